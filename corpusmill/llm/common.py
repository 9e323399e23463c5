"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import string
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch; bounds the memory of a Python worker for texts of usual length.
BATCH_ROWS = 500
#: Bytes of one Arrow batch, unless a single row is larger; bounds it for long texts.
BATCH_BYTES = 8 << 20
#: Sides of at most so many bytes are broadcast after they were measured; larger ones are shuffled.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session, as in tests, may leave that setting out; it gets a folder of its warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        base = spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
    if not base:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{base}/mill-{uuid.uuid4().hex}"


#: The folders written by the operators that are running, the innermost last.
_OPEN: list[list[str]] = []


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back.

    Cuts the lineage: a lost executor costs a reread of files, not a recomputation. Inside a ``tidy`` function the
    files go when the function has returned, unless its result reads them.
    """
    spark = df.sparkSession
    if path is None:
        path = shared_folder(spark)
        if _OPEN:
            _OPEN[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def tidy(function: Callable) -> Callable:
    """Deletes what ``written`` has written during a call, but for the files that the returned DataFrame reads."""

    @functools.wraps(function)
    def run(*args, **kwargs):
        _OPEN.append([])
        reads: list[str] = []
        try:
            out = function(*args, **kwargs)
            reads = out.inputFiles() if isinstance(out, DataFrame) else []
            return out
        finally:
            used = {folder for folder in (f.rpartition("/")[0].rpartition("/")[2] for f in reads)}
            for path in _OPEN.pop():
                if path.rpartition("/")[2] not in used:
                    _delete(path)
                elif _OPEN:
                    _OPEN[-1].append(path)

    return run


def _delete(path: str) -> None:
    spark = SparkSession.active()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bounds the rows and bytes of an Arrow batch, so that long texts do not pile up in one batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def _weight(name: str, kind: T.DataType) -> Column | int:
    """Bytes of a value in a broadcast relation, about."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(name), F.lit(0)) + 24
    if isinstance(kind, T.ArrayType):
        own = F.octet_length(F.array_join(name, "")) if isinstance(kind.elementType, T.StringType) else F.lit(0)
        return F.coalesce(own + F.size(name) * 24, F.lit(0)) + 24
    return 16


def size_in_bytes(df: DataFrame) -> int:
    """About what a written table takes as a broadcast relation, summed over its rows."""
    weights = [_weight(f"`{f.name}`", f.dataType) for f in df.schema]
    row = F.lit(32 + sum(w for w in weights if isinstance(w, int)))
    for w in weights:
        row = row if isinstance(w, int) else row + w
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def maybe_broadcast(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A broadcast hint only if the rows of ``df``, a written table, take at most ``most`` bytes; else the join shuffles."""
    return F.broadcast(df) if size_in_bytes(df) <= most else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: binds it as the variable of a one-element transform."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(c: Column, blanks: str = "") -> Column:
    """Lower-cases A-Z only, and makes each of ``blanks`` a space."""
    return F.translate(c, string.ascii_uppercase + blanks, string.ascii_lowercase + " " * len(blanks))


#: What a Python worker keeps from one task to the next: at most one operator's state.
_KEPT: dict = {}
#: Blocks of at least so many bytes go back to the system as soon as a worker frees them (the C library's option -3).
GIVEN_BACK = 1 << 20


def kept(key, make: Callable[[], object]):
    """``make()``, kept by the worker for its later tasks until a task asks for another key.

    So an operator's models and caches do not stay in workers that a later operator runs in.
    """
    if key not in _KEPT:
        _KEPT.clear()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):  # gives freed memory back where the C library can
            ctypes.CDLL(None).mallopt(-3, GIVEN_BACK)
            ctypes.CDLL(None).malloc_trim(0)
        _KEPT[key] = make()
    return _KEPT[key]


def release() -> None:
    """Frees what another operator's tasks have left in this worker."""
    kept(None, lambda: None)
