"""From raw documents to token ids: language ID, line dedup, near-duplicate join, decontamination and BPE coding.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the
columns of documents; the last returns one row of token and digest figures for each document that is left.

Null texts and texts without letters go in the first stage; null doc_ids, languages and sources stay as they are. An
empty table gives an empty result. Of equal texts one stays, so repeated rows end as one. Further columns of the table,
of whatever name, are dropped by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, decontaminate, jaccard, language, linededup
from corpusmill.llm.common import maybe_broadcast, shared_folder, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text no language model rejects; texts without letters go too."""
    return language.identify(docs, language.fit(docs)).where(~F.col("rejected")).select(COLUMNS)


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines stay in the first document that has them; documents without any other line go."""
    done = linededup.drop_recurring(docs).where(~F.col("emptied"))
    return done.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each component of similar texts; rows count one by one, whatever their doc_ids. Texts without
    words are similar to none."""
    keyed = written(docs.withColumn("_key", F.monotonically_increasing_id()))
    copies = written(jaccard.link_components(keyed, key="_key").where("doc_id <> component_id").select(F.col("doc_id").alias("_key")))
    return keyed.join(maybe_broadcast(copies), "_key", "left_anti").select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule leaves alone."""
    judged = decontaminate.judge(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    gone = written(judged.select(F.col("doc_id").alias("_d"), F.col("row").alias("_r")).distinct())
    keyed = docs.withColumn("_row", F.xxhash64("text"))
    return keyed.join(maybe_broadcast(gone), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_row") == F.col("_r")), "left_anti").select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their digests and the check of the way back."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_recurring_lines),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: The language models are no SQL; a test holds the rows of run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), shared_folder(spark))
    return docs
