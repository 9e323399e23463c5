"""Legacy web archives (ARC) to WARC.

``pages_to_arc`` lays pages out as ARC segments (a version block and records of a header line and a body of the
declared length), ``parse_arc`` reads ARC of version 1 or 2 by its header lines and declared lengths, and
``write_warc`` synthesises WARC records: deterministic record ids, timestamps, types and payload digests. A record
whose payload (of ``least`` bytes or more) equals that of another is a revisit of the one with the largest page
id. ``read_warc`` parses the archives back. Archives are gzip files written by Spark's text writer, whose line
separator is the record separator of the format.

Nulls: a null html is an empty payload, a null url is written as "-" and read back as such; a record without a
page id is always a response. Rows with the same page id and payload have the same type and stay as many as they
are. An empty table gives archives without records and no rows. Of pages only page_id, url and html are read, so
further columns may have any name. A worker holds a packed file and one unpacked record, so a very long page is fine
as long as it fits a worker alone.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, release, shared_folder, small_batches, tidy, written

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
SEGMENT_BYTES = 4 << 20
#: Bytes of an archive that are unpacked at once.
PART_BYTES = 1 << 20
#: Field names of the ARC versions, in the order of their header lines. Fixed values.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace
RECORD = "page_id long, url string, ip string, fetched string, content_type string, http binary, payload binary, payload_bytes long, payload_digest string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, payload_ok boolean"


def version_block(version: int, length_of_rest: int = 0) -> bytes:
    """The first record of an ARC file."""
    body = f"{version} 0 corpusmill\n{' '.join(ARC_FIELDS[version])}\n".encode()
    fields = {"URL": "filedesc://pages.arc", "IP-address": "0.0.0.0", "Archive-date": f"{EPOCH:%Y%m%d%H%M%S}", "Content-type": "text/plain", "Archive-length": str(len(body))}
    return " ".join(fields.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def arc_record(page_id: int | None, url: str | None, html: bytes, version: int) -> bytes:
    head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"X-Page-Id: {page_id}\r\n" if page_id is not None else "") + f"Content-Length: {len(html)}\r\n\r\n"
    body = head.encode() + html
    when = EPOCH + timedelta(seconds=(page_id or 0) % (86400 * 365))
    fields = {"URL": re.sub(r"\s", "%20", url or "") or "-", "IP-address": "0.0.0.0", "Archive-date": f"{when:%Y%m%d%H%M%S}", "Content-type": "text/html", "Result-code": "200", "Archive-length": str(len(body))}
    return " ".join(fields.get(f, "-") for f in ARC_FIELDS[version]).encode() + b"\n" + body + b"\n"


def unpacked(data: bytes):
    """The bytes of an archive, plain or gzip with one or more members, part by part."""
    if data[:2] != b"\x1f\x8b":
        for at in range(0, len(data), PART_BYTES):
            yield data[at : at + PART_BYTES]
        return
    at, member, raw = 0, zlib.decompressobj(31), b""
    while raw or at < len(data):
        if not raw:
            raw, at = data[at : at + PART_BYTES], at + PART_BYTES
        yield member.decompress(raw, PART_BYTES)
        if member.eof:
            raw, member = member.unused_data, zlib.decompressobj(31)
        else:
            raw = member.unconsumed_tail


class Bytes:
    """An archive that is unpacked as its bytes are asked for; at most a record is held unpacked."""

    def __init__(self, data: bytes) -> None:
        self.parts, self.held = unpacked(data), bytearray()

    def more(self) -> bool:
        """Unpacks a part more; False at the end."""
        part = next(self.parts, None)
        self.held += part or b""
        return part is not None

    def until(self, mark: bytes) -> bytes | None:
        """The bytes before the mark, which is read as well; None if it does not come."""
        looked = 0
        while (end := self.held.find(mark, looked)) < 0:
            looked = max(0, len(self.held) - len(mark))
            if not self.more():
                return None
        out = bytes(self.held[:end])
        del self.held[: end + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n and self.more():
            pass
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def arc_records(data: bytes):
    """(fields, body) of each record after the version block, by the header lines and declared lengths.

    A line where a header is due that has no length at its end is skipped; a body cut short is what there is of it.
    """
    source, names = Bytes(data), None
    while (raw := source.until(b"\n")) is not None:
        line = raw.decode("utf-8", "replace").rstrip("\r").split(" ")
        if not line[-1].isdigit():
            continue
        body = source.take(int(line[-1]))
        if line[0].startswith("filedesc:"):
            block = body.decode("utf-8", "replace").split("\n")
            version = block[0].split()[:1]
            names = ARC_FIELDS.get(int(version[0]) if version and version[0].isdigit() else 0) or (block[1].split() if len(block) > 1 else None)
            continue
        fields = names or ARC_FIELDS[1 if len(line) == 5 else 2]
        if len(line) > len(fields):  # spaces inside the URL
            line = [" ".join(line[: len(line) - len(fields) + 1]), *line[len(line) - len(fields) + 1 :]]
        yield dict.fromkeys(ARC_FIELDS[2], "-") | dict(zip(fields, line, strict=False)), body


def split_http(body: bytes) -> tuple[bytes, bytes]:
    """Status line with headers, and payload; a body that is not HTTP is all payload."""
    if body[:5] != b"HTTP/":
        return b"", body
    cut = body.find(b"\r\n\r\n")
    return (body, b"") if cut < 0 else (body[: cut + 4], body[cut + 4 :])


def pages_to_arc(pages: DataFrame, version: int = 2) -> DataFrame:
    """ARC segments of the pages: one binary column ``content``, each a valid ARC file of some megabytes."""
    small_batches(pages.sparkSession)

    def run(batches):
        held, size = [version_block(version)], 0
        for b in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(arc_record(page_id, url, html or b"", version))
                size += len(held[-1])
                if size >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])
                    held, size = [version_block(version)], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["content"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("binary").alias("html")).mapInArrow(run, "content binary")


def parse_arc(content: DataFrame) -> DataFrame:
    """Records of ARC files or segments (column ``content``), with their payloads as bytes."""
    small_batches(content.sparkSession, 4)
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]

    def run(batches):
        release()
        rows, size = [], 0
        for b in batches:
            for data in b.column(0).to_pylist():
                for f, body in arc_records(data or b""):
                    http, payload = split_http(body)
                    found = re.search(rb"(?im)^X-Page-Id: (-?\d+)", http)
                    rows.append((int(found[1]) if found else None, f["URL"], f["IP-address"], f["Archive-date"], f["Content-type"], http, payload, len(payload), hashlib.sha1(payload).hexdigest()))
                    size += len(body)
                    if len(rows) == 256 or size >= PART_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return content.select("content").mapInArrow(run, RECORD)


def revisits(slim: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, payload_digest, refers_to) of the records that revisit another, one row for repeated records.

    The groups of equal payloads are reduced to one row each before the join, so a large group is only ever
    joined with a single row, which Spark can split.
    """
    some = slim.select("page_id", "payload_bytes", "payload_digest").where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).select("page_id", "payload_digest").distinct()
    last = some.groupBy("payload_digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("_first")).where("_first < refers_to").drop("_first")
    return some.join(last, "payload_digest").where("page_id < refers_to")


def record_id(page_id: int | None, url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id} {url} {date} {digest}')}>"


def warc_record(x: dict) -> bytes:
    """A WARC record without its closing blank lines."""
    t = x["fetched"] if re.fullmatch(r"\d{14}", x["fetched"]) else f"{EPOCH:%Y%m%d%H%M%S}"
    date = f"{t[:4]}-{t[4:6]}-{t[6:8]}T{t[8:10]}:{t[10:12]}:{t[12:14]}Z"
    revisit = x["refers_to"] is not None
    block = x["http"] + (b"" if revisit else x["payload"])
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(x['page_id'], x['url'], x['fetched'], x['payload_digest'])}", f"WARC-Date: {date}", f"WARC-Target-URI: {x['url']}", f"WARC-IP-Address: {x['ip']}"]
    head += [f"WARC-Payload-Digest: sha1:{x['payload_digest']}", f"X-Payload-Length: {x['payload_bytes']}"]
    head += [f"X-Page-Id: {x['page_id']}"] if x["page_id"] is not None else []
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-Id: {x['refers_to']}"]
    return "\r\n".join([*head, "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]).encode() + block


def write_warc(records: DataFrame, seen: DataFrame, path: str) -> None:
    """Writes one WARC record for each ARC record; ``seen``, a written table, tells the revisits (see ``revisits``).

    Records are bytes all the way: the text writer gets them as they are, of whatever coding. A file is one gzip
    member.
    """
    small_batches(records.sparkSession)
    # joined by page and payload, of which no group is large in ``seen``
    marked = records.join(maybe_broadcast(seen), ["page_id", "payload_digest"], "left")

    def run(batches):
        info = "format: WARC File Format 1.1\r\n"
        first = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(NAMESPACE, info)}>\r\nWARC-Date: {EPOCH:%Y-%m-%dT%H:%M:%SZ}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n{info}".encode()
        for b in batches:
            rows = [warc_record(x) for x in b.to_pylist()]
            if rows and first:
                rows, first = [first, *rows], b""
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["value"])

    raw = marked.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    raw.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def warc_records(data: bytes):
    """(fields, block) of each WARC record, by its declared length; other lines between records are skipped."""
    source = Bytes(data)
    while (line := source.until(b"\r\n")) is not None:
        if not line.startswith(b"WARC/"):
            continue
        head = source.until(b"\r\n\r\n")
        if head is None:
            return
        fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n") if ": " in x)
        yield fields, source.take(int(fields["Content-Length"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of WARC files, plain or gzip; payload_ok: the digest of the payload read is
    the declared one (null for revisits, which have none)."""
    small_batches(spark, 4)
    files = spark.read.format("binaryFile").load(path).select("content")
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches):
        for b in batches:
            for data in b.column(0).to_pylist():
                rows = []
                for f, block in warc_records(data):
                    if f["WARC-Type"] not in ("response", "revisit"):
                        continue
                    page, to = f.get("X-Page-Id"), f.get("X-Refers-To-Page-Id")
                    digest, size, ok = f["WARC-Payload-Digest"].removeprefix("sha1:"), int(f["X-Payload-Length"]), None
                    if f["WARC-Type"] == "response":
                        payload = split_http(block)[1]
                        size, ok = len(payload), hashlib.sha1(payload).hexdigest() == digest
                        digest = digest if ok else hashlib.sha1(payload).hexdigest()
                    if len(rows) == 5000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[x.split()[1]]) for i, x in enumerate(READ.split(", "))], [x.split()[0] for x in READ.split(", ")])
                        rows = []
                    rows.append((int(page) if page else None, f["WARC-Target-URI"], size, digest, f["WARC-Type"], int(to) if to else None, f["WARC-Record-ID"], f["WARC-Date"], ok))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[x.split()[1]]) for i, x in enumerate(READ.split(", "))], [x.split()[0] for x in READ.split(", ")])

    return files.mapInArrow(run, READ)


@tidy
def convert(arc: DataFrame, path: str, least: int = LEAST_BYTES) -> None:
    """Converts ARC content to WARC files below ``path``; the archives are parsed once, into a table of records."""
    records = written(parse_arc(arc))
    write_warc(records, written(revisits(records, least)), path)


def convert_files(spark: SparkSession, arc_path: str, warc_path: str) -> None:
    """Converts ARC files, plain or gzip."""
    convert(spark.read.format("binaryFile").load(arc_path).select("content"), warc_path)


def pages_round_trip(pages: DataFrame, path: str | None = None, version: int = 2) -> DataFrame:
    """Pages as ARC, converted to WARC files and read back."""
    path = path or shared_folder(pages.sparkSession)
    convert(pages_to_arc(pages, version), path)
    return read_warc(pages.sparkSession, path)
