"""WARC archives: a writer on Spark's text sink and a salvage reader.

Writer: one WARC/1.1 record per row, payload = the text in UTF-8. Records are written by Spark's own
file commit, so lost tasks leave no half-written archive; each is a gzip member of its own (or plain), and
members are set apart by one zero byte, which gzip readers skip as padding. A task opens a new archive after a bound of
records or of bytes, so no archive outgrows the reader, whatever the size of its pages. Rows with equal
payloads are archived once: the smallest id is the response, the others are revisit records that refer to it.

Salvage reader: every archive is checked record by record (version line, header
lines, Content-Length inside the file, trailer, payload digest). A payload with a wrong digest whose trailer stands before the
next record or the file's end is quarantined as a whole: records quoted inside it are none. After any other failed check it searches for the
next version line (or gzip member) that starts a valid record, goes on from there, and logs the skipped
bytes as a quarantined gap. Plain files and files of gzip members are read.

Defined results: a null payload is empty; a null id is kept (never referred to by others unless
all ids of that payload are null); repeated rows get one record each; an empty table
writes no record; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.llm.common import prepare, stored

VERSION = "WARC/1.1"
CRLF = "\r\n"
TRAILER = b"\r\n\r\n"
NO_ID = "null"
#: Largest table of revisits (64 bytes each) that is broadcast to the pages; beyond it both sides are shuffled by id.
BROADCAST_BYTES = 16 << 20
#: Bytes after which a task opens a new archive.
ARCHIVE_BYTES = 256 << 20
#: Stands between gzip members.
PADDING = b"\0"
ID_PREFIX = "urn:page:"
#: Characters that would end a header line; percent-escaped in header values, with % itself.
HEADER_ESCAPES = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))

_BASE32_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_RFC4648 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a string's UTF-8 bytes: four groups of 40 bits."""
    digest = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substr(digest, F.lit(1 + 10 * i), F.lit(10)), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), _BASE32_DIGITS, _RFC4648)


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html",
                 uri_col: str | None = "url", min_revisit_bytes: int = 0) -> DataFrame:
    """id, uri, payload, payload_bytes, digest, record_type, refers_to for every row.

    Only (id, digest) rows are grouped, with map-side partial minima, so a payload shared by a
    third of all rows is no hot group; whole payloads stay where they are unless the revisits are too many to broadcast.
    """
    uri = F.col(uri_col) if uri_col else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).alias("id"), uri.alias("uri"),
                        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    keyed = rows.select("id", F.octet_length("payload").cast("long").alias("n"),
                        sha1_base32(F.col("payload")).alias("digest")).where(F.col("n") >= min_revisit_bytes)
    first = keyed.groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"),
                                        F.count_distinct("id").alias("ids")).where("copies > 1")
    repeats = (keyed.join(first, "digest").where("id <> first_id and ids > 1")
               .groupBy("id", "digest").agg(F.min("first_id").alias("refers_to")))
    repeats = stored(repeats, "warc-repeats")
    if repeats.count() * 64 <= BROADCAST_BYTES:
        repeats = F.broadcast(repeats)
    out = rows.withColumn("digest", sha1_base32(F.col("payload")))
    return (out.join(repeats, ["id", "digest"], "left")
            .select("id", "uri", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), "digest",
                    F.when(F.col("refers_to").isNull(), "response").otherwise("revisit").alias("record_type"),
                    "refers_to"))


def _header_value(value: Column) -> Column:
    for plain, coded in HEADER_ESCAPES:
        value = F.replace(value, F.lit(plain), F.lit(coded))
    return value


def _record_id(value: Column) -> Column:
    return F.concat(F.lit("<" + ID_PREFIX), F.coalesce(value.cast("string"), F.lit(NO_ID)), F.lit(">"))


def write_warc(records: DataFrame, path: str, date: str = "2026-01-01T00:00:00Z",
               records_per_file: int = 5000, compress: bool = True, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write planned records (see `plan_records`) as WARC files below `path`: gzip members, or plain.

    A file holds at most `records_per_file` records, and at most `archive_bytes` and its last record.
    """
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, "").otherwise(F.col("payload"))
    lines = [
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _header_value(F.col("uri"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Length: "), F.col("payload_bytes")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to")))),
        F.when(revisit, F.lit("WARC-Profile: "
                              "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body)),
    ]
    head = F.concat_ws(CRLF, *lines)
    plain = records.select(F.concat(head, F.lit(CRLF + CRLF), body).alias("value"))
    prepare(records.sparkSession)
    coded = plain.mapInArrow(lambda it: _members(it, compress, archive_bytes), "value binary, volume long")
    members = coded.select(F.col("value").cast("string"), "volume")  # the bytes as they are
    (members.write.partitionBy("volume").option("lineSep", PADDING.decode() if compress else TRAILER.decode())
     .option("maxRecordsPerFile", records_per_file).text(path))


def _members(batches: Iterator[pa.RecordBatch], compress: bool, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Records as they stand in the archive, and the number of the task's archive that each goes to."""
    volume = held = 0
    for batch in batches:
        members, volumes = [], []
        for value in batch.column(0):
            member = value.as_py().encode("utf-8")
            if compress:
                member = gzip.compress(member + TRAILER, 6, mtime=0)
            if held >= archive_bytes:
                volume, held = volume + 1, 0
            held += len(member)
            members.append(member)
            volumes.append(volume)
        yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary()), pa.array(volumes, pa.int64())], names=["value", "volume"])


# -- salvage reader --------------------------------------------------------------

_NEXT = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
_HEAD = re.compile(rb"WARC/1\.[01]\r\n((?:[A-Za-z-]+:[^\r\n]*\r\n)+)\r\n")


_FOLLOWS = re.compile(rb"\0*+(?:WARC/1\.[01]\r\n|\x1f\x8b\x08|\Z)")


def _parse_at(data: bytes, at: int):
    """(failed check, end, headers, payload) of a plain record at `at`; without a failure the check is ''.

    The end of a failed record is None unless its extent is sure: the trailer stands, and the next record or the file's end after it.
    """
    m = _HEAD.match(data, at)
    if not m:
        return "header", None, None, None
    headers = {}
    for line in m[1].split(b"\r\n")[:-1]:
        name, _, value = line.partition(b":")
        headers[name.decode("ascii").lower()] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit() and len(length) < 20):
        return "content-length", None, None, None
    end = m.end() + int(length)
    if end > len(data):
        return "truncated", None, None, None
    if data[end:end + 4] != TRAILER:
        return "trailer", None, None, None
    payload = data[m.end():end]
    digest = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") == "response" and digest.startswith("sha1:"):
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest[5:]:
            return "digest", end + 4 if _FOLLOWS.match(data, end + 4) else None, None, None
    return "", end + 4, headers, payload


def _member_at(data: bytes, at: int):
    """(end, bytes) of a valid gzip member at `at`, or None."""
    d, out, pos = zlib.decompressobj(wbits=31), [], at
    try:
        while not d.eof and pos < len(data):
            out.append(d.decompress(data[pos:pos + 65536]))
            pos += 65536
    except zlib.error:
        return None
    return (min(pos, len(data)) - len(d.unused_data), b"".join(out)) if d.eof else None


def salvage(data: bytes) -> Iterator[tuple]:
    """Records and gaps of one archive, in order.

    Yields ("record", start, end, headers, payload) and ("gap", start, end, failed check);
    offsets are bytes of `data`. Records of a gzip member carry the member's offsets.
    """
    at = 0
    while at < len(data):
        if data[at:at + 1] == PADDING:
            at += 1
            continue
        found, why = [], ""
        if data[at:at + 3] == b"\x1f\x8b\x08":
            member = _member_at(data, at)
            if member is None:
                why = "gzip"
            else:
                end, inner = member
                for item in salvage(inner):
                    if item[0] == "record":
                        found.append(("record", at, end, item[3], item[4]))
                    else:
                        found.append(("gap", at, end, "member: " + item[3]))
        else:
            why, end, headers, payload = _parse_at(data, at)
            if not why:
                found.append(("record", at, end, headers, payload))
            elif end is not None:
                found.append(("gap", at, end, why))
                why = ""
        if not why:
            yield from found
            at = end
            continue
        start = at
        while True:
            m = _NEXT.search(data, at + 1)
            if not m:
                at = len(data)
                break
            at = m.start()
            if data[at:at + 1] == b"\x1f":
                if _member_at(data, at) is not None:
                    break
            elif _parse_at(data, at)[1] is not None:
                break
        yield "gap", start, at, why


RECORD_SCHEMA = ("path string, start long, end long, kind string, why string, record_type string, record_id string, "
                 "refers_to string, target_uri string, payload_digest string, payload_bytes long, payload binary")


def _id_of(value: str | None) -> str | None:
    if not value:
        return None
    inner = value.strip("<>").removeprefix(ID_PREFIX)
    return None if inner == NO_ID else inner


def _unescape_header(value: str | None) -> str | None:
    if value is not None:
        for plain, coded in reversed(HEADER_ESCAPES):
            value = value.replace(coded, plain)
    return value


def _read_files(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()),
                        ("why", pa.string()), ("record_type", pa.string()), ("record_id", pa.string()),
                        ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload", pa.binary())])
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            out, held = [], 0
            for item in salvage(content.as_py()):
                if item[0] == "gap":
                    out.append((path.as_py(), item[1], item[2], "gap", item[3], *[None] * 7))
                else:
                    h, payload = item[3], item[4]
                    full = h.get("x-payload-length")
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    out.append((path.as_py(), item[1], item[2], "record", None, h.get("warc-type"),
                                _id_of(h.get("warc-record-id")), _id_of(h.get("warc-refers-to")),
                                _unescape_header(h.get("warc-target-uri")), digest,
                                int(full) if full and full.isdigit() else len(payload),
                                payload if with_payload else None))
                    held += len(payload)
                if held > (4 << 20) or len(out) >= 5000:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)
                    out, held = [], 0
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """All records and gaps of the archives below `path` (kind `record` or `gap`).

    One archive file is read by one task, so archives should be written at a bounded size
    (`records_per_file`, `archive_bytes`); Spark's reader fetches them, so any store that Spark reads will do.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(lambda it: _read_files(it, with_payload), RECORD_SCHEMA)


def gap_log(read: DataFrame) -> DataFrame:
    """Quarantined byte ranges: path, start, end, why."""
    return read.where("kind = 'gap'").select("path", "start", "end", "why")


def records(read: DataFrame) -> DataFrame:
    return read.where("kind = 'record'")
