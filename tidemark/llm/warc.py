"""WARC archives: writing, a normaliser for monolithic gzip files, and reading by offset.

``write_archives`` writes records as text, compressed by Spark as one gzip stream per file: the
form in which a file can only be read from its start.  ``normalise`` inflates each such stream once,
in pieces, rewrites every record as a gzip member of its own, and then writes a sidecar index (file,
offset, length, record id, type) read off the finished files.  ``fetch`` takes records by offset.

All files go through Spark's readers and writers, so any store that Spark reaches will do, and a
task that is run again replaces its file as a whole.  Members are written by the text writer with a
zero byte as separator: that byte is the last one of the member, the top byte of its length.

Rules
    * NULL html is an empty payload; NULL ids and urls leave their header out and come back NULL.
    * Tabs, line ends and spaces of a url are written as %XX.
    * A payload of ``least_bytes`` or more that several records share is stored once, with the record
      of the largest id; the others are revisits that name it.  Records that repeat that id all
      stay responses.  Equal payloads without any id stay responses.
    * An empty table gives no archives and no rows.

Scale: digests are compared in an aggregate of one narrow row per page; pages are shuffled only
if the payloads that repeat are too many to be sent to every executor (Spark then splits a payload
that very many pages share).
A file holds one task's rows, ``file_records`` at most, and is the unit that a task reads back.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import keep, new_path

LEAST_BYTES = 1000
FILE_RECORDS = 20_000
LEVEL = 6
#: Repeated payloads (a row of about 100 bytes each) that are sent to every executor.
SENT_ROWS = 200_000
CHUNK = 1 << 20
#: Output batches are cut at so many bytes.
BATCH_BYTES = 8 << 20
#: An empty gzip member: its last byte is zero, whatever the record before it was.
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
DATE = "2024-01-01T00:00:00Z"


def classify(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, bytes, digest, refers_to (NULL for responses)."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload).alias("digest"))
    shared = rows.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = keep(shared, "shared")
    # pages stay where they are while the payloads that repeat are few; else both sides are shuffled
    joined = rows.join(F.broadcast(shared) if shared.count() <= SENT_ROWS else shared, ["digest", "bytes"], "left")
    return joined.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("owner")), F.col("owner"))).drop("owner")


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing where the value is NULL."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _record() -> Column:
    """A record without its last line feed, which the writer adds."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    url = F.col("url")
    for code in (9, 10, 13, 32):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.col(c).cast("string"), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"), F.lit(f"\r\nWARC-Date: {DATE}\r\n"),
        _line("WARC-Record-ID", urn("page_id")), _line("WARC-Target-URI", url), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Refers-To", urn("refers_to")),
        F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n").otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r"),
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, file_records: int = FILE_RECORDS) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html); a file is one gzip stream."""
    rows = classify(pages, least_bytes).select(_record().alias("value"))
    rows.write.option("compression", "gzip").option("lineSep", "\n").option("maxRecordsPerFile", file_records).text(path)


def inflate(content: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file in pieces, over all its members."""
    d, at = zlib.decompressobj(31), 0
    while at < len(content) or d.unconsumed_tail or d.unused_data:
        if d.eof:
            rest = d.unused_data
            if not rest and at >= len(content):
                return
            d = zlib.decompressobj(31)
        else:
            rest = d.unconsumed_tail
        if not rest:
            rest, at = content[at : at + CHUNK], at + CHUNK
        piece = d.decompress(rest, 4 * CHUNK)
        if piece:
            yield piece
        elif not d.eof and at >= len(content) and not d.unconsumed_tail:
            break
    if not d.eof and len(content):
        raise ValueError("the gzip stream ends too soon")


_LENGTH = re.compile(rb"\r\nContent-Length:[ \t]*(\d+)", re.IGNORECASE)


def records_in(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, with the empty lines that end them."""
    held = bytearray()
    for piece in pieces:
        held += piece
        at = 0
        while (head := held.find(b"\r\n\r\n", at)) >= 0:
            found = _LENGTH.search(held, at, head + 2)
            if found is None:
                raise ValueError("a record without Content-Length")
            end = head + 4 + int(found[1]) + 4
            if len(held) < end:
                break
            yield bytes(held[at:end])
            at = end
        del held[:at]
    if held.strip():
        raise ValueError("the last record is cut off")


def member(record: bytes, level: int = LEVEL) -> bytes:
    """A gzip member whose last byte is zero."""
    packed = gzip.compress(record, level, mtime=0)
    return packed if packed[-1] == 0 else packed + EMPTY_MEMBER


def members_in(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of a file of one member per record; empty members belong to the one before."""
    at, held = 0, None
    while at < len(content):
        d = zlib.decompressobj(31)
        parts, pos = [], at
        while not d.eof:
            piece = content[pos : pos + CHUNK]
            if not piece:
                raise ValueError("the gzip stream ends too soon")
            parts.append(d.decompress(piece))
            pos += len(piece)
        end = pos - len(d.unused_data)
        record = b"".join(parts)
        if record:
            if held:
                yield held
            held = (at, end - at, record)
        elif held:
            held = (held[0], end - held[0], held[2])
        at = end
    if held:
        yield held


def parse(record: bytes) -> tuple[dict[str, str], int, bytes]:
    """Headers with lower-case names, the payload's length by its HTTP header, and the payload."""
    head, _, block = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.decode().lower()] = value.strip().decode()
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = _LENGTH.search(http)
    return fields, int(length[1]) if length else len(payload), payload


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(n)[i].as_py() for n in batch.schema.names}


def _page(urn: str | None) -> int | None:
    return int(urn[len("<urn:page:") : -1]) if urn else None


def normalise(spark: SparkSession, path: str, to: str, index: str) -> None:
    """Rewrites the archives below ``path`` to ``to`` with a member per record; offsets go to ``index``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            out, size = [], 0
            for record in records_in(inflate(row["content"])):
                out.append(member(record)[:-1])
                size += len(out[-1])
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])

    members = _files(spark, path).mapInArrow(split, "member binary")
    # a separator ends every row, so what is written is the members without a gap
    members.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\x00").option("compression", "none").text(to)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            found = [(a, n, parse(r)[0]) for a, n, r in members_in(row["content"])]
            yield pa.RecordBatch.from_pydict({
                "path": pa.array([row["path"]] * len(found), pa.string()), "offset": pa.array([f[0] for f in found], pa.int64()), "length": pa.array([f[1] for f in found], pa.int64()),
                "record_id": pa.array([f[2].get("warc-record-id") for f in found], pa.string()), "record_type": pa.array([f[2]["warc-type"] for f in found], pa.string()),
            })

    schema = "path string, offset long, length long, record_id string, record_type string"
    _files(spark, to).mapInArrow(entries, schema).write.parquet(index)


def _fields(path: str, offset: int, length: int, record: bytes) -> tuple:
    fields, size, payload = parse(record)
    digest = fields["warc-payload-digest"].removeprefix("sha1:")
    if fields["warc-type"] == "response" and (hashlib.sha1(payload).hexdigest() != digest or size != len(payload)):
        raise ValueError(f"digest of {fields.get('warc-record-id')} differs")
    return path, offset, length, _page(fields.get("warc-record-id")), fields.get("warc-target-uri"), size, digest, fields["warc-type"], _page(fields.get("warc-refers-to")), payload


def _in_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += len(row[-1])
        if size >= BATCH_BYTES:
            yield _batch(out)
            out, size = [], 0
    yield _batch(out)


def fetch(archives: DataFrame, index: DataFrame) -> DataFrame:
    """The records of ``index`` (path, offset, length) from ``archives`` (path, content), each by its offset.

    path, offset, length, page_id, url, payload_bytes, payload_digest, record_type, refers_to,
    payload.  The digest of a response is computed from its payload and must equal its header's.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            at = ((p["offset"], p["length"]) for p in row["places"])
            yield from _in_batches(_fields(row["path"], o, n, b"".join(inflate(row["content"][o : o + n]))) for o, n in at)

    places = index.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places"))
    return archives.join(places, "path").select("path", "content", "places").mapInArrow(read, _SCHEMA)


def read_all(archives: DataFrame) -> DataFrame:
    """All records of ``archives`` (path, content), member by member, as ``fetch`` gives them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _each(batches):
            yield from _in_batches(_fields(row["path"], o, n, r) for o, n, r in members_in(row["content"]))

    return archives.mapInArrow(read, _SCHEMA)


_FETCHED = (
    ("path", "string", pa.string()), ("offset", "long", pa.int64()), ("length", "long", pa.int64()), ("page_id", "long", pa.int64()), ("url", "string", pa.string()), ("payload_bytes", "long", pa.int64()), ("payload_digest", "string", pa.string()),
    ("record_type", "string", pa.string()), ("refers_to", "long", pa.int64()), ("payload", "binary", pa.binary()),
)


_SCHEMA = ", ".join(f"{n} {s}" for n, s, _ in _FETCHED)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, _, t) in enumerate(_FETCHED)], names=[n for n, _, _ in _FETCHED])


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES, file_records: int = FILE_RECORDS) -> DataFrame:
    """Archives of ``pages`` written, normalised and read back; the monolithic files are replaced.

    Every record is read where the index has it, so files are read in place and only the fields of
    the records meet the index; the payload itself is left out.
    """
    spark = pages.sparkSession
    whole, split, index = (new_path(spark, n) for n in ("warc-whole", "warc", "warc-index"))
    write_archives(pages, whole, least_bytes, file_records)
    normalise(spark, whole, split, index)
    _delete(spark, whole)
    entries = spark.read.schema("path string, offset long, length long, record_id string, record_type string").parquet(index)
    found = keep(read_all(_files(spark, split)).drop("payload"), "warc-records")
    return found.join(entries.select("path", "offset", "length"), ["path", "offset", "length"])


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
