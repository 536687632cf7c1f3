"""Exact deduplication as a stateful stream.

Texts are equal when they are identical after lower-casing A-Z only.  Documents arrive as a stream of
files.  Two streaming queries follow each other, both restart from their logs:

* ``seen``: a row per document with the digest of its text, its identifier and its locator, that is
  the file and the row in it; texts stay where they are.
* ``state``: one entry per digest, kept on disk by the RocksDB state store and never expired.  It
  retains the digest, the row that stays (identifier and locator) and the number of rows.  Rows are
  combined before the shuffle, so a third of all rows with one text costs one entry per task.

``decisions`` joins the rows with their entry.  Equal digests are hits; the texts of all hits are read
through their locators and compared in full: a group is confirmed when its least and its greatest
text are the same bytes, an aggregate that again combines before the shuffle.  Groups in which
texts differ are split by the whole text.

Defined results: a NULL text is an empty text.  Of equal texts the row with the largest identifier
stays, NULL being the smallest; of equal identifiers the one that comes last by file and row, so one
row of each group stays whatever repeats.  An empty table gives an empty result.  Only the two named
columns of a table are read, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tidemark.llm.common import keep, new_path

#: Bytes of input files that one micro-batch reads.
BATCH_BYTES = 1 << 40
#: State on disk; a store takes the space it fills and no more, as a store per partition may be small.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


@contextmanager
def _on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams and state used here lie in RocksDB; the settings are as before afterwards."""
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _pattern(path: str) -> str:
    """The same path as a pattern: a stream takes a single file only from a pattern."""
    return f"{path[:-1]}[{path[-1]}]"


def _located(rows: DataFrame, key: str, text: str) -> DataFrame:
    return rows.select(
        F.col(key).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), normalised(F.col(text)).alias("text")
    )


def _through(writer: DataStreamWriter, log: str) -> None:
    writer.option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()


class ExactDedup:
    """Digests and state of a growing folder of Parquet files, kept below ``folder``.

    ``folder`` must be shared by driver and executors.  ``digest`` maps a normalised text to a string;
    any function gives right results, a weak one more texts to compare.
    """

    def __init__(self, spark: SparkSession, path: str, folder: str | None = None, key: str = "doc_id", text: str = "text",
                 digest: Callable[[Column], Column] = sha256, batch_bytes: int = BATCH_BYTES):
        self.spark, self.path, self.folder = spark, path, folder or new_path(spark, "exact")
        self.key, self.text, self.digest, self.batch_bytes = key, text, digest, batch_bytes
        self.schema = spark.read.parquet(path).select(key, text).schema
        self.columns = f"id {self.schema[key].dataType.simpleString()}, file string, row long, digest string"

    def absorb(self) -> ExactDedup:
        """Take in the files that are new since the last call."""
        source = self.spark.readStream.schema(self.schema).option("maxBytesPerTrigger", self.batch_bytes).parquet(_pattern(self.path))
        rows = _located(source, self.key, self.text)
        rows = rows.select("id", "file", "row", self.digest(F.col("text")).alias("digest"))
        _through(rows.writeStream.format("parquet").option("path", f"{self.folder}/seen"), f"{self.folder}/seen-log")
        with _on_disk(self.spark):
            seen = self.spark.readStream.schema(self.columns).option("maxBytesPerTrigger", self.batch_bytes).parquet(f"{self.folder}/seen")
            entries = seen.groupBy("digest").agg(F.max(F.struct("id", "file", "row")), F.count(F.lit(1)))
            _through(entries.writeStream.outputMode("update").format("noop"), f"{self.folder}/state")
        return self

    def seen(self) -> DataFrame:
        """(id, file, row, digest) of every document so far."""
        return self.spark.read.schema(self.columns).parquet(f"{self.folder}/seen")

    def entries(self) -> DataFrame:
        """(digest, stays, n): the state, with identifier and locator of the row that stays."""
        if self.seen().isEmpty():
            kind = self.schema[self.key].dataType.simpleString()
            return self.spark.createDataFrame([], f"digest string, stays struct<id:{kind},file:string,row:long>, n long")
        state = self.spark.read.format("statestore").load(f"{self.folder}/state")
        return state.select("key.digest", F.col("value.max").alias("stays"), F.col("value.count").alias("n"))

    def texts(self) -> DataFrame:
        """(id, file, row, text) of every document, read from its file."""
        return _located(self.spark.read.schema(self.schema).parquet(_pattern(self.path)), self.key, self.text)

    def decisions(self) -> DataFrame:
        """(id, digest, keep_id, group_size, kept) of every document so far."""
        with _on_disk(self.spark):
            found = keep(self.seen().join(self.entries(), "digest"), "found")
        # the hash stands for a long path; two files of one hash would only mean a text more to compare
        place = F.xxhash64("file").alias("place")
        hits = keep(found.where("n > 1").select(place, "row").distinct(), "hits")
        texts = self.texts().withColumn("place", place).join(hits, ["place", "row"]).withColumn("digest", self.digest(F.col("text")))
        mixed = texts.groupBy("digest").agg((F.min("text") < F.max("text")).alias("mixed")).where("mixed")
        mixed = keep(mixed.select("digest"), "mixed")
        if not mixed.isEmpty():
            rows = texts.join(mixed, "digest")
            whole = rows.groupBy("digest", "text").agg(F.max(F.struct("id", "file", "row")).alias("stays"), F.count(F.lit(1)).alias("n"))
            split = rows.join(whole, ["digest", "text"]).select(*found.columns)
            found = found.join(mixed, "digest", "left_anti").union(split)
        stays = (F.col("file") == F.col("stays.file")) & (F.col("row") == F.col("stays.row"))
        return found.select("id", "digest", F.col("stays.id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"))


def deduplicate(spark: SparkSession, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document of the Parquet table at ``path``: key, keep_id, group_size, kept, text_sha256."""
    found = ExactDedup(spark, path, key=key, text=text).absorb().decisions()
    return found.select(F.col("id").alias(key), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))
