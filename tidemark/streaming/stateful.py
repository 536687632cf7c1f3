"""Operators over signal streams whose state is one row per series.

A micro-batch is computed with the bucketed frames of the batch library, so a series that has a third of all
rows is not one group: its rows are numbered by a range shuffle, behind the stored row of the series,
and looked at through ``lag``.  What a series hands on to the next micro-batch is its last row, an aggregate that
combines before the shuffle.

States and results are written per micro-batch number.  A micro-batch that is run again after a failure reads
the state of the one before it and replaces its own results, so every change appears once.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.frame import SeriesFrame, number_rows, release, settle, step
from tidemark.functions.numeric import null_safe_false
from tidemark.operators.scores import score_band


# Fixed value: the state store these operators need.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Start stateful streams inside this block where the session does not name the RocksDB store."""
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


# A stored row comes before the rows of its series.
NEW = "is_new"


@dataclass(frozen=True)
class CarriedStream:
    """Changes of a stream, found with the last row of every series at hand.

    ``look`` gets a frame of the stored rows (``NEW`` false, the first of their series) and the new ones in
    order of time and returns the rows that count, stored ones included, with ``pos``.  The last of these in
    a series is stored; those with ``changed`` are written, with the columns of ``result``.  Late rows are
    taken in the order in which micro-batches bring them.
    """

    folder: str
    keys: tuple[str, ...]
    order: list[str]
    look: Callable[[SeriesFrame], DataFrame]
    changed: Column
    result: dict[str, Column]

    def _path(self, spark: SparkSession, kind: str, number: int):
        context = spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}/batch={number}")
        return path.toString(), path.getFileSystem(context._jsc.hadoopConfiguration()), path

    def handle(self, batch: DataFrame, number: int) -> None:
        """Take in one micro-batch."""
        spark = batch.sparkSession
        columns = batch.columns
        before, store, at = self._path(spark, "state", number - 1)
        stored = spark.read.schema(batch.schema).parquet(before) if number and store.exists(at) else spark.createDataFrame([], batch.schema)
        both = stored.withColumn(NEW, F.lit(False)).unionByName(batch.withColumn(NEW, F.lit(True)))
        rest = [c for c in columns if c not in (*self.keys, *self.order)]
        frame = number_rows(both, list(self.keys), [NEW, *self.order, *rest])
        found = settle(self.look(frame))
        found.where(F.col(NEW) & self.changed).select(*self.keys, *[c.alias(n) for n, c in self.result.items()]).write.mode("overwrite").parquet(
            self._path(spark, "out", number)[0])
        last = found.groupBy(*self.keys).agg(F.max_by(F.struct(*[c for c in columns if c not in self.keys]), "pos").alias("__last"))
        last.select(*self.keys, "__last.*").select(*columns).write.mode("overwrite").parquet(self._path(spark, "state", number)[0])
        release(found)
        release(frame.df)
        # the state before the last is not needed even if this micro-batch is run again
        if number > 1:
            _, store, old = self._path(spark, "state", number - 2)
            store.delete(old, True)

    def start(self, source: DataFrame) -> StreamingQuery:
        """Run over what is there now; the same folder goes on from there."""
        return source.writeStream.foreachBatch(self.handle).option("checkpointLocation", f"{self.folder}/log").trigger(availableNow=True).start()

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        """All changes so far; none before the first micro-batch."""
        _, store, at = self._path(spark, "out", 0)
        if not store.exists(at):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.folder}/out/batch=*")


def _before(frame: SeriesFrame, columns: dict[str, str]) -> SeriesFrame:
    """Values of the previous row of the series."""
    return frame.derive([step(name, lambda span, name=name, c=c: {name: F.lag(c, 1).over(span.ordered)}, 1) for name, c in columns.items()])


def _other_side(frame: SeriesFrame) -> DataFrame:
    """Rows whose side is not that of the row before, with the price of the change before."""
    turned = _before(frame, {"before": "side"}).df
    turned = turned.where(~F.col(NEW) | F.col("before").isNull() | (F.col("before") != F.col("side"))).drop("pos", "before")
    values = [c for c in turned.columns if c not in (*frame.keys, NEW, "ts")]
    return _before(number_rows(turned, list(frame.keys), [NEW, "ts", *values]), {"earlier": "price"}).df


TRANSACTIONS = "series string, ts timestamp, price double, profit double, status string"


def stream_transactions(signals: DataFrame, series: str, buy: str, sell: str, price: str, folder: str, ts: str = "ts") -> CarriedStream:
    """Alternating transactions of a signal stream, run to the end of what is there; ``read(spark, TRANSACTIONS)`` gives them.

    A signal of the side that was taken last is passed over, and so are rows with both signals.  The first
    transaction, and one after a price of 0 or NULL, has profit 0.
    """
    b, s = null_safe_false(F.col(buy)), null_safe_false(F.col(sell))
    rows = signals.where(b != s).select(
        F.col(series).cast("string").alias("series"), F.col(ts).alias("ts"), F.col(price).cast("double").alias("price"),
        F.when(b, "BUY").otherwise("SELL").alias("side"))
    earlier = F.col("earlier")
    gain = F.when(F.col("side") == "BUY", earlier - F.col("price")).otherwise(F.col("price") - earlier)
    profit = F.when(earlier.isNull() | (earlier == 0), F.lit(0.0)).otherwise(gain)
    stream = CarriedStream(folder, ("series",), ["ts"], _other_side, F.lit(True),
                           {"ts": F.col("ts"), "price": F.col("price"), "profit": profit, "status": F.col("side")})
    stream.start(rows).awaitTermination()
    return stream


BANDS = "series string, ts timestamp, score double, band int, band_up boolean, band_down boolean"


def stream_band_changes(scores: DataFrame, series: str, score: str, positive: list[float], negative: list[float], folder: str,
                        ts: str = "ts") -> CarriedStream:
    """Rows of a score stream at which the size of the band changes; ``read(spark, BANDS)`` gives them."""
    rows = scores.select(F.col(series).cast("string").alias("series"), F.col(ts).alias("ts"), F.col(score).cast("double").alias("score"),
                         score_band(F.col(score), positive, negative).cast(T.IntegerType()).alias("band"))
    first, size = F.col("before").isNull(), F.abs("band")

    changed = first | (size != F.abs("before"))
    stream = CarriedStream(folder, ("series",), ["ts"], lambda frame: _before(frame, {"before": "band"}).df, changed, {
        "ts": F.col("ts"), "score": F.col("score"), "band": F.col("band"), "band_up": first | (size > F.abs("before")),
        "band_down": first | (size < F.abs("before"))})
    stream.start(rows).awaitTermination()
    return stream
