"""Bars kept up to date by Structured Streaming.

The table of bars is a Parquet folder partitioned by day.  Every micro-batch overwrites the
rows it brings (late or changed data included), recomputes the derived columns of the rows
these can influence, and rewrites the days concerned.  A repeated batch gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.frame import SeriesFrame, join_on, release, settle
from tidemark.functions.intervals import freq_us, intervals_since, starts_longer_interval
from tidemark.operators.raster import densify
from tidemark.operators.upsert import replace_rows

DAY = "day"
KNOWN = "known__row"


def stream_table(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Stream the Parquet files of a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP columns, not TIMESTAMP_NTZ."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def tumbling_bars(ticks: DataFrame, keys: list[str], freq: str, value: str, ts: str = "ts", late: str = "1 hour",
                  tie: str | None = None) -> DataFrame:
    """Bars of a tick stream, emitted once the watermark has passed their end.

    The bars that the watermark has not passed stay in the state: after the last batch of a finite
    input these are the last ones, which ``resample`` gives in batch.

    With the series in the key a hot series still combines on the map side of every batch.
    """
    # as in batch, a bar opens and closes with values that are known
    order = F.when(F.col(value).isNotNull(), F.struct(ts, tie) if tie else F.col(ts))
    width = f"{freq_us(freq)} microseconds"
    return ticks.withWatermark(ts, late).groupBy(*keys, F.window(ts, width).alias("w")).agg(
        F.min_by(value, order).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"),
        F.max_by(value, order).alias("close"), F.sum(value).alias("volume"), F.count(value).alias("trades"),
    ).select(*keys, F.col("w.start").alias(ts), "open", "high", "low", "close", "volume", "trades")


def exact_repeats_removed(df: DataFrame, columns: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Drop rows delivered twice within the lateness bound."""
    return df.withWatermark(ts, late).dropDuplicatesWithinWatermark(columns)


@dataclass(frozen=True)
class BarTable:
    """A folder of bars with derived columns.

    ``derive`` adds the derived columns to a dense frame; ``lookback`` is the number of
    earlier rows it reads, so a changed row influences itself and that many later rows.  Of rows
    of one series and time the last one counts, by ``arrival`` if that names a column.  Rows before the
    last ``retain_rows`` intervals of a series are deleted.
    """

    path: str
    keys: tuple[str, ...]
    freq: str
    ts: str = "ts"
    lookback: int = 0
    derive: Callable[[SeriesFrame], SeriesFrame] | None = None
    retain_rows: int | None = None
    arrival: str | None = None

    def exists(self, spark: SparkSession) -> bool:
        """Whether the folder exists, on whatever file system the path names."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(self.path).drop(DAY)

    def _derived(self, bars: DataFrame, *more_keys: str) -> DataFrame:
        frame = densify(bars, [*self.keys, *more_keys], self.ts, self.freq)
        return (self.derive(frame) if self.derive else frame).df.drop("pos")

    def _write(self, df: DataFrame, mode: str) -> None:
        out = df.withColumn(DAY, F.to_date(self.ts))
        out.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(DAY).parquet(self.path)

    def backfill(self, bars: DataFrame) -> None:
        """Cold start: the full history in one batch job."""
        self._write(self._derived(self._latest(bars)), "overwrite")

    def _latest(self, bars: DataFrame) -> DataFrame:
        """One row per series and time: the last by ``arrival``, or else by the order of the rows."""
        key, order = [*self.keys, self.ts], F.col(self.arrival) if self.arrival else F.monotonically_increasing_id()
        last = bars.withColumn("__order", order).groupBy(*key).agg(F.max_by(F.struct(*bars.columns), "__order").alias("__row"))
        return last.select("__row.*")

    def _segments(self, new: DataFrame, stored: DataFrame) -> DataFrame:
        """keys, seg__, __lo, __hi: the stretches that the new rows of each series touch, in microseconds.

        A row behind the stored end starts there, so that the raster between is built.  Stretches
        whose context overlaps are one.
        """
        reach, at = self.lookback * freq_us(self.freq), F.unix_micros(self.ts)
        ends = stored.groupBy(*self.keys).agg(F.max(at).alias("__last"))
        days = new.groupBy(*self.keys, F.to_date(self.ts).alias(DAY)).agg(F.min(at).alias("__at"), F.max(at).alias("__hi"))
        days = join_on(days, ends, list(self.keys), "left").withColumn("__lo", F.least("__at", F.coalesce("__last", "__at")))
        order = Window.partitionBy(*self.keys).orderBy("__lo", "__hi")
        behind = F.max("__hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
        apart = F.coalesce(F.col("__lo") - behind > 2 * reach + freq_us(self.freq), F.lit(True))
        marked = days.withColumn("__new", apart.cast("long"))
        marked = marked.withColumn("seg__", F.sum("__new").over(order))
        return marked.groupBy(*self.keys, "seg__").agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))

    def upsert(self, new: DataFrame) -> None:
        """Bring in new or changed bars and recompute what they influence.

        Only the days of the stretches that a series' new rows touch are read and written.
        """
        spark = new.sparkSession
        if not self.exists(spark):
            self.backfill(new)
            return
        base, key, keys = new.columns, [*self.keys, self.ts], list(self.keys)
        new = settle(self._latest(new))
        if new.isEmpty():
            return
        reach, at = self.lookback * freq_us(self.freq), F.unix_micros(self.ts)
        stored = spark.read.parquet(self.path)
        segments = settle(self._segments(new, stored))
        day = lambda micros: F.to_date(F.timestamp_micros(micros))
        touched = segments.select(F.explode(F.sequence(day(F.col("__lo") - reach), day(F.col("__hi") + reach))).alias(DAY)).distinct()
        inside = (at >= F.col("__lo") - reach) & (at <= F.col("__hi") + reach)
        near = stored.join(touched, DAY, "left_semi").select(*base)
        near = join_on(near, segments, keys).where(inside).select(*base, "seg__")
        fresh_rows = join_on(new, segments, keys).where((at >= F.col("__lo")) & (at <= F.col("__hi"))).select(*base, "seg__")
        merged = replace_rows(near, fresh_rows, [*key, "seg__"]).withColumn(KNOWN, F.lit(True))
        fresh = join_on(self._derived(merged, "seg__"), segments, [*keys, "seg__"])
        # changed values can reach forward by the lookback; rows the raster added are new anyway
        dirty = (at >= F.col("__lo")) & (at <= F.col("__hi") + reach)
        changed = settle(fresh.where(dirty | F.col(KNOWN).isNull()).drop(KNOWN, "seg__", "__lo", "__hi"))
        days = changed.select(F.to_date(self.ts).alias(DAY)).distinct()
        old = stored.join(days, DAY, "left_semi").select(*changed.columns)
        rewritten = settle(replace_rows(old, changed, key))
        self._write(rewritten, "overwrite")
        for table in (new, segments, changed, rewritten):
            release(table)
        if self.retain_rows is not None:
            self.trim(spark)

    def trim(self, spark: SparkSession) -> None:
        """Delete what lies before the last ``retain_rows`` intervals of every series."""
        stored = spark.read.parquet(self.path)
        staying = retained(stored, list(self.keys), self.freq, self.retain_rows, self.ts)
        counts = join_on(stored.groupBy(DAY).agg(F.count("*").alias("n")), staying.groupBy(DAY).agg(F.count("*").alias("kept")), [DAY], "left")
        short = settle(counts.where("kept is null or kept < n"))
        some = short.where("kept is not null").select(DAY)
        if not some.isEmpty():
            rewritten = settle(staying.join(some, DAY, "left_semi").drop(DAY))
            self._write(rewritten, "overwrite")
            release(rewritten)
        # one row for each day that has become empty since the last call
        for row in short.where("kept is null").select(F.col(DAY).cast("string").alias("day")).toLocalIterator():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{DAY}={row.day}")
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        release(short)

    def start(self, bars: DataFrame, checkpoint: str, trigger: dict | None = None,
              after: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
        """Run ``upsert`` on every micro-batch, then an optional output function on its rows."""

        def handle(batch: DataFrame, number: int) -> None:
            self.upsert(batch)
            if after is not None:
                after(batch, number)

        return bars.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(
            **(trigger or {"availableNow": True})).start()

    def hot(self, spark: SparkSession) -> DataFrame:
        """The rows within the retention window of every series."""
        df = self.read(spark)
        return df if self.retain_rows is None else retained(df, list(self.keys), self.freq, self.retain_rows, self.ts)

    def last_bars(self, spark: SparkSession, now: Column) -> DataFrame:
        """Last bar time per series and the number of bars to fetch."""
        last = self.read(spark).groupBy(*self.keys).agg(F.max(self.ts).alias("last_ts"))
        return last.withColumn("missing", intervals_since(F.col("last_ts"), now, self.freq))


def retained(df: DataFrame, keys: list[str], freq: str, rows: int, ts: str = "ts", slack: int = 0) -> DataFrame:
    """The last ``rows`` intervals of every series; with ``slack`` nothing is cut until a series
    exceeds ``rows + slack`` intervals."""
    step = freq_us(freq)
    edge = df.groupBy(*keys).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
    length = (F.unix_micros("__hi") - F.unix_micros("__lo")) / step + 1
    cut = F.when(length > rows + slack, F.unix_micros("__hi") - rows * step).otherwise(F.unix_micros("__lo") - 1)
    return join_on(df, edge.select(*keys, cut.alias("__cut")), keys).where(F.unix_micros(F.col(ts)) > F.col("__cut")).drop("__cut")


def longer_interval_starts(df: DataFrame, freq: str, longer: str, ts: str = "ts") -> DataFrame:
    """Rows at which the longer interval starts together with the bar."""
    return df.where(starts_longer_interval(F.col(ts), freq, longer))
