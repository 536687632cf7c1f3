"""Order-book ladders to volume per price bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.frame import join_on, number_rows, settle, tasks_for
from tidemark.functions.numeric import ratio

# Levels up to which a snapshot is worked on whole; longer ones are cut into buckets.
WHOLE_LEVELS = 1 << 16


def _segments(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Levels with the next price of their snapshot and its first price, by one sort; no snapshot is long."""
    span = Window.partitionBy(*keys).orderBy("p", "v")
    return levels.withColumns({"following": F.lead("p").over(span), "first_price": F.first("p").over(span)})


def _long_segments(levels: DataFrame, keys: list[str]) -> DataFrame:
    """The same for snapshots of any length, none of which is in one task."""
    frame = number_rows(levels, keys, ["p", "v"]).fill(forward={"following": F.col("p")}, strict=True)
    facts = frame.df.groupBy(*keys).agg(
        F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("p").alias("first_price"))
    return frame.attach(facts).select(*levels.columns, "following", "first_price")


def depth_bins(ladder: DataFrame, keys: list[str], bin_size: float, start: float | None = None, side: str = "ask",
               price: str = "price", volume: str = "volume") -> DataFrame:
    """Mean volume in each price bin of a snapshot (``keys``).

    The volume of a level holds from its price to the next one, that of the last level to
    the end of its bin.  Bins are numbered from 0 at ``start`` (default: the first price).
    Bids run downward: their prices are mirrored.
    """
    if side not in ("ask", "bid"):
        raise ValueError(f"unknown side {side!r}")
    sign = 1.0 if side == "ask" else -1.0
    levels = ladder.select(*keys, (F.col(price) * sign).cast("double").alias("p"), F.col(volume).cast("double").alias("v"))
    # a level without a price bounds no other one
    levels = settle(levels.where(F.col("p").isNotNull()))
    tasks = tasks_for(levels.sparkSession, levels.count())
    long = settle(levels.select(*keys).repartition(tasks, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
                  .where(F.col("__n") > WHOLE_LEVELS).drop("__n"))
    if long.isEmpty():
        rows = _segments(levels.repartition(tasks, *keys), keys)
    else:
        # one row per WHOLE_LEVELS levels at most
        short = join_on(levels, F.broadcast(long), keys, "left_anti")
        rows = _segments(short.repartition(tasks, *keys), keys).unionByName(
            _long_segments(join_on(levels, F.broadcast(long), keys, "left_semi"), keys))
    origin = F.col("first_price") if start is None else F.lit(start * sign)
    lo = F.col("p") - origin
    own_end = (F.floor(lo / bin_size) + 1) * bin_size
    hi = F.coalesce(F.col("following") - origin, own_end)
    parts = rows.select(*keys, "v", lo.alias("lo"), hi.alias("hi")).where(F.col("hi") > F.col("lo"))
    last_bin = F.ceil(F.col("hi") / bin_size) - 1
    parts = parts.withColumn("bin", F.explode(F.sequence(F.floor(F.col("lo") / bin_size), last_bin)))
    overlap = F.least("hi", (F.col("bin") + 1) * bin_size) - F.greatest("lo", F.col("bin") * bin_size)
    # bins below a given start are not reported
    bins = parts.where(F.col("bin") >= 0).groupBy(*keys, "bin").agg(
        ratio(F.sum(overlap * F.col("v")), F.lit(bin_size)).alias("volume"))
    if start is None:
        return bins
    # nothing is offered between the start and the first level
    empty = bins.groupBy(*keys).agg(F.min("bin").alias("first")).where("first > 0")
    return bins.unionByName(empty.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("first") - 1)).alias("bin"), F.lit(0.0).alias("volume")))
