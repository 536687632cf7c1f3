"""Regular time rasters: densifying, merging sources, linear interpolation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.frame import BUCKET, BUCKET_ROWS, GROUP_BUCKETS, SeriesFrame, floor_div, join_on
from tidemark.functions.intervals import freq_us, micros


def on_raster(df: DataFrame, keys, ts: str, freq: str, bucket_rows: int = BUCKET_ROWS) -> SeriesFrame:
    """Declare that the rows already form a gapless raster; positions follow from the time."""
    size = freq_us(freq)
    return SeriesFrame(df.withColumn("pos", floor_div(micros(F.col(ts)), size)), keys, ts=ts, step_us=size,
                       bucket_rows=bucket_rows)


def positions(bounds: DataFrame, keys: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """All positions from ``first_pos`` to ``last_pos`` of every series.

    Expanded in three steps, spread over the cluster in between, so that one long series
    is not produced by one task.
    """
    wide = bucket_rows * GROUP_BUCKETS
    lo, hi = F.col("first_pos"), F.col("last_pos")
    facts = bounds.columns

    def inside(unit: str, size: int, low: Column, high: Column) -> list[Column]:
        start = F.col(unit) * size
        return [F.greatest(low, start), F.least(high, start + (size - 1))]

    groups = bounds.withColumn("__wide", F.explode(F.sequence(floor_div(lo, wide), floor_div(hi, wide))))
    a, b = inside("__wide", wide, lo, hi)
    buckets = groups.withColumn(
        BUCKET, F.explode(F.sequence(floor_div(a, bucket_rows), floor_div(b, bucket_rows)))).repartition(*keys, BUCKET)
    a, b = inside(BUCKET, bucket_rows, lo, hi)
    return buckets.withColumn("pos", F.explode(F.sequence(a, b))).select(*facts, "pos")


def densify(df: DataFrame, keys, ts: str, freq: str, fill: dict[str, object] | None = None) -> SeriesFrame:
    """Add the missing rows between the first and the last row of every series.

    The input has at most one row per interval, stamped with the interval start.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    size = freq_us(freq)
    rows = df.withColumn("pos", floor_div(micros(F.col(ts)), size))
    bounds = rows.groupBy(*keys).agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
    grid = positions(bounds, keys).select(*keys, "pos")
    out = join_on(grid, rows.drop(ts), [*keys, "pos"], "left")
    out = out.withColumn(ts, F.timestamp_micros(F.col("pos") * F.lit(size).cast("long")))
    if fill:
        out = out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})
    return SeriesFrame(out.select(*df.columns, "pos"), tuple(keys), ts=ts, step_us=size)


@dataclass(frozen=True)
class Source:
    """One table to merge; its value columns get the prefix unless they already have it."""

    df: DataFrame
    prefix: str = ""


def merge_sources(sources: list[Source], keys, ts: str, freq: str, interpolate_gaps: bool = False) -> SeriesFrame:
    """Merge tables on one raster per series.

    The raster starts at the earliest first row of all sources, is anchored there, and
    ends at the earliest last row.  Rows off the raster drop out.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    size = freq_us(freq)
    size_lit = F.lit(size).cast("long")
    tables = []
    for s in sources:
        df = s.df
        if s.prefix:
            head = s.prefix + "_"
            df = df.select(*[
                F.col(c) if c in (*keys, ts) or c.startswith(head) else F.col(c).alias(head + c) for c in df.columns])
        tables.append(df)
    spans = []
    for n, df in enumerate(tables):
        values = [c for c in df.columns if c not in (*keys, ts)]
        present = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in values], F.lit(not values))
        spans.append(df.where(present).groupBy(*keys).agg(
            F.min(micros(F.col(ts))).alias("start"), F.max(micros(F.col(ts))).alias("end")).withColumn("__src", F.lit(n)))
    bounds = reduce(DataFrame.unionByName, spans).groupBy(*keys).agg(
        F.min("start").alias("start"), F.min("end").alias("end"))
    bounds = bounds.where(F.col("end") >= F.col("start")).select(
        *keys, F.pmod("start", size_lit).alias("__phase"),
        floor_div(F.col("start"), size).alias("first_pos"),
        floor_div(F.col("end") - F.pmod("start", size_lit), size).alias("last_pos"))
    out = positions(bounds, keys)
    out = out.withColumn(ts, F.timestamp_micros(F.col("pos") * size_lit + F.col("__phase"))).select(*keys, ts, "pos")
    for df in tables:
        out = join_on(out, df, [*keys, ts], "left")
    frame = SeriesFrame(out, tuple(keys), ts=ts, step_us=size)
    if interpolate_gaps:
        numeric = [f.name for f in out.schema.fields
                   if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.LongType, T.IntegerType))
                   and f.name not in (*keys, "pos")]
        frame = interpolate(frame, numeric)
    return frame


def interpolate(frame: SeriesFrame, columns: list[str], names: dict[str, str] | None = None) -> SeriesFrame:
    """Linear interpolation by row position.

    Gaps are filled on the line between their neighbours; leading NULLs stay NULL and
    trailing ones repeat the last value.
    """
    names = names or {}
    pos = F.col(frame.pos)
    knots = {c: F.when(F.col(c).isNotNull(), F.struct(pos.alias("p"), F.col(c).cast("double").alias("v"))) for c in columns}
    filled = frame.fill(backward={f"prev__{c}": k for c, k in knots.items()}, forward={f"next__{c}": k for c, k in knots.items()})
    out = {}
    for c in columns:
        prev, nxt = F.col(f"prev__{c}"), F.col(f"next__{c}")
        line = prev["v"] + (nxt["v"] - prev["v"]) * F.try_divide(pos - prev["p"], nxt["p"] - prev["p"])
        out[names.get(c, c)] = F.coalesce(F.col(c).cast("double"), line, prev["v"])
    df = filled.df.withColumns(out)
    return filled.with_df(df.drop(*[f"prev__{c}" for c in columns], *[f"next__{c}" for c in columns]))
