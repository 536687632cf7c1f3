"""Aggregating bars and transactions to a lower frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.frame import SeriesFrame
from tidemark.functions.intervals import interval_start
from tidemark.functions.numeric import null_safe_false
from tidemark.operators.raster import densify


def _keys(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def first_value(c: str, order: Column) -> Column:
    """First non-NULL value in the given order."""
    return F.min_by(F.col(c), F.when(F.col(c).isNotNull(), order))


def last_value(c: str, order: Column) -> Column:
    return F.max_by(F.col(c), F.when(F.col(c).isNotNull(), order))


def score_of_bucket(c: str) -> Column:
    """Largest score if all are positive, smallest if all are negative, else the mean."""
    complete = F.count(c) == F.count(F.lit(1))
    return (F.when(complete & (F.min(c) > 0), F.max(c))
            .when(complete & (F.max(c) < 0), F.min(c))
            .otherwise(F.avg(c)))


def any_true(c: str) -> Column:
    return null_safe_false(F.bool_or(F.col(c)))


def resample_ohlc(df: DataFrame, keys, freq: str, ts: str = "ts", tie: str | None = None,
                  scores: list[str] | None = None, flags: list[str] | None = None,
                  sums: list[str] | None = None, last_rows: int = 0) -> SeriesFrame:
    """Bars of a lower frequency: first open, highest high, lowest low, last close.

    Intervals without rows are kept with NULL values (flags: False).  ``tie`` orders rows
    of equal time.  Everything is combined before the shuffle.
    """
    keys = _keys(keys)
    scores, flags, sums = scores or [], flags or [], sums or []
    order = F.struct(ts, tie) if tie else F.col(ts)
    bars = df.groupBy(*keys, interval_start(F.col(ts), freq).alias("__start")).agg(
        first_value("open", order).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        last_value("close", order).alias("close"),
        *[F.sum(c).alias(c) for c in sums],
        *[score_of_bucket(c).alias(c) for c in scores],
        *[any_true(c).alias(c) for c in flags],
    ).withColumnRenamed("__start", ts)
    frame = densify(bars, keys, ts, freq, fill={c: False for c in flags})
    return frame.tail(last_rows) if last_rows else frame


def ticks_to_bars(df: DataFrame, keys, freq: str, value: str, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """OHLC bars with volume and number of trades from single values; empty intervals are left out."""
    keys = _keys(keys)
    order = F.struct(ts, tie) if tie else F.col(ts)
    return df.groupBy(*keys, interval_start(F.col(ts), freq).alias("__start")).agg(
        first_value(value, order).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        last_value(value, order).alias("close"),
        F.sum(value).alias("volume"),
        F.count(value).alias("trades"),
    ).withColumnRenamed("__start", ts)


def resample_flags(df: DataFrame, keys, freq: str, flags: list[str], ts: str = "ts", last_rows: int = 0) -> SeriesFrame:
    """A list of events at arbitrary times as a regular series of booleans."""
    keys = _keys(keys)
    out = df.groupBy(*keys, interval_start(F.col(ts), freq).alias("__start")).agg(
        *[any_true(c).alias(c) for c in flags]).withColumnRenamed("__start", ts)
    frame = densify(out, keys, ts, freq, fill={c: False for c in flags})
    return frame.tail(last_rows) if last_rows else frame


def bars_with_transactions(bars: DataFrame, transactions: DataFrame, keys, ts: str = "ts") -> DataFrame:
    """Resampled transactions beside resampled bars; bars without any keep NULL flags."""
    return bars.join(transactions, [*_keys(keys), ts], "left")
