"""Bringing new rows into an existing table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.frame import join_on


def combine_update(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Union of the rows; non-NULL new cells overwrite, all others keep the old value.  A NULL key equals a NULL key."""
    values = [c for c in old.columns if c not in key] + [c for c in new.columns if c not in (*key, *old.columns)]
    same = F.struct(*key).alias("__same")
    o = old.select(same, F.lit(True).alias("__old"), *[F.col(c).alias(f"old__{c}") for c in old.columns if c not in key])
    n = new.select(same, *[F.col(c).alias(f"new__{c}") for c in new.columns if c not in key])
    cells = []
    for c in values:
        sides = [F.col(f"{s}__{c}") for s, df in (("new", new), ("old", old)) if c in df.columns]
        cells.append(F.coalesce(*sides).alias(c))
    return o.join(n, "__same", "full").select("__same.*", *cells)


def replace_from(old: DataFrame, new: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """Drop the old rows from the first new row of their series on, then append the new rows."""
    starts = new.groupBy(*keys).agg(F.min(ts).alias("__start"))
    kept = join_on(old, starts, keys, "left").where(F.col("__start").isNull() | (F.col(ts) < F.col("__start"))).drop("__start")
    return kept.unionByName(new)


def replace_rows(old: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """New rows replace old rows of equal key entirely; a key may hold NULL.

    Of new rows of one key the last by ``order`` counts, without an order the one of the largest values.
    """
    values = [c for c in new.columns if c not in key]
    if values:
        last = F.max_by(F.struct(*values), F.struct(*(order or []), *values)).alias("__last")
        new = new.groupBy(*key).agg(last).select(*key, "__last.*").select(*new.columns)
    return join_on(old, new.select(*key), key, "left_anti").unionByName(new)


def _compared(previous: DataFrame, recomputed: DataFrame, key: list[str], columns: list[str], relative: float, absolute: float) -> DataFrame:
    """The rows that both have, with the columns whose values differ by more than the tolerance."""
    joined = join_on(previous.select(*key, *[F.col(c).alias(f"old__{c}") for c in columns]),
                     recomputed.select(*key, *[F.col(c).alias(f"new__{c}") for c in columns]), key)
    marks = []
    for c in columns:
        a, b = F.col(f"old__{c}"), F.col(f"new__{c}")
        close = F.coalesce(F.abs(a - b) <= F.lit(absolute) + F.abs(b) * relative, F.lit(False))
        marks.append(F.when(~close, F.lit(c)))
    return joined.withColumn("differing", F.array_compact(F.array(*marks)))


def overlap_differences(previous: DataFrame, recomputed: DataFrame, key: list[str], columns: list[str],
                        relative: float = 1e-5, absolute: float = 1e-8) -> DataFrame:
    """Rows of the overlap whose values differ by more than the tolerance, with the columns concerned."""
    return _compared(previous, recomputed, key, columns, relative, absolute).where(F.size("differing") > 0)


def overlap_mismatches(previous: DataFrame, recomputed: DataFrame, key: list[str], columns: list[str],
                       relative: float = 1e-5, absolute: float = 1e-8) -> DataFrame:
    """Number of compared rows and of rows that differ."""
    both = _compared(previous, recomputed, key, columns, relative, absolute)
    return both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.size("differing") > 0).alias("different"))


def notnull_tail(df: DataFrame, keys: list[str], pos: str, columns: list[str]) -> DataFrame:
    """Number of last rows of every series that have no NULL in the columns."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    edge = df.groupBy(*keys).agg(F.max(F.when(bad, F.col(pos))).alias("bad"), F.max(pos).alias("last"), F.min(pos).alias("first"))
    return edge.select(*keys, (F.col("last") - F.coalesce(F.col("bad"), F.col("first") - 1)).alias("tail_rows"))
