"""Tops and bottoms of a series as labels.

A row with value v is a top of level l when the values fall below ``v - l * |v|`` on both
sides before they reach v again on the left (or exceed it on the right).  Its label covers
the rows around it down to a tolerance.  Bottoms are tops of the negated series.

Everything is a search for the nearest row below a threshold.  Inside a bucket it is a
doubling search in numpy.  A candidate whose search leaves its bucket is *open*; there are
at most three of those per bucket and level, because an open candidate must be the highest
value on its open side.  Open searches go on over bucket minima and maxima, then over
groups of buckets, and come back down into the one bucket that holds the answer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.frame import BUCKET, GROUP_BUCKETS, SeriesFrame, floor_div, settle, join_on

LEFT, RIGHT = 0, 1
NONE = -1


@dataclass(frozen=True)
class ExtremumLabel:
    """One label: direction, minimum height and tolerance as fractions of the extremum."""

    name: str
    top: bool
    level: float
    tolerance: float


def _maxima(x: np.ndarray) -> list[np.ndarray]:
    n, size = len(x), 1
    tables = [np.append(x, -np.inf)]
    while size * 2 <= n:
        prev, shifted = tables[-1], np.full(n + 1, -np.inf)
        shifted[: n - size] = prev[size:n]
        tables.append(np.maximum(prev, shifted))
        size *= 2
    return tables


def _first(tables: list[np.ndarray], at: np.ndarray, level: np.ndarray, inclusive: bool = False) -> np.ndarray:
    """Index of the first value from ``at`` on that is above (or at) the level; n if none."""
    n = len(tables[0]) - 1
    at = at.copy()
    for k in range(len(tables) - 1, -1, -1):
        value = tables[k][np.minimum(at, n)]
        jump = (value < level if inclusive else value <= level) & (at < n)
        at = np.where(jump, np.minimum(at + (1 << k), n), at)
    return at


class _Search:
    """Nearest rows on either side; ``low`` and ``high`` bound the values of each row."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.n = len(low)
        down = -np.where(np.isnan(low), np.inf, low)
        up = np.where(np.isnan(high), -np.inf, high)
        self.tables = {(RIGHT, "below"): _maxima(down), (RIGHT, "above"): _maxima(up),
                       (LEFT, "below"): _maxima(down[::-1]), (LEFT, "above"): _maxima(up[::-1])}

    def below(self, side: int, at: np.ndarray, level: np.ndarray) -> np.ndarray:
        """Nearest row strictly beyond ``at`` whose low is below the level, else NONE."""
        return self._find(side, "below", at, -level, False)

    def reaching(self, side: int, at: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Nearest row that reaches v (left side) or exceeds it (right side), else NONE."""
        return self._find(side, "above", at, v, side == LEFT)

    def _find(self, side: int, what: str, at: np.ndarray, level: np.ndarray, inclusive: bool) -> np.ndarray:
        start = at + 1 if side == RIGHT else self.n - at
        hit = _first(self.tables[side, what], np.clip(start, 0, self.n), level, inclusive)
        found = hit < self.n
        return np.where(found, hit if side == RIGHT else self.n - 1 - hit, NONE)


def _directed(x: np.ndarray, top: bool, searches: dict[bool, tuple]) -> tuple[np.ndarray, _Search]:
    """Values with tops pointing up, and their search tables, made once per direction."""
    if top not in searches:
        y = x if top else -x
        searches[top] = (y, _Search(y, y))
    return searches[top]


def _outcome(side: int, hit: np.ndarray, guard: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rejected, open) flags; a guard in the very row of the hit is left to a closer look."""
    none = np.iinfo(np.int64).max
    far_hit = np.where(hit == NONE, none, hit if side == RIGHT else -hit)
    far_guard = np.where(guard == NONE, none, guard if side == RIGHT else -guard)
    return far_guard < far_hit, (hit == NONE) & (guard == NONE)


@dataclass
class _Candidates:
    at: np.ndarray                     # row index of the extremum
    level: dict[int, np.ndarray]       # side -> row index of the level crossing or NONE (open)


def _candidates(search: _Search, y: np.ndarray, level: float) -> _Candidates:
    at = np.flatnonzero(~np.isnan(y))
    hits: dict[int, np.ndarray] = {}
    for side in (RIGHT, LEFT):
        v = y[at]
        hit = search.below(side, at, v - level * np.abs(v))
        rejected, _ = _outcome(side, hit, search.reaching(side, at, v))
        keep = ~rejected
        at, hits[side] = at[keep], hit[keep]
        for other in hits:
            if other != side:
                hits[other] = hits[other][keep]
    return _Candidates(at, hits)


def _tolerance(search: _Search, y: np.ndarray, c: _Candidates, side: int, spec: ExtremumLabel) -> np.ndarray:
    """Row index of the tolerance crossing, clipped at the level crossing; NONE if open."""
    v = y[c.at]
    edge = c.level[side]
    if spec.tolerance >= spec.level:
        return edge
    hit = search.below(side, c.at, v - spec.tolerance * np.abs(v))
    return np.where(hit == NONE, edge, hit)


def extremum_labels(frame: SeriesFrame, column: str, labels: list[ExtremumLabel]) -> tuple[SeriesFrame, list[str]]:
    """Add one boolean column per label."""
    keys, rows, pos_name = list(frame.keys), frame.bucket_rows, frame.pos
    groups: dict[tuple[bool, float], list[int]] = {}
    for i, spec in enumerate(labels):
        groups.setdefault((spec.top, spec.level), []).append(i)
    narrow = frame.df.select(*keys, F.col(pos_name).alias("pos"), F.col(column).cast("double").alias("x"))
    narrow = narrow.withColumn(BUCKET, floor_div(F.col("pos"), rows))
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.df.schema.fields if f.name in keys)

    # -- pass 1: candidates whose search leaves the bucket -------------------------------

    def find_open(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        head, pos = [pdf[k].iloc[0] for k in keys], pdf["pos"].to_numpy()
        x, out, searches = pdf["x"].to_numpy(dtype=float), [], {}
        for (top, level), members in groups.items():
            y, search = _directed(x, top, searches)
            c = _candidates(search, y, level)
            is_open = (c.level[LEFT] == NONE) | (c.level[RIGHT] == NONE)
            c = _Candidates(c.at[is_open], {s: h[is_open] for s, h in c.level.items()})
            if len(c.at) == 0:
                continue
            for member in [NONE, *members]:
                spec = None if member == NONE else labels[member]
                for side in (LEFT, RIGHT):
                    hit = c.level[side] if spec is None else _tolerance(search, y, c, side, spec)
                    share = level if spec is None else spec.tolerance
                    if spec is not None and spec.tolerance >= spec.level:
                        continue
                    for a, h in zip(c.at, hit):
                        v = y[a]
                        out.append([*head, top, level, pos[a], member, side, v, v - share * abs(v),
                                    None if h == NONE else pos[h]])
        return pd.DataFrame(out, columns=[*keys, "top", "level", "origin", "member", "side", "v", "thr", "hit"])

    query_ddl = f"{key_ddl}, top boolean, level double, origin long, member int, side int, v double, thr double, hit long"
    opened = settle(narrow.groupBy(*keys, BUCKET).applyInPandas(find_open, query_ddl))
    spans = None
    if not opened.isEmpty():
        solved = _solve(opened, narrow, keys, key_ddl, rows)
        spans = _intervals(solved, keys, labels, groups, rows)

    # -- pass 2: mark the rows -----------------------------------------------------------

    df = frame.df.withColumn(BUCKET, frame.home())
    if spans is not None:
        df = join_on(df, spans, [*keys, BUCKET], "left")
    names = [spec.name for spec in labels]
    schema = T.StructType(
        [f for f in frame.df.schema.fields if f.name not in names] + [T.StructField(n, T.BooleanType()) for n in names])
    kept = [f.name for f in schema.fields if f.name not in names]

    def mark(table: pa.Table) -> pa.Table:
        table = table.sort_by(pos_name)
        pos = table[pos_name].to_numpy()
        x = table[column].cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
        steps, searches = np.zeros((len(labels), len(x) + 1), dtype=np.int64), {}
        for (top, level), members in groups.items():
            y, search = _directed(x, top, searches)
            c = _candidates(search, y, level)
            closed = (c.level[LEFT] != NONE) & (c.level[RIGHT] != NONE)
            c = _Candidates(c.at[closed], {s: h[closed] for s, h in c.level.items()})
            for i in members:
                np.add.at(steps[i], _tolerance(search, y, c, LEFT, labels[i]) + 1, 1)
                np.add.at(steps[i], _tolerance(search, y, c, RIGHT, labels[i]), -1)
        if "__spans" in table.column_names:
            for s in table["__spans"][0].as_py() or []:
                lo = max(s["first"] - pos[0], 0)
                hi = min(s["last"] - pos[0], len(x) - 1)
                if lo <= hi:
                    steps[s["member"], lo] += 1
                    steps[s["member"], hi + 1] -= 1
        out = table.select(kept)
        for i, n in enumerate(names):
            out = out.append_column(n, pa.array(np.cumsum(steps[i][:-1]) > 0))
        return out

    return frame.with_df(df.groupBy(*keys, BUCKET).applyInArrow(mark, schema)), names


def _solve(queries: DataFrame, narrow: DataFrame, keys: list[str], key_ddl: str, rows: int) -> DataFrame:
    """Answer the open searches; rejected candidates lose their level rows."""
    buckets = settle(narrow.groupBy(*keys, BUCKET).agg(F.min("x").alias("low"), F.max("x").alias("high")))
    by_bucket = buckets.select(*keys, F.col(BUCKET).alias("pos"), "low", "high")
    by_group = by_bucket.groupBy(*keys, floor_div(F.col("pos"), GROUP_BUCKETS).alias("pos")).agg(
        F.min("low").alias("low"), F.max("high").alias("high"))
    by_row = narrow.select(*keys, "pos", F.col("x").alias("low"), F.col("x").alias("high"))
    done = queries.where(F.col("hit").isNotNull())
    todo = queries.where(F.col("hit").isNull()).drop("hit")
    query_columns = todo.columns
    ddl = (f"{key_ddl}, top boolean, level double, origin long, member int, side int, v double, thr double, "
           "hit long, open boolean")

    def look(table: DataFrame, asked: DataFrame, size: int | None) -> DataFrame:
        """Search inside groups of ``size`` rows, starting beyond ``at``; group is ``cell``."""
        cell = floor_div(F.col("pos"), size) if size else F.lit(0).cast("long")
        table = table.withColumn("cell", cell)
        table = join_on(table, asked.select(*keys, "cell").distinct(), [*keys, "cell"], "left_semi")

        def answer(values: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if len(q) == 0 or len(values) == 0:
                return pd.DataFrame({c: [] for c in [*query_columns, "hit", "open"]})
            values = values.sort_values("pos")
            pos, low, high = (values[c].to_numpy() for c in ("pos", "low", "high"))
            parts = []
            for (top, side), part in q.groupby(["top", "side"]):
                lo, hi = (low, high) if top else (-high, -low)
                search = _Search(lo.astype(float), hi.astype(float))
                at = part["at"].to_numpy()
                index = np.searchsorted(pos, at) if side == LEFT else np.searchsorted(pos, at, side="right") - 1
                hit = search.below(side, index, part["thr"].to_numpy())
                guard = np.where(part["member"].to_numpy() == NONE,
                                 search.reaching(side, index, part["v"].to_numpy()), NONE)
                rejected, is_open = _outcome(side, hit, guard)
                found = part.assign(hit=pd.array(np.where(hit == NONE, 0, pos[np.maximum(hit, 0)]), dtype="Int64"), open=hit == NONE)
                found.loc[hit == NONE, "hit"] = pd.NA
                parts.append(found[~rejected])
            return pd.concat(parts)[[*query_columns, "hit", "open"]]

        left = table.groupBy(*keys, "cell")
        return settle(left.cogroup(asked.groupBy(*keys, "cell")).applyInPandas(answer, ddl))

    def inside(found: DataFrame, size: int) -> DataFrame:
        """Go down: search the group that holds the answer from its near end."""
        q = found.where(~F.col("open")).withColumn("cell", F.col("hit"))
        near = F.when(F.col("side") == LEFT, (F.col("cell") + 1) * size).otherwise(F.col("cell") * size - 1)
        return q.withColumn("at", near).drop("hit", "open")

    # up: other buckets of the same group, then other groups
    own = floor_div(F.col("origin"), rows)
    first = look(by_bucket, todo.withColumn("at", own).withColumn("cell", floor_div(own, GROUP_BUCKETS)), GROUP_BUCKETS)
    higher = first.where("open").drop("hit", "open")
    in_bucket = inside(first, rows)
    several = by_group.groupBy(*keys).count().where("count > 1")
    if not several.isEmpty():
        second = look(by_group, higher.withColumn("at", floor_div(own, GROUP_BUCKETS)).withColumn("cell", F.lit(0).cast("long")), None)
        third = look(by_bucket, inside(second, GROUP_BUCKETS), GROUP_BUCKETS)
        in_bucket = in_bucket.unionByName(inside(third, rows))
    last = look(by_row, in_bucket, rows)
    return done.unionByName(last.where(~F.col("open")).drop("open"))


def _intervals(solved: DataFrame, keys: list[str], labels: list[ExtremumLabel], groups, rows: int) -> DataFrame:
    """Label runs of the solved candidates, listed per bucket they touch."""
    per = solved.groupBy(*keys, "top", "level", "origin").agg(
        F.max(F.when((F.col("member") == NONE) & (F.col("side") == LEFT), F.col("hit"))).alias("l"),
        F.max(F.when((F.col("member") == NONE) & (F.col("side") == RIGHT), F.col("hit"))).alias("r"),
        F.map_from_entries(F.collect_list(F.when((F.col("member") != NONE) & (F.col("side") == LEFT), F.struct("member", "hit")))).alias("lt"),
        F.map_from_entries(F.collect_list(F.when((F.col("member") != NONE) & (F.col("side") == RIGHT), F.struct("member", "hit")))).alias("rt"),
    ).where(F.col("l").isNotNull() & F.col("r").isNotNull())
    cases = F.array(*[
        F.struct(F.lit(top).alias("g_top"), F.lit(float(level)).alias("g_level"), F.lit(i).alias("member"))
        for (top, level), members in groups.items() for i in members])
    mine = F.filter(cases, lambda c: (c["g_top"] == F.col("top")) & (c["g_level"] == F.col("level")))
    runs = per.withColumn("c", F.explode(mine)).select(
        *keys, F.col("c.member").alias("member"),
        (F.greatest("l", F.try_element_at("lt", F.col("c.member"))) + 1).alias("first"),
        (F.least("r", F.try_element_at("rt", F.col("c.member"))) - 1).alias("last"))
    touched = runs.withColumn(BUCKET, F.explode(F.sequence(floor_div(F.col("first"), rows), floor_div(F.col("last"), rows))))
    return touched.groupBy(*keys, BUCKET).agg(F.collect_list(F.struct("member", "first", "last")).alias("__spans"))


# -- label sets ------------------------------------------------------------------------------


def top_or_bottom(frame: SeriesFrame, column: str, function: str, level: float, tolerances, names: list[str]):
    """One level, several tolerances given as fractions of the level."""
    if function not in ("top", "bot"):
        raise ValueError(f"direction must be top or bot, not {function!r}")
    tolerances = tolerances if isinstance(tolerances, list) else [tolerances]
    if len(names) != len(tolerances):
        raise ValueError("one name is needed for each tolerance")
    level = abs(level)
    return extremum_labels(frame, column, [
        ExtremumLabel(n, function == "top", level, level * t) for n, t in zip(names, tolerances)])


# Levels and tolerances of the preset label set, and the name of each tolerance.
PRESET_LEVELS = [0.01, 0.02, 0.03, 0.04, 0.05]
PRESET_TOLERANCES = {
    "025": 0.0025, "05": 0.005, "075": 0.0075, "1": 0.01, "125": 0.0125,
    "15": 0.015, "175": 0.0175, "2": 0.02, "25": 0.025, "3": 0.03,
}


def tops_and_bottoms(frame: SeriesFrame, column: str = "close"):
    """The preset set of 100 labels ``top{k}_{tolerance}`` and ``bot{k}_{tolerance}``.

    Where a tolerance is as large as the level, the label covers the rows between the two
    level crossings.
    """
    labels = [ExtremumLabel(f"{'top' if top else 'bot'}{k}_{text}", top, level, tolerance)
              for text, tolerance in PRESET_TOLERANCES.items() for top in (True, False)
              for k, level in enumerate(PRESET_LEVELS, 1)]
    return extremum_labels(frame, column, labels)
