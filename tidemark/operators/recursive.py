"""Recursive averages: exponential smoothing and the indicators built on it.

``y = (w * y + a * x) / (w + a)`` with ``w = (1 - a) ** rows since the last value`` is, from
its first value on, an affine map of y.  A bucket is therefore summarised by a few numbers,
the summaries are chained in two levels, and each bucket starts from its carried state.
The result equals the plain recursion over the whole series; no bucket needs another one's
rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.frame import BUCKET, GROUP_BUCKETS, KEY, PLACE, SeriesFrame, Span, Step, floor_div, join_on, settle
from tidemark.functions.numeric import ratio

# One summary: rows, leading NULL rows, number of values, first value, slope and constant of
# the map from the first smoothed value to the last one, weight left at the end.
SUMMARY = ["n", "lead", "seen", "first", "a", "c", "w_end"]
SUMMARY_TYPES = "n double, lead double, seen double, first double, a double, c double, w_end double"


def _summarise(x: np.ndarray, alpha: float) -> list[float]:
    n = len(x)
    at = np.flatnonzero(~np.isnan(x))
    if len(at) == 0:
        return [n, n, 0, 0.0, 1.0, 0.0, 1.0]
    w = (1 - alpha) ** np.diff(at)
    keep = w / (w + alpha)
    after = np.append(np.cumprod(keep[::-1])[::-1][1:], 1.0) if len(keep) else keep
    c = float(np.sum((1 - keep) * x[at[1:]] * after)) if len(keep) else 0.0
    a = float(np.prod(keep)) if len(keep) else 1.0
    return [n, at[0], len(at), x[at[0]], a, c, (1 - alpha) ** (n - 1 - at[-1])]


def _enter(y: float, w: float, lead: float, first: float, alpha: float) -> float:
    """Smoothed value at the first value of a stretch entered with state (y, w)."""
    if np.isnan(y):
        return first
    w = w * (1 - alpha) ** (lead + 1)
    return (w * y + alpha * first) / (w + alpha)


def _advance(state: tuple[float, float, float], s, alpha: float) -> tuple[float, float, float]:
    y, w, seen = state
    if s.seen == 0:
        return y, w * (1 - alpha) ** s.n, seen
    return s.a * _enter(y, w, s.lead, s.first, alpha) + s.c, s.w_end, seen + s.seen


def _join(one: list[float], two: list[float], alpha: float) -> list[float]:
    """Summary of two stretches in a row."""
    n1, lead1, seen1, first1, a1, c1, w1 = one
    n2, lead2, seen2, first2, a2, c2, w2 = two
    if seen1 == 0:
        return [n1 + n2, n1 + lead2, seen2, first2, a2, c2, w2]
    if seen2 == 0:
        return [n1 + n2, lead1, seen1, first1, a1, c1, w1 * (1 - alpha) ** n2]
    w = w1 * (1 - alpha) ** (lead2 + 1)
    keep = w / (w + alpha)
    return [n1 + n2, lead1, seen1 + seen2, first1, a2 * keep * a1, a2 * (keep * c1 + (1 - keep) * first2) + c2, w2]


def smooth(frame: SeriesFrame, wanted: dict[str, tuple[str, float]], need: dict[str, int] | None = None) -> SeriesFrame:
    """Exponential smoothing; ``wanted`` maps output names to (column, alpha).

    The first value starts the recursion.  Rows with NULL repeat the last result.  Results
    before the ``need``-th value are NULL.
    """
    need = need or {}
    names, keys = list(wanted), list(frame.keys)
    alphas = {n: a for n, (_, a) in wanted.items()}
    columns = {n: c for n, (c, _) in wanted.items()}
    key_fields = [f for f in frame.df.schema.fields if f.name in keys]
    key_ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key_fields)
    rows = frame.df.withColumn(BUCKET, frame.home())
    narrow = rows.select(*keys, BUCKET, F.col(frame.pos).alias("__pos"), *dict.fromkeys(columns.values()))

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__pos")
        head = pdf.iloc[0]
        out = []
        for n in names:
            x = pdf[columns[n]].to_numpy(dtype=float)
            out.append([*[head[k] for k in keys], head[BUCKET], n, *_summarise(x, alphas[n])])
        return pd.DataFrame(out, columns=[*keys, BUCKET, "which", *SUMMARY])

    summaries = narrow.groupBy(*keys, BUCKET).applyInPandas(
        summarise, f"{key_ddl}, {BUCKET} long, which string, {SUMMARY_TYPES}")
    summaries = summaries.withColumn("__group", floor_div(F.col(BUCKET), GROUP_BUCKETS))

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(BUCKET)
        head = pdf.iloc[0]
        parts = pdf[SUMMARY].to_numpy(dtype=float).tolist()
        total = parts[0]
        for p in parts[1:]:
            total = _join(total, p, alphas[head["which"]])
        return pd.DataFrame([[*[head[k] for k in keys], head["__group"], head["which"], *total]],
                            columns=[*keys, "__group", "which", *SUMMARY])

    groups = summaries.groupBy(*keys, "which", "__group").applyInPandas(
        combine, f"{key_ddl}, __group long, which string, {SUMMARY_TYPES}")

    def states(pdf: pd.DataFrame, order: str, start: tuple[float, float, float]) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        alpha, state, before = alphas[pdf["which"].iloc[0]], start, []
        for s in pdf.itertuples(index=False):
            before.append(state)
            state = _advance(state, s, alpha)
        return pdf.assign(y=[b[0] for b in before], w=[b[1] for b in before], count=[b[2] for b in before])

    def chain_groups(pdf: pd.DataFrame) -> pd.DataFrame:
        out = states(pdf.rename(columns={"__group": "grp"}), "grp", (np.nan, 1.0, 0.0))
        return out.rename(columns={"grp": "__group"})[[*keys, "__group", "which", "y", "w", "count"]]

    starts = groups.groupBy(*keys, "which").applyInPandas(
        chain_groups, f"{key_ddl}, __group long, which string, y double, w double, count double")

    def chain_buckets(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        start = (first["y"], first["w"], first["count"])
        return states(pdf, BUCKET, start)[[*keys, BUCKET, "which", "y", "w", "count"]]

    carried = join_on(summaries, starts, [*keys, "__group", "which"]).groupBy(*keys, "which", "__group").applyInPandas(
        chain_buckets, f"{key_ddl}, {BUCKET} long, which string, y double, w double, count double")
    carried = carried.groupBy(*keys, BUCKET).agg(
        F.map_from_entries(F.collect_list(F.struct("which", F.struct("y", "w", "count")))).alias("__state"))
    states_in = {f"__{i}_{p}": F.col("__state")[n][p] for i, n in enumerate(names) for p in ("y", "w", "count")}
    # only the inputs and the entry states go to numpy
    joined = join_on(narrow, carried, [*keys, BUCKET]).withColumns(states_in).drop("__state")
    joined = joined.withColumnRenamed("__pos", PLACE).withColumn(KEY, F.struct(*keys)).drop(*keys)

    def apply(table: pa.Table) -> pa.Table:
        table = table.sort_by(PLACE)
        out = table.select([KEY, PLACE])
        for i, n in enumerate(names):
            alpha = alphas[n]
            x = table[columns[n]].cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
            y0, w0, count0 = (table[f"__{i}_{p}"][0].as_py() for p in ("y", "w", "count"))
            y0 = np.nan if y0 is None else y0
            at = np.flatnonzero(~np.isnan(x))
            if len(at):
                x = x.copy()
                x[at[0]] = _enter(y0, w0, at[0], x[at[0]], alpha)
                y = pd.Series(x).ewm(alpha=alpha, adjust=False, ignore_na=False).mean().to_numpy().copy()
                y[:at[0]] = y0
            else:
                y = np.full(len(x), y0)
            seen = count0 + np.cumsum(~np.isnan(x))
            hide = np.isnan(y) | (seen < max(1, need.get(n, 1)))
            out = out.append_column(n, pa.array(y, type=pa.float64(), mask=hide))
        return out

    schema = ", ".join([f"{KEY} {joined.schema[KEY].dataType.simpleString()}", f"{PLACE} long", *[f"`{n}` double" for n in names]])
    return frame.with_rows(joined.groupBy(BUCKET, KEY).applyInArrow(apply, schema))


def exponential_mean(frame: SeriesFrame, column: str, span: float, name: str, need: int = 1) -> SeriesFrame:
    """Smoothing with alpha = 2 / (span + 1)."""
    return smooth(frame, {name: (column, 2.0 / (span + 1.0))}, {name: need})


# -- seeded chains: the indicators with infinite memory ---------------------------------------


@dataclass(frozen=True)
class Chain:
    """An average of an average (of an average): ``depth`` recursions, each on the results of the one before.

    Each starts from the plain mean of its first ``w`` inputs.  The recursion runs over known values; a
    row without one has no result.  The results are called ``name1``, ``name2``, ...
    """

    name: str
    column: str
    w: int
    alpha: float
    depth: int = 1

    @property
    def outputs(self) -> list[str]:
        return [f"{self.name}{k}" for k in range(1, self.depth + 1)]

    def run(self, x: np.ndarray, before: int, entry: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Results of all stages over the values ``x`` that follow ``before`` others, and the state behind them.

        The state has one number per stage: the share of the seed that is summed up so far, or the last
        result.  Which of the two follows from ``before``, so a stretch of values is an affine map of the state.
        The results of a stage belong to the last values of ``x``.
        """
        results, leave = [], entry.copy()
        for k in range(self.depth):
            seed = self.w - 1 - before
            if seed >= len(x):
                leave[k] = entry[k] + x.sum() / self.w
                y = x[:0]
            elif seed >= 0:
                y = _recursion(entry[k] + x[: seed + 1].sum() / self.w, x[seed + 1 :], self.alpha)
            else:
                y = _recursion(entry[k], x, self.alpha)[1:]
            if len(y):
                leave[k] = y[-1]
            results.append(y)
            x, before = y, max(0, before - self.w + 1)
        return results, leave

    def map(self, x: np.ndarray, before: int) -> np.ndarray:
        """The affine map of the state as a matrix with the constants in its last column; lower-triangular but for them."""
        out = np.empty((self.depth, self.depth + 1))
        out[:, -1] = self.run(x, before, np.zeros(self.depth))[1]
        for k in range(self.depth):
            unit = np.zeros(self.depth)
            unit[k] = 1.0
            out[:, k] = self.run(np.zeros(len(x)), before, unit)[1]
        return out


def _recursion(first: float, x: np.ndarray, alpha: float) -> np.ndarray:
    return pd.Series(np.append(first, x)).ewm(alpha=alpha, adjust=False).mean().to_numpy()


def _after(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The map of two stretches in a row."""
    out = two[:, :-1] @ one
    out[:, -1] += two[:, -1]
    return out


def chained(frame: SeriesFrame, chains: list[Chain]) -> SeriesFrame:
    """The results of all chains in one carried pass.

    A bucket is one affine map per chain; the maps are composed in two levels, and each bucket starts from its
    entry state.  Rows are placed twice, both times with the input columns only.  The frame is read
    three times; settle a long lineage before.
    """
    columns = list(dict.fromkeys(c.column for c in chains))
    rows = frame.placed().select(KEY, BUCKET, F.col(frame.pos).cast("long").alias(PLACE), *[F.col(c).cast("double").alias(c) for c in columns])
    kind = rows.schema[KEY].dataType.simpleString()
    # known values before each bucket: the buckets of a series are the rows of a frame
    counts = rows.groupBy(KEY, BUCKET).agg(*[F.count(c).alias(f"n_{i}") for i, c in enumerate(columns)]).withColumnsRenamed({KEY: "series", BUCKET: "at"})
    totals = SeriesFrame(counts, ("series",), pos="at").running({f"upto_{i}": F.col(f"n_{i}") for i in range(len(columns))}).df
    before = totals.select(F.col("series").alias(KEY), F.col("at").alias(BUCKET), F.array(*[F.col(f"upto_{i}") - F.col(f"n_{i}") for i in range(len(columns))]).alias("before"))
    at = {c: i for i, c in enumerate(columns)}
    sizes = [c.depth * (c.depth + 1) for c in chains]

    def parts(flat: list[float]) -> list[np.ndarray]:
        """The maps of all chains from one array."""
        cuts = np.split(np.array(flat), np.cumsum(sizes)[:-1])
        return [x.reshape(c.depth, c.depth + 1) for x, c in zip(cuts, chains)]

    def flat(maps: list[np.ndarray]) -> list[float]:
        return np.concatenate([m.ravel() for m in maps]).tolist()

    def known(table: pa.Table) -> tuple[dict[str, np.ndarray], list[int]]:
        return {c: table[c].to_numpy() for c in columns}, table["before"][0].as_py()

    def summarise(table: pa.Table) -> pa.Table:
        values, seen = known(table.sort_by(PLACE))
        maps = [c.map(values[c.column][~np.isnan(values[c.column])], seen[at[c.column]]) for c in chains]
        return pa.table({KEY: table[KEY].slice(0, 1), BUCKET: table[BUCKET].slice(0, 1), "before": [seen], "maps": [flat(maps)]})

    placed = rows.join(before, [BUCKET, KEY])
    summary = f"{KEY} {kind}, {BUCKET} long, before array<long>, maps array<double>"
    summaries = settle(placed.groupBy(BUCKET, KEY).applyInArrow(summarise, summary).withColumn("__group", floor_div(F.col(BUCKET), GROUP_BUCKETS)))

    def combine(table: pa.Table) -> pa.Table:
        total = None
        for row in table.sort_by(BUCKET)["maps"].to_pylist():
            total = parts(row) if total is None else [_after(a, b) for a, b in zip(total, parts(row))]
        return pa.table({KEY: table[KEY].slice(0, 1), "__group": table["__group"].slice(0, 1), "maps": [flat(total)]})

    def entries(table: pa.Table, order: str, start: list[np.ndarray]) -> tuple[pa.Table, list[list[float]]]:
        table, state, out = table.sort_by(order), start, []
        for row in table["maps"].to_pylist():
            out.append(np.concatenate(state).tolist())
            state = [m[:, :-1] @ v + m[:, -1] for m, v in zip(parts(row), state)]
        return table, out

    def start_groups(table: pa.Table) -> pa.Table:
        table, states = entries(table, "__group", [np.zeros(c.depth) for c in chains])
        return pa.table({KEY: table[KEY], "__group": table["__group"], "start": states})

    def start_buckets(table: pa.Table) -> pa.Table:
        start = np.split(np.array(table["start"][0].as_py()), np.cumsum([c.depth for c in chains])[:-1])
        table, states = entries(table, BUCKET, start)
        return pa.table({KEY: table[KEY], BUCKET: table[BUCKET], "before": table["before"], "entry": states})

    groups = summaries.groupBy("__group", KEY).applyInArrow(combine, f"{KEY} {kind}, __group long, maps array<double>")
    starts = groups.groupBy(KEY).applyInArrow(start_groups, f"{KEY} {kind}, __group long, start array<double>")
    states = summaries.join(starts, ["__group", KEY]).groupBy("__group", KEY).applyInArrow(
        start_buckets, f"{KEY} {kind}, {BUCKET} long, before array<long>, entry array<double>")

    def apply(table: pa.Table) -> pa.Table:
        table = table.sort_by(PLACE)
        values, seen = known(table)
        entry = np.split(np.array(table["entry"][0].as_py()), np.cumsum([c.depth for c in chains])[:-1])
        out = {KEY: table[KEY], PLACE: table[PLACE]}
        for c, v in zip(chains, entry):
            rows = np.flatnonzero(~np.isnan(values[c.column]))
            results, _ = c.run(values[c.column][rows], seen[at[c.column]], v)
            for name, y in zip(c.outputs, results):
                x = np.full(table.num_rows, np.nan)
                x[rows[len(rows) - len(y) :]] = y
                out[name] = pa.array(x, mask=np.isnan(x))
        return pa.table(out)

    names = [n for c in chains for n in c.outputs]
    found = rows.join(states, [BUCKET, KEY]).groupBy(BUCKET, KEY).applyInArrow(apply, ", ".join([f"{KEY} {kind}, {PLACE} long", *[f"`{n}` double" for n in names]]))
    return frame.with_rows(found)


@dataclass(frozen=True)
class Recursive:
    """An indicator of chains: columns to prepare, the chains, and its value of their results."""

    chains: list[Chain]
    value: Column
    prepare: list[Step]


def _one(inputs: dict[str, str]) -> str:
    return inputs["real"]


def _averages(depth: int, combine: Callable[..., Column]):
    def build(inputs: dict[str, str], w: int, name: str) -> Recursive:
        chain = Chain(f"ema__{name}", _one(inputs), w, 2.0 / (w + 1.0), depth)
        return Recursive([chain], combine(*[F.col(n) for n in chain.outputs]), [])

    return build


def _moves(kind: str):
    def build(inputs: dict[str, str], w: int, name: str) -> Recursive:
        c = _one(inputs)
        up, down = f"up__{c}", f"down__{c}"

        def columns(span: Span) -> dict[str, Column]:
            d = F.col(c) - F.lag(c, 1).over(span.ordered)
            return {up: F.greatest(d, F.lit(0.0)) + d * 0, down: F.greatest(-d, F.lit(0.0)) + d * 0}

        chains = [Chain(f"avg__{side}__{name}", side, w, 1.0 / w) for side in (up, down)]
        a, b = (F.col(chain.outputs[0]) for chain in chains)
        value = F.when(a + b == 0, F.lit(0.0)).otherwise(ratio((a if kind == "rsi" else a - b) * 100.0, a + b))
        return Recursive(chains, value, [Step([up, down], [columns], 1, 0)])

    return build


def _average_range(relative: bool):
    def build(inputs: dict[str, str], w: int, name: str) -> Recursive:
        from tidemark.operators.indicators import true_range

        tr = "tr__" + "__".join(inputs[k] for k in ("high", "low", "close"))
        chain = Chain(f"avg__{name}", tr, w, 1.0 / w)
        value = F.col(chain.outputs[0])
        if relative:
            value = ratio(value * 100.0, F.col(inputs["close"]))
        return Recursive([chain], value, [Step([tr], [lambda span: {tr: true_range(inputs, span)}], 1, 0)])

    return build


RECURSIVE: dict[str, Callable[[dict[str, str], int, str], Recursive]] = {
    "EMA": _averages(1, lambda a: a),
    "DEMA": _averages(2, lambda a, b: a * 2 - b),
    "TEMA": _averages(3, lambda a, b, c: (a - b) * 3 + c),
    "RSI": _moves("rsi"),
    "CMO": _moves("cmo"),
    "ATR": _average_range(False),
    "NATR": _average_range(True),
}


def recursive_indicators(frame: SeriesFrame, wanted: list[tuple[str, dict[str, str], int, str]]) -> SeriesFrame:
    """Indicators (function, inputs, window, name) with infinite memory: one settled table, one carried pass for all."""
    if not wanted:
        return frame
    built = {name: RECURSIVE[fn](inputs, w, name) for fn, inputs, w, name in wanted}
    prepared = {n: s for r in built.values() for s in r.prepare for n in s.names}
    frame = frame.derive(list({id(s): s for s in prepared.values()}.values())).settle()
    chains = [c for r in built.values() for c in r.chains]
    out = chained(frame, chains).with_columns({name: r.value for name, r in built.items()})
    return out.with_df(out.df.drop(*prepared, *[n for c in chains for n in c.outputs]))
