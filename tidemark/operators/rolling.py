"""Rolling aggregates over past and future rows.

Every function returns a ``Step`` for ``SeriesFrame.derive``.  Long windows merge states of runs whose
lengths are powers of two (``doubling``): O(log w) per row.  Windows of at most ``SHORT`` rows use Spark's
sliding frames, which for them is the cheaper plan.  All share one sort order, neither subtracts
anything, and results agree but for rounding.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.frame import Kernel, Phase, Span, Step, renamed
from tidemark.functions.numeric import ratio
from tidemark.operators import doubling as D
from tidemark.operators.levels import Tree, window

# Aggregates by name; each skips NULLs.
AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "std": F.stddev_pop,
    "var": F.var_pop,
    "max": F.max,
    "min": F.min,
    "sum": F.sum,
    "count": F.count,
}
# Rows up to which a sliding frame is cheaper than the doublings.
SHORT = 48


def min_count(w: int) -> int:
    """Fewest non-NULL values a window needs to give a result."""
    return max(1, w // 2)


def _windows(windows: int | list[int]) -> list[int]:
    return [windows] if isinstance(windows, int) else list(windows)


def _relative(value: Column, base: str | None, factor: float) -> Column:
    if base is None:
        return value if factor == 1.0 else value * factor
    b = F.col(base)
    return ratio((value - b) * factor, b)


def _aggregate(column: str, fn: str, w: int, need: int) -> tuple[list[Phase], Column, Column]:
    """Phases, value and number of known values of the last ``w`` rows."""
    if fn in ("std", "var"):
        phases, held = D.windowed(f"real:{column}", D.moments(column), w)
        value = ratio(F.col(held["q2"]), F.col(held["n"]))
        return phases, F.sqrt(value) if fn == "std" else value, F.col(held["n"])
    counts, n = D.known_values(column, w)
    if fn == "count":
        return counts, F.col(n), F.col(n)
    if fn in ("max", "min"):
        phases, name = D.extreme(column, lambda span: F.col(column), fn == "max", w)
        # of no values there is no extreme
        return (D.together(counts, phases), F.col(name), F.col(n)) if need > 1 else (phases, F.col(name), F.lit(need))
    phases, held = D.windowed(f"sum:{column}", D.total(column), w)
    value = F.col(held["s"])
    return D.together(counts, phases), ratio(value, F.col(n)) if fn == "mean" else value, F.col(n)


def rolling(column: str, fn: str, w: int, name: str, future: bool = False, strict: bool = False,
            rel_column: str | None = None, rel_factor: float = 1.0) -> Step:
    """One rolling aggregate.

    Past frames hold the current row and the ``w-1`` rows before it, future frames the
    ``w`` rows after it.  The result is NULL with fewer than ``w // 2`` values (with
    ``strict``: fewer than ``w``), and for future frames that reach over the end.
    """
    if fn not in AGGREGATES:
        raise ValueError(f"unknown aggregate {fn!r}")
    need = w if strict else min_count(w)
    if w <= SHORT:
        def short(span: Span) -> dict[str, Column]:
            frame = span.next(w) if future else span.past(w)
            ok = F.count(column).over(frame) >= need
            if future:
                ok = ok & F.lead(F.lit(True), w).over(span.ordered).isNotNull()
            return {name: _relative(F.when(ok, AGGREGATES[fn](F.col(column)).over(frame)), rel_column, rel_factor)}

        return Step([name], [short], 0 if future else w - 1, w if future else 0)
    phases, value, n = _aggregate(column, fn, w, need)

    def finish(span: Span) -> dict[str, Column]:
        result = F.when(n >= need, value)
        return {name: _relative(F.lead(result, w).over(span.ordered) if future else result, rel_column, rel_factor)}

    return Step([name], [*phases, finish], 0 if future else w - 1, w if future else 0)


def past_aggregations(column: str, fn: str, windows, suffix: str | None = None, rel_column: str | None = None,
                      rel_factor: float = 1.0) -> list[Step]:
    tail = f"_{fn}" if suffix is None else suffix
    return [rolling(column, fn, w, f"{column}{tail}_{w}", rel_column=rel_column, rel_factor=rel_factor)
            for w in _windows(windows)]


def future_aggregations(column: str, fn: str, windows, suffix: str | None = None, rel_column: str | None = None,
                        rel_factor: float = 1.0) -> list[Step]:
    tail = f"_{fn}" if suffix is None else suffix
    return [rolling(column, fn, w, f"{column}{tail}_{w}", future=True, rel_column=rel_column, rel_factor=rel_factor)
            for w in _windows(windows)]


def means_against_base(columns: list[str], windows: list[int], base: int, factor: float) -> Callable[[pa.Table], dict[str, pa.Array]]:
    """``column_window``: past means relative to the mean of the last ``base`` rows, as ``rolling`` gives them.

    For ``SeriesFrame.along``.  Values are added from the oldest to the newest for every row, as in a sliding
    frame, so results are the same to the last digit; an array is added per row of the window.
    """

    def totals(x: np.ndarray, w: int) -> np.ndarray:
        out = np.zeros_like(x)
        for k in range(min(w, len(x)) - 1, -1, -1):
            out[k:] += x[: len(x) - k]
        return out

    def function(table: pa.Table) -> dict[str, pa.Array]:
        out = {}
        place = np.arange(1, len(table) + 1)
        for c in columns:
            known = table[c].is_valid().to_numpy()
            x = table[c].cast(pa.float64()).fill_null(0.0).to_numpy()
            means, enough = {}, {}
            with np.errstate(all="ignore"):
                for w in (base, *windows):
                    n = np.minimum(place, w) if known.all() else totals(known.astype(np.int64), w)
                    means[w], enough[w] = totals(x, w) / n, n >= min_count(w)
                level = means[base]
                for w in windows:
                    value = (means[w] - level) * factor / level
                    out[f"{c}_{w}"] = pa.array(value, mask=~(enough[w] & enough[base]) | (level == 0))
        return out

    return function


def past_weighted_aggregations(column: str, weight: str | None, fn: str, windows, suffix: str | None = None,
                               rel_column: str | None = None, rel_factor: float = 1.0) -> list[Step]:
    """fn(column * weight) / fn(weight); without a weight column the weights are 1."""
    tail = f"_{fn}" if suffix is None else suffix
    product, w_col = f"__product_{column}_{weight}", f"__weight_{column}_{weight}"

    def prepare(span: Span) -> dict[str, Column]:
        weights = F.col(weight).cast("double") if weight else F.lit(1.0)
        return {w_col: weights, product: F.col(column) * weights}

    steps = []
    for w in _windows(windows):
        name = f"{column}{tail}_{w}"
        top, bottom = rolling(product, fn, w, f"__top_{name}"), rolling(w_col, fn, w, f"__bottom_{name}")

        def merged(span: Span, k: int, top=top, bottom=bottom) -> dict[str, Column]:
            return {**top.phases[k](span), **bottom.phases[k](span)}

        phases = [prepare]
        phases += [lambda s, k=k, m=merged: m(s, k) for k in range(len(top.phases))]
        phases.append(lambda s, n=name: {
            n: _relative(ratio(F.col(f"__top_{n}"), F.col(f"__bottom_{n}")), rel_column, rel_factor)})
        steps.append(Step([name], phases, w - 1, 0))
    return steps


def area_ratio(column: str, windows, future: bool = False, suffix: str = "_area_ratio", need: int | None = None) -> list[Kernel]:
    """Area above minus area below the level of this row, over both: in [-1, 1]."""
    return [_area(column, w, f"{column}{suffix}_{w}", future, min_count(w) if need is None else need) for w in _windows(windows)]


def centred(x: np.ndarray) -> np.ndarray:
    """Differences to a typical value: areas do not change, and their sums lose fewer digits."""
    known = x[np.isfinite(x)]
    return x - (np.median(known) if len(known) else 0.0)


def _area(column: str, w: int, name: str, future: bool, need: int) -> Kernel:
    def function(pos: np.ndarray, values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        x = centred(values[column])
        first, end = window(len(x), w, future)
        parts = Tree(x, w).parts(first, end, x)
        above, below = parts.areas(x)
        ok = (parts.n >= need) & ~np.isnan(x) & (above + below != 0)
        if future:
            ok &= end - first == w
        with np.errstate(invalid="ignore", divide="ignore"):
            return {name: np.where(ok, (above - below) / (above + below), np.nan)}

    return Kernel({name: "double"}, [column], function, 0 if future else w - 1, w - 1 if future else 0)


def _slope_single(value: Column, n: Column) -> Column:
    # One point has no direction.
    return F.when(n == 1, F.lit(0.0)).otherwise(value)


def linear_trends(column: str, windows, future: bool = False, suffix: str = "_trend") -> list[Step]:
    """Slope of the least-squares line through the values of the frame, NULLs ignored.

    Both frames include the current row.
    """
    return [slope(column, w, f"{column}{suffix}_{w}", future) for w in _windows(windows)]


def slope(column: str, w: int, name: str, future: bool = False, need: int | None = None) -> Step:
    need = min_count(w) if need is None else need
    back, ahead = (0, w - 1) if future else (w - 1, 0)
    if w <= SHORT:
        def short(span: Span) -> dict[str, Column]:
            frame = span.next_with_current(w) if future else span.past(w)
            n = F.count(column).over(frame)
            ok = n >= need
            if future and w > 1:
                ok = ok & F.lead(F.lit(True), w - 1).over(span.ordered).isNotNull()
            value = F.regr_slope(F.col(column), F.col(span.pos).cast("double")).over(frame)
            return {name: F.when(ok, _slope_single(value, n))}

        return Step([name], [short], back, ahead)
    phases, held = D.windowed(f"real:{column}", D.line(column), w)

    def finish(span: Span) -> dict[str, Column]:
        n = F.col(held["n"])
        value = F.when(n >= need, _slope_single(ratio(F.col(held["xm"]), F.col(held["xx"])), n))
        return {name: F.lead(value, w - 1).over(span.ordered) if future else value}

    return Step([name], [*phases, finish], back, ahead)


# -- shape statistics ------------------------------------------------------------------------


def _masked(column: str, w: int, value: Callable[[Span], Column], name: str, need: int | None = None) -> Step:
    def columns(span: Span) -> dict[str, Column]:
        ok = F.count(column).over(span.past(w)) >= (min_count(w) if need is None else need)
        return {name: F.when(ok, value(span))}

    return Step([name], [columns], w - 1, 0)


def _from_moments(column: str, w: int, name: str, least: int, value: Callable[[Column, Column, Column, Column], Column]) -> Step:
    """A statistic of number and central sums of powers; equal values have none, which counts as 0."""
    phases, held = D.windowed(f"real:{column}", D.moments(column, 4), w)

    def finish(span: Span) -> dict[str, Column]:
        n, q2, q3, q4 = (F.col(held[f]) for f in ("n", "q2", "q3", "q4"))
        return {name: F.when(n >= max(least, min_count(w)), F.when(q2 == 0, F.lit(0.0)).otherwise(value(n, q2, q3, q4)))}

    return Step([name], [*phases, finish], w - 1, 0)


def skewness(column: str, w: int, name: str, bias: bool = False) -> Step:
    def value(n: Column, q2: Column, q3: Column, q4: Column) -> Column:
        g = ratio(F.sqrt(n) * q3, q2 * F.sqrt(q2))
        return g if bias else g * ratio(F.sqrt(n * (n - 1)), n - 2)

    return _from_moments(column, w, name, 1 if bias else 3, value)


def kurtosis(column: str, w: int, name: str, bias: bool = False) -> Step:
    def value(n: Column, q2: Column, q3: Column, q4: Column) -> Column:
        g = ratio(n * q4, q2 * q2) - 3
        return g if bias else ratio(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g + 6)

    return _from_moments(column, w, name, 1 if bias else 4, value)


def longest_below_mean(column: str, w: int, name: str) -> Step:
    """Length of the longest run of values strictly below the mean of the window."""

    def value(span: Span) -> Column:
        values = F.collect_list(F.col(column)).over(span.past(w))
        mean = F.avg(column).over(span.past(w))
        start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

        def extend(acc: Column, x: Column) -> Column:
            run = F.when(x < mean, acc["run"] + 1).otherwise(F.lit(0))
            return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

        return F.aggregate(values, start, extend, lambda acc: acc["best"].cast("double"))

    return _masked(column, w, value, name)


def first_maximum(column: str, w: int, name: str) -> Step:
    """Place of the first maximum among the known values of the window, as a fraction of their number."""
    counts, n = D.known_values(column, w)
    count = f"__count~{column}"
    first = lambda span: F.when(F.col(column).isNotNull(), F.struct(F.col(column).alias("v"), (-F.col(count)).alias("k")))
    phases, top = D.extreme(f"first:{column}", first, True, w)

    def finish(span: Span) -> dict[str, Column]:
        before = F.col(count) - F.col(n)
        place = -F.col(top)["k"] - 1 - before
        return {name: F.when(F.col(n) >= min_count(w), ratio(place.cast("double"), F.col(n).cast("double")))}

    return Step([name], [*D.together(counts, [lambda span: {}, *phases]), finish], w - 1, 0)


def mean_second_derivative(column: str, w: int, name: str) -> Step:
    """Mean of the central second differences; only the window's two edge pairs remain."""
    counts, n = D.known_values(column, w)
    phases, held = D.windowed(f"edges:{column}", D.edges(column), w)

    def finish(span: Span) -> dict[str, Column]:
        top = F.col(held["l1"]) - F.col(held["l2"]) - F.col(held["f2"]) + F.col(held["f1"])
        known = F.col(n)
        return {name: F.when((known >= min_count(w)) & (known > 2), ratio(top, 2.0 * (known - 2)))}

    return Step([name], [*D.together(counts, phases), finish], w - 1, 0)


STATISTICS: dict[str, Callable[..., Step | Kernel]] = {
    "skew": skewness,
    "kurtosis": kurtosis,
    "lsbm": longest_below_mean,
    "fmax": first_maximum,
    "msdc": mean_second_derivative,
    "mean": lambda c, w, n: rolling(c, "mean", w, n),
    "std": lambda c, w, n: rolling(c, "std", w, n),
    "area": lambda c, w, n: renamed(area_ratio(c, w)[0], n),
    "slope": lambda c, w, n: slope(c, w, n),
}


def window_statistics(column: str, functions: list[str], windows, bias: bool = False) -> list[Step | Kernel]:
    """Named statistics over several windows, called ``column_function_window``."""
    out = []
    for fn in functions:
        if fn not in STATISTICS:
            raise ValueError(f"unknown statistic {fn!r}")
        for w in _windows(windows):
            extra = {"bias": bias} if fn in ("skew", "kurtosis") else {}
            out.append(STATISTICS[fn](column, w, f"{column}_{fn}_{w}", **extra))
    return out


# -- row offsets -----------------------------------------------------------------------------


def percent_change(column: str, name: str, over: str = "previous") -> Step:
    """100 * difference to the previous row, over the previous (or the current) value."""

    def columns(span: Span) -> dict[str, Column]:
        prev = F.lag(F.col(column).cast("double"), 1).over(span.ordered)
        diff = (F.col(column) - prev) * 100.0
        return {name: ratio(diff, prev if over == "previous" else F.col(column))}

    return Step([name], [columns], 1, 0)


def log_difference(column: str, name: str) -> Step:
    def columns(span: Span) -> dict[str, Column]:
        prev = F.lag(column, 1).over(span.ordered)
        return {name: F.ln(F.when(F.col(column) > 0, F.col(column))) - F.ln(F.when(prev > 0, prev))}

    return Step([name], [columns], 1, 0)


def shifted_copies(columns: list[str], shifts: list[int]) -> list[Step]:
    """Copies of the columns from earlier (k > 0) or later (k < 0) rows."""
    out = []
    for k in shifts:
        names = [f"{c}_lag_{k}" for c in columns]

        def build(span: Span, k=k, names=names) -> dict[str, Column]:
            return {n: F.lag(c, k).over(span.ordered) for n, c in zip(names, columns)}

        out.append(Step(names, [build], max(k, 0), max(-k, 0)))
    return out


def user_aggregate(column: str, fn, w: int, name: str) -> Step:
    """A grouped-aggregate pandas UDF (Series -> float) over the past window."""
    return _masked(column, w, lambda span: fn(F.col(column)).over(span.past(w)), name)


def convert_to_relative(columns: list[Column], base: str | None, function: str, percentage: bool = False,
                        compat: bool = False) -> list[Column]:
    """Relate the outputs of consecutive windows to each other.

    ``base`` is next, last, prev or first; ``function`` is rel, diff or rel_diff.  The
    output that has no base stays as it is; the factor 100 applies to it as well.  With
    ``compat`` the base 'first' means the last output.
    """
    if base not in (None, "next", "last", "prev", "first"):
        raise ValueError(f"unknown relative base {base!r}")
    if base and function not in ("rel", "diff", "rel_diff"):
        raise ValueError(f"unknown relative function {function!r}")
    n, out = len(columns), []
    for i, c in enumerate(columns):
        at = {None: None, "next": i + 1, "last": n - 1, "prev": i - 1, "first": 0}[base]
        own_base = base in ("next", "last") and i == n - 1 or base in ("prev", "first") and i == 0
        if base == "first" and compat:
            at = n - 1
        if at is None or own_base:
            value = c
        else:
            b = columns[at]
            value = {"rel": lambda: ratio(c, b), "diff": lambda: c - b, "rel_diff": lambda: ratio(c - b, b)}[function]()
        out.append(value * 100.0 if percentage else value)
    return out
