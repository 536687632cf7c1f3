"""Labels from future rows: extremes of the horizon, thresholds, first crossings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.frame import Kernel, SeriesFrame
from tidemark.functions.numeric import null_safe_false, ratio
from tidemark.operators.rolling import future_aggregations

# Fixed value: thresholds from here on ask "does any value reach it", smaller ones "do all stay inside".
LARGE_THRESHOLD = 0.75

# Thresholds (percent) and names of the horizon labels.
HIGH_THRESHOLDS = {
    "high_10": 1.0, "high_15": 1.5, "high_20": 2.0, "high_25": 2.5, "high_30": 3.0,
    "high_01": 0.1, "high_02": 0.2, "high_03": 0.3, "high_04": 0.4, "high_05": 0.5,
}
LOW_THRESHOLDS = {
    "low_01": -0.1, "low_02": -0.2, "low_03": -0.3, "low_04": -0.4, "low_05": -0.5,
    "low_10": -1.0, "low_15": -1.5, "low_20": -2.0, "low_25": -2.5, "low_30": -3.0,
}


def threshold_labels(column: str, thresholds: dict[str, float]) -> dict[str, Column]:
    """Boolean columns; sign and size of a threshold choose the comparison."""
    out = {}
    for name, t in thresholds.items():
        reach = abs(t) >= LARGE_THRESHOLD
        upward = (t > 0) == reach
        c = F.col(column)
        out[name] = null_safe_false(c >= t if upward else c <= t)
    return out


def horizon_labels(frame: SeriesFrame, horizon: int) -> tuple[SeriesFrame, list[str]]:
    """Largest high and smallest low of the next rows in percent of close, and 20 labels."""
    high, low = f"high_max_{horizon}", f"low_min_{horizon}"
    frame = frame.derive([
        *future_aggregations("high", "max", horizon, "_max", "close", 100.0),
        *future_aggregations("low", "min", horizon, "_min", "close", 100.0)])
    labels = {**threshold_labels(high, HIGH_THRESHOLDS), **threshold_labels(low, LOW_THRESHOLDS)}
    frame = frame.with_columns(labels)
    up, down = F.col(high), F.col(low)
    # Rises below zero and falls above zero count as zero; falls are given as positive sizes.
    frame = frame.with_columns({
        high: F.when(up < 0, F.lit(0.0)).otherwise(up),
        low: F.when(down > 0, F.lit(0.0)).otherwise(-down)})
    both = f"high_to_low_{horizon}"
    frame = frame.with_columns({both: ratio(F.col(high), F.col(high) + F.col(low)) * 2 - 1})
    return frame, [high, low, *labels, both]


# -- first crossing --------------------------------------------------------------------------


def _range_maxima(x: np.ndarray, longest: int) -> list[np.ndarray]:
    """Maxima of all runs of 1, 2, 4, ... rows; position n stands for 'past the end'."""
    n = len(x)
    tables = [np.append(x, -np.inf)]
    size = 1
    while size * 2 <= longest:
        prev = tables[-1]
        shifted = np.full(n + 1, -np.inf)
        if size < n:
            shifted[: n - size] = prev[size:n]
        tables.append(np.maximum(prev, shifted))
        size *= 2
    return tables


def first_above(x: np.ndarray, level: np.ndarray, horizon: int, tables: list[np.ndarray] | None = None) -> np.ndarray:
    """For each row the 0-based offset of the first of the next ``horizon`` values above its level, else -1."""
    n = len(x)
    tables = tables or _range_maxima(x, horizon)
    at = np.arange(1, n + 1)
    left = np.full(n, horizon, dtype=np.int64)
    for k in range(len(tables) - 1, -1, -1):
        size = 1 << k
        # jump over a run of values that all stay at or below the level
        jump = (left >= size) & (tables[k][np.minimum(at, n)] <= level)
        at = np.where(jump, at + size, at)
        left = np.where(jump, left - size, left)
    found = (left > 0) & (at < n)
    found[found] = x[at[found]] > level[found]
    return np.where(found, at - np.arange(1, n + 1), -1)


def first_crossings(frame: SeriesFrame, horizon: int, wanted: dict[str, tuple[str, str, float]]) -> SeriesFrame:
    """Offsets of the first future row that crosses a level.

    ``wanted`` maps output names to (reference column, price column, threshold in percent).
    A positive threshold looks for prices above ``reference * (1 + threshold / 100)``, a
    negative one for prices below.  NULL without a crossing and for the last ``horizon``
    rows.  Each bucket plus its next ``horizon`` rows is searched by doubling jumps, so a
    row costs O(log horizon).
    """
    for name, (_, _, t) in wanted.items():
        if t == 0:
            raise ValueError(f"threshold of {name!r} cannot be zero")
    def search(pos: np.ndarray, values: dict[str, np.ndarray]) -> dict[str, pa.Array]:
        complete, tables, out = np.arange(len(pos)) + horizon < len(pos), {}, {}
        for name, (reference, price, threshold) in wanted.items():
            sign = 1.0 if threshold > 0 else -1.0
            x = values[price] * sign
            x = np.where(np.isnan(x), -np.inf, x)
            if (price, sign) not in tables:
                tables[price, sign] = _range_maxima(x, horizon)
            level = values[reference] * (1 + threshold / 100.0) * sign
            level = np.where(np.isnan(level), np.inf, level)
            hit = first_above(x, level, horizon, tables[price, sign])
            out[name] = pa.array(hit, type=pa.int64(), mask=(hit < 0) | ~complete)
        return out

    columns = list(dict.fromkeys(c for reference, price, _ in wanted.values() for c in (reference, price)))
    return frame.derive(Kernel({n: "long" for n in wanted}, columns, search, 0, horizon))


def first_cross_labels(frame: SeriesFrame, columns: list[str], function: str, thresholds, tolerance: float, horizon: int,
                       names: list[str]) -> tuple[SeriesFrame, list[str]]:
    """True where the price rises (or falls) by a threshold before it moves against it by the tolerance.

    ``columns`` are close, high and low; ``tolerance`` is a fraction of the threshold.
    Crossing both in the same row counts as True.
    """
    if function not in ("high", "low"):
        raise ValueError(f"direction must be high or low, not {function!r}")
    thresholds = thresholds if isinstance(thresholds, list) else [thresholds]
    if len(names) != len(thresholds):
        raise ValueError("one name is needed for each threshold")
    close, high, low = columns
    sign, toward, against = (1, high, low) if function == "high" else (-1, low, high)
    wanted = {}
    for n, t in zip(names, thresholds):
        t = sign * abs(t)
        wanted[f"first__{n}"] = (close, toward, t)
        wanted[f"second__{n}"] = (close, against, round(-t * tolerance, 6))
    frame = first_crossings(frame, horizon, wanted)
    labels = {}
    for n in names:
        first, second = F.col(f"first__{n}"), F.col(f"second__{n}")
        labels[n] = first.isNotNull() & (second.isNull() | null_safe_false(first <= second))
    df = frame.df.withColumns(labels).drop(*wanted)
    return frame.with_df(df), list(names)
