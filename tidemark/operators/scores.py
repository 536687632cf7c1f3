"""Scores to signals: smoothing, combining, thresholds, bands, messages, score intervals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.frame import SeriesFrame, Span, step
from tidemark.functions.intervals import close_time
from tidemark.functions.numeric import null_safe_false, ratio
from tidemark.operators.recursive import exponential_mean
from tidemark.operators.rolling import rolling


def row_mean(columns: list[str]) -> Column:
    """Mean of the columns of a row, NULLs left out."""
    values = F.array_compact(F.array(*[F.col(c).cast("double") for c in columns]))
    return ratio(F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x), F.size(values).cast("double"))


def smoothen(frame: SeriesFrame, columns, name: str, window=None, point_threshold: float | None = None) -> SeriesFrame:
    """Row mean of the columns, made 0/1 by ``point_threshold``, then averaged over rows.

    An int window is a moving average, a float window the span of an exponential one;
    both need half a window of values.
    """
    columns = [columns] if isinstance(columns, str) else list(columns)
    value = row_mean(columns)
    if point_threshold:
        value = null_safe_false(value >= point_threshold).cast("double")
    if window is None:
        return frame.with_columns({name: value})
    raw = f"raw__{name}"
    frame = frame.with_columns({raw: value})
    if isinstance(window, float):
        frame = exponential_mean(frame, raw, window, name, int(window // 2))
    else:
        frame = frame.derive(rolling(raw, "mean", window, name))
    return frame.with_df(frame.df.drop(raw))


def combine(buy: str, sell: str, how: str | None = None, coefficient: float | None = None,
            constant: float | None = None) -> Column:
    """One signed score from a buy and a sell score."""
    b, s = F.col(buy), F.col(sell)
    if how == "relative":
        value = ratio(b, b + s) * 2 - 1.0
    elif how == "difference":
        value = b - s
    else:
        value = F.when(b >= s, b).otherwise(-s)
    if coefficient:
        value = value * coefficient
    if constant:
        value = value + constant
    return value


def threshold_rule(score: str, buy_threshold: float, sell_threshold: float) -> tuple[Column, Column]:
    """Buy from the upper threshold on, sell down from the lower one; NULL gives neither."""
    c = F.col(score)
    return null_safe_false(c >= buy_threshold), null_safe_false(c <= sell_threshold)


def threshold_rule_two(first: str, second: str, buy: tuple[float, float], sell: tuple[float, float]) -> tuple[Column, Column]:
    """Both scores have to pass their thresholds."""
    b1, s1 = threshold_rule(first, buy[0], sell[0])
    b2, s2 = threshold_rule(second, buy[1], sell[1])
    return b1 & b2, s1 & s2


def rule_signals(models: dict[str, dict[str, float]]) -> dict[str, Column]:
    """'buy': 1 if all columns reach their bounds; 'sell': 1 if none exceeds its bound."""
    out = {}
    for name, bounds in models.items():
        if name not in ("buy", "sell"):
            raise ValueError(f"unexpected signal {name!r}")
        tests = [F.col(c) >= v if name == "buy" else F.col(c) <= v for c, v in bounds.items()]
        out[name] = null_safe_false(reduce(lambda a, b: a & b, tests)).cast("int")
    return out


# -- bands -----------------------------------------------------------------------------------


def score_band(score: Column, positive: list[float], negative: list[float]) -> Column:
    """k if the score reaches k of the positive edges, -k if it is below k of the negative ones."""
    out = F.lit(None).cast("int")
    chain = None
    for k, edge in reversed(list(enumerate(sorted(positive), 1))):
        chain = F.when(score >= edge, k) if chain is None else chain.when(score >= edge, k)
    for i, edge in enumerate(sorted(negative)):
        k = i - len(negative)
        chain = F.when(score < edge, k) if chain is None else chain.when(score < edge, k)
    return out if chain is None else chain.otherwise(0).cast("int")


def _band_attribute(band: Column, positive: list[dict], negative: list[dict], key: str, default) -> Column:
    chain = F.when(F.lit(False), F.lit(default))
    ordered = [(k, b) for k, b in enumerate(sorted(positive, key=lambda b: b["edge"]), 1)]
    ordered += [(i - len(negative), b) for i, b in enumerate(sorted(negative, key=lambda b: b["edge"]))]
    for k, b in ordered:
        if b.get(key) is not None:
            chain = chain.when(band == k, F.lit(b[key]))
    return chain.otherwise(F.lit(default))


def band_events(frame: SeriesFrame, score: str, freq: str, positive: list[dict], negative: list[dict],
                notify_up: bool = True, notify_down: bool = True) -> DataFrame:
    """Rows on which the band of the score changed, or the repeat interval of its band began.

    The first row of a series counts as a change in both directions.
    """
    band = score_band(F.col(score), [b["edge"] for b in positive], [b["edge"] for b in negative])
    frame = frame.with_columns({"band": band})
    frame = frame.derive(step("prev_band", lambda s: {"prev_band": F.lag("band", 1).over(s.ordered)}, 1))
    first = F.col("prev_band").isNull()
    up = first | (F.abs("band") > F.abs("prev_band"))
    down = first | (F.abs("band") < F.abs("prev_band"))
    every = _band_attribute(F.col("band"), positive, negative, "frequency", 0)
    periodic = null_safe_false((every > 0) & (F.minute(close_time(F.col(frame.ts), freq)) % F.when(every > 0, every) == 0))
    out = frame.df.withColumns({"band_up": up, "band_down": down, "periodic": periodic})
    wanted = F.col("periodic")
    if notify_up:
        wanted = wanted | F.col("band_up")
    if notify_down:
        wanted = wanted | F.col("band_down")
    return out.where(wanted)


def band_message(symbol: Column, close: Column, score: Column, freq: str, positive: list[dict], negative: list[dict],
                 second_score: Column | None = None) -> Column:
    """Message text of a band event row (columns band, band_up and band_down)."""
    band = F.col("band")
    # Arrows of a band change.
    arrow = F.when(F.col("band_up"), "↑").when(F.col("band_down"), "↓").otherwise("")
    sign = _band_attribute(band, positive, negative, "sign", "")
    text = _band_attribute(band, positive, negative, "text", "")
    bold = _band_attribute(band, positive, negative, "bold", False)
    price = F.format_number(F.floor(close), 0)
    first = F.concat(F.format_string("%+.2f", score), F.lit(" "), arrow, F.lit(" "))
    second = F.lit("") if second_score is None else F.coalesce(F.format_string("%+.2f", second_score), F.lit(""))
    named = F.concat(sign, F.lit(" "), symbol, F.lit(" "), price, F.lit(" Indicator: "), first, F.lit(" "), second,
                     F.lit(" "), text, F.lit(f" {freq}"))
    plain = F.concat(symbol, F.lit(" "), price, F.lit(" Indicator: "), first, F.lit(" "), second, F.lit(f" {freq}"))
    return F.when(band == 0, plain).otherwise(F.when(bold, F.concat(F.lit("*"), named, F.lit("*"))).otherwise(named))


def latest_signal(df: DataFrame, keys: list[str], freq: str, buy: str, sell: str, close: str = "close", ts: str = "ts") -> DataFrame:
    """The last row of every series as a signal record."""
    last = df.groupBy(*keys).agg(F.max_by(F.struct(ts, close, buy, sell), F.col(ts)).alias("r"))
    b, s = null_safe_false(F.col("r")[buy]), null_safe_false(F.col("r")[sell])
    side = F.when(b & s, "BOTH").when(b, "BUY").when(s, "SELL").otherwise("")
    return last.select(*keys, side.alias("side"), F.col("r")[close].alias("close_price"),
                       close_time(F.col("r")[ts], freq).alias("close_time"))


def label_and_algorithm(score_column: Column) -> tuple[Column, Column]:
    """Split ``label_algorithm`` at the last underscore."""
    return F.regexp_extract(score_column, r"^(.*)_([^_]+)$", 1), F.regexp_extract(score_column, r"^(.*)_([^_]+)$", 2)


def score_average(frame: SeriesFrame, score: str, windows) -> SeriesFrame:
    """Moving averages of a score over full windows, for display."""
    windows = [windows] if isinstance(windows, int) else windows
    return frame.derive([rolling(score, "mean", w, f"{score}_{w}", strict=True) for w in windows])


# -- score intervals -------------------------------------------------------------------------


def islands(frame: SeriesFrame, column: str, name: str = "interval_no") -> SeriesFrame:
    """Number the runs of equal values of a column, from 0."""
    changed = f"changed__{name}"

    def columns(span: Span) -> dict[str, Column]:
        before = F.lag(F.struct(column), 1).over(span.ordered)
        differs = before.isNotNull() & ~F.col(column).eqNullSafe(before[column])
        return {changed: differs.cast("long")}

    frame = frame.derive(step(changed, columns, 1)).running({name: F.col(changed)})
    return frame.with_df(frame.df.drop(changed))


def interval_precision(frame: SeriesFrame, label: str, score: str, threshold: float) -> DataFrame:
    """One row per run of equal labels: its label, and whether any score reached the threshold."""
    frame = islands(frame, label)
    return frame.df.groupBy(*frame.keys, "interval_no").agg(
        F.max(label).alias(label), F.bool_or(null_safe_false(F.col(score) >= threshold)).alias(score))
