"""Catalogue: rolling features, indicators, bundles and labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.frame import Kernel
from tidemark.operators import bundles, extremum, labels
from tidemark.operators import rolling as R
from tidemark.operators.indicators import indicators
from tidemark.operators.recursive import exponential_mean
from tidemark.plans import inputs
from tidemark.plans.catalog import register
from tidemark.plans.inputs import EVENT_SQL, FILLED_SQL, TICKS_SQL
from tidemark.plans.specs import apply_specs

KEY = "series:s pos:b "


def spec(names: list[str], kind: str = "d") -> str:
    return KEY + " ".join(f"{n}:{kind}" for n in names)


def past(w: int) -> str:
    return f"(PARTITION BY series ORDER BY pos ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


def following(w: int) -> str:
    return f"(PARTITION BY series ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND {w} FOLLOWING)"


def with_current(w: int) -> str:
    return f"(PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND {w - 1} FOLLOWING)"


FUNCTIONS = {"mean": "avg", "std": "stddev_pop", "var": "var_pop", "max": "max", "min": "min", "sum": "sum"}


def rolled(c: str, fn: str, w: int, need: int | None = None) -> str:
    need = max(1, w // 2) if need is None else need
    return f"CASE WHEN count({c}) OVER {past(w)} >= {need} THEN {FUNCTIONS[fn]}({c}) OVER {past(w)} END"


def ahead(c: str, fn: str, w: int) -> str:
    return (f"CASE WHEN count(*) OVER {following(w)} = {w} AND count({c}) OVER {following(w)} >= {max(1, w // 2)} "
            f"THEN {FUNCTIONS[fn]}({c}) OVER {following(w)} END")


def sloped(c: str, w: int, need: int | None = None) -> str:
    need = max(1, w // 2) if need is None else need
    n = f"count({c}) OVER {past(w)}"
    return f"CASE WHEN {n} < {need} THEN NULL WHEN {n} = 1 THEN 0.0 ELSE regr_slope({c}, CAST(pos AS DOUBLE)) OVER {past(w)} END"


# -- past aggregates -------------------------------------------------------------------------

AGGS, WINDOWS = ["mean", "std", "max", "min", "sum"], [5, 12, 24]
names = [f"close_{fn}_{w}" for fn in AGGS for w in WINDOWS]
register("past_aggregations", spec(names),
         lambda s, d: inputs.bars(s, d).derive([x for fn in AGGS for x in R.past_aggregations("close", fn, WINDOWS)]).df,
         EVENT_SQL, "SELECT series, pos, " + ", ".join(
             f"{rolled('close', fn, w)} AS close_{fn}_{w}" for fn in AGGS for w in WINDOWS) + " FROM bars")

register("past_relative", spec(["close_mean_5", "close_mean_12"]),
         lambda s, d: inputs.bars(s, d).derive(
             R.past_aggregations("close", "mean", 48, "_base"),
             R.past_aggregations("close", "mean", [5, 12], rel_column="close_base_48", rel_factor=100.0)).df,
         EVENT_SQL + f""",
w AS (SELECT series, pos, {rolled('close', 'mean', 48)} AS b, {rolled('close', 'mean', 5)} AS m5, {rolled('close', 'mean', 12)} AS m12 FROM bars)""",
         "SELECT series, pos, 100 * (m5 - b) / nullif(b, 0) AS close_mean_5, 100 * (m12 - b) / nullif(b, 0) AS close_mean_12 FROM w")

register("past_weighted", spec(["close_vwap_5", "close_vwap_24"]),
         lambda s, d: inputs.bars(s, d).derive(R.past_weighted_aggregations("close", "volume", "mean", [5, 24], "_vwap")).df,
         EVENT_SQL + ",\np AS (SELECT series, pos, close * volume AS p, volume AS v FROM bars)",
         "SELECT series, pos, " + ", ".join(f"({rolled('p', 'mean', w)}) / nullif({rolled('v', 'mean', w)}, 0) AS close_vwap_{w}" for w in (5, 24)) + " FROM p")

# The long-window forms: a year of ticks under windows of hundreds of rows.
LONG = [288, 672]
long_names = [f"price_{fn}_{w}" for fn in ("mean", "max", "min") for w in LONG] + [f"level_{fn}_{w}" for fn in ("std", "trend") for w in LONG]
register("long_windows", spec(long_names),
         lambda s, d: inputs.ticks(s, d).with_columns({"level": F.col("price") / 10000.0}).derive(
             [x for fn in ("mean", "max", "min") for x in R.past_aggregations("price", fn, LONG, rel_column="price", rel_factor=100.0)]
             + R.past_aggregations("level", "std", LONG) + R.linear_trends("level", LONG)).df,
         TICKS_SQL + ",\nw AS (SELECT series, pos, price, " + ", ".join(
             [f"{rolled('price', fn, w)} AS price_{fn}_{w}" for fn in ("mean", "max", "min") for w in LONG]
             + [f"{rolled('level', 'std', w)} AS level_std_{w}" for w in LONG] + [f"{sloped('level', w)} AS level_trend_{w}" for w in LONG]) + " FROM (SELECT *, price / 10000.0 AS level FROM ticks))",
         "SELECT series, pos, " + ", ".join(
             [f"100 * (price_{fn}_{w} - price) / nullif(price, 0) AS price_{fn}_{w}" for fn in ("mean", "max", "min") for w in LONG]
             + [f"level_{fn}_{w}" for fn in ("std", "trend") for w in LONG]) + " FROM w")

register("tick_windows", spec(["price_mean_20", "price_std_20", "price_max_20", "size_sum_50"]),
         lambda s, d: inputs.ticks(s, d).derive([
             *R.past_aggregations("price", "mean", 20), *R.past_aggregations("price", "std", 20),
             *R.past_aggregations("price", "max", 20), *R.past_aggregations("size", "sum", 50)]).df,
         TICKS_SQL, f"""SELECT series, pos, {rolled('price', 'mean', 20)} AS price_mean_20, {rolled('price', 'std', 20)} AS price_std_20,
  {rolled('price', 'max', 20)} AS price_max_20, {rolled('size', 'sum', 50)} AS size_sum_50 FROM ticks""")


# A value that is not finite leaves with its window, and whole numbers stay whole, for any window.
ANY_WIDTH = [5, 63, 64, 288]


def _nonfinite(spark, sf_dir):
    frame = inputs.ticks(spark, sf_dir).with_columns({
        "x": F.when(F.col("pos") % 701 == 3, F.lit(float("inf"))).when(F.col("pos") % 997 == 5, 1e290).otherwise(F.col("price") * 0.00007310585786300049),
        "k": (F.col("size") * 3).cast("long")})
    frame = frame.derive([*R.past_aggregations("x", "mean", ANY_WIDTH), *R.past_aggregations("x", "std", ANY_WIDTH), *R.linear_trends("x", ANY_WIDTH),
                          *R.past_aggregations("k", "sum", ANY_WIDTH), *R.past_aggregations("k", "max", ANY_WIDTH)])
    return frame.df.withColumns({f"x_{fn}_{w}": F.when(F.col(f"x_mean_{w}") < 1e200, F.col(f"x_{fn}_{w}")) for fn in ("mean", "std", "trend") for w in ANY_WIDTH})


register("rolling_nonfinite", spec([f"x_{fn}_{w}" for fn in ("mean", "std", "trend") for w in ANY_WIDTH]) + " " + " ".join(f"{c}_{w}:b" for c in ("k_sum", "k_max") for w in ANY_WIDTH),
         _nonfinite,
         TICKS_SQL + """,
v AS (SELECT series, pos, CASE WHEN pos % 701 = 3 OR pos % 997 = 5 THEN NULL ELSE price * 0.00007310585786300049::DOUBLE END AS x, CAST(size * 3 AS BIGINT) AS k FROM ticks),
w AS (SELECT series, pos, """ + ", ".join(
             [f"count(x) OVER {past(w)} = count(*) OVER {past(w)} AS fine_{w}" for w in ANY_WIDTH]
             + [f"{rolled('x', fn, w)} AS x_{fn}_{w}" for fn in ("mean", "std") for w in ANY_WIDTH] + [f"{sloped('x', w)} AS x_trend_{w}" for w in ANY_WIDTH]
             + [f"{rolled('k', fn, w)} AS k_{fn}_{w}" for fn in ("sum", "max") for w in ANY_WIDTH]) + " FROM v)",
         "SELECT series, pos, " + ", ".join([f"CASE WHEN fine_{w} THEN x_{fn}_{w} END AS x_{fn}_{w}" for fn in ("mean", "std", "trend") for w in ANY_WIDTH]
                                            + [f"k_{fn}_{w}" for fn in ("sum", "max") for w in ANY_WIDTH]) + " FROM w")


def area_sql(c: str, frame: str, enough: str, name: str) -> str:
    values = f"list({c}) FILTER ({c} IS NOT NULL) OVER {frame}"
    return (f"CASE WHEN {enough} AND {c} IS NOT NULL THEN list_sum(list_transform({values}, lambda x: x - {c})) "
            f"/ nullif(list_sum(list_transform({values}, lambda x: abs(x - {c}))), 0) END AS {name}")


register("area_ratio", spec(["close_area_ratio_6", "close_area_ratio_24"], "f"),
         lambda s, d: inputs.bars(s, d).derive(R.area_ratio("close", [6, 24])).df, EVENT_SQL,
         "SELECT series, pos, " + ", ".join(
             area_sql("close", past(w), f"count(close) OVER {past(w)} >= {w // 2}", f"close_area_ratio_{w}") for w in (6, 24)) + " FROM bars")

register("area_ratio_long", spec(["level_area_ratio_672"], "f"),
         lambda s, d: inputs.ticks(s, d).with_columns({"level": F.col("price") / 10000.0}).derive(R.area_ratio("level", 672)).df,
         TICKS_SQL + """,
v AS (SELECT series, pos, price / 10000.0 AS x FROM ticks),
s AS (SELECT a.series, a.pos, count(b.x) AS n, sum(b.x - a.x) AS up, sum(abs(b.x - a.x)) AS span
  FROM (SELECT *, unnest(range(0, 672)) AS k FROM v) a JOIN v b ON b.series = a.series AND b.pos = a.pos - a.k GROUP BY a.series, a.pos)""",
         "SELECT series, pos, CASE WHEN n >= 336 THEN up / nullif(span, 0) END AS level_area_ratio_672 FROM s")

register("linear_trend", spec(["close_trend_2", "close_trend_6", "close_trend_24"]),
         lambda s, d: inputs.bars(s, d).derive(R.linear_trends("close", [2, 6, 24])).df, EVENT_SQL,
         "SELECT series, pos, " + ", ".join(f"{sloped('close', w)} AS close_trend_{w}" for w in (2, 6, 24)) + " FROM bars")


# -- shape statistics ------------------------------------------------------------------------

def _moments_sql(w: int) -> str:
    n = f"count(close) OVER {past(w)}"
    flat = f"stddev_pop(close) OVER {past(w)} = 0"
    return (f"CASE WHEN {n} < {w // 2} THEN NULL WHEN {flat} THEN 0.0 ELSE skewness(close) OVER {past(w)} END AS close_skew_{w}, "
            f"CASE WHEN {n} < {w // 2} THEN NULL WHEN {flat} THEN 0.0 ELSE kurtosis(close) OVER {past(w)} END AS close_kurtosis_{w}")


register("moments", spec(["close_skew_10", "close_kurtosis_10", "close_skew_24", "close_kurtosis_24"]),
         lambda s, d: inputs.filled(s, d).derive(R.window_statistics("close", ["skew", "kurtosis"], [10, 24])).df, FILLED_SQL,
         f"SELECT series, pos, {_moments_sql(10)}, {_moments_sql(24)} FROM filled")

LISTED = FILLED_SQL + f""",
listed AS (SELECT series, pos, close, list(close) FILTER (close IS NOT NULL) OVER {past(12)} AS x, avg(close) OVER {past(12)} AS m,
  max(close) OVER {past(12)} AS top, count(close) OVER {past(12)} AS n FROM filled)"""
register("shape_statistics", spec(["close_lsbm_12", "close_fmax_12", "close_msdc_12"]),
         lambda s, d: inputs.filled(s, d).derive(R.window_statistics("close", ["lsbm", "fmax", "msdc"], [12])).df, LISTED,
         """SELECT series, pos,
  CASE WHEN n >= 6 THEN list_max(list_transform(string_split(list_aggregate(list_transform(x, lambda v: CASE WHEN v < m THEN 'b' ELSE ' ' END), 'string_agg', ''), ' '), lambda r: length(r))) END AS close_lsbm_12,
  CASE WHEN n >= 6 THEN CAST(list_position(x, top) - 1 AS DOUBLE) / n END AS close_fmax_12,
  CASE WHEN n >= 6 THEN (x[n] - x[n - 1] - x[2] + x[1]) / (2.0 * (n - 2)) END AS close_msdc_12 FROM listed""")


def _statistics_spec(spark, sf_dir):
    return apply_specs(inputs.bars(spark, sf_dir), [{"generator": "statistics", "feature_prefix": "st", "config": {
        "columns": "close", "functions": ["mean", "std", "slope"], "windows": [6, 24],
        "parameters": {"rel_base": "last", "rel_func": "diff"}}}])[0].df


register("statistics_by_name", spec([f"st_close_{f}_{w}" for f in ("mean", "std", "slope") for w in (6, 24)]), _statistics_spec,
         FILLED_SQL + f""",
w AS (SELECT series, pos, {', '.join(f"{rolled('close', f, w)} AS {f}_{w}" for f in ('mean', 'std') for w in (6, 24))},
  {', '.join(f"{sloped('close', w)} AS slope_{w}" for w in (6, 24))} FROM filled)""",
         "SELECT series, pos, " + ", ".join(f"{f}_6 - {f}_24 AS st_close_{f}_6, {f}_24 AS st_close_{f}_24" for f in ("mean", "std", "slope")) + " FROM w")

register("changes_and_shifts", spec(["pct", "pct_now", "logdiff", "close_lag_2", "close_lag_-1", "ln_close"]),
         lambda s, d: inputs.bars(s, d).derive([
             R.percent_change("close", "pct"), R.percent_change("close", "pct_now", "current"), R.log_difference("close", "logdiff"),
             *R.shifted_copies(["close"], [2, -1])]).with_columns({"ln_close": F.ln(F.when(F.col("close") > 0, F.col("close")))}).df,
         EVENT_SQL + """,
l AS (SELECT *, lag(close) OVER (PARTITION BY series ORDER BY pos) AS p FROM bars)""",
         """SELECT series, pos, 100 * (close - p) / nullif(p, 0) AS pct, 100 * (close - p) / nullif(close, 0) AS pct_now,
  CASE WHEN close > 0 AND p > 0 THEN ln(close) - ln(p) END AS logdiff, lag(close, 2) OVER (PARTITION BY series ORDER BY pos) AS close_lag_2,
  lead(close) OVER (PARTITION BY series ORDER BY pos) AS "close_lag_-1", CASE WHEN close > 0 THEN ln(close) END AS ln_close FROM l""")

register("constant_change", spec(["x_plus", "x_close_mul"]),
         lambda s, d: apply_specs(inputs.bars(s, d), [
             {"generator": "constant", "config": {"columns": "close", "function": "add", "parameter": 2.5, "names": "x_plus"}},
             {"generator": "tidemark.plans.specs:_constant", "feature_prefix": "x",
              "config": {"columns": "close", "function": "mul", "parameter": 3}}])[0].df,
         EVENT_SQL, "SELECT series, pos, close + 2.5 AS x_plus, close * 3 AS x_close_mul FROM bars")


@F.pandas_udf(T.DoubleType())
def _spread(values: pd.Series) -> float:
    return float(values.max() - values.min()) if values.notna().any() else float("nan")


register("user_aggregate", spec(["spread"]),
         lambda s, d: inputs.bars(s, d).derive(R.user_aggregate("close", _spread, 8, "spread")).df, EVENT_SQL,
         f"SELECT series, pos, CASE WHEN count(close) OVER {past(8)} >= 4 THEN max(close) OVER {past(8)} - min(close) OVER {past(8)} END AS spread FROM bars")


def _place_in_window(pos: np.ndarray, values: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A user's kernel: how many of the last 30 and of the next 10 values lie below this row's."""
    x = values["price"]
    earlier, later = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for k in range(1, 30):
        earlier[k:] += x[:-k] < x[k:]
    for k in range(1, 11):
        later[:-k] += x[k:] < x[:-k]
    return {"below_before": earlier, "below_after": later}


register("user_kernel", KEY + "below_before:b below_after:b",
         lambda s, d: inputs.ticks(s, d).derive(Kernel({"below_before": "long", "below_after": "long"}, ["price"], _place_in_window, 29, 10)).df,
         TICKS_SQL + """,
l AS (SELECT series, pos, price, list(price) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS b,
  list(price) OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS a FROM ticks)""",
         """SELECT series, pos, len(list_filter(b, lambda x: x < price))::BIGINT AS below_before, len(list_filter(a, lambda x: x < price))::BIGINT AS below_after FROM l""")


def _prefixed(spark, sf_dir):
    frame = inputs.bars(spark, sf_dir)
    frame = frame.with_df(frame.df.select("series", "ts", "pos", F.col("close").alias("btc_close"), F.col("open").alias("eth_close")))
    specs = [{"generator": "indicator", "column_prefix": p, "feature_prefix": p,
              "config": {"columns": "close", "functions": ["SMA"], "windows": [4], "interpolate": False}} for p in ("btc", "eth")]
    return apply_specs(frame, specs)[0].df


register("prefixed_columns", spec(["btc_close", "btc_close_SMA_4", "eth_close_SMA_4"]), _prefixed, EVENT_SQL,
         f"SELECT series, pos, close AS btc_close, {rolled('close', 'mean', 4, 4)} AS btc_close_SMA_4, {rolled('open', 'mean', 4, 4)} AS eth_close_SMA_4 FROM bars")

# -- indicators ------------------------------------------------------------------------------

SIMPLE = {"SMA": "mean", "SUM": "sum", "MAX": "max", "MIN": "min", "VAR": "var", "STDDEV": "std"}
names = [f"close_{f}_{w}" for f in SIMPLE for w in (5, 24)] + ["close_MIDPOINT_5", "close_MIDPOINT_24"]
register("indicator_averages", spec(names),
         lambda s, d: indicators(inputs.filled(s, d), "close", [*SIMPLE, "MIDPOINT"], [5, 24], fill_gaps=False)[0].df,
         FILLED_SQL, "SELECT series, pos, " + ", ".join(
             [f"{rolled('close', a, w, w)} AS close_{f}_{w}" for f, a in SIMPLE.items() for w in (5, 24)]
             + [f"(({rolled('close', 'max', w, w)}) + ({rolled('close', 'min', w, w)})) / 2 AS close_MIDPOINT_{w}" for w in (5, 24)]) + " FROM filled")

register("indicator_relative", spec(["close_SMA_1", "close_SMA_5", "close_SMA_24"]),
         lambda s, d: indicators(inputs.bars(s, d), ["close"], ["SMA"], [1, 5, 24], rel_base="next", rel_func="rel_diff", percentage=True)[0].df,
         FILLED_SQL + f",\nw AS (SELECT series, pos, close, {rolled('close', 'mean', 5, 5)} AS a, {rolled('close', 'mean', 24, 24)} AS b FROM filled)",
         "SELECT series, pos, (close - a) / nullif(a, 0) * 100 AS close_SMA_1, (a - b) / nullif(b, 0) * 100 AS close_SMA_5, b * 100 AS close_SMA_24 FROM w")

REGRESSION = ["LINEARREG", "LINEARREG_SLOPE", "LINEARREG_INTERCEPT", "LINEARREG_ANGLE", "TSF"]
register("indicator_regression", spec([f"close_{f}_14" for f in REGRESSION]),
         lambda s, d: indicators(inputs.filled(s, d), "close", REGRESSION, [14], fill_gaps=False)[0].df,
         FILLED_SQL + f""",
w AS (SELECT series, pos, {sloped('close', 14, 14)} AS m,
  CASE WHEN count(close) OVER {past(14)} = 14 THEN regr_intercept(close, CAST(pos - 473352 AS DOUBLE)) OVER {past(14)} END AS b0 FROM filled),
v AS (SELECT series, pos, m, b0 + m * (pos - 473352 - 13) AS b FROM w)""",
         """SELECT series, pos, b + 13 * m AS close_LINEARREG_14, m AS close_LINEARREG_SLOPE_14, b AS close_LINEARREG_INTERCEPT_14,
  degrees(atan(m)) AS close_LINEARREG_ANGLE_14, b + 14 * m AS close_TSF_14 FROM v""")

MOMENTUM = ["MOM", "ROC", "ROCP", "ROCR", "ROCR100"]
register("indicator_momentum", spec([f"close_{f}_7" for f in MOMENTUM]),
         lambda s, d: indicators(inputs.filled(s, d), "close", MOMENTUM, [7], fill_gaps=False)[0].df,
         FILLED_SQL + ",\nl AS (SELECT series, pos, close, lag(close, 7) OVER (PARTITION BY series ORDER BY pos) AS p FROM filled)",
         """SELECT series, pos, close - p AS close_MOM_7, (close / p - 1) * 100 AS close_ROC_7, (close - p) / p AS close_ROCP_7, close / p AS close_ROCR_7,
  close / p * 100 AS close_ROCR100_7 FROM l""")

register("indicator_weighted", spec(["close_WMA_6", "close_TRIMA_6", "close_TRIMA_5"]) + " close_MAXINDEX_6:b close_MININDEX_6:b",
         lambda s, d: indicators(indicators(inputs.filled(s, d), "close", ["WMA", "TRIMA", "MAXINDEX", "MININDEX"], [6], fill_gaps=False)[0],
                                 "close", "TRIMA", 5, fill_gaps=False)[0].df,
         FILLED_SQL + f""",
s AS (SELECT *, {rolled('close', 'mean', 3, 3)} AS s3, 
  count(close) OVER {past(6)} AS n, list(close) FILTER (close IS NOT NULL) OVER {past(6)} AS x, list(pos) OVER {past(6)} AS at FROM filled)""",
         f"""SELECT series, pos, CASE WHEN n = 6 THEN (x[1] + 2 * x[2] + 3 * x[3] + 4 * x[4] + 5 * x[5] + 6 * x[6]) / 21 END AS close_WMA_6,
  {rolled('s3', 'mean', 4, 4)} AS close_TRIMA_6, {rolled('s3', 'mean', 3, 3)} AS close_TRIMA_5,
  CASE WHEN n = 6 THEN pos + 1 - list_position(list_reverse(x), list_max(x)) END AS close_MAXINDEX_6,
  CASE WHEN n = 6 THEN pos + 1 - list_position(list_reverse(x), list_min(x)) END AS close_MININDEX_6 FROM s""")

TWO = ["ADD", "SUB", "MULT", "DIV"]


def _two_columns(spark, sf_dir):
    frame, _ = indicators(inputs.filled(spark, sf_dir), ["close", "open"], TWO, None, fill_gaps=False)
    return indicators(frame, ["close", "volume"], ["CORREL"], [10], fill_gaps=False)[0].df


register("indicator_two_columns", spec([f"close_open_{f}" for f in TWO] + ["close_volume_CORREL_10"]), _two_columns, FILLED_SQL,
         f"""SELECT series, pos, close + open AS close_open_ADD, close - open AS close_open_SUB, close * open AS close_open_MULT, close / nullif(open, 0) AS close_open_DIV,
  CASE WHEN count(close) OVER {past(10)} = 10 AND count(volume) OVER {past(10)} = 10 THEN coalesce(corr(close, volume) OVER {past(10)}, 0) END AS close_volume_CORREL_10 FROM filled""")


def _price_bars(spark, sf_dir):
    frame = inputs.filled(spark, sf_dir)
    full = {"open": "open", "high": "high", "low": "low", "close": "close"}
    for f, cols, w in (("AVGPRICE", full, None), ("MEDPRICE", {"high": "high", "low": "low"}, None),
                       ("TYPPRICE", {k: k for k in ("high", "low", "close")}, None), ("WCLPRICE", {k: k for k in ("high", "low", "close")}, None),
                       ("TRANGE", {k: k for k in ("high", "low", "close")}, None), ("MIDPRICE", {"high": "high", "low": "low"}, 8),
                       ("WILLR", {k: k for k in ("high", "low", "close")}, 8), ("CCI", {k: k for k in ("high", "low", "close")}, 8)):
        frame, _ = indicators(frame, cols, [f], w, names=[f.lower()], fill_gaps=False)
    return frame.df


register("indicator_price_bars", spec(["avgprice", "medprice", "typprice", "wclprice", "trange", "midprice", "willr", "cci"]), _price_bars,
         FILLED_SQL + f""",
t AS (SELECT *, (high + low + close) / 3 AS tp, lag(close) OVER (PARTITION BY series ORDER BY pos) AS p, count(close) OVER {past(8)} AS n,
  max(high) OVER {past(8)} AS hh, min(low) OVER {past(8)} AS ll FROM filled),
u AS (SELECT *, avg(tp) OVER {past(8)} AS m, list(tp) OVER {past(8)} AS x FROM t)""",
         """SELECT series, pos, (open + high + low + close) / 4 AS avgprice, (high + low) / 2 AS medprice, tp AS typprice, (high + low + 2 * close) / 4 AS wclprice,
  CASE WHEN p IS NOT NULL THEN greatest(high - low, abs(high - p), abs(low - p)) END AS trange, CASE WHEN n = 8 THEN (hh + ll) / 2 END AS midprice,
  CASE WHEN n = 8 THEN CASE WHEN hh = ll THEN 0 ELSE -100 * (hh - close) / (hh - ll) END END AS willr,
  CASE WHEN n = 8 THEN (tp - m) / (0.015 * list_avg(list_transform(x, lambda v: abs(v - m)))) END AS cci FROM u""")

MATH = {"LN": "ln(close)", "LOG10": "log10(close)", "SQRT": "sqrt(close)", "FLOOR": "floor(close)", "CEIL": "ceil(close)",
        "SIN": "sin(close)", "COS": "cos(close)", "ATAN": "atan(close)"}
register("indicator_math", spec([f"close_{f}" for f in MATH] + ["close_TAN", "small_EXP"]),
         lambda s, d: indicators(indicators(inputs.filled(s, d), "close", [*MATH, "TAN"], None, fill_gaps=False)[0].with_columns(
             {"small": F.col("close") / 100}), "small", "EXP", None, fill_gaps=False)[0].df, FILLED_SQL,
         "SELECT series, pos, " + ", ".join(f"CASE WHEN close > 0 THEN {e} END AS close_{f}" if f in ("LN", "LOG10") else f"{e} AS close_{f}" for f, e in MATH.items())
         + ", tan(close) AS close_TAN, exp(close / 100) AS small_EXP FROM filled")

STEP_SQL = """,
start AS (SELECT series, min(pos) FILTER (close IS NOT NULL) AS p0, max(pos) AS p1 FROM filled GROUP BY 1)"""


def ema_sql(w: int) -> str:
    return FILLED_SQL + STEP_SQL + f""",
ema AS (
  SELECT f.series, p0 + {w - 1} AS pos, avg(close) AS y FROM filled f JOIN start s ON f.series = s.series
  WHERE pos BETWEEN p0 AND p0 + {w - 1} GROUP BY f.series, p0
  UNION ALL
  SELECT e.series, f.pos, e.y + 2.0 / {w + 1} * (f.close - e.y) FROM ema e JOIN filled f ON f.series = e.series AND f.pos = e.pos + 1)"""


register("indicator_ema", spec(["close_EMA_9"]),
         lambda s, d: indicators(inputs.filled(s, d), "close", "EMA", 9, fill_gaps=False)[0].df,
         ema_sql(9), "SELECT f.series, f.pos, y AS close_EMA_9 FROM filled f LEFT JOIN ema e ON e.series = f.series AND e.pos = f.pos")

register("indicator_rsi", spec(["close_RSI_9", "close_CMO_9"]),
         lambda s, d: indicators(inputs.filled(s, d), "close", ["RSI", "CMO"], 9, fill_gaps=False)[0].df,
         FILLED_SQL + """,
moves AS (SELECT series, pos, greatest(c, 0) AS up, greatest(-c, 0) AS down FROM (
  SELECT series, pos, close - lag(close) OVER (PARTITION BY series ORDER BY pos) AS c FROM filled) WHERE c IS NOT NULL),
begin AS (SELECT series, min(pos) AS p0 FROM moves GROUP BY 1),
avgs AS (
  SELECT m.series, p0 + 8 AS pos, avg(up) AS u, avg(down) AS d FROM moves m JOIN begin b ON m.series = b.series
  WHERE pos BETWEEN p0 AND p0 + 8 GROUP BY m.series, p0
  UNION ALL
  SELECT a.series, m.pos, (a.u * 8 + m.up) / 9, (a.d * 8 + m.down) / 9 FROM avgs a JOIN moves m ON m.series = a.series AND m.pos = a.pos + 1)""",
         """SELECT f.series, f.pos, CASE WHEN u + d = 0 THEN 0 ELSE 100 * u / (u + d) END AS close_RSI_9,
  CASE WHEN u + d = 0 THEN 0 ELSE 100 * (u - d) / (u + d) END AS close_CMO_9 FROM filled f LEFT JOIN avgs a ON a.series = f.series AND a.pos = f.pos""")

register("indicator_atr", spec(["atr", "natr"]),
         lambda s, d: indicators(indicators(inputs.filled(s, d), {k: k for k in ("high", "low", "close")}, "ATR", 9, names=["atr"], fill_gaps=False)[0],
                                 {k: k for k in ("high", "low", "close")}, "NATR", 9, names=["natr"], fill_gaps=False)[0].df,
         FILLED_SQL + """,
tr AS (SELECT * FROM (SELECT series, pos, close, CASE WHEN p IS NOT NULL THEN greatest(high - low, abs(high - p), abs(low - p)) END AS r FROM (
  SELECT *, lag(close) OVER (PARTITION BY series ORDER BY pos) AS p FROM filled)) WHERE r IS NOT NULL),
begin AS (SELECT series, min(pos) AS p0 FROM tr GROUP BY 1),
atr AS (
  SELECT t.series, p0 + 8 AS pos, avg(r) AS y FROM tr t JOIN begin b ON t.series = b.series WHERE pos BETWEEN p0 AND p0 + 8 GROUP BY t.series, p0
  UNION ALL
  SELECT a.series, t.pos, (a.y * 8 + t.r) / 9 FROM atr a JOIN tr t ON t.series = a.series AND t.pos = a.pos + 1)""",
         "SELECT f.series, f.pos, y AS atr, 100 * y / close AS natr FROM filled f LEFT JOIN atr a ON a.series = f.series AND a.pos = f.pos")

register("indicator_dema_tema", spec(["close_DEMA_5", "close_TEMA_5"]),
         lambda s, d: indicators(inputs.filled(s, d), "close", ["DEMA", "TEMA"], 5, fill_gaps=False)[0].df,
         ema_sql(5) + "".join(f""",
start{k} AS (SELECT series, min(pos) AS p0 FROM {src} GROUP BY 1),
ema{k} AS (
  SELECT e.series, p0 + 4 AS pos, avg(y) AS y FROM {src} e JOIN start{k} s ON e.series = s.series WHERE pos BETWEEN p0 AND p0 + 4 GROUP BY e.series, p0
  UNION ALL
  SELECT a.series, e.pos, a.y + 2.0 / 6 * (e.y - a.y) FROM ema{k} a JOIN {src} e ON e.series = a.series AND e.pos = a.pos + 1)"""
                              for k, src in ((2, "ema"), (3, "ema2"))),
         """SELECT f.series, f.pos, 2 * a.y - b.y AS close_DEMA_5, 3 * (a.y - b.y) + c.y AS close_TEMA_5 FROM filled f
  LEFT JOIN ema a ON a.series = f.series AND a.pos = f.pos LEFT JOIN ema2 b ON b.series = f.series AND b.pos = f.pos
  LEFT JOIN ema3 c ON c.series = f.series AND c.pos = f.pos""")

# Exponential smoothing over a column with gaps: the weight of the past decays with each missing row.
register("exponential_mean", spec(["smooth"]),
         lambda s, d: exponential_mean(inputs.bars(s, d), "close", 10.0, "smooth", 5).df,
         EVENT_SQL + """,
seen AS (SELECT series, pos, close, row_number() OVER (PARTITION BY series ORDER BY pos) AS k,
  pos - lag(pos) OVER (PARTITION BY series ORDER BY pos) AS gap FROM bars WHERE close IS NOT NULL),
ewm AS (
  SELECT series, k, pos, close AS y FROM seen WHERE k = 1
  UNION ALL
  SELECT e.series, s.k, s.pos, (pow(1 - 2.0 / 11, s.gap) * e.y + 2.0 / 11 * s.close) / (pow(1 - 2.0 / 11, s.gap) + 2.0 / 11)
  FROM ewm e JOIN seen s ON s.series = e.series AND s.k = e.k + 1)""",
         """SELECT b.series, b.pos, CASE WHEN count(close) OVER (PARTITION BY b.series ORDER BY b.pos) >= 5
  THEN last_value(y IGNORE NULLS) OVER (PARTITION BY b.series ORDER BY b.pos) END AS smooth
  FROM bars b LEFT JOIN ewm e ON e.series = b.series AND e.pos = b.pos""")


# -- bundles ---------------------------------------------------------------------------------

def _market(spark, sf_dir):
    frame = inputs.filled(spark, sf_dir).with_columns({"tb_base_av": F.col("open"), "trades": F.col("trades") + 1})
    return bundles.market_bundle(frame, [4, 12], 24, use_differences=False)[0].df


MARKET = [("close_std", "close", "std"), ("volume", "volume", "mean"), ("span", "span", "mean"), ("trades", "n", "mean"), ("tb_base", "tb", "mean")]
market_sql = FILLED_SQL + f""",
m AS (SELECT series, pos, close, volume, high - low AS span, trades + 1 AS n, open / nullif(volume, 0) AS tb, close * volume AS p FROM filled),
w AS (SELECT series, pos, close, volume, {', '.join(
    [f"({rolled('p', 'mean', w)}) / nullif({rolled('volume', 'mean', w)}, 0) AS wma_{w}" for w in (4, 12, 24)]
    + [f"{rolled(c, f, w)} AS {n}_{w}" for n, c, f in MARKET for w in (4, 12, 24)]
    + [f"{sloped(c, w)} AS {c}_trend_{w}" for c in ('close', 'volume') for w in (4, 12)]
    + [area_sql('close', past(w), f'count(close) OVER {past(w)} >= {w // 2}', f'close_area_{w}') for w in (4, 12)])} FROM m)"""
market_names = [f"close_{w}" for w in (4, 12)] + [f"{n}_{w}" for n, _, _ in MARKET for w in (4, 12)] + [
    f"{n}_{w}" for n in ("close_area", "close_trend", "volume_trend") for w in (4, 12)]
register("market_bundle", " ".join([KEY.strip(), *[f"{n}:{'f' if n.startswith('close_area') else 'd'}" for n in market_names]]), _market, market_sql,
         "SELECT series, pos, " + ", ".join(
             [f"100 * (wma_{w} - wma_24) / nullif(wma_24, 0) AS close_{w}" for w in (4, 12)]
             + [f"100 * ({n}_{w} - {n}_24) / nullif({n}_24, 0) AS {n}_{w}" for n, _, _ in MARKET for w in (4, 12)]
             + [f"{n}_{w}" for n in ("close_area", "close_trend", "volume_trend") for w in (4, 12)]) + " FROM w")

register("market_bundle_differences", spec(["close_std_4", "volume_4", "trades_4"]),
         lambda s, d: bundles.market_bundle(inputs.filled(s, d).with_columns({"trades": F.col("trades") + 1}), [4], 24,
                                            ["close_STD", "volume_SMA", "trades_SMA"])[0].df,
         FILLED_SQL + f""",
l AS (SELECT series, pos, {', '.join(f"100.0 * ({c} - lag({c}) OVER o) / nullif(lag({c}) OVER o, 0) AS {n}" for n, c in (('close', 'close'), ('volume', 'volume'), ('trades', '(trades + 1)')))}
  FROM filled WINDOW o AS (PARTITION BY series ORDER BY pos)),
w AS (SELECT series, pos, {', '.join(f"{rolled(c, f, w)} AS {n}_{w}" for n, c, f in (('close_std', 'close', 'std'), ('volume', 'volume', 'mean'), ('trades', 'trades', 'mean')) for w in (4, 24))} FROM l)""",
         "SELECT series, pos, " + ", ".join(f"100 * ({n}_4 - {n}_24) / nullif({n}_24, 0) AS {n}_4" for n in ("close_std", "volume", "trades")) + " FROM w")


def _depth(spark, sf_dir):
    book = {c: (F.col("size") * (i + 1) + F.col("price") / 1000.0) for i, c in enumerate(bundles.DEPTH_COLUMNS)}
    frame = inputs.ticks(spark, sf_dir, [])
    return bundles.depth_bundle(frame.with_df(frame.df.select("series", "pos", "price", "size")), book)[0].df


depth_names = [f"{c}_{w}" for c in bundles.DEPTH_COLUMNS for w in bundles.DEPTH_WINDOWS]
register("depth_bundle", spec(depth_names), _depth,
         TICKS_SQL + ",\nbook AS (SELECT series, pos, " + ", ".join(f"size * {i + 1} + price / 1000.0 AS {c}" for i, c in enumerate(bundles.DEPTH_COLUMNS)) + " FROM ticks),\n"
         + "w AS (SELECT series, pos, " + ", ".join(f"{rolled(c, 'mean', w)} AS {c}_{w}" for c in bundles.DEPTH_COLUMNS for w in (2, 5, 10, 30)) + " FROM book)",
         "SELECT series, pos, " + ", ".join(f"100 * ({c}_{w} - {c}_30) / nullif({c}_30, 0) AS {c}_{w}" for c in bundles.DEPTH_COLUMNS for w in (2, 5, 10)) + " FROM w")

# -- labels ----------------------------------------------------------------------------------

register("future_aggregations", spec(["high_max_6", "low_min_6", "close_mean_24", "close_std_24"]),
         lambda s, d: inputs.bars(s, d).derive([
             *R.future_aggregations("high", "max", 6, rel_column="close", rel_factor=100.0), *R.future_aggregations("low", "min", 6),
             *R.future_aggregations("close", "mean", 24), *R.future_aggregations("close", "std", 24)]).df, EVENT_SQL,
         f"""SELECT series, pos, 100 * (({ahead('high', 'max', 6)}) - close) / nullif(close, 0) AS high_max_6, {ahead('low', 'min', 6)} AS low_min_6,
  {ahead('close', 'mean', 24)} AS close_mean_24, {ahead('close', 'std', 24)} AS close_std_24 FROM bars""")

register("future_area_and_trend", spec(["close_area_6", "close_slope_6"]),
         lambda s, d: inputs.bars(s, d).derive([*R.area_ratio("close", 6, future=True, suffix="_area"),
                                                *R.linear_trends("close", 6, future=True, suffix="_slope")]).df, EVENT_SQL,
         "SELECT series, pos, " + area_sql("close", with_current(6), f"count(*) OVER {with_current(6)} = 6 AND count(close) OVER {with_current(6)} >= 3", "close_area_6")
         + f""", CASE WHEN count(*) OVER {with_current(6)} < 6 OR count(close) OVER {with_current(6)} < 3 THEN NULL
  ELSE regr_slope(close, CAST(pos AS DOUBLE)) OVER {with_current(6)} END AS close_slope_6 FROM bars""")


def _threshold_sql(c: str, thresholds: dict[str, float]) -> str:
    out = []
    for n, t in thresholds.items():
        op = ">=" if (t > 0) == (abs(t) >= 0.75) else "<="
        out.append(f"coalesce({c} {op} {t}, false) AS {n}")
    return ", ".join(out)


# written out, so that the SQL does not take them from the labels that it is compared with
HIGH_PERCENT = [1.0, 1.5, 2.0, 2.5, 3.0, 0.1, 0.2, 0.3, 0.4, 0.5]
LOW_PERCENT = [-0.1, -0.2, -0.3, -0.4, -0.5, -1.0, -1.5, -2.0, -2.5, -3.0]
high_flags, low_flags = ({f"{side}_{round(abs(t) * 10):02d}": t for t in percent} for side, percent in (("high", HIGH_PERCENT), ("low", LOW_PERCENT)))
flags = [*high_flags, *low_flags]
register("horizon_labels", KEY + "high_max_12:d low_min_12:d high_to_low_12:d " + " ".join(f"{f}:b" for f in flags),
         lambda s, d: labels.horizon_labels(inputs.filled(s, d), 12)[0].df,
         FILLED_SQL + f""",
h AS (SELECT series, pos, 100 * (({ahead('high', 'max', 12)}) - close) / nullif(close, 0) AS hi, 100 * (({ahead('low', 'min', 12)}) - close) / nullif(close, 0) AS lo FROM filled)""",
         f"""SELECT series, pos, CASE WHEN hi < 0 THEN 0 ELSE hi END AS high_max_12, CASE WHEN lo > 0 THEN 0 ELSE -lo END AS low_min_12,
  2 * (CASE WHEN hi < 0 THEN 0 ELSE hi END) / nullif((CASE WHEN hi < 0 THEN 0 ELSE hi END) + (CASE WHEN lo > 0 THEN 0 ELSE -lo END), 0) - 1 AS high_to_low_12,
  {_threshold_sql('hi', high_flags)}, {_threshold_sql('lo', low_flags)} FROM h""")


def crossing_sql(reference: str, price: str, t: float, h: int) -> str:
    op = ">" if t > 0 else "<"
    hit = f"list_position(list_transform(list({price}) OVER {following(h)}, lambda x: coalesce(x {op} {reference} * (1 + {t} / 100.0), false)), true)"
    return f"CASE WHEN count(*) OVER {following(h)} = {h} THEN nullif({hit}, 0) - 1 END"


register("first_crossing", KEY + "up:b down:b",
         lambda s, d: labels.first_crossings(inputs.ticks(s, d), 40, {"up": ("price", "price", 150.0), "down": ("price", "price", -80.0)}).df,
         TICKS_SQL, f"SELECT series, pos, {crossing_sql('price', 'price', 150.0, 40)} AS up, {crossing_sql('price', 'price', -80.0, 40)} AS down FROM ticks")

register("first_crossing_long_horizon", KEY + "far:b",
         lambda s, d: labels.first_crossings(inputs.ticks(s, d), 2000, {"far": ("price", "price", 1200.0)}).df,
         TICKS_SQL + """,
total AS (SELECT series, count(*) AS n FROM ticks GROUP BY 1)""",
         """SELECT t.series, t.pos, (SELECT min(u.pos) FROM ticks u WHERE u.series = t.series AND u.pos > t.pos AND u.pos <= t.pos + 2000
    AND u.price > t.price * (1 + 1200.0 / 100.0)) - t.pos - 1 AS far FROM ticks t JOIN total ON t.series = total.series WHERE t.pos + 2000 < n
  UNION ALL SELECT t.series, t.pos, NULL FROM ticks t JOIN total ON t.series = total.series WHERE t.pos + 2000 >= n""")


def first_cross_sql(function: str, thresholds: dict[str, float], tolerance: float, h: int) -> str:
    toward, against, sign = ("high", "low", 1) if function == "high" else ("low", "high", -1)
    parts = []
    for n, t in thresholds.items():
        t = sign * t
        parts.append(f"{crossing_sql('close', toward, t, h)} AS {n}_1, {crossing_sql('close', against, round(-t * tolerance, 6), h)} AS {n}_2")
    return ", ".join(parts)


def _highlow2(spark, sf_dir):
    specs = [{"generator": "highlow2", "config": {"columns": ["close", "high", "low"], "function": f, "thresholds": [60.0, 90.0], "tolerance": 0.5,
                                                  "horizon": 24, "names": [f"{f}_60", f"{f}_90"]}} for f in ("high", "low")]
    return apply_specs(inputs.filled(spark, sf_dir), specs)[0].df


register("first_cross_labels", KEY + "high_60:b high_90:b low_60:b low_90:b", _highlow2,
         FILLED_SQL + ",\nc AS (SELECT series, pos, " + first_cross_sql("high", {"high_60": 60.0, "high_90": 90.0}, 0.5, 24) + ", "
         + first_cross_sql("low", {"low_60": 60.0, "low_90": 90.0}, 0.5, 24) + " FROM filled)",
         "SELECT series, pos, " + ", ".join(f"({n}_1 IS NOT NULL AND ({n}_2 IS NULL OR {n}_1 <= {n}_2)) AS {n}" for n in ("high_60", "high_90", "low_60", "low_90")) + " FROM c")


def extremum_sql(specs: list[extremum.ExtremumLabel], ctes: str = FILLED_SQL, source: str = "filled", column: str = "close") -> tuple[str, str]:
    """Nearest rows below the level by subqueries, nothing as high in between, then runs inside the tolerance."""
    parts = [ctes]
    for n, (top, level) in enumerate(dict.fromkeys((s.top, s.level) for s in specs)):
        near = "(SELECT {agg}(b.pos) FROM y{n} b WHERE b.series = a.series AND b.pos {op} a.pos AND b.y < a.y - {share} * abs(a.y))"
        guard = "NOT EXISTS (SELECT 1 FROM y{n} b WHERE b.series = e.series AND b.pos > {lo} AND b.pos < {hi} AND b.y {op} e.y)"
        parts.append(f"""y{n} AS MATERIALIZED (SELECT series, pos, {'' if top else '-'}{column} AS y FROM {source} WHERE {column} IS NOT NULL),
e{n} AS MATERIALIZED (SELECT series, pos, y, {near.format(n=n, agg='max', op='<', share=level)} AS l, {near.format(n=n, agg='min', op='>', share=level)} AS r FROM y{n} a),
x{n} AS MATERIALIZED (SELECT series, pos, y, l, r FROM e{n} e WHERE l IS NOT NULL AND r IS NOT NULL
  AND {guard.format(n=n, lo='e.l', hi='e.pos', op='>=')} AND {guard.format(n=n, lo='e.pos', hi='e.r', op='>')})""")
        for i, s in enumerate(specs):
            if (s.top, s.level) == (top, level):
                inner = "(SELECT {agg}(b.pos) FROM y{n} b WHERE b.series = x.series AND b.pos {op} x.pos AND b.y < x.y - {share} * abs(x.y))"
                left, right = inner.format(n=n, agg="max", op="<", share=s.tolerance), inner.format(n=n, agg="min", op=">", share=s.tolerance)
                parts.append(f"z{i} AS MATERIALIZED (SELECT series, greatest(l, {left}) AS a, least(r, {right}) AS b FROM x{n} x)")
    marks = " UNION ALL ".join(f"SELECT series, a, b, {i} AS i FROM z{i}" for i in range(len(specs)))
    parts.append(f"""marks AS (SELECT f.series, f.pos, list(DISTINCT i) AS hit FROM {source} f JOIN ({marks}) z
  ON z.series = f.series AND f.pos > z.a AND f.pos < z.b GROUP BY 1, 2)""")
    flags = ", ".join(f"coalesce(list_contains(hit, {i}), false) AS {s.name}" for i, s in enumerate(specs))
    return ",\n".join(parts), f"SELECT f.series, f.pos, {flags} FROM {source} f LEFT JOIN marks m ON m.series = f.series AND m.pos = f.pos"


EXTREMES = [extremum.ExtremumLabel("top_a", True, 0.5, 0.1), extremum.ExtremumLabel("top_b", True, 0.5, 0.25),
            extremum.ExtremumLabel("bot_a", False, 2.0, 0.5)]


def _extremes(spark, sf_dir):
    return extremum.extremum_labels(inputs.filled(spark, sf_dir), "close", EXTREMES)[0].df


register("extremum_labels", KEY + "top_a:b top_b:b bot_a:b", _extremes, *extremum_sql(EXTREMES))

#: The labels of one level: tolerances are fractions of it.
ONE_LEVEL = [extremum.ExtremumLabel("narrow", False, 2.0, 0.5), extremum.ExtremumLabel("wide", False, 2.0, 1.0)]
register("extremum_one_level", KEY + "narrow:b wide:b",
         lambda s, d: apply_specs(inputs.filled(s, d), [
             {"generator": "topbot2", "config": {"columns": "close", "function": "bot", "level": 2.0, "tolerances": [0.25, 0.5], "names": ["narrow", "wide"]}}])[0].df,
         *extremum_sql(ONE_LEVEL))

# written out as above; the name of a tolerance is its digits behind 0.0
PRESET = [extremum.ExtremumLabel(f"{side}{k}_{text}", side == "top", k / 100, float(f"0.0{text}"))
          for text in "025 05 075 1 125 15 175 2 25 3".split() for side in ("top", "bot") for k in range(1, 6)]
register("extremum_preset", KEY + " ".join(f"{p.name}:b" for p in PRESET),
         lambda s, d: extremum.tops_and_bottoms(inputs.filled(s, d))[0].df, *extremum_sql(PRESET))

TICK_EXTREMES = [extremum.ExtremumLabel("top", True, 0.9, 0.5), extremum.ExtremumLabel("bot", False, 9.0, 4.0)]
register("extremum_ticks", KEY + "top:b bot:b",
         lambda s, d: extremum.extremum_labels(inputs.ticks(s, d), "price", TICK_EXTREMES)[0].df,
         *extremum_sql(TICK_EXTREMES, TICKS_SQL, "ticks", "price"))
