"""Catalogue: scores, signals, transactions, sweeps, depth."""

from __future__ import annotations



from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from tidemark.frame import tasks_for
from tidemark.operators import scores as S
from tidemark.operators import trades as T
from tidemark.operators.depth import depth_bins
from tidemark.plans import inputs
from tidemark.plans.catalog import register
from tidemark.plans.catalog_windows import KEY, rolled
from tidemark.plans.flagship import moving_average_signals
from tidemark.plans.inputs import FILLED_SQL, SCORED_SQL, SIGNALLED_SQL
from tidemark.plans.specs import apply_specs

register("moving_average_signals", "series:s ts:b close:d average:d distance:d buy:b sell:b", moving_average_signals,
         FILLED_SQL + f""",
m AS (SELECT series, ts, close, {rolled('close', 'mean', 5, 5)} AS average FROM filled),
v AS (SELECT *, (close - average) / nullif(average, 0) AS distance FROM m)""",
         """SELECT series, epoch(ts) AS ts, close, average, distance, distance >= 0.5 AS buy, distance <= -0.5 AS sell FROM v
  WHERE distance >= 0.5 OR distance <= -0.5""")


# -- scores ----------------------------------------------------------------------------------

def _smoothed(spark, sf_dir):
    return apply_specs(inputs.scored(spark, sf_dir), [
        {"generator": "smoothen", "config": {"columns": ["buy_score", "sell_score"], "names": "plain", "window": 6}},
        {"generator": "smoothen", "config": {"columns": ["buy_score"], "names": "share", "window": 6, "point_threshold": 0.5}},
        {"generator": "smoothen", "config": {"columns": ["buy_score"], "names": "row"}}])[0].df


register("smoothed_scores", KEY + "plain:d share:d row:d", _smoothed,
         SCORED_SQL + """,
r AS (SELECT series, pos, buy_score, CASE WHEN buy_score IS NULL THEN sell_score WHEN sell_score IS NULL THEN buy_score
  ELSE (buy_score + sell_score) / 2 END AS m, CASE WHEN buy_score >= 0.5 THEN 1.0 ELSE 0.0 END AS p FROM scored)""",
         f"SELECT series, pos, {rolled('m', 'mean', 6)} AS plain, {rolled('p', 'mean', 6)} AS share, buy_score AS \"row\" FROM r")

register("smoothed_scores_exponential", KEY + "smooth:d",
         lambda s, d: S.smoothen(inputs.scored(s, d), ["buy_score", "sell_score"], "smooth", 8.0).df,
         SCORED_SQL + """,
seen AS (SELECT series, pos, (buy_score + sell_score) / 2 AS m, row_number() OVER (PARTITION BY series ORDER BY pos) AS k,
  pos - lag(pos) OVER (PARTITION BY series ORDER BY pos) AS gap FROM scored WHERE buy_score IS NOT NULL),
ewm AS (
  SELECT series, k, pos, m AS y FROM seen WHERE k = 1
  UNION ALL
  SELECT e.series, s.k, s.pos, (pow(1 - 2.0 / 9, s.gap) * e.y + 2.0 / 9 * s.m) / (pow(1 - 2.0 / 9, s.gap) + 2.0 / 9)
  FROM ewm e JOIN seen s ON s.series = e.series AND s.k = e.k + 1)""",
         """SELECT b.series, b.pos, CASE WHEN count(buy_score) OVER (PARTITION BY b.series ORDER BY b.pos) >= 4
  THEN last_value(y IGNORE NULLS) OVER (PARTITION BY b.series ORDER BY b.pos) END AS smooth
  FROM scored b LEFT JOIN ewm e ON e.series = b.series AND e.pos = b.pos""")

register("combined_scores", KEY + "plain:d relative:d difference:d scaled:d",
         lambda s, d: inputs.scored(s, d).with_columns({
             "plain": S.combine("buy_score", "sell_score"), "relative": S.combine("buy_score", "sell_score", "relative"),
             "difference": S.combine("buy_score", "sell_score", "difference"),
             "scaled": S.combine("buy_score", "sell_score", "difference", 2.0, 0.1)}).df, SCORED_SQL,
         """SELECT series, pos, CASE WHEN buy_score >= sell_score THEN buy_score ELSE -sell_score END AS plain,
  2 * (buy_score / nullif(buy_score + sell_score, 0)) - 1 AS relative, buy_score - sell_score AS difference,
  2 * (buy_score - sell_score) + 0.1 AS scaled FROM scored""")


def _rules(spark, sf_dir):
    return apply_specs(inputs.scored(spark, sf_dir), [
        {"generator": "threshold_rule", "config": {"columns": ["trade_score"], "names": ["buy", "sell"], "parameters": {
            "buy_signal_threshold": 0.25, "sell_signal_threshold": -0.15}}},
        {"generator": "threshold_rule2", "config": {"columns": ["trade_score", "buy_score"], "names": ["buy2", "sell2"], "parameters": {
            "buy_signal_threshold": 0.1, "sell_signal_threshold": -0.1, "buy_signal_threshold_2": 0.5, "sell_signal_threshold_2": 0.3}}},
    ])[0].with_columns({f"rule_{k}": c for k, c in S.rule_signals({
        "buy": {"buy_score": 0.5, "sell_score": 0.3}, "sell": {"buy_score": 0.4, "sell_score": 0.6}}).items()}).df


register("threshold_rules", KEY + "buy:b sell:b buy2:b sell2:b rule_buy:b rule_sell:b", _rules, SCORED_SQL,
         """SELECT series, pos, coalesce(trade_score >= 0.25, false) AS buy, coalesce(trade_score <= -0.15, false) AS sell,
  coalesce(trade_score >= 0.1, false) AND coalesce(buy_score >= 0.5, false) AS buy2,
  coalesce(trade_score <= -0.1, false) AND coalesce(buy_score <= 0.3, false) AS sell2,
  coalesce(buy_score >= 0.5 AND sell_score >= 0.3, false) AS rule_buy, coalesce(buy_score <= 0.4 AND sell_score <= 0.6, false) AS rule_sell FROM scored""")

POSITIVE = [{"edge": 0.2, "frequency": 240, "sign": "+", "text": "weak"}, {"edge": 0.4, "frequency": 60, "sign": "++", "text": "strong", "bold": True}]
NEGATIVE = [{"edge": -0.1, "sign": "-", "text": "weak"}, {"edge": -0.25, "frequency": 60, "sign": "--", "text": "strong"}]
BAND_SQL = """CASE WHEN trade_score >= 0.4 THEN 2 WHEN trade_score >= 0.2 THEN 1 WHEN trade_score < -0.25 THEN -2
  WHEN trade_score < -0.1 THEN -1 ELSE 0 END"""

register("score_bands", KEY + "band:b",
         lambda s, d: inputs.scored(s, d).with_columns({"band": S.score_band(F.col("trade_score"), [0.2, 0.4], [-0.1, -0.25])}).df,
         SCORED_SQL, f"SELECT series, pos, {BAND_SQL} AS band FROM scored")


def _band_events(spark, sf_dir):
    events = S.band_events(inputs.scored(spark, sf_dir), "trade_score", "1h", POSITIVE, NEGATIVE)
    return events.withColumn("message", S.band_message(F.upper("series"), F.coalesce("close", F.lit(0.0)), F.coalesce("trade_score", F.lit(0.0)), "1h", POSITIVE, NEGATIVE))


register("band_events", KEY + "band:b band_up:b band_down:b periodic:b message:s", _band_events,
         SCORED_SQL + f""",
b AS (SELECT *, {BAND_SQL} AS band FROM scored),
p AS (SELECT *, lag(band) OVER (PARTITION BY series ORDER BY pos) AS prev FROM b),
e AS (SELECT *, prev IS NULL OR abs(band) > abs(prev) AS band_up, prev IS NULL OR abs(band) < abs(prev) AS band_down,
  band IN (1, 2, -2) AS periodic,
  printf('%+.2f', coalesce(trade_score, 0.0)) AS t, format('{{:,}}', CAST(floor(coalesce(close, 0)) AS BIGINT)) AS price FROM p),
m AS (SELECT *, CASE WHEN band_up THEN '↑' WHEN band_down THEN '↓' ELSE '' END AS arrow FROM e)""",
         """SELECT series, pos, band, band_up, band_down, periodic,
  CASE WHEN band = 0 THEN upper(series) || ' ' || price || ' Indicator: ' || t || ' ' || arrow || '   1h'
       ELSE CASE WHEN band = 2 THEN '*' ELSE '' END || CASE band WHEN 1 THEN '+' WHEN 2 THEN '++' WHEN -1 THEN '-' ELSE '--' END || ' ' || upper(series) || ' ' || price
         || ' Indicator: ' || t || ' ' || arrow || '   ' || CASE band WHEN 1 THEN 'weak' WHEN 2 THEN 'strong' WHEN -1 THEN 'weak' ELSE 'strong' END || ' 1h' || CASE WHEN band = 2 THEN '*' ELSE '' END
  END AS message FROM m WHERE periodic OR band_up OR band_down""")

register("latest_signal", "series:s side:s close_price:d close_time:b",
         lambda s, d: S.latest_signal(inputs.signalled(s, d, 0.1, -0.1).df, ["series"], "1h", "buy", "sell"), SCORED_SQL,
         """SELECT series, CASE WHEN trade_score >= 0.1 THEN 'BUY' WHEN trade_score <= -0.1 THEN 'SELL' ELSE '' END AS side, close AS close_price,
  epoch(ts) + 3600 AS close_time FROM scored b WHERE b.ts = (SELECT max(ts) FROM scored x WHERE x.series = b.series)""")

register("display_average", KEY + "buy_score_4:d buy_score_9:d", lambda s, d: S.score_average(inputs.scored(s, d), "buy_score", [4, 9]).df,
         SCORED_SQL, f"SELECT series, pos, {rolled('buy_score', 'mean', 4, 4)} AS buy_score_4, {rolled('buy_score', 'mean', 9, 9)} AS buy_score_9 FROM scored")


def _intervals(spark, sf_dir):
    frame = inputs.scored(spark, sf_dir).with_columns({"label": F.col("trades") > 3})
    return S.interval_precision(frame, "label", "buy_score", 0.7)


register("interval_precision", "series:s interval_no:b label:b buy_score:b", _intervals,
         SCORED_SQL + """,
c AS (SELECT *, trades > 3 AS label, coalesce(buy_score >= 0.7, false) AS reached FROM scored),
f AS (SELECT *, CASE WHEN label <> lag(label) OVER (PARTITION BY series ORDER BY pos) THEN 1 ELSE 0 END AS change FROM c),
i AS (SELECT *, sum(change) OVER (PARTITION BY series ORDER BY pos) AS interval_no FROM f)""",
         "SELECT series, interval_no, bool_or(label) AS label, bool_or(reached) AS buy_score FROM i GROUP BY 1, 2")


# -- transactions ----------------------------------------------------------------------------

# Plain state machine: one step per row.
WALK_SQL = SIGNALLED_SQL + """,
rows_ AS (SELECT series, pos, ts, close, buy, sell, row_number() OVER (PARTITION BY series ORDER BY pos) AS k FROM signalled
  WHERE close IS NOT NULL AND close <> 0),
walk AS (
  SELECT series, k, pos, ts, close, buy AS long, CASE WHEN buy THEN 'BUY' END AS side FROM rows_ WHERE k = 1
  UNION ALL
  SELECT r.series, r.k, r.pos, r.ts, r.close, CASE WHEN w.long THEN NOT r.sell ELSE r.buy END,
    CASE WHEN w.long AND r.sell THEN 'SELL' WHEN NOT w.long AND r.buy THEN 'BUY' END
  FROM walk w JOIN rows_ r ON r.series = w.series AND r.k = w.k + 1),
events_ AS (SELECT series, pos, ts, close, side, lag(close) OVER (PARTITION BY series, side ORDER BY pos) AS before,
  lag(close) OVER (PARTITION BY series ORDER BY pos) AS other FROM walk WHERE side IS NOT NULL),
traded AS (SELECT *, coalesce(CASE WHEN side = 'BUY' THEN before - close ELSE close - before END, 0.0) AS profit FROM events_),
done AS (SELECT *, coalesce(100 * profit / before, 0.0) AS profit_percent FROM traded)"""


def _events(spark, sf_dir):
    return T.alternating_transactions(inputs.signalled(spark, sf_dir), "buy", "sell", "close")


register("alternating_transactions", KEY + "close:d side:s", lambda s, d: _events(s, d).df, WALK_SQL,
         "SELECT series, pos, close, side FROM events_")
register("transaction_profits", KEY + "side:s previous_price:d profit:d profit_percent:d",
         lambda s, d: T.transaction_profits(_events(s, d).settle(), "close").df, WALK_SQL,
         "SELECT series, pos, side, coalesce(before, 0) AS previous_price, profit, profit_percent FROM done")
register("transaction_profits_paired", KEY + "side:s profit:d",
         lambda s, d: T.transaction_profits(_events(s, d).settle(), "close", paired=True).df, WALK_SQL,
         "SELECT series, pos, side, coalesce(CASE WHEN side = 'BUY' THEN other - close ELSE close - other END, 0) AS profit FROM done")

MEASURES = "transactions:b profit:d profit_percent:d profitable:b profitable_percent:d profit_per_transaction:d profit_percent_per_transaction:d"


def measures_sql(exact: bool) -> str:
    p, q = ("sum(profit)", "sum(profit_percent)") if exact else ("round(sum(profit), 2)", "round(sum(profit_percent), 1)")
    return f"""count(*) AS transactions, {p} AS profit, {q} AS profit_percent, count(*) FILTER (profit > 0) AS profitable,
  round(100.0 * count(*) FILTER (profit > 0) / count(*), 1) AS profitable_percent, round(sum(profit) / count(*), 2) AS profit_per_transaction,
  round(sum(profit_percent) / count(*), 1) AS profit_percent_per_transaction"""


register("performance", "series:s direction:s " + MEASURES,
         lambda s, d: T.performance(T.transaction_profits(_events(s, d).settle(), "close").df, ["series"]), WALK_SQL,
         f"""SELECT series, CASE WHEN side = 'SELL' THEN 'long' ELSE 'short' END AS direction, {measures_sql(False)} FROM done GROUP BY 1, 2
  UNION ALL SELECT series, 'both', {measures_sql(True)} FROM done GROUP BY 1""")


def _monthly(spark, sf_dir):
    signals = inputs.signalled(spark, sf_dir)
    span = signals.df.groupBy("series").agg(T.months(F.min("ts"), F.max("ts")).alias("months"))
    events = T.alternating_transactions(signals, "buy", "sell", "close").settle()
    totals = T.performance(T.transaction_profits(events, "close").df, ["series"]).where("direction = 'long'")
    return T.monthly_rates(totals, span, ["series"])


register("monthly_rates", "series:s months:d transactions_per_month:d profit_per_month:d profit_percent_per_month:d", _monthly,
         WALK_SQL + f""",
t AS (SELECT series, {measures_sql(False)} FROM done WHERE side = 'SELL' GROUP BY 1),
s AS (SELECT series, (epoch(max(ts)) - epoch(min(ts))) / 2628000.0 AS months FROM signalled GROUP BY 1)""",
         """SELECT t.series, months, round(transactions / months, 2) AS transactions_per_month, round(profit / months, 2) AS profit_per_month,
  round(profit_percent / months, 2) AS profit_percent_per_month FROM t JOIN s ON t.series = s.series""")

LIVE_SQL = SIGNALLED_SQL + """,
sig AS (SELECT series, pos, ts, close, CASE WHEN buy THEN 'BUY' ELSE 'SELL' END AS side FROM signalled WHERE buy <> sell),
lagged AS (SELECT *, lag(side) OVER (PARTITION BY series ORDER BY pos) AS prev FROM sig),
live AS (SELECT series, pos, ts, close, side, lag(close) OVER (PARTITION BY series ORDER BY pos) AS before FROM lagged WHERE prev IS NULL OR prev <> side),
paid AS (SELECT *, coalesce(CASE WHEN side = 'BUY' THEN before - close ELSE close - before END, 0.0) AS profit FROM live)"""
register("live_transactions", KEY + "side:s close:d profit:d",
         lambda s, d: T.live_transactions(inputs.signalled(s, d), "buy", "sell", "close").df, LIVE_SQL,
         "SELECT series, pos, side, close, profit FROM paid")


def _recent(spark, sf_dir):
    live = T.live_transactions(inputs.signalled(spark, sf_dir), "buy", "sell", "close").settle()
    return T.recent_statistics(live, F.lit("2024-02-10 00:00:00").cast("timestamp"), 4, "close")


register("recent_statistics", "series:s side:s count:b profit_sum:d percent_sum:d percent_mean:d percent_std:d percent_min:d percent_median:d percent_max:d",
         _recent, LIVE_SQL + """,
r AS (SELECT *, CASE WHEN before = 0 THEN 0 ELSE 100 * profit / before END AS percent FROM paid
  WHERE ts >= TIMESTAMP '2024-01-13' AND before IS NOT NULL)""",
         """SELECT series, side, count(*) AS "count", sum(profit) AS profit_sum, sum(percent) AS percent_sum, avg(percent) AS percent_mean,
  stddev_samp(percent) AS percent_std, min(percent) AS percent_min, quantile_cont(percent, 0.5) AS percent_median, max(percent) AS percent_max
  FROM r GROUP BY 1, 2""")

GRID = {"buy_signal_threshold": [0.1, 0.2, 0.3], "sell_signal_threshold": [-0.05, -0.15]}


def _sweep(spark, sf_dir):
    return T.sweep(inputs.scored(spark, sf_dir), ["trade_score"], "close", GRID, "long", top=4)




def sweep_sql(params: str, buy: str, sell: str, side: str, ctes: str = SCORED_SQL, source: str = "scored") -> str:
    """The same state machine, once per parameter set."""
    change = "close - before" if side == "SELL" else "before - close"
    return ctes + f""",
params AS ({params}),
rows_ AS (SELECT param_id, series, pos, close, coalesce({buy}, false) AS buy, coalesce({sell}, false) AS sell,
  row_number() OVER (PARTITION BY param_id, series ORDER BY pos) AS k FROM {source}, params WHERE close IS NOT NULL AND close <> 0),
walk AS (
  SELECT param_id, series, k, pos, close, buy AS long, CASE WHEN buy THEN 'BUY' END AS side FROM rows_ WHERE k = 1
  UNION ALL
  SELECT r.param_id, r.series, r.k, r.pos, r.close, CASE WHEN w.long THEN NOT r.sell ELSE r.buy END,
    CASE WHEN w.long AND r.sell THEN 'SELL' WHEN NOT w.long AND r.buy THEN 'BUY' END
  FROM walk w JOIN rows_ r ON r.series = w.series AND r.param_id = w.param_id AND r.k = w.k + 1),
taken AS (SELECT param_id, series, close, lag(close) OVER (PARTITION BY param_id, series ORDER BY pos) AS before FROM walk WHERE side = '{side}'),
done AS (SELECT *, coalesce({change}, 0) AS profit, coalesce(100 * ({change}) / before, 0) AS profit_percent FROM taken),
span AS (SELECT series, (epoch(max(ts)) - epoch(min(ts))) / 2628000.0 AS months FROM scored GROUP BY 1),
totals AS (SELECT param_id, series, {measures_sql(False)} FROM done GROUP BY 1, 2),
ranked AS (SELECT span.series, params.*, coalesce(transactions, 0) AS transactions, coalesce(profit, 0) AS profit,
  round(coalesce(profit_percent, 0) / months, 2) AS profit_percent_per_month
  FROM span CROSS JOIN params LEFT JOIN totals ON totals.series = span.series AND totals.param_id = params.param_id)"""


SWEEP_SQL = sweep_sql("""SELECT row_number() OVER (ORDER BY b, s DESC) - 1 AS param_id, b, s
  FROM (SELECT unnest([0.1, 0.2, 0.3]) AS b), (SELECT unnest([-0.05, -0.15]) AS s)""", "trade_score >= b", "trade_score <= s", "SELL")
register("parameter_sweep", "series:s param_id:b buy_signal_threshold:d sell_signal_threshold:d transactions:b profit:d profit_percent_per_month:d place:b",
         _sweep, SWEEP_SQL,
         """SELECT series, param_id, b AS buy_signal_threshold, s AS sell_signal_threshold, transactions, profit, profit_percent_per_month,
  row_number() OVER (PARTITION BY series ORDER BY profit_percent_per_month DESC, param_id) AS place FROM ranked
  QUALIFY row_number() OVER (PARTITION BY series ORDER BY profit_percent_per_month DESC, param_id) <= 4""")


def _sweep_two(spark, sf_dir):
    grid = {"buy_signal_threshold": [0.1, 0.2], "buy_signal_threshold_2": [0.0, 0.1]}
    frame = inputs.scored(spark, sf_dir).derive(
        S.rolling("trade_score", "mean", 4, "slow_score"))
    return T.sweep(frame, ["trade_score", "slow_score"], "close", grid, "short", buy_sell_equal=True, top=None)


register("parameter_sweep_two_scores", "series:s param_id:b buy_signal_threshold:d sell_signal_threshold_2:d transactions:b profit:d", _sweep_two,
         sweep_sql("""SELECT row_number() OVER (ORDER BY b, c) - 1 AS param_id, b, c
  FROM (SELECT unnest([0.1, 0.2]) AS b), (SELECT unnest([0.0, 0.1]) AS c)""", "trade_score >= b AND slow_score >= c",
                   "trade_score <= -b AND slow_score <= -c", "BUY",
                   SCORED_SQL + f", two AS (SELECT *, {rolled('trade_score', 'mean', 4)} AS slow_score FROM scored)", "two"),
         "SELECT series, param_id, b AS buy_signal_threshold, -c AS sell_signal_threshold_2, transactions, profit FROM ranked")


# -- depth -----------------------------------------------------------------------------------

def _ladders(spark, sf_dir) -> DataFrame:
    """Each order as a ladder: its lines are price levels with their quantity."""
    lines = inputs.table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor(F.col("l_extendedprice") / 1000).alias("price"), "l_quantity")
    placed = lines.repartition(tasks_for(spark, lines.count()), "l_orderkey", "price")
    return placed.groupBy("l_orderkey", "price").agg(F.sum("l_quantity").alias("volume"))


LADDER_SQL = """
lad AS (SELECT l_orderkey, CAST(floor(l_extendedprice / 1000) AS DOUBLE) AS p, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
lv AS (SELECT l_orderkey, p - min(p) OVER (PARTITION BY l_orderkey) AS lo, v,
  lead(p) OVER (PARTITION BY l_orderkey ORDER BY p) - min(p) OVER (PARTITION BY l_orderkey) AS nx FROM lad),
seg AS (SELECT l_orderkey, lo, v, coalesce(nx, (floor(lo / 8) + 1) * 8) AS hi FROM lv),
binned AS (SELECT l_orderkey, lo, hi, v, unnest(generate_series(CAST(floor(lo / 8) AS BIGINT), CAST(ceil(hi / 8) AS BIGINT) - 1)) AS bin FROM seg WHERE hi > lo)"""
register("depth_bins", "l_orderkey:b bin:b volume:d", lambda s, d: depth_bins(_ladders(s, d), ["l_orderkey"], 8.0), LADDER_SQL,
         "SELECT l_orderkey, bin, sum((least(hi, (bin + 1) * 8) - greatest(lo, bin * 8)) * v) / 8 AS volume FROM binned GROUP BY 1, 2")

register("depth_bins_bid", "l_orderkey:b bin:b volume:d",
         lambda s, d: depth_bins(_ladders(s, d).withColumn("price", -F.col("price")), ["l_orderkey"], 8.0, side="bid"), LADDER_SQL,
         "SELECT l_orderkey, bin, sum((least(hi, (bin + 1) * 8) - greatest(lo, bin * 8)) * v) / 8 AS volume FROM binned GROUP BY 1, 2")
