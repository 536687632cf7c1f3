"""Bars, ticks and scores made from the provided tables: the inputs of the catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import SeriesFrame, number_rows, tasks_for
from tidemark.operators.raster import densify, interpolate
from tidemark.operators.resample import ticks_to_bars
from tidemark.operators.scores import combine

PRICES = ["open", "high", "low", "close", "volume"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of the event values per event type; hours without events are missing."""
    return ticks_to_bars(event_ticks(spark, sf_dir), "series", "1h", "value", tie="event_id")


def bars(spark: SparkSession, sf_dir: str) -> SeriesFrame:
    """The same on a gapless raster."""
    return densify(hourly(spark, sf_dir), "series", "ts", "1h", fill={"trades": 0})


def filled(spark: SparkSession, sf_dir: str) -> SeriesFrame:
    """The raster with interpolated prices and volume."""
    return interpolate(bars(spark, sf_dir), PRICES)


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of the order totals per priority."""
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        "o_orderkey", F.col("o_totalprice").alias("value"))
    return ticks_to_bars(orders, "series", "1D", "value", tie="o_orderkey")


LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def ticks(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> SeriesFrame:
    """Line items as one long irregular series per flag and status, numbered in shipping order.

    ``columns`` are those of the line items that the query goes on with besides price and size; all, if it is left out.
    """
    every = columns is None
    lines = table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("series"), *dict.fromkeys([*LINE_ORDER, *(["l_discount"] if every else columns)]))
    frame = number_rows(lines, ["series"], LINE_ORDER, ts="l_shipdate", partitions=tasks_for(spark, lines.count()),
                        columns=None if every else ["l_extendedprice", "l_quantity", *columns])
    return frame.with_columns({"price": F.col("l_extendedprice"), "size": F.col("l_quantity")})


def scored(spark: SparkSession, sf_dir: str) -> SeriesFrame:
    """Hourly bars with a buy, a sell and a signed score."""
    frame = bars(spark, sf_dir)
    return frame.with_columns({
        "buy_score": F.col("high") / (F.col("high") + 40.0),
        "sell_score": F.lit(20.0) / (F.col("low") + 20.0),
    }).with_columns({"trade_score": combine("buy_score", "sell_score", "difference")})


def signalled(spark: SparkSession, sf_dir: str, buy: float = 0.25, sell: float = -0.15) -> SeriesFrame:
    """Scored bars with buy and sell flags."""
    from tidemark.operators.scores import threshold_rule

    b, s = threshold_rule("trade_score", buy, sell)
    return scored(spark, sf_dir).with_columns({"buy": b, "sell": s})


# -- the same inputs for the comparison queries ----------------------------------------------

EVENT_SQL = """
ev AS (SELECT event_type AS series, ts, event_id, value FROM events),
hourly AS (
  SELECT series, date_trunc('hour', ts) AS h, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
         min(value) AS low, last(value ORDER BY ts, event_id) AS close, sum(value) AS volume, count(value) AS trades
  FROM ev GROUP BY 1, 2),
grid AS (SELECT series, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS ts FROM hourly GROUP BY series),
bars AS (
  SELECT g.series, g.ts, CAST(epoch(g.ts) / 3600 AS BIGINT) AS pos, open, high, low, close, volume,
         coalesce(trades, 0) AS trades
  FROM grid g LEFT JOIN hourly x ON g.series = x.series AND g.ts = x.h)"""


def interpolate_sql(source: str, target: str, columns: list[str], keep: list[str]) -> str:
    """Linear interpolation by position, written with ordered window functions."""
    back = "OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    ahead = "OVER (PARTITION BY series ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"
    knots = ", ".join(
        f"last_value({c} IGNORE NULLS) {back} AS {c}_a, last_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {back} AS {c}_i, "
        f"first_value({c} IGNORE NULLS) {ahead} AS {c}_b, first_value(CASE WHEN {c} IS NOT NULL THEN pos END IGNORE NULLS) {ahead} AS {c}_j"
        for c in columns)
    values = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN {c} WHEN {c}_i IS NULL THEN NULL WHEN {c}_j IS NULL THEN {c}_a "
        f"ELSE {c}_a + ({c}_b - {c}_a) * (CAST(pos - {c}_i AS DOUBLE) / ({c}_j - {c}_i)) END AS {c}" for c in columns)
    return f"{target} AS (SELECT {', '.join(keep)}, {values} FROM (SELECT *, {knots} FROM {source}))"


FILLED_SQL = EVENT_SQL + ",\n" + interpolate_sql("bars", "filled", PRICES, ["series", "ts", "pos", "trades"])

TICKS_SQL = f"""
ticks AS (
  SELECT l_returnflag || l_linestatus AS series, l_extendedprice AS price, l_quantity AS size, l_discount, l_shipdate,
         row_number() OVER (PARTITION BY l_returnflag || l_linestatus ORDER BY {', '.join(LINE_ORDER)}) - 1 AS pos
  FROM lineitem)"""

SCORED_SQL = EVENT_SQL + """,
scored AS (
  SELECT *, buy_score - sell_score AS trade_score
  FROM (SELECT *, high / (high + 40.0) AS buy_score, 20.0 / (low + 20.0) AS sell_score FROM bars))"""

SIGNALLED_SQL = SCORED_SQL + """,
signalled AS (
  SELECT *, coalesce(trade_score >= 0.25, false) AS buy, coalesce(trade_score <= -0.15, false) AS sell FROM scored)"""
