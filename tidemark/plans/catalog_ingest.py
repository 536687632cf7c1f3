"""Catalogue: reading, resampling, merging, updating, row selection, scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.frame import checkpoint_dir
from tidemark.functions import intervals as I
from tidemark.functions import numeric as N
from tidemark.operators import resample, upsert
from tidemark.operators.raster import Source, merge_sources, on_raster
from tidemark.plans import inputs
from tidemark.plans.catalog import register
from tidemark.plans.inputs import EVENT_SQL, FILLED_SQL, SIGNALLED_SQL, TICKS_SQL
from tidemark.plans.stages import locate_row, time_or_offset
from tidemark.sources import bars as src
from tidemark.streaming.bars import longer_interval_starts, retained

BAR = "series:s ts:b open:d high:d low:d close:d volume:d trades:b"
EPOCH = "epoch(ts) AS ts"

register("hourly_bars", BAR, lambda s, d: inputs.bars(s, d).df, EVENT_SQL,
         f"SELECT * EXCLUDE (ts), {EPOCH} FROM bars")

register("interpolated_bars", BAR, lambda s, d: inputs.filled(s, d).df, FILLED_SQL,
         f"SELECT * EXCLUDE (ts), {EPOCH} FROM filled")


# -- resampling to a lower frequency ---------------------------------------------------------

def _resampled(spark, sf_dir):
    frame = inputs.signalled(spark, sf_dir)
    return resample.resample_ohlc(frame.df, "series", "6h", scores=["trade_score"], flags=["buy", "sell"]).df


RESAMPLE_SQL = SIGNALLED_SQL + """,
six AS (
  SELECT series, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS ts,
         first(open ORDER BY ts) FILTER (open IS NOT NULL) AS open, max(high) AS high, min(low) AS low,
         last(close ORDER BY ts) FILTER (close IS NOT NULL) AS close,
         CASE WHEN count(trade_score) = count(*) AND min(trade_score) > 0 THEN max(trade_score)
              WHEN count(trade_score) = count(*) AND max(trade_score) < 0 THEN min(trade_score)
              ELSE avg(trade_score) END AS trade_score,
         bool_or(buy) AS buy, bool_or(sell) AS sell
  FROM signalled GROUP BY 1, 2)"""

register("resample_bars", "series:s ts:b open:d high:d low:d close:d trade_score:d buy:b sell:b", _resampled,
         RESAMPLE_SQL, f"SELECT * EXCLUDE (ts), {EPOCH} FROM six")

register("resample_last_rows", "series:s ts:b open:d high:d low:d close:d",
         lambda s, d: resample.resample_ohlc(inputs.bars(s, d).df, "series", "1D", last_rows=10).df,
         EVENT_SQL + """,
day AS (
  SELECT series, date_trunc('day', ts) AS ts, first(open ORDER BY ts) FILTER (open IS NOT NULL) AS open, max(high) AS high,
         min(low) AS low, last(close ORDER BY ts) FILTER (close IS NOT NULL) AS close FROM bars GROUP BY 1, 2)""",
         f"SELECT * EXCLUDE (ts), {EPOCH} FROM day QUALIFY row_number() OVER (PARTITION BY series ORDER BY ts DESC) <= 10")

register("resample_sparse_raster", "series:s ts:b open:d close:d",
         lambda s, d: resample.resample_ohlc(inputs.hourly(s, d), "series", "30min").df,
         EVENT_SQL + """,
half AS (SELECT series, unnest(generate_series(min(h), max(h), INTERVAL 30 MINUTE)) AS ts FROM hourly GROUP BY series)""",
         f"SELECT half.series, {EPOCH}, open, close FROM half LEFT JOIN hourly ON half.series = hourly.series AND half.ts = h")


def _event_flags(spark, sf_dir):
    e = inputs.table(spark, sf_dir, "events").select(
        F.lit("all").alias("series"), F.col("ts").cast("timestamp").alias("ts"),
        (F.col("event_type") == "purchase").alias("buy_long"), (F.col("event_type") == "error").alias("sell_long"))
    return e.where("buy_long OR sell_long")


register("resample_transactions", "series:s ts:b buy_long:b sell_long:b",
         lambda s, d: resample.resample_flags(_event_flags(s, d), "series", "1h", ["buy_long", "sell_long"]).df,
         """f AS (SELECT date_trunc('hour', ts) AS h, bool_or(event_type = 'purchase') AS b, bool_or(event_type = 'error') AS s
  FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1),
g AS (SELECT unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS ts FROM f)""",
         f"SELECT 'all' AS series, {EPOCH}, coalesce(b, false) AS buy_long, coalesce(s, false) AS sell_long FROM g LEFT JOIN f ON ts = h")


def _bars_beside_transactions(spark, sf_dir):
    flags = _event_flags(spark, sf_dir).withColumn("series", F.when(F.col("buy_long"), "purchase").otherwise("error"))
    flags = resample.resample_flags(flags, "series", "1h", ["buy_long", "sell_long"]).df.drop("pos")
    return resample.bars_with_transactions(inputs.bars(spark, sf_dir).df, flags, "series")


register("bars_beside_transactions", "series:s ts:b close:d buy_long:b sell_long:b", _bars_beside_transactions,
         EVENT_SQL + """,
f AS (SELECT event_type AS series, date_trunc('hour', ts) AS h, bool_or(event_type = 'purchase') AS b, bool_or(event_type = 'error') AS s
  FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1, 2),
g AS (SELECT series, unnest(generate_series(min(h), max(h), INTERVAL 1 HOUR)) AS h FROM f GROUP BY series),
flags AS (SELECT g.series, g.h, coalesce(b, false) AS b, coalesce(s, false) AS s FROM g LEFT JOIN f ON g.h = f.h AND g.series = f.series)""",
         f"""SELECT bars.series, {EPOCH}, close, b AS buy_long, s AS sell_long
  FROM bars LEFT JOIN flags ON ts = flags.h AND bars.series = flags.series""")


# -- merging ---------------------------------------------------------------------------------

def _merged(spark, sf_dir):
    orders = inputs.daily_orders(spark, sf_dir).select("series", "ts", "close", "volume")
    lines = inputs.table(spark, sf_dir, "lineitem").join(
        inputs.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("series")),
        "l_orderkey").groupBy("series", F.col("l_shipdate").cast("timestamp").alias("ts")).agg(
            F.sum("l_quantity").alias("ship_quantity"), F.count(F.lit(1)).cast("double").alias("lines"))
    return merge_sources([Source(orders, "ord"), Source(lines, "ship")], "series", "ts", "1D", interpolate_gaps=True).df


MERGE_SQL = """
o AS (SELECT o_orderpriority AS series, o_orderdate AS ts, last(o_totalprice ORDER BY o_orderkey) AS ord_close,
        sum(o_totalprice) AS ord_volume FROM orders GROUP BY 1, 2),
l AS (SELECT o_orderpriority AS series, l_shipdate AS ts, sum(l_quantity) AS ship_quantity, CAST(count(*) AS DOUBLE) AS ship_lines
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
span AS (SELECT series, min(a) AS a, min(b) AS b FROM (
  SELECT series, min(ts) AS a, max(ts) AS b FROM o GROUP BY 1 UNION ALL SELECT series, min(ts), max(ts) FROM l GROUP BY 1) GROUP BY 1),
grid AS (SELECT series, unnest(generate_series(a, b, INTERVAL 1 DAY)) AS ts FROM span),
joined AS (SELECT g.series, g.ts, CAST(epoch(g.ts) / 86400 AS BIGINT) AS pos, ord_close, ord_volume, ship_quantity, ship_lines
  FROM grid g LEFT JOIN o ON o.series = g.series AND o.ts = g.ts LEFT JOIN l ON l.series = g.series AND l.ts = g.ts),
""" + inputs.interpolate_sql("joined", "smooth", ["ord_close", "ord_volume", "ship_quantity", "ship_lines"], ["series", "ts", "pos"])

register("merge_sources", "series:s ts:b ord_close:d ord_volume:d ship_quantity:d ship_lines:d", _merged, MERGE_SQL,
         f"SELECT * EXCLUDE (ts), {EPOCH} FROM smooth")


# -- reading, writing, updating --------------------------------------------------------------

def _stored(ext):
    def build(spark, sf_dir):
        # a throw-away copy in the shared checkpoint folder, read back by its extension
        path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}.{ext}"
        bars = inputs.hourly(spark, sf_dir)
        src.write_table(bars, path, partition_by=None if ext == "csv" else "series")
        return src.read_table(spark, path, bars.schema if ext == "csv" else None)

    return build


for ext in ("csv", "parquet"):
    register(f"write_and_read_{ext}", BAR, _stored(ext), EVENT_SQL,
             "SELECT series, epoch(h) AS ts, open, high, low, close, volume, trades FROM hourly")


def _append(spark, sf_dir, keep):
    rows = inputs.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series"), I.interval_start(F.col("ts").cast("timestamp"), "1h").alias("ts"),
        "event_id", "value")
    return keep(rows, ["series", "ts"], ["event_id"])


for name, keep, order in (("append_keep_last", src.keep_last, "DESC"), ("append_keep_first", src.keep_first, "ASC")):
    register(name, "series:s ts:b event_id:b value:d", lambda s, d, keep=keep: _append(s, d, keep), None,
             f"""SELECT event_type AS series, epoch(date_trunc('hour', ts)) AS ts, event_id, value FROM events
  QUALIFY row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY event_id {order}) = 1""")


def _appended_batches(spark, sf_dir):
    orders = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("series"), F.col("o_orderdate").alias("ts"), "o_orderkey", "o_totalprice", "o_orderstatus")
    old = src.keep_last(orders.where("o_orderstatus <> 'P'"), ["series", "ts"], ["o_orderkey"])
    new = src.keep_last(orders.where("o_orderstatus <> 'F'"), ["series", "ts"], ["o_orderkey"])
    return src.append_bars(old, new, ["series", "ts"])


register("append_batches", "series:b ts:b o_orderkey:b o_totalprice:d", _appended_batches,
         """one AS (SELECT o_custkey AS series, o_orderdate AS ts, o_orderkey, o_totalprice, 0 AS batch FROM orders WHERE o_orderstatus <> 'P'
  QUALIFY row_number() OVER (PARTITION BY series, ts ORDER BY o_orderkey DESC) = 1),
two AS (SELECT o_custkey AS series, o_orderdate AS ts, o_orderkey, o_totalprice, 1 AS batch FROM orders WHERE o_orderstatus <> 'F'
  QUALIFY row_number() OVER (PARTITION BY series, ts ORDER BY o_orderkey DESC) = 1)""",
         """SELECT series, epoch(ts) AS ts, o_orderkey, o_totalprice FROM (SELECT * FROM one UNION ALL SELECT * FROM two) u
  QUALIFY row_number() OVER (PARTITION BY series, u.ts ORDER BY batch DESC) = 1""")

register("drop_last_bar", "series:s ts:b close:d", lambda s, d: inputs.bars(s, d).drop_tail(1).df, EVENT_SQL,
         f"SELECT series, {EPOCH}, close FROM bars b WHERE b.ts < (SELECT max(ts) FROM bars x WHERE x.series = b.series)")

register("complete_bars", "series:s ts:b close:d",
         lambda s, d: src.complete_bars(inputs.hourly(s, d), F.lit("2024-01-20 10:30:00").cast("timestamp"), "1h"), EVENT_SQL,
         "SELECT series, epoch(h) AS ts, close FROM hourly WHERE h < TIMESTAMP '2024-01-20 10:00:00'")


def _raw_rows(spark, sf_dir):
    return inputs.hourly(spark, sf_dir).select(
        "series", (F.unix_micros("ts") / 1000).cast("long").cast("string").alias("timestamp"),
        F.col("open").cast("string").alias("open"), F.col("close").cast("string").alias("close"), F.col("trades").cast("string").alias("trades"))


def _epoch_rows(spark, sf_dir):
    typed = src.typed_bars(_raw_rows(spark, sf_dir).drop("series"))
    return typed.groupBy(F.to_date("timestamp").alias("ts")).agg(
        F.sum("open").alias("open"), F.sum("close").alias("close"), F.sum("trades").alias("trades"))


register("typed_epoch_rows", "ts:b open:d close:d trades:b", _epoch_rows, EVENT_SQL,
         "SELECT epoch(date_trunc('day', h)) AS ts, sum(open) AS open, sum(close) AS close, sum(trades) AS trades FROM hourly GROUP BY 1")
register("typed_epoch_bars", "series:s timestamp:b open:d close:d trades:b",
         lambda s, d: src.typed_bars(_raw_rows(s, d), keys=("series",)), EVENT_SQL,
         "SELECT series, epoch(h) AS timestamp, open, close, trades FROM hourly")


def _null_report(spark, sf_dir):
    frame = inputs.bars(spark, sf_dir)
    return src.null_report(frame.df, ["open", "high", "low", "close", "volume", "trades"])


register("null_report", "column_name:s nulls:b", _null_report, EVENT_SQL,
         """SELECT unnest(['open', 'high', 'low', 'close', 'volume', 'trades', 'any column']) AS column_name,
  unnest([count(*) - count(open), count(*) - count(high), count(*) - count(low), count(*) - count(close),
          count(*) - count(volume), count(*) - count(trades), count(*) - count(close)]) AS nulls FROM bars""")


def _two_versions(spark, sf_dir):
    bars = inputs.bars(spark, sf_dir).df
    old = bars.where("trades <> 2").select("series", "ts", "open", "close")
    new = bars.where("trades < 4").select("series", "ts", F.when(F.col("trades") > 1, F.col("close") + 1000).alias("close"), "trades")
    return old, new


VERSIONS_SQL = EVENT_SQL + """,
old AS (SELECT series, ts, open, close FROM bars WHERE trades <> 2),
new AS (SELECT series, ts, CASE WHEN trades > 1 THEN close + 1000 END AS close, trades FROM bars WHERE trades < 4)"""

register("combine_update", "series:s ts:b open:d close:d trades:b",
         lambda s, d: upsert.combine_update(*_two_versions(s, d), ["series", "ts"]), VERSIONS_SQL,
         """SELECT coalesce(n.series, o.series) AS series, epoch(coalesce(n.ts, o.ts)) AS ts, open, coalesce(n.close, o.close) AS close, trades
  FROM old o FULL JOIN new n ON o.series = n.series AND o.ts = n.ts""")


def _same_columns(spark, sf_dir):
    bars = inputs.bars(spark, sf_dir).df
    old = bars.where("trades <> 3").select("series", "ts", "close")
    new = bars.where("ts >= timestamp'2024-01-15 00:00:00' AND trades < 6").select("series", "ts", (F.col("close") * 2).alias("close"))
    return old, new


SAME_SQL = EVENT_SQL + """,
old AS (SELECT series, ts, close FROM bars WHERE trades <> 3),
new AS (SELECT series, ts, close * 2 AS close FROM bars WHERE ts >= TIMESTAMP '2024-01-15' AND trades < 6)"""

register("replace_from_first_new", "series:s ts:b close:d",
         lambda s, d: upsert.replace_from(*_same_columns(s, d), ["series"]), SAME_SQL,
         """SELECT series, epoch(ts) AS ts, close FROM (SELECT * FROM new UNION ALL SELECT o.* FROM old o
  WHERE o.ts < (SELECT min(ts) FROM new n WHERE n.series = o.series) OR NOT EXISTS (SELECT 1 FROM new n WHERE n.series = o.series)) u""")

register("replace_rows", "series:s ts:b close:d",
         lambda s, d: upsert.replace_rows(*_same_columns(s, d), ["series", "ts"]), SAME_SQL,
         """SELECT series, epoch(ts) AS ts, close FROM (SELECT * FROM new UNION ALL SELECT o.* FROM old o
  WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.series = o.series AND n.ts = o.ts)) u""")

register("overlap_check", "compared:b different:b",
         lambda s, d: upsert.overlap_mismatches(*_same_columns(s, d), ["series", "ts"], ["close"]), SAME_SQL,
         """SELECT count(*) AS compared, count(*) FILTER (NOT coalesce(abs(o.close - n.close) <= 1e-8 + 1e-5 * abs(n.close), false)) AS different
  FROM old o JOIN new n ON o.series = n.series AND o.ts = n.ts""")


def _transaction_log(spark, sf_dir):
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}.parquet"
    rows = inputs.table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
        F.col("o_totalprice").alias("price"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "BUY").otherwise("SELL").alias("status"))
    for status in ("BUY", "SELL"):
        src.append_transactions(rows.where(F.col("status") == status), path)
    log = src.read_transactions(spark, path).withColumn("order", F.struct("timestamp", "o_orderkey"))
    return src.last_row(log, ["series"], "order")


register("transaction_log_last", "series:s o_orderkey:b price:d status:s", _transaction_log, None,
         """SELECT o_orderpriority AS series, o_orderkey, o_totalprice AS price, CASE WHEN o_orderstatus = 'F' THEN 'BUY' ELSE 'SELL' END AS status
  FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")


def _report(spark, sf_dir):
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}.txt"
    counts = inputs.hourly(spark, sf_dir).groupBy("series").agg(F.count(F.lit(1)).alias("n")).orderBy("series")
    src.append_report(counts, path)
    src.append_report(counts, path)
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("times"))


register("append_report_lines", "value:s times:b", _report, EVENT_SQL,
         "SELECT series || ',' || count(*) AS value, 2 AS times FROM hourly GROUP BY series")


def _ranking(spark, sf_dir):
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}.csv"
    trades = inputs.hourly(spark, sf_dir).groupBy("series").agg(F.sum("trades").alias("trades"), F.count(F.lit(1)).alias("bars"))
    for _ in range(2):
        src.append_ranking(trades, path, [F.desc("trades"), F.asc("series")], 3)
    files = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n")).alias("place", "value"))
    return files.groupBy("place", "value").agg(F.count(F.lit(1)).alias("times"))


register("append_ranked_report", "place:b value:s times:b", _ranking, EVENT_SQL + """,
ranked AS (SELECT row_number() OVER (ORDER BY sum(trades) DESC, series) AS n, concat_ws(',', series, sum(trades)::BIGINT, count(*)) AS value FROM hourly GROUP BY series)""",
         """SELECT 0 AS place, 'series,trades,bars' AS value, 1 AS times
UNION ALL SELECT n AS place, value, 1 AS times FROM ranked WHERE n <= 3
UNION ALL SELECT n - 1 AS place, value, 1 AS times FROM ranked WHERE n <= 3""")


# -- row selection ---------------------------------------------------------------------------

POSITION = "series:s pos:b price:d"
register("tail_rows", POSITION, lambda s, d: inputs.ticks(s, d).tail(500).df, TICKS_SQL,
         "SELECT series, pos, price FROM ticks QUALIFY row_number() OVER (PARTITION BY series ORDER BY pos DESC) <= 500")
register("head_rows", POSITION, lambda s, d: inputs.ticks(s, d).drop_tail(60).df, TICKS_SQL,
         "SELECT series, pos, price FROM ticks QUALIFY row_number() OVER (PARTITION BY series ORDER BY pos DESC) > 60")
register("every_nth_row", POSITION, lambda s, d: inputs.ticks(s, d).every_nth(7), TICKS_SQL,
         "SELECT series, pos, price FROM ticks WHERE pos % 7 = 0")
register("range_by_time", "series:s ts:b close:d",
         lambda s, d: time_or_offset(inputs.bars(s, d), "2024-01-05 00:00:00", "2024-01-20 12:00:00").df,
         EVENT_SQL, f"SELECT series, {EPOCH}, close FROM bars b WHERE b.ts >= TIMESTAMP '2024-01-05' AND b.ts < TIMESTAMP '2024-01-20 12:00:00'")
register("range_by_row_offset", POSITION, lambda s, d: time_or_offset(inputs.ticks(s, d), 100, 100).df, TICKS_SQL,
         "SELECT series, pos, price FROM ticks t WHERE pos >= 100 AND pos < (SELECT count(*) FROM ticks x WHERE x.series = t.series) - 100")
register("drop_null_rows", "series:s ts:b close:d", lambda s, d: inputs.bars(s, d).df.dropna(subset=["close", "high"]),
         EVENT_SQL, f"SELECT series, {EPOCH}, close FROM bars WHERE close IS NOT NULL AND high IS NOT NULL")
register("finite_values", "series:s ts:b x:d y:d",
         lambda s, d: N.clean(inputs.bars(s, d).df.select(
             "series", "ts", (F.lit(1.0).cast("float").cast("double") * F.when(F.col("trades") == 0, F.lit(float("nan"))).otherwise(F.col("close"))).alias("x"),
             F.when(F.col("trades") > 3, F.lit(float("inf"))).otherwise(F.col("open")).alias("y"))),
         EVENT_SQL, f"SELECT series, {EPOCH}, close AS x, CASE WHEN trades > 3 THEN NULL ELSE open END AS y FROM bars")


register("locate_row", "series:s row_no:b", lambda s, d: locate_row(inputs.bars(s, d), "2024-01-10 05:00:00"), EVENT_SQL,
         """SELECT series, row_no FROM (SELECT series, ts, row_number() OVER (PARTITION BY series ORDER BY ts) - 1 AS row_no FROM bars)
  WHERE ts = TIMESTAMP '2024-01-10 05:00:00'""")

register("notnull_tail", "series:s tail_rows:b",
         lambda s, d: upsert.notnull_tail(inputs.bars(s, d).df, ["series"], "pos", ["open", "close"]), EVENT_SQL,
         """SELECT series, max(pos) - coalesce(max(pos) FILTER (open IS NULL OR close IS NULL), min(pos) - 1) AS tail_rows FROM bars GROUP BY 1""")

register("retained_rows", "series:s ts:b close:d",
         lambda s, d: retained(inputs.bars(s, d).df, ["series"], "1h", 96, slack=15),
         EVENT_SQL, f"SELECT series, {EPOCH}, close FROM bars b WHERE b.ts > (SELECT max(ts) FROM bars x WHERE x.series = b.series) - INTERVAL 96 HOUR")


# -- scalars ---------------------------------------------------------------------------------

def _decimals(spark, sf_dir):
    x = F.col("l_extendedprice") * (1 - F.col("l_discount")) / 7
    k = F.round(x, 9)
    return inputs.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        N.truncate_decimal(k).cast("string").alias("whole"), N.round_text(k, 4).alias("rounded"), N.round_down_text(-k, 6).alias("down"))


register("decimal_text", "l_orderkey:b l_linenumber:b l_partkey:b whole:s rounded:s down:s", _decimals,
         """d AS (SELECT l_orderkey, l_linenumber, l_partkey,
  CAST(CAST(round(l_extendedprice * (1 - l_discount) / 7, 9) AS VARCHAR) AS DECIMAL(38,18)) AS k FROM lineitem)""",
         """SELECT l_orderkey, l_linenumber, l_partkey, left(CAST(k AS VARCHAR), length(CAST(k AS VARCHAR)) - 10) AS whole,
  CAST(CAST(k AS DECIMAL(38,4)) AS VARCHAR) AS rounded, left(CAST(-k AS VARCHAR), length(CAST(-k AS VARCHAR)) - 12) AS down FROM d""")


def _prices_text(spark, sf_dir):
    from tidemark.operators.trades import order_price, order_quantity

    o = inputs.table(spark, sf_dir, "orders").withColumn("side", F.when(F.col("o_orderstatus") == "F", "BUY").otherwise("SELL"))
    o = o.withColumn("price", order_price(F.col("o_totalprice"), F.col("side"), 0.005))
    return o.withColumn("quantity", order_quantity(F.lit(1000000.0), 50.0, F.col("price")))


register("order_sizing", "o_orderkey:b side:s price:s quantity:s", _prices_text,
         """p AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'BUY' ELSE 'SELL' END AS side,
  CAST(CAST(CAST(o_totalprice * CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE - 0.005::DOUBLE ELSE 1.0::DOUBLE + 0.005::DOUBLE END AS VARCHAR) AS DECIMAL(38,18)) AS DECIMAL(38,2)) AS price FROM orders)""",
         "SELECT o_orderkey, side, CAST(price AS VARCHAR) AS price, printf('%.6f', floor(500000000000.0 / CAST(price AS DOUBLE)) / 1000000.0) AS quantity FROM p")


def _intervals(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    now = F.lit("2024-02-01 00:10:00").cast("timestamp")
    return inputs.table(spark, sf_dir, "events").select(
        "event_id", I.interval_start(ts, "15min").alias("start"), I.interval_end(ts, "4h").alias("end"),
        I.close_time(I.interval_start(ts, "1B"), "1B").alias("day_end"), I.intervals_since(ts, now, "1h").alias("missing"),
        I.start_for_intervals(I.interval_start(ts, "1h"), 24, "1h").alias("back"),
        I.starts_longer_interval(ts, "1h", "4h").alias("opens_longer"))


register("interval_arithmetic", "event_id:b start:b end:b day_end:b missing:b back:b opens_longer:b", _intervals, None,
         """SELECT event_id, epoch(time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01')) AS "start",
  epoch(time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01')) + 4 * 3600 AS "end",
  epoch(date_trunc('day', ts)) + 86400 AS day_end,
  floor((1706746200000000 - epoch_us(ts)) / 3600000000.0) + 2 AS missing, epoch(date_trunc('hour', ts)) - 25 * 3600 AS back,
  CASE WHEN hour(ts) % 4 = 0 THEN 1 ELSE 0 END AS opens_longer FROM events""")

register("interval_gate", "series:s ts:b close:d",
         lambda s, d: longer_interval_starts(inputs.bars(s, d).df, "1h", "4h"), EVENT_SQL,
         f"SELECT series, {EPOCH}, close FROM bars b WHERE hour(b.ts) % 4 = 0")

register("last_bars", "series:s last_ts:b missing:b",
         lambda s, d: inputs.hourly(s, d).groupBy("series").agg(F.max("ts").alias("last_ts")).withColumn(
             "missing", I.intervals_since(F.col("last_ts"), F.lit("2024-02-01 00:10:00").cast("timestamp"), "1h")), EVENT_SQL,
         """SELECT series, epoch(max(h)) AS last_ts, floor((1706746200 - epoch(max(h))) / 3600) + 2 AS missing FROM hourly GROUP BY 1""")


def _on_raster(spark, sf_dir):
    frame = on_raster(inputs.bars(spark, sf_dir).df.drop("pos"), "series", "ts", "1h")
    return frame.running({"trades_so_far": F.col("trades")}).df


register("running_totals", "series:s ts:b trades_so_far:b", _on_raster, EVENT_SQL,
         f"SELECT series, {EPOCH}, sum(trades) OVER (PARTITION BY series ORDER BY pos) AS trades_so_far FROM bars")
