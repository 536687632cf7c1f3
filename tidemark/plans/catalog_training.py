"""Catalogue: training, scoring, walk-forward, metrics, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.frame import checkpoint_dir, settle
from tidemark.operators import metrics as M
from tidemark.operators import models as ML
from tidemark.operators.rolling import future_aggregations, past_aggregations
from tidemark.operators.scores import threshold_rule
from tidemark.plans import inputs, stages
from tidemark.plans.catalog import register
from tidemark.plans.catalog_signals import LIVE_SQL
from tidemark.plans.catalog_windows import crossing_sql, rolled
from tidemark.plans.inputs import EVENT_SQL, FILLED_SQL, TICKS_SQL
from tidemark.streaming import bars as stream
from tidemark.streaming.stateful import BANDS, TRANSACTIONS, rocksdb_state, stream_band_changes, stream_transactions

# -- metrics ---------------------------------------------------------------------------------


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with a label and two scores of few distinct values (many ties)."""
    return inputs.table(spark, sf_dir, "lineitem").select(
        "l_linestatus", (F.col("l_returnflag") == "R").cast("int").alias("returned"),
        (F.col("l_discount") * 5 + F.col("l_tax") * 6).alias("returned_lc"), (F.col("l_quantity") / 50).alias("returned_gb"),
        (F.col("l_quantity") - 25).alias("y"), (F.col("l_extendedprice") / 2000 - 25).alias("y_hat"))


def metrics_sql(group: str) -> str:
    """Pairwise form of AUC (wins plus half the ties) and stepwise average precision over distinct scores."""
    return f"""
tied AS (SELECT {group}, y_hat, sum(y_true) AS p, count(*) - sum(y_true) AS n FROM long GROUP BY ALL),
cum AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn, sum(p) OVER (PARTITION BY {group}) AS tp, sum(n) OVER (PARTITION BY {group}) AS tn
  FROM tied WINDOW w AS (PARTITION BY {group} ORDER BY y_hat DESC)),
ranks AS (SELECT {group}, sum(n * (cp - p / 2.0)) / (max(tp) * max(tn)) AS auc, sum(p / tp * (CAST(cp AS DOUBLE) / (cp + cn))) AS ap FROM cum GROUP BY ALL),
hits AS (SELECT {group}, CAST(count(*) FILTER (y_true = 1 AND y_hat > 0.5) AS DOUBLE) AS tp, count(*) FILTER (y_true = 0 AND y_hat > 0.5) AS fp,
  count(*) FILTER (y_true = 1 AND y_hat <= 0.5) AS fn FROM long GROUP BY ALL)"""


METRIC = "auc:d ap:d f1:d precision:d recall:d"
METRIC_SELECT = """round(auc, 3) AS auc, round(ap, 3) AS ap, round(2 * tp / (2 * tp + fp + fn), 3) AS f1,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 3) AS "precision", round(tp / (tp + fn), 3) AS recall"""

register("classification_metrics", "l_linestatus:s " + METRIC,
         lambda s, d: M.classification_metrics(_graded(s, d), ["l_linestatus"], "returned", "returned_lc"),
         "long AS (SELECT l_linestatus, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true, l_discount * 5 + l_tax * 6 AS y_hat FROM lineitem),"
         + metrics_sql("l_linestatus"),
         f"SELECT r.l_linestatus, {METRIC_SELECT} FROM ranks r JOIN hits h ON r.l_linestatus = h.l_linestatus")

register("score_columns_metrics", "label:s algo:s " + METRIC,
         lambda s, d: M.score_columns_metrics(_graded(s, d), ["returned_lc", "returned_gb"]),
         """long AS (SELECT 'lc' AS algo, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true, l_discount * 5 + l_tax * 6 AS y_hat FROM lineitem
  UNION ALL SELECT 'gb', CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END, l_quantity / 50 FROM lineitem),""" + metrics_sql("algo"),
         f"SELECT 'returned' AS label, r.algo, {METRIC_SELECT} FROM ranks r JOIN hits h ON r.algo = h.algo")

register("regression_metrics", "l_linestatus:s mae:d mape:d r2:d " + METRIC,
         lambda s, d: M.regression_metrics(_graded(s, d), ["l_linestatus"], "y", "y_hat"),
         """g AS (SELECT l_linestatus, l_quantity - 25 AS y, l_extendedprice / 2000 - 25 AS p FROM lineitem),
long AS (SELECT l_linestatus, CASE WHEN y > 0 THEN 1 ELSE 0 END AS y_true, CASE WHEN p > 0 THEN 1 ELSE -1 END AS y_hat FROM g),"""
         + metrics_sql("l_linestatus").replace("y_hat > 0.5", "y_hat > 0").replace("y_hat <= 0.5", "y_hat <= 0")
         + """,
errors AS (SELECT l_linestatus, avg(abs(y - p)) AS mae, avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)) AS mape,
  1 - sum((y - p) * (y - p)) / (var_pop(y) * count(y)) AS r2 FROM g GROUP BY 1)""",
         f"""SELECT r.l_linestatus, round(mae, 3) AS mae, round(mape, 3) AS mape, round(r2, 3) AS r2, {METRIC_SELECT}
  FROM ranks r JOIN hits h ON r.l_linestatus = h.l_linestatus JOIN errors e ON e.l_linestatus = r.l_linestatus""")

# -- models ----------------------------------------------------------------------------------

ALGORITHMS = [
    {"name": "lc", "algo": "lc", "params": {"every_nth_row": 2}, "train": {"max_iter": 20, "reg": 0.01}},
    {"name": "gb", "algo": "gb", "params": {}, "train": {"max_depth": 3, "num_boost_round": 3}},
    {"name": "svc", "algo": "svc", "params": {}, "train": {"max_iter": 10}},
    {"name": "nn", "algo": "nn", "params": {"layers": [6]}, "train": {"n_epochs": 15}},
]


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    df, names = ML.embedding_features(inputs.table(spark, sf_dir, "embeddings"), "embedding", 64)
    # a missing input where the element is far out, to exercise the NULL rule
    df = df.withColumns({"e0": F.when(F.abs("e0") < 0.2, F.col("e0")), "low": (F.col("label") < 5).cast("int")})
    return df.drop("embedding"), names


def _trained(algorithm: str):
    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, features = _vectors(spark, sf_dir)
        specs = [a for a in ALGORITHMS if a["name"] == algorithm]
        models = ML.train_all(df.withColumn("all", F.lit(1)), features, ["low"], specs, ["all"], ["vec_id"])
        return ML.predict_all(df, features, ["low"], specs, models)[0]

    return build


for a in ALGORITHMS:
    register(f"train_and_score_{a['name']}", f"vec_id:b low:b low_{a['name']}:d", _trained(a["name"]))


def _null_rule(spark, sf_dir):
    df = _trained("lc")(spark, sf_dir)
    return df.select("vec_id", F.col("low_lc").isNull().alias("unscored"), F.col("low_lc").between(0, 1).alias("in_range"))


register("score_null_rule", "vec_id:b unscored:b in_range:b", _null_rule, None,
         """SELECT vec_id, NOT (abs(embedding[1]) < 0.2) AS unscored, CASE WHEN abs(embedding[1]) < 0.2 THEN 1 END AS in_range FROM embeddings""")


def _training_rows(spark, sf_dir):
    df, features = _vectors(spark, sf_dir)
    rows = ML.training_rows(df.withColumn("all", F.lit(1)), features, "low", ["all"], ["vec_id"], 3, 100)
    return rows.select("vec_id", "low")


register("training_rows", "vec_id:b low:b", _training_rows,
         """c AS (SELECT vec_id, label < 5 AS low, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM embeddings WHERE abs(embedding[1]) < 0.2),
t AS (SELECT * FROM c WHERE k % 3 = 0)""",
         "SELECT vec_id, low FROM t QUALIFY row_number() OVER (ORDER BY k DESC) <= 100")


def _reloaded(spark, sf_dir):
    df, features = _vectors(spark, sf_dir)
    specs = ALGORITHMS[:1]
    path = f"{checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
    models = ML.train_all(df.withColumn("all", F.lit(1)), features, ["low"], specs, ["all"], ["vec_id"])
    ML.save_models(models, path)
    again = ML.load_models(path, list(models))
    both = ML.predict_all(df, features, ["low"], specs, models)[0].withColumnRenamed("low_lc", "first")
    both = ML.predict_all(both, features, ["low"], specs, again)[0]
    return both.select("vec_id", F.col("first").eqNullSafe(F.col("low_lc")).alias("same"))


register("model_save_and_load", "vec_id:b same:b", _reloaded, None, "SELECT vec_id, 1 AS same FROM embeddings")


def _walk(spark, sf_dir):
    frame = inputs.filled(spark, sf_dir).derive([
        *past_aggregations("close", "mean", [6, 24]), *past_aggregations("close", "std", 24), *future_aggregations("high", "max", 6)])
    return frame.with_columns({"rise": (F.col("high_max_6") > F.col("close") * 2).cast("int")})


WALK_FEATURES = ["close_mean_6", "close_mean_24", "close_std_24"]


def _fold_counts(spark, sf_dir):
    rows = ML.fold_rows(inputs.ticks(spark, sf_dir), ML.SeriesFolds(4, 24, 2000))
    return rows.groupBy("series", "step", "role").agg(F.count(F.lit(1)).alias("n"), F.sum("price").alias("total"))


register("walk_forward_folds", "series:s step:b role:s n:b total:d", _fold_counts,
         TICKS_SQL + """,
size AS (SELECT series AS s, max(pos) + 1 AS n FROM ticks GROUP BY 1),
folds AS (SELECT s, k AS step, n * (k + 1) // 5 AS a, n * (k + 2) // 5 AS b, greatest(0, n * (k + 1) // 5 - 25) AS e FROM size, (SELECT unnest([0, 1, 2, 3]) AS k)),
r AS (SELECT s, step, 'train' AS role, greatest(0, e - 2000) AS lo, e AS hi FROM folds UNION ALL SELECT s, step, 'predict', a, b FROM folds)""",
         "SELECT series, step, role, count(*) AS n, sum(price) AS total FROM ticks JOIN r ON s = series AND pos >= lo AND pos < hi GROUP BY 1, 2, 3")

register("walk_forward", "series:s ts:b step:b rise:b rise_lc:d",
         lambda s, d: ML.walk_forward(_walk(s, d).settle(), WALK_FEATURES, ["rise"], [{"name": "lc", "algo": "lc", "train": {"max_iter": 10, "reg": 0.01}}], ML.SeriesFolds(3, 6))[0])


def _walk_coverage(spark, sf_dir):
    frame = _walk(spark, sf_dir).settle()
    scored, _ = ML.walk_forward(frame, WALK_FEATURES, ["rise"], [{"name": "gb", "algo": "gb", "train": {"max_depth": 2, "num_boost_round": 2}}], ML.SeriesFolds(3, 6))
    return scored.groupBy("series", "step").agg(F.min("row_no").alias("first_row"), F.max("row_no").alias("last_row"), F.count("rise_gb").alias("scored"))


register("walk_forward_coverage", "series:s step:b first_row:b last_row:b scored:b", _walk_coverage, EVENT_SQL + """,
r AS (SELECT series, row_number() OVER (PARTITION BY series ORDER BY pos) - 1 AS k FROM bars),
size AS (SELECT series AS s, max(k) + 1 AS n FROM r GROUP BY 1),
folds AS (SELECT s, step, n * (step + 1) // 4 AS a, n * (step + 2) // 4 AS b FROM size, (SELECT unnest([0, 1, 2]) AS step))""",
         "SELECT series, step, min(k) AS first_row, max(k) AS last_row, count(*) AS scored FROM r JOIN folds ON s = series AND k >= a AND k < b GROUP BY series, step")


def _fitted(spark, sf_dir):
    path = f"{checkpoint_dir(spark)}/models/{uuid.uuid4().hex}"
    bars = inputs.hourly(spark, sf_dir)
    ML.fit_statistic(bars.where("ts < timestamp'2024-01-16 00:00:00'"), "close", path, ["series"])
    return ML.deviation_from_fitted(bars, "close", path, "deviation", ["series"])


register("fitted_statistic", "series:s ts:b deviation:d", _fitted, EVENT_SQL + """,
m AS (SELECT series, avg(close) AS mean FROM hourly WHERE h < TIMESTAMP '2024-01-16' GROUP BY 1)""",
         "SELECT h1.series, epoch(h) AS ts, close - mean AS deviation FROM hourly h1 LEFT JOIN m ON m.series = h1.series")

# -- streams ---------------------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = inputs.table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.event_time(raw.withColumnRenamed("event_type", "series"))


def _finished(df: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a stream over what is there now and read its output back."""
    base = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    with rocksdb_state(spark):
        query = df.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option(
            "checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/out")


register("stream_tumbling_bars", "series:s ts:b open:d high:d low:d close:d trades:b",
         lambda s, d: _finished(stream.tumbling_bars(_event_stream(s, d), ["series"], "1h", "value", tie="event_id"), s), EVENT_SQL,
         """SELECT series, epoch(h) AS ts, open, high, low, close, trades FROM hourly
  WHERE epoch_ms(h) + 3600000 <= (SELECT epoch_ms(max(ts)) - 3600000 FROM events)""")

register("stream_repeats_removed", "series:s n:b",
         lambda s, d: _finished(stream.exact_repeats_removed(_event_stream(s, d).union(_event_stream(s, d)), ["event_id"]), s).groupBy(
             "series").agg(F.count(F.lit(1)).alias("n")), None,
         "SELECT event_type AS series, count(*) AS n FROM events GROUP BY 1")


def _bar_table(spark, sf_dir, late: bool):
    """History in batch, then a stream with the rest; late data changes bars that are stored already."""
    path = f"{checkpoint_dir(spark)}/tables/{uuid.uuid4().hex}"
    table = stream.BarTable(f"{path}/bars", ("series",), "1h", lookback=5,
                            derive=lambda f: f.derive(past_aggregations("close", "mean", 6)))
    bars = inputs.hourly(spark, sf_dir)
    first = bars.where("ts < timestamp'2024-01-20 00:00:00'")
    if late:
        first = first.withColumn("close", F.when(F.col("ts") >= F.lit("2024-01-18 00:00:00").cast("timestamp"), -1.0).otherwise(F.col("close")))
    table.backfill(first)
    rest = bars.where(F.col("ts") >= F.lit("2024-01-18 00:00:00" if late else "2024-01-20 00:00:00").cast("timestamp"))
    rest.withColumn("__d", F.floor(F.unix_micros("ts") / (4 * 86400 * 1000000))).repartitionByRange(2, "__d").drop("__d").write.parquet(f"{path}/in")
    source = stream.stream_table(spark, f"{path}/in", rest.schema)
    table.start(source, f"{path}/state").awaitTermination()
    return table.read(spark)


TABLE_SQL = EVENT_SQL + """,
r AS (SELECT series, ts, close, CASE WHEN count(close) OVER w >= 3 THEN avg(close) OVER w END AS close_mean_6 FROM bars
  WINDOW w AS (PARTITION BY series ORDER BY pos ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))"""
for late in (False, True):
    register("stream_late_data_overwrite" if late else "stream_bar_table", "series:s ts:b close:d close_mean_6:d",
             lambda s, d, late=late: _bar_table(s, d, late), TABLE_SQL, "SELECT series, epoch(ts) AS ts, close, close_mean_6 FROM r")


def _score_stream(spark, sf_dir, files_per_batch: int | None = None) -> DataFrame:
    """The scored bars in three files that follow each other in time."""
    path = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}/in"
    scored = settle(inputs.scored(spark, sf_dir).df.select("series", "ts", "close", "trade_score"))
    bounds = scored.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    for k in range(3 if bounds.a else 0):
        part = F.floor(3 * F.unix_micros("ts").cast("double") / 1e6 - 3 * bounds.a.timestamp()) / (bounds.b.timestamp() - bounds.a.timestamp() + 1)
        scored.where(F.floor(part) == k).coalesce(1).write.mode("append").parquet(path)
    return stream.stream_table(spark, path, scored.schema, files_per_batch)


def _stream_folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"


def _stream_transactions(spark, sf_dir, files_per_batch: int | None = None):
    df = _score_stream(spark, sf_dir, files_per_batch)
    buy, sell = threshold_rule("trade_score", 0.25, -0.15)
    return stream_transactions(df.withColumns({"buy": buy, "sell": sell}), "series", "buy", "sell", "close", _stream_folder(spark)).read(spark, TRANSACTIONS)


def _stream_bands(spark, sf_dir, files_per_batch: int | None = None):
    return stream_band_changes(_score_stream(spark, sf_dir, files_per_batch), "series", "trade_score", [0.2, 0.4], [-0.1, -0.25], _stream_folder(spark)).read(spark, BANDS)


# the history in one micro-batch, and one file at a time
for suffix, files in (("", None), ("_many_batches", 1)):
    register(f"stream_transactions{suffix}", "series:s ts:b price:d profit:d status:s",
             lambda s, d, files=files: _stream_transactions(s, d, files), LIVE_SQL,
             "SELECT series, epoch(ts) AS ts, close AS price, profit, side AS status FROM paid")
    register(f"stream_band_changes{suffix}", "series:s ts:b band:b band_up:b band_down:b",
             lambda s, d, files=files: _stream_bands(s, d, files),
             LIVE_SQL.split(",\nsig AS")[0] + """,
b AS (SELECT series, pos, ts, CASE WHEN trade_score >= 0.4 THEN 2 WHEN trade_score >= 0.2 THEN 1 WHEN trade_score < -0.25 THEN -2
  WHEN trade_score < -0.1 THEN -1 ELSE 0 END AS band FROM scored),
p AS (SELECT *, lag(band) OVER (PARTITION BY series ORDER BY pos) AS prev FROM b)""",
             """SELECT series, epoch(ts) AS ts, band, prev IS NULL OR abs(band) > abs(prev) AS band_up, prev IS NULL OR abs(band) < abs(prev) AS band_down
  FROM p WHERE prev IS NULL OR abs(band) <> abs(prev)""")


def _output_function(spark, sf_dir):
    """A custom output function on the rows of every micro-batch: here it logs the transactions."""
    path = f"{checkpoint_dir(spark)}/streams/{uuid.uuid4().hex}"
    source = _score_stream(spark, sf_dir)

    def log(batch: DataFrame, number: int) -> None:
        batch.groupBy("series").agg(F.count(F.lit(1)).alias("rows"), F.lit(number).cast("long").alias("batch")).write.mode("append").parquet(f"{path}/log")

    source.writeStream.foreachBatch(log).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/log").groupBy("series").agg(F.sum("rows").alias("rows"))


register("stream_output_function", "series:s rows:b", _output_function, EVENT_SQL, 'SELECT series, count(*) AS "rows" FROM bars GROUP BY 1')


# -- the whole chain -------------------------------------------------------------------------

CHAIN_FEATURES = [
    {"generator": "indicator", "config": {"columns": "close", "functions": ["SMA"], "windows": [4, 12], "interpolate": False,
                                          "parameters": {"rel_base": "next", "rel_func": "diff"}}},
    {"generator": "statistics", "config": {"columns": "close", "functions": ["std"], "windows": [12], "interpolate": False}}]
CHAIN_LABELS = [{"generator": "highlow2", "config": {"columns": ["close", "high", "low"], "function": "high", "thresholds": [80.0],
                                                     "tolerance": 0.5, "horizon": 12, "names": ["high_80"]}}]


def _chain(spark, sf_dir):
    frame, features = stages.feature_stage(inputs.filled(spark, sf_dir), CHAIN_FEATURES)
    frame, labels = stages.feature_stage(frame, CHAIN_LABELS)
    frame = stages.select_existing(frame, features, labels).settle()
    algorithms = [{"name": "lc", "algo": "lc", "train": {"max_iter": 10, "reg": 0.01}}]
    models = stages.training_stage(frame, features, labels, algorithms, label_horizon=12)
    frame, scores = stages.scoring_stage(frame, features, labels, algorithms, models)
    signals, _ = stages.feature_stage(frame, [{"generator": "threshold_rule", "config": {
        "columns": scores, "names": ["buy", "sell"], "parameters": {"buy_signal_threshold": 0.5, "sell_signal_threshold": 0.2}}}])
    return signals.df.withColumn("unscored", F.col(scores[0]).isNull())


register("stages_end_to_end", "series:s ts:b close_SMA_4:d close_SMA_12:d close_std_12:d high_80:b unscored:b", _chain,
         FILLED_SQL + f""",
c AS (SELECT series, ts, pos, {rolled('close', 'mean', 4, 4)} AS a, {rolled('close', 'mean', 12, 12)} AS b, {rolled('close', 'std', 12)} AS d,
  {crossing_sql('close', 'high', 80.0, 12)} AS x, {crossing_sql('close', 'low', -40.0, 12)} AS y FROM filled)""",
         """SELECT series, epoch(ts) AS ts, a - b AS close_SMA_4, b AS close_SMA_12, d AS close_std_12,
  x IS NOT NULL AND (y IS NULL OR x <= y) AS high_80, a - b IS NULL OR b IS NULL OR d IS NULL AS unscored FROM c""")
