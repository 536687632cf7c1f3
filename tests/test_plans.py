"""Specs, sources, merging, models and streams."""

import os
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from conftest import random_walk
from pyspark.sql import functions as F

from tidemark.operators import models as ML
from tidemark.operators.raster import Source, densify, merge_sources, positions
from tidemark.operators.rolling import past_aggregations
from tidemark.operators.scores import score_band
from tidemark.plans.specs import GENERATORS, apply_specs
from tidemark.sources import bars as src
from tidemark.streaming import bars as stream
from tidemark.streaming.stateful import BANDS, TRANSACTIONS, stream_band_changes, stream_transactions


def hourly(spark, rows, columns="x double"):
    df = spark.createDataFrame([(s, h, *v) for s, h, *v in rows], f"series string, h long, {columns}")
    return df.withColumn("ts", F.timestamp_seconds(F.col("h") * 3600)).drop("h")


def test_merge_sources(spark):
    a = hourly(spark, [("s", 0, 1.0), ("s", 1, 2.0), ("s", 4, 5.0)])
    b = hourly(spark, [("s", 1, 10.0), ("s", 3, 30.0)], "b_x double")
    out = merge_sources([Source(a, "a"), Source(b, "b")], "series", "ts", "1h", interpolate_gaps=True).df.orderBy("ts").collect()
    assert [r.a_x for r in out] == [1.0, 2.0, 3.0, 4.0] or [r.a_x for r in out] == [1.0, 2.0, 2.0, 2.0]
    assert [r.b_x for r in out] == [None, 10.0, 20.0, 30.0]
    assert len(out) == 4


def test_positions_in_steps(spark):
    bounds = spark.createDataFrame([("a", -7, 60), ("b", 3, 3)], "series string, first_pos long, last_pos long")
    got = positions(bounds, ["series"], bucket_rows=8)
    assert sorted(r.pos for r in got.where("series = 'a'").collect()) == list(range(-7, 61))
    assert [r.pos for r in got.where("series = 'b'").collect()] == [3]


def test_prefixes_and_replacement(make_frame, column_of):
    x = random_walk(40, 1)
    f = make_frame({"a": {"btc_close": x, "eth_close": x * 2, "other": x}})
    specs = [{"generator": "indicator", "column_prefix": "btc", "feature_prefix": "f", "config": {
        "columns": "close", "functions": ["SMA"], "windows": [3]}},
        {"generator": "constant", "config": {"columns": "f_close_SMA_3", "function": "mul", "parameter": 2, "names": "other"}}]
    out, names = apply_specs(f, specs)
    assert names == ["f_close_SMA_3", "other"]
    sma = pd.Series(x).rolling(3).mean()
    np.testing.assert_allclose(column_of(out, "f_close_SMA_3"), sma)
    np.testing.assert_allclose(column_of(out, "other"), sma * 2)
    assert set(out.df.columns) == {"series", "ts", "pos", "btc_close", "eth_close", "f_close_SMA_3", "other"}
    own = {"generator": lambda frame, config: (frame.with_columns({"y": F.col("other") + config["k"]}), ["y"]), "config": {"k": 1}}
    np.testing.assert_allclose(column_of(apply_specs(f, [own])[0], "y"), x + 1)
    with pytest.raises(ValueError):
        apply_specs(f, [{"generator": "nothing"}])


def test_every_generator_runs(make_frame):
    n = 90
    c = np.abs(random_walk(n, 2))
    rng = np.random.default_rng(0)
    data = {"close": c, "high": c + 1, "low": c - 1, "volume": rng.uniform(1, 9, n), "trades": rng.uniform(1, 9, n),
            "tb_base_av": rng.uniform(1, 9, n), "up": rng.random(n), "down": rng.random(n)}
    data.update({k: rng.random(n) for k in ("gap", *[f"{s}_{i}" for s in ("bids", "asks") for i in (1, 2, 5, 10, 20)])})
    f = make_frame({"a": data}, bucket_rows=32)
    thresholds = {"buy_signal_threshold": 0.5, "sell_signal_threshold": -0.5, "buy_signal_threshold_2": 0.5, "sell_signal_threshold_2": -0.5}
    configs = {
        "market": {"windows": [3], "base_window": 9}, "depth": {}, "shape": {"columns": "close", "windows": [8]},
        "statistics": {"columns": ["close"], "functions": ["scipy_skew", "mean"], "windows": [8]},
        "indicator": {"columns": ["close"], "functions": ["SMA", "RSI"], "windows": [5]},
        "highlow": {"horizon": 5}, "highlow2": {"columns": ["close", "high", "low"], "function": "high", "thresholds": [1.0],
                                                "tolerance": 0.2, "horizon": 9, "names": ["h1"]},
        "topbot2": {"columns": "close", "function": "bot", "level": 0.02, "tolerances": [0.1], "names": ["b1"]},
        "topbot": {"columns": "close"}, "smoothen": {"columns": ["up", "down"], "names": "sm", "window": 3},
        "combine": {"columns": ["up", "down"], "names": "tr", "combine": "difference"},
        "threshold_rule": {"columns": "up", "names": ["b", "s"], "parameters": thresholds},
        "threshold_rule2": {"columns": ["up", "down"], "names": ["b", "s"], "parameters": thresholds},
        "constant": {"columns": "up", "function": "add", "parameter": 1},
    }
    assert set(configs) == set(GENERATORS)
    for name, config in configs.items():
        out, names = GENERATORS[name](f, config)
        assert names and set(names) <= set(out.df.columns), name
        assert out.df.select(*names).count() == n, name


def test_tables(spark, tmp_path):
    df = hourly(spark, [("s", 0, 1.25), ("s", 1, None), ("t", 0, 1 / 3)])
    for ext in ("csv", "parquet"):
        path = str(tmp_path / f"x.{ext}")
        src.write_table(df, path)
        back = {(r.series, r.ts): r.x for r in src.read_table(spark, path, df.schema).collect()}
        want = {(r.series, r.ts): r.x for r in df.collect()}
        assert back.keys() == want.keys()
        for k, v in want.items():
            assert back[k] == (v if v is None else pytest.approx(v, abs=1e-6))
    with pytest.raises(ValueError):
        src.read_table(spark, "x.json")


def test_ranking_keeps_its_order_and_one_header(spark, tmp_path):
    path = str(tmp_path / "ranking")
    rows = spark.createDataFrame([("a", 1.5), ("b", None), ("c", 9.0), ("d, e", 1.5)], "name string, score double").repartition(4)
    order = [F.desc_nulls_last("score"), F.asc("name")]
    for part in (rows, rows, rows.where("score > 100")):
        src.append_ranking(part, path, order, 3)
    files = sorted(r.value.rstrip("\n") for r in spark.read.text(path, wholetext=True).collect() if r.value)
    lines = 'c,9.0\na,1.5\n"d, e",1.5'
    assert files == sorted([f"name,score\n{lines}", lines])


def test_daily_vendor_bars(spark):
    df = spark.createDataFrame([("2024-01-02", 1.0)], "Date string, Close double").withColumn("Date", F.to_date("Date"))
    row = src.daily_vendor_bars(df).first()
    assert str(row.timestamp) == "2024-01-02 00:00:00" and row.close == 1.0


def test_folds():
    folds = ML.resolve_folds(100, 5, start=60, size=10, train_length=30)
    assert [(f.train_start, f.train_end, f.predict_start, f.predict_end) for f in folds][0] == (24, 54, 60, 70)
    assert len(folds) == 4 and ML.resolve_folds(100, 5, size=10, steps=4) == ML.resolve_folds(100, 5, start=60, steps=4)
    with pytest.raises(ValueError):
        ML.resolve_folds(100, 5, start=60)
    with pytest.raises(ValueError):
        ML.resolve_folds(100, 5, start=90, size=10, steps=4)


def test_every_series_is_walked_over_its_own_length(make_frame, monkeypatch):
    """As the query walk_forward calls it: series of 400, 37 and 2 rows."""
    from tidemark.plans import catalog_training as C
    from tidemark.plans.catalog import CATALOGUE

    rng = np.random.default_rng(5)
    sizes = {"a": 400, "b": 37, "c": 2}
    data = {k: {c: rng.normal(size=n) for c in C.WALK_FEATURES} | {"rise": rng.integers(0, 2, n).astype(int)} for k, n in sizes.items()}
    frame, trained = make_frame(data), []
    monkeypatch.setattr(C, "_walk", lambda spark, sf_dir: frame)
    train_all = ML.train_all
    monkeypatch.setattr(ML, "train_all", lambda df, *rest: trained.append(Counter(r.series for r in df.collect())) or train_all(df, *rest))
    rows = CATALOGUE["walk_forward"].build(None, None).collect()
    got = {(r.series, int(r.ts) // 3600 - 5): r.step for r in rows}
    assert len(got) == len(rows)
    assert got == {(k, i): step for k, n in sizes.items() for step in range(3) for i in range(n * (step + 1) // 4, n * (step + 2) // 4)}
    known = [{k: max(0, n * (step + 1) // 4 - 7) for k, n in sizes.items()} for step in range(3)]
    assert sorted(map(dict, trained), key=lambda x: x["a"]) == [{k: v for k, v in x.items() if v} for x in known]


@pytest.mark.parametrize("algo", ["lc", "gb", "svc", "nn"])
def test_rows_with_nulls_keep_their_place(spark, algo):
    train = spark.createDataFrame([(float(x), float(x * 2), y) for x, y in zip([1, 2, 3, 2, 1], [0, 1, 0, 1, 0])] * 4, "x double, z double, y int")
    a = ML.Algorithm(algo, algo, {"layers": [3]} if algo == "nn" else {}, {"max_iter": 5, "n_epochs": 5, "num_boost_round": 2, "max_depth": 2})
    model = ML.fit(train, ["x", "z"], "y", a)
    test = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (None, 1.0), (2.0, 3.0), (None, 2.0)], "x double, z double")
    rows = ML.score(test, model, ["x", "z"], a, "y_hat").collect()
    assert len(rows) == 5 and sum(r.y_hat is None for r in rows) == 2
    assert [r.x for r in rows if r.y_hat is None] == [None, None]


def test_separable_classes_are_learned(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"x": rng.normal(size=300), "z": rng.normal(size=300)})
    pdf["y"] = (pdf.x + pdf.z > 0).astype(int)
    df = spark.createDataFrame(pdf)
    a = ML.Algorithm("lc", "lc", {}, {"max_iter": 50, "C": 10.0, "class_weight": "balanced"})
    out = ML.score(df, ML.fit(df, ["x", "z"], "y", a), ["x", "z"], a, "p").toPandas()
    assert ((out.p > 0.5) == (out.y == 1)).mean() > 0.95


def test_stream_equals_batch(spark, tmp_path):
    n = 200
    x = random_walk(n, 4)
    rows = [(s, h, float(v)) for s in ("a", "b") for h, v in enumerate(x)]
    df = hourly(spark, rows, "close double")
    table = stream.BarTable(str(tmp_path / "bars"), ("series",), "1h", lookback=9,
                            derive=lambda f: f.derive(past_aggregations("close", "mean", [4, 10])))
    stale = df.where("ts < timestamp'1970-01-04 00:00:00'").withColumn(
        "close", F.when(F.col("ts") >= F.lit("1970-01-03").cast("timestamp"), F.lit(0.0)).otherwise(F.col("close")))
    table.backfill(stale)
    table.upsert(df.where("ts >= timestamp'1970-01-03 00:00:00' AND ts < timestamp'1970-01-06 05:00:00'"))
    table.upsert(df.where("ts >= timestamp'1970-01-06 03:00:00'"))
    table.upsert(df.where("ts >= timestamp'1970-01-06 03:00:00'"))  # repeated batch
    want = densify(df, "series", "ts", "1h").derive(past_aggregations("close", "mean", [4, 10])).df.drop("pos")
    got = table.read(spark).select(*want.columns)
    a, b = (d.orderBy("series", "ts").toPandas() for d in (got, want))
    pd.testing.assert_frame_equal(a, b)
    last = {r.series: r.missing for r in table.last_bars(spark, F.lit("1970-01-09 12:00:00").cast("timestamp")).collect()}
    assert last == {"a": 7, "b": 7}
    assert stream.BarTable(table.path, ("series",), "1h", retain_rows=24).hot(spark).count() == 48


def test_folds_over_each_series(make_frame):
    """Series of unequal length are each walked to their end; every row after the first part is predicted once."""
    frame = make_frame({s: {"x": np.arange(float(n))} for s, n in (("a", 100), ("b", 13), ("c", 3))})
    rows = ML.fold_rows(frame, ML.SeriesFolds(4, 2, 10)).toPandas()
    for s, n in (("a", 100), ("b", 13), ("c", 3)):
        mine = rows[rows.series == s]
        predicted = mine[mine.role == "predict"]
        assert sorted(predicted.row_no) == list(range(n // 5, n))
        for k, part in mine.groupby("step"):
            cut = n * (k + 1) // 5
            assert sorted(part[part.role == "predict"].row_no) == list(range(cut, n * (k + 2) // 5))
            assert sorted(part[part.role == "train"].row_no) == list(range(max(0, cut - 3 - 10), max(0, cut - 3)))


@pytest.mark.parametrize("files_per_batch", [1, None])
def test_stateful_streams(spark, tmp_path, files_per_batch):
    """One row per series goes from micro-batch to micro-batch, whatever these hold; a repeated one replaces its results."""
    n = 60
    rng = np.random.default_rng(3)
    rows = [(s, h, float(v), float(p)) for s in ("a", "b") for h, (v, p) in enumerate(zip(rng.uniform(-1, 1, n), rng.uniform(5, 9, n)))]
    df = hourly(spark, rows, "score double, price double")
    for k in range(3):
        df.where(F.floor(F.unix_seconds("ts") / 3600 / 20) == k).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    files = stream.stream_table(spark, str(tmp_path / "in"), df.schema, files_per_batch)
    signals = files.withColumns({"buy": F.col("score") > 0.3, "sell": F.col("score") < -0.3})
    t = stream_transactions(signals, "series", "buy", "sell", "price", str(tmp_path / "t"))
    b = stream_band_changes(files, "series", "score", [0.3, 0.6], [-0.3], str(tmp_path / "b"))
    got = {"t": t.read(spark, TRANSACTIONS).orderBy("series", "ts").collect(), "b": b.read(spark, BANDS).orderBy("series", "ts").collect()}
    for r, before in zip(got["t"][1:], got["t"]):
        if r.series == before.series:
            assert r.profit == pytest.approx((before.price - r.price) * (1 if r.status == "BUY" else -1))
    # the last micro-batch once more
    number = 2 if files_per_batch else 0
    last = df.where(F.floor(F.unix_seconds("ts") / 3600 / 20) == 2) if files_per_batch else df
    again = last.select("series", "ts", F.col("score").alias("score"), score_band(F.col("score"), [0.3, 0.6], [-0.3]).cast("int").alias("band"))
    b.handle(again, number)
    assert b.read(spark, BANDS).orderBy("series", "ts").collect() == got["b"]
    # nothing new, nothing changes
    stream_transactions(signals, "series", "buy", "sell", "price", str(tmp_path / "t"))
    assert t.read(spark, TRANSACTIONS).count() == len(got["t"])
    for s in ("a", "b"):
        mine, last = [r for r in rows if r[0] == s], None
        want = []
        for _, h, v, p in mine:
            side = "BUY" if v > 0.3 else "SELL" if v < -0.3 else None
            if side and side != last:
                want.append(side)
                last = side
        assert [r.status for r in got["t"] if r.series == s] == want
        bands = [2 if v >= 0.6 else 1 if v >= 0.3 else -1 if v < -0.3 else 0 for _, _, v, _ in mine]
        changed = [b for i, b in enumerate(bands) if i == 0 or abs(b) != abs(bands[i - 1])]
        assert [r.band for r in got["b"] if r.series == s] == changed


# -- the bar table against its batch form ----------------------------------------------------


def _bar_rows(spark, rows):
    return spark.createDataFrame([(s, h, v, n) for n, (s, h, v) in enumerate(rows)], "series string, h long, close double, n long").selectExpr(
        "series", "timestamp_seconds(1704067200 + h * 3600) AS ts", "close", "n")


def _bar_table(spark, tmp_path, batches, **options):
    from tidemark.operators.rolling import past_aggregations
    from tidemark.streaming.bars import BarTable

    table = BarTable(f"{tmp_path}/bars", ("series",), "1h", lookback=3, derive=lambda f: f.derive(past_aggregations("close", "mean", 4)), arrival="n", **options)
    for rows in batches:
        table.upsert(_bar_rows(spark, rows))
    last = {}
    for rows in batches:
        for s, h, v in rows:
            last[s, h] = v
    want = {}
    for name in {s for s, _ in last}:
        hours = [h for s, h in last if s == name]
        for h in range(min(hours), max(hours) + 1):
            known = [last[name, k] for k in range(h - 3, h + 1) if last.get((name, k)) is not None]
            want[name, h] = (last.get((name, h)), sum(known) / len(known) if len(known) >= 2 else None)
    got = [(r.series, r.h, r.close, r.close_mean_4) for r in table.read(spark).selectExpr("*", "(unix_seconds(ts) - 1704067200) div 3600 AS h").collect()]
    return got, want


def _assert_same(got, want):
    assert len(got) == len(want)
    for s, h, close, mean in got:
        assert (close, mean) == (want[s, h][0], None if want[s, h][1] is None else pytest.approx(want[s, h][1]))


def test_bar_table_repeated_key_in_batch(spark, tmp_path):
    batches = [[("a", h, 10.0 + h) for h in range(6)] + [("a", 2, 99.0)], [("a", 6, 1.0), ("a", 6, 2.0), ("a", 3, 5.0), ("a", 3, 7.0)]]
    _assert_same(*_bar_table(spark, tmp_path, batches))


def test_bar_table_gap_and_late_rows(spark, tmp_path):
    batches = [[(s, h, 1.0 * h) for s in "ab" for h in range(11)], [("a", 100, 5.0), ("b", 4, -3.0)], [("a", 50, 8.0), ("c", 7, 1.0), (None, 1, 2.0)], [("a", 101, 6.0), ("a", 1, 4.0), (None, 3, 4.0)]]
    _assert_same(*_bar_table(spark, tmp_path, batches))


def test_bar_table_is_trimmed(spark, tmp_path):
    batches = [[("a", h, 1.0 * h) for h in range(60)], [("a", 60, 1.0), ("b", 59, 2.0)], [("b", 61, 2.0)]]
    got, want = _bar_table(spark, tmp_path, batches, retain_rows=10)
    assert sorted((s, h) for s, h, *_ in got) == [("a", h) for h in range(51, 61)] + [("b", 59), ("b", 60), ("b", 61)]
    assert not list((tmp_path / "bars").glob("day=2024-01-01"))
    _assert_same(got, {k: v for k, v in want.items() if k in {(s, h) for s, h, *_ in got}})


def test_settled_rows_need_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from tidemark import frame

    class Cluster:
        conf = SimpleNamespace(get=lambda name, default=None: default)
        sparkContext = SimpleNamespace(applicationId="cluster-1", master="spark://host:7077", getCheckpointDir=lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        frame.checkpoint_dir(Cluster())
    kept = frame.settle(spark.range(5).toDF("x"))
    frame.release(kept)
    assert not any(os.path.exists(f.removeprefix("file:")) for f in kept.inputFiles())


def test_depth_bins_below_the_first_level(spark):
    from tidemark.operators.depth import depth_bins

    ladder = spark.createDataFrame([("s", 5.0, 2.0), ("s", 6.0, 4.0)], "snap string, price double, volume double")
    got = {r.bin: r.volume for r in depth_bins(ladder, ["snap"], 2.0, 0.0).collect()}
    assert got == {0: 0.0, 1: 0.0, 2: 1.0, 3: 4.0}


def test_quantile_of_one_tie(spark):
    from tidemark.operators.trades import exact_quantile

    rows = [("a", 1.0)] * 40 + [("b", float(x)) for x in (4, 1, 3, 2)] + [(None, 2.0), (None, None)]
    got = {r.k: r.m for r in exact_quantile(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", 0.5, "m").collect()}
    assert got == {"a": 1.0, "b": 2.5, None: 2.0}


def test_models_that_only_classify_refuse_regression():
    from tidemark.operators import models

    for algo in ("lc", "svc", "nn"):
        with pytest.raises(ValueError, match="classifies"):
            models._estimator(models.Algorithm(algo, algo, {"is_regression": True}, {}), 3, "f", 10)
    with pytest.raises(ValueError):
        models.resolve_folds(100, 5, 10, None, None)
    assert [f.predict_start for f in models.resolve_folds(100, 5, None, 20, 3)] == [40, 60, 80]
