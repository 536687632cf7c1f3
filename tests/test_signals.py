"""Scores, transactions, metrics, depth and updates against plain Python, with short buckets."""

import itertools

import numpy as np
import pandas as pd
import pytest
from conftest import random_walk
from pyspark.sql import functions as F

from tidemark.frame import SeriesFrame
from tidemark.functions import numeric as N
from tidemark.operators import metrics as M
from tidemark.operators import scores as S
from tidemark.operators import trades as T
from tidemark.operators import models as ML
from tidemark.operators import upsert as U
from tidemark.operators.depth import depth_bins


def walk_signals(buy, sell, price):
    events, seeking = [], True
    for i, (b, s, p) in enumerate(zip(buy, sell, price)):
        if not p or np.isnan(p):
            continue
        if seeking and b:
            events.append((i, "BUY"))
            seeking = False
        elif not seeking and s:
            events.append((i, "SELL"))
            seeking = True
    return events


@pytest.mark.parametrize("density,group", [(0.5, 8192), (0.15, 8192), (0.3, 3), (0.03, 2)])
def test_alternating_transactions(make_frame, monkeypatch, density, group):
    import tidemark.frame as base

    monkeypatch.setattr(base, "GROUP_BUCKETS", group)
    data, want = {}, {}
    for k in range(12):
        rng = np.random.default_rng(100 * k + int(density * 100))
        n = int(rng.integers(1, 90))
        buy, sell = rng.random(n) < density, rng.random(n) < density
        price = np.round(rng.uniform(1, 9, n), 2)
        price[rng.random(n) < 0.1] = np.nan
        price[rng.random(n) < 0.05] = 0.0
        data[f"s{k}"] = {"buy": buy, "sell": sell, "price": price}
        want[f"s{k}"] = [(i + 5, side) for i, side in walk_signals(buy, sell, price)]
    out = T.alternating_transactions(make_frame(data, bucket_rows=4), "buy", "sell", "price").df.collect()
    for name, events in want.items():
        assert sorted((r.pos, r.side) for r in out if r.series == name) == events


@pytest.fixture
def signalled(make_frame):
    rng = np.random.default_rng(5)
    n = 200
    data = {"buy": rng.random(n) < 0.2, "sell": rng.random(n) < 0.2, "price": np.round(rng.uniform(50, 99, n), 2)}
    return make_frame({"a": data}, bucket_rows=16), data


def test_profits_and_performance(signalled):
    frame, d = signalled
    events = T.alternating_transactions(frame, "buy", "sell", "price").settle()
    rows = T.transaction_profits(events, "price").df.orderBy("pos").collect()
    last, totals = {}, {"BUY": [], "SELL": []}
    for r, (i, side) in zip(rows, walk_signals(d["buy"], d["sell"], d["price"])):
        p, before = d["price"][i], last.get(side, 0.0)
        profit = 0.0 if not before else (before - p if side == "BUY" else p - before)
        assert (r.pos, r.side) == (i + 5, side)
        assert r.profit == pytest.approx(profit) and r.profit_percent == pytest.approx(100 * profit / before if before else 0.0)
        last[side] = p
        totals[side].append((profit, 100 * profit / before if before else 0.0))
    got = {r.direction: r for r in T.performance(T.transaction_profits(events, "price").df, ["series"]).collect()}
    for direction, side in (("long", "SELL"), ("short", "BUY")):
        assert got[direction].transactions == len(totals[side])
        assert got[direction].profit == pytest.approx(round(sum(p for p, _ in totals[side]), 2))
        assert got[direction].profitable == sum(p > 0 for p, _ in totals[side])
    assert got["both"].profit == pytest.approx(sum(p for side in totals.values() for p, _ in side))


def test_live_transactions(signalled):
    frame, d = signalled
    rows = T.live_transactions(frame, "buy", "sell", "price").df.orderBy("pos").collect()
    want, last = [], (None, None)
    for i, (b, s, p) in enumerate(zip(d["buy"], d["sell"], d["price"])):
        side = "BUY" if b and not s else "SELL" if s and not b else None
        if side and side != last[0]:
            want.append((i + 5, side, 0.0 if last[1] is None else (last[1] - p if side == "BUY" else p - last[1])))
            last = (side, p)
    assert [(r.pos, r.side) for r in rows] == [w[:2] for w in want]
    np.testing.assert_allclose([r.profit for r in rows], [w[2] for w in want], atol=1e-9)


def test_sweep_equals_single_runs(make_frame):
    rng = np.random.default_rng(9)
    n = 150
    score, price = np.round(rng.uniform(-1, 1, n), 3), np.round(rng.uniform(50, 99, n), 2)
    frame = make_frame({"a": {"score": score, "price": price}}, bucket_rows=16)
    grid = {"buy_signal_threshold": [0.2, 0.6, 2.0], "sell_signal_threshold": [-0.3, -0.7]}
    got = {(r.buy_signal_threshold, r.sell_signal_threshold): r for r in T.sweep(frame, ["score"], "price", grid, "long", top=None).collect()}
    assert len(got) == 6
    for b, s in itertools.product(*grid.values()):
        events = [i for i, side in walk_signals(score >= b, score <= s, price) if side == "SELL"]
        profit = sum(price[y] - price[x] for x, y in zip(events, events[1:]))
        assert got[b, s].transactions == len(events) and got[b, s].profit == pytest.approx(round(profit, 2))
    best = T.sweep(frame, ["score"], "price", grid, "long", top=2).collect()
    ranked = sorted(got.values(), key=lambda r: (-r.profit_percent_per_month, r.param_id))[:2]
    assert {r.param_id for r in best} == {r.param_id for r in ranked}
    equal = T.sweep(frame, ["score"], "price", {"buy_signal_threshold": [0.2, 0.4]}, "short", buy_sell_equal=True).collect()
    assert {(r.buy_signal_threshold, r.sell_signal_threshold) for r in equal} == {(0.2, -0.2), (0.4, -0.4)}
    with pytest.raises(ValueError):
        T.sweep(frame, ["score"], "price", grid, "sideways")


def test_exact_quantile(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": ["x"] * 7 + ["y"] * 10, "v": np.round(rng.normal(size=17), 3)})
    got = {r.k: r.m for r in T.exact_quantile(spark.createDataFrame(pdf), ["k"], "v", 0.5, "m").collect()}
    for k, g in pdf.groupby("k"):
        assert got[k] == pytest.approx(g["v"].median())


def test_decimal_text(spark):
    df = spark.createDataFrame([("4.1E-7",), ("10.000000001",), ("10.000000009",), ("0.01185454",), ("-1.5",)], "v string")
    rows = df.select(N.round_down_text(F.col("v"), 8).alias("a"), N.round_text(F.col("v"), 8).alias("b"),
                     N.round_down_text(F.col("v"), 6).alias("c"), N.truncate_decimal(F.col("v")).cast("string").alias("d")).collect()
    assert [r.a for r in rows] == ["0.00000041", "10.00000000", "10.00000000", "0.01185454", "-1.50000000"]
    assert rows[2].b == "10.00000001" and rows[3].c == "0.011854" and rows[0].d == "0.00000041"


def test_rule_signals(spark):
    df = spark.createDataFrame([(222, 1, 2), (333, 2, 1), (444, 0, 1)], "aaa int, high_60_20 int, low_60_04 int")
    bounds = {"high_60_20": 1, "low_60_04": 1}
    rows = df.withColumns(S.rule_signals({"buy": bounds, "sell": bounds})).orderBy("aaa").collect()
    assert [r.buy for r in rows] == [1, 1, 0] and [r.sell for r in rows] == [0, 0, 1]


@pytest.mark.parametrize("prices,size,start,want", [
    ([(1, 1), (3, 1), (4, 1), (5, 1), (6, 1), (7, 1)], 4.0, None, [1, 1]),
    ([(1, 1), (3, 1), (4, 20), (6, 1), (7, 1)], 4.0, None, [5.75, 5.75]),
    ([(1, 1), (3, 1), (4, 1), (5, 2)], 2.0, 0.0, [0.5, 1.0, 1.5]),
    ([(1, 1), (5, 2)], 2.0, 0.0, [0.5, 1.0, 1.5]),
])
@pytest.mark.parametrize("side", ["ask", "bid"])
def test_depth(spark, prices, size, start, want, side):
    sign = 1.0 if side == "ask" else -1.0
    df = spark.createDataFrame([("s", sign * p, float(v)) for p, v in prices], "snap string, price double, volume double")
    rows = depth_bins(df, ["snap"], size, start, side).orderBy("bin").collect()
    assert [r.volume for r in rows] == pytest.approx(want) and [r.bin for r in rows] == list(range(len(want)))


def test_bands(spark):
    df = spark.createDataFrame([(v,) for v in (0.5, 0.3, 0.1, 0.0, -0.1, -0.2, -0.5, None)], "v double")
    rows = df.select(S.score_band(F.col("v"), [0.3, 0.1], [-0.1, -0.3]).alias("b")).collect()
    assert [r.b for r in rows] == [2, 2, 1, 0, 0, -1, -2, 0]


def test_intervals_of_the_published_series(make_frame):
    close = np.array([10., 40, 30, 70, 90, 50, 60, 30, 9] * 2)
    label = np.isin(np.arange(18), [3, 4, 5, 12, 13])
    f = make_frame({"a": {"score": close / 10, "label": label}}, bucket_rows=4)
    rows = S.interval_precision(f, "label", "score", 6.0).orderBy("interval_no").collect()
    assert [r.label for r in rows] == [False, True, False, True, False]
    assert [r.score for r in rows] == [False, True, True, True, True]


def test_smoothing(make_frame, column_of):
    a, b = random_walk(60, 1, 0.2), random_walk(60, 2, 0.2)
    f = make_frame({"a": {"a": a, "b": b}}, bucket_rows=16)
    mean = pd.DataFrame({"a": a, "b": b}).mean(axis=1)
    np.testing.assert_allclose(column_of(S.smoothen(f, ["a", "b"], "y", 6), "y"), mean.rolling(6, min_periods=3).mean(), atol=1e-9)
    share = (mean >= 100).astype(float)
    np.testing.assert_allclose(
        column_of(S.smoothen(f, ["a", "b"], "y", 6, point_threshold=100), "y"), share.rolling(6, min_periods=3).mean(), atol=1e-9)
    np.testing.assert_allclose(
        column_of(S.smoothen(f, ["a", "b"], "y", 6.0), "y"), mean.ewm(span=6.0, min_periods=3, adjust=False).mean(), atol=1e-9)


def test_metrics(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"g": "x", "y_true": (rng.random(120) < 0.4).astype(int), "y_hat": np.round(rng.random(120), 1)})
    got = M.classification_metrics(spark.createDataFrame(pdf), ["g"]).first()
    pos, neg = pdf[pdf.y_true == 1].y_hat.to_numpy(), pdf[pdf.y_true == 0].y_hat.to_numpy()
    auc = np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg])
    assert got.auc == pytest.approx(auc, abs=6e-4)
    ap, before = 0.0, 0.0
    for t in sorted(set(pdf.y_hat), reverse=True):
        said = pdf[pdf.y_hat >= t]
        recall = said.y_true.sum() / len(pos)
        ap += (recall - before) * said.y_true.mean()
        before = recall
    assert got.ap == pytest.approx(ap, abs=6e-4)
    tp = ((pdf.y_true == 1) & (pdf.y_hat > 0.5)).sum()
    assert got.precision == pytest.approx(tp / (pdf.y_hat > 0.5).sum(), abs=6e-4) and got.recall == pytest.approx(tp / len(pos), abs=6e-4)
    single = M.classification_metrics(spark.createDataFrame(pdf[pdf.y_true == 1]), ["g"]).first()
    assert single.auc == 0 and single.ap == 0
    reg = pdf.assign(y_true=rng.normal(size=120), y_hat=rng.normal(size=120))
    r = M.regression_metrics(spark.createDataFrame(reg), ["g"]).first()
    err = reg.y_true - reg.y_hat
    assert r.mae == pytest.approx(err.abs().mean(), abs=6e-4)
    assert r.r2 == pytest.approx(1 - (err ** 2).sum() / ((reg.y_true - reg.y_true.mean()) ** 2).sum(), abs=6e-4)


def test_updates(spark):
    old = spark.createDataFrame([("a", 1, 1.0, 5.0), ("a", 2, 2.0, None), ("a", 3, 3.0, 7.0)], "s string, t int, x double, y double")
    new = spark.createDataFrame([("a", 2, None, 8.0), ("a", 4, 4.0, None)], "s string, t int, x double, y double")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    key = ["s", "t"]
    assert rows(U.combine_update(old, new, key)) == [("a", 1, 1.0, 5.0), ("a", 2, 2.0, 8.0), ("a", 3, 3.0, 7.0), ("a", 4, 4.0, None)]
    assert [r[1] for r in rows(U.replace_from(old, new, ["s"], "t"))] == [1, 2, 4]
    assert rows(U.replace_rows(old, new, key))[1] == ("a", 2, None, 8.0)
    assert U.overlap_mismatches(old, old.withColumn("x", F.col("x") + 1e-9), key, ["x"]).first().different == 0
    assert U.overlap_differences(old, new, key, ["x"]).first().differing == ["x"]


def test_updates_of_null_keys_and_repeated_rows(spark, tmp_path):
    old = spark.createDataFrame([(None, 1, 1.0), ("a", None, 2.0)], "s string, t int, x double")
    new = spark.createDataFrame([(None, 1, 5.0), (None, 1, 3.0), ("a", None, 7.0)], "s string, t int, x double")
    key, rows = ["s", "t"], lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(U.combine_update(old, new.where("x <> 3"), key)) == [("a", None, 7.0), (None, 1, 5.0)]
    assert rows(U.replace_rows(old, new, key)) == [("a", None, 7.0), (None, 1, 5.0)]
    dated = new.withColumn("seen", -F.col("x"))
    assert [r[2] for r in rows(U.replace_rows(old.withColumn("seen", F.lit(0.0)), dated, key, ["seen"]))] == [7.0, 3.0]
    assert tuple(U.overlap_mismatches(old, new.where("x <> 3"), key, ["x"]).first()) == (2, 2)
    ML.fit_statistic(old, "x", str(tmp_path / "m"), ["s"])
    assert rows(ML.deviation_from_fitted(new, "x", str(tmp_path / "m"), "d", ["s"]).select("d")) == [(2.0,), (4.0,), (5.0,)]


def test_notnull_tail(make_frame):
    f = make_frame({"a": {"x": [1., np.nan, 3., 4.], "y": [1., 2, np.nan, 4.]}, "b": {"x": [1.], "y": [1.]}})
    got = {r.series: r.tail_rows for r in U.notnull_tail(f.df, ["series"], "pos", ["x", "y"]).collect()}
    assert got == {"a": 1, "b": 1}


def test_one_hot_series_is_split(spark):
    """A window over a hot series is partitioned by series and bucket, never by series alone."""
    df = spark.range(100_000).select(F.when(F.col("id") >= 0, "hot").alias("series"), F.col("id").alias("pos"), F.rand(1).alias("x"))
    from tidemark.operators.rolling import past_aggregations

    out = SeriesFrame(df, ("series",), ts="pos", bucket_rows=1000).derive(past_aggregations("x", "mean", 50))
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    # the series is in the key value that stands for all keys
    exchanges = [part[:60] for part in plan.split("hashpartitioning(")[1:]]
    assert exchanges and all("__bucket" in e and "__key" in e for e in exchanges)
    assert out.df.count() == 100_000


def test_kernels_take_more_tasks_for_more_rows(spark, monkeypatch):
    import tidemark.frame

    monkeypatch.setattr(tidemark.frame, "TASK_ROWS", 100)
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(4000)], "s long, x double")
    frame = tidemark.frame.number_rows(df, ["s"], ["x"], ts="x")
    from tidemark.operators.labels import first_crossings

    crossed = first_crossings(frame, 5, {"far": ("x", "x", 50.0)}).df
    plan = crossed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(", 40") >= 3  # rows sent to numpy, and both sides of the join
    assert crossed.count() == 4000


def test_depth_bins_take_more_tasks_for_more_levels(spark, monkeypatch):
    import tidemark.frame

    monkeypatch.setattr(tidemark.frame, "TASK_ROWS", 100)
    df = spark.createDataFrame([(i // 4, float(i % 4), 1.0) for i in range(4000)], "snap long, price double, volume double")
    bins = depth_bins(df, ["snap"], 2.0)
    assert bins.rdd.getNumPartitions() == 40
    assert bins.count() == 2000


def test_depth_bins_of_long_snapshots(spark, monkeypatch):
    import tidemark.operators.depth as depth

    rows = [(k, None if (i + j) % 7 == 0 else float(p), float(i)) for j, (k, n) in enumerate([("a", 40), (None, 30), ("b", 3), ("c", 1)])
            for i, p in enumerate(np.random.default_rng(j).integers(0, 50, n))]
    df = spark.createDataFrame(rows, "snap string, price double, volume double")

    def bins(start):
        return {(r.snap, r.bin): r.volume for r in depth_bins(df, ["snap"], 4.0, start).collect()}

    whole = {start: bins(start) for start in (None, -5.0)}
    monkeypatch.setattr(depth, "WHOLE_LEVELS", 10)
    for start, expected in whole.items():
        assert bins(start) == pytest.approx(expected)


def test_rounding_is_that_of_spark(spark):
    from tidemark.functions.numeric import rounded

    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 10.0**k, 2000) for k in range(-8, 12)] + [rng.integers(-10**6, 10**6, 2000) / 2e6, rng.integers(-10**9, 10**9, 2000) / 2e6,
                       rng.integers(-99, 99, 500) / 640, [0.0, -0.0, np.nan, np.inf, -np.inf, 9999999.9999995, 0.0000005, -0.0000005, 1.0000005]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    fast = rounded(F.col("x"), 6)
    assert df.where(~fast.eqNullSafe(F.round("x", 6))).count() == 0
    assert "CASE WHEN" in df.select(fast)._jdf.queryExecution().optimizedPlan().toString()


def test_wide_projections_stay_out_of_whole_stage_code(spark):
    """One method for all rounded columns would be too long for Java to compile; the values are the same."""
    from tidemark.plans.catalog import WIDE, project

    rng = np.random.default_rng(6)
    names = [f"c{i}" for i in range(WIDE + 1)]
    df = spark.createDataFrame([(float(i), *map(float, x)) for i, x in enumerate(rng.normal(0, 100, (50, WIDE + 1)))] + [(None,) * (WIDE + 2)], ", ".join(f"{n} double" for n in ["id", *names]))
    df = df.repartition(2)
    wide, narrow = project(df, "id:b " + " ".join(f"{n}:d" for n in names)), [project(df, f"id:b {n}:d") for n in names]
    got = {r.id: r for r in wide.collect()}
    for n, part in zip(names, narrow):
        assert {r.id: r[n] for r in part.collect()} == {i: r[n] for i, r in got.items()}
    stages = [line for line in wide._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0].splitlines() if "lambda" in line]
    assert stages and not any("*(" in line for line in stages)
