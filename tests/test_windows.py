"""Window operators against plain pandas, with buckets much shorter than the series."""

import time

import numpy as np
import pandas as pd
import pytest
from conftest import random_walk
from pyspark.sql import functions as F

from tidemark.frame import CLEANUP, Kernel, SeriesFrame, number_rows, settle
from tidemark.operators import bundles, recursive
from tidemark.operators import rolling as R
from tidemark.operators.indicators import indicators
from tidemark.operators.labels import first_crossings
from tidemark.operators.levels import Tree, window
from tidemark.operators.raster import interpolate
from tidemark.operators.recursive import exponential_mean

N = 150


@pytest.fixture
def walk(make_frame):
    x, v = random_walk(N, 1, 0.1), np.abs(random_walk(N, 2))
    return make_frame({"a": {"x": x, "v": v}, "b": {"x": random_walk(40, 3), "v": random_walk(40, 4)}}), x, v


@pytest.fixture(params=[0, R.SHORT], ids=["doubling", "sliding"])
def both_plans(request, monkeypatch):
    """Every window by merged states, and short ones by sliding frames."""
    monkeypatch.setattr(R, "SHORT", request.param)


@pytest.mark.parametrize("future", [False, True])
def test_aggregates(both_plans, walk, column_of, future):
    frame, x, _ = walk
    windows, functions = [1, 2, 5, 16, 24, 61], ["mean", "max", "min", "sum", "std", "var", "count"]
    out = frame.derive([s for fn in functions for s in (R.future_aggregations if future else R.past_aggregations)("x", fn, windows)])
    out = out.settle()
    for fn, w in [(fn, w) for fn in functions for w in windows]:
        ro = pd.Series(x).rolling(w, min_periods=max(1, w // 2))
        want = (getattr(ro, fn)(ddof=0) if fn in ("std", "var") else getattr(ro, fn)()).to_numpy()
        if fn == "count":
            want = np.where(ro.mean().isna(), np.nan, want)
        if future:
            want = np.append(want[w:], np.full(w, np.nan))
        np.testing.assert_allclose(column_of(out, f"x_{fn}_{w}"), want, atol=1e-8)


def test_weighted(walk, column_of):
    frame, x, v = walk
    base = R.past_weighted_aggregations("x", "v", "mean", 20, suffix="")
    out = frame.derive(base, R.past_weighted_aggregations("x", "v", "mean", [3, 7], "_rel", "x_20", 100.0))

    def weighted(w):
        p = pd.Series(x * v).rolling(w, min_periods=max(1, w // 2)).mean()
        return p / pd.Series(v).rolling(w, min_periods=max(1, w // 2)).mean()

    np.testing.assert_allclose(column_of(out, "x_20"), weighted(20), atol=1e-9)
    np.testing.assert_allclose(column_of(out, "x_rel_7"), 100 * (weighted(7) - weighted(20)) / weighted(20), atol=1e-8)


def _slope(values):
    ok = ~np.isnan(values)
    if ok.sum() == 1:
        return 0.0
    return np.polyfit(np.arange(len(values))[ok], values[ok], 1)[0]


def test_slope(both_plans, walk, column_of):
    frame, x, _ = walk
    out = frame.derive(R.linear_trends("x", [4, 30]))
    for w in (4, 30):
        want = pd.Series(x).rolling(w, min_periods=max(1, w // 2)).apply(_slope, raw=True)
        np.testing.assert_allclose(column_of(out, f"x_trend_{w}"), want, atol=1e-8)


def test_published_values(both_plans, make_frame, column_of):
    f = make_frame({"a": {"price": [10., 20, 30, 20, 10, 20, 30]}}, bucket_rows=4)
    past = column_of(f.derive(R.area_ratio("price", 4)), "price_area_ratio_4")
    assert past[-1] == -1 and past[-2] == 0
    future = column_of(f.derive(R.area_ratio("price", 4, future=True)), "price_area_ratio_4")
    assert future[0] == 1 and future[1] == 0
    g = make_frame({"a": {"price": [10., 20, 40, 40, 30, 10]}}, bucket_rows=4)
    np.testing.assert_allclose(column_of(g.derive(R.linear_trends("price", 2)), "price_trend_2"), [0, 10, 20, 0, -10, -20])
    np.testing.assert_allclose(
        column_of(g.derive(R.linear_trends("price", 2, future=True)), "price_trend_2"), [10, 20, 0, -10, -20, np.nan])
    np.testing.assert_allclose(
        column_of(g.derive(R.linear_trends("price", 6)), "price_trend_6"), [np.nan, np.nan, 15, 11, 6, 0.857143], atol=1e-6)


def test_shape_statistics(both_plans, make_frame, column_of):
    x = random_walk(N, 5)
    f = make_frame({"a": {"x": x}})
    out = f.derive(R.window_statistics("x", ["skew", "kurtosis", "lsbm", "fmax", "msdc", "area"], [12]))
    ro = pd.Series(x).rolling(12, min_periods=6)

    def longest(v):
        best = run = 0
        for below in v < v.mean():
            run = run + 1 if below else 0
            best = max(best, run)
        return best

    np.testing.assert_allclose(column_of(out, "x_skew_12"), ro.apply(lambda v: pd.Series(v).skew()), atol=1e-6)
    np.testing.assert_allclose(column_of(out, "x_kurtosis_12"), ro.apply(lambda v: pd.Series(v).kurt()), atol=1e-6)
    np.testing.assert_allclose(column_of(out, "x_lsbm_12"), ro.apply(longest, raw=True))
    np.testing.assert_allclose(column_of(out, "x_fmax_12"), ro.apply(lambda v: np.argmax(v) / len(v), raw=True))
    msdc = ro.apply(lambda v: np.mean((v[2:] - 2 * v[1:-1] + v[:-2]) / 2), raw=True)
    np.testing.assert_allclose(column_of(out, "x_msdc_12"), msdc, atol=1e-9)


def test_states_leave_nothing_behind(both_plans, make_frame, column_of):
    """Equal values have no spread at all, huge and infinite ones are gone with their window, gaps do not count."""
    x = np.full(120, 0.1)
    x[20], x[50], x[80:100] = np.inf, 1e300, np.nan
    out = make_frame({"a": {"x": x}}).derive([R.rolling("x", "std", 7, "std"), R.skewness("x", 7, "skew"), R.slope("x", 7, "slope"), R.rolling("x", "sum", 7, "sum")])
    clean = np.ones(120, bool)
    for k in (20, 50):
        clean[k : k + 7] = False
    known = pd.Series(x).rolling(7, min_periods=0).count().to_numpy() >= 3
    for name in ("std", "skew", "slope"):
        got = column_of(out, name)
        assert (got[clean & known] == 0).all() if name != "slope" else (np.abs(got[clean & known]) < 1e-15).all()
        assert np.isnan(got[~known]).all()
    np.testing.assert_allclose(column_of(out, "sum")[clean & known], 0.1 * pd.Series(x).rolling(7, min_periods=0).count().to_numpy()[clean & known])


@pytest.mark.parametrize(("n", "w", "future"), [(1, 1, False), (7, 3, True), (50, 50, False), (200, 37, True), (333, 64, False), (100, 1000, False)])
def test_merge_sort_tree(n, w, future):
    rng = np.random.default_rng(n)
    x = np.round(rng.normal(0, 3, n), 1)
    x[rng.random(n) < 0.2] = np.nan
    level = np.where(rng.random(n) < 0.5, x, np.round(rng.normal(0, 3, n), 1))
    first, end = window(n, w, future)
    parts = Tree(x, w).parts(first, end, level)
    for i in range(n):
        v = x[first[i] : end[i]]
        v = v[~np.isnan(v)]
        assert parts.n[i] == len(v) and abs(parts.total[i] - v.sum()) < 1e-9
        if not np.isnan(level[i]):
            below, upto = v[v < level[i]], v[v <= level[i]]
            assert (parts.n_below[i], parts.n_upto[i]) == (len(below), len(upto))
            assert abs(parts.below[i] - below.sum()) < 1e-9 and abs(parts.upto[i] - upto.sum()) < 1e-9


def test_tree_forgets_huge_values(make_frame, column_of):
    """A value that is huge or infinite counts in the windows that hold it, and in no other."""
    x = random_walk(100, 11)
    y = x.copy()
    y[30], y[60] = 1e300, np.inf
    a, b = (column_of(make_frame({"a": {"x": v}}).derive(R.area_ratio("x", 8)), "x_area_ratio_8") for v in (x, y))
    clean = np.ones(100, bool)
    clean[30:38] = clean[60:68] = False
    np.testing.assert_allclose(a[clean], b[clean], atol=1e-12)


def test_kernels_get_their_columns_only(make_frame):
    """What goes to Python are keys, position and the columns that a kernel names."""
    frame = make_frame({"a": {"x": random_walk(60, 1), "v": random_walk(60, 2), "other": random_walk(60, 3)}})
    frame = frame.with_columns({"text": F.lit("wide")})
    for out in (first_crossings(frame, 5, {"up": ("x", "v", 1.0)}), frame.derive(R.area_ratio("x", 9)), exponential_mean(frame, "x", 5.0, "smooth")):
        plan = out.df._jdf.queryExecution().optimizedPlan().toString()
        sent = [line for line in plan.splitlines() if "FlatMapGroupsInArrow" in line or "FlatMapGroupsInPandas" in line]
        assert sent and not any("other" in line or "text" in line for line in sent)
        rows = out.df.collect()
        assert len(rows) == 60 and {"other", "text", "x", "v"} <= set(out.df.columns)


def test_kernels_follow_steps(make_frame, column_of):
    """A kernel may read what steps of an earlier stage made, and later steps what a kernel made."""
    frame = make_frame({"a": {"x": random_walk(80, 4)}})
    double = Kernel({"__twice": "double"}, ["__m"], lambda pos, v: {"__twice": v["__m"] * 2}, 0, 0)
    out = frame.derive(R.rolling("x", "mean", 3, "__m"), [double, R.rolling("x", "max", 4, "top")], R.rolling("__twice", "sum", 2, "y"))
    m = column_of(frame.derive(R.rolling("x", "mean", 3, "m")), "m")
    np.testing.assert_allclose(column_of(out, "y"), 2 * pd.Series(m).rolling(2, min_periods=1).sum())
    assert not [c for c in out.df.columns if c.startswith("__")] and "top" in out.df.columns


def test_one_sort_for_all_windows(monkeypatch, walk):
    """Windows of any length and function share the frame's exchange and its sort."""
    monkeypatch.setattr(R, "SHORT", 4)
    frame, _, _ = walk
    out = frame.derive([s for fn in ("mean", "max", "std") for s in R.past_aggregations("x", fn, [3, 17, 40, 64])] + R.linear_trends("x", [33]))
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("Exchange hashpartitioning") == 1
    # one window node per doubling at most, not one for each length and function
    assert plan.count("Window [") <= 9


def test_changes_and_shifts(walk, column_of):
    frame, x, _ = walk
    out = frame.derive([R.percent_change("x", "pc"), R.percent_change("x", "pc2", "current"), R.log_difference("x", "ld"),
                        *R.shifted_copies(["x"], [3, -2])])
    s = pd.Series(x)
    np.testing.assert_allclose(column_of(out, "pc"), 100 * s.diff() / s.shift(), atol=1e-9)
    np.testing.assert_allclose(column_of(out, "pc2"), 100 * s.diff() / s, atol=1e-9)
    np.testing.assert_allclose(column_of(out, "ld"), np.log(s).diff(), atol=1e-9)
    np.testing.assert_allclose(column_of(out, "x_lag_3"), s.shift(3))
    np.testing.assert_allclose(column_of(out, "x_lag_-2"), s.shift(-2))


def test_interpolation(make_frame, column_of):
    x = random_walk(N, 7, 0.4)
    x[:20] = np.nan
    x[60:110] = np.nan
    x[-30:] = np.nan
    f = make_frame({"a": {"x": x}, "b": {"x": np.full(30, np.nan)}}, bucket_rows=8)
    out = interpolate(f, ["x"])
    np.testing.assert_allclose(column_of(out, "x"), pd.Series(x).interpolate(), atol=1e-9)
    assert np.isnan(column_of(out, "x", "b")).all()


def test_running_and_fill(walk, column_of):
    frame, x, v = walk
    out = frame.running({"n": F.col("x").isNotNull().cast("long"), "t": F.col("v")})
    np.testing.assert_allclose(column_of(out, "n"), np.cumsum(~np.isnan(x)))
    np.testing.assert_allclose(column_of(out, "t"), np.cumsum(v), rtol=1e-12)
    out = frame.fill({"p": F.col("x")}, {"q": F.col("x")}, strict=True)
    s = pd.Series(x)
    np.testing.assert_allclose(column_of(out, "p"), s.ffill().shift())
    np.testing.assert_allclose(column_of(out, "q"), s.bfill().shift(-1))


def test_row_selection(walk):
    frame, _, _ = walk
    count = lambda df, s: df.where(F.col("series") == s).count()
    assert count(frame.tail(10).df, "a") == 10 and count(frame.tail(100).df, "b") == 40
    assert count(frame.drop_tail(10).df, "a") == N - 10
    assert count(frame.drop_head(3).df, "b") == 37
    assert count(frame.every_nth(4), "b") == 10


def test_user_aggregate(walk, column_of):
    @F.pandas_udf("double")
    def spread(s: pd.Series) -> float:
        return float(s.max() - s.min())

    frame, x, _ = walk
    out = frame.derive(R.user_aggregate("x", spread, 6, "spread"))
    ro = pd.Series(x).rolling(6, min_periods=3)
    np.testing.assert_allclose(column_of(out, "spread"), ro.max() - ro.min())


def _ema(x, w):
    out, y = np.full(len(x), np.nan), np.nan
    ok = np.flatnonzero(~np.isnan(x))
    if len(ok) < w:
        return out
    s = ok[0] + w - 1
    y = x[ok[0]:s + 1].mean()
    out[s] = y
    for i in range(s + 1, len(x)):
        y += 2 / (w + 1) * (x[i] - y)
        out[i] = y
    return out


def test_indicators(make_frame, column_of):
    x = random_walk(90, 8)
    f = make_frame({"a": {"x": x}})
    s = pd.Series(x)
    out, names = indicators(f, "x", ["SMA", "STDDEV", "LINEARREG_SLOPE", "WMA", "TRIMA", "ROC", "MOM", "TSF"], [6, 9],
                            fill_gaps=False)
    assert names[:2] == ["x_SMA_6", "x_SMA_9"]
    for w in (6, 9):
        ro = s.rolling(w)
        np.testing.assert_allclose(column_of(out, f"x_SMA_{w}"), ro.mean(), atol=1e-9)
        np.testing.assert_allclose(column_of(out, f"x_STDDEV_{w}"), ro.std(ddof=0), atol=1e-9)
        np.testing.assert_allclose(column_of(out, f"x_LINEARREG_SLOPE_{w}"), ro.apply(_slope, raw=True), atol=1e-9)
        k = np.arange(1, w + 1)
        np.testing.assert_allclose(column_of(out, f"x_WMA_{w}"), ro.apply(lambda v: v @ k / k.sum(), raw=True), atol=1e-9)
        a, b = (w // 2, w // 2 + 1) if w % 2 == 0 else ((w + 1) // 2,) * 2
        np.testing.assert_allclose(column_of(out, f"x_TRIMA_{w}"), s.rolling(a).mean().rolling(b).mean(), atol=1e-9)
        np.testing.assert_allclose(column_of(out, f"x_ROC_{w}"), 100 * (s / s.shift(w) - 1), atol=1e-9)
        tsf = ro.apply(lambda v: np.polyval(np.polyfit(np.arange(w), v, 1), w), raw=True)
        np.testing.assert_allclose(column_of(out, f"x_TSF_{w}"), tsf, atol=1e-8)


def test_relative_indicators(make_frame, column_of):
    x = random_walk(60, 9)
    s = pd.Series(x)
    f = make_frame({"a": {"x": x}})
    out, _ = indicators(f, ["x"], ["SMA"], [1, 4, 12], rel_base="next", rel_func="rel_diff", percentage=True)
    m4, m12 = s.rolling(4).mean(), s.rolling(12).mean()
    np.testing.assert_allclose(column_of(out, "x_SMA_1"), 100 * (s - m4) / m4, atol=1e-8)
    np.testing.assert_allclose(column_of(out, "x_SMA_4"), 100 * (m4 - m12) / m12, atol=1e-8)
    np.testing.assert_allclose(column_of(out, "x_SMA_12"), 100 * m12, atol=1e-8)


def test_recursive_indicators(make_frame, column_of):
    x, n = random_walk(80, 10), 7
    f = make_frame({"a": {"x": x, "h": x + 1.5, "l": x - 0.7}, "b": {"x": x[:5], "h": x[:5], "l": x[:5]}})
    out, _ = indicators(f, "x", ["EMA", "DEMA", "RSI", "CMO"], [n], fill_gaps=False)
    e1 = _ema(x, n)
    e2 = _ema(e1, n)
    np.testing.assert_allclose(column_of(out, f"x_EMA_{n}"), e1, atol=1e-9)
    np.testing.assert_allclose(column_of(out, f"x_DEMA_{n}"), 2 * e1 - e2, atol=1e-9)
    d = np.diff(x)
    g, lo = np.maximum(d, 0), np.maximum(-d, 0)
    ag, al, rsi = g[:n].mean(), lo[:n].mean(), np.full(len(x), np.nan)
    rsi[n] = 100 * ag / (ag + al)
    for i in range(n, len(d)):
        ag, al = (ag * (n - 1) + g[i]) / n, (al * (n - 1) + lo[i]) / n
        rsi[i + 1] = 100 * ag / (ag + al)
    np.testing.assert_allclose(column_of(out, f"x_RSI_{n}"), rsi, atol=1e-8)
    assert np.isnan(column_of(out, f"x_EMA_{n}", "b")).all()


def test_recursive_indicators_in_one_pass(make_frame, column_of, monkeypatch):
    """All functions and windows, also windows over several buckets, settle the frame once and place it as often as one would."""
    x = random_walk(200, 12)
    x[:9] = np.nan
    settled = []
    monkeypatch.setattr(recursive, "settle", lambda df, real=recursive.settle: settled.append("maps") or real(df))
    real = SeriesFrame.settle
    monkeypatch.setattr(SeriesFrame, "settle", lambda self: settled.append("rows") or real(self))
    f = make_frame({"a": {"x": x}, "b": {"x": np.full(30, np.nan)}, "c": {"x": random_walk(3, 5)}})
    out, names = indicators(f, "x", ["EMA", "DEMA", "TEMA", "RSI"], [2, 5, 40], fill_gaps=False)
    assert settled == ["rows", "maps"] and not [c for c in out.df.columns if "__" in c]
    out = real(out)
    for w in (2, 5, 40):
        e1 = _ema(x, w)
        e2 = _ema(e1, w)
        e3 = _ema(e2, w)
        np.testing.assert_allclose(column_of(out, f"x_EMA_{w}"), e1, atol=1e-9)
        np.testing.assert_allclose(column_of(out, f"x_TEMA_{w}"), 3 * e1 - 3 * e2 + e3, atol=1e-8)
    for n in names:
        assert np.isnan(column_of(out, n, "b")).all() and len(column_of(out, n, "c")) == 3


def test_recursion_passes_over_unknown_values(make_frame, column_of):
    """A row without a value has no result, wherever it is, and the others are those of the known values alone."""
    x = random_walk(90, 13)
    gaps = np.random.default_rng(2).random(90) < 0.3
    with_gaps = np.where(gaps, np.nan, x)
    out, _ = indicators(make_frame({"a": {"x": with_gaps}}), "x", "DEMA", 6, fill_gaps=False)
    e1 = _ema(x[~gaps], 6)
    want = np.full(90, np.nan)
    want[~gaps] = 2 * e1 - _ema(e1, 6)
    np.testing.assert_allclose(column_of(out, "x_DEMA_6"), want, atol=1e-9)


@pytest.mark.parametrize("nulls", [0.0, 0.6])
def test_exponential_mean(make_frame, column_of, nulls):
    from tidemark.operators.recursive import exponential_mean

    x = random_walk(N, 11, nulls)
    x[:19] = np.nan
    x[50:90] = np.nan
    f = make_frame({"a": {"x": x}, "b": {"x": np.full(25, np.nan)}}, bucket_rows=8)
    out = exponential_mean(f, "x", 9.0, "y", 4)
    np.testing.assert_allclose(
        column_of(out, "y"), pd.Series(x).ewm(span=9.0, min_periods=4, adjust=False).mean(), atol=1e-9)
    assert np.isnan(column_of(out, "y", "b")).all()


@pytest.mark.parametrize("w", [5, 63, 64])
def test_types_and_values_that_leave(make_frame, column_of, w):
    n = 200
    x = np.arange(n, dtype=float)
    x[10], x[90] = np.inf, 1e300
    frame = make_frame({"a": {"x": x, "k": np.arange(n)}}, bucket_rows=256)
    out = frame.derive([*R.past_aggregations("x", "mean", w), *R.past_aggregations("k", "sum", w)])
    assert dict(out.df.dtypes)[f"k_sum_{w}"] == "bigint"
    got = column_of(out, f"x_mean_{w}")
    for i in (w - 1 + 11, 89, n - 1):
        if i - w >= 10 and not i - w < 90 <= i:
            assert got[i] == pytest.approx(x[i - w + 1 : i + 1].mean())


def test_null_series_is_a_series(spark):
    from tidemark.frame import number_rows

    df = spark.createDataFrame([(None, 3.0), (None, 1.0), ("a", 2.0)], "series string, x double")
    frame = number_rows(df, "series", ["x"], ts="x")
    rows = frame.tail(1).running({"total": F.col("x")}).derive(R.past_aggregations("x", "sum", 2)).df.collect()
    assert sorted((str(r.series), r.pos, r.x, r.total) for r in rows) == [("None", 1, 3.0, 3.0), ("a", 0, 2.0, 2.0)]


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_depth_bundle_equals_sliding_frames(make_frame):
    """The same to the last digit, also around NULL, NaN, infinities and a base of 0; NULL keys are a series."""
    rng = np.random.default_rng(9)
    columns = {c: rng.normal(0, 3, 120) for c in bundles.DEPTH_COLUMNS}
    columns["gap"][rng.random(120) < 0.5] = np.nan  # NULL
    columns["bids_1"][:] = 0.0
    columns["asks_1"][40:] = 0.0
    columns["bids_2"][50], columns["asks_2"][60] = np.inf, 1e300
    columns["bids_5"][:] = np.nan
    frame = make_frame({"a": columns, "b": {c: x[:20] for c, x in columns.items()}})
    frame = frame.with_columns({"series": F.when(F.col("series") == "a", "a"), "bids_10": F.when(F.col("pos") == 45, float("nan")).otherwise(F.col("bids_10"))}).settle()
    got, names = bundles.depth_bundle(frame)
    parts = [bundles._against_base(c, "mean", bundles.DEPTH_BASE, bundles.DEPTH_WINDOWS, c) for c in bundles.DEPTH_COLUMNS]
    want = frame.derive([s for p in parts for s in p[0]], [s for p in parts for s in p[1]])
    assert names == [n for p in parts for n in p[2]] and got.df.columns == want.df.columns
    assert sorted(map(repr, got.df.collect())) == sorted(map(repr, want.df.collect()))
    assert got.df.where("bids_10_2 = double('NaN')").count() and got.df.where("gap_2 is not null").count()


def test_made_columns_do_not_go_through_the_shuffle(make_frame):
    walk = make_frame({"a": {"x": random_walk(60, 1)}})
    book = {c: F.col("x") * (i + 1) for i, c in enumerate(bundles.DEPTH_COLUMNS)}
    through, want = bundles.depth_bundle(walk, book)[0].df, bundles.depth_bundle(walk.with_columns(book))[0].df
    assert sorted(map(repr, through.select(want.columns).collect())) == sorted(map(repr, want.collect()))
    plan = through._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "asks_20" not in plan[plan.index("RepartitionByExpression"):]
    assert _plan(through).partition("Initial Plan")[0].count("Exchange") == 1


def test_numbering_places_rows_once(spark):
    """Rows are shuffled for the order alone: not for the join with the few starts, and no file of that shuffle stays."""
    df = spark.range(3000).select((F.col("id") % 3).alias("k"), F.hash("id").alias("x"), "id", F.lit("unused").alias("u"))
    frame = number_rows(df, ["k"], ["x", "id"], ts="id", partitions=5, columns=["x"])
    assert frame.df.columns == ["k", "id", "x", "pos"]
    plan = _plan(frame.df)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    want = pd.DataFrame(df.collect(), columns=df.columns).sort_values(["k", "x", "id"])
    want["pos"] = want.groupby("k").cumcount()
    assert sorted(map(tuple, frame.df.collect())) == sorted(map(tuple, want[["k", "id", "x", "pos"]].to_numpy().tolist()))


def test_shuffles_of_settled_rows_are_deleted(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return set(disk.getAllFiles().mkString("|").split("|"))

    before, setting = files(), spark.conf.get(CLEANUP)
    settle(spark.range(5000).repartition(3, "id"))
    deadline = time.monotonic() + 20
    while any("shuffle_" in f for f in files() - before) and time.monotonic() < deadline:
        time.sleep(0.2)
    assert not any("shuffle_" in f for f in files() - before)
    assert spark.conf.get(CLEANUP) == setting
