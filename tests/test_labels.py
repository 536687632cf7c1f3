"""Labels against brute force over whole series, with short buckets."""

import numpy as np
import pytest
from conftest import random_walk

from tidemark.operators import extremum as X
from tidemark.operators import labels as L


def brute_crossing(close, price, horizon, t):
    n, out = len(close), np.full(len(close), np.nan)
    for i in range(n - horizon):
        level = close[i] * (1 + t / 100)
        for k in range(horizon):
            p = price[i + 1 + k]
            if (p > level) if t > 0 else (p < level):
                out[i] = k
                break
    return out


@pytest.mark.parametrize("horizon", [1, 7, 40])
def test_first_crossing(make_frame, column_of, horizon):
    c = random_walk(160, 21, 0.05)
    h, lo = c + 0.4, c - 0.3
    f = make_frame({"a": {"close": c, "high": h, "low": lo}, "b": {"close": c[:9], "high": h[:9], "low": lo[:9]}}, 8)
    wanted = {"up": ("close", "high", 2.0), "down": ("close", "low", -1.0), "far": ("close", "high", 50.0)}
    out = L.first_crossings(f, horizon, wanted)
    np.testing.assert_array_equal(column_of(out, "up"), brute_crossing(c, h, horizon, 2.0))
    np.testing.assert_array_equal(column_of(out, "down"), brute_crossing(c, lo, horizon, -1.0))
    assert np.isnan(column_of(out, "far")).all()
    assert out.df.count() == 169


def test_zero_threshold_is_an_error(make_frame):
    with pytest.raises(ValueError):
        L.first_crossings(make_frame({"a": {"close": [1.0]}}), 3, {"x": ("close", "close", 0.0)})


def test_first_cross_labels(make_frame, column_of):
    c = random_walk(160, 22)
    f = make_frame({"a": {"close": c, "high": c + 0.5, "low": c - 0.5}}, 16)
    out, names = L.first_cross_labels(f, ["close", "high", "low"], "low", [1.0, 2.0], 0.5, 20, ["d1", "d2"])
    for n, t in (("d1", 1.0), ("d2", 2.0)):
        first, second = brute_crossing(c, c - 0.5, 20, -t), brute_crossing(c, c + 0.5, 20, t * 0.5)
        want = ~np.isnan(first) & (np.isnan(second) | (first <= second))
        np.testing.assert_array_equal(column_of(out, n).astype(bool), want)
    assert out.df.columns == [*f.df.columns, "d1", "d2"]


def test_horizon_labels(make_frame, column_of):
    c = random_walk(80, 23)
    f = make_frame({"a": {"close": c, "high": c + 0.3, "low": c - 0.3}}, 16)
    out, names = L.horizon_labels(f, 10)
    top = np.array([(c[i + 1:i + 11] + 0.3).max() if i + 10 < 80 else np.nan for i in range(80)])
    rel = 100 * (top - c) / c
    np.testing.assert_allclose(column_of(out, "high_max_10"), np.where(rel < 0, 0, rel), atol=1e-9)
    np.testing.assert_array_equal(column_of(out, "high_15").astype(bool), np.nan_to_num(rel, nan=-1) >= 1.5)
    np.testing.assert_array_equal(column_of(out, "high_03").astype(bool), np.nan_to_num(rel, nan=9) <= 0.3)
    low = np.array([(c[i + 1:i + 11] - 0.3).min() if i + 10 < 80 else np.nan for i in range(80)])
    down = 100 * (low - c) / c
    np.testing.assert_array_equal(column_of(out, "low_10").astype(bool), np.nan_to_num(down, nan=9) <= -1.0)
    np.testing.assert_array_equal(column_of(out, "low_05").astype(bool), np.nan_to_num(down, nan=-9) >= -0.5)
    assert len(names) == 23


def split_extremes(x, level, tol):
    """Our own plain description: take the highest value of a stretch, check both sides, split."""
    label, work = np.zeros(len(x), bool), [(0, len(x) - 1)]
    while work:
        lo, hi = work.pop()
        if lo > hi or np.isnan(x[lo:hi + 1]).all():
            continue
        m = lo + int(np.nanargmax(x[lo:hi + 1]))

        def near(share):
            thr = x[m] - share * abs(x[m])
            left = [i for i in range(lo, m) if x[i] < thr]
            right = [i for i in range(m + 1, hi + 1) if x[i] < thr]
            return (left[-1] if left else None), (right[0] if right else None)

        left, right = near(level)
        if left is not None and right is not None:
            tl, tr = near(tol)
            label[tl + 1:tr] = True
        if left is not None and left > lo:
            work.append((lo, left))
        if right is not None and right < hi:
            work.append((right, hi))
    return label


def wave(n, seed, size, nulls=0.0):
    rng = np.random.default_rng(seed)
    x = 100 + 6 * np.sin(np.arange(n) / size) + np.cumsum(rng.normal(0, 0.3, n))
    x = np.round(x, 1)
    if nulls:
        x[rng.random(n) < nulls] = np.nan
    return x


@pytest.mark.parametrize("group", [3, 8192])
@pytest.mark.parametrize("size,seed", [(3, 1), (25, 2), (60, 3)])
def test_extremes(make_frame, column_of, monkeypatch, size, seed, group):
    monkeypatch.setattr(X, "GROUP_BUCKETS", group)
    x = wave(400, seed, size, 0.03)
    f = make_frame({"a": {"x": x}, "b": {"x": x[:3]}}, bucket_rows=16)
    specs = [X.ExtremumLabel("t1", True, 0.02, 0.004), X.ExtremumLabel("t2", True, 0.06, 0.03),
             X.ExtremumLabel("t3", True, 0.06, 0.01), X.ExtremumLabel("b1", False, 0.03, 0.01)]
    out, _ = X.extremum_labels(f, "x", specs)
    out = out.with_df(out.df.persist())
    for s in specs:
        want = split_extremes(x if s.top else -x, s.level, s.tolerance)
        np.testing.assert_array_equal(column_of(out, s.name).astype(bool), want, err_msg=s.name)
    assert sum(split_extremes(x, 0.02, 0.004)) > 0
    assert out.df.count() == 403


def test_extremes_of_the_published_series(make_frame, column_of):
    x = np.array([10., 40, 30, 70, 90, 50, 60, 30, 9] * 2)
    f = make_frame({"a": {"x": x}}, bucket_rows=4)
    out, _ = X.top_or_bottom(f, "x", "top", 0.5, [0.2], ["top"])
    np.testing.assert_array_equal(column_of(out, "top").astype(bool), split_extremes(x, 0.5, 0.1))


def test_preset_names(make_frame):
    x = wave(120, 5, 10)
    out, names = X.tops_and_bottoms(make_frame({"a": {"close": x}}, bucket_rows=32))
    assert len(names) == 100 and {"top1_025", "bot5_3", "top3_15"} <= set(names)
    assert out.df.count() == 120
