"""Top-k search and embedding near-duplicates against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import topk, vectors

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int, dim string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "i", 1, "d") for i, v in rows], SCHEMA)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def sample(seed, n, dim=6):
    rng = np.random.default_rng(seed)
    rows = [(int(i), np.float32(rng.normal(0, 1, dim)).tolist()) for i in rng.permutation(n)]
    for i in range(0, n, 3):
        rows.append((n + i, (np.array(rows[i][1]) * 2).tolist()))
        rows.append((2 * n + i, rows[i][1]))
        rows.append((4 * n + i, (np.array(rows[i][1], np.float32) + np.float32(rng.normal(0, 0.1, dim))).tolist()))
    rows += [(5 * n, None), (5 * n + 50, []), (5 * n + 2, [None] * dim), (5 * n + 3, [float("nan")] + [1.0] * (dim - 1)), (5 * n + 4, [float("inf")] * dim), (5 * n + 6, [0.0] * dim), (5 * n + 7, [1.0, 2.0]), (5 * n + 10, [1.0, 2.0]), (rows[0][0], rows[1][1])]
    return rows


@pytest.mark.parametrize(("candidate_rows", "query_rows"), [(8192, 4096), (20, 3)])
def test_top_k(spark, candidate_rows, query_rows):
    rows = sample(1, 60)
    got = topk.top_k(table(spark, rows), F.col("vec_id") % 10 == 0, 5, candidate_rows=candidate_rows, query_rows=query_rows)
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got.collect())
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if usable(v)]
    want = []
    for q, a in ints:
        if q % 10 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints if i != q and len(a) == len(b))
            want.append((q, [(i, -s) for s, i in scores]))
    for q, s in want:
        mine = [(v, x) for k, _, v, x in got if k == q]
        if sum(k == q for k, _ in want) == 1:
            assert mine == s[:5]
    assert {g[0] for g in got} == {q for q, s in want if s}


def test_bounds_stop_early_and_lose_nothing():
    rng = np.random.default_rng(2)
    centre = rng.integers(-300, 300, (20, 8))
    x = (centre[rng.integers(0, 20, 5000)] + rng.integers(-3, 4, (5000, 8))).astype(float)
    ids = rng.permutation(5000)
    out = topk.search_block(x[:40], ids[:40], x, ids, 5)
    score = x[:40] @ x.T
    for i in range(40):
        score[i, i] = -np.inf
        best = np.lexsort((ids, -score[i]))[:5]
        assert [(a, b) for q, a, b in out if q == ids[i]] == [(int(ids[j]), int(score[i, j])) for j in best]


def test_top_k_of_nothing(spark):
    df = table(spark, sample(1, 5))
    assert topk.top_k(df.where("vec_id < 0"), F.lit(True)).count() == 0
    assert topk.top_k(df, F.lit(False)).count() == 0
    assert topk.top_k(table(spark, [(0, [1.0]), (1, None)]), F.lit(True)).count() == 0


def brute_links(rows, threshold):
    root = {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    good = [usable(v) and any(v) for _, v in rows]
    links = [0] * len(rows)
    for i, (a, x) in enumerate(rows):
        for j in range(i):
            b, y = rows[j]
            if good[i] and good[j] and len(x) == len(y) and np.dot(x, y) / np.sqrt(np.dot(x, x)) / np.sqrt(np.dot(y, y)) >= threshold:
                links[i] += 1
                links[j] += 1
                r, s = find(a), find(b)
                root[max(r, s)] = min(r, s)
    return sorted((i, n, find(i), find(i) == i) for (i, _), n in zip(rows, links))


@pytest.mark.parametrize(("cell_rows", "block_rows", "dim"), [(8192, 8192, 6), (25, 10, 6), (10, 7, 3)])
def test_near_duplicates(spark, cell_rows, block_rows, dim):
    rows = [(i, v) for i, v in sample(4, 50, dim)[:-1]] + [(900 + i, [1.0 + 0.001 * i] + [0.5] * (dim - 1)) for i in range(60)]
    got = sorted(tuple(r) for r in vectors.near_duplicates(table(spark, rows), cell_rows=cell_rows, block_rows=block_rows).collect())
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert got == brute_links(exact, 0.9)


def test_near_duplicates_of_nothing(spark):
    df = table(spark, [(3, None), (4, [0.0, 0.0])])
    assert sorted(tuple(r) for r in vectors.near_duplicates(df).collect()) == [(3, 0, 3, True), (4, 0, 4, True)]
    assert vectors.near_duplicates(df.where("vec_id > 9")).count() == 0


def test_near_duplicates_move_each_vector_once(spark, monkeypatch):
    """Vectors are shuffled and kept once, however many blocks meet; copies are one row."""
    rng = np.random.default_rng(5)
    rows = [(i, np.float32(rng.normal(0, 1, 8)).tolist()) for i in range(200)]
    rows += [(200 + i, rows[i][1]) for i in range(50)] + [(300 + i, rows[7][1]) for i in range(50)]
    kept = {}

    def keep(df, name, was=vectors.keep):
        plan = df._jdf.queryExecution().executedPlan().toString()
        kept[name] = plan, was(df, name)
        return kept[name][1]

    monkeypatch.setattr(vectors, "keep", keep)
    got = sorted(tuple(r) for r in vectors.near_duplicates(table(spark, rows), cell_rows=40, block_rows=10).collect())
    assert got == brute_links(rows, 0.9)
    plan, blocks = kept["blocks"]
    assert plan.count("Exchange") == 1 and blocks.count() >= 20
    sizes = blocks.select(F.sum(F.length("data")), F.sum(F.length("ids")), F.max(F.length("ids"))).first()
    assert tuple(sizes) == (200 * 8 * 4, 200 * 8, 10 * 8)
    plan, found = kept["found"]
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Shuffle" not in plan
    # edges of a forest of each task, one count per vector and task
    assert found.where("other is null").groupBy(F.spark_partition_id(), "id").count().where("count > 1").isEmpty()


def test_blocks_far_apart_do_not_meet(spark):
    rng = np.random.default_rng(6)
    rows = [(i, np.float32(np.eye(6)[i % 6] + rng.normal(0, 0.15, 6)).tolist()) for i in range(300)]
    got = sorted(tuple(r) for r in vectors.near_duplicates(table(spark, rows), cell_rows=20, block_rows=20).collect())
    assert got == brute_links(rows, 0.9)


@pytest.mark.parametrize("kind", ["even", "few components", "one cone"])
def test_links_by_the_larger_components_first(monkeypatch, kind):
    """All links and no others, whether the first look leaves few pairs or is given up."""
    monkeypatch.setattr(vectors, "PRODUCT", 3000)
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (300, 40))
    if kind == "few components":
        x[:, 5:] *= 0.05
    if kind == "one cone":
        x += 3
    x[200:] = x[:100] + rng.normal(0, 0.45, (100, 40)) * np.abs(x[:100]).mean()
    x = vectors._unit(x)
    threshold = 0.9
    cosine = x @ x.T
    want = (cosine >= threshold) & ~np.eye(300, dtype=bool)
    weight = rng.integers(1, 4, 300)
    n, _, edges = vectors.links_between(x, x, weight, weight, threshold, True)
    n_b = vectors.links_between(x, x, weight, weight, threshold, True)[1]
    assert (n + n_b == want @ weight).all() and all(want[e] for e in edges) and 0 < want.sum()
    a, b = x[:150], x[150:]
    n_a, n_b, edges = vectors.links_between(a, b, weight[:150], weight[150:], threshold, False)
    assert (n_a == want[:150, 150:] @ weight[150:]).all() and (n_b == want[:150, 150:].T @ weight[:150]).all()
    assert all(want[i, 150 + j] for i, j in edges)
