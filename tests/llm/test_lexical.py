"""Ranked lexical search against brute force."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    counted = [(i, Counter(terms(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, n_terms = len(counted), sum(x[2] for x in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    merged = defaultdict(Counter)
    for i, t in items:
        merged[i].update(terms(t))
    out = []
    for item, wanted in merged.items():
        scores = []
        for doc, c, n in counted:
            m = 100 - 75 + 75 * n * n_docs // n_terms
            s = 0
            for t, times in wanted.items():
                if c[t]:
                    s += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scores.append((-s, doc is None, doc or 0))
        out += [(item, r + 1, None if none else doc, -s) for r, (s, none, doc) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def sample(seed, n_docs=200, n_items=20):
    rng = np.random.default_rng(seed)
    vocab = ["The", "of", "é", "日本", "x1", "Ünd"] + [f"w{i}" for i in range(300)]
    share = 1 / np.arange(1, len(vocab) + 1)
    def text(n):
        return ["-", " ", "\n", ". "][rng.integers(0, 4)].join(rng.choice(vocab, n, p=share / share.sum()))
    docs = [(int(i), text(rng.integers(1, 60))) for i in rng.permutation(n_docs)]
    docs += docs[:3] + [(None, docs[5][1]), (None, None), (9001, None), (9002, ""), (9003, " .-\x00 \x7f"), (9004, "the " * 100_000), (9005, "Z" * 300_000)]
    items = [(int(i), text(rng.integers(1, 25))) for i in range(n_items)]
    return docs, items + [(None, "the w5 of"), (3, "w7 w7 extra"), (900, None), (901, "..."), (902, "nowhere"), (903, "z" * 300_000)]


def got(spark, docs, items, **options):
    d = spark.createDataFrame([(x, i, 1, 2, 3) for i, x in docs], "text string, doc_id long, block int, term int, item_id int").repartition(3)
    i = spark.createDataFrame([(i, x, 5, "b") for i, x in items], "item_id long, text string, doc_id int, bundle string")
    return sorted((tuple(r) for r in search.search(d, i, **options).select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize(
    "options",
    [{}, {"bands": (0.005, 0.02, 0.1, 0.3), "bundle_items": 4, "block_docs": 16, "k": 3}, {"bands": (), "bundle_items": 1, "block_docs": 7, "map_bits": 3, "k": 1}],
)
def test_search(spark, options):
    docs, items = sample(4)
    want = brute(docs, items, options.get("k", 10))
    assert got(spark, docs, items, **options) == want


def test_ties_and_frequent_words(spark):
    """Equal scores go by id over blocks and stages; a word of all documents adds where it must."""
    docs = [(i, "the same words here" if i % 2 else "the other words") for i in range(120)]
    items = [(1, "the same"), (2, "words"), (3, "the other the"), (4, "none of it")]
    assert got(spark, docs, items, block_docs=9, bands=(0.1, 0.6)) == brute(docs, items, 10)


def test_empty(spark):
    docs, items = sample(5, 10, 3)
    assert got(spark, [], items) == [] and got(spark, docs, []) == [] and got(spark, [(1, "-"), (2, None)], items) == []


def test_bounds_shed_accumulators(spark):
    """Once an item has k documents that later terms cannot reach, frequent terms open no new accumulators."""
    import pyarrow as pa

    add = search._stage(1000, 50_000, 2, False)
    docs = np.arange(50, dtype=np.uint16)
    ones, sizes = np.ones(50, np.uint32), np.full(50, 50, np.uint32)
    left = pa.Table.from_pylist([{"bundle": 0, "block": 7, "items": [0, 0, 0], "docs": [3, 4, 5], "scores": [9 * 10**9, 8 * 10**9, 10]}])
    entries = [{"item": 0, "weight": 100, "admit": False, "floor": 8 * 10**9}, {"item": 1, "weight": 100, "admit": True, "floor": 0}]
    right = pa.Table.from_pylist([{"bundle": 0, "block": 7, "docs": docs.tobytes(), "counts": ones.tobytes(), "sizes": sizes.tobytes(), "entries": entries}])
    row = add(left, right).to_pylist()[0]
    impact = 10**9 // (1000 + 8 * (25 + 75 * 50 * 1000 // 50_000))
    assert [x for x in zip(row["items"], row["docs"], row["scores"]) if x[0] == 0] == [(0, 3, 9 * 10**9 + 100 * impact), (0, 4, 8 * 10**9 + 100 * impact)]
    assert sum(i == 1 for i in row["items"]) == 50 and row["best_items"] == [0, 0, 1, 1] and row["best_docs"] == [3, 4, 0, 1]
