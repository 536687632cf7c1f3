"""Exact deduplication as a stateful stream against brute force."""

import hashlib
import uuid
from collections import defaultdict
from string import ascii_lowercase, ascii_uppercase

import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact

LOWER = str.maketrans(ascii_uppercase, ascii_lowercase)
LONG = "Long text é " * 60_000


def plain(text):
    return (text or "").translate(LOWER)


def sample(shift=0):
    texts = ["A b", "a B", "a  b", None, "", "Ä", "ä", "a b\n", LONG, LONG.upper().lower(), LONG[:-1] + "x", "A b"]
    return [(shift + i, t) for i, t in enumerate(texts)] + [(None, "a b"), (None, "lonely"), (shift + 3, "A B"), (shift + 11, "A b"), (None, None)]


def want(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[plain(t)].append(-1 if i is None else i)
    out = []
    for i, t in rows:
        g = groups[plain(t)]
        top = max(g)
        out.append((-1 if i is None else i, top, len(g), hashlib.sha256(plain(t).encode()).hexdigest()))
    return sorted(out)


def write(spark, path, rows, mode="append"):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("text", "doc_id", "'x' AS digest", "1 AS row", "'f' AS file", "0 AS id")
    df.repartition(3).write.mode(mode).parquet(path)


def got(df):
    rows = df.collect()
    ids = [(-1 if r[0] is None else r[0], -1 if r.keep_id is None else r.keep_id, r.group_size) for r in rows]
    return rows, ids


def one_stays(rows):
    by_group = defaultdict(int)
    for r in rows:
        by_group[(r.keep_id, r.digest, r.group_size)] += r.kept
        assert not r.kept or r.id == r.keep_id
    return set(by_group.values()) == {1}


def test_whole_table(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    write(spark, path, sample())
    rows, ids = got(exact.deduplicate(spark, path))
    assert sorted((*x, r.text_sha256) for x, r in zip(ids, rows)) == want(sample())
    assert sum(r.kept for r in rows) == len({plain(t) for _, t in sample()})


def test_single_file_and_empty_table(spark, tmp_path):
    path = tmp_path / "docs.parquet"
    write(spark, str(path), sample())
    rows = exact.deduplicate(spark, str(sorted(path.glob("part-*"))[0])).collect()
    assert 0 < len(rows) < len(sample())
    empty = str(tmp_path / "none.parquet")
    write(spark, empty, [])
    assert exact.deduplicate(spark, empty).collect() == []


@pytest.mark.parametrize("batch_bytes", [1, exact.BATCH_BYTES])
def test_state_goes_on(spark, tmp_path, batch_bytes):
    """New files meet the state of earlier ones, whatever the size of a micro-batch; nothing expires."""
    path = str(tmp_path / "docs.parquet")
    all_rows, folder = [], str(tmp_path / f"state-{uuid.uuid4().hex}")
    for k in range(3):
        rows = sample(100 * (2 - k))
        write(spark, path, rows)
        all_rows += rows
        found = exact.ExactDedup(spark, path, folder, batch_bytes=batch_bytes).absorb()
        rows, ids = got(found.decisions())
        assert sorted((*x, r.digest) for x, r in zip(ids, rows)) == want(all_rows)
        assert one_stays(rows)
    assert all(spark.conf.get(k, None) != v for k, v in exact._STORE.items())


@pytest.mark.parametrize("weak", [lambda t: F.lit("same"), lambda t: F.length(t).cast("string")])
def test_bytes_decide(spark, tmp_path, weak):
    """Texts of one digest are compared in full; groups of different texts are split."""
    path = str(tmp_path / "docs.parquet")
    write(spark, path, sample())
    rows, ids = got(exact.ExactDedup(spark, path, digest=weak).absorb().decisions())
    assert sorted(ids) == sorted(x[:3] for x in want(sample()))
    assert sum(r.kept for r in rows) == len({plain(t) for _, t in sample()})


def test_hot_group_and_no_python(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    write(spark, path, [(i, "Same Text" if i % 3 == 0 else f"text {i}") for i in range(3000)])
    found = exact.deduplicate(spark, path)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    rows = found.collect()
    assert sum(r.group_size == 1000 and r.keep_id == 2997 for r in rows) == 1000
    assert sum(r.kept for r in rows) == 2001
