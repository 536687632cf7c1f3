"""Prefix trie of conversations against brute force."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import trie

SCHEMA = "turn long, conv_id long, role string, text string, depth int, k1 string, conv string"


def table(spark, rows):
    return spark.createDataFrame([(t, c, r, x, 7, "k", "c") for c, t, r, x in rows], SCHEMA)


def brute(rows):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[: d - 1])].add(tuple(turns[:d]))

    totals = {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        below = [totals[x] for x in children[node]]
        totals[node] = (sum(x[0] for x in below) + (not below), saved + sum(x[1] for x in below))
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(node)))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(m), len(node), parent, len(m), len(children[node]), *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda x: x[:2])


def sample(seed, convs=60, words=2, longest=12):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        if rng.random() < 0.15:
            continue
        for t in range(rng.integers(1, longest)):
            text = [None, "", "é", "hello " * 3][rng.integers(0, 4)] if rng.random() < 0.3 else f"w{rng.integers(0, words)}"
            rows.append((int(c), None if rng.random() < 0.1 else int(t), ["user", None, "assistant"][int(t) % 3], text))
    rows += rows[:5] + [(None, 1, "user", "nobody"), (10**15, 0, "user", "x" * 200_000)]
    # copies of one conversation, a common first turn
    rows += [(1000 + c, t, "user", f"copy {t}") for c in range(40) for t in range(9)]
    return [rows[i] for i in rng.permutation(len(rows))]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda x: x[:2])


@pytest.mark.parametrize(("shard_rows", "levels", "queue_rows"), [(trie.SHARD_ROWS, trie.LEVELS, trie.QUEUE_ROWS), (6, 3, 4), (40, 1, 2)])
def test_trie(spark, shard_rows, levels, queue_rows):
    rows = sample(1)
    assert got(trie.prefix_trie(table(spark, rows), shard_rows, levels, queue_rows)) == brute(rows)


def test_one_long_conversation(spark):
    """A conversation with most of the turns spans blocks of levels."""
    rows = [(5, t, "user", f"t{t % 7}") for t in range(400)] + [(6, t, "user", f"t{t % 7}") for t in range(300)] + sample(2, 20)
    assert got(trie.prefix_trie(table(spark, rows), 30, 50, 3)) == brute(rows)


def test_empty_and_turnless(spark):
    assert got(trie.prefix_trie(table(spark, []))) == []
    # conversation 1 loses its only turns and gets none
    rows = [(c, 0, "user", "a") for c in range(1, 5)]
    assert got(trie.prefix_trie(table(spark, rows))) == brute(rows)
    assert got(trie.prefix_trie(table(spark, [(None, 0, "user", "a")]))) == []


def test_queue_spills_and_keeps_order():
    rng = np.random.default_rng(3)
    queue, want = trie.MessageQueue(64), defaultdict(lambda: np.zeros(2, np.int64))
    for _ in range(50):
        conv, totals = rng.integers(0, 500, 40), rng.integers(0, 9, (40, 2))
        queue.push(conv, totals)
        for c, x in zip(conv, totals):
            want[c] += x
    assert queue.spills > 3 and queue.rows <= 64
    seen = defaultdict(lambda: np.zeros(2, np.int64))
    for last in range(9, 510, 10):
        conv, totals = queue.pop(last)
        assert not len(conv) or conv.min() > last - 10 and conv.max() <= last
        for c, x in zip(conv, totals):
            seen[c] += x
    assert {c: tuple(x) for c, x in seen.items()} == {c: tuple(x) for c, x in want.items()}


def test_digests_over_chunks():
    n = 1000
    one = pa.RecordBatch.from_arrays([pa.array([1] * n), pa.array([2] * n), pa.array(range(n))], ["k1", "k2", "conv"])
    chunks = list(trie._chunks(one.slice(a, 300) for a in range(0, n, 300)))
    assert [c.num_rows for c in chunks] == [1, 1, 1, 1]
    rows = [r for b in trie._digests(iter(chunks)) for r in b.to_pylist()]
    assert [r["ends_sha256"] for r in rows] == [hashlib.sha256(",".join(map(str, range(n))).encode()).hexdigest()]
