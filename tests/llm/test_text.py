"""Substring, line and near-duplicate removal against brute force."""

import hashlib

import numpy as np
import pytest
from samples_llm import docs_of, prose, words  # noqa: F401

from tidemark.llm import lines, minhash, substring

TEXTS = [None, "", "  \n\t ", "one", "one", "a b c d", "A B c d", "x " * 400, "x " * 400, "x " * 30 + "y", *prose(1, 60), "Wort eins zwei", "tab\tand\x0bvt"]


def brute_substring(rows, window):
    least = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            least[k] = min(least.get(k, d), d)
    out = []
    for d, t in rows:
        w = words(t)
        gone = {j for i in range(len(w) - window + 1) if least[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize(("group", "frequent"), [(4 << 20, 400), (300, 400), (300, 1)])
def test_substring(docs_of, monkeypatch, group, frequent):
    monkeypatch.setattr(substring, "FREQUENT", frequent)
    rows = [*enumerate(TEXTS), (3, TEXTS[20]), (5, TEXTS[7])]
    got = substring.remove_repeats(docs_of(rows), group_bytes=group, bucket_bytes=group)
    assert {"size", "bucket", "node"} <= set(got.columns)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got.collect()), key=str)
    assert got == brute_substring(rows, 13)


def test_frequent_runs_change_routes_only(docs_of, monkeypatch):
    monkeypatch.setattr(substring, "LEAST_IN_PIECE", 1)
    rows = [(i, f"begin{i} " + "p1 p2 p3 p4 p5 p6 p7 p8 p9 p10 p11 p12 p13 p14 p15 p16 " + f"end{i}") for i in range(90)]
    got = substring.remove_repeats(docs_of(rows), group_bytes=400, bucket_bytes=400)
    assert len(substring.frequent_runs(docs_of(rows), "text", 4, 64)) == 13
    assert sorted(r.n_removed for r in got.collect()) == [0] + [16] * 89


def test_substring_null_ids_and_empty_table(docs_of):
    text = " ".join(f"v{i}" for i in range(15))
    got = {(r.doc_id, r.n_removed) for r in substring.remove_repeats(docs_of([(None, text), (7, text), (9, None)])).collect()}
    assert got == {(None, 15), (7, 0), (9, 0)}
    assert substring.remove_repeats(docs_of([(1, "a")]).where("doc_id > 1")).count() == 0


def near_lines(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_lines(rows, least):
    every = [(d, i, words(x)) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if words(x)]
    out = []
    for d, i, w in every:
        out.append((d, i, not any((e, j) < (d, i) and (v == w or min(len(v), len(w)) >= least and near_lines(v, w)) for e, j, v in every)))
    return sorted(out)


LINES = [
    "a b c d e f g\nshort line\na b c d e f g\nb c d e f g", "a b X d e f g\nshort  line\nshort lane", "a a a a a a\na a a a a\na a a a", "\n\n", None, "", "x b c d e f g\n" * 3,
    "a b c d e f g h\nq r s t u", "q r s t u v\nq r z t u v", "one\none", "k " * 300 + "z\n" + "k " * 299 + "z", "k " * 150 + "y " + "k " * 149 + "z", "q r s t\nq r s t u w",
]


def test_lines(docs_of):
    rows = list(enumerate(LINES))
    got = sorted(tuple(r) for r in lines.line_decisions(docs_of(rows)).collect())
    assert got == brute_lines(rows, 5)


def test_lines_random(docs_of):
    rows = [(i, t.replace(" ", "\n", 1)) for i, t in enumerate(prose(5, 80, 4, 9))]
    rows += [(100 + i, t) for i, t in enumerate(prose(6, 40, 30, 30))]
    got = sorted(tuple(r) for r in lines.line_decisions(docs_of(rows)).collect())
    assert got == brute_lines(rows, 5)


def test_lines_one_hot_half(docs_of):
    rows = [(i, f"page number {i} of the long book") for i in range(120)]
    got = lines.line_decisions(docs_of(rows)).where("kept").collect()
    assert [r.did for r in got] == [0]


def test_lines_as_documents(docs_of):
    df = docs_of([(2, "same line here now ok\nown words of this one"), (1, "x\nsame line here now ok"), (None, "x\n\ny"), (3, None), (4, "")])
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(df).collect()}
    assert got == {1: ("x\nsame line here now ok", 2, 0), 2: ("own words of this one", 2, 1), None: ("\ny", 3, 1), 3: (None, 0, 0), 4: ("", 1, 0)}
    assert set(df.columns) <= set(lines.dedup_lines(df).columns)
    assert lines.line_decisions(df.where("doc_id > 9")).count() == 0


def test_lines_plan_has_no_python(docs_of, capsys):
    lines.line_decisions(docs_of([(1, "a b c d e f")])).explain()
    assert "Python" not in capsys.readouterr().out


def sets_of(t, k=5):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, percent):
    """Rows of one id are one node."""
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    s = [sets_of(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if both and 100 * both >= percent * len(s[i] | s[j]):
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return sorted(((d, len(s[i]), find(d), find(d) == d) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(docs_of, percent):
    base = [f"b{i}" for i in range(120)]
    close = []
    for i in range(40):  # a chain and a star around one text
        w = list(base)
        w[3 * i] = f"c{i}"
        close.append(" ".join(w))
    for i in range(1, 12):
        close.append(" ".join(base[2 * i :] + [f"t{j}" for j in range(2 * i)]))
    rows = [*enumerate(TEXTS), *[(200 - i, t) for i, t in enumerate(close)], (4, "totally other words in this one"), (150, TEXTS[20])]
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs_of(rows), percent).collect()), key=str)
    assert got == brute_components(rows, percent)


def test_one_large_group(docs_of, monkeypatch):
    """Copies of one text that mostly link with nothing share buckets; the few that do link are found, over many blocks."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(8)
    base, texts = [f"b{i}" for i in range(150)], []
    for i in range(500):
        w = list(base)
        for j in rng.choice(150, 6, replace=False):
            w[j] = f"x{i}_{j}"
        texts.append(w)
        if i % 25 == 0:
            texts.append(w[:-3] + [f"y{i}"])
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    got = sorted((tuple(r) for r in minhash.near_duplicates(docs_of(rows), 85).collect()), key=str)
    assert got == brute_components(rows, 85)
    assert 15 < sum(not r[3] for r in got) < 200


def test_block_links_join_components_only():
    """Links within and between blocks against all pairs; those inside a component are not sent out."""
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.int64) for _ in range(60)]
    sets = sorted(sets + [np.union1d(sets[i], [99]) for i in range(0, 60, 2)], key=len)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    sketch = minhash.sketches(owner, np.concatenate(sets).view(np.uint64), len(sets))
    nodes = np.arange(len(sets)) * 10
    block = lambda a, b: (nodes[a:b], nodes[a:b], sketch[a:b], sets[a:b])
    found = minhash.links_between(block(0, 90), None, 70) + minhash.links_between(block(0, 40), block(40, 90), 70)

    def roots(links):
        root = {int(x): int(x) for x in nodes}
        for _ in range(len(root)):
            for a, b in links:
                root[a] = root[b] = min(root[a], root[b])
        return root

    every = [(10 * i, 10 * j) for i in range(90) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 70 * len(np.union1d(sets[i], sets[j]))]
    assert set(found) | {(b, a) for a, b in found} <= set(every) | {(b, a) for a, b in every}
    assert roots(found) == roots(every) and len(minhash.links_between(block(0, 90), None, 70)) < 90
    one = (nodes[:90], np.zeros(90, np.int64), sketch[:90], sets[:90])
    assert minhash.links_between(one, None, 70) == []


def test_near_duplicates_nulls_and_empty(docs_of):
    df = docs_of([(None, "a b c d e f"), (8, "a b c d e f"), (3, "A b c d e f"), (9, None)])
    got = {tuple(r) for r in minhash.near_duplicates(df).collect()}
    assert got == {(None, 2, None, True), (8, 2, 3, False), (3, 2, 3, True), (9, 0, 9, True)}
    assert minhash.near_duplicates(df.where("doc_id > 100")).count() == 0


def test_sketches_rule_out_no_link(spark):
    """Pairs at and around the threshold, of small and large sets."""
    import numpy as np

    rng = np.random.default_rng(2)
    sets, pairs = [], []
    for n in (1, 5, 20, 100, 700, 4000):
        for d in sorted({0, 1, n // 12, n // 7, n // 4, n // 2}):
            x = rng.integers(0, 1 << 63, n + d, dtype=np.uint64)
            sets += [x[:n], x[d:]]
            pairs.append((len(sets) - 2, len(sets) - 1, n, n, n - d if n > d else 0))
    bits = minhash.sketches(np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets), len(sets)).view(np.int64)
    for a, b, n, m, both in pairs:
        assert sum(int(x).bit_count() for x in (bits[a] ^ bits[b]).view(np.uint64)) <= n + m - 2 * both
    df = spark.createDataFrame([(bits[a].tolist(), bits[b].tolist(), n, m, both) for a, b, n, m, both in pairs], "a array<long>, b array<long>, n int, m int, both int")
    for percent in (80, 85):
        got = df.withColumn("may", minhash._may_be_similar("a", "b", "n", "m", percent)).collect()
        assert all(r.may for r in got if 100 * r.both >= percent * (r.n + r.m - r.both))
        assert any(not r.may for r in got if r.n == 700) and any(not r.may for r in got if r.n == 20)


def test_bands_find_similar_sets():
    import numpy as np

    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(200):
        a = rng.integers(0, 2**63, 200, dtype=np.uint64)
        b = np.concatenate([a[16:], rng.integers(0, 2**63, 16, dtype=np.uint64)])  # 184 of 216 in common
        owner = np.repeat([0, 1], 200)
        _, _, _, _, bands = minhash.signatures(owner, np.concatenate([np.sort(a), np.sort(b)]), 2)
        missed += not (bands[0] == bands[1]).any()
    assert missed == 0


def test_components(spark):
    from tidemark.llm.common import components

    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (103, 102), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
