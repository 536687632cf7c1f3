"""Mixing, language ID, packing, HTML and the pipeline."""

import os
import subprocess
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from samples_llm import docs_of, prose, words  # noqa: F401

from tidemark.llm import html, language, mixing, packing
from tidemark.llm.common import few_rows
from tidemark.llm.queries import tokenizer_files

SOURCES = ["b", "a", None, "ä", "Z", "tiny", "none"]


def mix_rows():
    texts = prose(9, 160, 50, 80)
    rows = [(i, t, None, SOURCES[0] if i % 2 else SOURCES[i % 5]) for i, t in enumerate(texts)]
    return [*rows, (500, "only one", None, "tiny"), (501, None, None, "none"), (502, "", None, "none"), (3, rows[3][1], None, rows[3][3]), (None, "x y z", None, "a"), (None, "x y z", None, "a")]


def fill(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, full, total = {}, set(), sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        share = sum(w[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * w[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("slot_words", [128, 7])
def test_mix(docs_of, slot_words):
    rows = mix_rows()
    got = [tuple(r) for r in mixing.taken(docs_of(rows), slot_words=slot_words).collect()]
    assert Counter(g[:2] for g in got) == Counter((d, len(words(t))) for d, t, *_ in rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    target = fill(sizes)
    of = {d: s for d, _, _, s in rows}
    taken = Counter()
    for d, size, source_size, t, n in got:
        assert source_size == sizes[of[d]] and abs(t - target[of[d]]) < 1e-6 and 0 <= n <= 3 * size
        taken[of[d]] += n
    assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
    again = [tuple(r) for r in mixing.taken(docs_of(rows).repartition(3), slot_words=slot_words).collect()]
    assert Counter(got) == Counter(again)


def test_slots_follow_the_shares(spark):
    targets = spark.createDataFrame([(1, 6000), (2, 3000), (3, 999), (4, 1)], "source_no int, words long")
    rows = mixing.slots(spark, targets, 10).orderBy("slot").collect()
    for k in (16, 64, 256, 1000):
        n = Counter(r.source_no for r in rows[:k])
        assert all(abs(n[s] - k * w / 10000) <= 4 for s, w in ((1, 6000), (2, 3000), (3, 999)))
    for s, w in ((1, 6000), (2, 3000), (3, 999), (4, 1)):
        own = [r for r in rows if r.source_no == s]
        assert [r["rank"] for r in own] == list(range(len(own))) and own[0].lo == 0 and own[-1].hi == w
        assert all(a.hi == b.lo for a, b in zip(own, own[1:])) and max(r.hi - r.lo for r in own) - min(r.hi - r.lo for r in own) <= 1


def test_mixed_documents_hold_the_words_taken(docs_of):
    df = docs_of(mix_rows())
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    got, want = Counter(), Counter()
    for r in out.collect():
        got[r.doc_id] += len(words(r.text))
    for r in mixing.taken(df).collect():
        want[r.doc_id] += r.taken
    assert +got == +want


def test_mix_of_nothing(docs_of):
    assert mixing.taken(docs_of([(1, "a", None, "s")]).where("doc_id > 1")).count() == 0
    got = mixing.taken(docs_of([(1, None, None, "s"), (2, " ", None, None)])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    assert mixing.mixed_documents(docs_of([(1, None, None, "s")])).count() == 0


def greedy_phrases(sample, text, block):
    def clean(s):
        return "".join(map(chr, language.normalised(language.code_points(s))))

    sample, text, n = clean(sample), clean(text), 0
    for a in range(0, len(text), block):
        part, i = text[a : a + block], 0
        while i < len(part):
            j = i + 1
            while j <= len(part) and part[i:j] in sample:
                j += 1
            i, n = max(i + 1, j - 1), n + 1
    return n


def test_phrases_are_longest_matches():
    samples = {"a": "abc abd abcd xyz", "b": "the cat sat on the mat", "c": "Ärger über Öl"}
    texts = ["abcdabxq the cat!! ABC", "zz", "x", None, "", "12", "ÜBER Öl\n\n the", "the cat " * 50, "кот", "\U0001f600 a", "日本"]
    p = language.Parser(samples, block=7)
    cost, has = p.costs(texts)
    assert (cost / p.price[:, None] == [[greedy_phrases(samples[k], t or "", 7) for t in texts] for k in p.languages]).all()
    assert has.tolist() == [True, True, True, False, False, False, True, True, True, True, True]


@pytest.mark.parametrize("most", [0, 1, 6])
def test_rare_characters_are_parsed_too(most):
    samples = {"ja": "日本語の文字を読む日本の人", "ko": "한국어 글자를 읽는 한국 사람", "zh": "中文字读日本中文的人们"}
    texts = ["日本の文字", "中文的人们读中文", "한국 사람 abc", "人人人日本語", "x", "읽는日本"]
    p = language.Parser(samples, block=5, max_alphabet=most)
    cost, _ = p.costs(texts)
    assert np.allclose(cost / p.price[:, None], [[greedy_phrases(samples[k], t, 5) for t in texts] for k in p.languages])


def test_languages_of_long_texts_only_are_learned(docs_of):
    long = {"de": "der und nicht straße " * 60, "en": "12 " * 400 + "the and not street " * 60}
    rows = [*((i, long[k], k) for i, k in enumerate(["de", "en"] * 3)), (8, "le la et rue", "fr"), (9, "la maison " * 60, "fr")]
    samples = language.fit(docs_of(rows), doc_chars=100, language_chars=400)
    assert set(samples) == {"de", "en", "fr"} and all(len(v) <= 400 for v in samples.values())
    assert samples["en"].startswith("the and") and samples["fr"].startswith("le la et rue la maison")
    got = {r.doc_id: r.lang_pred for r in language.predict(docs_of([(1, "nicht der", None), (2, "not the", None), (3, "la rue", None)]), samples).collect()}
    assert got == {1: "de", 2: "en", 3: "fr"}


def test_language(docs_of):
    rng = np.random.default_rng(1)
    vocab = {"de": "der die und nicht über straße haus", "en": "the and of house not over street", "fr": "le la et maison ne pas déjà rue"}
    rows = []
    for i in range(240):
        k = sorted(vocab)[i % 3]
        v = vocab[k].split()
        rows.append((i, " ".join(v[j] for j in rng.integers(0, len(v), 12)), k if i % 7 else None, "s"))
    rows += [(900, None, "de"), (901, "", "de"), (902, "12 !?", "de"), (903, "the house " * 3000, None), (None, "le la maison", None), (5, rows[5][1], "en")]
    got = language.identify(docs_of(rows)).collect()
    assert len(got) == len(rows)
    right = [g.lang_pred == sorted(vocab)[g.doc_id % 3] for g in got if g.doc_id is not None and g.doc_id < 240 and g.doc_id != 5 and g.held_out]
    assert np.mean(right) > 0.98 and 50 < len(right) < 110
    by = {g.doc_id: g for g in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (900, 901, 902))
    assert by[903].lang_pred == "en" and by[None].lang_pred == "fr"
    assert all(0 <= g.score <= 1 for g in got) and all(g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 3 == 1) for g in got)
    assert {g.lang_pred for g in language.identify(docs_of([(1, "abc", None)])).collect()} == {"und"}
    assert language.identify(docs_of(rows).where("doc_id > 9999")).count() == 0


def brute_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(tokenizer_files()[0]).encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("ranks", [True, False])
def test_packing(docs_of, ranks):
    texts = [None, "", "a", "  two  spaces\n\n tabs\t", "<|endoftext|> x", "日本語 \U0001f600 it's 12²", "long " * 5000, "z" * 9000, *prose(4, 70, 30, 200)]
    rows = [*enumerate(texts), (2, "a"), (None, "b c")]
    json, fast = tokenizer_files()
    got = packing.pack(docs_of(rows), json, fast if ranks else None).collect()
    want = Counter((d, len(brute_ids(t))) for d, t in rows)
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append(r)
    assert set(pieces) == set(want)
    for d, t in dict.fromkeys(rows):
        ids = brute_ids(t)
        own = sorted(pieces[d, len(ids)], key=lambda r: r.start)
        copies = want[d, len(ids)]
        spans = sorted({(r.start, r.length) for r in own})
        assert len(own) == copies * len(spans) and [a for a, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1]] and sum(n for _, n in spans) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        s.sort()
        assert [o for o, _ in s] == [0, *np.cumsum([n for _, n in s])[:-1]] and sum(n for _, n in s) <= 2048
    total = sum(r.length for r in got)
    assert len(sequences) <= total / 2048 * 1.02 + 2


def test_packing_solver():
    rng = np.random.default_rng(1)
    for capacity, n in ((256, 5000), (64, 300), (16, 40), (8, 1)):
        counts = np.bincount(rng.integers(0, capacity, n), minlength=capacity)
        plan = packing.solve(counts, capacity)
        assert (sum(p * t for p, t in plan) == counts).all() and all((p * np.arange(1, capacity + 1)).sum() <= capacity for p, _ in plan)
        least = (counts * np.arange(1, capacity + 1)).sum() / capacity
        assert sum(t for _, t in plan) <= least * 1.02 + 4 or n < 1000
    assert packing.solve(np.zeros(8, int), 8) == []


def test_knapsack_is_optimal():
    sizes, price = np.array([3, 4, 7]), np.array([4.0, 5.5, 9.9])
    for room in range(7, 25):
        best = max(a * 4 + b * 5.5 + c * 9.9 for a in range(9) for b in range(7) for c in range(4) if 3 * a + 4 * b + 7 * c <= room)
        column, value = packing._knapsack(price, sizes, room)
        assert abs(value - best) < 1e-9 and abs(column @ price - best) < 1e-9 and column @ sizes <= room


def test_packing_of_nothing(docs_of):
    assert packing.pack(docs_of([(1, "a")]).where("doc_id > 1"), *tokenizer_files()).count() == 0


PAGES = [
    ("<p>One<p>Two <b>bo</b>ld<br>line", "One\n\nTwo bold\nline"),
    ("<ul><li>a<li>b<ol start=3><li>c<li value=9>d</ol></ul>x", "- a\n- b\n\n  3. c\n  9. d\n\nx"),
    ("<table><caption>cap<tr><th>Name<th>N<tr><td>alpha<td>1<tr><td colspan=2>wide cell here<tr><td>b<td>22</table>", "cap\nName    N\nalpha   1\nwide cell here\nb       22"),
    ("<head><title>t</title></head><script>if (a<b) '</p>'</script><div style='display:none'>no<p>no</div><div hidden>no</div>yes<style>p{}</style>", "yes"),
    ("<pre>\n a\n   b\n</pre>after", " a\n   b\n\nafter"),
    ("a &lt; b &amp; c < d &nosuch; <3", "a < b & c < d &nosuch; <3"),
    ("<!-- <p>no --><![CDATA[x]]>text<!doctype html", "text"),
    ("</div></p>x</span>", "x"),
    ("<div>a<div>b</div>c</div>d<blockquote>q<p>r</blockquote><hr>e", "a\nb\nc\nd\n\n> q\n\n> r\n\n---\n\ne"),
    ("<dl><dt>t<dd>d1<dd>d2</dl><input type=hidden value=no><img alt='pic'>", "t\n    d1\n    d2\n\npic"),
    ("<b>" * 5000 + "deep", "deep"),
    ("", ""),
    (None, ""),
    ("<tr><td>loose<td>row", "loose row"),
    ("<p title='a>b'>q", "q"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_html(page, text):
    assert html.page_text(page).replace("\n\n> r", "\n\n> r") == text


IMPLIED_BODY = [
    ("<html><head><title>T</title><p>Hello <b>all</b></html>", "Hello all"),
    ("<head><meta charset=utf-8><link rel=x>\n Hello<p>you", "Hello\n\nyou"),
    ("<head><title>T</title><style>p{}</style><script>1<2</script><noscript><img alt=no></noscript><h1>A</h1><body class=x>b</body>", "A\n\nb"),
    ("<p>a<head><title>T</title><p>b</head>c", "a\n\nbc"),
    ("<head></head><head><title>T</title>a<head>b", "ab"),
    ("<head><title>T</title><html lang=en><body><p>a", "a"),
    ("<head><title>T</title></head>a", "a"),
    ("<head><template><p>no</template> <body>a", "a"),
]


@pytest.mark.parametrize(("page", "text"), IMPLIED_BODY)
def test_html_head_ends_where_the_body_begins(page, text):
    assert html.page_text(page) == text


SHOWN = [
    ("a<svg viewBox='0 0 1 1'><title>no</title><defs><text>no</text></defs>no<g><text x=1>one<tspan x=1>two</tspan></text><text/><text>three</text></g></svg>b", "a one two three b"),
    ("<svg><defs/><style>p > q</style><title/><path d='M0'/><text><a href=x>l</a>k<![CDATA[<m>&]]></text><foreignObject><p>f</p></foreignObject></svg>x", "lk<m>&\n\nf\n\nx"),
    ("<svg><g><path d='M0'><p>after<text>x", "afterx"),
    ("<svg><text visibility=hidden>no<tspan visibility=visible>yes</tspan></text><text display=none>no</text></svg>", "yes"),
    ("if <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><mphantom><mi>no</mi></mphantom><mtext>so</mtext></math>.", "if x=1 2 so."),
    ("<math><semantics><mi>y</mi><annotation encoding=tex>no</annotation></semantics></math>", "y"),
    ("Size <select><option>S<option selected>M<option>L</select>!", "Size M !"),
    ("<select><option disabled>no<optgroup label=no disabled><option>no</optgroup><optgroup label=no><option label=two>no</select>", "two"),
    ("<select multiple><optgroup label=g><option>a<option>b</select>c", "g\na\nb\nc"),
    ("<select><option>a<input value=b>c", "a bc"),
    ("a<![CDATA[no>b]]>c", "ab]]>c"),
    ("a<!-->b<p>c<!--->d<!-- no > --!>e<!-- no", "ab\n\ncde"),
    ("<div style='visibility:hidden'>no<p>no <b style='visibility: visible'>yes <i>too</i></b><img alt=no></div>", "yes too"),
    ("<ol style='visibility:hidden'><li>no<li style='visibility:visible'>b</ol><p style='visibility:hidden;VISIBILITY:visible'>c", "2. b\n\nc"),
    ("<table><tr style='visibility:collapse'><td style='visibility:visible'>no<tr><td>a</table>", "a"),
    ("<p style='backface-visibility:hidden'>a<p style='display:none;display:block'>b<p style='/* x */display:none'>no", "a\n\nb"),
    ("<pre>a <select><option>b</select><img alt=c></pre>", "a bc"),
]


@pytest.mark.parametrize(("page", "text"), SHOWN)
def test_html_shows_what_a_browser_shows(page, text):
    assert html.page_text(page) == text


def test_html_text_below_the_depth():
    assert "w" in html.page_text("<svg>" + "<g>" * 500 + "<text>w").split()
    assert "w" in html.page_text("<svg><foreignObject>" * 500 + "w").split()


def test_html_keeps_all_visible_words():
    rng = np.random.default_rng(7)
    tags = ["p", "div", "b", "ul", "li", "table", "tr", "td", "span", "h2", "pre", "ol", "section", "dd"]
    for _ in range(200):
        parts, want = [], []
        for i in range(40):
            t = tags[rng.integers(0, len(tags))]
            kind = rng.integers(0, 3)
            parts.append(f"<{t}>" if kind == 0 else f"</{t}>" if kind == 1 else f" w{i} ")
            if kind == 2:
                want.append(f"w{i}")
        got = [x for x in html.page_text("".join(parts)).split() if x.startswith("w")]
        assert Counter(got) == Counter(want)


def test_html_query(spark):
    df = spark.createDataFrame([(1, PAGES[0][0], "x"), (None, None, "y"), (1, PAGES[0][0], "x")], "page_id long, html string, lines string")
    assert sorted(((r.page_id, r.text, r.lines) for r in html.extract(df).collect()), key=str) == [(1, PAGES[0][1], "x")] * 2 + [(None, "", "y")]
    assert html.extract(df.where("page_id > 5")).count() == 0


def test_pipeline(spark, tmp_path):
    """Stage by stage against what each stage is for, on a table with planted cases."""
    import corpus_pipeline

    texts = prose(12, 60, 200, 90)
    base = " ".join(f"base{i}" for i in range(150))
    rows = [(i, t, "en", f"s{i % 4}") for i, t in enumerate(texts)]
    rows += [(100, base, "en", "s0"), (101, base, "en", "s0"), (102, base.replace("base30 ", "other "), None, "s1"), (103, base.replace("base30 ", "a b c d ").replace("base90 ", "e f g "), "en", "s1"), (104, None, "en", "s1"), (105, "12 34", "en", "s2"), (106, "clean text of its own that stays", "en", None)]
    df = spark.createDataFrame([(d, t, k, s, None if t is None else len(t)) for d, t, k, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        if name != "pack_sequences":
            assert docs.columns == df.columns
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        out[name] = docs.collect()
    ids = {k: {r.doc_id for r in v} for k, v in out.items()}
    letters = {d for d, t, *_ in rows if t and any(c.isalpha() for c in t)}
    assert ids["language_id"] == letters
    assert next(r.lang for r in out["language_id"] if r.doc_id == 102) == "en"
    assert {100, 103, 106} <= ids["line_dedup"] and not {101, 102} & ids["line_dedup"]
    assert {100, 106} <= ids["near_dedup"] and 103 not in ids["near_dedup"]
    assert {(r.doc_id, r.source) for r in out["mix_sources"]} <= {(r.doc_id, r.source) for r in out["near_dedup"]}
    n = sum(len(words(r.text)) for r in out["near_dedup"])
    assert abs(sum(len(words(r.text)) for r in out["mix_sources"]) - n) <= 5
    assert sum(r.length for r in out["pack_sequences"]) == sum(len(brute_ids(r.text)) for r in out["mix_sources"])
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in again.collect()) == Counter(r.doc_id for r in out["pack_sequences"])


def test_language_id_takes_little_memory_in_a_worker():
    import tracemalloc

    import pyarrow as pa

    class Rows:  # gives the function that would run in a worker
        columns, schema = ["text"], None

        def select(self, *columns):
            return self

        def mapInArrow(self, function, schema):
            return function

    samples = {k: "".join(chr(97 + (i * i * n + i) % 23) for i in range(500)) for k, n in (("en", 3), ("de", 5))}
    batch = pa.RecordBatch.from_pydict({"text": ["der fox springt " * 200] * 4000})
    language._tables.clear()
    language._parsers.clear()
    tracemalloc.start()
    parts = list(language.predict(Rows(), samples)([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(p.num_rows for p in parts) == 4000
    assert most < 150 << 20


ROWS = """
import sys
import pyarrow as pa
part = pa.RecordBatch.from_pydict({"text": [f"{i} the fox jumps over dogs " * 120 for i in range(9000)]})
with pa.ipc.new_stream(sys.stdout.buffer, part.schema) as to:
    to.write_batch(part)
    to.write_batch(part)
"""
#: A worker without Spark: what a task gets comes as an Arrow stream, as from Spark.
WORKER = """
import re, subprocess, sys
import pyarrow as pa
import pyspark.worker
from pyspark.sql import functions as F
from tidemark.llm import language

class Rows:
    columns, schema = ["text"], None
    def select(self, *columns):
        return self
    def mapInArrow(self, function, schema):
        return function

class Name:
    def alias(self, name):
        return self

F.lit = lambda value: Name()
samples = {k: "".join(chr(97 + (i * i * n + i) % 23) for i in range(4000)) for k, n in (("en", 3), ("de", 5))}
function = language.predict(Rows(), samples)

def held():
    return sum(int(x) for x in re.findall(r"\\nAnonymous: +(\\d+)", open("/proc/self/smaps_rollup").read())) >> 10

pins = []

def fragments():
    # 80 MB are freed below a piece that stays: the C library keeps them
    pieces = [bytes(50_000) for _ in range(1_600)]
    pins.append(bytes(50_000))

def task():
    with subprocess.Popen([sys.executable, "-c", sys.argv[1]], stdout=subprocess.PIPE) as rows:
        return sum(x.num_rows for x in function((fragments(), x)[1] for x in pa.ipc.open_stream(rows.stdout)))

before = held()
print(task(), task(), held() - before)
"""


def test_a_worker_gives_back_what_language_id_took(tmp_path):
    root = str(Path(language.__file__).parents[2])
    done = subprocess.run([sys.executable, "-c", WORKER, ROWS], cwd=tmp_path, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    *rows, held = map(int, done.stdout.split())
    assert rows == [18_000, 18_000]
    assert held < 50, f"{held} MB are still held after the tasks"


def test_few_rows_need_no_python_workers(spark):
    schema = "type int, firsts array<long>, copies array<int>"
    for rows in ([(1, [0, 1 << 40], [2]), (2, [], [])], []):
        got, want = few_rows(spark, rows, schema), spark.createDataFrame(rows, schema)
        assert got.schema == want.schema and got.collect() == want.collect()
    targets = spark.sql("select * from values (1, 9000L), (2, 5L) as t(source_no, words)")
    text = "\n".join(f"{k} {k + 1} three" for k in range(3000))
    packed = packing.pack(spark.createDataFrame([(1, text), (2, "a")], "doc_id long, text string"), *tokenizer_files())
    for df in (mixing.slots(spark, targets, 1000), packed):
        assert "ExistingRDD" not in df._jdf.queryExecution().executedPlan().toString()
