import numpy as np
import pytest

SPACE = " \t\n\x0b\x0c\r"


@pytest.fixture
def docs_of(spark):
    """documents from (doc_id, text, lang, source) rows, n_chars counted, and an extra column whose name clashes."""

    def build(rows, extra=True):
        data = [(*(list(r) + [None] * (4 - len(r))), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        return df.selectExpr("*", "'x' AS size", "1 AS bucket", "2 AS node", "3 AS line", "4 AS did") if extra else df

    return build


def words(text):
    out, cur = [], ""
    for c in text or "":
        if c in SPACE:
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
    return out + ([cur] if cur else [])


def prose(seed, n_docs, vocabulary=40, longest=60):
    """Random texts with copies, near copies and shared passages."""
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(vocabulary)]
    passage = [vocab[i] for i in rng.integers(0, vocabulary, 20)]
    texts = []
    for i in range(n_docs):
        kind = rng.random()
        w = [vocab[j] for j in rng.integers(0, vocabulary, rng.integers(0, longest))]
        if texts and kind < 0.25:
            w = words(texts[rng.integers(0, len(texts))])
            if w and kind < 0.18:
                w[rng.integers(0, len(w))] = f"new{i}"
        elif kind < 0.5:
            k = rng.integers(0, len(w) + 1)
            w = w[:k] + passage + w[k:]
        texts.append((" " if i % 3 else "\n").join(w))
    return texts
