"""Language identification by cross parsing.

The labelled text of each language becomes a suffix automaton, which holds all its substrings.  A
text is parsed from left to right into the longest phrases that occur in the language's text; the
language that needs the fewest phrases, each priced by what naming a place in its text costs, wins.

Rules
    * Letters are taken in lower case; a run of anything else is one space.  Characters that no
      learned text has are phrases alone.  The ``max_alphabet`` most frequent ones are looked up in a
      dense table, rarer ones in a sorted list; this changes the time only.
    * Texts are parsed in blocks of ``block`` characters, so that a very long text is many short
      parses; a phrase ends where its block ends.
    * NULL texts and texts without a letter are ``und`` with score 0; so is every text if nothing was
      learned.  Ties go to the first language in order.  The score is the share of the runner-up's
      cost in the sum of the two costs, 0.5 to 1; with one language it is 1.
    * Other columns than text do not enter a prediction and pass through.

Fitting takes at most ``sample_docs`` labelled documents of each language, in the order of a hash of
their ids, and of their text at most ``language_chars`` characters: documents of up to ``doc_chars``
characters come first and are taken whole while they fit, then longer ones with the ``doc_chars``
characters from their first letter on.  Every document is classified, over its whole text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, lean, row_runs

SAMPLE_DOCS = 64
DOC_CHARS = 8_000
LANGUAGE_CHARS = 16_000
MAX_ALPHABET = 1_000
BLOCK = 1_024
#: Blocks that are parsed side by side.
LANES = 4_096
#: Bytes of text that a worker takes at once: a character costs it some 40 bytes while its row is parsed.
RUN_BYTES = 1 << 19

_tables: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: its lower case, and whether it is a letter."""
    if not _tables:
        # filled from iterators: lists of all code points would take some 150 MB in every worker
        low = np.fromiter((ord(y) if len(y := chr(c).lower()) == 1 else c for c in range(0x110000)), np.int32, 0x110000)
        _tables["x"] = low, np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _tables["x"]


def normalised(codes: np.ndarray) -> np.ndarray:
    """Lower-case letters and single spaces (32) of a text's code points."""
    low, letter = _letters()
    out = np.where(letter[codes], low[codes], 32)
    gap = out == 32
    return out[~(gap & np.concatenate([[False], gap[:-1]]))] if len(out) else out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence: for each state, the next state by symbol."""
    link, length, edges = [-1], [0], [{}]
    last = 0
    for c in symbols:
        cur = len(link)
        length.append(length[last] + 1)
        link.append(0)
        edges.append({})
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = cur
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(link)
                length.append(length[p] + 1)
                link.append(link[q])
                edges.append(dict(edges[q]))
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return edges


class Parser:
    """Cross parsing against the automata of several languages at once.

    Symbols are numbers below ``width``, 0 for unknown characters, and from ``width`` on for rare ones.  In the joint table a missing
    transition leads to where the symbol leads from the start of a new phrase, and is marked; a
    symbol that starts no phrase leads to a state of its own that every symbol leaves with a mark.
    Transitions by rare symbols are a sorted list of state and symbol.
    """

    def __init__(self, samples: dict[str, str], block: int = BLOCK, max_alphabet: int = MAX_ALPHABET):
        self.languages, self.block = sorted(samples), block
        texts = {k: normalised(code_points(v)) for k, v in samples.items()}
        seen = Counter()
        for t in texts.values():
            seen.update(t.tolist())
        found = [c for c, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))]
        alphabet, rare = found[:max_alphabet], found[max_alphabet:]
        self.width = width = 1 << len(alphabet).bit_length()
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[alphabet] = np.arange(1, len(alphabet) + 1)
        self.symbol[rare] = width + np.arange(len(rare))
        self.rare = len(rare)
        # an automaton has at most twice as many states as its text has characters
        total = sum(2 * len(texts[k]) + 2 for k in self.languages) * width
        self.bits = 30 if total < 1 << 30 else 60
        mark, kind = 1 << self.bits, np.int32 if self.bits == 30 else np.int64
        self.start, base, steps = [], 0, []
        # of what is set aside, only the rows that are filled in take memory
        table = np.empty((total // width, width), kind)
        self.rare_root = np.zeros((len(self.languages), self.rare), np.int64)
        for k, name in enumerate(self.languages):
            edges = automaton(self.symbol[texts[name]].tolist())
            alone = len(edges)
            # where nothing else is said, a symbol starts a new phrase; if it starts none, it is one alone
            joint = table[base : base + alone + 1]
            joint[:] = (base + alone) * width + mark
            for c, to in edges[0].items():
                if c < width:
                    joint[:, c] = (base + to) * width + mark
            self.rare_root[k] = (base + alone) * width + mark
            for s, e in enumerate(edges):
                for c, to in e.items():
                    if c < width:
                        joint[s, c] = (base + to) * width
                    else:
                        steps.append(((base + s) * self.rare + c - width, (base + to) * width))
                        if s == 0:
                            self.rare_root[k, c - width] = (base + to) * width + mark
            del edges
            self.start.append((base + alone) * width)
            base += alone + 1
        self.table = table[:base].ravel()
        self.rare_keys, self.rare_to = np.array(sorted(steps), np.int64).reshape(-1, 2).T
        # a phrase names a place in its language's text
        self.price = np.array([np.log2(max(2, len(texts[k]))) for k in self.languages])

    def _rare_step(self, state: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """What the joint table would hold for rare symbols."""
        key = state.astype(np.int64) // self.width * self.rare + rare
        at = np.minimum(np.searchsorted(self.rare_keys, key), len(self.rare_keys) - 1)
        return np.where(self.rare_keys[at] == key, self.rare_to[at], self.rare_root[:, rare])

    def phrases(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Phrases of each block under each language; blocks come longest first."""
        n, kind = len(starts), self.table.dtype.type
        state = np.repeat(np.array(self.start, kind)[:, None], n, 1)
        count = np.zeros((len(self.start), n), np.int32)
        live = np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1 if n else 1), "right")
        low = kind((1 << self.bits) - 1)
        for t, m in enumerate(live.tolist()):
            symbol = symbols[starts[:m] + t]
            rare = np.flatnonzero(symbol >= self.width) if self.rare else ()
            if len(rare):
                got = self.table.take(state[:, :m] + np.where(symbol < self.width, symbol, 0))
                got[:, rare] = self._rare_step(state[:, rare], symbol[rare] - self.width)
            else:
                got = self.table.take(state[:, :m] + symbol)
            count[:, :m] += (got >> self.bits).astype(np.int32)
            state[:, :m] = got & low
        return count

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(cost by language and text, texts that have a letter)."""
        low, letter = _letters()
        out = np.zeros((len(self.languages), len(texts)))
        off = np.concatenate([[0], np.cumsum([len(t or "") for t in texts])])
        codes = code_points("".join(t or "" for t in texts))
        is_letter = letter[codes]
        norm = np.where(is_letter, low[codes], 32)
        del codes
        row = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(off))
        has = np.bincount(row, is_letter, len(texts)) > 0
        gap = ~is_letter
        again = np.zeros(len(gap), bool)
        again[1:] = gap[1:] & gap[:-1] & (row[1:] == row[:-1])
        symbols, row = self.symbol[norm[~again]], row[~again]
        del norm, is_letter, gap, again
        size = np.bincount(row, minlength=len(texts))
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        blocks = -(-size // self.block)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(blocks)[:-1]]), blocks)
        starts = first[owner] + nth * self.block
        lengths = np.minimum(self.block, size[owner] - nth * self.block)
        order = np.argsort(-lengths, kind="stable")
        for a in range(0, len(order), LANES):
            o = order[a : a + LANES]
            found = self.phrases(symbols, starts[o], lengths[o])
            for k in range(len(self.languages)):
                out[k] += np.bincount(owner[o], found[k], len(texts))
        return out * self.price[:, None], has


_parsers: dict[tuple, Parser] = {}


def parser(samples: tuple[tuple[str, str], ...], block: int, max_alphabet: int) -> Parser:
    """One parser per worker and sample."""
    key = (samples, block, max_alphabet)
    if key not in _parsers:
        _parsers.clear()
        _parsers[key] = Parser(dict(samples), block, max_alphabet)
        give_back()
    return _parsers[key]


def fit(labelled: DataFrame, lang: str = "lang", text: str = "text", order: Column | None = None, sample_docs: int = SAMPLE_DOCS, doc_chars: int = DOC_CHARS, language_chars: int = LANGUAGE_CHARS) -> dict[str, str]:
    """Sample text by language; at most sample_docs * doc_chars characters of each reach the driver."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    long = F.length(text) > doc_chars
    part = F.when(long, F.substring(F.regexp_extract(text, r"(?s)\p{L}.*", 0), 1, doc_chars)).otherwise(F.col(text))
    rows = rows.select(F.col(lang).alias("lang"), long.alias("long"), part.alias("text"), (order if order is not None else F.xxhash64(text)).alias("order"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("long", "order", "text"))
    out: dict[str, str] = {}
    for r in rows.withColumn("nth", nth).where(F.col("nth") <= sample_docs).orderBy("lang", "nth").collect():
        have = out.setdefault(r.lang, "")
        if not have or len(have) + len(r.text) < language_chars:
            out[r.lang] = have + " " + r.text if have else r.text
    return out


def predict(documents: DataFrame, samples: dict[str, str], text: str = "text", block: int = BLOCK, max_alphabet: int = MAX_ALPHABET) -> DataFrame:
    """``documents`` with lang_pred and score."""
    sample = tuple(sorted(samples.items()))
    names = sorted(samples)
    schema = documents.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    at = documents.columns.index(text)

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = parser(sample, block, max_alphabet)
        for batch in batches:
            for part in row_runs(batch, at, RUN_BYTES):
                # the rows that were sent out last are still held; as copies they do not hold the whole batch
                columns = [pa.concat_arrays([c]) for c in part.columns]
                cost, has = p.costs(columns[at].to_pylist())
                if not names:
                    label, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                else:
                    best = cost.argmin(0)
                    top = cost[best, np.arange(len(best))]
                    cost[best, np.arange(len(best))] = np.inf
                    second = cost.min(0) if len(names) > 1 else np.full(len(best), np.inf)
                    with np.errstate(invalid="ignore"):
                        score = np.where(has, np.where(np.isinf(second), 1.0, second / (top + second)), 0.0)
                    label = [names[b] if h else "und" for b, h in zip(best.tolist(), has.tolist())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(label, pa.string()), pa.array(score, pa.float64())], schema=pa.schema([*part.schema, pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]))
                del part, columns
            del batch

    return documents.mapInArrow(lean(classify), schema)


def identify(documents: DataFrame, folds: int = 3, held_out: int = 1, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score; documents of the held-out fold of crc32(doc_id) are not learned from."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds
    rows = documents.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    learn = documents.where(~F.coalesce(fold == held_out, F.lit(True)))
    samples = fit(learn, order=F.xxhash64("doc_id"), **options)
    return predict(rows, samples).drop("text")
