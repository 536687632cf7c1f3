"""Packing token sequences by column generation for the cutting-stock problem.

Documents become ids; every full ``capacity`` of ids is a sequence of its own, and what is left of
each document is an item.  Item lengths, rounded up to a grain, form a histogram of at most
capacity / grain types.  A linear program covers the histogram by patterns (sets of items that fit a
sequence); new patterns come from a knapsack over the dual prices until none pays.  The program's
values are rounded down, the few items left over are filled in by size, and the documents of each
type, ranked by a hash, take the slots of the patterns in turn.

Rules
    * A NULL or empty text is the end id alone.  Rows that repeat an id are separate documents.
    * A piece is a run of ids of one document: the full ones from its start, then the rest.
    * ``sequence_id`` counts full pieces after the packed ones; offsets in a sequence have no gap.
    * Empty tables give no rows; other columns are ignored.

Scale: the driver sees the histogram (capacity / grain numbers) and the patterns, nothing that grows
with the rows.  Ranks come from groups of (type, salt), with salts in proportion to the rows, and one
count per group; sequences are windows over at most ``capacity`` pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import few_rows, keep, lean, row_runs

CAPACITY = 2048
GRAIN = 8
END_ID = 1
#: Column generation stops within this share of the linear program's optimum.
SLACK = 5e-4
#: Ranks are counted in groups of about so many rows.
GROUP_ROWS = 2048
#: Bytes of text whose ids a worker makes at once.
RUN_BYTES = 1 << 20


class Encoder:
    """Ids of texts under a byte-level BPE file.

    ``ranks`` may name the same vocabulary as a list of ranks: the ids are the same and found
    faster.  Texts that might hold the name of a special token go to the tokenizer itself, which
    is loaded with the first one.
    """

    def __init__(self, path: str, ranks: str | None = None):
        self.path, self.tokenizer, self.fast = path, None, None
        if ranks:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def ids(self, text: str) -> bytes:
        if self.fast is None or "<|" in text:
            if self.tokenizer is None:
                from tokenizers import Tokenizer

                self.tokenizer = Tokenizer.from_file(self.path)
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text).astype("<u4", copy=False).tobytes()


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, ranks: str | None = None) -> Encoder:
    """One encoder per worker and file."""
    if (path, ranks) not in _encoders:
        _encoders[path, ranks] = Encoder(path, ranks)
    return _encoders[path, ranks]


def _fill(left: np.ndarray, sizes: np.ndarray, capacity: int, whole: bool) -> Iterator[tuple[np.ndarray, float]]:
    """Patterns that take the largest items that fit, each used until it no longer can be."""
    left = left.copy()
    while (left > 1e-9).any():
        p, room = np.zeros(len(sizes)), capacity
        for i in range(len(sizes) - 1, -1, -1):
            if left[i] > 1e-9 and sizes[i] <= room:
                p[i] = min(np.ceil(left[i]), room // sizes[i])
                room -= int(p[i]) * sizes[i]
        used = p > 0
        share = left[used] // p[used] if whole else left[used] / p[used]
        times = share.min()
        left -= times * p
        if not whole:
            left[np.flatnonzero(used)[share <= times]] = 0
        yield p, times


def _start(need: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A basis and its values: each filled pattern stands for a type that it uses up, so the matrix is triangular."""
    n = len(sizes)
    patterns, use = np.diag((capacity // sizes).astype(float)), np.zeros(n)
    left, done = need.copy(), np.zeros(n, bool)
    for p, times in _fill(need, sizes, capacity, False):
        left = left - times * p
        i = int(np.flatnonzero((p > 0) & ~done)[np.argmin(left[(p > 0) & ~done] / p[(p > 0) & ~done])])
        patterns[:, i], use[i] = p, times
        done[i] = True
        done |= left <= 1e-9
    return patterns, use


def _times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a @ x without a threaded library, which may hang in a process that has started another one."""
    return (a * x[None, :]).sum(1)


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan elimination with row exchange."""
    n = len(a)
    w = np.hstack([a, np.eye(n)])
    for i in range(n):
        k = i + int(np.abs(w[i:, i]).argmax())
        if k != i:
            w[[i, k]] = w[[k, i]]
        w[i] /= w[i, i]
        factor = w[:, i].copy()
        factor[i] = 0
        w -= factor[:, None] * w[i][None, :]
    return w[:, n:].copy()


def solve(counts: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used, so that all items are packed.

    ``counts[s]`` items have size s + 1; a pattern holds numbers of items by size and fits ``capacity``.
    """
    sizes = np.flatnonzero(counts) + 1
    need = counts[sizes - 1].astype(float)
    if not len(sizes):
        return []
    n = len(sizes)
    patterns, use = _start(need, sizes, capacity)
    inverse = _inverse(patterns)
    use = np.maximum(_times(inverse, need), 0)
    least = (need * sizes).sum() / capacity
    for r in range(rounds):
        if use.sum() <= least * (1 + SLACK):
            break
        if r % 200 == 199:  # rounding errors of the updates go
            inverse = _inverse(patterns)
            use = np.maximum(_times(inverse, need), 0)
        column, value = _knapsack(inverse.sum(0), sizes, capacity)
        if value <= 1 + SLACK:  # the program's optimum is at most this share below
            break
        way = _times(inverse, column)
        up = way > 1e-9
        ratio = np.full(n, np.inf)
        ratio[up] = use[up] / way[up]
        out = int(ratio.argmin())
        step = ratio[out]
        use -= step * way
        use[out] = step
        patterns[:, out] = column
        row = inverse[out] / way[out]
        inverse -= way[:, None] * row[None, :]
        inverse[out] = row
    times = np.floor(use + 1e-9).astype(np.int64)
    chosen, left = [], counts[sizes - 1].astype(np.int64)
    for k in np.argsort(-use):
        p = patterns[:, k].round().astype(np.int64)
        t = min(int(times[k]), int((left[p > 0] // p[p > 0]).min()))
        if t > 0:
            left -= t * p
            chosen.append((p, t))
    # what rounding left over
    chosen += [(p.astype(np.int64), int(t)) for p, t in _fill(left.astype(float), sizes, capacity, True)]
    out = []
    for p, t in chosen:
        full = np.zeros(len(counts), np.int64)
        full[sizes - 1] = p
        out.append((full, t))
    return out


def _knapsack(price: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """Numbers of items of the best value that fit, by dynamic programming over the room.

    best[j][c] is the best value of up to 2**j items in room c, made of two halves of 2**(j-1) items.
    """
    one = np.zeros(capacity + 1)
    np.maximum.at(one, sizes, price)
    item = np.full(capacity + 1, -1)
    item[sizes] = np.arange(len(sizes))
    run = np.maximum.accumulate(one)
    at = np.where(one >= run, np.arange(capacity + 1), 0)
    item = item[np.maximum.accumulate(at)]
    best, halves = [run], []
    shift = np.arange(capacity + 1)[:, None] - np.arange(capacity + 1)[None, :]
    inside = shift >= 0
    while True:
        b = best[-1]
        sums = np.where(inside, b[np.abs(shift)] + b[None, :], -1.0)
        half = sums.argmax(1)
        nxt = sums[np.arange(capacity + 1), half]
        if nxt[-1] <= b[-1] + 1e-12:
            break
        best.append(nxt)
        halves.append(half)
    column = np.zeros(len(sizes))
    parts = [(len(best) - 1, capacity)]
    while parts:
        j, room = parts.pop()
        if j == 0:
            if run[room] > 0 and item[room] >= 0:
                column[item[room]] += 1
        else:
            h = int(halves[j - 1][room])
            parts += [(j - 1, h), (j - 1, room - h)]
    return column, float(best[-1][-1])


def slot_table(patterns: list[tuple[np.ndarray, int]]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(type, first rank, copies of the type in the pattern, first sequence, times) by type and rank; number of sequences."""
    rows, used, sequence = [], {}, 0
    for p, t in patterns:
        for s in np.flatnonzero(p).tolist():
            rows.append((s, used.get(s, 0), int(p[s]), sequence, t))
            used[s] = used.get(s, 0) + int(p[s]) * t
        sequence += t
    return rows, sequence


def pack(documents: DataFrame, tokenizer: str, ranks: str | None = None, capacity: int = CAPACITY, grain: int = GRAIN, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece."""
    spark = documents.sparkSession
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, step = encoder(tokenizer, ranks).ids, capacity * 4
        for batch in batches:
            for part in row_runs(batch, 1, RUN_BYTES):
                out: list[list[int]] = [[], [], [], [], []]
                for doc, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = encode(words or "") + end
                    n = len(ids) // 4
                    for a in range(0, len(ids), step):
                        piece = ids[a : a + step]
                        for c, v in zip(out, (doc, a // 4, len(piece) // 4, zlib.crc32(piece), n)):
                            c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = keep(documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(cut), schema), "pieces")
    # equal rows of a repeated document are interchangeable; a number keeps them apart
    item = F.floor((F.col("length") + (grain - 1)) / grain).cast("int") - 1
    items = pieces.where(F.col("length") < capacity).withColumn("type", item)
    counts = np.zeros(capacity // grain, np.int64)
    for r in items.groupBy("type").agg(F.count("*").alias("n")).collect():
        counts[r.type] = r.n
    table, sequences = slot_table(solve(counts, capacity // grain))
    salts = 1 << (int(counts.sum()) // GROUP_ROWS).bit_length()
    salt = F.pmod(F.xxhash64("doc_id", "ids_crc32"), F.lit(salts))
    items = items.withColumn("salt", salt)
    inside = Window.partitionBy("type", "salt").orderBy("doc_id", "ids_crc32")
    before = Window.partitionBy("type").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = items.groupBy("type", "salt").agg(F.count("*").alias("n")).select("type", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = items.withColumn("r", F.row_number().over(inside) - 1).join(base, ["type", "salt"]).withColumn("rank", F.col("base") + F.col("r"))
    by_type: dict[int, list[tuple[int, int, int, int]]] = {}
    for t, first, copies, sequence, times in table:
        by_type.setdefault(t, []).append((first, copies, sequence, times))
    plan = few_rows(
        spark,
        [(t, [x[0] for x in v], [x[1] for x in v], [x[2] for x in v]) for t, v in by_type.items()],
        "type int, firsts array<long>, copies array<int>, sequences array<long>",
    )
    nth = F.size(F.filter("firsts", lambda f: f <= F.col("rank")))
    placed = ranked.join(F.broadcast(plan), "type").withColumn("nth", nth)
    sequence = F.element_at("sequences", F.col("nth")) + F.floor((F.col("rank") - F.element_at("firsts", F.col("nth"))) / F.element_at("copies", F.col("nth")))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = placed.select(*columns, sequence.cast("long").alias("sequence_id"))
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "ids_crc32").rowsBetween(Window.unboundedPreceding, -1)
    packed = placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long"))
    # numbers need only differ: those of the stored rows do, and stay the same when a task runs again
    full = pieces.where(F.col("length") == capacity)
    whole = full.select(*columns, (F.monotonically_increasing_id() + sequences).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.union(whole)
