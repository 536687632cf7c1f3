"""Substring deduplication: words of passages that an earlier document has already.

A window is ``window`` consecutive words.  The minimiser of a window is the smallest hash of its runs
of ``gram`` words; consecutive windows that share it travel as one packed string to the bucket of
the minimiser, so equal windows meet.  Before that, four bytes of each minimiser travel alone: equal
windows have equal minimisers, so a string whose minimiser is in no other document stays at home.  A bucket sorts its windows, finds the smallest document of each, and replies to the groups
of documents whose strings hold a window of an earlier document.

Rules
    * A word is covered if any window over it also starts in a document with a smaller id; windows are
      judged on the input.  Rows that share an id are one document for that, and keep a row each.
    * A NULL id counts as larger than all others.  NULL and empty texts have no words.
    * Documents shorter than a window lose nothing.  Extra columns pass through.

Scale: documents are dealt into groups by a hash of their id, which bounds a group whatever the ids
hold.  Each group sends a string once, with the smallest and largest id that has it: a passage that a
third of all documents hold arrives once per group.  Runs of words that very many documents have
rank last among minimisers, so windows that hold such a passage together with other words go where
the other words send them.  Groups and buckets grow in number, not in size.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chain, mix64, row_runs, text_buffer, words_of

WINDOW = 13
GRAM = 3
GROUP_BYTES = 4 << 20
BUCKET_BYTES = 4 << 20
#: A run of words is frequent if more than one document in so many has it; there are at most this
#: number times the mean number of words of a document.
FREQUENT = 400
#: Occurrences in a piece of about 8 MB below which a run is not reported as possibly frequent.
LEAST_IN_PIECE = 8
#: Windows of one string; longer runs (one word repeated) are cut.
STRING_WINDOWS = 64
_LAST = np.iinfo(np.int64).max
_FACTORS = mix64(np.arange(1, 129, dtype=np.uint64)) | np.uint64(1)


def _runs_hash(words: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of each run of ``length`` words, by its first word; the last runs are cut off."""
    n = len(words) - length + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(length):
        out += words[j : j + n] * _FACTORS[salt + j]
    return mix64(out)


def _starts(row: np.ndarray, length: int) -> np.ndarray:
    """Words at which a run of ``length`` words of one row starts, as a mask without the last runs."""
    n = len(row) - length + 1
    return row[:n] == row[length - 1 :] if n > 0 else np.zeros(0, bool)


def strings_of(words: np.ndarray, row: np.ndarray, frequent: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, end, minimiser): the runs of windows that travel together."""
    ok = _starts(row, window)
    if not ok.any():
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(0, np.uint64)
    g = _runs_hash(words, gram)
    rank = g >> np.uint64(1)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, g), len(frequent) - 1)
        rank[frequent[at] == g] |= np.uint64(1 << 63)
    least, width = rank, 1
    while width < window - gram + 1:
        step = min(width, window - gram + 1 - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    new = np.ones(len(ok), bool)
    new[1:] = (least[1:] != least[:-1]) | ~ok[:-1] | (row[1 : len(ok)] != row[: len(ok) - 1])
    at = np.arange(len(ok))
    begin = np.maximum.accumulate(np.where(new, at, 0))
    new |= (at - begin) % STRING_WINDOWS == 0
    first = np.flatnonzero(new & ok)
    stop = np.flatnonzero(new | ~ok)
    after = np.searchsorted(stop, first, "right")
    end = np.where(after < len(stop), stop[np.minimum(after, len(stop) - 1)], len(ok))
    return first, end, least[first]


def _take_bytes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    size = end - start
    place = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(size) else size
    return data[np.repeat(start - place, size) + np.arange(int(size.sum()))]


def _pack(*arrays: np.ndarray) -> bytes:
    import zstandard

    head = np.array([len(arrays), *[a.nbytes for a in arrays]], np.int64).tobytes()
    return zstandard.compress(head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays), 1)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.decompress(blob)
    sizes = np.frombuffer(raw, np.int64, len(kinds) + 1)[1:].tolist()
    out, at = [], 8 * (len(kinds) + 1)
    for kind, size in zip(kinds, sizes):
        out.append(np.frombuffer(raw, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _short(minimiser: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and 32 further bits of each minimiser."""
    h = mix64(minimiser + np.uint64(1))
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), h.astype(np.uint32)


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("__id").fill_null(int(_LAST)).to_numpy()


def frequent_runs(documents: DataFrame, text: str, gram: int, limit: int) -> np.ndarray:
    """Hashes of the runs of words that occur more than ``limit`` times in pieces that hold them often, sorted."""

    def count(batches):
        for batch in batches:
            for part in row_runs(batch, 0):
                _, _, row, words = words_of(*text_buffer(part.column(0)))
                g = _runs_hash(words, gram)[_starts(row, gram)]
                g.sort()
                edge = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])) if len(g) else np.zeros(1, np.int64)
                n = np.diff(edge)
                often = n >= LEAST_IN_PIECE
                yield pa.RecordBatch.from_arrays([pa.array(g[edge[:-1]][often].view(np.int64)), pa.array(n[often].astype(np.int64))], names=["run", "n"])

    found = documents.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "run long, n long")
    rows = found.groupBy("run").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("run").toArrow()
    return np.sort(rows.column("run").to_numpy().view(np.uint64))


def remove_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM, group_bytes: int = GROUP_BYTES, bucket_bytes: int = BUCKET_BYTES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``documents`` with n_words, n_removed and kept_text (the words kept, joined by one space)."""
    size, rows = documents.agg(F.coalesce(F.sum(F.octet_length(F.col(text).cast("string"))), F.lit(0)), F.count("*")).first()
    frequent = frequent_runs(documents, text, gram, max(64, rows // FREQUENT))
    n_groups, n_buckets = 1 + size // group_bytes, 1 + 3 * size // bucket_bytes
    n_minimiser_buckets, columns = 1 + n_buckets // 8, documents.columns
    base = documents.withColumn("__id", F.col(doc_id).cast("long"))
    base = base.withColumn("__group", F.pmod(F.xxhash64("__id", F.length(text)), F.lit(n_groups)).cast("long"))

    def parse(table: pa.Table):
        data, off = text_buffer(table.column(text))
        start, end, row, words = words_of(data, off)
        first, stop, least = strings_of(words, row, frequent, window, gram)
        key = chain(words, first, stop + window - 1) if len(first) else np.zeros(0, np.uint64)
        return data, off, start, end, row, first, stop, least, key

    def name_minimisers(key: tuple, table: pa.Table) -> pa.Table:
        least = np.unique(parse(table)[7])
        bucket, short = _short(least, n_minimiser_buckets)
        order = np.lexsort((short, bucket))
        bucket, short = bucket[order], short[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
        blobs = [x.tobytes() for x in np.split(short, cuts[1:])] if len(bucket) else []
        return pa.table({"bucket": pa.array(bucket[cuts], pa.int64()), "group": pa.array([key[0].as_py()] * len(blobs), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def shared_minimisers(key: tuple, table: pa.Table) -> pa.Table:
        got = [np.frombuffer(b, np.uint32) for b in table.column("blob").to_pylist()]
        found, n = np.unique(np.concatenate(got), return_counts=True)
        found = found[n > 1]
        blobs = [_pack(g[np.isin(g, found)]) for g in got]
        return pa.table({"group": table.column("group"), "bucket": pa.array([key[0].as_py()] * len(blobs), pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def send(key: tuple, table: pa.Table, shared: pa.Table) -> pa.Table:
        group = key[0].as_py()
        data, _, start, end, row, first, stop, least, name = parse(table)
        out_bucket, out_blob = [], []
        if len(first):
            # minimisers that another group has, or another document of this one
            buckets, blobs = shared.column("bucket").to_numpy(), shared.column("blob").to_pylist()
            parts = [(np.uint64(b) << np.uint64(32)) | _unpack(x, np.uint32)[0].astype(np.uint64) for b, x in zip(buckets.tolist(), blobs)]
            bucket, short = _short(least, n_minimiser_buckets)
            goes = np.isin((bucket.astype(np.uint64) << np.uint64(32)) | short, np.concatenate(parts)) if parts else np.zeros(len(least), bool)
            order = np.lexsort((row[first], least))
            twice = (least[order][1:] == least[order][:-1]) & (row[first][order][1:] != row[first][order][:-1])
            goes |= np.isin(least, least[order][1:][twice])
            first, stop, least, name = first[goes], stop[goes], least[goes], name[goes]
        if len(first):
            ids = _ids(table)[row[first]]
            bucket = (mix64(least) % np.uint64(n_buckets)).astype(np.int64)
            order = np.lexsort((ids, name, bucket))
            name, ids, bucket, first, stop = name[order], ids[order], bucket[order], first[order], stop[order]
            new = np.concatenate([[True], (name[1:] != name[:-1]) | (bucket[1:] != bucket[:-1])])
            at = np.flatnonzero(new)
            last = np.concatenate([at[1:], [len(new)]]) - 1
            begin, until = start[first[at]], end[stop[at] + window - 2]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[at])) + 1, [len(at)]])
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                s = slice(a, b)
                out_bucket.append(int(bucket[at[a]]))
                out_blob.append(_pack(name[at[s]], ids[at[s]], ids[last[s]], (until[s] - begin[s]).astype(np.int32), _take_bytes(data, begin[s], until[s])))
        return pa.table({"bucket": pa.array(out_bucket, pa.int64()), "group": pa.array([group] * len(out_blob), pa.int64()), "blob": pa.array(out_blob, pa.binary())})

    def count(key: tuple, table: pa.Table) -> pa.Table:
        groups = table.column("group").to_numpy()
        got = [_unpack(b, np.uint64, np.int64, np.int64, np.int32, np.uint8) for b in table.column("blob").to_pylist()]
        name, low, high, size = (np.concatenate([g[i] for g in got]) for i in range(4))
        data = np.concatenate([g[4] for g in got])
        owner = np.repeat(np.arange(len(got)), [len(g[0]) for g in got])
        _, _, row, words = words_of(data, np.concatenate([[0], np.cumsum(size, dtype=np.int64)]))
        ok = _starts(row, window)
        row = row[: len(ok)][ok]
        one, two = _runs_hash(words, window)[ok], _runs_hash(words, window, 64)[ok]
        order = np.lexsort((two, one))
        new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])])
        at = np.flatnonzero(new)
        least = np.minimum.reduceat(low[row[order]], at)
        first = np.empty(len(row), np.int64)
        first[order] = np.repeat(least, np.diff(np.append(at, len(row))))
        # strings that hold a window of a document before one of theirs
        edge = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        hit = np.minimum.reduceat(first, edge) < high
        windows = np.diff(np.append(edge, len(row)))
        keep = np.repeat(hit, windows)
        first = first[keep]
        name, owner, windows = name[hit], owner[hit], windows[hit]
        out_group, out_blob = [], []
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1, [len(owner)]]) if len(owner) else [0]
        place = np.concatenate([[0], np.cumsum(windows)])
        for a, b in zip(cuts[:-1], cuts[1:]):
            out_group.append(int(groups[owner[a]]))
            out_blob.append(_pack(name[a:b], windows[a:b].astype(np.int32), first[place[a] : place[b]]))
        return pa.table({"group": pa.array(out_group, pa.int64()), "blob": pa.array(out_blob, pa.binary())})

    def clean(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        data, off, start, end, row, first, stop, _, name = parse(table)
        ids = _ids(table)
        change = np.zeros(len(start) + 1, np.int64)
        blobs = replies.column("blob").to_pylist()
        if blobs and len(first):
            got = [_unpack(b, np.uint64, np.int32, np.int64) for b in blobs]
            names, windows, least = (np.concatenate([g[i] for g in got]) for i in range(3))
            place = np.concatenate([[0], np.cumsum(windows, dtype=np.int64)])
            order = np.argsort(names)
            at = np.minimum(np.searchsorted(names[order], name), len(names) - 1)
            known = names[order][at] == name
            reply, first = order[at[known]], first[known]
            n = windows[reply].astype(np.int64)
            shift = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            word = np.repeat(first, n) + shift
            gone = word[least[np.repeat(place[reply], n) + shift] < ids[row[word]]]
            np.add.at(change, gone, 1)
            np.add.at(change, gone + window, -1)
        stays = np.cumsum(change[:-1]) == 0
        n_words = np.bincount(row, minlength=len(ids)).astype(np.int64)
        n_kept = np.bincount(row, stays, len(ids)).astype(np.int64)
        edge = np.concatenate([[0], np.cumsum(n_words)])
        raw, texts = data.tobytes(), []
        for i in range(len(ids)):
            parts = raw[off[i] : off[i + 1]].split()
            texts.append(b" ".join(parts if n_kept[i] == n_words[i] else compress(parts, stays[edge[i] : edge[i + 1]])).decode())
        own = [table.column(c) for c in columns]
        return pa.Table.from_arrays([*own, pa.array(n_words), pa.array(n_words - n_kept), pa.array(texts, pa.string())], names=[*columns, "n_words", "n_removed", "kept_text"])

    named = base.groupBy("__group").applyInArrow(name_minimisers, "bucket long, group long, blob binary")
    shared = named.groupBy("bucket").applyInArrow(shared_minimisers, "group long, bucket long, blob binary").withColumnRenamed("group", "__group")
    strings = base.groupBy("__group").cogroup(shared.groupBy("__group")).applyInArrow(send, "bucket long, group long, blob binary")
    replies = strings.groupBy("bucket").applyInArrow(count, "group long, blob binary").withColumnRenamed("group", "__group")
    out = documents.select("*", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("kept_text")).schema
    return base.groupBy("__group").cogroup(replies.groupBy("__group")).applyInArrow(clean, out)
