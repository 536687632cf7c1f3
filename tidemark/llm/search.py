"""Ranked lexical search by pipelined term partitioning.

Documents are indexed once, in blocks as they lie: postings of the terms that some item has, and the number
of terms of every document.  Terms are owned by stages, the rarest terms by the first.  Items are dealt to
bundles; a bundle's lane for a block of documents carries sparse accumulators (item, document, score) from one
term owner to the next, which adds its integer contributions in a cogroup with its postings.  A lane is
bounded by items of a bundle times documents of a block, so a word that all documents have is never one
group.

Between two stages the k-th highest score so far of every item is known.  Contributions are never negative,
so this is a lower bound of its final k-th score, and a term adds less than a million times its weight.  A
document without an accumulator is admitted, and an accumulator is carried on, only while the terms that are
still to come may lift it to that bound; equal scores count as reaching it.  Nothing else is left out, so
results are exact.

Terms are known by 64-bit hashes.  Which terms occur in items goes to the readers as a bitmap of fixed size
(1 MB, whatever the number of items); what it lets through by chance is removed by the join with the terms.

Defined results: a NULL or empty text has no term; documents without a term are not counted.  Rows of one item
id, NULL included, are one item with the terms of all of them.  Each row of documents is a document, repeated
ids and NULL ids included; equal scores are ordered by id, NULL last.  Empty tables give an empty result.  Only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import keep, row_runs, text_buffer, words_of

#: Documents of a block at most; a block also ends after about 8 MB of text.
BLOCK_DOCS = 4096
#: Items of a bundle, on average.
BUNDLE_ITEMS = 256
#: Shares of the documents that hold a term: a term above the first i of them belongs to stage i.
BANDS = (1 / 64, 1 / 8, 1 / 2)
#: Number of bits of the map of item terms, as a power of two.
MAP_BITS = 23
#: No contribution reaches its weight times this.
MOST = 999_999

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)

_INDEX = "block long, term long, docs binary, counts binary, sizes binary, ids array<long>, holding long, tokens long"
_LANE = ("bundle long, block long, items array<int>, docs array<int>, scores array<long>, "
         "best_items array<int>, best_docs array<int>, best_scores array<long>")


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every term: runs of digits, letters and characters beyond ASCII, A-Z lower-cased."""
    data, off = text_buffer(column)
    _, _, row, hashed = words_of(_FOLD[data], off)
    return row, hashed


def _counted(row: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (hash, row) in this order with their number."""
    order = np.lexsort((row, hashed))
    row, hashed = row[order], hashed[order]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])]) if len(row) else np.zeros(0, np.int64)
    return hashed[first], row[first], np.diff(np.r_[first, len(row)])


def item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """(item_id, term, times): the terms of every item."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in row_runs(batch, 1):
                hashed, row, times = _counted(*_terms(run.column(1)))
                yield pa.RecordBatch.from_arrays([run.column(0).take(pa.array(row)), pa.array(hashed.view(np.int64)), pa.array(times)], ["item_id", "term", "times"])

    rows = items.select(F.col(key).cast("long").alias("item_id"), F.col(text).alias("text"))
    return rows.mapInArrow(parse, "item_id long, term long, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def _bitmap(terms: DataFrame, bits: int) -> bytes:
    """A bit for the first ``bits`` bits of every term; of fixed size, combined before it is collected."""
    place = F.shiftrightunsigned("term", 64 - bits) + 1
    rows = terms.groupBy(F.bitmap_bucket_number(place).alias("slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros(max(1 << bits, 32768) // 8, np.uint8)
    for slot, part in rows:
        out[(slot - 1) * 4096 : slot * 4096] = np.frombuffer(bytes(part), np.uint8)
    return out.tobytes()


def index(documents: DataFrame, key: str, text: str, wanted: bytes, bits: int = MAP_BITS, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Postings per (block, term), and a row per block with its document ids in ascending order, NULL last.

    ``docs`` are places among these ids, ``counts`` occurrences there and ``sizes`` numbers of terms.
    """

    def write(block: int, run: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        run = run.take(pa.compute.sort_indices(run.column(0), null_placement="at_end"))
        row, hashed = _terms(run.column(1))
        size = np.bincount(row, minlength=run.num_rows)
        map_ = np.frombuffer(wanted, np.uint8)
        at = hashed >> np.uint64(64 - bits)
        hit = (map_[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        term, doc, times = _counted(row[hit], hashed[hit])
        first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)

        def packed(values: np.ndarray, kind: type) -> pa.Array:
            width = np.dtype(kind).itemsize
            off = pa.py_buffer((np.r_[first, len(term)] * width).astype(np.int32))
            return pa.Array.from_buffers(pa.binary(), len(first), [None, off, pa.py_buffer(np.ascontiguousarray(values.astype(kind)))])

        n, none = len(first), pa.nulls
        postings = [pa.array(np.full(n, block)), pa.array(term[first].view(np.int64)), packed(doc, np.uint16), packed(times, np.uint32),
                    packed(size[doc], np.uint32), none(n, pa.list_(pa.int64())), none(n, pa.int64()), none(n, pa.int64())]
        ids = pa.ListArray.from_arrays(pa.array([0, run.num_rows], pa.int32()), run.column(0))
        head = [pa.array([block]), none(1, pa.int64()), none(1, pa.binary()), none(1, pa.binary()), none(1, pa.binary()), ids,
                pa.array([int((size > 0).sum())]), pa.array([int(size.sum())])]
        names = [c.split()[0] for c in _INDEX.split(", ")]
        yield pa.RecordBatch.from_arrays(head, names)
        if n:
            yield pa.RecordBatch.from_arrays(postings, names)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for run in row_runs(batch, 1):
                for a in range(0, run.num_rows, min(block_docs, 1 << 16)):
                    yield from write(block, run.slice(a, min(block_docs, 1 << 16)))
                    block += 1

    return documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(parse, _INDEX)


def _impacts(counts: np.ndarray, sizes: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(1000000000 * tf) div (1000 * tf + 8 * m) with m = 100 - 75 + (75 * n * N) div L."""
    kinds, back = np.unique(sizes, return_inverse=True)
    m = np.array([100 - 75 + 75 * int(n) * n_docs // n_terms for n in kinds], np.int64)[back]
    tf = counts.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _stage(n_docs: int, n_terms: int, k: int, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What a term owner does with a lane: add its contributions to the accumulators."""

    def lists(table: pa.Table, name: str) -> np.ndarray:
        return table.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        source = right if right.num_rows else left
        bundle, block = source.column("bundle")[0].as_py(), source.column("block")[0].as_py()
        items, docs, scores = (lists(left, c) if left.num_rows else np.zeros(0, np.int64) for c in ("items", "docs", "scores"))
        rows = []
        if right.num_rows:
            entries = right.column("entries").combine_chunks()
            off, flat = entries.offsets.to_numpy() - entries.offsets[0].as_py(), entries.flatten()
            item, weight, admit, floor = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("item", "weight", "admit", "floor"))
            for r, (d, c, n) in enumerate(zip(*(right.column(x).to_pylist() for x in ("docs", "counts", "sizes")))):
                rows.append((np.frombuffer(d, np.uint16).astype(np.int64), _impacts(np.frombuffer(c, np.uint32), np.frombuffer(n, np.uint32), n_docs, n_terms), off[r], off[r + 1]))
        else:
            item, floor = np.zeros(0, np.int64), np.zeros(0, np.int64)
        shape = 1 + max(items.max(initial=0), item.max(initial=0)), 1 + max(docs.max(initial=0), max((int(r[0].max(initial=0)) for r in rows), default=0))
        total, least = np.zeros(shape, np.int64), np.ones(shape[0], np.int64)
        total[items, docs] = scores
        carried = total > 0
        least[item] = np.maximum(floor, 1)
        for at, impact, a, b in rows:
            for e in range(a, b):
                i = item[e]
                if admit[e]:
                    total[i, at] += weight[e] * impact
                else:
                    live = carried[i, at]
                    total[i, at[live]] += weight[e] * impact[live]
        items, docs = np.nonzero(total >= least[:, None])
        scores = total[items, docs]
        order = np.lexsort((docs, -scores, items))
        first = np.searchsorted(items[order], items[order], "left")
        best = order[np.arange(len(order)) - first < k]
        kept = slice(0, 0) if last else slice(None)
        columns = [items[kept], docs[kept], scores[kept], items[best], docs[best], scores[best]]
        kinds = [pa.int32(), pa.int32(), pa.int64()] * 2
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, t)) for c, t in zip(columns, kinds)]
        return pa.Table.from_arrays([pa.array([bundle], pa.int64()), pa.array([block], pa.int64()), *arrays], [c.split()[0] for c in _LANE.split(", ")])

    return add


def _best(lanes: DataFrame, k: int) -> DataFrame:
    """(bundle, item, bound): the k-th highest score so far of the items that have k scores."""
    each = lanes.select("bundle", F.explode(F.arrays_zip("best_items", "best_scores")).alias("x")).select("bundle", F.col("x.best_items").alias("item"), F.col("x.best_scores").alias("score"))
    place = F.row_number().over(Window.partitionBy("bundle", "item").orderBy(F.col("score").desc()))
    top = each.withColumn("place", place).where(F.col("place") <= k)
    return top.groupBy("bundle", "item").agg(F.min("score").alias("bound"), F.max("place").alias("places")).where(F.col("places") == k).drop("places")


def search(documents: DataFrame, items: DataFrame, k: int = 10, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text",
           bands: tuple[float, ...] = BANDS, bundle_items: int = BUNDLE_ITEMS, block_docs: int = BLOCK_DOCS, map_bits: int = MAP_BITS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item."""
    spark = documents.sparkSession
    own = keep(item_terms(items, item_key, text), "item-terms")
    found = keep(index(documents, doc_key, text, _bitmap(own.select("term").distinct(), map_bits), map_bits, block_docs), "index")
    n_docs, n_terms = found.where("term is null").agg(F.coalesce(F.sum("holding"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()

    # terms with weight, stage and owner; items with their place in a bundle and what each stage may still add
    postings = found.where("term is not null").select("block", "term", "docs", "counts", "sizes")
    df = postings.groupBy("term").agg(F.sum(F.octet_length("docs") / 2).cast("long").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(float(n_docs)) + 2) / (2 * F.col("df") + 1))).cast("long")
    stage = sum((F.when(F.col("df") > share * n_docs, 1).otherwise(0) for share in bands), F.lit(0))
    names = own.select("item_id").distinct()
    bundles = max(1, -(-names.count() // bundle_items))
    names = names.withColumn("bundle", F.pmod(F.xxhash64("item_id"), F.lit(bundles)).cast("long"))
    names = keep(names.withColumn("item", (F.row_number().over(Window.partitionBy("bundle").orderBy("item_id")) - 1)), "items")
    terms = own.join(df, "term").select("item_id", "term", (weight * F.col("times")).alias("weight"), stage.alias("stage"))
    named = names.select(F.col("item_id").alias("its_id"), "bundle", "item")
    terms = keep(terms.join(named, F.col("item_id").eqNullSafe(F.col("its_id"))).select("bundle", "item", "term", "weight", "stage"), "terms")
    rest = [F.coalesce(F.sum(F.when(F.col("stage") >= s, F.col("weight") * MOST)), F.lit(0)).alias(f"rest_{s}") for s in range(len(bands) + 2)]
    rest = terms.groupBy("bundle", "item").agg(*rest)

    lanes = spark.createDataFrame([], _LANE)
    for s in range(len(bands) + 1):
        known = F.coalesce("bound", F.lit(0))
        info = rest.join(_best(lanes, k), ["bundle", "item"], "left").select(
            "bundle", "item", (F.col(f"rest_{s}") >= known).alias("admit"), (known - F.col(f"rest_{s + 1}")).alias("floor"))
        entry = F.struct("item", "weight", "admit", "floor")
        owned = terms.where(F.col("stage") == s).join(info, ["bundle", "item"]).groupBy("bundle", "term").agg(F.collect_list(entry).alias("entries"))
        owned = keep(owned, "owned")
        right = postings.join(owned, "term").select("bundle", "block", "docs", "counts", "sizes", "entries")
        lane = lanes.groupBy("bundle", "block").cogroup(right.groupBy("bundle", "block"))
        lanes = keep(lane.applyInArrow(_stage(n_docs, n_terms, k, s == len(bands)), _LANE), "lanes")

    ids = found.where("term is null").select("block", "ids")
    best = F.arrays_zip("best_items", F.transform("best_docs", lambda i: F.get("ids", i)).alias("id"), "best_scores")
    each = lanes.join(ids, "block").select("bundle", F.explode(best).alias("x"))
    each = each.select("bundle", F.col("x.best_items").alias("item"), F.col("x.id").alias("doc_id"), F.col("x.best_scores").alias("score"))
    order = Window.partitionBy("bundle", "item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    top = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return top.join(names, ["bundle", "item"]).select("item_id", "rank", "doc_id", "score")
