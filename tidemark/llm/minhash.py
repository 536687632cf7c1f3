"""Near-duplicate documents by min-max hashing.

A document is the set of its shingles of five words.  Under each of ``permutations`` permutations
both the smallest and the largest hash of the set are kept: either agrees between two sets with the
probability of their Jaccard similarity, so half the hash evaluations give the same signature.
Bands of four values are keys; documents that share a key are candidates, and a candidate pair is a
link if its full sets are similar enough.

Rules
    * Words are lower-cased in A-Z only.  A document with fewer than five words is one shingle, the
      whole sequence; without words or text the set is empty and links with nothing.
    * A link: 100 * intersection >= percent * union.  Components are over links; the result holds
      the smallest id reachable, and ``kept`` for the document that has it.
    * Rows that share an id are one node, with a row each.  A NULL id links with nothing, is its own
      component (NULL) and is kept.  Extra columns are ignored; an empty table gives no rows.

Scale: equal sets become one node before anything else.  Inside a bucket its smallest member is
compared with the rest first.  Buckets with members that it does not link then go through one block pass: each is cut
into blocks of bounded rows and shingles, and any two blocks meet in a cogroup, which sends out
the edges of a spanning forest only.  Components are made once, of all links.  Sketches are looked at before sets: the shingles of a set fall into
1024 cells, and a bit tells whether their number in a cell is odd.  Where the bits of two sets differ, at
least one shingle is in one of them only, so the sketches bound the intersection from above; only pairs that
the bound rules out are not confirmed, and no link is lost.  Nothing is capped.  Sets and sketches are made
again from the text where it lies, of the documents in a bitmap of candidates (1 MB, whatever their number; the
few others that it lets through meet nobody), so no text is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import chain, components, keep, lean, mix64, row_runs, text_buffer, words_of
from tidemark.llm.substring import _runs_hash, _starts

SHINGLE = 5
PERMUTATIONS = 32
BAND_VALUES = 4
PERCENT = 85
#: Rows and shingles of a block, on average.
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 20
#: Bits of the map of candidates, as a power of two.
MAP_BITS = 23
#: Cells of a sketch, a power of two.
SKETCH_BITS = 1024
#: Bytes of text that a worker takes at once: a byte costs it some 30 while its row is hashed.
PIECE_BYTES = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLY = mix64(np.arange(1000, 1000 + PERMUTATIONS, dtype=np.uint64)) | np.uint64(1)
_ADD = mix64(np.arange(5000, 5000 + PERMUTATIONS, dtype=np.uint64))


def shingle_sets(array) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, in order."""
    data, off = text_buffer(array)
    _, _, row, words = words_of(_LOWER[data], off)
    ok = _starts(row, SHINGLE)
    shingle, owner = _runs_hash(words, SHINGLE)[ok], row[: len(ok)][ok]
    count = np.bincount(row, minlength=len(off) - 1)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    first = np.concatenate([[0], np.cumsum(count)])[short]
    shingle = np.concatenate([shingle, chain(words, first, first + count[short]) if len(short) else shingle[:0]])
    owner = np.concatenate([owner, short])
    order = np.lexsort((shingle, owner))
    shingle, owner = shingle[order], owner[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (shingle[1:] != shingle[:-1])
    return owner[new], shingle[new]


def signatures(owner: np.ndarray, shingle: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows with a set, sizes, two digests of the whole set, band keys)."""
    have, first = np.unique(owner, return_index=True)
    size = np.diff(np.append(first, len(owner)))
    bands = np.zeros((len(have), PERMUTATIONS * 2 // BAND_VALUES), np.uint64)
    if not len(have):
        return have, size, bands[:, 0], bands[:, 0], bands
    for p in range(PERMUTATIONS):
        x = shingle * _MULTIPLY[p] + _ADD[p]
        x ^= x >> np.uint64(32)
        for k, v in enumerate((np.minimum.reduceat(x, first), np.maximum.reduceat(x, first))):
            band, place = divmod(2 * p + k, BAND_VALUES)
            bands[:, band] = mix64(bands[:, band] + v + np.uint64(place))
    one = np.add.reduceat(mix64(shingle), first)
    two = np.add.reduceat(mix64(shingle ^ np.uint64(0x5555555555555555)), first)
    return have, size, one, two, bands


def _sign(batches):
    for batch in batches:
        for part in row_runs(batch, 1, PIECE_BYTES):
            n = part.num_rows
            owner, shingle = shingle_sets(part.column(1))
            have, size, one, two, bands = signatures(owner, shingle, n)
            cols = []
            for v in (size, one, two):
                full = np.zeros(n, np.int64)
                full[have] = v.view(np.int64)
                cols.append(pa.array(full))
            width = bands.shape[1]
            at = np.zeros(n + 1, np.int32)
            at[1:][have] = width
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(at, dtype=np.int32)), pa.array(bands.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), *cols, lists], names=["doc_id", "n", "d1", "d2", "bands"])


def sketches(owner: np.ndarray, shingle: np.ndarray, rows: int) -> np.ndarray:
    """The parity of each set's shingles in every cell, as 64-bit words."""
    cell = mix64(shingle) & np.uint64(SKETCH_BITS - 1)
    out = np.zeros(rows * (SKETCH_BITS // 64), np.uint64)
    np.bitwise_xor.at(out, owner * (SKETCH_BITS // 64) + (cell >> np.uint64(6)).astype(np.int64), np.uint64(1) << (cell & np.uint64(63)))
    return out.reshape(rows, SKETCH_BITS // 64)


def _bitmap(nodes: DataFrame) -> bytes:
    """A bit for the hash of every node; of fixed size, combined before it is collected."""
    place = F.shiftrightunsigned(F.xxhash64("node"), 64 - MAP_BITS) + 1
    rows = nodes.groupBy(F.bitmap_bucket_number(place).alias("slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()
    out = np.zeros((1 << MAP_BITS) // 8, np.uint8)
    for slot, part in rows:
        out[(slot - 1) * 4096 : slot * 4096] = np.frombuffer(bytes(part), np.uint8)
    return out.tobytes()


def _sets_of(wanted: bytes):
    """Sets and sketches of the documents whose hash (second column) is in the map."""

    def sets(batches):
        bits = np.frombuffer(wanted, np.uint8)
        for batch in batches:
            at = batch.column(1).to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS)
            hit = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
            batch = batch.filter(pa.array(hit))
            for part in row_runs(batch, 2, PIECE_BYTES):
                owner, shingle = shingle_sets(part.column(2))
                at = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=part.num_rows))]).astype(np.int32)
                sketch = sketches(owner, shingle, part.num_rows)
                words = np.arange(0, sketch.size + 1, sketch.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(at), pa.array(shingle.view(np.int64))), pa.ListArray.from_arrays(pa.array(words), pa.array(sketch.view(np.int64).ravel()))],
                    names=["node", "shingles", "sketch"],
                )

    return sets


def _may_be_similar(a: str, b: str, size_a: str, size_b: str, percent: int) -> Column:
    """Whether two sets of these sketches and sizes can be a link: as many bits differ, as many shingles are in one set only."""
    differ = F.lit(0)
    for k in range(SKETCH_BITS // 64):
        differ = differ + F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))))
    total = (F.col(size_a) + F.col(size_b)).cast("long")
    return (100 + percent) * (total - differ) >= 2 * percent * total


def _rows_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Nodes, components, sketches (a row each) and sets."""
    shingles = table.column("shingles").combine_chunks()
    off, flat = shingles.offsets.to_numpy(), shingles.values.to_numpy()
    sketch = np.stack(table.column("sketch").to_numpy()).view(np.uint64)
    return table.column("node").to_numpy(), table.column("component").to_numpy(), sketch, [flat[a:b] for a, b in zip(off[:-1], off[1:])]


def links_between(left, right, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks, or within one if ``right`` is None, that join components not joined yet.

    Each row meets all others of another component whose sketches allow a link; a confirmed link
    makes two components one, so at most one link per row is sent out.
    """
    nodes, parts, sketch, sets = left
    rows = len(nodes)
    others = (nodes, parts, sketch, sets) if right is None else right
    size, other_size = (np.array([len(x) for x in xs], np.int64) for xs in (sets, others[3]))
    label = np.unique(np.concatenate([parts, others[1]]), return_inverse=True)[1]
    mine, theirs, out = label[:rows].copy(), label[rows:].copy(), []
    for i in range(rows):
        first = i + 1 if right is None else 0
        far = np.flatnonzero(theirs[first:] != mine[i]) + first
        if not len(far):
            continue
        total = size[i] + other_size[far]
        differ = np.bitwise_count(others[2][far] ^ sketch[i]).sum(axis=1, dtype=np.int64)
        far = far[(100 + percent) * (total - differ) >= 2 * percent * total]
        for j in far:
            if theirs[j] == mine[i]:
                continue
            both = len(np.intersect1d(sets[i], others[3][j], assume_unique=True))
            if 100 * both >= percent * (size[i] + other_size[j] - both):
                out.append((int(nodes[i]), int(others[0][j])))
                old, new = theirs[j], mine[i]
                mine[mine == old], theirs[theirs == old] = new, new
    return out


def _block_pass(open_rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): links that join the components of (bucket, node, n, component) rows; all pairs of a bucket are decided."""
    weight = open_rows.groupBy("bucket").agg(
        F.count("*").alias("rows"), F.sum("n").alias("shingles"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    # buckets of the same members are one
    weight = weight.groupBy("rows", "shingles", "x", "y").agg(F.min("bucket").alias("bucket"))
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK_ROWS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rows = open_rows.select("bucket", "node", "component").join(weight.select("bucket", blocks.alias("blocks")), "bucket").join(sets, "node")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).cast("int"))
    columns = ["bucket", "one", "two", "node", "component", "sketch", "shingles"]
    left = rows.withColumns({"one": F.col("own"), "two": F.explode(F.sequence("own", F.col("blocks") - 1))}).select(*columns)
    right = rows.where("own > 0").withColumns({"two": F.col("own"), "one": F.explode(F.sequence(F.lit(0), F.col("own") - 1))}).select(*[F.col(c).alias(c) for c in columns])

    def decide(key: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        _, one, two = (k.as_py() for k in key)
        found = []
        if len(a) and (one == two or len(b)):
            found = links_between(_rows_of(a), None if one == two else _rows_of(b), percent)
        ends = [[max(x) for x in found], [min(x) for x in found]]
        return pa.table({"a": pa.array(ends[0], pa.int64()), "b": pa.array(ends[1], pa.int64())})

    keys = ["bucket", "one", "two"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(decide, "a long, b long")


def _similar(percent: int) -> Column:
    both = F.size(F.array_intersect("sa", "sb"))
    return 100 * both >= percent * (F.size("sa") + F.size("sb") - both)


def near_duplicates(documents: DataFrame, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``documents``."""
    spark = documents.sparkSession
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = keep(docs.mapInArrow(lean(_sign), "doc_id long, n long, d1 long, d2 long, bands array<long>"), "signatures")
    nodes = keep(
        rows.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("node")),
        "nodes",
    )
    keyed = nodes.select("node", "n", F.posexplode("bands").alias("band", "key")).select("node", "n", F.xxhash64("band", "key").alias("bucket"))
    crowded = keyed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot < last").drop("last")
    members = keep(keyed.join(crowded, "bucket"), "members")
    wanted = _sets_of(_bitmap(members))
    sets = keep(docs.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("hash"), "text").mapInArrow(lean(wanted), "node long, shingles array<long>, sketch array<long>").where("size(shingles) > 0"), "sets")
    own = nodes.select(F.col("n").alias("sn"), F.col("d1").alias("s1"), F.col("d2").alias("s2"), "node")
    placed = rows.join(own, (rows["n"] == own["sn"]) & (rows["d1"] == own["s1"]) & (rows["d2"] == own["s2"]) & rows["doc_id"].isNotNull(), "left")
    placed = keep(placed.select("doc_id", "n", "node"), "placed")
    # an id and the node of each of its sets are one
    links = placed.where("doc_id <> node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    # every bucket against its smallest member
    pairs = members.where("node > pivot").groupBy(F.col("node").alias("a")).agg(F.collect_set("pivot").alias("pivots"))
    sides = [sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s{x}"), F.col("sketch").alias(f"k{x}"), F.size("shingles").alias(f"n{x}")) for x in "ab"]
    pairs = pairs.join(sides[0], "a").withColumn("b", F.explode("pivots")).drop("pivots")
    found = pairs.join(sides[1], "b").where(_may_be_similar("ka", "kb", "na", "nb", percent)).where(_similar(percent))
    found = keep(found.select("a", "b"), "pairs")
    # a pivot has met its whole bucket; the others meet in blocks if it leaves one out
    met = found.select(F.col("a").alias("node"), F.col("b").alias("pivot"), F.col("b").alias("component"))
    rest = members.where("size > 2 and node > pivot").join(met, ["node", "pivot"], "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    rest = keep(rest, "open")
    mixed = rest.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    more = _block_pass(keep(rest.join(mixed, "bucket"), "open"), sets, percent)
    component = components(links.union(found).union(more))
    out = placed.join(component, placed["node"] == component["id"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
