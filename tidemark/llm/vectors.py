"""Embedding near-duplicates: an exact range join in the metric of unit vectors.

cosine >= c means an angle of at most acos(c).  Pivots cut the vectors into cells of the nearest
pivot, and the vectors of a cell into blocks.  A block keeps its least and largest angle to every
pivot.  Angles obey the triangle inequality: two blocks whose angles to some pivot lie further apart
than acos(c) have no pair, and of two others only rows that can reach the other block are multiplied.

Rules
    * Vectors that are NULL, empty, zero, or hold NULL or non-finite components link with nothing and
      are a component of their own.  Only vectors of equal length are compared.
    * Cosines are computed in double precision on the given values.  Rows that repeat an id are
      separate rows: they count as links of each other if their vectors link, and share the result.
    * Extra columns are ignored; an empty table gives no rows.

Scale: vectors are shuffled once and written once, as blocks; no vector is copied for another block.
Pairs of blocks meet in a cartesian product that reads the blocks from the shared folder, so disk
grows as the rows.  Exact copies are joined as one vector with a count (vectors are told apart by 128
bits of their hashes); near copies are counted by blocks of a product of matrices and never listed: a
task gives one count per vector and the edges of a spanning forest.  On vectors that fill
their space evenly no exact bound can separate blocks, and work grows with the square of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import blocks_for, components, keep, lean, usable_vector

THRESHOLD = 0.9
CELL_ROWS = 16384
BLOCK_ROWS = 16384
MAX_PIVOTS = 256
#: Bytes of vectors from which a block has fewer rows: pairs of blocks go to Python whole.
BLOCK_BYTES = 1 << 22
#: Blocks of one file; fewer where there would be fewer files than tasks run at once.
FILE_BLOCKS = 4
#: Rows below which a block is not made smaller to occupy more tasks.
LEAST_ROWS = 1024
#: Elements of a product of matrices that are looked at together.
PRODUCT = 1 << 20
#: Components from which pairs are first looked at by three eighths of them, and the share of pairs these may leave.
LEAST_DIM, RARE = 32, 1 / 500
#: Blocks of the right side that a task keeps for its next blocks of the left side.
KEPT_BLOCKS = 8
#: Angles are rounded in their last digits, most where they are small.
ANGLE_MARGIN = 1e-6
#: Stands for a NULL id among the blocks.
NO_ID = np.iinfo(np.int64).max
PLACED = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("n", pa.int64()), ("data", pa.binary())])
BLOCK = pa.schema([("dim", pa.int32()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64())), ("ids", pa.binary()), ("n", pa.binary()), ("data", pa.binary())])
#: Single-precision products within this of the threshold are computed again in double precision.
MARGIN = 1e-5


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _find(root: np.ndarray | dict[int, int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def links_between(a: np.ndarray, b: np.ndarray, weight_a: np.ndarray, weight_b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of every row of ``a`` into ``b`` and back, by weight, and edges (row of a, row of b) of a spanning forest.

    With ``same`` the two are one block, and a pair counts once.
    """
    n_a, n_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    root = np.arange(len(a) + len(b))
    shift = 0 if same else len(a)
    edges = []
    a32, b32 = a.astype(np.float32), b.astype(np.float32)
    step = max(1, PRODUCT // max(1, len(b)))
    low = np.float32(threshold - MARGIN)
    few = a.shape[1] * 3 // 8 if a.shape[1] >= LEAST_DIM else 0
    if few:
        main = np.argsort(-((a32 * a32).sum(0) + (b32 * b32).sum(0)), kind="stable")
        a_few, b_few = (np.column_stack([x[:, main[:few]], np.linalg.norm(x[:, main[few:]], axis=1)]) for x in (a32, b32))
    for s in range(0, len(a), step):
        if few:
            # the rest of the components adds at most the product of its lengths
            i, j = np.divmod(np.flatnonzero((a_few[s : s + step] @ b_few.T).ravel() >= low), max(1, len(b)))
            few *= len(i) <= RARE * step * len(b)
        if few:
            p = None
        else:
            p = a32[s : s + step] @ b32.T
            i, j = np.divmod(np.flatnonzero(p.ravel() >= low), max(1, len(b)))
        i += s
        if same:
            i, j = i[i < j], j[i < j]
        if not len(i):
            continue
        close = np.ones(len(i), bool) if p is None else p[i - s, j] < threshold + MARGIN
        ok = ~close
        ok[close] = np.einsum("ij,ij->i", a[i[close]], b[j[close]]) >= threshold
        i, j = i[ok], j[ok]
        np.add.at(n_a, i, weight_b[j])
        np.add.at(n_b, j, weight_a[i])
        # every row of b joins its first row of a, then the first pair of each two parts left
        first = np.unique(j, return_index=True)[1]
        while len(first):
            for x, y in zip(i[first].tolist(), j[first].tolist()):
                rx, ry = _find(root, x), _find(root, y + shift)
                if rx != ry:
                    root[max(rx, ry)] = min(rx, ry)
                    edges.append((x, y))
            while (root != root[root]).any():
                root = root[root]
            apart = root[i] != root[j + shift]
            i, j = i[apart], j[apart]
            first = np.unique(root[i] * len(root) + root[j + shift], return_index=True)[1]
    return n_a, n_b, edges


def _cells(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot nearest to each row; in whole numbers, so that equal vectors have equal cells in any batch."""
    whole = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * (1 << 20))
    return (whole @ np.rint(pivots * (1 << 20)).T).argmax(1)


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _place(pivots: dict[int, np.ndarray], real: str):
    """Rows (id, h1, h2, dim, v) with their cell and the bytes of the vector; copies within a batch are one row with a count."""

    def place(batches):
        for batch in batches:
            ids = batch.column("id").fill_null(NO_ID).to_numpy()
            h1, h2, dims = (batch.column(c).to_numpy() for c in ("h1", "h2", "dim"))
            order = np.lexsort((ids, h2, h1))
            first = np.flatnonzero(np.concatenate([[True], (np.diff(h1[order]) != 0) | (np.diff(h2[order]) != 0)])) if len(order) else order
            count = np.diff(np.append(first, len(order)))
            rows = order[first]
            for dim in np.unique(dims).tolist():
                mine = dims[rows] == dim
                at = rows[mine]
                x = batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                cell = _cells(x.astype(np.float64), pivots[dim]).astype(np.int32)
                data = np.ascontiguousarray(x, real)
                off = np.arange(0, data.nbytes + 1, data.itemsize * dim, dtype=np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(off), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(dims[at]), pa.array(cell), *[pa.array(c) for c in (h1[at], h2[at], ids[at], count[mine])], data], names=["dim", "cell", "h1", "h2", "id", "n", "data"])

    return place


def _pack(pivots: dict[int, np.ndarray], real: str, block_rows: int):
    """Blocks of the rows of a partition, which come in order of cell and hash: ids, counts and vectors, and the least and largest angle to every pivot."""

    def pack(batches):
        table = pa.Table.from_batches(list(batches) or [pa.RecordBatch.from_pylist([], PLACED)])
        dims, cell, h1, h2, ids, n = (table.column(c).to_numpy() for c in PLACED.names[:-1])
        changed = np.ones(len(table), bool)
        changed[1:] = np.any([np.diff(c) != 0 for c in (dims, cell, h1, h2)], axis=0)
        first = np.flatnonzero(changed)
        if not len(first):
            return
        ids, n = np.minimum.reduceat(ids, first), np.add.reduceat(n, first)
        dims, cell, data = dims[first], cell[first], table.column("data").take(pa.array(first))
        cuts = [0, *(np.flatnonzero((np.diff(dims) != 0) | (np.diff(cell) != 0)) + 1).tolist(), len(first)]
        for start, end in zip(cuts, cuts[1:]):
            parts = blocks_for(end - start, max(1, min(block_rows, BLOCK_BYTES // len(data[start].as_py()))))
            for k in range(parts):
                a, b = (start + (end - start) * x // parts for x in (k, k + 1))
                held = b"".join(data.slice(a, b - a).to_pylist())
                angles = _angles(_unit(_rows(held, int(dims[a]), real)), pivots[int(dims[a])])
                yield pa.RecordBatch.from_pylist([{"dim": dims[a], "lo": angles.min(0).tolist(), "hi": angles.max(0).tolist(), "ids": ids[a:b].tobytes(), "n": n[a:b].tobytes(), "data": held}], BLOCK)

    return pack


def _rows(data: bytes, dim: int, real: str) -> np.ndarray:
    return np.frombuffer(data, real).reshape(-1, dim).astype(np.float64)


def _link(pivots: dict[int, np.ndarray], real: str, threshold: float):
    """(id, links, NULL) for the linked rows of pairs of blocks, summed up within a task, and (id, 0, other) for edges of a spanning forest of the task."""
    far = np.arccos(threshold) + ANGLE_MARGIN

    def result(ids: np.ndarray, links: np.ndarray, other: np.ndarray | None = None):
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(links, pa.int64()), pa.nulls(len(ids), pa.int64()) if other is None else pa.array(other, pa.int64())], names=["id", "links", "other"])

    def link(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        counts: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        root: dict[int, int] = {}

        def block(row: dict, side: str) -> tuple:
            key = row[f"b_{side}"]
            if key in held:
                return held[key]
            ids, n = (np.frombuffer(row[f"{c}_{side}"], np.int64) for c in ("ids", "n"))
            found = _unit(_rows(row[f"data_{side}"], row["dim"], real)), ids, n
            if key not in counts:
                counts[key] = ids, np.zeros(len(ids), np.int64)
            # every block of the left side meets those of the right side in the same order: the first ones are worth keeping
            if side == "b" and len(held) < KEPT_BLOCKS:
                held[key] = found
            return found

        def reaching(x: np.ndarray, dim: int, largest: list[float]) -> np.ndarray:
            """Rows that can be near a block with these largest angles, by the pivot around which it lies closest."""
            p = int(np.argmin(largest))
            return np.flatnonzero(_angles(x, pivots[dim][p : p + 1])[:, 0] <= largest[p] + far)

        last = None
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if last is None or last[0] != row["b_a"]:
                    last = row["b_a"], block(row, "a")
                (x, ids_x, n_x), (y, ids_y, n_y) = last[1], block(row, "b")
                same = row["b_a"] == row["b_b"]
                i, j = np.arange(len(x)), np.arange(len(y))
                if not same:
                    i, j = reaching(x, row["dim"], row["hi_b"]), reaching(y, row["dim"], row["hi_a"])
                if not (len(i) and len(j)):
                    continue
                a, b = (v if len(v) == len(at) else v[at] for v, at in ((x, i), (y, j)))
                n_a, n_b, edges = links_between(a, b, n_x[i], n_y[j], threshold, same)
                counts[row["b_a"]][1][i] += n_a
                counts[row["b_b"]][1][j] += n_b
                new = []
                for one, other in edges:
                    ends = int(ids_x[i[one]]), int(ids_y[j[other]])
                    r, t = (_find(root, root.setdefault(e, e)) for e in ends)
                    if r != t and NO_ID not in ends:
                        root[max(r, t)] = min(r, t)
                        new.append(ends)
                if new:
                    yield result(np.array([e[0] for e in new]), np.zeros(len(new), np.int64), np.array([e[1] for e in new]))
        for ids, links in counts.values():
            some = (links > 0) & (ids != NO_ID)
            yield result(ids[some], links[some])

    return link


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, vec_id: str = "vec_id", vector: str = "embedding", cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``."""
    spark = vectors.sparkSession
    v = F.col("v")
    single = vectors.schema[vector].dataType.simpleString() == "array<float>"
    real = "f4" if single else "f8"
    table = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    usable = usable_vector(v) & F.exists(v, lambda x: x != 0)
    rest = table.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    good = table.where(usable).select(F.col("vec_id").alias("id"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), F.size("v").alias("dim"), "v")
    sizes = {r.dim: r.c for r in good.groupBy("dim").agg(F.count("*").alias("c")).collect()}
    if not sizes:
        return rest.withColumn("kept", F.col("vec_id") == F.col("component_id"))
    pivots = {}
    for dim, rows in sizes.items():
        want = min(MAX_PIVOTS, blocks_for(rows, cell_rows))
        some = good.where(F.col("dim") == dim).orderBy(F.xxhash64("h1")).limit(want).select("v").collect()
        pivots[dim] = np.unique(_unit(np.array([r.v for r in some], np.float64)), axis=0)
    total = sum(sizes.values())
    stored = sum(rows * dim * np.dtype(real).itemsize for dim, rows in sizes.items())
    files = max(blocks_for(total, FILE_BLOCKS * block_rows), blocks_for(stored, FILE_BLOCKS * BLOCK_BYTES), min(spark.sparkContext.defaultParallelism, blocks_for(total, LEAST_ROWS)))
    placed = good.mapInArrow(lean(_place(pivots, real)), "dim int, cell int, h1 long, h2 long, id long, n long, data binary")
    order = ["dim", "cell", "h1", "h2"]
    packed = placed.repartitionByRange(files, *order).sortWithinPartitions(*order).mapInArrow(lean(_pack(pivots, real, block_rows)), "dim int, lo array<double>, hi array<double>, ids binary, n binary, data binary")
    blocks = keep(packed.withColumn("b", F.monotonically_increasing_id()), "blocks")
    a, b = (blocks.select(F.col("dim").alias("dim" if x == "a" else "dim_b"), *[F.col(c).alias(f"{c}_{x}") for c in ("b", "lo", "hi", "ids", "n", "data")]) for x in "ab")
    # a pair of blocks once, if their angles to every pivot allow a link; written so that Spark sees no equal keys to shuffle by
    reach = float(np.arccos(threshold)) + ANGLE_MARGIN
    near = F.expr(f"forall(zip_with(lo_a, hi_b, (x, y) -> x - y <= {reach!r}D), z -> z) and forall(zip_with(lo_b, hi_a, (x, y) -> x - y <= {reach!r}D), z -> z)")
    pairs = a.hint("shuffle_replicate_nl").join(b, (F.col("b_a") <= F.col("b_b")) & (F.col("dim") - F.col("dim_b") == 0) & near)
    columns = [f"{c}_{x}" for x in "ab" for c in ("b", "hi", "ids", "n", "data")]
    found = keep(pairs.select("dim", *columns).mapInArrow(lean(_link(pivots, real, threshold)), "id long, links long, other long"), "found")
    links = found.where("other is null").groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    # copies: the smallest id and the number of rows
    keyed = good.select("h1", "h2", F.col("id").alias("vec_id"))
    per = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count("*").alias("n")).join(links, "id", "left").join(comp, "id", "left")
    per = per.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    linked = keyed.join(per, ["h1", "h2"]).select("vec_id", F.col("links").alias("n_links"), F.col("component").alias("component_id"))
    return linked.union(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
