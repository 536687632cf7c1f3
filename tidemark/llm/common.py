"""Shared storage, words and connected components of the pipeline operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[9, 10, 11, 12, 13, 32]] = True

_folders: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """A folder of this session below ``spark.checkpoint.dir``, deleted when the driver's JVM ends.

    Without the setting a local master gets a temporary folder; any other master is refused, as
    its executors would not share it.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="tidemark-")
        folder = f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _folders[app] = folder
    return _folders[app]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def few_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of rows of the driver; by way of Arrow, as a list would need Python workers of its own to read it."""
    import pyarrow as pa

    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame(pa.table([pa.array([r[k] for r in rows]) for k in range(len(names))], names=names), schema)


def words_count(text: Column) -> Column:
    """Number of words; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def usable_vector(v: Column) -> Column:
    """True for a vector without NULL or non-finite components that has at least one component."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~bad, F.lit(False))


def blocks_for(rows: int, per_block: int) -> int:
    return max(1, -(-rows // per_block))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over undirected ``edges`` (a, b); ids without an edge are left out.

    Every id points to a smaller one.  A round hooks the parents of linked ids to the smallest
    parent seen and then replaces each parent by its parent, so paths halve; all steps are
    aggregates that combine before the shuffle and joins whose hot keys Spark may split.
    """
    both = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = keep(both, "links")
    for _ in range(max_rounds):
        # each larger end keeps its smallest neighbour as parent; its other neighbours are linked to that parent
        parent = links.groupBy("a").agg(F.min("b").alias("p"))
        rest = links.join(parent, "a").where("b <> p").select(F.greatest("b", "p").alias("a"), F.least("b", "p").alias("b"))
        lifted = parent.select("a", F.col("p").alias("b")).union(rest)
        # jump: a -> b becomes a -> p(b); every id keeps an ancestor, so the trees stay whole
        above = parent.select(F.col("a").alias("b"), "p")
        links = keep(lifted.join(above, "b", "left").select("a", F.coalesce("p", "b").alias("b")).distinct(), "links")
        # done when every id has one parent and no parent has one itself
        ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
        roles = ends.groupBy("e.id").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down"))
        if roles.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return links.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    )


def text_buffer(array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array without copying; NULL has length 0."""
    import pyarrow as pa

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary()) if array.null_count == 0 else array.fill_null("").cast(pa.large_binary())
    off = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


_R = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(20240613).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finishing steps of a 64-bit hash (SplitMix constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2**64 and of its inverse, for at least n positions."""
    if len(_powers[0]) < n:
        n = 1 << int(n - 1).bit_length()
        inverse = pow(int(_R), -1, 1 << 64)
        for k, base in enumerate((int(_R), inverse)):
            p = np.ones(1, np.uint64)
            while len(p) < n:
                p = np.concatenate([p, p * np.uint64(pow(base, len(p), 1 << 64))])
            _powers[k] = p
    return _powers[0], _powers[1]


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, hash) of all words of a text buffer; no word crosses a row.

    The hash is a polynomial over random byte values, so it depends on the word's bytes alone.
    """
    n = len(data)
    if n == 0:
        e = np.zeros(0, np.int64)
        return e, e, e, np.zeros(0, np.uint64)
    solid = ~SPACE_BYTES[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    cut = off[1:-1]
    before[cut[cut < n]] = False
    start = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[cut[(cut > 0) & (cut <= n)] - 1] = False
    end = np.flatnonzero(solid & ~after) + 1
    row = np.searchsorted(off, start, "right") - 1
    total = np.zeros(n + 1, np.uint64)
    block = 1 << 19  # bounded memory for the powers
    up, down = _power_tables(min(n, block) + 1)
    carry = np.uint64(0)
    scale = np.uint64(1)
    first_of = []
    for a in range(0, n, block):
        b = min(n, a + block)
        part = np.cumsum(_BYTE[data[a:b]] * up[: b - a], dtype=np.uint64) * scale + carry
        total[a + 1 : b + 1] = part
        carry = part[-1]
        first_of.append(scale)
        scale = scale * np.uint64(pow(int(_R), b - a, 1 << 64))
    hashed = (total[end] - total[start]) * down[start % block]
    if n > block:
        inverse = np.array([pow(int(s), -1, 1 << 64) for s in first_of], np.uint64)
        hashed = hashed * inverse[start // block]
    return start, end, row, mix64(hashed ^ (end - start).astype(np.uint64))


def give_back() -> None:
    """Memory that was freed goes back to the system: Arrow's pool and, where it can be asked, the C library's heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(function):
    """``function`` for mapInArrow; its worker gives freed memory back after each task.

    Spark keeps workers for later tasks and stages, and an idle one would hold what its largest task took.
    """

    def run(batches):
        try:
            yield from function(batches)
        finally:
            give_back()

    return run


def row_runs(batch, at: int, most: int = 8 << 20):
    """Runs of rows of an Arrow batch with about ``most`` bytes in column ``at``; a longer row is a run alone."""
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right")))
        yield batch.slice(a, b - a)
        a = b


def chain(values: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs [first, end) of ``values``; equal runs have equal hashes wherever they lie."""
    up, down = _power_tables(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=total[1:])
    return mix64((total[end] - total[first]) * down[first] + (end - first).astype(np.uint64))
