"""The one layout every window operator shares.

A ``SeriesFrame`` is a DataFrame with one row per ``(keys, pos)``, where ``pos`` is a
dense integer position inside the series.  On a time raster it is plain arithmetic on the
timestamp; for irregular rows ``number_rows`` computes it by a range shuffle.

A window over a bare series key would put a whole series into one task.  Because ``pos``
is dense, a row frame of ``w`` rows equals ``w`` positions, so the series is cut into
buckets of equal length:

* ``derive``  - bounded frames: every bucket is given the edge rows of its neighbours.  Steps are column
  expressions, or numpy kernels, to which only the columns they name are sent.
* ``running`` and ``fill`` - unbounded frames: every bucket is summarised to one row, the
  summaries are scanned in two levels, and the result is carried into the bucket.

Nothing is grouped or joined on the series key alone, so a hot series costs nothing extra.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "__bucket"
# All keys as one value, which is never NULL: rows that are placed by it and their bucket stay where they
# are in plain joins, while a join on NULL-safe keys places both sides anew.
KEY = "__key"
# The position, in tables of results that are joined to the rows.
PLACE = "__place"
# Rows per bucket.  A bucket is the unit of work of a task and of numpy kernels: large
# enough to make the duplicated edge rows cheap, small enough to sort in memory.
BUCKET_ROWS = 8192
# Buckets per group in the second level of carried scans.
GROUP_BUCKETS = 8192
# Shuffle files of a query are deleted when it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Rows a task sorts where their number is known: more rows make more tasks, not larger ones.
TASK_ROWS = 1 << 18


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Number of partitions for so many rows."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))


def floor_div(value: Column, size: int) -> Column:
    """Integer division rounding down, also for positions before the epoch."""
    size_lit = F.lit(int(size)).cast("long")
    return F.call_function("div", value - F.pmod(value, size_lit), size_lit)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, where NULL equals NULL; the keys of ``left`` stay."""
    other = right.withColumnsRenamed({k: f"__key_{k}" for k in keys})
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__key_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"__key_{k}" for k in keys])


def spread(home: Column, pos: Column, rows: int, back: int, ahead: int) -> Column:
    """Buckets that need a row: its own, the next one if it lies in the last ``back`` rows of
    its bucket, the previous one if it lies in the first ``ahead`` rows."""
    offset = F.pmod(pos, F.lit(rows).cast("long"))
    first = F.when(offset < ahead, home - 1).otherwise(home) if ahead else home
    last = F.when(offset >= rows - back, home + 1).otherwise(home) if back else home
    return F.explode(F.sequence(first, last)) if back or ahead else home


@dataclass(frozen=True)
class Span:
    """Window frames inside one bucket."""

    partition: tuple[str, ...]
    pos: str

    @property
    def whole(self):
        return Window.partitionBy(*self.partition)

    @property
    def ordered(self):
        return Window.partitionBy(*self.partition).orderBy(self.pos)

    @property
    def running(self):
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    def past(self, w: int):
        return self.ordered.rowsBetween(-(w - 1), 0)

    def next(self, w: int):
        return self.ordered.rowsBetween(1, w)

    def next_with_current(self, w: int):
        return self.ordered.rowsBetween(0, w - 1)


Phase = Callable[[Span], dict[str, Column]]


@dataclass(frozen=True)
class Step:
    """Columns computed from a bounded neighbourhood.

    ``phases`` run one after the other because a window function cannot be nested in
    another one.  Columns whose name starts with ``__`` are dropped at the end.
    """

    names: list[str]
    phases: list[Phase]
    lookback: int = 0
    lookahead: int = 0


#: Arrays of a bucket and its edge rows, in order of position: positions and columns (float, NaN for NULL).
KernelFunction = Callable[[np.ndarray, dict[str, np.ndarray]], "dict[str, np.ndarray | pa.Array]"]


@dataclass(frozen=True)
class Kernel:
    """Columns computed by numpy from a bounded neighbourhood.

    ``outputs`` maps names to types.  ``function`` gets the named ``columns`` of a bucket together with the
    last ``lookback`` rows before it and the first ``lookahead`` after it, and returns an array of the same
    length for every output; NaN, or a null of an Arrow array, becomes NULL.
    """

    outputs: dict[str, str]
    columns: list[str]
    function: KernelFunction
    lookback: int = 0
    lookahead: int = 0

    @property
    def names(self) -> list[str]:
        return list(self.outputs)


def renamed(s: Step | Kernel, name: str) -> Step | Kernel:
    """The same step with another name for its only output."""
    old = s.names[0]
    if isinstance(s, Kernel):
        return replace(s, outputs={name: s.outputs[old]}, function=lambda pos, values: {name: s.function(pos, values)[old]})
    last = s.phases[-1]
    return Step([name], [*s.phases[:-1], lambda span: {name: last(span)[old]}], s.lookback, s.lookahead)


def step(names: str | list[str], columns: Phase, lookback: int = 0, lookahead: int = 0) -> Step:
    return Step([names] if isinstance(names, str) else list(names), [columns], lookback, lookahead)


@dataclass(frozen=True)
class SeriesFrame:
    df: DataFrame
    keys: tuple[str, ...]
    ts: str = "ts"
    pos: str = "pos"
    step_us: int | None = None
    bucket_rows: int = field(default=BUCKET_ROWS)
    # Number of rows, if known: it sets how many tasks share the work of kernels and the join of their results.
    rows: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "keys", tuple([self.keys] if isinstance(self.keys, str) else self.keys))
        if not self.keys:
            raise ValueError("a series frame needs at least one key column")

    # -- plain DataFrame work ------------------------------------------------------------

    def with_df(self, df: DataFrame) -> SeriesFrame:
        return replace(self, df=df)

    def with_columns(self, columns: dict[str, Column]) -> SeriesFrame:
        return self.with_df(self.df.withColumns(columns)) if columns else self

    def where(self, condition) -> DataFrame:
        return self.df.where(condition)

    def home(self, rows: int | None = None) -> Column:
        return floor_div(F.col(self.pos), rows or self.bucket_rows)

    def placed(self, df: DataFrame | None = None) -> DataFrame:
        """The rows (or those of ``df``) with ``KEY`` and ``BUCKET``."""
        df = self.df if df is None else df
        return df.withColumns({KEY: F.struct(*self.keys), BUCKET: self.home()})

    def settle(self) -> SeriesFrame:
        """Write the rows to the reliable checkpoint folder and go on from there."""
        return self.with_df(settle(self.df))

    # -- bounded frames ------------------------------------------------------------------

    def derive(self, *stages: Step | Kernel | Iterable[Step | Kernel]) -> SeriesFrame:
        """Add the columns of the given steps.

        The steps of one stage do not depend on each other; a later stage may read the
        columns of an earlier one.  Stages of column expressions share one shuffle; the kernels of a
        stage share another, of the columns they name.
        """
        frame, waiting = self, []
        for stage in stages:
            group = [stage] if isinstance(stage, (Step, Kernel)) else list(stage)
            waiting.append([s for s in group if isinstance(s, Step)])
            kernels = [s for s in group if isinstance(s, Kernel)]
            if kernels:
                frame, waiting = frame._framed(waiting)._run(kernels), []
        out = frame._framed(waiting).df
        helpers = [c for c in out.columns if c.startswith("__")]
        return self.with_df(out.drop(*helpers)) if out is not self.df else self

    def _framed(self, groups: list[list[Step]]) -> SeriesFrame:
        """Columns of steps, helper columns included."""
        groups = [g for g in groups if g]
        if not groups:
            return self
        back = sum(max(s.lookback for s in g) for g in groups)
        ahead = sum(max(s.lookahead for s in g) for g in groups)
        rows = max(self.bucket_rows, 4 * max(back, ahead))
        home = self.home(rows)
        df = self.df.withColumns({KEY: F.struct(*self.keys), BUCKET: spread(home, F.col(self.pos), rows, back, ahead)})
        span = Span((BUCKET, KEY), self.pos)
        for group in groups:
            for n in range(max(len(s.phases) for s in group)):
                columns: dict[str, Column] = {}
                for s in group:
                    if n < len(s.phases):
                        columns.update(s.phases[n](span))
                if columns:
                    df = df.withColumns(columns)
        if back or ahead:
            df = df.where(F.col(BUCKET) == home)
        return self.with_df(df.drop(BUCKET, KEY))

    def _run(self, kernels: list[Kernel]) -> SeriesFrame:
        """Columns of kernels: keys, position and the named columns go to numpy, the results are joined to the rows."""
        back, ahead = max(k.lookback for k in kernels), max(k.lookahead for k in kernels)
        rows = max(self.bucket_rows, 4 * max(back, ahead))
        columns = list(dict.fromkeys(c for k in kernels for c in k.columns))
        outputs = {n: t for k in kernels for n, t in k.outputs.items()}
        pos = F.col(self.pos).cast("long")
        sent = self.df.select(F.struct(*self.keys).alias(KEY), spread(self.home(rows), pos, rows, back, ahead).alias(BUCKET), pos.alias(PLACE),
                              *[F.col(c).cast("double").alias(c) for c in columns])

        if self.rows is not None:
            sent = sent.repartition(tasks_for(sent.sparkSession, self.rows), BUCKET, KEY)

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by(PLACE)
            pos = table[PLACE].to_numpy()
            values = {c: table[c].to_numpy() for c in columns}
            found: dict[str, np.ndarray | pa.Array] = {}
            for k in kernels:
                found |= k.function(pos, {c: values[c] for c in k.columns})
            for n, x in found.items():
                if isinstance(x, np.ndarray):
                    found[n] = pa.array(x, mask=np.isnan(x)) if x.dtype.kind == "f" else pa.array(x)
            mine = (pos - pos % rows) // rows == table[BUCKET][0].as_py()
            out = pa.Table.from_arrays([table[KEY], table[PLACE], *[found[n] for n in outputs]], [KEY, PLACE, *outputs])
            return out.filter(pa.array(mine))

        schema = ", ".join([f"{KEY} {sent.schema[KEY].dataType.simpleString()}", f"{PLACE} long", *[f"`{n}` {t}" for n, t in outputs.items()]])
        return self.with_rows(sent.groupBy(BUCKET, KEY).applyInArrow(run, schema))

    def along(self, made: dict[str, Column], outputs: dict[str, str], function: Callable[[pa.Table], dict[str, pa.Array]],
              lookback: int) -> SeriesFrame:
        """Columns that ``function`` computes from Arrow tables of whole rows, in order of position.

        A table is a bucket with the last ``lookback`` rows before it.  Unlike those of kernels the rows go
        to Python and back with their results, so nothing is joined: for rows of few columns.  ``made`` are
        columns of the row that are added behind the shuffle.
        """
        rows = max(self.bucket_rows, 4 * lookback)
        tasks = [] if self.rows is None else [tasks_for(self.df.sparkSession, self.rows)]
        pos = F.col(self.pos).cast("long")
        sent = self.df.withColumn(BUCKET, spread(self.home(rows), pos, rows, lookback, 0))
        sent = sent.repartition(*tasks, BUCKET, *self.keys).withColumns({**made, PLACE: pos})
        kept = [c for c in sent.columns if c not in (BUCKET, PLACE, *outputs)]

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by(PLACE)
            pos = table[PLACE].to_numpy()
            mine = pa.array((pos - pos % rows) // rows == table[BUCKET][0].as_py())
            found = function(table)
            return pa.Table.from_arrays([*[table[c] for c in kept], *[found[n] for n in outputs]], [*kept, *outputs]).filter(mine)

        schema = T.StructType([*[T.StructField(c, sent.schema[c].dataType) for c in kept], *[T.StructField(n, T.DataType.fromDDL(t)) for n, t in outputs.items()]])
        return self.with_df(sent.groupBy(BUCKET, *self.keys).applyInArrow(run, schema))

    def with_rows(self, found: DataFrame) -> SeriesFrame:
        """The rows with the other columns of ``found``, which has one row for each by ``KEY`` and ``PLACE``."""
        fresh = [c for c in found.columns if c not in (KEY, PLACE)]
        mine = self.df.drop(*fresh).withColumns({KEY: F.struct(*self.keys), PLACE: F.col(self.pos).cast("long")})
        if self.rows is not None:
            tasks = tasks_for(mine.sparkSession, self.rows)
            mine, found = mine.repartition(tasks, PLACE, KEY), found.repartition(tasks, PLACE, KEY)
        return self.with_df(mine.join(found, [PLACE, KEY]).drop(PLACE, KEY))

    # -- unbounded frames ----------------------------------------------------------------

    def _carry(self, rows: DataFrame, summary: list[Column], scan: Callable[[DataFrame, Span, Span, list[str]], DataFrame],
               inner: str | None = None) -> DataFrame:
        """Join each bucket with what its predecessors (or successors) hand over.

        ``rows`` come from ``placed``.  ``summary`` are aggregates giving one row per bucket; ``scan`` turns
        these into carried columns, with one span over the buckets of a group, one over groups and
        the columns that tell series apart.
        ``inner`` names a key with few values (a parameter grid) by which the placed rows
        were multiplied: its states travel as one map per bucket, so that the join needs
        the placement of the rows only and they stay where they are.
        """
        keys = [KEY] if inner is None else list(self.keys)
        sums = rows.groupBy(BUCKET, *keys).agg(*summary)
        sums = sums.withColumn("__group", floor_div(F.col(BUCKET), GROUP_BUCKETS))
        within = Span(("__group", *keys), BUCKET)
        across = Span(tuple(keys), "__group")
        carried = scan(sums, within, across, keys).drop("__group")
        if inner is None:
            return rows.join(carried, [BUCKET, KEY], "left")
        outer = [k for k in keys if k != inner] + [BUCKET]
        states = [c for c in carried.columns if c not in (*keys, BUCKET)]
        packed = carried.groupBy(*outer).agg(
            F.map_from_entries(F.collect_list(F.struct(F.col(inner), F.struct(*states)))).alias("__states"))
        joined = join_on(rows, packed, outer, "left")
        mine = F.try_element_at("__states", F.col(inner))
        return joined.withColumns({c: mine[c] for c in states}).drop("__states")

    def running(self, sums: dict[str, Column]) -> SeriesFrame:
        """Running totals from the start of the series, current row included."""
        names = list(sums)
        rows = self.placed(self.df.withColumns({f"__in_{n}": c for n, c in sums.items()}))

        def scan(buckets: DataFrame, within: Span, across: Span, keys: list[str]) -> DataFrame:
            before = within.ordered.rowsBetween(Window.unboundedPreceding, -1)
            local = buckets.withColumns({f"__w_{n}": F.coalesce(F.sum(f"__t_{n}").over(before), F.lit(0)) for n in names})
            groups = buckets.groupBy(*keys, "__group").agg(*[F.sum(f"__t_{n}").alias(f"__g_{n}") for n in names])
            earlier = across.ordered.rowsBetween(Window.unboundedPreceding, -1)
            groups = groups.select(
                *keys, "__group", *[F.coalesce(F.sum(f"__g_{n}").over(earlier), F.lit(0)).alias(f"__a_{n}") for n in names])
            return local.join(groups, ["__group", *keys]).select(
                *keys, BUCKET, "__group", *[(F.col(f"__w_{n}") + F.col(f"__a_{n}")).alias(f"__c_{n}") for n in names])

        joined = self._carry(rows, [F.sum(f"__in_{n}").alias(f"__t_{n}") for n in names], scan)
        span = Span((BUCKET, KEY), self.pos)
        out = joined.withColumns({
            n: F.coalesce(F.sum(f"__in_{n}").over(span.running), F.lit(0)) + F.coalesce(F.col(f"__c_{n}"), F.lit(0))
            for n in names})
        return self.with_df(out.drop(*[c for c in out.columns if c.startswith("__")]))

    def fill(self, backward: dict[str, Column] | None = None, forward: dict[str, Column] | None = None,
             strict: bool = False) -> SeriesFrame:
        """Last non-NULL value so far and first non-NULL value from here on.

        ``backward`` looks at earlier rows, ``forward`` at later rows; with ``strict`` the
        current row itself is left out.  Values may be structs.
        """
        backward, forward = dict(backward or {}), dict(forward or {})
        inputs = {f"__in_{n}": c for n, c in {**backward, **forward}.items()}
        rows = self.placed(self.df.withColumns(inputs))
        pos_if = {n: F.when(F.col(f"__in_{n}").isNotNull(), F.col(self.pos)) for n in [*backward, *forward]}
        summary = [F.max_by(F.col(f"__in_{n}"), pos_if[n]).alias(f"__t_{n}") for n in backward]
        summary += [F.min_by(F.col(f"__in_{n}"), pos_if[n]).alias(f"__t_{n}") for n in forward]

        def scan(buckets: DataFrame, within: Span, across: Span, keys: list[str]) -> DataFrame:
            def last_before(span: Span, name: str) -> Column:
                return F.last(name, ignorenulls=True).over(span.ordered.rowsBetween(Window.unboundedPreceding, -1))

            def first_after(span: Span, name: str) -> Column:
                w = Window.partitionBy(*span.partition).orderBy(F.col(span.pos).desc())
                return F.last(name, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))

            local = {f"__w_{n}": last_before(within, f"__t_{n}") for n in backward}
            local.update({f"__w_{n}": first_after(within, f"__t_{n}") for n in forward})
            known = {n: F.when(F.col(f"__t_{n}").isNotNull(), F.col(BUCKET)) for n in [*backward, *forward]}
            groups = buckets.groupBy(*keys, "__group").agg(
                *[F.max_by(F.col(f"__t_{n}"), known[n]).alias(f"__g_{n}") for n in backward],
                *[F.min_by(F.col(f"__t_{n}"), known[n]).alias(f"__g_{n}") for n in forward])
            groups = groups.select(
                *keys, "__group",
                *[last_before(across, f"__g_{n}").alias(f"__a_{n}") for n in backward],
                *[first_after(across, f"__g_{n}").alias(f"__a_{n}") for n in forward])
            return buckets.withColumns(local).join(groups, ["__group", *keys]).select(
                *keys, BUCKET, "__group",
                *[F.coalesce(F.col(f"__w_{n}"), F.col(f"__a_{n}")).alias(f"__c_{n}") for n in [*backward, *forward]])

        joined = self._carry(rows, summary, scan)
        span = Span((BUCKET, KEY), self.pos)
        end = -1 if strict else 0
        asc = span.ordered.rowsBetween(Window.unboundedPreceding, end)
        desc = Window.partitionBy(*span.partition).orderBy(F.col(self.pos).desc()).rowsBetween(Window.unboundedPreceding, end)
        out = joined.withColumns({
            **{n: F.coalesce(F.last(f"__in_{n}", ignorenulls=True).over(asc), F.col(f"__c_{n}")) for n in backward},
            **{n: F.coalesce(F.last(f"__in_{n}", ignorenulls=True).over(desc), F.col(f"__c_{n}")) for n in forward}})
        return self.with_df(out.drop(*[c for c in out.columns if c.startswith("__")]))

    # -- per-series facts ----------------------------------------------------------------

    def bounds(self) -> DataFrame:
        """First and last position of every series."""
        return self.df.groupBy(*self.keys).agg(F.min(self.pos).alias("first_pos"), F.max(self.pos).alias("last_pos"))

    def attach(self, facts: DataFrame) -> DataFrame:
        """Join per-series facts (which include ``first_pos`` and ``last_pos``) to the rows.

        The facts are first spread over the buckets of their series, so that the join key
        is never the bare series key.
        """
        lo, hi = floor_div(F.col("first_pos"), self.bucket_rows), floor_div(F.col("last_pos"), self.bucket_rows)
        # in two steps, so that one row is not turned into all buckets of a series at once
        wide = facts.withColumn(KEY, F.struct(*self.keys)).drop(*self.keys).withColumn(
            "__wide", F.explode(F.sequence(floor_div(lo, GROUP_BUCKETS), floor_div(hi, GROUP_BUCKETS)))).repartition("__wide", KEY)
        first, last = F.greatest(lo, F.col("__wide") * GROUP_BUCKETS), F.least(hi, F.col("__wide") * GROUP_BUCKETS + (GROUP_BUCKETS - 1))
        spread = wide.withColumn(BUCKET, F.explode(F.sequence(first, last))).drop("__wide")
        return self.placed().join(spread, [BUCKET, KEY]).drop(BUCKET, KEY)

    # -- row selection by position -------------------------------------------------------

    def tail(self, n: int) -> SeriesFrame:
        """The last ``n`` rows of every series."""
        return self._cut(F.col(self.pos) > F.col("last_pos") - n)

    def drop_tail(self, n: int) -> SeriesFrame:
        """All but the last ``n`` rows of every series."""
        return self._cut(F.col(self.pos) <= F.col("last_pos") - n)

    def drop_head(self, n: int) -> SeriesFrame:
        """All but the first ``n`` rows of every series."""
        return self._cut(F.col(self.pos) >= F.col("first_pos") + n)

    def every_nth(self, n: int) -> DataFrame:
        """Every n-th row counted from the start.  The positions are no longer dense."""
        return self._cut((F.col(self.pos) - F.col("first_pos")) % n == 0).df

    def _cut(self, condition: Column) -> SeriesFrame:
        kept = self.attach(self.bounds()).where(condition).drop("first_pos", "last_pos")
        return self.with_df(kept)


_folders: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """A folder of this session below ``spark.checkpoint.dir``; it is deleted when the driver's JVM ends.

    Only a local master may go without the setting and gets a temporary folder: the executors of a
    cluster would each write to their own disk.
    """
    context = spark.sparkContext
    if context.applicationId not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if base is None:
            if context.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        path = context._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/tidemark-{uuid.uuid4().hex}")
        store = path.getFileSystem(context._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
        _folders[context.applicationId] = path.toString()
    return _folders[context.applicationId]


def release(df: DataFrame) -> None:
    """Delete the folders of settled rows that ``df`` reads; nothing may read them afterwards."""
    context = df.sparkSession.sparkContext
    root = checkpoint_dir(df.sparkSession)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/settled/" in folder and root.split(":")[-1] in folder:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder as a Parquet table and read them from there.

    This cuts the lineage and survives lost executors, and unlike a checkpointed RDD it is
    compressed and lets later steps read only the columns they need.  The shuffles that made the rows
    are not read again, so their files go at once.
    """
    path, conf = f"{checkpoint_dir(df.sparkSession)}/settled/{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            conf.unset(CLEANUP)
        else:
            conf.set(CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(df: DataFrame, keys: str | Iterable[str], order: list[str], ts: str = "ts", pos: str = "pos",
                partitions: int | None = None, columns: list[str] | None = None) -> SeriesFrame:
    """Number the rows of every series in the given total order, starting at 0.

    ``columns`` are those to go on with besides the keys and ``ts``; all, if it is left out.

    Rows are range-partitioned on all key and order columns and sorted, so that neither a
    hot series nor a hot instant ends up in one task.  The boundaries come from a sample,
    therefore the sorted rows are written once, with their number inside the partition;
    what is left is to add where each partition starts.  These few rows are written too: Spark
    then knows their size before it places the rows for the join.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    parts = [partitions] if partitions else []
    placed = df.repartitionByRange(*parts, *keys, *order).sortWithinPartitions(*keys, *order)
    if columns is not None:
        placed = placed.select(*dict.fromkeys([*keys, ts, *columns]))
    placed = settle(placed.withColumns({"__part": F.spark_partition_id(), "__id": F.monotonically_increasing_id()}))
    counts = placed.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per range partition and series in it: far fewer than rows
    starts = settle(counts.select(*keys, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift")))
    numbered = join_on(placed, starts, [*keys, "__part"]).withColumn(pos, F.col("__id") + F.col("__shift"))
    return SeriesFrame(numbered.drop("__part", "__id", "__shift"), tuple(keys), ts=ts, pos=pos, rows=placed.count())
