"""Mixing sources to target weights by a low-discrepancy schedule.

2**m slots are dealt to the sources: the van der Corput point of slot n (its bits reversed) is
looked up in the cumulative shares, so every run of slots holds each source in its share, and all
2**m points together are equally spaced, which gives each source its share of slots to within one.
The slots of a source are ranked; slot r of k takes words [r*t/k, (r+1)*t/k) of the source's
line, with t its target: equal blocks that add up to the target exactly.  The line of a source is
its documents in a seeded random order, repeated as often as the target asks for.

Rules
    * A document without words (NULL, empty or white space) has size 0 and takes nothing.
    * NULL is a source of its own, last in order.
    * Rows that share an id are dealt as separate rows; equal rows are interchangeable.
    * Targets: weights' shares of all words, none above ``max_repeat`` times its source.  What a
      source cannot take goes to the others by weight, until all fit.
    * An empty table gives an empty result.  Columns other than id, text and source pass through
      untouched by name.

Scale: words are counted once; the order inside a source is cut into ranges of the random key, so
a source that holds a third of all rows is many small groups; offsets come from one row per range.
One row per source is the only thing whose number is taken to be small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, few_rows, keep, words_count

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
SLOT_WORDS = 128
SLOT_CHUNK = 1 << 14
GROUP_ROWS = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    A source that is full at level x has max_repeat * size / weight <= x; in that order the level
    is found from running totals: the first source that the rest by weight does not overfill.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode(F.col("source"), "UTF-8"))
    nth = (F.row_number().over(order) - 1) % len(weights)
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth + 1).cast("int")))
    s = s.withColumn("limit", F.col("source_size") * float(max_repeat)).withColumn("ratio", F.col("limit") / F.col("w"))
    by = Window.orderBy("ratio", F.col("source").isNull(), "source")
    full = F.coalesce(F.sum("limit").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (total - full) / rest)
    # the first source that is not full at its level sets the level of all later ones
    first = F.min(F.when(F.col("level") < F.col("ratio"), F.struct("ratio", -F.col("level")))).over(Window.partitionBy())
    s = s.withColumn("final", -first["col2"])
    target = F.when(F.col("final").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("final") * F.col("w")))
    return s.select("source", "source_size", target.alias("target"))


def _reverse_bits(n: Column, bits: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(n), bits, "0")), 2, 10).cast("long") if bits else F.lit(0).cast("long")


def slots(spark, targets: DataFrame, slot_words: int = SLOT_WORDS) -> DataFrame:
    """(slot, source_no, k, rank, lo, hi): which source each slot takes and which words of its line.

    ``targets`` has source_no and words (the whole-number target); the driver reads one row per
    source of it.  A source whose share is less than one slot gets a slot of its own at the end.
    """
    rows = targets.where("words > 0").orderBy("source_no").select("source_no", "words").collect()
    if not rows:
        return spark.createDataFrame([], "slot long, source_no int, k long, rank long, lo long, hi long")
    total = sum(r.words for r in rows)
    bits = (-(-total // slot_words) - 1).bit_length()
    edges, run = [], 0
    for r in rows:  # the first point that belongs to the next source
        run += r.words
        edges.append(-(-(run << bits) // total))
    held = [e - b for e, b in zip(edges, [0, *edges[:-1]])]
    facts = few_rows(spark, [(r.source_no, r.words, max(1, k)) for r, k in zip(rows, held)], "source_no int, words long, k long")
    nth = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col("point"))) + 1
    dealt = (
        spark.range(0, 1 << bits, 1, max(1, min(10_000, (1 << bits) // SLOT_CHUNK)))
        .select(F.col("id").alias("slot"), F.floor(F.col("id") / SLOT_CHUNK).alias("chunk"), _reverse_bits(F.col("id"), bits).alias("point"))
        .select("slot", "chunk", F.element_at(F.array(*[F.lit(r.source_no) for r in rows]), nth.cast("int")).alias("source_no"))
    )
    alone = [((1 << bits) + i, -1, r.source_no) for i, (r, k) in enumerate(zip(rows, held)) if k == 0]
    if alone:
        dealt = dealt.union(few_rows(spark, alone, "slot long, chunk long, source_no int"))
    before = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy("source_no", "chunk").agg(F.count("*").alias("n")).select("source_no", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_no", "chunk").orderBy("slot")
    ranked = dealt.withColumn("r", F.row_number().over(inside) - 1).join(base, ["source_no", "chunk"]).join(F.broadcast(facts), "source_no")
    out = ranked.withColumn("rank", F.col("base") + F.col("r"))
    return out.select("slot", "source_no", "k", "rank", F.expr("rank * words div k").alias("lo"), F.expr("(rank + 1) * words div k").alias("hi"))


def mix(documents: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, slot_words: int = SLOT_WORDS, seed: str = "mix"):
    """(rows, pieces) of the mix of ``documents`` (doc_id, source, text, ...).

    ``rows``: doc_id, source, size, content, twin, source_no, source_size, target, words, line_start
    for every document; doc_id, source, content and twin name a row.
    ``pieces``: slot, the naming columns, epoch, first, last: the words [first, last) of a document
    that a slot takes, in the epoch-th run over its source.
    """
    spark = documents.sparkSession
    base = keep(named_rows(documents).select(*NAME, "size"), "sizes")
    per_source = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(per_source, weights, max_repeat)
    # rounding down loses less than a word of each source
    numbered = keep(
        targets.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))).withColumn("words", F.floor(F.col("target") + 1e-6)),
        "targets",
    )
    groups = 1 << (base.count() // GROUP_ROWS).bit_length()
    small = F.broadcast(numbered.withColumnRenamed("source", "s"))
    rows = base.join(small, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # the key orders a source at random, from the id and the seed alone, so reruns agree
    rows = rows.withColumn("key", F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"))))
    rows = rows.withColumn("range", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * groups / (1 << 32)))
    sums = rows.groupBy("source_no", "range").agg(F.sum("size").alias("part"))
    earlier = (Window.unboundedPreceding, -1)
    offsets = sums.select("source_no", "range", F.coalesce(F.sum("part").over(Window.partitionBy("source_no").orderBy("range").rowsBetween(*earlier)), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("source_no", "range").orderBy("key", "size", "content", "twin").rowsBetween(*earlier)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["source_no", "range"])
    rows = rows.withColumn("line_start", F.col("range_start") + F.col("inner")).select(*NAME, "size", "source_no", "source_size", "target", "words", "line_start")
    rows = keep(rows, "line")
    return rows, _pieces(rows, slots(spark, numbered, slot_words), max_repeat)


#: What names a row: equal rows are numbered.
NAME = ["doc_id", "source", "content", "twin"]


def named_rows(documents: DataFrame) -> DataFrame:
    """``documents`` with size, content (hash of the text) and twin (number among rows of equal id, source and text)."""
    named = documents.withColumn("size", words_count(F.col("text"))).withColumn("content", F.xxhash64("text"))
    return named.withColumn("twin", F.row_number().over(Window.partitionBy("doc_id", "source", "content").orderBy("size")))


def _pieces(rows: DataFrame, plan: DataFrame, max_repeat: int) -> DataFrame:
    """Joins documents with slots on the rank of the slots that hold their words."""
    counts = plan.select("source_no", "k").distinct()
    sized = rows.where("size > 0").join(F.broadcast(counts), "source_no")
    # one row per run over the source that the target reaches
    last = F.least(F.lit(max_repeat - 1), F.expr("(words - 1 - line_start) div source_size")).cast("int")
    runs = sized.where("words > line_start").withColumn("epoch", F.explode(F.sequence(F.lit(0), last)))
    runs = runs.withColumn("a", F.col("line_start") + F.col("epoch") * F.col("source_size"))
    runs = runs.withColumn("b", F.least(F.col("a") + F.col("size"), F.col("words")))
    # word x lies in the slot of the largest rank r with r * words div k <= x
    rank = lambda x: F.expr(f"(({x} + 1) * k - 1) div words")
    runs = runs.withColumn("rank", F.explode(F.sequence(rank("a"), rank("(b - 1)")))).drop("k")
    joined = runs.join(plan.drop("k"), ["source_no", "rank"])
    first, end = F.greatest("a", "lo") - F.col("a"), F.least("b", "hi") - F.col("a")
    return joined.select("slot", *NAME, "epoch", first.alias("first"), end.alias("last")).where("last > first")


def _plus(rows: DataFrame, facts: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with columns of ``facts``, joined on what names a row, NULL where there are none."""
    other = facts.select(*[F.col(c).alias(f"__{c}") for c in [*NAME, *columns]])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in NAME]
    on = same[0] & same[1] & same[2] & same[3]
    return rows.join(other, on, "left").drop(*[f"__{c}" for c in NAME]).withColumnsRenamed({f"__{c}": c for c in columns})


def taken(documents: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words of every document that the mix takes."""
    rows, pieces = mix(documents, **options)
    sums = pieces.groupBy(*NAME).agg(F.sum(F.col("last") - F.col("first")).alias("taken"))
    out = _plus(rows, sums, ["taken"])
    return out.select("doc_id", F.col("size").cast("long").alias("size"), F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The mix as documents: a row for every run over a source in which a document is taken.

    The text of a row is what the run takes: the whole text unchanged, or, where the target ends
    inside the document, the words taken, joined by one space.  Columns are those of ``documents``;
    n_chars, if there is one, is counted anew where a text is cut.
    """
    rows, pieces = mix(documents, **options)
    spans = pieces.groupBy(*NAME, "epoch").agg(F.max("last").alias("upto")).groupBy(*NAME).agg(F.collect_list("upto").alias("upto"))
    clash = {c: f"__own_{c}" for c in ("size", "content", "twin", "upto") if c in documents.columns}
    out = _plus(named_rows(documents.withColumnsRenamed(clash)), spans, ["upto"]).where("upto is not null").withColumn("upto", F.explode("upto"))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("upto").cast("int")), " ")
    out = out.withColumn("text", F.when(F.col("upto") < F.col("size"), head).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col("upto") < F.col("size"), F.length("text").cast(documents.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("size", "content", "twin", "upto").withColumnsRenamed({v: k for k, v in clash.items()}).select(*documents.columns)
