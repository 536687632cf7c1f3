"""Line deduplication within one edit of a word, with DataFrame functions only.

The deletion neighbourhood of a line is what is left when one word is taken out.  Two lines of one
word's edit share a variant: both without the replaced word, or the longer one without the added
word and the shorter one as it is.  A variant is named by where the word is missing, the hash of the
words before and the hash of the words after, so a line of n words has 2n + 1 variants and all of
them come from two running sums.

Rules
    * A line ends at a line feed; its words are runs of anything but ASCII white space.  Lines of
      equal words are equal.  Lines without words always stay.
    * A line goes if an equal line, or for lines of ``min_words`` or more one that differs by one word
      replaced, added or removed, comes earlier, by (doc_id, line number), whether that one stays
      or not.  Earlier lines may be in the same document.
    * Rows that share an id are one document whose lines share their numbers: a line is not earlier
      than the one of the same number.  A NULL id comes last.  A NULL text has no lines.
    * Extra columns are untouched; an empty table gives no rows.

Scale: two lines of one edit share their first or their last half; keys of the halves, combined
before the shuffle, leave the few lines that share one with another line, and only these emit
variants, only for the half that may differ.  Each text is one row from then on, wherever and how
often it stands.  Groups are reduced to their earliest line by aggregates and met by joins, which
Spark splits where a key is hot; no group is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, keep

MIN_WORDS = 5
_LAST = (1 << 63) - 1
_ID = ["t1", "t2"]
_AT = ["did", "line"]


def _line_rows(documents: DataFrame) -> DataFrame:
    """did, line, words, n, t1, t2 (hash of the words) for every line with words."""
    rows = documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("did"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("line", "content"))
    rows = rows.select("did", "line", F.regexp_extract_all("content", F.lit(WORD), F.lit(0)).alias("words"))
    return rows.withColumn("n", F.size("words")).where("n > 0").withColumns({"t1": F.xxhash64("words"), "t2": F.xxhash64(F.lit(7), "words")})


def _half_keys() -> Column:
    """Keys of the first and last (n-1)/2 and n/2 words; the lowest bit tells the side."""
    n = F.col("n")
    out = []
    for side in (0, 1):
        for h in (F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")):
            part = F.slice("words", 1 if side == 0 else n - h + 1, h)
            out.append(F.shiftleft(F.shiftright(F.xxhash64(h, part), 1), 1).bitwiseOR(F.lit(side).cast("long")))
    return F.array_distinct(F.array(*out))


def _variants(lines: DataFrame) -> DataFrame:
    """did, line, k1, k2: the variants of each line on the sides that may differ."""
    words = lines.select("did", "line", "n", "first_half", "last_half", F.posexplode("words").alias("j", "word"))
    # a hash of 64 bits as two numbers of 40 bits, so that sums over a line do not overflow
    parts = {}
    for side, place in (("l", F.col("j")), ("r", F.col("n") - 1 - F.col("j"))):
        h = F.xxhash64("word", place)
        parts |= {f"{side}1": F.shiftright(h, 24), f"{side}2": h.bitwiseAND(F.lit((1 << 40) - 1))}
    words = words.select("did", "line", "n", "first_half", "last_half", "j", *[c.alias(k) for k, c in parts.items()])
    whole = Window.partitionBy("did", "line")
    upto = whole.orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = words.select("did", "line", "n", "first_half", "last_half", "j", *[c for k in parts for c in (F.col(k), F.sum(k).over(upto).alias(f"s{k}"), F.sum(k).over(whole).alias(f"t{k}"))])
    before = [F.col(f"sl{i}") - F.col(f"l{i}") for i in (1, 2)]
    after = [F.col(f"tr{i}") - F.col(f"sr{i}") for i in (1, 2)]
    key = lambda a, b: F.struct(F.xxhash64(*a, *b).alias("k1"), F.xxhash64(F.lit(7), *a, *b).alias("k2"))
    half = F.floor((F.col("n") - 1) / 2)
    # a shared first half leaves places from its end on, a shared last half those up to its start
    open_at = lambda x: (F.col("first_half") & (x >= half)) | (F.col("last_half") & (x <= F.col("n") - half))
    gap = key(before, [F.col(f"tr{i}") - F.col(f"sr{i}") + F.col(f"r{i}") for i in (1, 2)])
    end = key([F.col(f"sl{i}") for i in (1, 2)], after)
    made = F.array(
        F.when(open_at(F.col("j")), key(before, after)),
        F.when(open_at(F.col("j")), gap),
        F.when((F.col("j") == F.col("n") - 1) & open_at(F.col("n")), end),
    )
    out = sums.select("did", "line", F.explode(F.array_distinct(made)).alias("k")).where("k is not null")
    return out.select("did", "line", "k.k1", "k.k2")


def within_one_word(a: Column, b: Column) -> Column:
    """True if two arrays of words differ by at most one word replaced, added or removed."""
    short, long = F.when(F.size(a) <= F.size(b), a).otherwise(b), F.when(F.size(a) <= F.size(b), b).otherwise(a)
    same = F.zip_with(short, F.slice(long, 1, F.size(short)), lambda x, y: x == y)
    lead = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(short)).cast("int")
    rest = F.slice(long, lead + 2, F.size(long))
    replaced = (F.size(a) == F.size(b)) & (rest == F.slice(short, lead + 2, F.size(long)))
    added = (F.size(long) == F.size(short) + 1) & (rest == F.slice(short, lead + 1, F.size(long)))
    return replaced | added


def line_decisions(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """did, line, kept for every line with words of ``documents`` (doc_id, text); did is the id, or the largest number for NULL."""
    # texts are split and hashed once; from here on a line is its place, its hash and the keys of its halves
    halves = F.when(F.col("n") >= min_words, _half_keys()).alias("halves")
    lines = keep(_line_rows(documents).select(*_AT, *_ID, halves), "lines")
    firsts = keep(lines.groupBy(*_ID).agg(F.min(F.struct(*_AT)).alias("at")).select(*_ID, "at.did", "at.line"), "firsts")
    halves = lines.select(*_AT, "t1", F.explode("halves").alias("key"))
    shared = keep(halves.groupBy("key").agg(F.min("t1").alias("a"), F.max("t1").alias("b")).where("a < b").select("key"), "halves")
    # lines that share a half, and which
    found = halves.drop("t1").join(shared, "key").groupBy(*_AT).agg(F.max(F.col("key").bitwiseAND(F.lit(1)) == 0).alias("first_half"), F.max(F.col("key").bitwiseAND(F.lit(1)) == 1).alias("last_half"))
    marked = found.join(firsts.select(*_AT), _AT, "left_semi")
    per_doc = marked.groupBy("did").agg(F.collect_list(F.struct("line", "first_half", "last_half")).alias("marks"))
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    texts = documents.select(ids.alias("did"), F.split(F.col("text").cast("string"), "\n").alias("lines")).join(per_doc, "did")
    texts = texts.select("did", "lines", F.explode("marks").alias("m")).select("did", "m.*", F.regexp_extract_all(F.get("lines", F.col("m.line")), F.lit(WORD), F.lit(0)).alias("words"))
    # of rows that share an id, the line whose text is first there; only that one is a text's place
    texts = texts.withColumns({"t1": F.xxhash64("words"), "t2": F.xxhash64(F.lit(7), "words"), "n": F.size("words")})
    texts = keep(texts.join(firsts, [*_ID, *_AT], "left_semi").dropDuplicates([*_ID]), "texts")
    variants = _variants(texts)
    leads = variants.groupBy("k1", "k2").agg(F.min(F.struct(*_AT)).alias("lead"), F.max(F.struct(*_AT)).alias("other")).where("lead < other").drop("other")
    pairs = variants.join(leads, ["k1", "k2"]).where(F.col("lead") < F.struct(*_AT)).select(*_AT, F.col("lead.did").alias("lead_did"), F.col("lead.line").alias("lead_line")).distinct()
    mine = texts.select(*_AT, *_ID, "words")
    theirs = texts.select(F.col("did").alias("lead_did"), F.col("line").alias("lead_line"), F.col("words").alias("lead_words"))
    near = pairs.join(mine, _AT).join(theirs, ["lead_did", "lead_line"]).where(within_one_word(F.col("words"), F.col("lead_words"))).select(*_ID).distinct()
    near = keep(near.withColumn("near", F.lit(True)), "near")
    # every line against the place of its text
    places = firsts.select(*_ID, F.col("did").alias("first_did"), F.col("line").alias("first_line")).join(near, _ID, "left")
    joined = lines.select(*_AT, *_ID).join(places, _ID)
    first = (F.col("did") == F.col("first_did")) & (F.col("line") == F.col("first_line"))
    return joined.select("did", F.col("line").cast("long").alias("line"), (first & F.col("near").isNull()).alias("kept"))


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``documents`` with the lines that stay as text, and n_lines and n_removed."""
    gone = line_decisions(documents.select("doc_id", "text"), min_words).where("not kept").groupBy("did").agg(F.collect_set(F.col("line").cast("int")).alias("__gone")).withColumnRenamed("did", "__of")
    ids = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    rows = documents.withColumn("__did", ids).join(gone, F.col("__did") == F.col("__of"), "left").drop("__of", "__did")
    rows = rows.withColumn("__lines", F.split(F.col("text").cast("string"), "\n"))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("__lines", i)), "\n"))
    n = F.coalesce(F.size("__lines"), F.lit(0))
    n = F.when(F.col("text").isNull(), 0).otherwise(n).cast("long")
    removed = F.when(F.col("__gone").isNull(), 0).otherwise(n - F.size(left)).cast("long")
    rows = rows.select("*", text.alias("__text"), n.alias("n_lines"), removed.alias("n_removed"))
    return rows.withColumn("text", F.col("__text")).drop("__lines", "__gone", "__text")
