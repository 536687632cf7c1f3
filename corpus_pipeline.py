"""A training corpus from ``documents``: language, repeated lines, near-duplicates, mix of sources, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and gives it to the next one.  All stages but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, lines, minhash, mixing, packing
from tidemark.llm.common import WORD, keep
from tidemark.llm.queries import tokenizer_files

#: Near-duplicates of the pipeline share 80 of 100 shingles.
PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; a missing language is filled in with the predicted one."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3, F.lit(0))
    samples = language.fit(docs.where(fold != 1), order=F.xxhash64("doc_id"))
    found = language.predict(docs, samples).where("lang_pred <> 'und'" if samples else "true")
    return found.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that came before, up to one word, go, and so do documents of which no word is left."""
    found = lines.dedup_lines(docs)
    changed = F.col("n_removed") > 0
    found = found.where(~changed | F.col("text").rlike(WORD))
    return found.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near-duplicates stays; rows of one id stay or go together."""
    gone = minhash.near_duplicates(docs.select("doc_id", "text"), PERCENT).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: documents repeated, cut or left out as the schedule says."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, *tokenizer_files())


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

#: The language model and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
