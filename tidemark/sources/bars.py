"""Reading, writing and updating bar tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names and types of a full and of a reduced bar row.
FULL_BAR = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
    T.StructField("close_time", T.LongType()),
    T.StructField("quote_av", T.DoubleType()),
    T.StructField("trades", T.LongType()),
    T.StructField("tb_base_av", T.DoubleType()),
    T.StructField("tb_quote_av", T.DoubleType()),
    T.StructField("ignore", T.DoubleType()),
])
REDUCED_BAR = T.StructType(FULL_BAR.fields[:6])
TRANSACTION = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("profit", T.DoubleType()),
    T.StructField("status", T.StringType()),
])


def table_format(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1]
    if ext not in (".csv", ".parquet"):
        raise ValueError(f"a table must end in .csv or .parquet, not {ext!r}")
    return ext[1:]


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Read a CSV (with header, ISO 8601 times) or Parquet table by its extension."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    if table_format(path) == "parquet":
        return reader.parquet(path)
    if schema is None:
        raise ValueError("a CSV table needs a schema")
    return reader.option("header", True).option("enforceSchema", False).csv(path)


def write_table(df: DataFrame, path: str, partition_by: str | list[str] | None = None, decimals: int | None = 6,
                mode: str = "overwrite") -> None:
    """Write by extension.  CSV numbers are written with a fixed number of decimals."""
    fmt = table_format(path)
    if fmt == "csv" and decimals is not None:
        floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
        df = df.withColumns({n: F.format_string(f"%.{decimals}f", F.col(n)) for n in floats}) if floats else df
        # format_string turns NULL into the text 'null'
        df = df.withColumns({n: F.when(F.col(n) != "null", F.col(n)) for n in floats}) if floats else df
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)


def _one_per_key(df: DataFrame, key: list[str], chosen: Column) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    picked = df.groupBy(*key).agg(chosen.alias("__row"))
    return picked.select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def keep_last(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the latest in the given order.  Combines before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    return _one_per_key(df, key, F.max_by(F.struct(*rest), F.struct(*order)))


def keep_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the earliest in the given order."""
    rest = [c for c in df.columns if c not in key]
    return _one_per_key(df, key, F.min_by(F.struct(*rest), F.struct(*order)))


def append_bars(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Append a newer batch; on equal keys the newer row wins."""
    tagged = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)))
    return keep_last(tagged, key, ["__batch"]).drop("__batch")


def complete_bars(df: DataFrame, now: Column, freq: str, ts: str = "ts") -> DataFrame:
    """Only bars that ended before the interval holding ``now``."""
    from tidemark.functions.intervals import interval_start

    return df.where(F.col(ts) < interval_start(now, freq))


def epoch_to_timestamp(c: Column, unit: str = "ms") -> Column:
    if unit == "ms":
        return F.timestamp_millis(c.cast("long"))
    if unit == "s":
        return F.timestamp_seconds(c.cast("long"))
    raise ValueError(f"unknown epoch unit {unit!r}")


def typed_bars(df: DataFrame, schema: T.StructType = FULL_BAR, unit: str = "ms", keys: tuple[str, ...] = ()) -> DataFrame:
    """Cast raw vendor rows (text or numbers, epoch time) to the bar types; columns named as ``keys`` come along as they are."""
    first, *rest = schema.fields
    return df.select(
        *keys,
        epoch_to_timestamp(F.col(first.name), unit).alias(first.name),
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in rest if f.name in df.columns])


def daily_vendor_bars(df: DataFrame, date: str = "Date", ts: str = "timestamp") -> DataFrame:
    """Lower-case vendor columns; the date becomes the timestamp of the bar start."""
    out = df.select(*[F.col(c).alias(c.lower()) for c in df.columns])
    return out.withColumn(ts, F.col(date.lower()).cast("timestamp")).drop(date.lower())


def null_report(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Number of NULLs per column, and of rows with any NULL, largest first."""
    columns = columns or df.columns
    any_null = F.greatest(*[F.col(c).isNull() for c in columns]) if len(columns) > 1 else F.col(columns[0]).isNull()
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns], F.count_if(any_null).alias("__any"))
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns) + ", 'any column', `__any`"
    return counts.selectExpr(f"stack({len(columns) + 1}, {pairs}) AS (column_name, nulls)").orderBy(
        F.col("nulls").desc(), "column_name")


# -- transaction log -------------------------------------------------------------------------


def append_transactions(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def last_row(df: DataFrame, keys: list[str], ts: str = "timestamp") -> DataFrame:
    """The latest row of every series."""
    rest = [c for c in df.columns if c not in keys]
    return _one_per_key(df, keys, F.max_by(F.struct(*rest), F.col(ts)))


def append_report(df: DataFrame, path: str) -> None:
    """Append result rows (a ranking, a table of metrics) as text lines."""
    df.select(F.concat_ws(",", *[F.col(c).cast("string") for c in df.columns]).alias("line")).write.mode("append").text(path)


def append_ranking(df: DataFrame, path: str, order: list[Column], top: int) -> None:
    """Append the ``top`` rows by ``order`` as one CSV file; only the first file of ``path`` has a header."""
    spark = df.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    new = not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    df.orderBy(*order).limit(top).write.mode("append").option("header", new).csv(path)
