"""Registry of the catalogue: named queries over the provided tables with comparison SQL.

Both sides end in the same typed projection: text, whole numbers (times as epoch seconds,
flags as 0/1) and doubles rounded to six digits.  Where results are short fractions, such as 77/640 or
733/1024, which lie just between two rounded values, both sides are moved by the same small part of the last
digit first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import rounded

Build = Callable[[SparkSession, str], DataFrame]
DIGITS, OFFSET = 6, {"d": 0.0, "f": 3.3e-8}
# Rounded columns from which one of them goes through a lambda.  Spark's whole-stage code of a projection is one method,
# and Java runs a method of more than 8,000 bytes uncompiled; a projection with a lambda stays out of that code, and its own is cut up.
WIDE = 12


@dataclass(frozen=True)
class Entry:
    build: Build
    sql: str | None


CATALOGUE: dict[str, Entry] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [(p.rsplit(":", 1)[0], p.rsplit(":", 1)[1]) for p in spec.split()]


def _rounded(c: Column) -> Column:
    return rounded(c, DIGITS) + F.lit(0.0)


def project(df: DataFrame, spec: str) -> DataFrame:
    """Typed projection; kinds are s (text), b (whole number), d and f (doubles)."""
    typed, out = [], []
    columns = _columns(spec)
    wide = sum(kind in OFFSET for _, kind in columns) > WIDE
    for name, kind in columns:
        c = value = F.col(f"`{name}`")
        of = df.schema[name].dataType
        if kind == "s":
            typed.append(c.cast("string").alias(name))
        elif kind == "b":
            seconds = isinstance(of, (T.TimestampType, T.TimestampNTZType, T.DateType))
            typed.append((F.unix_seconds(c.cast("timestamp")) if seconds else c.cast("long")).alias(name))
        else:
            typed.append((c.cast("double") + OFFSET[kind]).alias(name))
            value = _rounded(c)
            if wide:
                value, wide = F.element_at(F.transform(F.array(c), _rounded), 1), False
        out.append(value.alias(name))
    return df.select(*typed).select(*out)


def _typed_sql(spec: str, body: str) -> str:
    kinds = {"s": "CAST({0} AS VARCHAR)", "b": "CAST({0} AS BIGINT)", **{k: f"round(CAST({{0}} AS DOUBLE) + {x:.9f}::DOUBLE, {DIGITS}) + 0.0" for k, x in OFFSET.items()}}
    columns = ", ".join(f'{kinds[k].format(chr(34) + n + chr(34))} AS "{n}"' for n, k in _columns(spec))
    return f"SELECT {columns} FROM ({body})"


def register(name: str, spec: str, build: Build, ctes: str | None = None, body: str | None = None) -> None:
    """Add a query; without ``body`` there is no comparison SQL."""
    if name in CATALOGUE:
        raise ValueError(f"{name} is registered already")
    sql = None
    if body is not None:
        typed = _typed_sql(spec, body)
        sql = f"WITH RECURSIVE {ctes.strip()}\n{typed}" if ctes else typed
    CATALOGUE[name] = Entry(lambda spark, sf_dir: project(build(spark, sf_dir), spec), sql)


def load() -> dict[str, Entry]:
    from tidemark.plans import catalog_ingest, catalog_signals, catalog_training, catalog_windows  # noqa: F401

    return CATALOGUE
