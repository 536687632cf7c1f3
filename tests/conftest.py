import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark.frame import SeriesFrame  # noqa: E402
from tidemark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "tidemark-tests")
    yield session
    session.stop()


@pytest.fixture
def make_frame(spark):
    """Series frame from {series: {column: values}}; positions start at ``start``."""

    def build(data: dict, bucket_rows: int = 16, start: int = 5) -> SeriesFrame:
        parts = []
        for name, columns in data.items():
            pdf = pd.DataFrame(columns)
            pdf.insert(0, "series", name)
            pdf.insert(1, "pos", np.arange(start, start + len(pdf)))
            parts.append(pdf)
        pdf = pd.concat(parts, ignore_index=True)
        df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema=_schema(pdf))
        df = df.withColumn("ts", F.timestamp_micros(F.col("pos") * 3_600_000_000))
        return SeriesFrame(df, ("series",), bucket_rows=bucket_rows)

    return build


def _schema(pdf: pd.DataFrame) -> str:
    kinds = {"f": "double", "i": "long", "b": "boolean", "O": "string"}
    return ", ".join(f"`{c}` {'string' if c == 'series' else kinds[pdf[c].dtype.kind]}" for c in pdf.columns)


@pytest.fixture
def column_of():
    """Values of a column in series order, as a float array with NaN for NULL."""

    def read(frame: SeriesFrame, name: str, series: str = "a"):
        rows = frame.df.where(F.col("series") == series).orderBy("pos").select(name).collect()
        return np.array([np.nan if r[0] is None else float(r[0]) for r in rows])

    return read


def random_walk(n: int, seed: int, nulls: float = 0.0, step: float = 1.0):
    rng = np.random.default_rng(seed)
    x = 100 + np.cumsum(rng.normal(0, step, n))
    x = np.round(x, 2)
    if nulls:
        x[rng.random(n) < nulls] = np.nan
    return x
