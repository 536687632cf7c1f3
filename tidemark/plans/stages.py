"""The usual chain on top of the operators: features, labels, training, scoring, signals, sweep.

Each stage takes a series frame and plain dicts and returns a lazy frame; the whole chain can
be one Spark plan, or each stage can be written with ``settle`` or ``write_table``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.frame import SeriesFrame
from tidemark.functions.intervals import micros
from tidemark.functions.numeric import clean
from tidemark.operators import models as ML
from tidemark.operators.metrics import score_columns_metrics
from tidemark.operators.trades import sweep
from tidemark.plans.specs import apply_specs
from tidemark.sources.bars import null_report

# Bar columns kept beside features, labels and scores where present.
BAR_COLUMNS = ["open", "high", "low", "close", "volume", "close_time"]


def select_existing(frame: SeriesFrame, features: list[str] = (), labels: list[str] = (), extra: list[str] = ()) -> SeriesFrame:
    """Keys, time, the bar columns that exist, then features and labels, each once."""
    wanted = [*frame.keys, frame.ts, frame.pos, *[c for c in BAR_COLUMNS if c in frame.df.columns], *features, *labels, *extra]
    missing = [c for c in (*features, *labels) if c not in frame.df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    return frame.with_df(frame.df.select(*dict.fromkeys(c for c in wanted if c in frame.df.columns)))


def flags_to_int(df: DataFrame, labels: list[str]) -> DataFrame:
    """Boolean labels as 0 and 1."""
    flags = [f.name for f in df.schema.fields if f.name in labels and isinstance(f.dataType, T.BooleanType)]
    return df.withColumns({n: F.col(n).cast("int") for n in flags}) if flags else df


def time_or_offset(frame: SeriesFrame, start=None, end=None) -> SeriesFrame:
    """Rows from a start on and before an end: texts are times, numbers count rows to skip."""
    ts = F.col(frame.ts)
    if isinstance(start, str):
        frame = frame.with_df(frame.df.where(ts >= F.lit(start).cast("timestamp")))
    if isinstance(end, str):
        frame = frame.with_df(frame.df.where(ts < F.lit(end).cast("timestamp")))
    if isinstance(start, int):
        frame = frame.drop_head(start)
    if isinstance(end, int):
        frame = frame.drop_tail(end)
    return frame


def locate_row(frame: SeriesFrame, instant: str | Column) -> DataFrame:
    """Row number (from 0) of an instant in every series; an error when no series has it."""
    at = F.lit(instant).cast("timestamp") if isinstance(instant, str) else instant
    rows = frame.attach(frame.bounds()).where(micros(F.col(frame.ts)) == micros(at))
    found = rows.select(*frame.keys, (F.col(frame.pos) - F.col("first_pos")).alias("row_no"))
    if found.isEmpty():
        raise ValueError(f"no row at {instant!r}")
    return found


def feature_stage(frame: SeriesFrame, specs: list[dict], rows: int | None = None, horizon: int = 0) -> tuple[SeriesFrame, list[str]]:
    """Apply feature (or label, or signal) specs, to the last ``rows + horizon`` rows if given."""
    return apply_specs(frame.tail(rows + horizon) if rows else frame, specs)


def report_stage(frame: SeriesFrame, columns: list[str]) -> DataFrame:
    return null_report(frame.df, columns)


def training_stage(frame: SeriesFrame, features: list[str], labels: list[str], algorithms: list[dict],
                   label_horizon: int = 0, rows: int | None = None):
    """Fit all models on rows whose labels are complete."""
    frame = select_existing(frame, features, labels)
    if label_horizon:
        frame = frame.drop_tail(label_horizon)
    if rows:
        frame = frame.tail(rows)
    df = clean(flags_to_int(frame.df, labels), features)
    return ML.train_all(df, features, labels, algorithms, list(frame.keys), [frame.ts])


def scoring_stage(frame: SeriesFrame, features: list[str], labels: list[str], algorithms: list[dict], models) -> tuple[SeriesFrame, list[str]]:
    df, names = ML.predict_all(frame.df, features, labels, algorithms, models)
    return frame.with_df(df), names


def metrics_stage(frame: SeriesFrame, score_columns: list[str], regression: bool = False) -> DataFrame:
    return score_columns_metrics(frame.df, score_columns, regression)


def sweep_stage(frame: SeriesFrame, scores: list[str], grid: dict[str, list[float]], direction: str, start=None, end=None,
                buy_sell_equal: bool = False, top: int = 10, price: str = "close") -> DataFrame:
    frame = time_or_offset(frame, start, end)
    return sweep(frame, scores, price, grid, direction, buy_sell_equal, top)
