"""Trainable columns: Spark ML models per label and algorithm, walk-forward scoring."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.frame import SeriesFrame, join_on, number_rows, settle
from tidemark.functions.numeric import clean

VECTOR, SCALED, TARGET, WEIGHT = "features_vector", "features_scaled", "target", "row_weight"


@dataclass(frozen=True)
class Algorithm:
    """``algo`` is lc (logistic), gb (boosted trees), svc (linear support vector) or nn (dense net)."""

    name: str
    algo: str
    params: dict
    train: dict

    @staticmethod
    def of(spec: dict) -> Algorithm:
        return Algorithm(spec["name"], spec["algo"], spec.get("params", {}), spec.get("train", {}))


def _estimator(a: Algorithm, n_features: int, features: str, n_rows: int | None):
    t = a.train
    if a.params.get("is_regression") and a.algo != "gb":
        raise ValueError(f"{a.algo} only classifies; is_regression needs gb")
    if a.algo == "lc":
        extra = {"weightCol": WEIGHT} if t.get("class_weight") == "balanced" else {}
        # C weighs the sum of losses, regParam the mean of losses
        reg = 1.0 / (t["C"] * max(1, n_rows)) if t.get("C") else t.get("reg", 0.0)
        return LogisticRegression(featuresCol=features, labelCol=TARGET, maxIter=t.get("max_iter", 100), regParam=reg,
                                  elasticNetParam=1.0 if t.get("penalty") == "l1" else 0.0, standardization=False, **extra)
    if a.algo == "gb":
        common = dict(featuresCol=features, labelCol=TARGET, maxDepth=t.get("max_depth", 5),
                      maxIter=t.get("num_boost_round", 20), stepSize=t.get("learning_rate", 0.1), seed=t.get("seed", 0))
        return GBTRegressor(**common) if _is_regression(a) else GBTClassifier(**common)
    if a.algo == "svc":
        return LinearSVC(featuresCol=features, labelCol=TARGET, maxIter=t.get("max_iter", 100), regParam=t.get("reg", 0.01),
                         standardization=False)
    if a.algo == "nn":
        layers = [n_features, *a.params.get("layers", [max(2, n_features // 4)]), 2]
        return MultilayerPerceptronClassifier(featuresCol=features, labelCol=TARGET, layers=layers,
                                              maxIter=t.get("n_epochs", 100), blockSize=t.get("bs", 128),
                                              stepSize=t.get("learning_rate", 0.03), seed=t.get("seed", 0))
    raise ValueError(f"unknown algorithm type {a.algo!r}")


def _is_regression(a: Algorithm) -> bool:
    return bool(a.params.get("is_regression")) or str(a.train.get("objective", "")).startswith("regress")


def _complete(columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in columns])


def training_rows(df: DataFrame, features: list[str], label: str, keys: list[str], order: list[str],
                  every_nth: int | None = None, length: int | None = None) -> DataFrame:
    """Rows complete in features and label; then every n-th, then the last ``length`` per series."""
    rows = clean(df, [*features, label]).dropna(subset=[*features, label])
    if not every_nth and not length:
        return rows
    frame = number_rows(rows.drop("pos"), keys, order)
    if every_nth and every_nth > 1:
        thinned = frame.every_nth(every_nth)
        frame = SeriesFrame(thinned.withColumn("pos", F.call_function("div", F.col("pos"), F.lit(every_nth).cast("long"))),
                            frame.keys, frame.ts, frame.pos, None, frame.bucket_rows)
    if length:
        frame = frame.tail(length)
    return frame.df.drop("pos")


def fit(df: DataFrame, features: list[str], label: str, algorithm: Algorithm) -> PipelineModel:
    """Fit one model on complete rows.  Features are standardised unless the params say otherwise."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in features], F.col(label).cast("double").alias(TARGET))
    if algorithm.train.get("class_weight") == "balanced":
        share = rows.agg(F.avg(TARGET)).first()[0]
        positive = 0.5 / share if share else 1.0
        negative = 0.5 / (1 - share) if share != 1 else 1.0
        rows = rows.withColumn(WEIGHT, F.when(F.col(TARGET) > 0, positive).otherwise(negative))
    scale = algorithm.params.get("is_scale", algorithm.algo != "gb")
    stages = [VectorAssembler(inputCols=features, outputCol=VECTOR, handleInvalid="keep")]
    used = VECTOR
    if scale:
        stages.append(StandardScaler(inputCol=VECTOR, outputCol=SCALED, withMean=True, withStd=True))
        used = SCALED
    n_rows = rows.count() if algorithm.train.get("C") else None
    stages.append(_estimator(algorithm, len(features), used, n_rows))
    return Pipeline(stages=stages).fit(rows)


def score(df: DataFrame, model: PipelineModel, features: list[str], algorithm: Algorithm, name: str) -> DataFrame:
    """Attach one score column.  Rows with a NULL feature are kept and get a NULL score."""
    ready = df.withColumns({f"model__{c}": F.col(c) for c in features})
    ready = ready.withColumns({c: F.col(c).cast("double") for c in features})
    out = model.transform(ready)
    if "probability" in out.columns:
        value = vector_to_array("probability")[1]
    elif algorithm.algo == "svc":
        value = 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1]))
    else:
        value = F.col("prediction")
    out = out.withColumn(name, F.when(_complete(features), value))
    out = out.withColumns({c: F.col(f"model__{c}") for c in features})
    return out.select(*[c for c in df.columns if c != name], name)


def train_all(df: DataFrame, features: list[str], labels: list[str], algorithms: list[dict], keys: list[str],
              order: list[str]) -> dict[str, PipelineModel]:
    """One model per label and algorithm, by the name of its score column.

    Rows with a NULL in any label are left out for all, so every model sees the same rows.
    """
    models, df = {}, settle(clean(df, labels).dropna(subset=labels))
    for label in labels:
        for spec in algorithms:
            a = Algorithm.of(spec)
            rows = training_rows(df, features, label, keys, order, a.params.get("every_nth_row"), a.params.get("length"))
            models[f"{label}_{a.name}"] = fit(rows, features, label, a)
    return models


def predict_all(df: DataFrame, features: list[str], labels: list[str], algorithms: list[dict],
                models: dict[str, PipelineModel]) -> tuple[DataFrame, list[str]]:
    """Attach all score columns to the rows; nothing is joined."""
    df, names = clean(df, features), []
    for label in labels:
        for spec in algorithms:
            a = Algorithm.of(spec)
            name = f"{label}_{a.name}"
            df = score(df, models[name], features, a, name)
            names.append(name)
    return df, names


def save_models(models: dict[str, PipelineModel], path: str) -> None:
    for name, model in models.items():
        model.write().overwrite().save(os.path.join(path, name))


def load_models(path: str, names: list[str]) -> dict[str, PipelineModel]:
    return {n: PipelineModel.load(os.path.join(path, n)) for n in names}


# -- walk-forward ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Fold:
    step: int
    train_start: int
    train_end: int
    predict_start: int
    predict_end: int


def resolve_folds(length: int, label_horizon: int, start: int | None = None, size: int | None = None,
                  steps: int | None = None, train_length: int | None = None) -> list[Fold]:
    """Row ranges of all folds; any two of start, size and steps give the third.

    The folds follow each other from ``start`` and must end within ``length`` rows: the missing
    number is the one that fills the rows best.  The rows whose labels would look into the predicted
    range are left out of training.
    """
    match (start, size, steps):
        case (None, int(), int()):
            start = length - size * steps
        case (int(), None, int()):
            size = (length - start) // steps
        case (int(), int(), None):
            steps = (length - start) // size
        case (int(), int(), int()):
            pass
        case _:
            raise ValueError("only one of start, size and steps can be left out")
    if start < 0 or size < 1 or start + size * steps > length:
        raise ValueError(f"not enough data for {steps} steps of {size} rows from {start}: {length} rows")

    def fold(step: int) -> Fold:
        predicted = start + step * size
        known = max(0, predicted - label_horizon - 1)
        return Fold(step, max(0, known - train_length) if train_length else 0, known, predicted, predicted + size)

    return [fold(k) for k in range(steps)]


@dataclass(frozen=True)
class SeriesFolds:
    """Folds over each series' own length.

    A series is cut into steps + 1 parts whose lengths differ by one row at most; step k predicts part
    k + 1 and trains on the rows before it whose labels do not look into it, ``train_length`` of them
    if given.  Every row after a series' first part is predicted once, however short the series is.
    """

    steps: int
    label_horizon: int
    train_length: int | None = None

    def ranges(self, step: int) -> list[Column]:
        """Start and end of training and of prediction, from the rows of a series (``n_rows``)."""
        cut = lambda part: F.expr(f"n_rows * {part} div {self.steps + 1}")
        known = F.greatest(F.lit(0), cut(step + 1) - self.label_horizon - 1)
        first = F.greatest(F.lit(0), known - self.train_length) if self.train_length else F.lit(0)
        return [first, known, cut(step + 1), cut(step + 2)]


def longest(frame: SeriesFrame) -> int:
    """Rows of the longest series, the length over which folds are laid."""
    return frame.bounds().agg(F.max(F.col("last_pos") - F.col("first_pos") + 1)).first()[0] or 0


def fold_rows(frame: SeriesFrame, folds: list[Fold] | SeriesFolds) -> DataFrame:
    """Rows with the folds and roles they take part in: a row appears once for each."""
    rows = frame.attach(frame.bounds()).withColumns({"row_no": F.col(frame.pos) - F.col("first_pos"), "n_rows": F.col("last_pos") - F.col("first_pos") + 1})
    if isinstance(folds, SeriesFolds):
        ranges = [(k, *folds.ranges(k)) for k in range(folds.steps)]
    else:
        ranges = [(f.step, *[F.lit(x) for x in (f.train_start, f.train_end, f.predict_start, f.predict_end)]) for f in folds]

    def part(step: int, role: str, first: Column, end: Column) -> Column:
        inside = (F.col("row_no") >= first) & (F.col("row_no") < end)
        return F.when(inside, F.struct(F.lit(step).cast("long").alias("step"), F.lit(role).alias("role")))

    parts = [p for step, a, b, c, d in ranges for p in (part(step, "train", a, b), part(step, "predict", c, d))]
    rows = rows.withColumn("__part", F.explode(F.array_compact(F.array(*parts))))
    return rows.withColumns({"step": F.col("__part.step"), "role": F.col("__part.role")}).drop("__part", "first_pos", "last_pos", "n_rows")


def walk_forward(frame: SeriesFrame, features: list[str], labels: list[str], algorithms: list[dict], folds: list[Fold] | SeriesFolds,
                 parallel: int = 2) -> tuple[DataFrame, list[str]]:
    """Train on the past and score the next rows, fold by fold; returns the scored rows.

    The rows are written once; the folds are independent Spark jobs started side by side.
    """
    keys, order = list(frame.keys), [frame.ts]
    rows = frame.attach(frame.bounds()).withColumns({"row_no": F.col(frame.pos) - F.col("first_pos"), "n_rows": F.col("last_pos") - F.col("first_pos") + 1})
    rows = settle(rows.drop("first_pos", "last_pos"))
    if isinstance(folds, SeriesFolds):
        ranges = [(k, *folds.ranges(k)) for k in range(folds.steps)]
    else:
        ranges = [(f.step, f.train_start, f.train_end, f.predict_start, f.predict_end) for f in folds]
    names = [f"{label}_{a['name']}" for label in labels for a in algorithms]

    def run(fold: tuple) -> DataFrame:
        step, train_start, train_end, predict_start, predict_end = fold
        train = rows.where((F.col("row_no") >= train_start) & (F.col("row_no") < train_end)).drop("n_rows")
        models = train_all(train, features, labels, algorithms, keys, order)
        ahead = rows.where((F.col("row_no") >= predict_start) & (F.col("row_no") < predict_end)).drop("n_rows")
        return predict_all(ahead, features, labels, algorithms, models)[0].withColumn("step", F.lit(step))

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        parts = list(pool.map(run, ranges))
    return reduce(DataFrame.unionByName, parts), names


# -- fitted statistics -----------------------------------------------------------------------


def fit_statistic(df: DataFrame, column: str, path: str, keys: list[str] | None = None) -> None:
    """Store the mean of a column (per series) as a small table."""
    df.groupBy(*(keys or [])).agg(F.avg(column).alias("fitted")).write.mode("overwrite").parquet(path)


def deviation_from_fitted(df: DataFrame, column: str, path: str, name: str, keys: list[str] | None = None) -> DataFrame:
    """Difference of a column to its stored mean."""
    stored = df.sparkSession.read.parquet(path)
    joined = join_on(df, stored, keys, "left") if keys else df.crossJoin(F.broadcast(stored))
    return joined.withColumn(name, F.col(column) - F.col("fitted")).drop("fitted")


def embedding_features(df: DataFrame, column: str, size: int, prefix: str = "e") -> tuple[DataFrame, list[str]]:
    """Elements of an array column as feature columns."""
    names = [f"{prefix}{i}" for i in range(size)]
    return df.withColumns({n: F.col(column)[i].cast(T.DoubleType()) for i, n in enumerate(names)}), names
