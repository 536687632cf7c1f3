"""Quality of scores against labels, as exact aggregates.

Ranking metrics need the scores in order.  Equal scores are first combined to one row with
two counts; the cumulated counts then come from the bucketed running sums, so no group of
scores is ever sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.frame import number_rows, join_on
from tidemark.functions.numeric import ratio
from tidemark.operators.scores import label_and_algorithm

DIGITS = 3


def unpivot_scores(df: DataFrame, keys: list[str], score_columns: list[str]) -> DataFrame:
    """Long form of ``label_algorithm`` columns with their labels; incomplete pairs drop out."""
    pairs = []
    for c in score_columns:
        label, _ = c.rsplit("_", 1)
        pairs.append(F.struct(F.lit(c).alias("score_column"), F.col(label).cast("double").alias("y_true"),
                              F.col(c).cast("double").alias("y_hat")))
    out = df.select(*keys, F.explode(F.array(*pairs)).alias("p")).select(*keys, "p.*")
    label, algo = label_and_algorithm(F.col("score_column"))
    out = out.where(F.col("y_true").isNotNull() & F.col("y_hat").isNotNull())
    return out.select(*keys, label.alias("label"), algo.alias("algo"), "y_true", "y_hat")


def ranking_metrics(df: DataFrame, keys: list[str], positive: Column, score: Column) -> DataFrame:
    """Exact ROC-AUC (ties count half) and average precision; 0 with only one class."""
    tied = df.select(*keys, positive.alias("p"), score.alias("score")).groupBy(*keys, "score").agg(
        F.count_if("p").alias("pos_n"), F.count_if(~F.col("p")).alias("neg_n"))
    tied = tied.withColumn("order", -F.col("score"))
    frame = number_rows(tied, keys, ["order"])
    ranked = frame.running({"cum_pos": F.col("pos_n"), "cum_neg": F.col("neg_n")}).df
    above = F.col("cum_pos") - F.col("pos_n")
    sums = ranked.groupBy(*keys).agg(
        F.sum("pos_n").alias("P"), F.sum("neg_n").alias("N"),
        F.sum(F.col("neg_n") * (above + F.col("pos_n") / 2)).alias("area"),
        F.sum(F.col("pos_n") * ratio(F.col("cum_pos").cast("double"), F.col("cum_pos") + F.col("cum_neg"))).alias("steps"))
    one_class = (F.col("P") == 0) | (F.col("N") == 0)
    return sums.select(
        *keys,
        F.when(one_class, 0.0).otherwise(ratio(F.col("area"), F.col("P").cast("double") * F.col("N"))).alias("auc"),
        F.when(one_class, 0.0).otherwise(ratio(F.col("steps"), F.col("P").cast("double"))).alias("ap"))


def _confusion(actual: Column, predicted: Column) -> dict[str, Column]:
    tp = F.count_if(actual & predicted).cast("double")
    fp, fn = F.count_if(~actual & predicted), F.count_if(actual & ~predicted)
    zero = F.lit(0.0)
    return {
        "f1": F.coalesce(ratio(tp * 2, tp * 2 + fp + fn), zero),
        "precision": F.coalesce(ratio(tp, tp + fp), zero),
        "recall": F.coalesce(ratio(tp, tp + fn), zero),
    }


def _rounded(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *[F.round(c, DIGITS).alias(c) for c in df.columns if c not in keys])


def classification_metrics(df: DataFrame, keys: list[str], y_true: str = "y_true", y_hat: str = "y_hat") -> DataFrame:
    """AUC, average precision, and F1, precision and recall at 0.5; a NULL score is 0 in all of them."""
    actual, score = F.col(y_true) > 0, F.coalesce(F.col(y_hat).cast("double"), F.lit(0.0))
    counts = df.groupBy(*keys).agg(*[c.alias(n) for n, c in _confusion(actual, score > 0.5).items()])
    return _rounded(join_on(ranking_metrics(df, keys, actual, score), counts, keys), keys)


def regression_metrics(df: DataFrame, keys: list[str], y_true: str = "y_true", y_hat: str = "y_hat") -> DataFrame:
    """MAE, MAPE and R2, and how well the sign is predicted.

    The sign metrics have a two-valued score, so AUC and average precision are closed forms
    of the confusion counts.
    """
    y, p = F.col(y_true).cast("double"), F.col(y_hat).cast("double")
    up, said = y > 0, p > 0
    # Fixed value: smallest denominator of a percentage error, the double epsilon.
    floor = F.lit(2.220446049250313e-16)
    sums = df.groupBy(*keys).agg(
        F.avg(F.abs(y - p)).alias("mae"), F.avg(F.abs(y - p) / F.greatest(F.abs(y), floor)).alias("mape"),
        F.sum((y - p) * (y - p)).alias("rest"), (F.var_pop(y) * F.count(y)).alias("spread"),
        F.count_if(up).cast("double").alias("P"), F.count_if(~up).cast("double").alias("N"),
        F.count_if(up & said).cast("double").alias("tp"), F.count_if(~up & said).cast("double").alias("fp"),
        *[c.alias(n) for n, c in _confusion(up, said).items()])
    one_class = (F.col("P") == 0) | (F.col("N") == 0)
    tp, fp, pos, neg = F.col("tp"), F.col("fp"), F.col("P"), F.col("N")
    auc = (ratio(tp, pos) + 1 - ratio(fp, neg)) / 2
    share = ratio(tp, pos)
    ap = F.coalesce(share * ratio(tp, tp + fp), F.lit(0.0)) + (1 - share) * ratio(pos, pos + neg)
    out = sums.select(
        *keys, "mae", "mape", (1 - ratio(F.col("rest"), F.col("spread"))).alias("r2"),
        F.when(one_class, 0.0).otherwise(auc).alias("auc"), F.when(one_class, 0.0).otherwise(ap).alias("ap"),
        "f1", "precision", "recall")
    return _rounded(out, keys)


def score_columns_metrics(df: DataFrame, score_columns: list[str], regression: bool = False) -> DataFrame:
    """Metrics of every ``label_algorithm`` column against its label."""
    long = unpivot_scores(df, [], score_columns)
    return (regression_metrics if regression else classification_metrics)(long, ["label", "algo"])
