"""The flagship query: ticks to signals in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numeric import null_safe_false, ratio
from tidemark.operators.indicators import indicators
from tidemark.plans import inputs


def moving_average_signals(spark: SparkSession, sf_dir: str, window: int = 5, band: float = 0.5) -> DataFrame:
    """Buy where the close is far above its moving average, sell where it is far below."""
    frame, _ = indicators(inputs.filled(spark, sf_dir), "close", "SMA", window, names=["average"], fill_gaps=False)
    distance = ratio(F.col("close") - F.col("average"), F.col("average"))
    df = frame.df.withColumns({
        "distance": distance, "buy": null_safe_false(distance >= band), "sell": null_safe_false(distance <= -band)})
    return df.where("buy OR sell").select("series", "ts", "close", "average", "distance", "buy", "sell")
