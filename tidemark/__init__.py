"""tidemark: features, labels, scores and signals on long time series, as Spark jobs."""

from tidemark.frame import SeriesFrame, Span, Step
from tidemark.operators.raster import on_raster

__all__ = ["SeriesFrame", "Span", "Step", "on_raster"]
