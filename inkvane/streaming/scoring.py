"""Scoring of text streams: our extension. All text features are row-local, so they run on a stream unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features
from ..operators.detector import Detector
from ..sources.schema import DDL


def read(spark: SparkSession, folder: str) -> DataFrame:
    """JSON-lines records as they arrive in a folder."""
    return spark.readStream.schema(DDL).json(folder)


def score(stream: DataFrame, model: Detector, common: list[str] | None = None) -> DataFrame:
    """The stream with p_ai; stateless. Models with perplexity features need a scorer's state and are refused."""
    if any(f in features.PERPLEXITY for f in model.features):
        raise ValueError("a stream has no corpus-wide scorer")
    return model.predict(features.statistical(stream, "text", common)).drop(*features.STATISTICAL)


def rates(scored: DataFrame, at: str, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, n, mean_p_ai) of tumbling windows, rows later than the watermark left out."""
    return scored.withWatermark(at, late).groupBy(F.window(at, window)).agg(F.count("*").alias("n"), F.avg("p_ai").alias("mean_p_ai"))
