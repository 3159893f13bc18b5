"""A stand-in for a neural sentence classifier: hashed words and word pairs with logistic regression.

It fills the same place (a probability per sentence, decided per text by the
rule) where no neural backend is installed, and is named as what it is. A real
backend is any function DataFrame(key, sid, sentence) -> with p_ai.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(sentences: DataFrame, y: str = "y", text: str = "sentence", size: int = 1 << 14, reg: float = 1e-3) -> PipelineModel:
    """Fits on sentences with a 0/1 label; rows with a null label or text are left out. The model's size is fixed by `size`."""
    rows = sentences.where(F.col(y).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("_t"), F.col(y).cast("double").alias("_y"))
    if rows.select("_y").distinct().count() < 2:
        raise ValueError("both classes are needed")
    stages = [
        RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"[A-Za-z]+|\d+|[^\sA-Za-z\d]", gaps=False), NGram(n=2, inputCol="_w", outputCol="_p"),
        HashingTF(numFeatures=size, inputCol="_w", outputCol="_v1"), HashingTF(numFeatures=size, inputCol="_p", outputCol="_v2"), VectorAssembler(inputCols=["_v1", "_v2"], outputCol="_v"),
        LogisticRegression(featuresCol="_v", labelCol="_y", probabilityCol="_q", rawPredictionCol="_raw", predictionCol="_hat", regParam=reg, maxIter=50)]
    return Pipeline(stages=stages).fit(rows)


def predict(model: PipelineModel, sentences: DataFrame, text: str = "sentence", out: str = "p_ai") -> DataFrame:
    """sentences with the probability of ai."""
    scored = model.transform(sentences.withColumn("_t", F.coalesce(F.col(text), F.lit(""))))
    return scored.select(*[c for c in sentences.columns if c != out], vector_to_array("_q")[1].alias(out))
