"""The decision rule: human, ai or mixed from sentence probabilities and, if there is one, a document probability."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    doc_ai: float = 0.55
    low: float = 0.45
    high: float = 0.85
    min_dispersion: float = 0.10
    sentence_ai: float = 0.5

    def __post_init__(self):
        if not 0 <= self.low < self.high <= 1 or not 0 <= self.doc_ai <= 1 or not 0 <= self.sentence_ai <= 1 or self.min_dispersion < 0:
            raise ValueError("thresholds out of range")


def decide_columns(doc_p: Column, mean_p: Column, dispersion: Column, rule: Rule = Rule()) -> dict[str, Column]:
    """label, p_human, p_ai, p_mixed, confidence. The label is not always that of the greatest score: from 0.5 up to doc_ai an unmixed text is human though p_ai is greater."""
    e = F.coalesce(doc_p, mean_p)
    mixed = (e >= rule.low) & (e <= rule.high) & (dispersion >= rule.min_dispersion)
    h = (rule.high - rule.low) / 4
    depth = F.least((e - rule.low) / h, (rule.high - e) / h, F.lit(1.0))
    p_mixed = F.when(mixed, 0.5 + 0.4 * depth).otherwise(0.0)
    p_ai, p_human = (1 - p_mixed) * e, (1 - p_mixed) * (1 - e)
    return {"label": F.when(mixed, "mixed").when(e >= rule.doc_ai, "ai").otherwise("human"), "p_human": p_human, "p_ai": p_ai, "p_mixed": p_mixed, "confidence": F.greatest(p_human, p_ai, p_mixed)}


def aggregate(scores: DataFrame, key: str, p: str = "p_ai", doc_p: DataFrame | None = None, rule: Rule = Rule()) -> DataFrame:
    """One row per text: n_sentences, mean_p_ai, frac_ai_sentences, dispersion and the decision.

    scores: (key, p) per sentence; null probabilities are left out and a text
    with none gives no row. doc_p: (key, doc_p), optional.
    """
    s = scores.where(F.col(p).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_sentences"), F.avg(p).alias("mean_p_ai"), F.avg((F.col(p) >= rule.sentence_ai).cast("double")).alias("frac_ai_sentences"), F.stddev_pop(p).alias("dispersion"))
    s = s.join(doc_p.select(key, "doc_p"), key, "left") if doc_p is not None else s.withColumn("doc_p", F.lit(None).cast("double"))
    return s.select("*", *[c.alias(k) for k, c in decide_columns(F.col("doc_p"), F.col("mean_p_ai"), F.col("dispersion"), rule).items()])
