"""Evaluation: sentence truth, document and sentence metrics, mixed labels, families, slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import metrics
from .ranges import running


def truth(label: Column, spans: Column, start: Column, end: Column) -> Column:
    """1 for an ai sentence: by the label of a pure text, by whether the midpoint lies in an ai span of a mixed one; null for other labels."""
    mid = (start + end) / 2.0
    inside = F.exists(F.coalesce(spans, F.array().cast("array<struct<start:int,end:int,label:string>>")), lambda s: (s["label"] == "ai") & (s["start"] <= mid) & (mid < s["end"]))
    return F.when(label == "human", 0).when(label == "ai", 1).when(label == "mixed", F.coalesce(inside, F.lit(False)).cast("int"))


def document_metrics(scored: DataFrame, label: str = "label", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Metrics of the pure texts; y is 1 for ai."""
    pure = scored.where(F.col(label).isin("human", "ai") & F.col(p).isNotNull()).withColumn("y", (F.col(label) == "ai").cast("int"))
    return metrics.classification(pure, "y", p, by)


def localization_metrics(sentences: DataFrame, p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Metrics of sentences (label, spans, start, end, p) of mixed texts."""
    m = sentences.where((F.col("label") == "mixed") & F.col(p).isNotNull()).withColumn("y", truth(F.col("label"), F.col("spans"), F.col("start"), F.col("end")))
    return metrics.classification(m, "y", p, by)


def mixed_rate(decided: DataFrame, truth_label: str, got: str) -> DataFrame:
    """(n, frac_labelled_mixed) of the mixed texts; no rows counted gives 0."""
    m = decided.where(F.col(truth_label) == "mixed")
    return m.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col(got) == "mixed").cast("double")), F.lit(0.0)).alias("frac_labelled_mixed"))


def by_family(scored: DataFrame, label: str = "label", family: str = "model_family", p: str = "p", threshold: float = 0.5) -> DataFrame:
    """n, n_ai, accuracy, f1, brier and auroc of each family's ai texts against all human texts.

    Human texts are neither copied nor joined per family: one running count of
    them over all probabilities tells how many lie below each ai text, and
    their other sums are one row.
    """
    pure = scored.where(F.col(label).isin("human", "ai") & F.col(p).isNotNull())
    ai, human, yes = (F.col(label) == "ai") & F.col(family).isNotNull(), F.col(label) == "human", F.col(p) >= threshold
    k = lambda c: F.sum(c.cast("long"))
    counts = pure.groupBy(family, p).agg(k(ai).alias("pos"), k(human).alias("neg"))
    # first the human texts of each probability, in one row
    flat = counts.select(F.when(F.col("pos") > 0, F.col(family)).alias(family), p, "pos", "neg")
    at = flat.groupBy(p).agg(F.sum("neg").alias("neg"), F.collect_list(F.when(F.col("pos") > 0, F.struct(F.col(family), "pos"))).alias("fams"))  # an entry per family
    at = running(at, [p], "neg", "below")
    each = at.select(p, "neg", "below", F.explode("fams").alias("f")).select(p, "neg", "below", F.col(f"f.{family}").alias(family), F.col("f.pos").alias("k"))
    hit = F.col(p) >= threshold
    per = each.groupBy(family).agg(F.sum("k").alias("n_ai"), F.sum(F.when(hit, F.col("k")).otherwise(0)).alias("tp"), F.sum(F.col("k") * (F.col(p) - 1) * (F.col(p) - 1)).alias("sa"), F.sum(F.col("k") * (F.col("below") + F.col("neg") / 2)).alias("u"))
    h = pure.where(human).agg(F.count("*").alias("nh"), F.coalesce(k(yes), F.lit(0)).alias("fp"), F.coalesce(F.sum(F.col(p) * F.col(p)), F.lit(0.0)).alias("sh"))
    x = per.join(F.broadcast(h), F.lit(True)).withColumn("n", F.col("n_ai") + F.col("nh"))  # one row
    wrong, double = F.col("n_ai") - F.col("tp") + F.col("fp"), 2 * F.col("tp")
    return x.select(family, "n", "n_ai", ((F.col("n") - wrong) / F.col("n")).alias("accuracy"), metrics.over(double, double + wrong).alias("f1"), ((F.col("sa") + F.col("sh")) / F.col("n")).alias("brier"), F.when(F.col("nh") > 0, F.col("u") / F.when(F.col("nh") > 0, F.col("n_ai") * F.col("nh"))).alias("auroc"))


def robustness(scored: DataFrame, sentences: DataFrame, decided: DataFrame, ood: DataFrame | None = None, ood_paraphrased: DataFrame | None = None) -> DataFrame:
    """(slice, n, n_ai, accuracy, f1, brier, auroc, frac_labelled_mixed): one system's whole report, a row per slice.

    Slices: seen_overall, family:<name> for each family's texts against all
    human ones, localization and mixed_doc_labels of mixed texts, ood and
    ood_paraphrased where given. scored and the two ood tables are (label,
    model_family, p) rows; decided is (truth, label).
    """
    names = ("n", "n_ai", "accuracy", "f1", "brier", "auroc")

    def rows(df, slice_name):
        have = [F.col(c).cast("double" if c not in ("n", "n_ai") else "long").alias(c) if c in df.columns else F.lit(None).cast("double" if c not in ("n", "n_ai") else "long").alias(c) for c in (*names, "frac_labelled_mixed")]
        return df.select(slice_name.alias("slice"), *have)

    def ai(df):
        return df.withColumn("n_ai", F.col("tp") + F.col("fn"))

    out = rows(ai(document_metrics(scored)), F.lit("seen_overall")).unionByName(rows(by_family(scored), F.concat(F.lit("family:"), "model_family")))
    out = out.unionByName(rows(ai(localization_metrics(sentences)), F.lit("localization"))).unionByName(rows(mixed_rate(decided, "truth", "label"), F.lit("mixed_doc_labels")))
    for name, df in (("ood", ood), ("ood_paraphrased", ood_paraphrased)):
        if df is not None:
            out = out.unionByName(rows(ai(document_metrics(df)), F.lit(name)))
    return out


def slices(scored: DataFrame, sentences: DataFrame, decided: DataFrame) -> dict[str, DataFrame]:
    """The four slices of one system: seen (without paraphrases, all if there are no others), paraphrase, localization, mixed."""
    plain = scored.where(~F.col("is_paraphrase"))
    seen = plain if plain.where(F.col("label").isin("human", "ai")).limit(1).count() else scored
    return {"seen": document_metrics(seen), "paraphrase": document_metrics(scored.where("is_paraphrase")), "localization": localization_metrics(sentences), "mixed": mixed_rate(decided, "truth", "label")}
