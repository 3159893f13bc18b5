"""Binary classification metrics over a column of labels (0/1) and one of probabilities, per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import running

#: The bin edges as binary fractions have them, so that 0.3 falls below the edge 0.30000000000000004.
EDGES = [i * 0.1 if i not in (3, 6, 7) else {3: 0.30000000000000004, 6: 0.6000000000000001, 7: 0.7000000000000001}[i] for i in range(11)]


def over(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0."""
    return F.when(d == 0, 0.0).otherwise(n / F.when(d != 0, d))


def auroc(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """Exact area under the ROC curve per group; null with one class only.

    Equal probabilities are first counted together; a pair of equal
    probabilities counts one half. The running sum goes over ranges of group
    and probability, so that no task orders a whole group, however its scores
    pile up.
    """
    by = by or []
    c = df.groupBy(*by, p).agg(F.sum(y).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))
    c = running(c, [*by, p], "neg", "below")
    # a group begins at the least running sum of its rows
    s = c.groupBy(*by).agg(F.sum(F.col("pos") * F.col("below") + F.col("pos") * F.col("neg") / 2).alias("u"), F.min("below").alias("start"), F.sum("pos").alias("np"), F.sum("neg").alias("nn"))
    both = (F.col("np") > 0) & (F.col("nn") > 0)
    return s.select(*by, F.when(both, (F.col("u") - F.col("np") * F.col("start")) / F.when(both, F.col("np") * F.col("nn"))).alias("auroc"))


def confusion(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """n, tp, fp, tn, fn, accuracy, precision, recall, f1, brier per group; ratios with nothing below are 0."""
    yes, hit = F.col(p) >= threshold, F.col(y) == 1
    n = lambda c: F.sum(c.cast("long"))
    s = df.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.coalesce(n(yes & hit), F.lit(0)).alias("tp"), F.coalesce(n(yes & ~hit), F.lit(0)).alias("fp"), F.coalesce(n(~yes & ~hit), F.lit(0)).alias("tn"), F.coalesce(n(~yes & hit), F.lit(0)).alias("fn"), F.avg((F.col(p) - F.col(y)) * (F.col(p) - F.col(y))).alias("brier"))
    s = s.withColumn("accuracy", over(F.col("tp") + F.col("tn"), F.col("n"))).withColumn("precision", over(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", over(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.withColumn("f1", over(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("threshold", F.lit(float(threshold)))


def classification(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """confusion() with auroc."""
    a = auroc(df, y, p, by)
    return confusion(df, y, p, by, threshold).join(a, by, "left") if by else confusion(df, y, p, by, threshold).join(F.broadcast(a), F.lit(True))  # one row


def calibration(df: DataFrame, y: str = "y", p: str = "p", by: list[str] | None = None) -> DataFrame:
    """(bin, mean_predicted, frac_positive, count) of ten equal bins, the last closed; empty bins give no row."""
    b = F.lit(0)
    for i in range(1, 10):
        b = F.when(F.col(p) >= EDGES[i], i).otherwise(b)
    return df.groupBy(*(by or []), b.cast("int").alias("bin")).agg(F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("frac_positive"), F.count("*").alias("count"))


def bad_inputs(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """(reason, n): rows that metrics don't accept."""
    r = F.when(F.col(y).isNull() | F.col(p).isNull(), "missing").when(~F.col(y).isin(0, 1), "label").when((F.col(p) < 0) | (F.col(p) > 1) | F.isnan(p), "probability")
    return df.withColumn("reason", r).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def correlation(df: DataFrame, a: str, b: str, by: list[str] | None = None) -> DataFrame:
    """(n, r): Pearson correlation of two columns; 0 if a side is constant."""
    c = lambda x, y: F.avg(F.col(x) * F.col(y)) - F.avg(x) * F.avg(y)
    s = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.covar_pop(a, b).alias("ab"), F.var_pop(a).alias("va"), F.var_pop(b).alias("vb"))
    ok = (F.col("va") > 0) & (F.col("vb") > 0)
    return s.select(*(by or []), "n", F.when(ok, F.col("ab") / F.sqrt(F.when(ok, F.col("va") * F.col("vb")))).otherwise(0.0).alias("r"))
