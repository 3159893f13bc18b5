"""The classical detector: scaling, logistic regression, out-of-fold Platt calibration, class distributions.

Fitting aggregates on the executors; scoring is an expression of literals and
needs neither Python nor MLlib.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from .ranges import ranked

KIND, VERSION = "inkvane-baseline", 1
QUANTILES = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
MARGIN = 0.25


@dataclass
class Config:
    c: float = 1.0
    max_iter: int = 2000
    seed: int = 0
    calibrate: bool = True
    folds: int = 3


@dataclass
class Detector:
    features: list[str]
    center: list[float]
    scale: list[float]
    coef: list[float]
    intercept: float
    calibration: tuple[float, float] | None = None
    scorer: str | None = None
    meta: dict = field(default_factory=dict)
    distributions: dict = field(default_factory=dict)

    def score(self) -> Column:
        """The decision score as an expression over the feature columns."""
        out = F.lit(float(self.intercept))
        for name, m, s, w in zip(self.features, self.center, self.scale, self.coef):
            out = out + (F.col(name) - m) / (s or 1.0) * w
        return out

    def probability(self) -> Column:
        a, b = self.calibration or (1.0, 0.0)
        return sigmoid(F.lit(a) * self.score() + b)

    def predict(self, df: DataFrame, out: str = "p_ai") -> DataFrame:
        missing = [f for f in self.features if f not in df.columns]
        if missing:
            raise ValueError(f"missing features: {missing}")
        return df.withColumn(out, self.probability())

    def importances(self, k: int | None = None) -> list[tuple[str, float]]:
        """Features by absolute coefficient, the first in order on ties."""
        order = sorted(range(len(self.coef)), key=lambda i: (-abs(self.coef[i]), i))
        return [(self.features[i], self.coef[i]) for i in order[:k]]

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump({"kind": KIND, "format_version": VERSION, "feature_names": self.features, "scaler": {"mean": self.center, "scale": self.scale}, "coef": self.coef, "intercept": self.intercept, "calibration": self.calibration, "scorer_name": self.scorer, "training_meta": self.meta, "feature_distributions": self.distributions}, f, indent=1)

    @classmethod
    def load(cls, path: str) -> "Detector":
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        if d.get("kind") != KIND or d.get("format_version") != VERSION:
            raise ValueError("not a detector of this format")
        cal = d["calibration"]
        return cls(d["feature_names"], d["scaler"]["mean"], d["scaler"]["scale"], d["coef"], d["intercept"], tuple(cal) if cal else None, d["scorer_name"], d["training_meta"], d["feature_distributions"])


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)), without overflow on either side."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def scaler(df: DataFrame, features: list[str]) -> tuple[list[float], list[float]]:
    """Means and population deviations, 1 for a deviation of 0; one aggregation."""
    row = df.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    k = len(features)
    return [row[i] or 0.0 for i in range(k)], [row[k + i] or 1.0 for i in range(k)]


def distributions(df: DataFrame, features: list[str], label: str = "label") -> DataFrame:
    """(label, feature, mean, std, p05, p25, p50, p75, p95) per class, exact quantiles with linear steps between values.

    Values are put in order by range partitions of class, feature and value;
    only the rows at the ranks that a quantile lies between are picked.
    """
    long = df.select(F.col(label).alias("_c"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("v")).select("_c", "v.feature", "v.x").where("x is not null")
    rows = cut(ranked(long, ["_c", "feature", "x"], "rank"))
    per = rows.groupBy("_c", "feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("rank").alias("start"), F.count("*").alias("n"))
    spot = lambda q: (F.col("n") - 1) * F.lit(q)
    picks = per.select("_c", "feature", "start", F.explode(F.array(*[F.struct(F.lit(k).alias("q"), spot(q).alias("at")) for k, q in QUANTILES.items()])).alias("s")).select("_c", "feature", "start", "s.q", "s.at")
    picks = picks.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).withColumn("w", F.when(F.floor("at") == F.ceil("at"), 1.0).otherwise(1.0 - F.abs(F.col("at") - F.col("rank"))))
    picks = picks.select("q", "w", (F.col("start") + F.col("rank")).alias("rank"))  # ten rows a class and feature
    got = rows.join(F.broadcast(picks), "rank").groupBy("_c", "feature").agg(*[F.sum(F.when(F.col("q") == k, F.col("w") * F.col("x"))).alias(k) for k in QUANTILES])
    return per.join(got, ["_c", "feature"]).select(F.col("_c").alias(label), "feature", "mean", "std", *QUANTILES)


def folds(df: DataFrame, k: int, label: str, order: str) -> DataFrame:
    """df with `fold`: each class in contiguous blocks by order, of the sizes that a stratified unshuffled split gives them.

    Fold f gets as many of a class as the class has at places f, f + k, ... of
    the labels in sorted order. The driver sees a count per class.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    at, fold = 0, F.lit(0)
    for y in sorted(counts):
        edge = at
        for f in range(1, k):
            edge += len(range((f - 1 - at) % k + at, at + counts[y], k))
            fold = F.when((F.col(label) == y) & (F.col("_rank") >= edge), f).otherwise(fold)
        at += counts[y]
    return ranked(df, [label, order], "_rank").withColumn("fold", fold).drop("_rank")


def _fit(df: DataFrame, columns: list[str], y: str, reg: float, iterations: int):
    data = VectorAssembler(inputCols=columns, outputCol="_v").transform(df).select("_v", F.col(y).cast("double").alias("_y"))
    m = LogisticRegression(featuresCol="_v", labelCol="_y", regParam=reg, elasticNetParam=0.0, standardization=False, fitIntercept=True, maxIter=iterations, tol=1e-9).fit(data)
    return [float(x) for x in m.coefficients], float(m.intercept)


def train(df: DataFrame, features: list[str], y: str = "y", order: str = "id", config: Config = Config(), scorer_name: str | None = None) -> Detector:
    """Fits on all rows of df; y is 1 for ai. Features are scaled on all rows before folding.

    The penalty is 1 / (c n) on standardised features, none on the intercept.
    With fewer than two rows of a class there is no calibration; with one
    class only it is an error.
    """
    df = df.select(order, F.col(y).cast("int").alias("_label"), *features).persist()
    try:
        counts = {r[0]: r[1] for r in df.groupBy("_label").count().collect()}
        if len(counts) < 2:
            raise ValueError("both classes are needed")
        n = sum(counts.values())
        center, scale = scaler(df, features)
        z = df.select(order, "_label", *[((F.col(f) - m) / s).alias(f"z{i}") for i, (f, m, s) in enumerate(zip(features, center, scale))])
        names = [f"z{i}" for i in range(len(features))]
        coef, intercept = _fit(z, names, "_label", 1.0 / (config.c * n), config.max_iter)
        k = min(config.folds, min(counts.values()))
        calibration = None
        if config.calibrate and k >= 2:
            parted = folds(z, k, "_label", order).persist()
            scored = None
            for f in range(k):
                w, b = _fit(parted.where(F.col("fold") != f), names, "_label", 1.0 / (config.c * parted.where(F.col("fold") != f).count()), config.max_iter)
                s = F.lit(b)
                for name, x in zip(names, w):
                    s = s + F.col(name) * x
                part = parted.where(F.col("fold") == f).select("_label", s.alias("s"))
                scored = part if scored is None else scored.unionByName(part)
            (a,), b = _fit(scored, ["s"], "_label", 1.0 / n, config.max_iter)
            calibration = (a, b)
            parted.unpersist()
        dist: dict = {}
        for r in distributions(df.withColumn("label", F.when(F.col("_label") == 1, "ai").otherwise("human")), features).collect():  # two classes, a row per feature
            dist.setdefault(r["label"], {})[r["feature"]] = {k2: r[k2] for k2 in ("mean", "std", *QUANTILES)}
        return Detector(features, center, scale, coef, intercept, calibration, scorer_name, {"n": n, "n_ai": counts.get(1, 0), "c": config.c, "seed": config.seed}, dist)
    finally:
        df.unpersist()


def compare(df: DataFrame, features: list[str], table: DataFrame, key: str) -> DataFrame:
    """(key, feature, observed, human_mean, human_std, ai_mean, ai_std, z_vs_human, z_vs_ai, closer_to) against class distributions.

    table: distributions() of human and ai. A deviation of 0 gives a z of 0;
    absolute values nearer than 0.25 to each other are 'similar'.
    """
    t = table.where("label in ('human', 'ai')").groupBy("feature").pivot("label", ["human", "ai"]).agg(F.first("mean").alias("mean"), F.first("std").alias("std")).where("human_mean is not null and ai_mean is not null")
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("observed")) for f in features])).alias("v")).select(key, "v.feature", "v.observed")
    z = lambda c: F.when(F.col(f"{c}_std") > 0, (F.col("observed") - F.col(f"{c}_mean")) / F.when(F.col(f"{c}_std") > 0, F.col(f"{c}_std"))).otherwise(0.0)
    out = long.join(F.broadcast(t), "feature").withColumn("z_vs_human", z("human")).withColumn("z_vs_ai", z("ai"))  # a row per feature
    a, b = F.abs("z_vs_human"), F.abs("z_vs_ai")
    return out.withColumn("closer_to", F.when(F.abs(a - b) < MARGIN, "similar").when(a < b, "human").otherwise("ai"))


def sigmoid_scalar(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))
