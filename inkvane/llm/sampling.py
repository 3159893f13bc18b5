"""Problem 5: a sample whose category shares follow given targets.

Method: systematic unequal-probability sampling. Inclusion probabilities are
fitted to the targets of all axes at once on the cells (combinations of
categories), records stand in random order within sorted cells, a running sum
of probabilities goes across hash buckets, and a record is taken where the sum
passes an integer plus one random start. Then floors are repaired.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import categories as cat

BUCKETS = 256
SHARE = 10_000


def records_with_axes(df: DataFrame) -> DataFrame:
    """(id, label, model_family, source): one row per distinct id, category values in plain form; null where there is none."""
    values = {"label": F.col("label"), "model_family": F.col("generation.model_family"), "source": F.col("source")}
    return cat.distinct_records(df, {k: cat.plain(v) for k, v in values.items()})


def cells(records: DataFrame, axes: list[str]) -> DataFrame:
    """Counts of each combination of categories."""
    return records.groupBy(*axes).count()


def ranked(df: DataFrame, strata: list[str], seed: int = 1, key: str = "id") -> DataFrame:
    """df with `order` and `rank`: rows in random order within their stratum, counted from 1.

    Ranks go across hash buckets, which are counted first, so that a stratum of
    most rows isn't sorted in one task.
    """
    df = df.withColumn("order", F.xxhash64(key, F.lit(seed))).withColumn("bucket", F.pmod(F.shiftright("order", 20), F.lit(BUCKETS)))
    per = df.groupBy(*strata, "bucket").count().withColumn("skip", F.coalesce(F.sum("count").over(Window.partitionBy(*strata).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    rank = F.row_number().over(Window.partitionBy(*strata, "bucket").orderBy("order", key)) + F.col("skip")
    return df.join(per, [*strata, "bucket"]).withColumn("rank", rank).drop("skip", "bucket")


def select(df: DataFrame, strata: list[str], num: str, den: str, start, seed: int = 1, key: str = "id") -> DataFrame:
    """df with `order`, `rank` and `taken`: systematic sampling with inclusion probability num / den in each stratum.

    The running sum of the probabilities goes over the rows in random order,
    from `start` on (a column, in units of 1 / den); a row is taken where it
    passes an integer.
    """
    passed = lambda r: F.floor((start + r * F.col(num)) / F.col(den) + 1e-9)
    return ranked(df, strata, seed, key).withColumn("taken", passed(F.col("rank")) > passed(F.col("rank") - 1))


def reached(records: DataFrame, targets: DataFrame, divisor: int = 5, seed: int = 1) -> DataFrame:
    """(axis, category, needed, reached): what systematic sampling gets for each target by itself.

    needed is the larger of min_count and share_bp of the sample size (distinct
    ids div `divisor`), rounded up. The records of the category are drawn with
    probability needed by available, at most 1, so that reached falls short of
    needed where, and only where, the target cannot be met. A null min_count or
    share counts as 0; rows of axes the records don't have reach 0.
    """
    axes = [c for c in records.columns if c != "id"]
    records = cut(records)
    counted = cells(records, axes)
    total = counted.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("all")).select(F.floor(F.col("all") / divisor).cast("long").alias("size"))
    each = lambda extra: F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("category")) for a in axes])).alias("x")
    by = counted.select(each(0), "count").where("x.category is not null").groupBy("x.axis", "x.category").agg(F.sum("count").alias("available"))
    need = F.expr(f"greatest(cast(coalesce(min_count, 0) as long), (coalesce(share_bp, 0) * size + {SHARE - 1}) div {SHARE})")
    t = targets.select("axis", cat.plain(F.col("category")).alias("category"), "share_bp", "min_count")
    t = t.join(F.broadcast(total), F.lit(True)).withColumn("needed", need)  # one row
    t = cut(t.join(by, ["axis", "category"], "left").select("axis", "category", "needed", F.coalesce("available", F.lit(0)).alias("available")))
    goal = t.groupBy("axis", "category").agg(F.max("needed").alias("needed"), F.max("available").alias("available"))
    goal = goal.select("axis", "category", F.least("needed", "available").alias("num"), F.col("available").alias("den")).where("num > 0")
    rows = records.select("id", each(0)).select("id", "x.axis", "x.category").join(F.broadcast(goal), ["axis", "category"])  # a row a target
    drawn = select(rows, ["axis", "category"], "num", "den", F.lit(0), seed)
    got = drawn.where("taken").groupBy("axis", "category").agg(F.count("*").alias("reached"))
    return t.join(got, ["axis", "category"], "left").select("axis", "category", "needed", F.least("needed", F.coalesce("reached", F.lit(0))).alias("reached"))


def unmet(records: DataFrame, targets: DataFrame, divisor: int = 5, seed: int = 1) -> DataFrame:
    """(axis, category, needed, reached): the targets that the sampler cannot meet, as too few distinct records have the category."""
    return reached(records, targets, divisor, seed).where("reached < needed")


def fit_probabilities(cell_rows: list[dict], axes: list[str], targets: dict[tuple[str, str], tuple[float, int]], size: int, rounds: int = 200) -> tuple[list[float], float]:
    """The expected number of records to take from each cell, by raking to the targets (share, minimum) of each category, and the largest deviation left.

    A cell gives at most what it has. On each axis the shares hold among the
    records that have a value there, so that targets of an axis on which many
    records have none don't contradict those of the others; values without a
    target get what the targets leave.
    """
    have = [float(c["count"]) for c in cell_rows]
    total = sum(have)
    take = [h * min(1.0, size / total) if total else 0.0 for h in have]
    none, groups = {a: [] for a in axes}, {a: {} for a in axes}
    for i, c in enumerate(cell_rows):
        for a in axes:
            if c[a] is None:
                none[a].append(i)
            else:
                groups[a].setdefault(c[a] if (a, c[a]) in targets else None, []).append(i)
    worst = 0.0
    for _ in range(rounds):
        worst = 0.0
        for a in axes:
            valued = size - sum(take[i] for i in none[a])
            want = {k: max(targets[a, k][1], targets[a, k][0] * valued) for k in groups[a] if k is not None}
            if None in groups[a]:
                want[None] = max(0.0, valued - sum(s * valued for (x, _), (s, _m) in targets.items() if x == a))
            for k, idx in groups[a].items():
                goal = min(want[k], sum(have[i] for i in idx))
                now = sum(take[i] for i in idx)
                worst = max(worst, abs(now - goal))
                for _ in range(20):  # cells that are used up pass their part on
                    if abs(now - goal) < 1e-9:
                        break
                    if now <= 0:
                        for i in idx:
                            take[i] = have[i] * goal / sum(have[i] for i in idx)
                    else:
                        for i in idx:
                            take[i] = min(have[i], take[i] * goal / now)
                    now = sum(take[i] for i in idx)
        for _ in range(20):
            s = sum(take)
            if s <= 0 or abs(s - size) < 1e-9:
                break
            take = [min(h, t * size / s) for h, t in zip(have, take)]
        if worst < 1e-6 * max(1, size):
            break
    return take, worst


def draw(df: DataFrame, targets: DataFrame, divisor: int = 5, seed: int = 1) -> DataFrame:
    """(id, label, model_family, source): the sample; its size is the number of distinct ids div `divisor`.

    The driver sees one row per cell: at most the product of the category
    counts, whatever the number of records. The same seed gives the same
    sample. An empty table gives an empty sample.
    """
    axes = ["label", "model_family", "source"]
    rec = cut(records_with_axes(df))
    rows = sorted((r.asDict() for r in cells(rec, axes).collect()), key=lambda c: [(c[a] is not None, c[a] or "") for a in axes])
    total = sum(c["count"] for c in rows)
    size = total // divisor
    goal: dict[tuple[str, str], tuple[float, int]] = {}
    for t in targets.select("axis", cat.plain(F.col("category")).alias("category"), F.coalesce("share_bp", F.lit(0)).alias("s"), F.coalesce("min_count", F.lit(0)).alias("m")).collect():
        goal[(t["axis"], t["category"])] = (t["s"] / SHARE, t["m"])
    take, left = fit_probabilities(rows, axes, goal, size)
    if left > 0.5:
        warnings.warn(f"targets of different axes contradict each other: a category is {left:.0f} records off its target", stacklevel=2)
    spark = df.sparkSession
    start = (seed * 0x9E3779B97F4A7C15 % 2**32) / 2**32
    plan, at = [], start
    for k, (c, n) in enumerate(zip(rows, take)):
        plan.append((*[c[a] for a in axes], k, at, n / c["count"] if c["count"] else 0.0))
        at += n
    cell = spark.createDataFrame(plan, "label string, model_family string, source string, cell int, before double, p double")
    same = [rec[a].eqNullSafe(cell[a]) for a in axes]
    joined = rec.join(cell, same).select("id", *[rec[a] for a in axes], "cell", "before", "p")
    drawn = cut(select(joined.withColumn("one", F.lit(1.0)), ["cell"], "p", "one", F.col("before"), seed).select("id", *axes, "taken"))
    return _repair(drawn, axes, goal, seed)


def _repair(ranked_rows: DataFrame, axes: list[str], goal: dict, seed: int) -> DataFrame:
    """Adds the records that come next in random order to categories short of their floor, as far as there are any."""
    for a in axes:
        floors = {c: least for (x, c), (_, least) in goal.items() if x == a and least > 0}
        if not floors:
            continue
        now = {r[a]: (r["t"], r["n"]) for r in ranked_rows.where(F.col(a).isin(list(floors))).groupBy(a).agg(F.sum(F.col("taken").cast("int")).alias("t"), F.count("*").alias("n")).collect()}
        short = {c: min(f, now.get(c, (0, 0))[1]) - now.get(c, (0, 0))[0] for c, f in floors.items()}
        short = {c: n for c, n in short.items() if n > 0}
        if not short:
            continue
        want = ranked_rows.sparkSession.createDataFrame(list(short.items()), f"`{a}` string, lacking long")  # a row a target
        rest = ranked(ranked_rows.where(~F.col("taken")).select("id", a).join(F.broadcast(want), a), [a], seed)
        adds = rest.where("rank <= lacking").select("id", F.lit(True).alias("add"))
        ranked_rows = cut(ranked_rows.join(adds, "id", "left").withColumn("taken", F.col("taken") | F.coalesce("add", F.lit(False))).drop("add"))
    return ranked_rows.where("taken").select("id", *axes)


def report(sample: DataFrame, targets: DataFrame) -> DataFrame:
    """(axis, category, drawn, share, target): what the sample reached for each target."""
    axes = [c for c in sample.columns if c != "id"]
    counted = cells(sample, axes)
    total = counted.agg(F.sum("count").alias("all"))
    by = counted.select(F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("category")) for a in axes])).alias("x"), "count").groupBy("x.axis", "x.category").agg(F.sum("count").alias("drawn"))
    t = targets.select("axis", cat.plain(F.col("category")).alias("category"), "share_bp")
    return t.join(by, ["axis", "category"], "left").join(F.broadcast(total), F.lit(True)).select("axis", "category", F.coalesce("drawn", F.lit(0)).alias("drawn"), F.round(F.coalesce("drawn", F.lit(0)) / F.col("all"), 6).alias("share"), F.round(F.col("share_bp") / SHARE, 6).alias("target"))
