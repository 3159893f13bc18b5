"""Problem 2: records that belong together, and splits that keep them together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from . import categories as cat

SALTS = 1024
BUCKETS = 256


def min_label(edges: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, label): the smallest node of each connected component of the bipartite edges (node, entity), both long.

    Each round gives every entity the least label of its nodes and every node
    the least of its entities, then follows the label's own label, so chains
    shorten by half or more. Nodes whose component is settled cost one more
    round only: a round ends the loop when no label has changed. Every round's
    labels are written to the checkpoint folder.
    """
    state = cut(edges.select("node", "entity", F.col("node").alias("label")))
    for _ in range(most_rounds):
        by_entity = state.select("node", "entity", F.col("label").alias("old"), F.min("label").over(Window.partitionBy("entity")).alias("label"))
        by_node = by_entity.withColumn("label", F.min("label").over(Window.partitionBy("node")))
        # a label is a node: take over what that node's own label has become
        jump = by_node.groupBy("node").agg(F.min("label").alias("next")).where("next < node").select(F.col("node").alias("label"), "next")
        state = cut(by_node.join(jump, "label", "left").select("node", "entity", F.coalesce("next", "label").alias("label"), (F.coalesce("next", "label") < F.col("old")).alias("moved")))
        if not state.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError("labels did not settle")
    return state.groupBy("node").agg(F.min("label").alias("label"))


def bipartite(nodes: DataFrame) -> DataFrame:
    """Edges (node, entity) from nodes (node, id, group, parent); entities with one node only are left out.

    An entity is a group key, or a record id that is itself or the parent of
    others. A hot entity may hold a third of all rows: its nodes are first tied
    in SALTS parts, then the parts' least nodes with each other, so that no
    task sees more than a part of it.
    """
    pairs = nodes.select("node", F.explode(F.filter(F.array(
        F.struct(F.lit("g").alias("kind"), F.col("group").alias("key")),
        F.struct(F.lit("p").alias("kind"), F.col("parent").alias("key")),
        F.struct(F.lit("p").alias("kind"), F.col("id").alias("key")),
    ), lambda x: x["key"].isNotNull())).alias("e")).select("node", "e.kind", "e.key").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    part = pairs.withColumn("hub", F.min("node").over(Window.partitionBy("kind", "key", "salt")))
    inner = part.where("node <> hub").select("node", F.col("hub").alias("entity"))
    hubs = part.where("node = hub").select("kind", "key", "node").withColumn("entity", F.min("node").over(Window.partitionBy("kind", "key"))).where("node <> entity").select("node", "entity")
    ties = inner.unionByName(hubs).distinct()
    return ties.unionByName(ties.select(F.col("entity").alias("node"), "entity").distinct())


def units(df: DataFrame, key: str = "id", group: str = "group_id", parent: str = "transform.parent_id", extra: dict | None = None) -> DataFrame:
    """One row per distinct record: id, unit (long), unit_id (least id of the unit, binary order), and the extra values.

    A null id gives no row; a null group or parent ties nothing; a parent that
    is no record still ties its children.
    """
    values = {"group": cat.group_key(F.col(group)), "parent": F.col(parent).cast("string")} | (extra or {})
    nodes = cut(cat.distinct_records(df, values, key).withColumn("node", F.monotonically_increasing_id()))
    labels = min_label(bipartite(nodes.select("node", "id", "group", "parent")))
    tied = labels.select("node", F.col("label").alias("tied_to"))
    labelled = nodes.join(tied, "node", "left").withColumn("unit", F.coalesce("tied_to", "node")).drop("tied_to", "node", "group", "parent")
    least = labelled.groupBy("unit").agg(F.min("id").alias("unit_id"))
    return labelled.join(least, "unit")


def straddling(df: DataFrame) -> DataFrame:
    """(record_id, unit_id): every record of each unit in which two or more splits occur; null is no split."""
    values = {"group": cat.group_key(F.col("group_id")), "parent": F.col("transform.parent_id"), "split": cat.split_name(F.col("split"))}
    nodes = cut(cat.distinct_records(df, values).withColumn("node", F.monotonically_increasing_id()))
    labels = min_label(bipartite(nodes.select("node", "id", "group", "parent")))
    tied = labels.join(nodes.select("node", "id", "split"), "node")
    broken = tied.groupBy("label").agg(F.min("id").alias("unit_id"), F.min("split").alias("a"), F.max("split").alias("b")).where("a < b").select("label", "unit_id")
    return tied.join(broken, "label").select(F.col("id").alias("record_id"), "unit_id")


def _level(c):
    """Counts up to 8 as they are, beyond in half octaves, so that the classes of units stay few."""
    return F.when(c <= 8, c.cast("double")).otherwise(F.floor(F.log2(F.greatest(c, F.lit(1))) * 2) + 10.0)


def allocate(classes: list[dict], labels: list[str], shares: dict[str, float]) -> dict[int, dict[str, int]]:
    """How many units of each class go to each split.

    classes: {"kind", "units", one total per label}. Classes with the largest
    units come first; each unit goes where the squared distance of the label
    counts from their targets grows least. A class of many units is first
    shared out by what the splits still lack, then the rest one by one.
    """
    total = {l: sum(c[l] for c in classes) for l in labels}
    have = {s: dict.fromkeys(labels, 0.0) for s in shares}
    out: dict[int, dict[str, int]] = {}
    for c in sorted(classes, key=lambda c: (-sum(c[l] for l in labels) / c["units"], c["kind"])):
        mean = {l: c[l] / c["units"] for l in labels}
        norm = sum(v * v for v in mean.values()) or 1.0
        want = {s: max(0.0, sum((shares[s] * total[l] - have[s][l]) * mean[l] for l in labels) / norm) for s in shares}
        scale = min(1.0, max(0, c["units"] - 64) / (sum(want.values()) or 1.0))
        took = {s: int(want[s] * scale) for s in shares}
        for s in shares:
            for l in labels:
                have[s][l] += took[s] * mean[l]
        for _ in range(c["units"] - sum(took.values())):
            def grown(s):
                return sum(mean[l] * (mean[l] + 2 * (have[s][l] - shares[s] * total[l])) / max(1.0, shares[s] * total[l]) for l in labels)
            s = min(shares, key=grown)
            took[s] += 1
            for l in labels:
                have[s][l] += mean[l]
        out[c["kind"]] = took
    return out


def assign_splits(df: DataFrame, targets: DataFrame, label: str = "label") -> DataFrame:
    """(id, unit_id, label, assigned): one split for every unit, with shares near the targets for each label.

    Units are put into classes of equal label counts (large counts in half
    octaves). The driver sees one row per class, not per unit. Units of a class
    take their splits by a rank that is counted per hash bucket and summed, so
    a class of most units isn't ranked in one task.
    """
    shares = {r["split"]: r["share_bp"] / 10000 for r in targets.select("split", "share_bp").where("split is not null and share_bp > 0").collect()}
    rec = cut(units(df, extra={"label": cat.plain(F.col(label))}).withColumn("label", F.coalesce("label", F.lit("(none)"))))
    if not shares:
        return rec.select("id", "unit_id", "label", F.lit(None).cast("string").alias("assigned"))
    labels = sorted(r[0] for r in rec.select("label").distinct().collect())
    if not labels:
        return rec.select("id", "unit_id", "label", F.lit(None).cast("string").alias("assigned"))
    names = [f"n{i}" for i in range(len(labels))]
    per = rec.groupBy("unit").agg(*[F.sum((F.col("label") == l).cast("int")).alias(n) for n, l in zip(names, labels)])
    per = cut(per.withColumn("kind", F.xxhash64(*[_level(F.col(n)) for n in names])).withColumn("bucket", F.pmod(F.xxhash64("unit", F.lit(7)), F.lit(BUCKETS))))
    kinds = [r.asDict() for r in per.groupBy("kind").agg(F.count("*").alias("units"), *[F.sum(n).alias(n) for n in names]).collect()]
    plan = allocate(kinds, names, shares)
    rows, order = [], list(shares)
    for kind, took in plan.items():
        at = 0
        for s in order:
            if took[s]:
                rows.append((kind, at, at + took[s], s))
                at += took[s]
    spark = df.sparkSession
    quota = spark.createDataFrame(rows, "kind long, low long, high long, assigned string")
    before = per.groupBy("kind", "bucket").count().withColumn("before", F.coalesce(F.sum("count").over(Window.partitionBy("kind").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    ranked = per.select("unit", "kind", "bucket").withColumn("rank", F.row_number().over(Window.partitionBy("kind", "bucket").orderBy(F.xxhash64("unit"), "unit")) - 1)
    ranked = ranked.join(before, ["kind", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    chosen = ranked.join(quota, (ranked.kind == quota.kind) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))).select("unit", "assigned")
    return rec.join(chosen, "unit").select("id", "unit_id", "label", "assigned")


def split_report(assigned: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, label, records, share, target): shares reached of each label and split."""
    n = assigned.groupBy("assigned", "label").count()
    t = n.groupBy("label").agg(F.sum("count").alias("all"))
    return n.join(t, "label").join(targets.select(F.col("split").alias("assigned"), "share_bp"), "assigned", "left").select(
        F.col("assigned").alias("split"), "label", F.col("count").alias("records"), F.round(F.col("count") / F.col("all"), 6).alias("share"), F.round(F.col("share_bp") / 10000, 6).alias("target"))
