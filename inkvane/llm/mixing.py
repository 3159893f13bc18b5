"""Problem 8: sources combined to target shares of the tokens, by weighted fair queueing.

Each document gets a virtual finish time: the tokens of its source up to and
with it, in random order, divided by the source's weight; a source that is used
again starts over where its last round ended. All documents are sorted by that
time over the cluster and cut off where the mix is full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, shuffle_partitions
from . import categories as cat
from . import tokens

SHARE = 10_000


def sized(documents: DataFrame, path: str = tokens.RANKS) -> DataFrame:
    """(doc_id, source, n_tokens), source in plain form."""
    src = documents.select("doc_id", cat.plain(F.col("source")).alias("source"), "text")
    return cut(tokens.count_tokens(src, ["doc_id", "source"], "text", path))


def supply(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: source, share_bp, max_repeats, tokens (0 without documents), budget (the mix, half of all tokens)."""
    per = docs.select("source", "n_tokens").groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    total = per.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all")).select(F.expr("all div 2").alias("budget"))
    t = targets.select(cat.plain(F.col("source")).alias("source"), F.coalesce("share_bp", F.lit(0)).cast("long").alias("share_bp"), F.coalesce("max_repeats", F.lit(1)).cast("long").alias("max_repeats")).where("source is not null")
    return t.join(per, "source", "left").withColumn("tokens", F.coalesce("tokens", F.lit(0))).join(F.broadcast(total), F.lit(True))  # one row


def level(rows: list, budget: int) -> float:
    """The virtual time at which the sources have given the budget together, each no more than it can; inf if they can't."""
    ends = sorted((r["tokens"] * r["max_repeats"] / r["share_bp"], r["share_bp"]) for r in rows if r["share_bp"] > 0)
    weight, given, now = sum(w for _, w in ends), 0.0, 0.0
    for end, w in ends:
        if given + (end - now) * weight >= budget:
            return now + (budget - given) / weight if weight else 0.0
        given += (end - now) * weight
        now, weight = end, weight - w
    return float("inf")


def queue(docs: DataFrame, supplied: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, copy, n_tokens, share_bp, served, finish): every use of a document with its virtual finish time.

    docs: (doc_id, source, n_tokens). served are the tokens of the source up to
    and with the document, earlier copies included; finish is served by
    share_bp. Sources without a target or with share 0 and empty documents are
    left out, and so is what comes only after the mix is full and every target
    met. Running sums of a source are made per hash bucket and added up, so
    that a source of most documents isn't sorted in one task.
    """
    rows = supplied.collect()  # one row a target
    budget = rows[0]["budget"] if rows else 0
    last = max(level(rows, budget), budget / SHARE)
    own = docs.select("doc_id", "source", "n_tokens").join(F.broadcast(supplied.select("source", "share_bp", "max_repeats", F.col("tokens").alias("all"))), "source").where("share_bp > 0 and n_tokens > 0")
    own = own.withColumn("order", F.xxhash64("doc_id", "source", F.lit(seed))).withColumn("bucket", F.shiftrightunsigned("order", 56))
    ahead = own.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"), F.max(F.col("n_tokens") / F.col("share_bp")).alias("longest"))
    ahead = ahead.withColumn("ahead", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ahead = ahead.withColumn("longest", F.max("longest").over(Window.partitionBy("source"))).drop("t")  # at most 256 rows a source
    run = own.withColumn("run", F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))).join(ahead, ["source", "bucket"])
    uses = F.col("max_repeats")
    if last != float("inf"):  # no more copies than can come before the cut
        uses = F.least(uses, F.floor((F.lit(last) + F.col("longest")) * F.col("share_bp") / F.col("all")).cast("long") + 1)
    run = run.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), uses - 1)))
    run = run.withColumn("served", F.col("copy") * F.col("all") + F.col("ahead") + F.col("run")).withColumn("finish", F.col("served") / F.col("share_bp"))
    if last != float("inf"):
        run = run.where(F.col("finish") <= F.lit(last) + F.col("longest") + 1e-6)
    return run.select("doc_id", "source", "copy", "n_tokens", "share_bp", "served", "finish")


def short(queued: DataFrame, supplied: DataFrame) -> DataFrame:
    """The targets whose source has run out before its share of the mix: its last finish time comes before that of the share."""
    last = queued.groupBy("source").agg(F.max("served").alias("served"))
    return supplied.join(last, "source", "left").where(F.coalesce("served", F.lit(0)) * SHARE < F.col("share_bp") * F.col("budget")).drop("served")


def mix(docs: DataFrame, targets: DataFrame, seed: int = 1) -> DataFrame:
    """(doc_id, source, copy, n_tokens, position): the mix in order; copy counts from 0.

    The queue's documents by finish time, up to the budget: half of all tokens.
    If all sources together can't fill the budget, everything that may be used
    is. The running sum over the mix goes by range partitions, so that no task
    sorts more than one of them.
    """
    s = supply(docs, targets)
    budget = (s.select("budget").first() or [0])[0]
    key = ["finish", "source", "doc_id", "copy"]
    run = queue(docs, s, seed).select("doc_id", "source", "copy", "n_tokens", "finish")
    placed = cut(run.repartitionByRange(shuffle_partitions(docs.sparkSession), *key).withColumn("part", F.spark_partition_id()))
    before = placed.groupBy("part").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("c"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    before = before.select("part", F.coalesce(F.sum("t").over(w), F.lit(0)).alias("t0"), F.coalesce(F.sum("c").over(w), F.lit(0)).alias("c0"))
    inner = Window.partitionBy("part").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.withColumn("t", F.sum("n_tokens").over(inner)).withColumn("c", F.count("*").over(inner)).join(F.broadcast(before), "part")
    return out.where(F.col("t") + F.col("t0") <= budget).select("doc_id", "source", "copy", "n_tokens", (F.col("c") + F.col("c0")).alias("position"))


def report(mixed: DataFrame, supplied: DataFrame) -> DataFrame:
    """(source, tokens, share, target, uses, falls_short) for every target."""
    per = mixed.groupBy("source").agg(F.sum("n_tokens").alias("used"), (F.max("copy") + 1).alias("uses"))
    total = per.agg(F.sum("used").alias("all"))
    out = supplied.join(per, "source", "left").join(F.broadcast(total), F.lit(True))
    used = F.coalesce("used", F.lit(0))
    return out.select("source", used.alias("tokens"), F.round(used / F.col("all"), 6).alias("share"), F.round(F.col("share_bp") / SHARE, 6).alias("target"), F.coalesce("uses", F.lit(0)).alias("uses"), (F.col("tokens") * F.col("max_repeats") * SHARE < F.col("share_bp") * F.col("budget")).alias("falls_short"))
