"""Paraphrases, mixed documents and span handling. Random choices come from hashes of seed and place, so they don't depend on the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.wordlists import SYNONYMS

def digit(*parts: Column | str | int) -> Column:
    """A pseudo-random number from 0 to 15: the first digit of the MD5 of the parts joined by colons."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in cols])), 1, 1), 16, 10).cast("int")


_TOKEN = r"(?s)[A-Za-z']+|[^A-Za-z']+"


def shuffled(key: str, seed: int) -> Column:
    """A key to order rows by at random."""
    return F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))


def paraphrase(text: Column, key: Column, seed: int = 0) -> Column:
    """About half of the words that have a synonym are replaced, a leading capital kept; the coin is a hash of key, place and seed."""
    table = F.create_map(*[F.lit(x) for kv in SYNONYMS.items() for x in kv])

    def swap(tok, i):
        found = F.try_element_at(table, F.lower(tok))
        coin = digit(key, i, seed) < 8
        cased = F.when(F.regexp_like(tok, F.lit("^[A-Z]")), F.concat(F.upper(F.substring(found, 1, 1)), F.substring(found, 2, 100))).otherwise(found)
        return F.when(found.isNotNull() & coin, cased).otherwise(tok)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(_TOKEN), F.lit(0)), swap), "")


def paraphrase_records(df: DataFrame, seed: int = 0, suffix: str = "-para", tool: str = "synonyms") -> DataFrame:
    """Paraphrase records of pure records: label, group and generation stay; transform names the parent. Mixed parents are an error."""
    text = F.when(F.col("label") == "mixed", F.raise_error(F.lit("a mixed record can't be paraphrased")).cast("string")).otherwise(paraphrase(F.col("text"), F.col("id"), seed))
    tr = F.struct(F.lit("paraphrase").alias("kind"), F.col("id").alias("parent_id"), F.lit(tool).alias("tool"))
    return df.withColumn("text", text).withColumn("transform", tr).withColumn("id", F.concat("id", F.lit(suffix)))


def mix(pairs: DataFrame, key: str, human: str, ai: str, seed: int = 0, separator: str = " ") -> DataFrame:
    """(key, text, spans): the sentences of two texts in alternating blocks of 1 to 3, one label per span.

    The side that starts and the block sizes come from hashes of the key. When
    one side is used up the rest of the other follows and joins its last block.
    Pairs with a side that has no sentence give no row.
    """
    sides = pairs.select(F.col(key), F.explode(F.array(F.struct(F.lit("human").alias("label"), F.col(human).alias("t")), F.struct(F.lit("ai").alias("label"), F.col(ai).alias("t")))).alias("x"))
    sents = sides.select(key, "x.label", F.transform(tx.sentences(F.col("x.t")), lambda s: s["text"]).alias("s"))
    both = sents.groupBy(key).pivot("label", ["human", "ai"]).agg(F.first("s")).where(F.size("human").__gt__(0) & F.size("ai").__gt__(0))
    first = F.pmod(digit(F.col(key), seed), F.lit(2))
    # the n-th block of a side has 1 to 3 sentences: its number follows from running sums of hashed sizes
    one, parts = both.withColumn("first", first), None
    for k, side in enumerate(("human", "ai")):
        ends = F.aggregate(F.sequence(F.lit(0), F.size(side) - 1), F.array().cast("array<int>"), lambda acc, i: F.concat(acc, F.array((F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.pmod(digit(F.col(key), side, i, seed), F.lit(3)) + 1).cast("int"))))
        z = one.select(key, "first", side, ends.alias("ends")).select(key, "first", "ends", F.posexplode(side).alias("i", "sentence"))
        block = F.size(F.filter("ends", lambda e: e <= F.col("i")))
        turn = 2 * block + F.when(F.col("first") == k, 0).otherwise(1)
        z = z.select(key, F.lit(side).alias("label"), turn.alias("turn"), "i", "sentence")
        parts = z if parts is None else parts.unionByName(z)
    return join_sentences(parts, key, ["turn", "i"], separator)


def join_sentences(parts: DataFrame, key: str, order: list[str], separator: str = " ") -> DataFrame:
    """(key, text, spans) from labelled sentences (key, label, sentence): joined in order, neighbours of one label merged into one span."""
    w = Window.partitionBy(key).orderBy(*order)
    at = F.sum(F.length("sentence") + len(separator)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = parts.withColumn("start", F.coalesce(at, F.lit(0)).cast("int")).withColumn("end", (F.col("start") + F.length("sentence")).cast("int"))
    spans = merge_spans(p, key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    text = p.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "sentence"))), lambda s: s["sentence"]), separator).alias("text"))
    return text.join(spans, key)


def merge_spans(spans: DataFrame, key: str) -> DataFrame:
    """(key, start, end, label): neighbouring spans of one label as one (gaps and islands)."""
    w = Window.partitionBy(key).orderBy("start")
    new = F.coalesce((F.lag("label").over(w) != F.col("label")).cast("int"), F.lit(1))
    run = spans.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(key, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.first("label").alias("label")).drop("_run")


def round_robin(df: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows, one of each category in turn, in hashed order within the categories. Only ranks up to n leave their task."""
    r = F.row_number().over(Window.partitionBy(by).orderBy(shuffled(key, seed), key))
    return df.withColumn("_r", r).where(F.col("_r") <= n).orderBy("_r", by).limit(n).drop("_r")


def boost(df: DataFrame, taken: DataFrame, key: str, text: str, label: str, count: int, seed: int = 0) -> DataFrame:
    """Up to count // 2 more rows of each label whose text has not been taken, in hashed order."""
    left = df.join(taken.select(text).distinct(), text, "left_anti")
    r = F.row_number().over(Window.partitionBy(label).orderBy(shuffled(key, seed), key))
    return left.withColumn("_r", r).where(F.col("_r") <= count // 2).drop("_r")
