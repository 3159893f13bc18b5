"""A small made-up corpus for tests and demos, built from hashes: the same seed gives the same records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import builders
from .schema import GENERATION, SPAN, TRANSFORM

_SUBJECTS = "river,market,garden,teacher,engine,letter,window,winter,cousin,bridge".split(",")
_HUMAN = "stumbled home before dawn,lost its best lantern,never liked the rain,broke twice that year,smelled of oranges".split(",")
_AI = "plays an important role,offers many significant benefits,can help people often,is important for many reasons,shows a very clear trend".split(",")


def corpus(spark: SparkSession, human: int = 36, ai: int = 44, paraphrases: int = 10, mixed: int = 12, seed: int = 0) -> DataFrame:
    """Records: human and ai texts, paraphrases of ai ones in their groups, and mixed ones of reserved pairs."""
    def words(values, *at):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64(*at, F.lit(seed)), F.lit(len(values))) + 1).cast("int"))

    def text(kind, i):
        tails = _HUMAN if kind == "human" else _AI
        n = F.lit(9) if kind == "ai" else F.lit(5) + F.pmod(F.xxhash64(i), F.lit(7))
        opening = F.lit("Furthermore, the ") if kind == "ai" else F.lit("Our ")
        extra = lambda k: F.when(F.pmod(F.xxhash64(i, k), F.lit(3)) == 0, F.lit(", oddly enough, with nobody watching and all the lamps gone out")).otherwise("") if kind == "human" else F.lit("")
        return F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), lambda k: F.concat(opening, words(_SUBJECTS, F.lit(kind), i, k), F.lit(" "), words(tails, i, k, F.lit("t")), extra(k), F.lit("."))), " ")

    fams = ["alpha", "beta", "gamma"]
    i = F.col("i")
    gen = F.struct(F.element_at(F.array(*[F.lit(f) for f in fams]), (F.pmod(i, F.lit(3)) + 1).cast("int")).alias("model_family"), F.lit("demo").alias("model_name"), *[F.lit(None).cast(t).alias(n) for n, t in (("provider", "string"), ("temperature", "double"), ("top_p", "double"), ("prompt_id", "string"), ("prompt_summary", "string"))]).cast(GENERATION)
    rest = [F.lit(None).cast(TRANSFORM).alias("transform"), F.lit(None).cast("string").alias("split"), F.create_map().cast("map<string,string>").alias("meta")]
    none = F.array().cast(f"array<{SPAN}>").alias("spans")
    ident = lambda p: F.format_string(f"{p}-%04d", i)
    h = spark.range(human).withColumnRenamed("id", "i").select(ident("h").alias("id"), text("human", i).alias("text"), F.lit("human").alias("label"), none, F.lit("demo").alias("source"), ident("gh").alias("group_id"), F.lit(None).cast(GENERATION).alias("generation"), *rest)
    a = spark.range(ai).withColumnRenamed("id", "i").select(ident("a").alias("id"), text("ai", i).alias("text"), F.lit("ai").alias("label"), none, F.lit("demo").alias("source"), ident("ga").alias("group_id"), gen.alias("generation"), *rest)
    p = builders.paraphrase_records(a.orderBy("id").limit(paraphrases), seed)
    pairs = spark.range(mixed).withColumnRenamed("id", "i").select(ident("m").alias("id"), text("human", i + 1000).alias("h"), text("ai", i + 1000).alias("a"), gen.alias("generation"), ident("gm").alias("group_id"))
    m = builders.mix(pairs, "id", "h", "a", seed).join(pairs.select("id", "generation", "group_id"), "id").select("id", "text", F.lit("mixed").alias("label"), "spans", F.lit("demo").alias("source"), "group_id", "generation", *rest)
    return h.unionByName(a).unionByName(p.select(h.columns)).unionByName(m)
