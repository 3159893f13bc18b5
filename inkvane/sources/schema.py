"""The document record: Spark schema and validation as rows with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLITS = ("train", "val", "test")
LABELS = ("human", "ai", "mixed")
SPAN = "struct<start:int,end:int,label:string>"
GENERATION = "struct<model_family:string,model_name:string,provider:string,temperature:double,top_p:double,prompt_id:string,prompt_summary:string>"
TRANSFORM = "struct<kind:string,parent_id:string,tool:string>"
DDL = f"id string, text string, label string, spans array<{SPAN}>, source string, group_id string, generation {GENERATION}, transform {TRANSFORM}, split string, meta map<string,string>"
_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


RECORD = _struct(
    id=_S, text=_S, label=_S, spans=T.ArrayType(_struct(start=_I, end=_I, label=_S)), source=_S, group_id=_S,
    generation=_struct(model_family=_S, model_name=_S, provider=_S, temperature=_D, top_p=_D, prompt_id=_S, prompt_summary=_S),
    transform=_struct(kind=_S, parent_id=_S, tool=_S), split=_S, meta=T.MapType(_S, _S))


def is_paraphrase():
    return F.coalesce(F.col("transform.kind") == "paraphrase", F.lit(False))


def broken_rules() -> Column:
    """array<string>: the rules that a record breaks."""
    def empty(c):
        return F.coalesce(F.col(c), F.lit("")) == ""

    spans = F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))
    kinds = F.array_distinct(F.transform(spans, lambda s: s["label"]))
    label = F.col("label")
    starts, ends = F.transform(spans, lambda s: s["start"]), F.transform(spans, lambda s: s["end"])
    overlap = F.exists(F.zip_with(F.slice(starts, 2, F.greatest(F.size(spans), F.lit(1))), F.slice(ends, 1, F.greatest(F.size(spans) - 1, F.lit(0))), lambda a, b: a < b), lambda x: F.coalesce(x, F.lit(False)))
    rules = {
        **{f"{c} is empty": empty(c) for c in ("id", "text", "source", "group_id")},
        "unknown label": ~F.coalesce(label.isin(*LABELS), F.lit(False)),
        "span bounds": F.exists(spans, lambda s: F.coalesce((s["start"] < 0) | (s["end"] <= s["start"]), F.lit(True))),
        "unknown span label": F.exists(spans, lambda s: ~F.coalesce(s["label"].isin("human", "ai"), F.lit(False))),
        "mixed needs spans of both kinds": (label == "mixed") & ~(F.array_contains(kinds, "human") & F.array_contains(kinds, "ai")),
        "pure record has spans": label.isin("human", "ai") & (F.size(spans) > 0),
        "span past the text": F.exists(spans, lambda s: s["end"] > F.length(F.coalesce("text", F.lit("")))),
        "spans overlap or are out of order": overlap,
        "generation missing": label.isin("ai", "mixed") & F.col("generation").isNull(),
        "human record has generation": (label == "human") & F.col("generation").isNotNull(),
        "temperature out of range": F.col("generation.temperature") < 0,
        "top_p out of range": (F.col("generation.top_p") < 0) | (F.col("generation.top_p") > 1),
        "unknown split": F.col("split").isNotNull() & ~F.coalesce(F.col("split").isin(*SPLITS), F.lit(False)),
    }
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda r: r.isNotNull())


def violations(df: DataFrame) -> DataFrame:
    """(id, reason): every broken rule of every record; ids that occur twice once per id. Row-local but for the last."""
    rows = df.select("id", F.explode(broken_rules()).alias("reason"))
    return rows.unionByName(duplicate_ids(df).select("id", F.lit("duplicate id").alias("reason")))


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def validate(df: DataFrame) -> DataFrame:
    """df, if no rule is broken; else an error that names the first ones."""
    bad = violations(df).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['id']}: {r['reason']}" for r in bad))
    return df
