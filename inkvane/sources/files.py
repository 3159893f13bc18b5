"""Readers and writers: JSON lines, text folders, field-mapped JSON lines, CSV, answer pairs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from .schema import DDL, GENERATION, SPAN, TRANSFORM, broken_rules, duplicate_ids


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, line), line numbers from 1, blank lines counted.

    Files are read in Spark's splits: lines are counted per split, and a row
    per split tells how many lines come before it in its file.
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    per = raw.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return raw.join(per.withColumn("before", before), ["path", "block"]).select("path", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def read_jsonl_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records with path, line_no and error; blank lines are skipped, a line that is no record has an error and null fields."""
    rows = _lines(spark, path).where(F.regexp_like("line", F.lit(rf"[^{tx.SPACE}]")))
    parsed = rows.withColumn("r", F.from_json("line", DDL + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    err = F.when(F.col("r").isNull() | F.col("r._bad").isNotNull(), F.concat("path", F.lit(":"), F.col("line_no").cast("string")))
    return parsed.select("path", "line_no", err.alias("error"), *[F.col(f"r.{c}").alias(c) for c in _names()])


def read_jsonl(spark: SparkSession, path: str, unique: bool = True, validate: bool = True) -> DataFrame:
    """Validated records of JSON-lines files. A missing path is an error.

    A line that is no record, or that breaks a rule of the schema, fails the
    query that reads it with path:line and the rule. With unique, ids that
    occur twice are an error at once. validate=False leaves the rules out.
    """
    rows = read_jsonl_lines(spark, path)
    rows = rows.withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))).withColumn("meta", F.coalesce("meta", F.create_map().cast("map<string,string>")))
    wrong = F.when(F.col("error").isNotNull(), F.concat("error", F.lit(": invalid JSON or fields")))
    if validate:
        rule = F.get(broken_rules(), F.lit(0))
        wrong = wrong.when(rule.isNotNull(), F.concat("path", F.lit(":"), F.col("line_no").cast("string"), F.lit(": "), rule))
    df = rows.where(F.when(wrong.isNotNull(), F.raise_error(wrong).cast("boolean")).otherwise(True)).select(*_names())
    if unique and (twice := duplicate_ids(df).limit(1).collect()):
        raise ValueError(f"duplicate id: {twice[0]['id']}")
    return df


def write_jsonl(df: DataFrame, path: str) -> int:
    """Writes records without nulls and defaults (empty spans, empty meta); returns how many."""
    out = df.select(*_names()).withColumn("spans", F.when(F.size("spans") > 0, F.col("spans"))).withColumn("meta", F.when(F.size("meta") > 0, F.col("meta")))
    out.write.mode("errorifexists").json(path, ignoreNullFields=True)
    return df.sparkSession.read.text(path).count()


def _names() -> list[str]:
    from .schema import RECORD

    return RECORD.names


def read_text_folder(spark: SparkSession, folder: str, label: str, source: str, prefix: str = "", family: str | None = None) -> DataFrame:
    """One record per *.txt file: id and group are prefix + stem, the text is stripped, blank files are skipped. Order is the caller's: sort by id."""
    raw = spark.read.text(f"{folder}/*.txt", wholetext=True).select(F.col("_metadata.file_name").alias("name"), tx.strip(F.col("value")).alias("text"))
    stem = F.concat(F.lit(prefix), F.regexp_replace("name", r"\.txt$", ""))
    gen = F.when(F.lit(label != "human"), F.from_json(F.to_json(F.struct(F.lit(family or "unknown").alias("model_family"), F.lit("unknown").alias("model_name"))), GENERATION))
    return _record(raw.where("text <> ''"), id=stem, text=F.col("text"), label=F.lit(label), source=F.lit(source), group_id=stem, generation=gen)


def _record(df: DataFrame, **c: Column) -> DataFrame:
    none = {"spans": F.array().cast(f"array<{SPAN}>"), "generation": F.lit(None).cast(GENERATION), "transform": F.lit(None).cast(TRANSFORM), "split": F.lit(None).cast("string"), "meta": F.create_map().cast("map<string,string>")}
    every = none | c
    return df.select(*[every[k].alias(k) for k in _names()])


@dataclass
class FieldMap:
    """How the fields of foreign JSON lines become a record. Exactly one of label and label_field; label_field needs label_map."""

    text: str
    source: str
    label: str | None = None
    label_field: str | None = None
    label_map: dict[str, str] = field(default_factory=dict)
    id: str | None = None
    group: str | None = None
    family: str | None = None
    model: str | None = None
    temperature: str | None = None

    def __post_init__(self):
        if (self.label is None) == (self.label_field is None) or (self.label_field and not self.label_map):
            raise ValueError("give either label, or label_field with label_map")


def read_field_map(spark: SparkSession, path: str, m: FieldMap) -> DataFrame:
    """Records of foreign JSON lines. A label outside label_map is an error that names its line; ids fall back to stem-line, groups to ids."""
    rows = _lines(spark, path).where(F.regexp_like("line", F.lit(rf"[^{tx.SPACE}]")))
    get = lambda f: F.get_json_object("line", f"$.{f}") if f else F.lit(None).cast("string")
    text = tx.strip(get(m.text))
    raw = get(m.label_field)
    label = F.lit(m.label) if m.label else F.coalesce(*[F.when(raw == k, v) for k, v in m.label_map.items()], F.raise_error(F.concat(F.lit("unmapped label at "), "path", F.lit(":"), F.col("line_no").cast("string"), F.lit(": "), F.coalesce(raw, F.lit("null")))).cast("string"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    ident = F.coalesce(get(m.id), F.concat(stem, F.lit("-"), F.col("line_no").cast("string")))
    out = rows.select(ident.alias("id"), text.alias("text"), label.alias("label"), F.coalesce(get(m.group), ident).alias("group_id"), F.coalesce(get(m.family), F.lit("unknown")).alias("f"), F.coalesce(get(m.model), F.lit("unknown")).alias("n"), get(m.temperature).cast("double").alias("t")).where("text <> ''")
    gen = F.when(F.col("label") != "human", F.struct(F.col("f").alias("model_family"), F.col("n").alias("model_name"), F.lit(None).cast("string").alias("provider"), F.col("t").alias("temperature"), F.lit(None).cast("double").alias("top_p"), F.lit(None).cast("string").alias("prompt_id"), F.lit(None).cast("string").alias("prompt_summary")))
    return _record(out, id=F.col("id"), text=F.col("text"), label=F.col("label"), source=F.lit(m.source), group_id=F.col("group_id"), generation=gen)


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """(text, label, src) of a CSV with a header: the first column stripped and without a byte order mark, short rows left out."""
    df = spark.read.schema("text string, label string, src string").csv(path, header=True, multiLine=True, quote='"', escape='"', encoding="UTF-8", enforceSchema=True, mode="PERMISSIVE")
    return df.where("src is not null").select(tx.strip(F.regexp_replace("text", "﻿", "")).alias("text"), "label", "src")


def usable(text: Column, least: int = 200, most: int = 4000, sentences: int = 3) -> Column:
    """A stripped length between the bounds and enough sentences."""
    t = tx.strip(text)
    return F.length(t).between(least, most) & (F.size(tx.sentences(t)) >= sentences)


def read_answer_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(id, human, ai): the first usable answer of each side; the id falls back to the 0-based line."""
    rows = _lines(spark, path).where("trim(line) <> ''").select("line_no", F.from_json("line", "id string, human_answers array<string>, chatgpt_answers array<string>").alias("r"))
    pick = lambda c: F.get(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda t: usable(t)), F.lit(0))
    return rows.select(F.coalesce("r.id", (F.col("line_no") - 1).cast("string")).alias("id"), pick("r.human_answers").alias("human"), pick("r.chatgpt_answers").alias("ai")).where("human is not null and ai is not null")


#: Patterns of raw model names and their families; the first that is found counts.
FAMILIES = [(r"davinci|gpt-3\.5|trubo|turbo", "gpt-3.5"), (r"glm", "glm"), (r"llama|^_?(7|13|30|65)b", "llama"), (r"flan_t5", "flan-t5"), (r"opt", "opt"), (r"gpt_j|gpt_neox|neox", "eleutherai"), (r"bloom|t0", "bigscience")]


def model_family(raw: Column) -> Column:
    out = F.lit("other")
    for pattern, name in reversed(FAMILIES):
        out = F.when(F.regexp_like(F.lower(raw), F.lit(pattern)), name).otherwise(out)
    return F.when(raw.isNotNull(), out)


#: Fixed value: the form of source names of machine text.
SOURCE_NAME = r"^([a-z0-9_]+?)_machine_[a-z]+_(.+)"


def parse_src(src: Column) -> Column:
    """struct<domain, model>: model is null for human text and 'unknown' where the name has no known form."""
    form = SOURCE_NAME
    human, machine = F.endswith(src, F.lit("_human")), F.regexp_like(src, F.lit(form))
    return F.struct(
        F.when(human, F.regexp_replace(src, "_human$", "")).when(machine, F.regexp_extract(src, form, 1)).otherwise(src).alias("domain"),
        F.when(human, F.lit(None).cast("string")).when(machine, F.regexp_extract(src, form, 2)).otherwise("unknown").alias("model"))


def merge(*corpora: DataFrame) -> DataFrame:
    """The union of corpora by column name; ids are not checked here."""
    out = corpora[0]
    for c in corpora[1:]:
        out = out.unionByName(c)
    return out
