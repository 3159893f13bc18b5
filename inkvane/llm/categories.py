"""Category values as people write them, brought to one form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words for the three splits.
SPLIT_WORDS = {
    "train": ("train", "training", "trn"),
    "val": ("val", "valid", "validation", "dev", "development"),
    "test": ("test", "testing", "tst", "eval", "evaluation"),
}


def plain(c: Column) -> Column:
    """Without surrounding white space (any Unicode blank), in lower case; blank becomes null."""
    s = F.lower(F.regexp_replace(c, r"^[\s\p{Z}\x{200B}\x{FEFF}]+|[\s\p{Z}\x{200B}\x{FEFF}]+$", ""))
    return F.when(s != "", s)


def split_name(c: Column) -> Column:
    """train, val or test for any of the words for it; null for null and for other words."""
    s = plain(c)
    out = F.lit(None).cast("string")
    for name, words in SPLIT_WORDS.items():
        out = F.when(s.isin(*words), F.lit(name)).otherwise(out)
    return out


def group_key(c: Column) -> Column:
    """Group ids that differ in case, surrounding blanks or the sign between their parts become equal."""
    return F.regexp_replace(plain(c), r"[^\p{L}\p{M}\p{N}]+", "-")


def latest(c: Column, when: Column) -> Column:
    """Aggregate: the value delivered last among the rows that have one."""
    return F.max_by(c, F.when(c.isNotNull(), F.struct(when, c)))


def distinct_records(df: DataFrame, values: dict[str, Column], key: str = "id", when: str = "loaded_at") -> DataFrame:
    """One row per non-null id with the given values, each from the last delivery that has it."""
    time = F.col(when) if when in df.columns else F.lit(0)
    return df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("id")).agg(*[latest(c, time).alias(n) for n, c in values.items()])
