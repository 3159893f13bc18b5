"""Hashed splits that keep groups together, family holdout, leak check."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scorers import blake2_unit


def group_units(df: DataFrame, group: str = "group_id", seed: int = 0) -> DataFrame:
    """(group, u): the hash of "seed:group" in [0, 1) for each distinct group. The groups are hashed once each, not once a row."""

    @F.pandas_udf("double")
    def unit(g: pd.Series) -> pd.Series:
        return pd.Series([blake2_unit(f"{seed}:{x}") for x in g], dtype="float64")

    return df.where(F.col(group).isNotNull()).select(group).distinct().withColumn("u", unit(group))


def check_ratios(train: float, val: float, test: float) -> None:
    if min(train, val, test) < 0 or abs(train + val + test - 1.0) > 1e-9:
        raise ValueError("ratios must not be negative and must sum to 1")


def split_of(u: Column, train: float, val: float) -> Column:
    return F.when(u < train, "train").when(u < train + val, "val").otherwise("test")


def assign_splits(df: DataFrame, group: str = "group_id", train: float = 0.8, val: float = 0.0, test: float = 0.2, seed: int = 0) -> DataFrame:
    """df with `split` set from its group's hash; rows without a group get no split."""
    check_ratios(train, val, test)
    u = group_units(df, group, seed)
    out = df.drop("split").join(u, group, "left")
    return out.withColumn("split", F.when(F.col("u").isNotNull(), split_of(F.col("u"), train, val))).drop("u")


def family_holdout(df: DataFrame, families: list[str], group: str = "group_id", label: str = "label", family: str = "model_family", seed: int = 0, human_test: float = 0.3) -> DataFrame:
    """df with `split`: records of the held-out families in test, other ai and mixed ones in train, humans by their group's hash.

    A group with a human and a held-out ai record stands in both; leaks() finds it.
    """
    u = group_units(df.where(F.col(label) == "human"), group, seed)
    out = df.drop("split").join(u, group, "left")
    human = F.when(F.col("u") < human_test, "test").otherwise("train")
    return out.withColumn("split", F.when(F.col(label) == "human", human).when(F.coalesce(F.col(family), F.lit("")).isin(families), "test").otherwise("train")).drop("u")


def leaks(df: DataFrame, group: str = "group_id", split: str = "split") -> DataFrame:
    """(group, splits, n_splits) of each group in more than one split; null is no split."""
    known = df.where(F.col(split).isNotNull() & F.col(group).isNotNull())
    per = known.groupBy(group).agg(F.array_join(F.sort_array(F.collect_set(split)), ",").alias("splits"), F.count_distinct(split).alias("n_splits"))
    return per.where("n_splits > 1")
