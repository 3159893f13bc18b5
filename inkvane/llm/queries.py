"""The queries of the nine problems. Each is called with a session and a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import forms, mixing, overlaps, pieces, sampling, sentences, similarity, tokens, units


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.near_duplicate_pairs(read_table(spark, folder, "records"))


def p1_groups(spark: SparkSession, folder: str) -> DataFrame:
    return similarity.groups(read_table(spark, folder, "records"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return units.straddling(read_table(spark, folder, "records"))


def p2_assignment(spark: SparkSession, folder: str) -> DataFrame:
    return units.assign_splits(read_table(spark, folder, "records"), read_table(spark, folder, "split_targets"))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return units.split_report(p2_assignment(spark, folder), read_table(spark, folder, "split_targets"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return forms.same_form_pairs(read_table(spark, folder, "records"), shortest=similarity.SHORTEST)


def p3_forms(spark: SparkSession, folder: str) -> DataFrame:
    return forms.consistent_form(read_table(spark, folder, "records").select("row_no", "id", "text"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = overlaps.split_overlaps(read_table(spark, folder, "records"))
    return pairs.select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    records = read_table(spark, folder, "records")
    return overlaps.overlap_report(records, overlaps.split_overlaps(records))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    records = sampling.records_with_axes(read_table(spark, folder, "records"))
    return sampling.unmet(records, read_table(spark, folder, "sample_targets")).select("axis", "category")


def p5_sample(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.draw(read_table(spark, folder, "records"), read_table(spark, folder, "sample_targets"))


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.report(p5_sample(spark, folder), read_table(spark, folder, "sample_targets"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return sentences.split(read_table(spark, folder, "records")).withColumnRenamed("id", "record_id")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode(read_table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = mixing.sized(read_table(spark, folder, "documents"))
    supplied = mixing.supply(docs, read_table(spark, folder, "mix_targets"))
    return mixing.short(mixing.queue(docs, supplied), supplied).select("source")


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(mixing.sized(read_table(spark, folder, "documents")), read_table(spark, folder, "mix_targets"))


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    docs, targets = mixing.sized(read_table(spark, folder, "documents")), read_table(spark, folder, "mix_targets")
    return mixing.report(mixing.mix(docs, targets), mixing.supply(docs, targets))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_pieces(spark, folder).select("doc_id").distinct()


def p9_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.split(read_table(spark, folder, "documents"), read_table(spark, folder, "piece_limits"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit()}


def oracle_sql() -> dict:
    from . import sql

    return sql.oracle_sql()
