"""Queries of the text operators. SQL can't measure tokens, align words or fit grades: these are tested against brute force instead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import leakage, packing, reading
from tidelog.plans.common import table


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_kinds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"), only="standard")
    return packed.filter("n_pieces > 1").select("doc_id").distinct()


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_kinds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).filter("not paraphrase").select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each item leaked, and how much of it at most."""
    found = leakage.leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"), F.max("share").alias("largest_share"), F.count_if("answered").alias("n_with_answer"), F.count_if("paraphrase").alias("n_paraphrased"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


QUERIES = {f.__name__: f for f in (p7_found, p7_containers, p8_found, p8_leaked_items, p9_found)}
SQL: dict[str, str] = {}
