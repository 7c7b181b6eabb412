"""References to catalog records that are missing, come later or were dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.plans.common import lookup_join, materialize


def catalog_epochs(catalog: DataFrame) -> DataFrame:
    """Distinct versions of the catalog with their place in the history of their table: table_id, table_meta_id, start_offset, epoch (from 1), is_drop.

    Versions of a table that start at one offset share an epoch, which is a drop if the last of them (by version) is one. Rows without
    table, id or start are no versions.
    """
    rows = catalog.dropna(subset=["table_id", "table_meta_id", "start_offset"])
    rows = rows.groupBy("table_id", "table_meta_id").agg(F.min("start_offset").alias("start_offset"), F.max("version").alias("version"), F.min(F.col("columns_json").isNull()).alias("is_drop"))
    order = W.partitionBy("table_id").orderBy("start_offset")
    rows = rows.withColumn("epoch", F.dense_rank().over(order))
    last = F.max(F.struct(F.coalesce("version", F.lit(-1)), "is_drop")).over(W.partitionBy("table_id", "epoch"))
    return rows.withColumn("epoch_dropped", last["is_drop"])


def epoch_at(starts: Column, position: Column, most: int) -> Column:
    """How many of the sorted ``starts`` (at most ``most``) are at or before ``position``: a binary search, so a table with many versions costs few steps."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(max(1, most).bit_length()))))
    further = lambda at, step: F.when(F.coalesce(F.get(starts, at + step - 1) <= position, F.lit(False)), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(0), further)


def orphan_references(references: DataFrame, catalog: DataFrame) -> DataFrame:
    """References (table_meta_id, log_offset and any further columns) to versions that aren't there at their position.

    A reference is an orphan if its version is not in the catalog, starts after it, or its table's last version by then marks a drop. A null
    reference refers to nothing and is no orphan. The table is ``table_meta_id >> 16``. References are reduced to distinct (key, epoch) pairs
    before the anti-join against the parents, and the orphans among these are joined back; the epoch is the number of versions of the table that
    had started, at most 65,536, as a version is the lower 16 bits of the id. A parent is there from its own epoch on, and a dropped epoch has none: as many
    parent rows as versions. Repeated references give repeated rows; an empty catalog makes every reference an orphan.
    """
    versions = materialize(catalog_epochs(catalog), "versions")
    starts = versions.groupBy("table_id").agg(F.array_sort(F.collect_set("start_offset")).alias("starts"))
    most = starts.agg(F.max(F.size("starts"))).first()[0] or 0
    rows = references.filter(F.col("table_meta_id").isNotNull()).withColumn("_table", F.shiftright("table_meta_id", 16))
    rows = lookup_join(rows, starts.withColumnRenamed("table_id", "_table"), ["_table"], "left", F.col("log_offset"))
    rows = rows.withColumn("_epoch", F.when(F.col("starts").isNull(), 0).otherwise(epoch_at(F.col("starts"), F.col("log_offset"), most))).drop("starts")
    keyed = materialize(rows, "references")  # read twice below
    keys = keyed.select("table_meta_id", "_table", "_epoch").distinct()
    parents = versions.groupBy("table_meta_id").agg(F.min("epoch").alias("_from"))
    dropped = versions.filter("epoch_dropped").select(F.col("table_id").alias("_table"), F.col("epoch").alias("_epoch"), F.lit(True).alias("_dropped")).distinct()
    there = keys.join(parents, "table_meta_id").filter("_from <= _epoch").join(dropped, ["_table", "_epoch"], "left_anti").select("table_meta_id", "_epoch")
    orphans = materialize(keys.join(there, ["table_meta_id", "_epoch"], "left_anti").select("table_meta_id", "_epoch"), "orphans")
    return lookup_join(keyed, orphans, ["table_meta_id", "_epoch"], "left_semi", F.col("log_offset")).drop("_epoch", "_table")


def orphan_counts(references: DataFrame, catalog: DataFrame, time: str = "ts") -> DataFrame:
    """Orphans for each table and day of ``time``: table_id, day, n_orphans, n_keys. References without time count under a null day."""
    orphans = orphan_references(references, catalog)
    return orphans.groupBy(F.shiftright("table_meta_id", 16).alias("table_id"), F.col(time).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("table_meta_id").alias("n_keys"))
