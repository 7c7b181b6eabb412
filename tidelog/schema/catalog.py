"""A logged catalog of table versions as a DataFrame: cleaning, lookups by position, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.references import epoch_at
from tidelog.plans.common import lookup_join, materialize


def registry(catalog: DataFrame) -> DataFrame:
    """One row for each version, repeated rows merged, with its end: table_meta_id, table_id, version, db, tbl (lower case), start_offset, end_offset, is_drop."""
    rows = catalog.dropna(subset=["table_meta_id", "table_id", "start_offset"]).groupBy("table_meta_id", "table_id", "version", "start_offset")
    rows = rows.agg(F.max(F.lower("db")).alias("db"), F.max(F.lower("tbl")).alias("tbl"), F.min(F.col("columns_json").isNull()).alias("is_drop"))
    following = F.lead("start_offset").over(W.partitionBy("table_id").orderBy("start_offset", "version"))
    return rows.withColumn("end_offset", following)


def version_at(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each message with the version of its table in force at its position: log_offset, table_id, in_force (table_meta_id; null before the first and after a drop)."""
    versions = registry(catalog).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("start_offset", "version", "table_meta_id", "is_drop"))).alias("versions"))
    versions = materialize(versions.withColumn("starts", F.transform("versions", lambda v: v["start_offset"])), "versions")  # a table has 65,536 versions at most
    most = versions.agg(F.max(F.size("starts"))).first()[0] or 0
    rows = log.filter(F.col("table_meta_id").isNotNull()).select("log_offset", F.shiftright("table_meta_id", 16).alias("table_id"))
    joined = lookup_join(rows, versions, ["table_id"], "left", F.col("log_offset"))
    held = F.get("versions", epoch_at(F.col("starts"), F.col("log_offset"), most) - 1)
    return joined.withColumn("_v", held).select("log_offset", "table_id", F.when(~F.col("_v.is_drop"), F.col("_v.table_meta_id")).alias("in_force"))


def columns_of(catalog: DataFrame) -> DataFrame:
    """The columns of each version: table_id, version, name, type, position."""
    parsed = F.from_json("columns_json", "array<struct<name: string, type: string>>")
    rows = catalog.filter(F.col("columns_json").isNotNull()).groupBy("table_id", "version").agg(F.max("columns_json").alias("columns_json"))
    return rows.select("table_id", "version", F.posexplode(parsed).alias("position", "c")).select("table_id", "version", F.col("c.name").alias("name"), F.col("c.type").alias("type"), "position")


def version_differences(catalog: DataFrame) -> DataFrame:
    """Columns that differ between a version and the one before it: table_id, version, name, change (added, removed, retyped)."""
    versions = catalog.filter(F.col("table_id").isNotNull() & F.col("version").isNotNull()).select("table_id", "version").distinct()
    after = versions.withColumn("next", F.lead("version").over(W.partitionBy("table_id").orderBy("version"))).filter(F.col("next").isNotNull())
    columns = columns_of(catalog)
    was = columns.join(after, ["table_id", "version"]).select("table_id", F.col("next").alias("version"), "name", F.col("type").alias("old_type"))
    now = columns.join(after.select("table_id", F.col("next").alias("version")), ["table_id", "version"]).select("table_id", "version", "name", "type")
    both = now.join(was, ["table_id", "version", "name"], "full")
    change = F.when(F.col("old_type").isNull(), "added").when(F.col("type").isNull(), "removed").when(F.col("type") != F.col("old_type"), "retyped")
    return both.withColumn("change", change).filter(F.col("change").isNotNull()).select("table_id", "version", "name", "change")


def purge(catalog: DataFrame, offset: int) -> DataFrame:
    """The versions still needed from ``offset`` on: those that end after it."""
    return registry(catalog).filter(F.col("end_offset").isNull() | (F.col("end_offset") > offset)).filter(~(F.col("is_drop") & F.col("end_offset").isNull() & (F.col("start_offset") <= offset)))


def information_schema(catalog: DataFrame) -> DataFrame:
    """The catalog as a table of tables: id, version, checkpoint, schema, table, is_current."""
    r = registry(catalog)
    return r.select(F.col("table_meta_id").alias("id"), "version", F.col("start_offset").alias("checkpoint"), F.col("db").alias("schema"), F.col("tbl").alias("table"), (F.col("end_offset").isNull() & ~F.col("is_drop")).alias("is_current"))
