"""Windows over a stream of records: tumbling, sliding and session, by time or by number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.plans.common import materialize


def _with_bounds(df: DataFrame) -> DataFrame:
    rest = [c for c in df.columns if c != "window"]
    return df.select(F.col("window.start").alias("starts"), F.col("window.end").alias("ends"), *rest)


def tumbling(df: DataFrame, time: str, size: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Aggregates of windows [starts, ends) of ``size`` that follow one another; rows without time fall in none."""
    return _with_bounds(df.groupBy(F.window(time, size), *keys).agg(*aggs))


def sliding(df: DataFrame, time: str, size: str, every: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Windows of ``size`` that begin ``every`` so often; a row is in each that holds its time."""
    return _with_bounds(df.groupBy(F.window(time, size, every), *keys).agg(*aggs))


def session(df: DataFrame, time: str, gap: str, keys: list[str], aggs: list[Column]) -> DataFrame:
    """Runs of rows of a key less than or just ``gap`` apart."""
    out = df.groupBy(F.session_window(time, gap).alias("window"), *keys).agg(*aggs)
    return _with_bounds(out)


def running(df: DataFrame, order: list[str], keys: list[str], value: Column, name: str, parts: int | None = None, greatest: bool = False) -> DataFrame:
    """Rows with the sum (or ``greatest``) of ``value`` (a whole number) over the rows of their key before them in ``order``, as ``name``; no key is gathered in one task.

    Rows are range-partitioned by key and order and summed inside; what the key has in earlier partitions is added from one sum for each
    partition and key. The order must be total within a key. Without rows before it a row has 0 (null with ``greatest``).
    """
    ranged = df.repartitionByRange(*([parts] if parts else []), *keys, *order).withColumn("_part", F.spark_partition_id()).withColumn("_value", value.cast("long"))
    ranged = materialize(ranged, "ranged")
    over_parts = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    fold, nothing = (F.max, F.lit(None).cast("long")) if greatest else (F.sum, F.lit(0))
    sums = ranged.groupBy(*keys, "_part").agg(fold("_value").alias("_sum")).withColumn("_before", F.coalesce(fold("_sum").over(over_parts), nothing))
    sums = sums.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_part").alias("_p"), "_before")
    inside = W.partitionBy("_part", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = ranged.withColumn("_local", F.coalesce(fold("_value").over(inside), nothing))
    on = F.col("_part") == F.col("_p")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = local.join(sums, on).withColumn(name, F.greatest("_before", "_local") if greatest else F.col("_before") + F.col("_local"))
    return joined.drop("_part", "_value", "_p", "_before", "_local", *(f"_{k}" for k in keys))


def numbered(df: DataFrame, order: list[str], keys: list[str], parts: int | None = None) -> DataFrame:
    """Rows numbered from 0 in ``order`` within their key (``ordinal``)."""
    return running(df, order, keys, F.lit(1), "ordinal", parts)


def with_previous(df: DataFrame, order: list[str], keys: list[str], column: str, name: str) -> DataFrame:
    """Rows with the value of ``column`` in the row before them of their key (null in the first): a join of each number with the one before."""
    rows = materialize(numbered(df, order, keys), "numbered")
    before = rows.select(*(F.col(k).alias(f"_{k}") for k in keys), (F.col("ordinal") + 1).alias("_ordinal"), F.col(column).alias(name))
    on = F.col("ordinal") == F.col("_ordinal")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(before, on, "left").drop("ordinal", "_ordinal", *(f"_{k}" for k in keys))


def count_tumbling(df: DataFrame, rows: int, order: list[str], keys: list[str], aggs: list[Column]) -> DataFrame:
    """Windows of ``rows`` rows that follow one another (``number`` from 0); the last of a key may be shorter."""
    n = numbered(df, order, keys).withColumn("number", F.floor(F.col("ordinal") / rows).cast("long"))
    return n.groupBy(*keys, "number").agg(*aggs)


def count_sliding(df: DataFrame, rows: int, every: int, order: list[str], keys: list[str], aggs: list[Column]) -> DataFrame:
    """Windows of ``rows`` rows that begin every ``every`` rows; those at the end of a key may be shorter."""
    n = numbered(df, order, keys)
    first = F.greatest(F.lit(0), F.floor((F.col("ordinal") - rows) / every) + 1).cast("long")
    last = F.floor(F.col("ordinal") / every).cast("long")
    return n.filter(first <= last).withColumn("number", F.explode(F.sequence(first, last))).groupBy(*keys, "number").agg(*aggs)
