"""Row images of changes: values before and after, net changes, histories and states as of a position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.plans.common import DML


def image_columns(log: DataFrame) -> list[str]:
    """The columns of the row images of a log."""
    return log.schema["after_img"].dataType.fieldNames()


def old_value(column: str) -> Column:
    """The value before a change: of the old image if the column changed or there is no new image, else the new value."""
    use_old = F.col("after_img").isNull() | F.array_contains(F.col("changed"), column)
    return F.when(F.coalesce(use_old, F.lit(False)), F.col(f"before_img.{column}")).otherwise(F.col(f"after_img.{column}"))


def before_image(log: DataFrame, columns=None) -> DataFrame:
    """DML messages with their whole row before: log_offset and old_<column> for each column (None: all of the image). Inserts have no row before."""
    columns = columns or image_columns(log)
    dml = log.filter(F.col("rec_type").isin(1, 2, 3) & F.col("before_img").isNotNull())
    return dml.select("log_offset", *(old_value(c).alias(f"old_{c}") for c in columns))


def changed_columns(columns: list[str]) -> Column:
    """The columns in which two images differ, a null and a value differing."""
    return F.array_compact(F.array(*(F.when(~F.col(f"before_img.{c}").eqNullSafe(F.col(f"after_img.{c}")), c) for c in columns)))


def key_updated(keys: Column) -> Column:
    """Whether a change touches a column of the key (``keys``: array of names)."""
    return F.coalesce(F.arrays_overlap(F.col("changed"), keys), F.lit(False))


def _moved() -> Column:
    return (F.col("rec_type") == 1) & F.coalesce(F.length("old_key") > 0, F.lit(False)) & ~F.col("old_key").eqNullSafe(F.col("row_key"))


def net_changes(log: DataFrame, columns=None) -> DataFrame:
    """Each key's changes merged to one: table_id, row_key, n_changes, effect (insert, update, delete, none), and for each column (None: all of the
    image) its value before the first change (first_<column>) and after the last (last_<column>), null where there was or is no row.

    Moves of a key count as a delete of the old key and an insert of the new one. A row before a change is whole: columns that the change left alone are those of the row after it.
    """
    columns = columns or image_columns(log)
    dml = log.filter(F.col("rec_type").isin(*DML)).withColumn("table_id", F.shiftright("table_meta_id", 16))
    moved = _moved()
    was = F.when(F.col("before_img").isNotNull(), F.struct(*(old_value(c).alias(c) for c in columns)))
    now = F.when(F.col("after_img").isNotNull(), F.struct(*(F.col(f"after_img.{c}") for c in columns)))
    side = lambda key, was, now, had, has: F.struct(F.col(key).alias("key"), was.alias("was"), now.alias("now"), had.alias("had"), has.alias("has"))
    gone = side("old_key", was, F.when(F.lit(False), now), F.lit(True), F.lit(False))
    own = side("row_key", F.when(~moved, was), now, ~moved & F.col("rec_type").isin(1, 2), F.col("rec_type") != 2)
    parts = dml.select("table_id", "log_offset", F.explode(F.array_compact(F.array(F.when(moved, gone), own))).alias("p")).filter(F.col("p.key").isNotNull())
    ends = parts.groupBy("table_id", F.col("p.key").alias("row_key")).agg(
        F.min(F.struct("log_offset", "p.had", "p.was")).alias("first"), F.max(F.struct("log_offset", "p.has", "p.now")).alias("last"), F.count(F.lit(1)).alias("n_changes"),
    )
    effect = F.when(F.col("first.had"), F.when(F.col("last.has"), "update").otherwise("delete")).otherwise(F.when(F.col("last.has"), "insert").otherwise("none"))
    firsts = [F.when(F.col("first.had"), F.col(f"first.was.{c}")).alias(f"first_{c}") for c in columns]
    lasts = [F.when(F.col("last.has"), F.col(f"last.now.{c}")).alias(f"last_{c}") for c in columns]
    return ends.select("table_id", "row_key", *firsts, *lasts, "n_changes", effect.alias("effect"))


def latest_rows(log: DataFrame, columns=None, until: int | None = None) -> DataFrame:
    """The rows of each table as of ``until`` (None: the end) with their values: table_id, row_key, log_offset and the columns (None: all of the image).

    ``log`` holds the messages to count, committed ones as a rule.
    """
    columns = columns or image_columns(log)
    dml = log.filter(F.col("rec_type").isin(*DML)).withColumn("table_id", F.shiftright("table_meta_id", 16))
    if until is not None:
        dml = dml.filter(F.col("log_offset") <= until)
    moved = _moved()
    own = F.struct(F.col("row_key").alias("key"), (F.col("rec_type") != 2).alias("has"))
    parts = dml.select("table_id", "log_offset", "after_img", F.explode(F.array_compact(F.array(F.when(moved, F.struct(F.col("old_key").alias("key"), F.lit(False).alias("has"))), own))).alias("p")).filter(F.col("p.key").isNotNull())
    last = parts.groupBy("table_id", F.col("p.key").alias("row_key")).agg(F.max_by(F.struct("log_offset", "p.has", "after_img"), F.col("log_offset") * 2 + F.col("p.has").cast("int")).alias("r"))
    return last.filter(F.col("r.has")).select("table_id", "row_key", "r.log_offset", *(F.col(f"r.after_img.{c}").alias(c) for c in columns))
