"""Fields that are added, removed, renamed or retyped between the capture files of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.plans.common import DML, lookup_join, materialize, spread

KINDS = ("whole", "fraction", "text", "flag", "list", "object")
#: Registered column types (codes) by the kind of value they hold.
REGISTERED_KINDS = {
    "whole": (1, 2, 3, 4, 5, 6, 7, 8, 17),
    "fraction": (9, 10, 11, 12),
    "flag": (29,),
}
_FILE = ["table_id", "log_offset"]


def cells(captures: DataFrame) -> DataFrame:
    """The filled fields of readable rows: table_id, log_offset, row_key, file_id, row_no, field, kind, text.

    Only DML rows with a position, a table and a JSON object as payload count. A value keeps its raw text (lists without blanks between parts)
    and the kind it is written as: whole, fraction, text, flag, list or object. Nulls, written out or left out, fill nothing. A payload
    with a field twice is unreadable. A field inside an object belongs to that object's value.
    """
    rows = captures.filter(F.col("rec_type").isin(*DML) & F.col("log_offset").isNotNull() & F.col("table_meta_id").isNotNull())
    rows = spread(rows.select(F.shiftright("table_meta_id", 16).alias("table_id"), "log_offset", "row_key", "file_id", "row_no", "payload"))
    parsed = rows.withColumn("parsed", F.expr("try_parse_json(payload)"))
    each = parsed.lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("parsed").outer())).drop("parsed").filter(F.col("key").isNotNull())
    each = each.withColumn("shape", F.schema_of_variant("value")).filter(F.col("shape") != "VOID")
    shape, number = F.col("shape"), F.col("shape").startswith("DECIMAL") | F.col("shape").isin("DOUBLE", "FLOAT")
    kind = (
        F.when(shape == "BIGINT", "whole").when(number, "fraction").when(shape == "BOOLEAN", "flag")
        .when(shape.startswith("ARRAY"), "list").when(shape.startswith("OBJECT"), "object").otherwise("text")
    )
    # only numbers that may be fractions lose their raw text in a variant, so only for them it is read from the payload
    raw = F.element_at(F.from_json("payload", "map<string, string>"), F.col("key"))
    text = F.when(number, F.coalesce(raw, F.expr("cast(value as string)"))).otherwise(F.expr("cast(value as string)"))
    each = each.select("table_id", "log_offset", "row_key", "file_id", "row_no", F.col("key").alias("field"), kind.alias("kind"), text.alias("text"))
    return each.withColumn("kind", F.when((F.col("kind") == "fraction") & F.col("text").rlike("^-?[0-9]+$"), "whole").otherwise(F.col("kind")))


def field_statistics(values: DataFrame) -> DataFrame:
    """Each field of each file with the kind of most of its values: table_id, log_offset, field, kind, n_values, n_of_kind. Ties fall to the later kind by name."""
    counted = values.groupBy(*_FILE, "field").agg(*(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS))
    most = F.greatest(*(F.struct(F.col(f"n_{k}").alias("n"), F.lit(k).alias("kind")) for k in KINDS))
    return counted.select(*_FILE, "field", most["kind"].alias("kind"), sum((F.col(f"n_{k}") for k in KINDS), F.lit(0)).alias("n_values"), most["n"].alias("n_of_kind"))


def _neighbours(stats: DataFrame) -> DataFrame:
    """Each file with the one before and the one after it of its table (null at the ends). Holds one row for each file, not its rows."""
    order = W.partitionBy("table_id").orderBy("log_offset")
    return stats.select(*_FILE).distinct().select(*_FILE, F.lag("log_offset").over(order).alias("before"), F.lead("log_offset").over(order).alias("next"))


def _renames(values: DataFrame, diff: DataFrame) -> DataFrame:
    """Pairs of a new and a vanished field that hold the same text for most row keys filled in both: table_id, at, field, old_field.

    ``diff``: the fields that a file has and the one ``before`` it doesn't (old_kind is null), or the other way round (kind is null).
    """
    lone = diff.filter(F.col("kind").isNull() | F.col("old_kind").isNull())
    both = lone.groupBy("table_id", "at").agg(F.max(F.col("kind").isNull()).alias("_lost"), F.max(F.col("old_kind").isNull()).alias("_won")).filter("_lost and _won")
    is_new = F.col("old_kind").isNull()
    roles = lone.join(both, ["table_id", "at"], "left_semi").select("table_id", "at", "field", is_new.alias("is_new"), F.when(is_new, F.col("at")).otherwise(F.col("before")).alias("log_offset"))
    roles = materialize(roles, "roles")  # as many as changes; a field of a file has two at most
    told = lookup_join(values.filter(F.col("row_key").isNotNull()), roles, [*_FILE, "field"], "inner", F.col("row_key"))
    one = told.groupBy("table_id", "at", "row_key", "field", "is_new").agg(F.max(F.struct("file_id", "row_no", "text"))["text"].alias("text"))
    one = materialize(one, "renamable")
    new, old = one.filter("is_new").drop("is_new"), one.filter("not is_new").drop("is_new").withColumnRenamed("field", "old_field")
    pair = ["table_id", "at", "field", "old_field"]
    same = new.join(old, ["table_id", "at", "row_key", "text"]).groupBy(*pair).agg(F.count(F.lit(1)).alias("n_same"))
    # only pairs with a value in common are counted further
    filled = new.drop("text").join(same, ["table_id", "at", "field"]).join(old.drop("text"), ["table_id", "at", "row_key", "old_field"])
    scored = filled.groupBy(*pair).agg(F.first("n_same").alias("n_same"), F.count(F.lit(1)).alias("n_both")).filter(F.col("n_same") * 2 > F.col("n_both"))
    best = [F.desc(F.col("n_same") / F.col("n_both")), F.desc("n_same")]
    scored = scored.withColumn("_a", F.row_number().over(W.partitionBy("table_id", "at", "field").orderBy(*best, "old_field")))
    scored = scored.withColumn("_b", F.row_number().over(W.partitionBy("table_id", "at", "old_field").orderBy(*best, "field")))
    return scored.filter("_a = 1 and _b = 1").select(*pair)


def field_changes(captures: DataFrame) -> DataFrame:
    """The list of changes: table_id, log_offset (of the later file), field, change (added, removed, renamed, retyped), old_field, kind, old_kind.

    Files of a table with one log_offset are one file, compared with the one before by log_offset; files without a readable
    row don't count. A field is in a file if any value of it is filled. A new field is a renamed one if it equals the vanished field, as text, for more
    than half of the row keys filled in both; where several pairs qualify, a pair is taken that is the best for both. Row keys
    that are null can't show a rename; of several rows with one key the last (file_id, row_no) counts. The first file of a table changes nothing.
    """
    values = materialize(cells(captures), "cells")
    stats = materialize(field_statistics(values), "fields")
    # a field counts for its own file and for the one after it; the first file of a table has none before it
    told = lookup_join(stats, _neighbours(stats), _FILE, "inner", F.col("field"))
    own = F.when(F.col("before").isNotNull(), F.struct(F.col("log_offset").alias("at"), F.col("before"), F.col("kind"), F.lit(None).cast("string").alias("old_kind")))
    later = F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("at"), F.col("log_offset").alias("before"), F.lit(None).cast("string").alias("kind"), F.col("kind").alias("old_kind")))
    sides = told.select("table_id", "field", F.inline(F.array_compact(F.array(own, later))))
    diff = sides.groupBy("table_id", "at", "before", "field").agg(F.max("kind").alias("kind"), F.max("old_kind").alias("old_kind"))
    diff = materialize(diff.filter(~F.col("kind").eqNullSafe(F.col("old_kind"))), "differences")
    added, removed = diff.filter(F.col("old_kind").isNull()), diff.filter(F.col("kind").isNull())
    renames = materialize(_renames(values, diff), "renames")
    renamed = renames.join(added.select("table_id", "at", "field", "kind"), ["table_id", "at", "field"]).join(removed.select("table_id", "at", F.col("field").alias("old_field"), "old_kind"), ["table_id", "at", "old_field"])
    shape = lambda rows, change, old: rows.select("table_id", F.col("at").alias("log_offset"), "field", F.lit(change).alias("change"), old.alias("old_field"), "kind", "old_kind")
    none = F.lit(None).cast("string")
    return (
        shape(added.join(renames, ["table_id", "at", "field"], "left_anti"), "added", none)
        .unionAll(shape(removed.join(renames.select("table_id", "at", F.col("old_field").alias("field")), ["table_id", "at", "field"], "left_anti"), "removed", none))
        .unionAll(shape(renamed, "renamed", F.col("old_field")))
        .unionAll(shape(renamed.filter(F.col("kind") != F.col("old_kind")), "retyped", F.col("old_field")))
        .unionAll(shape(diff.filter(F.col("kind").isNotNull() & F.col("old_kind").isNotNull()), "retyped", none))
    )


def latest_names(changes: DataFrame) -> DataFrame:
    """For every name a field had before a rename, the name it has now: table_id, field, until (offset of the rename), name.

    Follows chains of renames table by table over the renames only, which are as many as schema edits, not rows.
    """

    def follow(pdf):
        pdf = pdf.sort_values("log_offset", ascending=False)
        out, later = [], {}
        for at, new, old in zip(pdf["log_offset"], pdf["field"], pdf["old_field"], strict=True):
            later[old] = later.get(new, new)
            later.pop(new, None)
            out.append((pdf["table_id"].iloc[0], old, at, later[old]))
        import pandas as pd

        return pd.DataFrame(out, columns=["table_id", "field", "until", "name"])

    renamed = changes.filter(F.col("change") == "renamed").select("table_id", "log_offset", "field", "old_field")
    return renamed.groupBy("table_id").applyInPandas(follow, "table_id bigint, field string, until bigint, name string")


def consistent_values(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """All filled fields under one name and one type for each table: table_id, log_offset, row_key, file_id, row_no, name, kind, whole, fraction, flag,
    items, text, cast_failed.

    A field goes by its latest name (renames before which a file lies are followed); its type is the kind of most of its values over all files.
    A value that can't be cast to that kind keeps its raw text and is marked cast_failed.
    """
    values = materialize(cells(captures), "values")
    names = latest_names(changes)
    earliest = F.min(F.struct("until", "name"))
    moved = values.select("table_id", "log_offset", "field").distinct().join(names, ["table_id", "field"]).filter(F.col("log_offset") < F.col("until"))
    moved = moved.groupBy("table_id", "log_offset", "field").agg(earliest["name"].alias("name"))
    named = values.join(moved, ["table_id", "log_offset", "field"], "left").withColumn("name", F.coalesce("name", "field"))
    counted = named.groupBy("table_id", "name", "kind").agg(F.count(F.lit(1)).alias("n"))
    target = counted.groupBy("table_id", "name").agg(F.max(F.struct("n", "kind"))["kind"].alias("target"))
    typed = named.join(target, ["table_id", "name"])
    cast = lambda kind, value: F.when(F.col("target") == kind, value)
    typed = typed.select(
        "table_id", "log_offset", "row_key", "file_id", "row_no", "name", F.col("target").alias("kind"),
        cast("whole", F.expr("try_cast(text as bigint)")).alias("whole"),
        cast("fraction", F.expr("try_cast(text as double)")).alias("fraction"),
        cast("flag", F.expr("try_cast(text as boolean)")).alias("flag"),
        cast("list", F.when(F.col("kind") == "list", F.from_json("text", "array<string>"))).alias("items"),
        "text",
    )
    done = F.coalesce(F.col("whole").isNotNull(), F.lit(False)) | F.col("fraction").isNotNull() | F.col("flag").isNotNull() | F.col("items").isNotNull() | F.col("kind").isin("text", "object")
    return typed.withColumn("cast_failed", ~done)


def consistent_rows(values: DataFrame) -> DataFrame:
    """consistent_values() with one row for each row read: table_id, log_offset, file_id, row_no, row_key and its fields by latest name in a map for each
    type (whole, fraction, flag, items, text; objects are text), with the names whose values couldn't be cast in ``failed``.

    Several fields of a row under one name leave the last by text. A row is bounded by the fields of its payload.
    """
    row = ["table_id", "log_offset", "file_id", "row_no", "row_key"]
    one = values.groupBy(*row, "name", "kind").agg(F.max(F.struct("text", "whole", "fraction", "flag", "items", "cast_failed")).alias("v"))
    held = {"whole": "whole", "fraction": "fraction", "flag": "flag", "list": "items"}
    entry = lambda of, ok: F.when(ok & ~F.col("v.cast_failed"), F.struct(F.col("name"), F.col(f"v.{of}").alias("value")))
    maps = [F.map_from_entries(F.collect_list(entry(of, F.col("kind") == k))).alias(of) for k, of in held.items()]
    maps.append(F.map_from_entries(F.collect_list(entry("text", F.col("kind").isin("text", "object")))).alias("text"))
    return one.groupBy(*row).agg(*maps, F.array_sort(F.collect_list(F.when(F.col("v.cast_failed"), F.col("name")))).alias("failed"))


def consistent_table(values: DataFrame, table_id: int) -> DataFrame:
    """One captured table as a table: log_offset, file_id, row_no, row_key and a typed column for each field by its latest name, in order of name.

    A value that couldn't be cast is null. A field named like one of the four gets a ``_`` behind its name. The driver holds the names of the table's fields.
    """
    own = values.filter(F.col("table_id") == table_id)
    held = {"whole": "whole", "fraction": "fraction", "flag": "flag", "list": "items"}
    fields = own.groupBy("name").agg(F.first("kind").alias("kind")).orderBy("name").collect()
    fixed = ["log_offset", "file_id", "row_no", "row_key"]
    columns = [F.col(held.get(f.kind, "text"))[f.name].alias(f.name + "_" * (f.name in fixed)) for f in fields]
    return consistent_rows(own).select(*fixed, *columns)


def registry_differences(captures: DataFrame, registered: DataFrame) -> DataFrame:
    """Where files disagree with the registered columns of their version: table_meta_id, log_offset, field, kind, registered_kind, difference
    (unregistered, missing, other_kind).

    Versions without any registered column are left out; a registered column is missing when a file has no value of it.
    """
    code = F.col("col_type")
    kind = F.when(code.isin(*REGISTERED_KINDS["whole"]), "whole").when(code.isin(*REGISTERED_KINDS["fraction"]), "fraction").when(code.isin(*REGISTERED_KINDS["flag"]), "flag").otherwise("text")
    known = registered.filter(F.col("column_name").isNotNull()).select("table_meta_id", F.col("column_name").alias("field"), kind.alias("registered_kind")).groupBy("table_meta_id", "field").agg(F.max("registered_kind").alias("registered_kind"))
    of_version = captures.select((F.shiftright("table_meta_id", 16)).alias("table_id"), "log_offset", "table_meta_id").filter(F.col("log_offset").isNotNull()).distinct()
    stats = field_statistics(cells(captures)).join(of_version, _FILE).join(known.select("table_meta_id").distinct(), "table_meta_id", "left_semi")
    want = stats.select("table_meta_id", "log_offset").distinct().join(known, "table_meta_id")
    both = stats.select("table_meta_id", "log_offset", "field", "kind").join(want, ["table_meta_id", "log_offset", "field"], "full")
    difference = F.when(F.col("registered_kind").isNull(), "unregistered").when(F.col("kind").isNull(), "missing").when(F.col("kind") != F.col("registered_kind"), "other_kind")
    return both.withColumn("difference", difference).filter(F.col("difference").isNotNull())
