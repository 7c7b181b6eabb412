"""Plans for applying changes elsewhere: conflicts, order, statements and the position that is safe."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, NumericType, StringType, TimestampNTZType, TimestampType

from tidelog.functions.scalar import literal_text
from tidelog.operators.images import image_columns, old_value
from tidelog.operators.windows import running, with_previous
from tidelog.plans.common import DML, lookup_join, materialize

#: Column types (by name) whose values are too large to look rows up by.
LARGE = ("blob", "text", "json", "xml", "geometry", "byte", "binary")
#: Column types (by name) whose literals stand without quotes.
NUMBERS = r"^(u?int[0-9]*|tinyint|smallint|mediumint|bigint|big_number|float|double|decimal|year|bool)$"
#: Keys of the transactions of one segment of conflict_levels().
SEGMENT_KEYS = 100_000


def _by_version(unique: DataFrame) -> DataFrame:
    """The unique keys of each table version as one sorted list: table_meta_id, uniques."""
    return unique.groupBy("table_meta_id").agg(F.array_sort(F.collect_set("columns")).alias("uniques"))


def conflict_keys(log: DataFrame, unique: DataFrame | None = None) -> DataFrame:
    """The keys each DML message touches: txn_id, table_id, index, key. The row key, new and old, has the index "".

    ``unique`` has a row for each further unique key of a table version (table_meta_id, columns array<string>); its values are those of the
    new and of the old image, whatever columns these have. Nulls are values like any other, equal to one another.
    """
    dml = log.filter(F.col("rec_type").isin(*DML))
    table_id = F.shiftright("table_meta_id", 16).alias("table_id")
    own = F.array_distinct(F.array_compact(F.array(F.when(F.length("old_key") > 0, F.col("old_key")), F.col("row_key"))))
    keys = dml.select("txn_id", table_id, F.lit("").alias("index"), F.explode(own).alias("key"))
    if unique is None:
        return keys
    dml = dml.filter(F.col("table_meta_id").isNotNull()).select("txn_id", "log_offset", "table_meta_id", "rec_type", "changed", "before_img", "after_img")
    dml = lookup_join(dml, _by_version(unique), ["table_meta_id"], "inner", F.col("log_offset")).withColumn("columns", F.explode("uniques"))
    names = image_columns(log)

    def values(of) -> Column:
        by_name = F.create_map(*(x for c in names for x in (F.lit(c), of(c).cast("string"))))
        return F.to_json(F.transform("columns", lambda c: by_name[c]))

    new = F.when(F.col("after_img").isNotNull(), values(lambda c: F.col(f"after_img.{c}")))
    old = F.when((F.col("rec_type") != 0) & F.col("before_img").isNotNull(), values(lambda c: F.coalesce(F.col(f"before_img.{c}"), old_value(c))))
    return keys.unionAll(dml.select("txn_id", table_id, F.array_join("columns", ",").alias("index"), F.explode(F.array_distinct(F.array_compact(F.array(new, old)))).alias("key")))


def _places(log: DataFrame) -> DataFrame:
    """Where each transaction stands: at its last message."""
    return log.filter(F.col("txn_id").isNotNull()).groupBy("txn_id").agg(F.max("log_offset").alias("place"))


def conflict_edges(log: DataFrame, unique: DataFrame | None = None) -> DataFrame:
    """Pairs of transactions where the later must wait for the earlier: txn_id, after_txn.

    Two transactions conflict on a key both touch: the row key, and with ``unique`` each further unique key (see conflict_keys). Only neighbours in the order of each key are paired: a wait on any earlier one follows from these, and a
    key touched by every transaction gives one edge for each, not all pairs. A transaction stands where its last message does.
    """
    keys = conflict_keys(log.filter(F.col("txn_id").isNotNull()), unique).distinct().join(_places(log), "txn_id")
    edges = with_previous(keys, ["place", "txn_id"], ["table_id", "index", "key"], "txn_id", "after_txn")
    return edges.filter(F.col("after_txn").isNotNull()).select("txn_id", "after_txn").distinct()


def conflict_levels(log: DataFrame, unique: DataFrame | None = None, segment_keys: int = SEGMENT_KEYS) -> DataFrame:
    """When each transaction can be applied: txn_id, segment, level.

    Transactions stand where their last message does. In that order they are cut into segments of about ``segment_keys`` touched keys, which are applied one after
    the other; ``segment`` is the place of the first transaction in it. A transaction with more keys is a segment of its own. Within a segment a
    transaction's level is one more than the greatest level of an earlier one it shares a key of conflict_keys() with, so those of a level run side by side. One pass
    in order finds the levels of a segment, so no task holds more than two times ``segment_keys`` keys, however hot a key and however large a log file.
    """

    def walk(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["place", "txn_id"], kind="stable")
        reached: dict[int, int] = {}
        out = []
        for txn, keys in pdf.groupby("txn_id", sort=False)["key_hash"]:
            level = max((reached.get(k, -1) for k in keys), default=-1) + 1
            reached.update(dict.fromkeys(keys, level))
            out.append((txn, int(pdf["segment"].iloc[0]), level))
        return pd.DataFrame(out, columns=["txn_id", "segment", "level"])

    keys = conflict_keys(log.filter(F.col("txn_id").isNotNull()), unique).select("txn_id", F.xxhash64("table_id", "index", "key").alias("key_hash")).distinct()
    keys = materialize(keys, "keys")
    txns = keys.groupBy("txn_id").agg(F.count(F.lit(1)).alias("n")).join(_places(log), "txn_id").withColumn("alone", F.col("n") > segment_keys)
    # one running sum of both: keys of the transactions before, and in the upper bits how many of those stand alone
    step = F.when(F.col("alone"), F.lit(1 << 42)).otherwise(F.col("n"))
    block = [F.shiftright("_sum", 42).alias("_after"), F.floor((F.col("_sum") % (1 << 42)) / segment_keys).alias("_block"), "alone"]
    cut = materialize(running(txns, ["place", "txn_id"], [], step, "_sum").select("txn_id", "place", *block), "segments")
    starts = cut.groupBy("_after", "_block", "alone").agg(F.min("place").alias("segment"))
    placed = lookup_join(cut, starts, ["_after", "_block", "alone"], "inner", F.col("txn_id")).select("txn_id", "place", "alone", "segment")
    rows = keys.join(placed.filter("not alone"), "txn_id").select("txn_id", "key_hash", "place", "segment")
    levels = rows.groupBy("segment").applyInPandas(walk, "txn_id bigint, segment bigint, level bigint")
    return levels.unionAll(placed.filter("alone").select("txn_id", "segment", F.lit(0).cast("bigint")))


def ddl_segments(log: DataFrame) -> DataFrame:
    """The log cut at DDL messages of each table, which are barriers: log_offset, table_id, segment (DDLs of the table before the message)."""
    rows = log.filter(F.col("table_meta_id").isNotNull()).select("log_offset", F.shiftright("table_meta_id", 16).alias("table_id"), "rec_type")
    ddl = F.when(F.col("rec_type") == 4, 1).otherwise(0)
    return running(rows, ["log_offset"], ["table_id"], ddl, "segment").select("log_offset", "table_id", "segment")


def safe_checkpoint(log: DataFrame) -> DataFrame:
    """One row (position): up to here everything has ended; just before the first message of the oldest open transaction, else the end."""
    txns = log.filter(F.col("txn_id").isNotNull()).groupBy("txn_id").agg(F.min("log_offset").alias("first"), F.max(F.col("rec_type").isin(6, 7)).alias("ended"))
    oldest = txns.filter(~F.col("ended")).agg(F.min("first").alias("first"))
    return log.agg(F.max("log_offset").alias("end")).crossJoin(F.broadcast(oldest)).select(F.coalesce(F.col("first") - 1, F.col("end")).alias("position"))


def _kind(of: DataType) -> str:
    if isinstance(of, (NumericType, BooleanType)):
        return "number"
    return "bytes" if isinstance(of, BinaryType) else "time" if isinstance(of, (TimestampType, TimestampNTZType)) else "text"


def literals(log: DataFrame, image: str, types: Column | None = None) -> Column:
    """The values of an image as literals by column name, null where they are null: a map.

    An image is a struct, whose types tell how a literal is written, or a JSON text, for which ``types`` (a map of column names to type names) does.
    """
    of = log.schema[image].dataType
    if isinstance(of, StringType):
        text = lambda v: F.concat(F.lit("'"), F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''")), F.lit("'"))
        number = lambda c: F.coalesce(F.lower(types[c]).rlike(NUMBERS), F.lit(False)) if types is not None else F.lit(False)
        return F.transform_values(F.from_json(image, "map<string,string>"), lambda c, v: F.when(number(c), v).otherwise(text(v)))
    value = lambda f: F.when(F.col(f"{image}.{f.name}").isNotNull(), literal_text(F.col(f"{image}.{f.name}") if _kind(f.dataType) != "text" else F.col(f"{image}.{f.name}").cast("string"), _kind(f.dataType)))
    return F.when(F.col(image).isNotNull(), F.create_map(*(x for f in of.fields for x in (F.lit(f.name), value(f)))))


def where_columns(keys: Column, values: Column, uniques: Column | None = None, every: Column | None = None) -> Column:
    """The columns a WHERE uses: the key's if none of its ``values`` (see literals) is null, else those of the best such key of ``uniques`` (one of a single column, else the first), else ``every`` one."""
    every = F.map_keys(values) if every is None else every
    whole = lambda key: (F.size(key) > 0) & F.forall(key, lambda c: values[c].isNotNull())
    rest = every
    if uniques is not None:
        full = F.filter(uniques, whole)
        rest = F.coalesce(F.get(F.filter(full, lambda u: F.size(u) == 1), F.lit(0)), F.get(full, F.lit(0)), every)
    return F.when(F.coalesce(whole(keys), F.lit(False)), keys).otherwise(rest)


def statements(log: DataFrame, catalog: DataFrame, mapping: Mapping[str, str] | None = None, unique: DataFrame | None = None) -> DataFrame:
    """The SQL statement of each DML message with the images it needs: log_offset, statement (and txn_id where the log has it).

    A statement names the columns of the table's version, in its order, as far as the image has them; all of the image's where the version is not known.
    INSERT and REPLACE write the whole row (REPLACE as such), UPDATE the changed columns, DELETE the row. The WHERE names the key
    columns where the version of the table has any and all are filled, otherwise those of a filled key of ``unique`` (see conflict_keys), otherwise
    every column but those of LARGE types, with LIMIT 1. ``mapping`` renames target columns, in every clause. Images are structs or JSON texts (see literals).
    """
    shape = "array<struct<name: string, type: string>>"
    has = "columns_json" in catalog.columns
    versions = catalog.filter(F.col("table_meta_id").isNotNull()).groupBy("table_meta_id").agg(F.max("key_columns").alias("keys"), F.from_json(F.max("columns_json") if has else F.lit(None).cast("string"), shape).alias("fields"))
    versions = versions.withColumn("keys", F.filter(F.split("keys", ","), lambda k: F.length(k) > 0))
    rows = lookup_join(log.filter(F.col("rec_type").isin(*DML)), versions, ["table_meta_id"], "left", F.col("log_offset"))
    none = F.array().cast("array<string>")
    types = F.map_from_entries(F.array_distinct(F.coalesce("fields", F.array().cast(shape))))
    rows = rows.withColumns({"keys": F.coalesce("keys", none), "_before": literals(log, "before_img", types), "_after": literals(log, "after_img", types)})
    uniques = None
    if unique is not None:
        rows, uniques = lookup_join(rows, _by_version(unique), ["table_meta_id"], "left", F.col("log_offset")), F.coalesce("uniques", F.array().cast("array<array<string>>"))
    own = F.coalesce(F.map_keys(F.coalesce("_after", "_before")), none)
    listed = F.transform("fields", lambda f: f["name"])
    rows = rows.withColumn("_columns", F.when(F.size(F.array_intersect(listed, own)) > 0, F.filter(listed, lambda c: F.array_contains(own, c))).otherwise(own))
    # told by cheap tests: a test of the finished statement would be pushed below all these columns and make each of them several times
    kind, has, had = F.col("rec_type"), F.col("after_img").isNotNull(), F.col("before_img").isNotNull()
    told = (kind.isin(0, 3) & has) | ((kind == 1) & has & had & F.arrays_overlap("changed", "_columns")) | ((kind == 2) & had)
    rows = rows.filter(F.col("db").isNotNull() & F.col("tbl").isNotNull() & F.coalesce(told, F.lit(False)))
    large = F.coalesce(F.transform(F.filter("fields", lambda f: F.lower(f["type"]).isin(*LARGE)), lambda f: f["name"]), none)
    rows = rows.withColumn("_used", where_columns(F.col("keys"), F.col("_before"), uniques, F.array_except("_columns", large)))
    columns, used = F.col("_columns"), F.col("_used")
    names = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair)) if mapping else None
    quoted = lambda c: F.concat(F.lit("`"), F.coalesce(names[c], c) if names is not None else c, F.lit("`"))
    shown = lambda image, c: F.coalesce(F.col(image)[c], F.lit("NULL"))
    joined = lambda parts, glue: F.array_join(parts, glue)
    target = F.concat(F.lit("`"), F.col("db"), F.lit("`.`"), F.col("tbl"), F.lit("`"))
    test = lambda c: F.when(F.col("_before")[c].isNull(), F.concat(quoted(c), F.lit(" IS NULL"))).otherwise(F.concat(quoted(c), F.lit(" = "), F.col("_before")[c]))
    where = F.concat(F.lit(" WHERE "), joined(F.transform(used, test), " AND "))
    write = F.concat(F.when(F.col("rec_type") == 3, "REPLACE INTO ").otherwise("INSERT INTO "), target, F.lit(" ("), joined(F.transform(columns, quoted), ", "), F.lit(") VALUES ("), joined(F.transform(columns, lambda c: shown("_after", c)), ", "), F.lit(")"))
    sets = joined(F.transform(F.filter(columns, lambda c: F.array_contains("changed", c)), lambda c: F.concat(quoted(c), F.lit(" = "), shown("_after", c))), ", ")
    one = (used == F.col("keys")) if uniques is None else (used == F.col("keys")) | F.array_contains(uniques, used)
    once = F.when(~one, F.lit(" LIMIT 1")).otherwise(F.lit(""))
    update = F.concat(F.lit("UPDATE "), target, F.lit(" SET "), sets, where, once)
    delete = F.concat(F.lit("DELETE FROM "), target, where, once)
    text = F.when(kind.isin(0, 3), write).when(kind == 1, update).otherwise(delete)
    return rows.select("log_offset", text.alias("statement"), *(["txn_id"] if "txn_id" in log.columns else []))


def position_statement(table: str, log_offset: Column, txn_id: Column) -> Column:
    """The statement that records how far a target has got."""
    row = F.concat(txn_id.cast("string"), F.lit(", "), log_offset.cast("string"))
    return F.concat(F.lit(f"INSERT INTO {table} (`txn`, `position`) VALUES ("), row, F.lit(") ON DUPLICATE KEY UPDATE `position` = "), log_offset.cast("string"))
