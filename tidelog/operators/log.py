"""Reading an ordered change log: seeks, scans, filters, key lookups, merges and upkeep.

A log is a DataFrame with log_offset, and where needed record_id, ts, txn_id, rec_type, table_meta_id, row_key and old_key. Order is that of
log_offset, never of ts, which may go backward.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelog.operators.windows import numbered, running
from tidelog.plans.common import DML

FILE_BITS = 44


def ordered(log: DataFrame, descending: bool = False, by: str = "log_offset") -> DataFrame:
    return log.orderBy(F.desc(by) if descending else F.asc(by))


def scan_records(log: DataFrame, start: int, descending: bool = False) -> DataFrame:
    """From record ``start`` on in either direction; nothing if that record isn't there."""
    there = log.filter(F.col("record_id") == start).limit(1).select(F.lit(True).alias("_there"))
    side = F.col("record_id") <= start if descending else F.col("record_id") >= start
    return log.filter(side).join(F.broadcast(there), how="left_semi")


def scan_checkpoint(log: DataFrame, offset: int, descending: bool = False) -> DataFrame:
    """From the first message at or after ``offset``; descending from the last at or before it."""
    return log.filter(F.col("log_offset") <= offset if descending else F.col("log_offset") >= offset)


def seek_timestamp(log: DataFrame, time: Column, strict: bool = False) -> DataFrame:
    """One row (position): the first position whose time is at or after ``time``.

    With ``strict`` there is no position when the log begins after ``time``; otherwise such a time means its begin.
    """
    first = log.agg(F.min(F.when(F.col("ts") >= time, F.col("log_offset"))).alias("position"), F.min_by("ts", "log_offset").alias("begins"))
    return first.filter((F.col("begins") <= time) if strict else F.lit(True)).select("position")


def scan_timestamp(log: DataFrame, time: Column, descending: bool = False) -> DataFrame:
    """From the first message in log order whose time is at or after ``time``; all that follows belongs to it, also if its time is earlier.

    Descending: from the last message whose time is at or before ``time`` back to the begin.
    """
    if descending:
        at = log.agg(F.max(F.when(F.col("ts") <= time, F.col("log_offset"))).alias("position"))
        return log.join(F.broadcast(at), F.col("log_offset") <= F.col("position")).drop("position")
    return log.join(F.broadcast(seek_timestamp(log, time)), F.col("log_offset") >= F.col("position")).drop("position")


def resume_position(log: DataFrame, start_offset: int | None = None, start_time: Column | None = None) -> DataFrame:
    """One row (position): after the last message stored, else the given offset, else the position of the given time. Where nothing is stored and
    neither is given there is no place to start, which is an error."""
    if start_offset is None and start_time is None and log.limit(1).count() == 0:
        raise ValueError("nothing is stored, and neither an offset nor a time to start from is given")
    stored = log.agg(F.max("log_offset").alias("stored"))
    fallback = F.lit(start_offset).cast("long")
    if start_offset is None and start_time is not None:
        return stored.crossJoin(F.broadcast(seek_timestamp(log, start_time))).select(F.coalesce("stored", "position").alias("position"))
    return stored.select(F.coalesce("stored", fallback).alias("position"))


def of_types(log: DataFrame, types: Iterable[int]) -> DataFrame:
    return log.filter(F.col("rec_type").isin(*types))


def in_range(log: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Messages of [start, end], both inclusive."""
    if start is not None:
        log = log.filter(F.col("log_offset") >= start)
    return log if end is None else log.filter(F.col("log_offset") <= end)


def of_tables(log: DataFrame, only: Iterable[int] | None = None, without: Iterable[int] = ()) -> DataFrame:
    """Messages of tables on the white list (None: any) and not on the black list. Messages without table pass only without a white list."""
    of = F.shiftright("table_meta_id", 16)
    if only is not None:
        log = log.filter(of.isin(*only))
    out = list(without)
    return log.filter(~F.coalesce(of.isin(*out), F.lit(False))) if out else log


def committed(log: DataFrame, read_uncommitted: bool = False) -> DataFrame:
    """Messages of transactions with a COMMIT, and those outside transactions; all with ``read_uncommitted``."""
    if read_uncommitted:
        return log
    done = log.filter((F.col("rec_type") == 6) & F.col("txn_id").isNotNull()).select("txn_id").distinct()
    return log.filter(F.col("txn_id").isNotNull()).join(done, "txn_id", "left_semi").select(log.columns).unionAll(log.filter(F.col("txn_id").isNull()))


ISOLATION = ("read uncommitted", "read committed", "repeatable read")


def visible(log: DataFrame, isolation: str = "read committed", snapshot: int | None = None) -> DataFrame:
    """What a reader sees of a log: everything, what is committed by now, or (repeatable read) what was committed at the position ``snapshot``, the same at
    every later read. Messages outside transactions count as committed where they stand."""
    if isolation not in ISOLATION or (isolation == "repeatable read") != (snapshot is not None):
        raise ValueError(f"isolation is one of {', '.join(ISOLATION)}, the last with a snapshot")
    return committed(in_range(log, end=snapshot), isolation == "read uncommitted")


def touches(log: DataFrame) -> DataFrame:
    """The index of a log: a row for each key a DML message touches (table_id, key, log_offset, rec_type); an update that moves a key touches both."""
    keys = F.array_distinct(F.array_compact(F.array(F.when(F.length("old_key") > 0, F.col("old_key")), F.col("row_key"))))
    dml = log.filter(F.col("rec_type").isin(*DML))
    return dml.select(F.shiftright("table_meta_id", 16).alias("table_id"), F.explode(keys).alias("key"), "log_offset", "rec_type")


def key_lookup(log: DataFrame) -> DataFrame:
    """The latest message touching each key, deletes and moves away included: table_id, key, log_offset, rec_type."""
    last = touches(log).groupBy("table_id", "key").agg(F.max(F.struct("log_offset", "rec_type")).alias("m"))
    return last.select("table_id", "key", "m.log_offset", "m.rec_type")


def key_history(log: DataFrame, descending: bool = False) -> DataFrame:
    """All messages touching each key, numbered from the first (or the last) version: touches() and version."""
    place = (-F.col("log_offset") if descending else F.col("log_offset")).alias("_place")
    rows = numbered(touches(log).select("*", place), ["_place"], ["table_id", "key"])
    return rows.withColumn("version", (F.col("ordinal") + 1).cast("int")).drop("ordinal", "_place")


def keys_from(log: DataFrame, start: str, descending: bool = False) -> DataFrame:
    """The keys at or after ``start`` (descending: at or before) with their number of versions."""
    side = F.col("key") <= start if descending else F.col("key") >= start
    return touches(log).filter(side).groupBy("table_id", "key").agg(F.count(F.lit(1)).alias("n_versions"))


def neighbour_key(log: DataFrame, start: str, descending: bool = False) -> DataFrame:
    """The key after ``start`` (descending: before it) in each table, with its first and last version: table_id, key, first_version, last_version (log offsets).

    An iterator over keys goes on from one key to the next by this; tables without such a key give no row.
    """
    side = F.col("key") < start if descending else F.col("key") > start
    ends = touches(log).filter(side).groupBy("table_id", "key").agg(F.min("log_offset").alias("first_version"), F.max("log_offset").alias("last_version"))
    best = (F.max if descending else F.min)(F.struct("key", "first_version", "last_version")).alias("k")
    return ends.groupBy("table_id").agg(best).select("table_id", "k.*")


def point_select(state: DataFrame, keys: Mapping[str, object], key_columns: Iterable[str]) -> DataFrame:
    """The row of a latest-state table with these key values; they must name exactly the key's columns. A null key value finds rows without one."""
    if set(keys) != set(key_columns):
        raise ValueError(f"the key is {', '.join(key_columns)}, not {', '.join(keys)}")
    for column, value in keys.items():
        state = state.filter(F.col(column).eqNullSafe(F.lit(value)))
    return state


def merge_segments(*segments: DataFrame) -> DataFrame:
    """Keyed logs of several segments as one: for each key the message of the newest segment position wins."""
    every = segments[0]
    for more in segments[1:]:
        every = every.unionByName(more)
    return key_lookup(every)


def compact(log: DataFrame, start: int, end: int, keep_history: bool = False) -> DataFrame:
    """A range of the log, whole or reduced to the last message touching each key (log_offset, rec_type, table_id, key)."""
    part = in_range(log, start, end)
    return touches(part).select("table_id", "key", "log_offset", "rec_type") if keep_history else key_lookup(part)


def purge(log: DataFrame, retention_seconds: int = 86_400, keep_files: int = 2) -> DataFrame:
    """The messages of log files that hold anything newer than the retention, and of the last ``keep_files`` files anyway."""
    file = F.shiftright("log_offset", FILE_BITS)
    files = log.groupBy(file.alias("_file")).agg(F.max("ts").alias("_newest"))
    newest = files.agg(F.max("_newest").alias("_end"))
    last = files.orderBy(F.desc("_file")).limit(keep_files).select("_file")
    recent = files.crossJoin(F.broadcast(newest)).filter(F.col("_newest") >= F.col("_end") - F.make_dt_interval(secs=F.lit(retention_seconds))).select("_file")
    return log.withColumn("_file", file).join(recent.unionAll(last).distinct(), "_file", "left_semi").drop("_file")


def checkpoint(log: DataFrame) -> DataFrame:
    """Where a log stands: log_offset and ts of its last message."""
    return log.agg(F.max("log_offset").alias("log_offset"), F.max_by("ts", "log_offset").alias("ts"))


def statistics(log: DataFrame) -> DataFrame:
    """Counts and ends of a log, by record type."""
    return log.groupBy("rec_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("log_offset").alias("first_offset"), F.max("log_offset").alias("last_offset"),
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def rates(log: DataFrame, every: str = "1 second") -> DataFrame:
    """Records and transactions (COMMITs) of each period that has any: starts, n_records, n_commits."""
    period = F.window("ts", every)
    return log.filter(F.col("ts").isNotNull()).groupBy(period).agg(F.count(F.lit(1)).alias("n_records"), F.count_if(F.col("rec_type") == 6).alias("n_commits")).select(F.col("window.start").alias("starts"), "n_records", "n_commits")


def file_gaps(log: DataFrame) -> DataFrame:
    """Where the numbers of log files don't follow one another: file, previous."""
    files = log.select(F.shiftright("log_offset", FILE_BITS).alias("file")).filter(F.col("file").isNotNull()).distinct()
    before = files.select((F.col("file") + 1).alias("file"), F.lit(True).alias("_follows"))
    lone = files.join(before, "file", "left").filter(F.col("_follows").isNull()).select("file")
    # only the starts of runs of files are ordered: as many rows as gaps
    return lone.withColumn("previous", F.lag("file").over(W.orderBy("file"))).filter(F.col("previous").isNotNull()).select("file")


def missing_records(log: DataFrame) -> DataFrame:
    """How many record ids are missing between the least and the greatest: lowest, highest, n_missing."""
    ids = log.filter(F.col("record_id").isNotNull())
    return ids.agg(F.min("record_id").alias("lowest"), F.max("record_id").alias("highest"), F.countDistinct("record_id").alias("n")).select("lowest", "highest", (F.col("highest") - F.col("lowest") + 1 - F.col("n")).alias("n_missing"))


def schema_errors(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """Messages whose table version is unknown (no_meta) or whose changed columns aren't in it (meta_mismatch): log_offset, error."""
    fields = F.from_json("columns_json", "array<struct<name: string, type: string>>")
    known = catalog.filter(F.col("table_meta_id").isNotNull()).groupBy("table_meta_id").agg(F.max(F.transform(fields, lambda f: f["name"])).alias("names"))
    dml = log.filter(F.col("rec_type").isin(*DML)).join(known.withColumn("_known", F.lit(True)), "table_meta_id", "left")
    foreign = F.size(F.array_except(F.col("changed"), F.col("names"))) > 0
    error = F.when(F.col("_known").isNull(), "no_meta").when(foreign, "meta_mismatch")
    return dml.withColumn("error", error).filter(F.col("error").isNotNull()).select("log_offset", "error")


def table_pattern(pattern: str) -> str:
    """A table name pattern as a regular expression: %d any digits, %4d exactly four."""
    parts = re.split(r"%(\d*)d", pattern)
    out = re.escape(parts[0])
    for digits, rest in zip(parts[1::2], parts[2::2], strict=True):
        out += (r"\d{%s}" % digits if digits else r"\d+") + re.escape(rest)
    return f"^{out}$"


def select_tables(log: DataFrame, rules: Mapping[str, Mapping], exclude: Mapping[str, Iterable[str]] | None = None) -> DataFrame:
    """Messages of the tables that rules name, with the target name in ``target``.

    ``rules``: for each database {"needAllTable": bool, "translateTo": name, "table": {pattern: {"translateTo": name}}}; ``exclude``: patterns of
    tables left out for each database. A pattern may hold %d or %Nd. Messages of other databases or without table are left out.
    """
    chosen, target = F.lit(False), F.col("tbl")
    for db, rule in rules.items():
        own = F.col("db") == db
        hit = F.lit(bool(rule.get("needAllTable")))
        for pattern, to in (rule.get("table") or {}).items():
            match = F.col("tbl").rlike(table_pattern(pattern))
            hit = hit | match
            if to.get("translateTo"):
                target = F.when(own & match, F.lit(to["translateTo"])).otherwise(target)
        for pattern in (exclude or {}).get(db, ()):
            hit = hit & ~F.col("tbl").rlike(table_pattern(pattern))
        chosen = chosen | (own & hit)
    name = F.col("db")
    for db, rule in rules.items():
        if rule.get("translateTo"):
            name = F.when(F.col("db") == db, F.lit(rule["translateTo"])).otherwise(name)
    return log.filter(F.coalesce(chosen, F.lit(False))).withColumn("target", F.concat(name, F.lit("."), target))


def markers_to_transactions(events: DataFrame, source: str = "source") -> DataFrame:
    """Transaction numbers from BEGIN and end markers alone: ``txn_seq`` counts BEGINs of a source in log order; 0 before the first."""
    begin = F.when(F.col("rec_type") == 5, 1).otherwise(0)
    return running(events, ["log_offset"], [source], begin, "_begun").withColumn("txn_seq", F.col("_begun") + begin).drop("_begun")


def last_writer(entries: DataFrame) -> DataFrame:
    """A replicated log after truncations: for each log_index the entry of the greatest term, without those a later term rolled back.

    ``entries``: term, log_index, and rolled_back_to (set on entries that truncate the log to that index in their term). What rolls an entry back is the greatest term of
    the truncations to an index below its own: a running maximum over the index.
    """
    cuts = entries.filter(F.col("rolled_back_to").isNotNull()).groupBy(F.col("rolled_back_to").alias("log_index")).agg(F.max("term").alias("_cut"))
    newest = entries.filter(F.col("rolled_back_to").isNull() & F.col("log_index").isNotNull()).groupBy("log_index").agg(F.max("term").alias("term"))
    both = newest.select("log_index", "term", F.lit(None).cast("long").alias("_cut"), F.lit(0).alias("_side")).unionAll(cuts.select("log_index", F.lit(None).cast("long"), "_cut", F.lit(1)))
    told = running(both, ["log_index", "_side"], [], F.col("_cut"), "_by", greatest=True)
    return told.filter((F.col("_side") == 0) & ~F.coalesce(F.col("term") < F.col("_by"), F.lit(False))).select("log_index", "term")
