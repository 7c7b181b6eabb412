"""Binary logs: the test log and rows of every column type written to log files and read back, with their SQL over the tables they were made of."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from tidelog.plans.common import DML, scratch, table
from tidelog.queries.log import _M, _MID
from tidelog.sources import binlog as B

QUERIES: dict = {}
SQL: dict[str, str] = {}
_COLUMNS = ["at", "a", "b", "c", "d", "f"]
_IMAGE = "struct<at: bigint, a: int, b: int, c: string, d: int, f: timestamp_ntz>"
_KINDS = ([B.LONGLONG, B.LONG, B.LONG, B.VARCHAR, B.LONG, B.DATETIME2], [(), (), (), (400,), (), (6,)])


def _first_deliveries(batches):
    """Of rows in the order of their places the first of each place, if it is kept."""
    last = None
    for batch in batches:
        at = batch.column("log_offset").to_numpy()
        if len(at):
            first = np.concatenate([[at[0] != last], at[1:] != at[:-1]])
            last = at[-1]
            yield batch.filter(pc.and_(pa.array(first), batch.column("kept")))


def _images(at: list, images: pa.StructArray) -> list:
    """The values of each image as a row of the log's tables, None where there is none."""
    fields = {f.name: c for f, c in zip(images.type, images.flatten(), strict=True)}
    fields["f"] = fields["f"].cast(pa.timestamp("us")).cast(pa.string())
    values = zip(at, *(fields[c].to_pylist() for c in _COLUMNS[1:]), strict=True)
    return [list(v) if there else None for v, there in zip(values, images.is_valid().to_pylist(), strict=True)]


def _write_changes(batches, root: str):
    """Files of a log from the deliveries of its messages in order, those of a file side by side."""
    writer, number, tables = None, None, {}
    for batch in _first_deliveries(batches):
        offsets = batch.column("log_offset").to_pylist()
        columns = [batch.column(c).to_pylist() for c in ("second", "txn_id", "rec_type", "db", "tbl", "table_id")]
        images = [_images(offsets, batch.column(c)) for c in ("before_img", "after_img")]
        for at, ts, txn_id, rec_type, db, tbl, table_id, before, after in zip(offsets, *columns, *images, strict=True):
            file = at >> 44
            if file != number:
                if writer:
                    writer.rotate(f"bin.{number + 1:06d}")
                    writer.close()
                writer, number = B.Writer(f"{root}/bin.{file:06d}"), file
            if rec_type in DML:
                if before or after:
                    kind = 31 if before and after else 30 if after else 32
                    if (key := (table_id, db, tbl)) not in tables:
                        t = B.TableMap(*key, *_KINDS)
                        tables[key] = t, B.write_table_map(t)
                    t, announcement = tables[key]
                    writer.event(B.TABLE_MAP, ts, announcement)
                    writer.event(kind, ts, B.write_rows(kind, t, [(before, after)]))
            elif rec_type in (5, 7):
                writer.query(ts, db or "", {5: "BEGIN", 7: "ROLLBACK"}[rec_type])
            elif rec_type == 6:
                writer.commit(ts, txn_id or 0)
            elif rec_type == 16:
                writer.event(B.HEARTBEAT, ts, b"beat")
        yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])
    if writer:
        writer.rotate(f"bin.{number + 1:06d}")
        writer.close()


def _folder(spark, name: str) -> str:
    import os

    root = scratch(spark, name).removeprefix("file:")
    os.makedirs(root, exist_ok=True)
    return root


def _log(spark, sf_dir) -> tuple[str, str]:
    """The test log as binary log files, one for each file of the source: their pattern and the names of columns by table."""
    root = _folder(spark, "binlog")
    deliveries = table(spark, sf_dir, "change_records").filter("log_offset is not null")
    # a log file is one sequence; its messages count as in counting_messages, told from their copies by the order that the file needs anyway
    content = ["ts", "txn_id", "rec_type", "db", "tbl", "table_meta_id", "before_img", "after_img"]
    late = F.coalesce("delivery_id", F.lit(2**63 - 1))
    ordered = deliveries.select("log_offset", late.alias("late"), *content).repartition(F.shiftright("log_offset", 44)).sortWithinPartitions("log_offset", "late", *content)
    kept = F.expr("coalesce(rec_type <> 4 and (rec_type > 3 or table_meta_id is not null and db is not null and tbl is not null), false)")
    second = F.coalesce(F.unix_seconds(F.col("ts").cast("timestamp")), F.lit(0))
    written = ordered.select("log_offset", second.alias("second"), "txn_id", "rec_type", "db", "tbl", F.shiftright("table_meta_id", 16).alias("table_id"), "before_img", "after_img", kept.alias("kept"))
    written.mapInArrow(lambda b: _write_changes(b, root), "n bigint").agg(F.sum("n")).collect()
    names = deliveries.filter("tbl is not null and db is not null").select("db", "tbl").distinct().collect()  # one row for each table
    return f"{root}/bin.*", json.dumps({f"{r.db}.{r.tbl}": _COLUMNS for r in names})


def _read(spark, path: str, columns: str, **options):
    B.register(spark)
    return spark.read.format("tidelog_binlog").option("path", path).option("columns", columns).options(**options).load()


def _told(rows):
    """The rows of DML records with their images in columns."""
    image = lambda c: F.from_json(c, _IMAGE)
    rows = rows.filter("rec_type in (0, 1, 2)").select("rec_type", "db", "tbl", image("before").alias("b"), image("after").alias("a"), F.array_join("changed", ",").alias("changed"))
    shown = [F.col(f"{i}.{c}").alias(f"{n}_{c}") for i, n in (("b", "old"), ("a", "new")) for c in _COLUMNS[1:]]
    return rows.select(F.coalesce("a.at", "b.at").alias("log_offset"), "rec_type", "db", "tbl", *shown, "changed")


def binlog_scan(spark, sf_dir):
    """Every change of the log through its files: type, table, both images and what changed."""
    return _told(_read(spark, *_log(spark, sf_dir)))


def binlog_markers(spark, sf_dir):
    """How many records of each type the files hold, in how many files."""
    rows = _read(spark, *_log(spark, sf_dir))
    return rows.groupBy("rec_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.shiftright("log_offset", 44)).alias("n_files"))


def binlog_seek(spark, sf_dir):
    """The log from a place in the middle of a file on: only what comes from there is read."""
    path, columns = _log(spark, sf_dir)
    every = _read(spark, path, columns).filter("rec_type in (0, 1, 2)")
    at = F.coalesce(F.get_json_object("after", "$.at"), F.get_json_object("before", "$.at")).cast("bigint")
    start = every.filter(at >= _MID).agg(F.min("log_offset")).first()[0]
    if start is None:
        start = 1 << 62
    return _told(_read(spark, path, columns, startingOffset=str(start))).select("log_offset", "rec_type")


def binlog_stream(spark, sf_dir):
    """The files followed as a stream."""
    path, columns = _log(spark, sf_dir)
    root = scratch(spark, "binlog-stream")
    B.register(spark)
    rows = spark.readStream.format("tidelog_binlog").option("path", path).option("columns", columns).load()
    rows.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/out").trigger(once=True).start().awaitTermination()
    return _told(spark.read.schema(B.SCHEMA).parquet(f"{root}/out")).select("log_offset", "rec_type", "tbl", "new_d")


#: A column of each type: its name, type and parameters, and the value as it is read, in Spark SQL and in the SQL of the check (where they differ).
_TYPES = [
    ("key", B.LONGLONG, (), "o_orderkey", None),
    ("tiny", B.TINY, (), "cast(o_orderkey % 200 - 100 as int)", "(o_orderkey % 200 - 100)::int"),
    ("small", B.SHORT, (), "cast(o_orderkey % 60000 - 30000 as int)", "(o_orderkey % 60000 - 30000)::int"),
    ("medium", B.INT24, (), "cast(o_custkey * 37 % 16000000 - 8000000 as int)", "(o_custkey * 37 % 16000000 - 8000000)::int"),
    ("number", B.LONG, (), "cast(-o_custkey as int)", "(-o_custkey)::int"),
    ("real", B.DOUBLE, (8,), "o_totalprice", None),
    ("half", B.FLOAT, (4,), "cast(o_orderkey % 1000 / 8 as double)", "(o_orderkey % 1000) / 8"),
    ("price", B.NEWDECIMAL, (14, 3), "cast(cast(o_totalprice as decimal(14,3)) as string)", "(o_totalprice::decimal(14,3))::varchar"),
    ("debt", B.NEWDECIMAL, (20, 2), "cast(cast(-o_totalprice as decimal(20,2)) as string)", "((-o_totalprice)::decimal(20,2))::varchar"),
    ("day", B.DATE, (), "date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
    ("year", B.YEAR, (), "cast(year(o_orderdate) as int)", "year(o_orderdate)::int"),
    ("moment", B.DATETIME2, (6,), "date_format(timestampadd(MICROSECOND, o_orderkey, cast(o_orderdate as timestamp_ntz)), 'yyyy-MM-dd HH:mm:ss.SSSSSS')", "replace(strftime(o_orderdate::timestamp + to_microseconds(o_orderkey), '%Y-%m-%d %H:%M:%S.%f'), '.000000', '')"),
    ("stamp", B.TIMESTAMP2, (6,), "date_format(timestampadd(SECOND, o_orderkey, cast(o_orderdate as timestamp_ntz)), 'yyyy-MM-dd HH:mm:ss.SSSSSS')", "strftime(o_orderdate::timestamp + to_seconds(o_orderkey), '%Y-%m-%d %H:%M:%S')"),
    ("span", B.TIME2, (6,), "concat(if(o_orderkey % 2 = 0, '-', ''), if(o_orderkey % 838 < 10, '0', ''), o_orderkey % 838, ':', lpad(o_orderkey % 59 + 1, 2, '0'), ':', lpad(o_custkey % 60, 2, '0'), '.', lpad(o_orderkey % 1000000, 6, '0'))", "replace(case when o_orderkey % 2 = 0 then '-' else '' end || case when o_orderkey % 838 < 10 then '0' else '' end || (o_orderkey % 838)::varchar || ':' || lpad((o_orderkey % 59 + 1)::varchar, 2, '0') || ':' || lpad((o_custkey % 60)::varchar, 2, '0') || '.' || lpad((o_orderkey % 1000000)::varchar, 6, '0'), '.000000', '')"),
    ("bits", B.BIT, (3, 1), "cast(o_orderkey % 2048 as bigint)", "o_orderkey % 2048"),
    ("choice", B.ENUM, (B.ENUM, 1), "cast(o_orderkey % 5 + 1 as int)", "(o_orderkey % 5 + 1)::int"),
    ("several", B.SET, (B.SET, 2), "cast(o_orderkey % 1024 as int)", "(o_orderkey % 1024)::int"),
    ("name", B.VARCHAR, (60,), "concat(o_orderpriority, ' é')", "o_orderpriority || ' é'"),
    ("long_name", B.VARCHAR, (900,), "repeat(o_orderpriority, 20)", None),
    ("code", B.STRING, (80,), "o_orderstatus", None),
    ("body", B.BLOB, (2,), "lower(hex(o_orderpriority))", "lower(hex(o_orderpriority))"),
    ("nothing", B.LONG, (), "if(o_orderkey % 3 = 0, null, cast(o_custkey as int))", "case when o_orderkey % 3 <> 0 then o_custkey::int end"),
]
_JSON = {B.DOUBLE: "double", B.FLOAT: "double", B.LONGLONG: "bigint", B.BIT: "bigint"} | dict.fromkeys((B.TINY, B.SHORT, B.INT24, B.LONG, B.YEAR, B.ENUM, B.SET), "int")


def _write_types(batches, root: str):
    """One file for each partition, numbered by it."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() + 1
    t = B.TableMap(9, "shop", "every", [k for _, k, _, _, _ in _TYPES], [m for _, _, m, _, _ in _TYPES])
    writer = B.Writer(f"{root}/bin.{number:06d}")
    for batch in batches:
        rows = [(None, list(r.values())) for r in batch.to_pylist()]
        for k in range(0, len(rows), 100):  # rows of one event
            writer.rows(1_000 + k, 30, t, rows[k : k + 100])
        yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64())], ["n"])
    writer.close()


def binlog_types(spark, sf_dir):
    """Rows of every column type through log files."""
    root = _folder(spark, "types")
    rows = table(spark, sf_dir, "orders").select(*(F.expr(e).alias(n) for n, _, _, e, _ in _TYPES))
    rows.mapInArrow(lambda b: _write_types(b, root), "n bigint").agg(F.sum("n")).collect()
    read = _read(spark, f"{root}/bin.*", json.dumps({"shop.every": [n for n, *_ in _TYPES]}))
    shape = "struct<" + ", ".join(f"{n}: {_JSON.get(k, 'string')}" for n, k, *_ in _TYPES) + ">"
    return read.select(F.from_json("after", shape).alias("r")).select("r.*")


for _f in (binlog_scan, binlog_markers, binlog_seek, binlog_stream, binlog_types):
    QUERIES[_f.__name__] = _f
_WRITTEN = f"""{_M}, row as (select *, case when before_img is not null and after_img is not null then 1 when after_img is not null then 0 else 2 end as kind from message
    where rec_type in (0, 1, 2, 3) and table_meta_id is not null and db is not null and tbl is not null and (before_img is not null or after_img is not null))"""
_SHOWN = ", ".join(f"{i}.{c} as {n}_{c}" for i, n in (("before_img", "old"), ("after_img", "new")) for c in _COLUMNS[1:])
_CHANGED = "concat_ws(',', " + ", ".join(f"case when kind = 1 and before_img.{c} is distinct from after_img.{c} then '{c}' end" for c in _COLUMNS[1:]) + ")"
SQL["binlog_scan"] = f"{_WRITTEN} select log_offset, kind as rec_type, db, tbl, {_SHOWN}, case when kind = 1 then {_CHANGED} end as changed from row"
SQL["binlog_markers"] = f"{_WRITTEN}, every as (select kind as rec_type, log_offset from row union all select rec_type, log_offset from message where rec_type in (5, 6, 7, 16)) select rec_type, count(*) as n, count(distinct log_offset >> 44) as n_files from every group by 1"
SQL["binlog_seek"] = f"{_WRITTEN} select log_offset, kind as rec_type from row where log_offset >= {_MID}"
SQL["binlog_stream"] = f"{_WRITTEN} select log_offset, kind as rec_type, tbl, after_img.d as new_d from row"
SQL["binlog_types"] = "select " + ", ".join(f"{theirs or mine} as {n}" for n, _, _, mine, theirs in _TYPES) + " from orders"
