"""Queries of the data-pipeline operators over the change log, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators import asof, delivery, drift, incremental, references, replay
from tidelog.plans.common import DML, counting_messages, scratch, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of the test table has ended: what is committed by then is exposed."""
    return replay.replay_state(table(spark, sf_dir, "change_records"), log_ended=True)


def p1_watermarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same while the log still runs: only what lies below the contiguous committed watermark."""
    return replay.replay_state(table(spark, sf_dir, "change_records"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.pending_messages(table(spark, sf_dir, "change_records"), table(spark, sf_dir, "consumer_runs"))


def p2_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as it arrives in three parts, taken by runs of which one is lost after its plan and one before its commit mark: what the sink holds.

    Source partitions are the log files, positions in them the order of delivery; later parts hold copies of earlier messages and messages that land late.
    """
    changes = table(spark, sf_dir, "change_records").select("delivery_id", "log_offset", "record_id").filter(F.col("log_offset").isNotNull())
    last = changes.agg(F.max("delivery_id")).first()[0] or 0
    root, file = scratch(spark, "recovered"), F.shiftright("log_offset", 44)
    run = lambda: incremental.IncrementalRun(spark, root, ("log_offset",), partition=file, bucket=file)
    arrived = lambda share: changes.filter(F.col("delivery_id") <= last * share // 3)
    for share, fault in ((1, "plan"), (1, None), (2, "sink"), (3, None), (3, None), (3, None)):
        try:
            run().run(arrived(share), fail_after=fault)
        except RuntimeError:
            continue  # a new driver goes on
    return run().sink().select("log_offset", "delivery_id", "batch")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = table(spark, sf_dir, "change_records")
    return delivery.duplicates(changes, scratch(spark, "deliveries"), F.to_date("arrived_at"), ["record_id", "txn_id"])


def dml_messages(spark: SparkSession, sf_dir: str, columns: list[str]) -> DataFrame:
    rows = counting_messages(table(spark, sf_dir, "change_records"), ["rec_type", *columns])
    return rows.filter(F.col("rec_type").isin(*DML)).drop("rec_type")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = dml_messages(spark, sf_dir, ["table_meta_id"]).withColumn("table_id", F.shiftright("table_meta_id", 16))
    found = asof.attributes_at(events, table(spark, sf_dir, "table_attrs"), only_restated=True)
    return found.select("log_offset", F.col("known_revision").alias("revision_id"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.field_changes(table(spark, sf_dir, "capture_rows")).select("table_id", "log_offset", "field", "change")


def p5_failed_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = table(spark, sf_dir, "capture_rows")
    values = drift.consistent_values(captures, drift.field_changes(captures))
    return values.groupBy("table_id", "name", "kind").agg(F.count(F.lit(1)).alias("n_values"), F.count_if("cast_failed").alias("n_failed"))


def p5_consistent_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent table of all captured tables, one row for each row read; its maps as sorted texts."""
    captures = table(spark, sf_dir, "capture_rows")
    rows = drift.consistent_rows(drift.consistent_values(captures, drift.field_changes(captures)))
    names = lambda c: F.array_join(F.array_sort(F.map_keys(c)), ",").alias(c)
    return rows.select("table_id", "log_offset", "file_id", "row_no", *(names(c) for c in ("whole", "fraction", "flag", "items", "text")), F.array_join("failed", ",").alias("failed"))


def p5_registry_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.registry_differences(table(spark, sf_dir, "capture_rows"), table(spark, sf_dir, "column_defs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = dml_messages(spark, sf_dir, ["table_meta_id"])
    return references.orphan_references(refs, table(spark, sf_dir, "table_meta")).select("log_offset")


def p6_orphans_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = dml_messages(spark, sf_dir, ["table_meta_id", "ts"])
    return references.orphan_counts(refs, table(spark, sf_dir, "table_meta"))


QUERIES = {f.__name__: f for f in (p1_found, p1_watermarked, p2_found, p2_recovered, p3_found, p4_found, p5_found, p5_failed_casts, p5_consistent_rows, p5_registry_differences, p6_found, p6_orphans_by_day)}

_MESSAGES = "with msg as (select log_offset, arg_min({'record_id': record_id, 'txn_id': txn_id, 'rec_type': rec_type, 'table_meta_id': table_meta_id, 'row_key': row_key, 'old_key': old_key, 'ts': ts}, delivery_id) as m from change_records where log_offset is not null group by log_offset), message as (select log_offset, m.record_id, m.txn_id, m.rec_type, m.table_meta_id, m.row_key, m.old_key, m.ts from msg)"

_REPLAY = """{messages},
txn as (select txn_id, min(log_offset) as first_offset, min(log_offset) filter (rec_type = 6) as commit_offset, min(log_offset) filter (rec_type = 7) as rollback_offset from message where txn_id is not null group by txn_id),
num as (select record_id, max(log_offset) as pos from message where record_id is not null group by record_id),
gap as (select arg_min(pos, record_id) as held from (select *, lead(record_id) over (order by record_id) as following from num) where following > record_id + 1),
mark as (select least(coalesce(min(first_offset) filter (commit_offset is null and rollback_offset is null) - 1, 9223372036854775807), coalesce((select held from gap), 9223372036854775807), (select max(log_offset) from message)) as through from txn),
applied as (select * from message where rec_type in (0, 1, 2, 3) and txn_id in (select txn_id from message where rec_type = 6 and txn_id is not null{limit})),
touch as (
    select table_meta_id >> 16 as table_id, row_key, log_offset, rec_type <> 2 as is_set from applied
    union all
    select table_meta_id >> 16, old_key, log_offset, false from applied where rec_type = 1 and length(old_key) > 0 and old_key is distinct from row_key
)
select table_id, row_key, log_offset from touch where row_key is not null and table_id is not null
qualify row_number() over (partition by table_id, row_key order by log_offset desc) = 1 and is_set"""

_ORPHANS = """{messages},
versions as (select table_id, table_meta_id, start_offset, version, columns_json is null as is_drop from table_meta),
orphans as (
    select r.* from message r where rec_type in (0, 1, 2, 3) and (
        not exists (select 1 from versions v where v.table_meta_id = r.table_meta_id)
        or exists (select 1 from versions v where v.table_meta_id = r.table_meta_id and v.start_offset > r.log_offset)
        or (select arg_max(v.is_drop, v.start_offset) from versions v where v.table_id = r.table_meta_id >> 16 and v.start_offset <= r.log_offset))
)
{select}"""

SQL = {
    "p1_found": _REPLAY.format(messages=_MESSAGES, limit=""),
    "p1_watermarked": _REPLAY.format(messages=_MESSAGES, limit=" and log_offset <= (select through from mark)"),
    "p2_found": """with last as (select consumer_id, run_id, arg_max({'s': lower(trim(status)), 'a': first_delivery_id, 'z': last_delivery_id}, reported_at) as r from consumer_runs group by consumer_id, run_id),
done as (select consumer_id, r.a as a, r.z as z from last where r.s = 'succeeded'),
seen as (select distinct d.consumer_id, c.log_offset from done d join change_records c on c.delivery_id between d.a and d.z)
select k.consumer_id, c.log_offset from (select distinct consumer_id from consumer_runs) k, (select distinct log_offset from change_records where log_offset is not null) c
where not exists (select 1 from seen s where s.consumer_id = k.consumer_id and s.log_offset = c.log_offset)""",
    "p2_recovered": """with top as (select max(delivery_id) as m from change_records where log_offset is not null),
part as (select log_offset, delivery_id, case when delivery_id <= m // 3 then 1 when delivery_id <= m * 2 // 3 then 2 else 3 end as batch from change_records, top where log_offset is not null and delivery_id is not null)
select log_offset, min(delivery_id) as delivery_id, min(batch) as batch from part group by log_offset""",
    "p3_found": "select delivery_id from change_records qualify row_number() over (partition by log_offset order by delivery_id) > 1",
    "p4_found": f"""{_MESSAGES},
event as (select log_offset, table_meta_id >> 16 as table_id from message where rec_type in (0, 1, 2, 3)),
held as (select e.log_offset, arg_max(revision_id, (start_offset, known_offset)) filter (known_offset <= e.log_offset) as revision_id, arg_max(revision_id, (start_offset, known_offset)) as restated
    from event e left join table_attrs a on a.table_id = e.table_id and a.start_offset <= e.log_offset group by e.log_offset)
select log_offset, revision_id from held where revision_id is distinct from restated""",
    "p6_found": _ORPHANS.format(messages=_MESSAGES, select="select log_offset from orphans"),
    "p6_orphans_by_day": _ORPHANS.format(messages=_MESSAGES, select="select table_meta_id >> 16 as table_id, ts::date as day, count(*) as n_orphans, count(distinct table_meta_id) as n_keys from orphans group by all"),
}

_CELLS = """with ok as (select table_meta_id >> 16 as t, log_offset as o, row_key, file_id, row_no, payload from capture_rows where rec_type in (0, 1, 2, 3) and log_offset is not null and json_valid(payload) and json_type(payload) = 'OBJECT'),
cell as (select t, o, row_key, file_id, row_no, j.key as f, case j.type when 'VARCHAR' then 'text' when 'BOOLEAN' then 'flag' when 'ARRAY' then 'list' when 'OBJECT' then 'object' when 'DOUBLE' then 'fraction' else 'whole' end as kind,
    case when j.type = 'VARCHAR' then j.value ->> '$' else j.value::varchar end as x from ok, json_each(ok.payload) j where j.type <> 'NULL'),
stat as (select t, o, f, arg_max(kind, (n, kind)) as kind from (select t, o, f, kind, count(*) as n from cell group by all) group by t, o, f)"""

_RENAMES = f"""{_CELLS},
file as (select t, o, lead(o) over (partition by t order by o) as nxt, row_number() over (partition by t order by o) as k from (select distinct t, o from cell)),
now as (select s.t, s.o as pos, s.f, s.kind from stat s join file on file.t = s.t and file.o = s.o where k > 1),
was as (select s.t, nxt as pos, s.f, s.kind, s.o from stat s join file on file.t = s.t and file.o = s.o where nxt is not null),
added as (select n.* from now n where not exists (select 1 from was w where w.t = n.t and w.pos = n.pos and w.f = n.f)),
removed as (select w.* from was w where not exists (select 1 from now n where w.t = n.t and w.pos = n.pos and w.f = n.f)),
one as (select t, o, row_key, f, arg_max(x, (file_id, row_no)) as x from cell where row_key is not null group by all),
pair as (select a.t, a.pos, a.f, r.f as old, a.kind, r.kind as old_kind, count(*) as both_, count(*) filter (x.x = y.x) as same from added a join removed r on a.t = r.t and a.pos = r.pos join one x on x.t = a.t and x.o = a.pos and x.f = a.f join one y on y.t = r.t and y.o = r.o and y.f = r.f and y.row_key = x.row_key group by all having same * 2 > both_),
ren as (select * from pair qualify row_number() over (partition by t, pos, f order by same / both_ desc, same desc, old) = 1 and row_number() over (partition by t, pos, old order by same / both_ desc, same desc, f) = 1)"""

SQL["p5_found"] = f"""{_RENAMES}
select t as table_id, pos as log_offset, f as field, 'added' as change from added a where not exists (select 1 from ren where ren.t = a.t and ren.pos = a.pos and ren.f = a.f)
union all select t, pos, f, 'removed' from removed a where not exists (select 1 from ren where ren.t = a.t and ren.pos = a.pos and ren.old = a.f)
union all select t, pos, f, 'renamed' from ren
union all select t, pos, f, 'retyped' from ren where kind <> old_kind
union all select n.t, n.pos, n.f, 'retyped' from now n join was w on w.t = n.t and w.pos = n.pos and w.f = n.f where w.kind <> n.kind"""

# the name each field of each file has in the end, by following its renames one after the other
_NAMED = _RENAMES.replace("with ", "with recursive ", 1) + """,
follow as (
    select distinct t, o, f as field, f as name, o as pos from cell
    union all
    select x.t, x.o, x.field, r.f, r.pos from follow x join ren r on r.t = x.t and r.old = x.name and r.pos > x.pos where not exists (select 1 from ren e where e.t = x.t and e.old = x.name and e.pos > x.pos and e.pos < r.pos)
),
final as (select t, o, field, arg_max(name, pos) as name from follow group by all),
named as (select c.*, n.name from cell c join final n on n.t = c.t and n.o = c.o and n.field = c.f),
target as (select t, name, arg_max(kind, (n, kind)) as target from (select t, name, kind, count(*) as n from named group by all) group by all),
typed as (select n.*, target, case target when 'whole' then not coalesce(regexp_full_match(trim(x), '[+-]?[0-9]+') and try_cast(trim(x) as bigint) is not null, false) when 'fraction' then try_cast(x as double) is null
    when 'flag' then try_cast(x as boolean) is null when 'list' then kind <> 'list' else false end as cast_failed from named n join target using (t, name))"""
SQL["p5_failed_casts"] = f"{_NAMED} select t as table_id, name, target as kind, count(*) as n_values, count(*) filter (cast_failed) as n_failed from typed group by all"
_OF = lambda kinds: f"coalesce(string_agg(distinct name, ',' order by name) filter (target in ({kinds}) and not cast_failed), '')"
SQL["p5_consistent_rows"] = f"""{_NAMED}
select t as table_id, o as log_offset, file_id, row_no, {_OF("'whole'")} as whole, {_OF("'fraction'")} as fraction, {_OF("'flag'")} as flag, {_OF("'list'")} as items, {_OF("'text', 'object'")} as text,
    coalesce(string_agg(distinct name, ',' order by name) filter (cast_failed), '') as failed from typed group by t, o, file_id, row_no, row_key"""

SQL["p5_registry_differences"] = f"""{_CELLS},
version as (select distinct table_meta_id >> 16 as t, log_offset as o, table_meta_id from capture_rows where log_offset is not null),
known as (select table_meta_id, column_name as f, max(case when col_type in (1, 2, 3, 4, 5, 6, 7, 8, 17) then 'whole' when col_type in (9, 10, 11, 12) then 'fraction' when col_type = 29 then 'flag' else 'text' end) as registered_kind from column_defs where column_name is not null group by 1, 2),
held as (select v.table_meta_id, s.o as log_offset, s.f, s.kind from stat s join version v using (t, o) where v.table_meta_id in (select table_meta_id from known)),
want as (select h.table_meta_id, h.log_offset, k.f, k.registered_kind from (select distinct table_meta_id, log_offset from held) h join known k using (table_meta_id))
select table_meta_id, log_offset, f as field, kind, registered_kind, case when registered_kind is null then 'unregistered' when kind is null then 'missing' else 'other_kind' end as difference
from held full join want using (table_meta_id, log_offset, f) where kind is distinct from registered_kind"""
