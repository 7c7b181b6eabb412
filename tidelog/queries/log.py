"""Queries over the change log as a log: its messages are the counting deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators import apply, images, log, replay, windows
from tidelog.plans.common import counting_messages, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_COLUMNS = ["record_id", "ts", "txn_id", "rec_type", "db", "tbl", "table_meta_id", "row_key", "old_key", "changed", "before_img", "after_img"]
_M = "with message as (select * from change_records where log_offset is not null qualify row_number() over (partition by log_offset order by delivery_id) = 1)"
_TOUCH = f"""{_M}, touch as (select table_meta_id >> 16 as table_id, unnest(list_distinct(list_filter([case when length(old_key) > 0 then old_key end, row_key], lambda k: k is not null))) as key, log_offset, rec_type
    from message where rec_type in (0, 1, 2, 3))"""
_COMMITTED = f"{_M}, seen as (select m.* from message m where txn_id is null or txn_id in (select txn_id from message where rec_type = 6 and txn_id is not null))"


def messages(spark, sf_dir, columns=None) -> DataFrame:
    return counting_messages(table(spark, sf_dir, "change_records"), columns or _COLUMNS)


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


_HEAD = ["log_offset", "record_id", "rec_type"]
_H = ", ".join(_HEAD)
_COLS = ["a", "b", "c", "d", "f"]  # of the images of the test log
_MID = 387028092977152  # a position inside the test log: file 22
_TS = "timestamp '2024-06-12 06:00:00'"
_T = lambda: F.to_timestamp(F.lit("2024-06-12 06:00:00"))
_keyed = ["rec_type", "table_meta_id", "row_key", "old_key"]
_images = [*_keyed, "changed", "before_img", "after_img"]
_head = ["record_id", "rec_type", "ts", "txn_id", "table_meta_id"]
_add("log_scan_recordid", lambda s, d: log.scan_records(messages(s, d, _head), 1000).select(_HEAD), f"{_M} select {_H} from message where record_id >= 1000 and exists (select 1 from message where record_id = 1000)")
_add("log_scan_recordid_desc", lambda s, d: log.scan_records(messages(s, d, _head), 1000, True).select(_HEAD), f"{_M} select {_H} from message where record_id <= 1000 and exists (select 1 from message where record_id = 1000)")
_add("log_scan_checkpoint", lambda s, d: log.ordered(log.scan_checkpoint(messages(s, d, _head), _MID)).select(_HEAD), f"{_M} select {_H} from message where log_offset >= {_MID}")
_add("log_scan_checkpoint_desc", lambda s, d: log.ordered(log.scan_checkpoint(messages(s, d, _head), _MID, True), True).select(_HEAD), f"{_M} select {_H} from message where log_offset <= {_MID}")
_add("log_seek_timestamp", lambda s, d: log.seek_timestamp(messages(s, d, _head), _T()), f"{_M} select min(log_offset) as position from message where ts >= {_TS}")
_add("log_seek_timestamp_strict", lambda s, d: log.seek_timestamp(messages(s, d, _head), F.to_timestamp(F.lit("2024-05-01 00:00:00")), True), f"{_M} select min(log_offset) as position from message having arg_min(ts, log_offset) <= timestamp '2024-05-01 00:00:00'")
_add("log_scan_ts_position", lambda s, d: log.scan_timestamp(messages(s, d, _head), _T()).select(_HEAD), f"{_M} select {_H} from message where log_offset >= (select min(log_offset) from message where ts >= {_TS})")
_add("log_scan_ts_desc", lambda s, d: log.scan_timestamp(messages(s, d, _head), _T(), True).select(_HEAD), f"{_M} select {_H} from message where log_offset <= (select max(log_offset) from message where ts <= {_TS})")
_add("log_resume", lambda s, d: log.resume_position(messages(s, d, _head), 4), f"{_M} select coalesce(max(log_offset), 4) as position from message")
_add("log_filter_ops", lambda s, d: log.of_types(messages(s, d, _head), (1, 2)).select(_HEAD), f"{_M} select {_H} from message where rec_type in (1, 2)")
_add("log_filter_range", lambda s, d: log.in_range(messages(s, d, _head), _MID // 2, _MID).select(_HEAD), f"{_M} select {_H} from message where log_offset between {_MID // 2} and {_MID}")
_add("log_filter_tables", lambda s, d: log.of_tables(messages(s, d, _head), range(1001, 1031), (1002, 1005)).select(_HEAD), f"{_M} select {_H} from message where table_meta_id >> 16 between 1001 and 1030 and table_meta_id >> 16 not in (1002, 1005)")
_add("log_filter_predicate", lambda s, d: messages(s, d, ["record_id", "rec_type", "changed", "after_img"]).filter("after_img.b > 20000 and array_contains(changed, 'd')").select(_HEAD), f"{_M} select {_H} from message where after_img.b > 20000 and list_contains(changed, 'd')")
_add("log_committed", lambda s, d: log.committed(messages(s, d, _head)).select(_HEAD), f"{_COMMITTED} select {_H} from seen")
_add("log_read_uncommitted", lambda s, d: log.committed(messages(s, d, _head), True).select(_HEAD), f"{_M} select {_H} from message")
_add("log_key_lookup", lambda s, d: log.key_lookup(messages(s, d, _keyed)), f"{_TOUCH} select table_id, key, max(log_offset) as log_offset, arg_max(rec_type, log_offset) as rec_type from touch group by all")
_add("log_key_versions", lambda s, d: log.key_history(messages(s, d, _keyed)), f"{_TOUCH} select *, row_number() over (partition by table_id, key order by log_offset)::int as version from touch")
_add("log_key_versions_desc", lambda s, d: log.key_history(messages(s, d, _keyed), True), f"{_TOUCH} select *, row_number() over (partition by table_id, key order by log_offset desc)::int as version from touch")
_add("log_keyed_order", lambda s, d: log.keys_from(messages(s, d, _keyed), "k").orderBy("table_id", "key"), f"{_TOUCH} select table_id, key, count(*) as n_versions from touch where key >= 'k' group by all")
_add("log_merge_newest", lambda s, d: log.merge_segments(*(log.in_range(messages(s, d, _keyed), a, b) for a, b in ((None, _MID // 2), (_MID // 2 + 1, _MID), (_MID + 1, None)))), f"{_TOUCH} select table_id, key, max(log_offset) as log_offset, arg_max(rec_type, log_offset) as rec_type from touch group by all")
_add("log_compact", lambda s, d: log.compact(messages(s, d, _keyed), _MID // 2, _MID), f"{_TOUCH} select table_id, key, max(log_offset) as log_offset, arg_max(rec_type, log_offset) as rec_type from touch where log_offset between {_MID // 2} and {_MID} group by all")
_add("log_compact_history", lambda s, d: log.compact(messages(s, d, _keyed), _MID // 2, _MID, True), f"{_TOUCH} select table_id, key, log_offset, rec_type from touch where log_offset between {_MID // 2} and {_MID}")
_add("log_purge", lambda s, d: log.purge(messages(s, d, _head), 5 * 86_400).select(_HEAD), f"""{_M}, file as (select log_offset >> 44 as f, max(ts) as newest from message group by 1)
select {_H} from message where log_offset >> 44 in (select f from file where newest >= (select max(newest) from file) - interval 5 day union select * from (select f from file order by f desc limit 2))""")
_add("log_checkpoint", lambda s, d: log.checkpoint(messages(s, d, _head)), f"{_M} select max(log_offset) as log_offset, arg_max(ts, log_offset) as ts from message")
_add("log_stats", lambda s, d: log.statistics(messages(s, d, _head)), f"{_M} select rec_type, count(*) as n, min(log_offset) as first_offset, max(log_offset) as last_offset, min(ts) as first_ts, max(ts) as last_ts from message group by 1")
_add("log_rates", lambda s, d: log.rates(messages(s, d, _head).withColumn("ts", F.col("ts").cast("timestamp_ntz"))), f"{_M} select date_trunc('second', ts) as starts, count(*) as n_records, count(*) filter (rec_type = 6) as n_commits from message where ts is not null group by 1")
_add("log_gap_check", lambda s, d: log.file_gaps(messages(s, d, _head)), f"{_M}, f as (select distinct log_offset >> 44 as file from message) select file from f where file - 1 not in (select file from f) and file > (select min(file) from f)")
_add("log_missing_records", lambda s, d: log.missing_records(messages(s, d, _head)), f"{_M} select min(record_id) as lowest, max(record_id) as highest, max(record_id) - min(record_id) + 1 - count(distinct record_id) as n_missing from message")
_add("log_schema_errors", lambda s, d: log.schema_errors(messages(s, d, ["rec_type", "table_meta_id", "changed"]), table(s, d, "table_meta")), f"""{_M}, known as (select table_meta_id, list_distinct(flatten(list(case when columns_json is null then [] else json_extract_string(columns_json, '$[*].name') end))) as names, bool_and(columns_json is null) as dropped from table_meta group by 1)
select log_offset, case when k.table_meta_id is null then 'no_meta' else 'meta_mismatch' end as error from message m left join known k using (table_meta_id)
where rec_type in (0, 1, 2, 3) and (k.table_meta_id is null or (not dropped and len(list_filter(changed, lambda c: not list_contains(names, c))) > 0))""")
_RULES = {"ledger_a": {"translateTo": "ledger", "table": {"int_pk_%2d": {"translateTo": "int_pk"}, "char_%d": {}, "char_pk_%d": {}}}, "roster": {"needAllTable": True}}
_add("log_shard_pattern", lambda s, d: log.select_tables(messages(s, d, ["db", "tbl"]), _RULES, {"roster": ["char_uk_%d"]}).select("log_offset", "target"), rf"""{_M} select log_offset, case db when 'ledger_a' then 'ledger' else db end || '.' || case when db = 'ledger_a' and regexp_matches(tbl, '^int_pk_\d{{2}}$') then 'int_pk' else tbl end as target
from message where (db = 'ledger_a' and regexp_matches(tbl, '^int_pk_\d{{2}}$|^char_\d+$|^char_pk_\d+$')) or (db = 'roster' and not regexp_matches(tbl, '^char_uk_\d+$'))""")
_add("log_txn_markers", lambda s, d: log.markers_to_transactions(messages(s, d, _head).withColumn("source", F.shiftright("log_offset", 44)), "source").select("log_offset", "txn_seq"), f"{_M} select log_offset, sum((rec_type = 5)::int) over (partition by log_offset >> 44 order by log_offset)::bigint as txn_seq from message")
#: A cluster log made of orders: some four entries for an index, terms that grow with it, and truncations back by some indexes in a newer term.
_ENTRIES = ["o_orderkey div 5000 + o_orderkey % 3 as term", "o_orderkey div 4 as log_index", "case when o_orderkey % 97 = 5 then o_orderkey div 4 - o_orderkey % 11 end as rolled_back_to"]
_add("log_cluster_last_writer", lambda s, d: log.last_writer(table(s, d, "orders").selectExpr(*_ENTRIES)), """with e as (select o_orderkey // 5000 + o_orderkey % 3 as term, o_orderkey // 4 as log_index, case when o_orderkey % 97 = 5 then o_orderkey // 4 - o_orderkey % 11 end as r from orders),
w as (select log_index, max(term) as term from e where r is null group by 1) select * from w where not exists (select 1 from e where r is not null and w.log_index > e.r and w.term < e.term)""")
for _name, _desc, _sql in (("log_next_key", False, "min"), ("log_previous_key", True, "max")):
    _add(_name, lambda s, d, desc=_desc: log.neighbour_key(messages(s, d, _keyed), "k", desc), f"{_TOUCH}, v as (select table_id, key, min(log_offset) as first_version, max(log_offset) as last_version from touch where key {'<' if _desc else '>'} 'k' group by all), n as (select table_id, {_sql}(key) as key from v group by 1) select v.* from v join n using (table_id, key)")
_add("log_repeatable_read", lambda s, d: log.visible(messages(s, d, _head), "repeatable read", _MID).select(_HEAD), f"{_M} select {_H} from message m where log_offset <= {_MID} and (txn_id is null or txn_id in (select txn_id from message where rec_type = 6 and txn_id is not null and log_offset <= {_MID}))")
_add("replay_latest", lambda s, d: images.latest_rows(log.committed(messages(s, d, ["txn_id", *_images]))), f"""{_COMMITTED}, part as (select table_meta_id >> 16 as table_id, row_key as k, log_offset, rec_type <> 2 as has, after_img from seen where rec_type in (0, 1, 2, 3)
    union all select table_meta_id >> 16, old_key, log_offset, false, null from seen where rec_type = 1 and length(old_key) > 0 and old_key is distinct from row_key)
select table_id, k as row_key, log_offset, after_img.a, after_img.b, after_img.c, after_img.d, after_img.f from part where k is not null qualify row_number() over (partition by table_id, k order by log_offset desc) = 1 and has""")
_add("replay_as_of", lambda s, d: replay.replay_state(table(s, d, "change_records"), log_ended=True, through=_MID), f"""{_M}, applied as (select * from message where rec_type in (0, 1, 2, 3) and txn_id in (select txn_id from message where rec_type = 6 and log_offset <= {_MID})),
part as (select table_meta_id >> 16 as table_id, row_key, log_offset, rec_type <> 2 as has from applied union all select table_meta_id >> 16, old_key, log_offset, false from applied where rec_type = 1 and length(old_key) > 0 and old_key is distinct from row_key)
select table_id, row_key, log_offset from part where row_key is not null qualify row_number() over (partition by table_id, row_key order by log_offset desc) = 1 and has""")
_OLD = ", ".join(f"case when after_img is null or list_contains(changed, '{c}') then before_img.{c} else after_img.{c} end as old_{c}" for c in _COLS)
_WAS = "case when before_img is not null then {" + ", ".join(f"'{c}': case when after_img is null or list_contains(changed, '{c}') then before_img.{c} else after_img.{c} end" for c in _COLS) + "} end"
_NOW = "case when after_img is not null then {" + ", ".join(f"'{c}': after_img.{c}" for c in _COLS) + "} end"
_FIRSTS = ", ".join(f"case when arg_min(had, log_offset) then arg_min({{'v': was}}, log_offset).v.{c} end as first_{c}" for c in _COLS)
_LASTS = ", ".join(f"case when arg_max(has, log_offset) then arg_max({{'v': now}}, log_offset).v.{c} end as last_{c}" for c in _COLS)
_add("replay_net_change", lambda s, d: images.net_changes(log.committed(messages(s, d, ["txn_id", *_images]))), f"""{_COMMITTED}, dml as (select *, {_WAS} as was_img, {_NOW} as now_img, coalesce(rec_type = 1 and length(old_key) > 0 and old_key is distinct from row_key, false) as moved from seen where rec_type in (0, 1, 2, 3)),
part as (select table_meta_id >> 16 as table_id, row_key as k, log_offset, case when not moved then was_img end as was, now_img as now, not moved and rec_type in (1, 2) as had, rec_type <> 2 as has from dml
    union all select table_meta_id >> 16, old_key, log_offset, was_img, null, true, false from dml where moved)
select table_id, k as row_key, {_FIRSTS}, {_LASTS}, count(*) as n_changes,
    case when arg_min(had, log_offset) then case when arg_max(has, log_offset) then 'update' else 'delete' end else case when arg_max(has, log_offset) then 'insert' else 'none' end end as effect
from part where k is not null group by table_id, k""")
_add("replay_before_image", lambda s, d: images.before_image(messages(s, d, ["rec_type", "changed", "before_img", "after_img"])), f"{_M} select log_offset, {_OLD} from message where rec_type in (1, 2, 3) and before_img is not null")
_add("replay_key_updated", lambda s, d: messages(s, d, ["rec_type", "changed", "before_img", "after_img"]).filter("rec_type = 1").select("log_offset", images.key_updated(F.array(F.lit("a"), F.lit("c"))).alias("v")), f"{_M} select log_offset, coalesce(list_has_any(changed, ['a', 'c']), false) as v from message where rec_type = 1")
_add("replay_changed_columns", lambda s, d: messages(s, d, ["rec_type", "changed", "before_img", "after_img"]).filter("before_img is not null and after_img is not null").select("log_offset", F.array_join(images.changed_columns(_COLS), ",").alias("v")), f"{_M} select log_offset, concat_ws(',', " + ", ".join(f"case when before_img.{c} is distinct from after_img.{c} then '{c}' end" for c in _COLS) + ") as v from message where before_img is not null and after_img is not null")
_add("replay_transactions", lambda s, d: replay.transaction_report(table(s, d, "change_records")), f"""{_M} select txn_id, min(log_offset) as first_offset, max(log_offset) as last_offset, count(*) filter (rec_type in (0, 1, 2, 3)) as n_changes, min(log_offset) filter (rec_type = 6) as commit_offset, min(log_offset) filter (rec_type = 7) as rollback_offset,
    case when count(*) filter (rec_type = 6) > 0 then 'committed' when count(*) filter (rec_type = 7) > 0 then 'rolled_back' else 'open' end as outcome from message where txn_id is not null group by 1""")
_add("replay_watermark", lambda s, d: replay.watermark(table(s, d, "change_records")), f"""{_M}, t as (select min(log_offset) as f, count(*) filter (rec_type in (6, 7)) as e from message where txn_id is not null group by txn_id)
select least((select max(log_offset) from message), coalesce(min(f) filter (e = 0) - 1, 9223372036854775807)) as through from t""")
_add("apply_conflict_edges", lambda s, d: apply.conflict_edges(messages(s, d, ["txn_id", *_keyed])), f"""{_TOUCH}, place as (select txn_id, max(log_offset) as place from message where txn_id is not null group by 1),
k as (select distinct table_id, key, m.txn_id, place from touch join message m using (log_offset) join place p on p.txn_id = m.txn_id),
e as (select txn_id, lag(txn_id) over (partition by table_id, key order by place, txn_id) as after_txn from k) select distinct * from e where after_txn is not null""")
#: The further unique keys of the key shapes of FIXTURES A1, told by the name of the table.
_UNIQUE = {"multi_uk": [["a", "c"], ["a", "b"]], "pk_and_uk": [["a", "c"]], "pk_multi_uk": [["a", "c"], ["a", "b"]]}


def unique_keys(spark, sf_dir) -> DataFrame:
    """table_meta_id, columns: a row for each further unique key of a version."""
    shape = F.regexp_replace(F.lower("tbl"), "_[0-9]+$", "")
    keys = spark.createDataFrame([(s, k) for s, ks in _UNIQUE.items() for k in ks], "shape string, columns array<string>")
    return table(spark, sf_dir, "table_meta").select("table_meta_id", shape.alias("shape")).distinct().join(F.broadcast(keys), "shape").select("table_meta_id", "columns")


_UK_VALUES = lambda of: "to_json(list_transform(cols, lambda x: case x " + " ".join(f"when '{c}' then ({of(c)})::varchar" for c in "abc") + " end))::varchar"
_UK_OLD = lambda c: f"coalesce(before_img.{c}, case when after_img is null or list_contains(changed, '{c}') then before_img.{c} else after_img.{c} end)"
_UK_SHAPES = " ".join(f"when '{s}' then {ks}" for s, ks in _UNIQUE.items())
_add("apply_conflict_edges_unique", lambda s, d: apply.conflict_edges(messages(s, d, ["txn_id", *_images]), unique_keys(s, d)), f"""{_TOUCH}, place as (select txn_id, max(log_offset) as place from message where txn_id is not null group by 1),
shape as (select distinct table_meta_id, regexp_replace(lower(tbl), '_[0-9]+$', '') as shape from table_meta), uk as (select table_meta_id, unnest(case shape {_UK_SHAPES} end) as cols from shape),
hit as (select m.*, cols from message m join uk using (table_meta_id) where rec_type in (0, 1, 2, 3)),
every as (select table_id, '' as idx, key, log_offset from touch
    union all select table_meta_id >> 16, array_to_string(cols, ','), {_UK_VALUES(lambda c: f"after_img.{c}")}, log_offset from hit where after_img is not null
    union all select table_meta_id >> 16, array_to_string(cols, ','), {_UK_VALUES(_UK_OLD)}, log_offset from hit where rec_type <> 0 and before_img is not null),
k as (select distinct table_id, idx, key, m.txn_id, place from every join message m using (log_offset) join place p on p.txn_id = m.txn_id),
e as (select txn_id, lag(txn_id) over (partition by table_id, idx, key order by place, txn_id) as after_txn from k) select distinct * from e where after_txn is not null""")
#: Keys of a segment in the queries of levels.
_SEGMENT = 2_000


def _levels_sql(touched: str) -> str:
    """Levels by walking the waits of each segment; ``touched`` gives k: the keys (table_id, idx, key) of each txn_id with its place."""
    return f"""{touched.replace("with ", "with recursive ", 1)},
size as (select txn_id, place, count(*) as n, count(*) > {_SEGMENT} as alone from k group by 1, 2),
summed as (select *, coalesce(sum(case when alone then 0 else n end) over w, 0) as before, coalesce(sum(alone::int) over w, 0) as after from size window w as (order by place, txn_id rows between unbounded preceding and 1 preceding)),
placed as (select txn_id, alone, min(place) over (partition by after, before // {_SEGMENT}, alone) as segment from summed),
waits as (select distinct txn_id, after_txn from (select k.txn_id, lag(k.txn_id) over (partition by segment, table_id, idx, key order by place, k.txn_id) as after_txn from k join placed p on p.txn_id = k.txn_id where not alone) where after_txn is not null),
walk as (select txn_id, 0 as level from placed union select w.txn_id, level + 1 from walk join waits w on w.after_txn = walk.txn_id)
select txn_id, segment::bigint as segment, max(level)::bigint as level from walk join placed using (txn_id) group by all"""


_KEYS_SQL = f"""{_TOUCH}, place as (select txn_id, max(log_offset) as place from message where txn_id is not null group by 1),
k as (select distinct table_id, '' as idx, key, m.txn_id, place from touch join message m using (log_offset) join place p on p.txn_id = m.txn_id)"""
_add("apply_conflict_levels", lambda s, d: apply.conflict_levels(messages(s, d, ["txn_id", *_keyed]), segment_keys=_SEGMENT), _levels_sql(_KEYS_SQL))
_add("apply_conflict_levels_unique", lambda s, d: apply.conflict_levels(messages(s, d, ["txn_id", *_images]), unique_keys(s, d), _SEGMENT), _levels_sql(SQL["apply_conflict_edges_unique"].split(",\ne as (select")[0]))
_add("apply_ddl_barriers", lambda s, d: apply.ddl_segments(messages(s, d, ["rec_type", "table_meta_id"])), f"{_M} select log_offset, table_meta_id >> 16 as table_id, coalesce(sum((rec_type = 4)::int) over (partition by table_meta_id >> 16 order by log_offset rows between unbounded preceding and 1 preceding), 0)::bigint as segment from message where table_meta_id is not null")
_add("apply_safe_checkpoint", lambda s, d: apply.safe_checkpoint(messages(s, d, _head)), f"{_M}, t as (select min(log_offset) as f, count(*) filter (rec_type in (6, 7)) as e from message where txn_id is not null group by txn_id) select coalesce(min(f) filter (e = 0) - 1, (select max(log_offset) from message)) as position from t")
_add("apply_position_sql", lambda s, d: log.of_types(messages(s, d, _head), (6,)).select("log_offset", apply.position_statement("apply_state", F.col("log_offset"), F.col("txn_id")).alias("statement")), f"{_M} select log_offset, 'INSERT INTO apply_state (`txn`, `position`) VALUES (' || txn_id || ', ' || log_offset || ') ON DUPLICATE KEY UPDATE `position` = ' || log_offset as statement from message where rec_type = 6")


def _lit(c: str, image: str) -> str:
    v = f"{image}.{c}"
    text = {"c": f"'''' || replace(replace({v}, '\\', '\\\\'), '''', '''''') || ''''", "f": f"'''' || strftime({v}, '%Y-%m-%d %H:%M:%S.%f') || ''''"}.get(c, f"{v}::varchar")
    return f"coalesce({text}, 'NULL')"


_TESTS = ", ".join(f"case when list_contains(used, '{c}') then case when before_img.{c} is null then '`{c}` IS NULL' else '`{c}` = ' || {_lit(c, 'before_img')} end end" for c in _COLS)
_SETS = ", ".join(f"case when list_contains(changed, '{c}') then '`{c}` = ' || {_lit(c, 'after_img')} end" for c in _COLS)
_FILLED = "[" + ", ".join(f"case when before_img.{c} is not null then '{c}' end" for c in _COLS) + "]"
_STATEMENT_SQL = f"""{_M}, keyed as (select m.*, coalesce(list_filter(string_split(k.keys, ','), lambda x: length(x) > 0), []) as keys, '`' || db || '`.`' || tbl || '`' as target from message m left join (select table_meta_id, max(key_columns) as keys from table_meta group by 1) k using (table_meta_id) where rec_type in (0, 1, 2, 3)),
chosen as (select *, case when len(keys) > 0 and len(list_filter(keys, lambda x: not list_contains({_FILLED}, x))) = 0 then keys else ['a', 'b', 'c', 'd', 'f'] end as used from keyed),
told as (select log_offset, case
    when rec_type in (0, 3) and after_img is not null then case when rec_type = 3 then 'REPLACE INTO ' else 'INSERT INTO ' end || target || ' (`a`, `b`, `c`, `d`, `f`) VALUES (' || concat_ws(', ', {', '.join(_lit(c, 'after_img') for c in _COLS)}) || ')'
    when rec_type = 1 and after_img is not null and before_img is not null and len(list_filter(changed, lambda x: list_contains(['a', 'b', 'c', 'd', 'f'], x))) > 0 then 'UPDATE ' || target || ' SET ' || concat_ws(', ', {_SETS}) || ' WHERE ' || concat_ws(' AND ', {_TESTS}) || case when used <> keys then ' LIMIT 1' else '' end
    when rec_type = 2 and before_img is not null then 'DELETE FROM ' || target || ' WHERE ' || concat_ws(' AND ', {_TESTS}) || case when used <> keys then ' LIMIT 1' else '' end end as statement from chosen)
select * from told where statement is not null"""
_add("apply_sql_text", lambda s, d: apply.statements(messages(s, d, ["db", "tbl", *_images]), table(s, d, "table_meta")), _STATEMENT_SQL)
_add("apply_where_choice", lambda s, d: messages(s, d, ["rec_type", "changed", "before_img", "after_img"]).filter("before_img is not null").transform(lambda m: m.withColumn("v", apply.literals(m, "before_img"))).select("log_offset", F.array_join(apply.where_columns(F.array(F.lit("a"), F.lit("d")), F.col("v")), ",").alias("v")), f"{_M} select log_offset, case when before_img.a is not null and before_img.d is not null then 'a,d' else 'a,b,c,d,f' end as v from message where before_img is not null")
_add("apply_column_map", lambda s, d: apply.statements(messages(s, d, ["db", "tbl", *_images]).filter("rec_type = 0 and table_meta_id is not null"), table(s, d, "table_meta"), {"a": "id", "c": "code"}), f"{_M} select log_offset, 'INSERT INTO `' || db || '`.`' || tbl || '` (`id`, `b`, `code`, `d`, `f`) VALUES (' || concat_ws(', ', {', '.join(_lit(c, 'after_img') for c in _COLS)}) || ')' as statement from message where rec_type = 0 and after_img is not null and db is not null and tbl is not null")


def _mapped(sql: str, names: dict[str, str]) -> str:
    """The statement SQL with the column names it writes, those in backquotes, replaced by ``names``."""
    for c, name in names.items():
        sql = sql.replace(f"`{c}`", f"`{name}`")
    return sql


_add("apply_column_map_dml", lambda s, d: apply.statements(messages(s, d, ["db", "tbl", *_images]), table(s, d, "table_meta"), {"a": "id", "c": "code"}), _mapped(_STATEMENT_SQL, {"a": "id", "c": "code"}))

# windows over events

_AGGS = lambda: [F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")]
_A = "count(*) as n, sum(value::decimal(18,4)) as total"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events")


_add("win_tumbling", lambda s, d: windows.tumbling(events(s, d), "ts", "1 hour", ["event_type"], _AGGS()), f"select time_bucket(interval 1 hour, ts) as starts, time_bucket(interval 1 hour, ts) + interval 1 hour as ends, event_type, {_A} from events group by 1, 2, 3")
_add("win_sliding", lambda s, d: windows.sliding(events(s, d), "ts", "1 hour", "15 minutes", ["event_type"], _AGGS()), f"with w as (select *, unnest(range(0, 4)) as k from events) select time_bucket(interval 15 minute, ts) - k * interval 15 minute as starts, time_bucket(interval 15 minute, ts) - k * interval 15 minute + interval 1 hour as ends, event_type, {_A} from w group by 1, 2, 3")
_add("win_session", lambda s, d: windows.session(events(s, d), "ts", "2 hours", ["user_id"], _AGGS()), f"with g as (select *, ts - lag(ts) over (partition by user_id order by ts) > interval 2 hour as cut from events), s as (select *, sum(coalesce(cut, false)::int) over (partition by user_id order by ts) as k from g) select min(ts) as starts, max(ts) + interval 2 hour as ends, user_id, {_A} from s group by user_id, k")
_add("win_count_tumbling", lambda s, d: windows.count_tumbling(events(s, d), 100, ["ts", "event_id"], ["event_type"], _AGGS()), f"with o as (select *, (row_number() over (partition by event_type order by ts, event_id) - 1) // 100 as number from events) select event_type, number, {_A} from o group by 1, 2")
_add("win_count_sliding", lambda s, d: windows.count_sliding(events(s, d), 100, 25, ["ts", "event_id"], ["event_type"], _AGGS()), f"with o as (select *, row_number() over (partition by event_type order by ts, event_id) - 1 as i from events), w as (select *, unnest(range(greatest(0, floor((i - 100) / 25)::bigint + 1), i // 25 + 1)) as number from o) select event_type, number, {_A} from w group by 1, 2")
_add("win_transactions", lambda s, d: messages(s, d, _head).filter("txn_id is not null").groupBy("txn_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("starts"), F.max("ts").alias("ends")), f"{_M} select txn_id, count(*) as n, min(ts) as starts, max(ts) as ends from message where txn_id is not null group by 1")
_add("win_chained", lambda s, d: windows.tumbling(windows.tumbling(events(s, d), "ts", "10 minutes", ["event_type"], _AGGS()), "starts", "1 hour", ["event_type"], [F.max("n").alias("most"), F.count(F.lit(1)).alias("n_windows")]), "with w as (select time_bucket(interval 10 minute, ts) as starts, event_type, count(*) as n from events group by 1, 2) select time_bucket(interval 1 hour, starts) as starts, time_bucket(interval 1 hour, starts) + interval 1 hour as ends, event_type, max(n) as most, count(*) as n_windows from w group by 1, 2, 3")
