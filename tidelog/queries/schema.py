"""Queries over schema history: the logged catalog, and rows brought from one version of a table to another."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelog.plans.common import table
from tidelog.queries.log import messages
from tidelog.schema import catalog, ddl

QUERIES: dict = {}
SQL: dict[str, str] = {}
_REG = """with r0 as (select table_meta_id, table_id, version, start_offset, max(lower(db)) as db, max(lower(tbl)) as tbl, bool_and(columns_json is null) as is_drop from table_meta group by 1, 2, 3, 4),
reg as (select *, lead(start_offset) over (partition by table_id order by start_offset, version) as end_offset from r0)"""
_CUT = 387028092977152


def _add(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


_add("ddl_registry", lambda s, d: catalog.registry(table(s, d, "table_meta")), f"{_REG} select * from reg")
_add("ddl_version_at", lambda s, d: catalog.version_at(messages(s, d, ["table_meta_id"]), table(s, d, "table_meta")), f"""{_REG}, msg as (select log_offset, min(table_meta_id) >> 16 as table_id from change_records where log_offset is not null group by 1 having min(table_meta_id) is not null)
select m.log_offset, m.table_id, case when not r.is_drop then r.table_meta_id end as in_force from msg m asof left join reg r on m.table_id = r.table_id and m.log_offset >= r.start_offset""")
_add("ddl_columns", lambda s, d: catalog.columns_of(table(s, d, "table_meta")), """with v as (select table_id, version, max(columns_json) as j from table_meta where columns_json is not null group by 1, 2), e as (select table_id, version, unnest(range(0, json_array_length(j)::bigint))::int as position, j from v)
select table_id, version, json_extract_string(j, '$[' || position || '].name') as name, json_extract_string(j, '$[' || position || '].type') as type, position from e""")
_add("ddl_diff", lambda s, d: catalog.version_differences(table(s, d, "table_meta")), """with v as (select table_id, version, max(columns_json) as j from table_meta group by 1, 2), n as (select table_id, version, lead(version) over (partition by table_id order by version) as nxt from v),
c as (select table_id, version, unnest(range(0, json_array_length(j)::bigint)) as p, j from v where j is not null), col as (select table_id, version, json_extract_string(j, '$[' || p || '].name') as name, json_extract_string(j, '$[' || p || '].type') as type from c),
was as (select c.table_id, n.nxt as version, name, type from col c join n using (table_id, version) where n.nxt is not null), now as (select c.* from col c join n on n.table_id = c.table_id and n.nxt = c.version)
select table_id, version, name, case when w.type is null then 'added' when o.type is null then 'removed' else 'retyped' end as change from now o full join was w using (table_id, version, name) where w.type is distinct from o.type""")
_add("ddl_purge", lambda s, d: catalog.purge(table(s, d, "table_meta"), _CUT), f"{_REG} select * from reg where (end_offset is null or end_offset > {_CUT}) and not (is_drop and end_offset is null and start_offset <= {_CUT})")
_add("ddl_information_schema", lambda s, d: catalog.information_schema(table(s, d, "table_meta")), f'{_REG} select table_meta_id as id, version, start_offset as "checkpoint", db as "schema", tbl as "table", end_offset is null and not is_drop as is_current from reg')

_BASE = "CREATE TABLE shop.part (p_partkey BIGINT NOT NULL PRIMARY KEY, p_name VARCHAR(55), p_brand CHAR(10), p_size INT, p_retailprice DOUBLE, KEY by_brand (p_brand))"


def history(*changes: str) -> tuple[ddl.Table, ddl.Table]:
    """The definition of the part table before and after DDL statements."""
    r = ddl.Registry().script([(1, "CREATE DATABASE shop"), (2, _BASE), *((k + 3, c) for k, c in enumerate(changes))])
    return r.at("shop", "part", 2).table, r.current("shop", "part").table


def _evolved(renamed, *changes):
    def run(s, d):
        old, new = history(*changes)
        rows = table(s, d, "part")
        before = ddl.evolve(rows.filter("p_partkey % 2 = 0").select(*old.names()), old, new, renamed)
        after = ddl.evolve(rows.filter("p_partkey % 2 = 1").select(*old.names()), old, new, renamed)
        return before.unionByName(after)

    return run


_add("evolve_add", _evolved(None, "ALTER TABLE shop.part ADD COLUMN note TEXT FIRST, ADD COLUMN (stock INT UNSIGNED, seen DATE)"), "select null::varchar as note, p_partkey, p_name, p_brand, p_size, p_retailprice, null::bigint as stock, null::date as seen from part")
_add("evolve_drop", _evolved(None, "ALTER TABLE shop.part DROP COLUMN p_brand"), "select p_partkey, p_name, p_size, p_retailprice from part")
_add("evolve_rename", _evolved({"title": "p_name"}, "ALTER TABLE shop.part RENAME COLUMN p_name TO title"), "select p_partkey, p_name as title, p_brand, p_size, p_retailprice from part")
_add("evolve_modify", _evolved(None, "ALTER TABLE shop.part MODIFY p_size BIGINT AFTER p_partkey"), "select p_partkey, p_size::bigint as p_size, p_name, p_brand, p_retailprice from part")
_add("evolve_change", _evolved({"price": "p_retailprice"}, "ALTER TABLE shop.part CHANGE p_retailprice price DECIMAL(12,2)"), "select p_partkey, p_name, p_brand, p_size, p_retailprice::decimal(12,2) as price from part")


def ddl_from_text(spark, sf_dir):
    """The registry that a script of statements gives, as a catalog."""
    statements = [
        "CREATE DATABASE shop DEFAULT CHARACTER SET latin1", _BASE, "CREATE TABLE shop.part2 LIKE shop.part", "ALTER TABLE shop.part ADD COLUMN note TEXT FIRST", "CREATE UNIQUE INDEX u1 ON shop.part (p_name, p_brand)",
        "RENAME TABLE shop.part2 TO shop.part3", "ALTER TABLE shop.part3 RENAME TO shop.part4, DROP PRIMARY KEY", "DROP INDEX u1 ON shop.part", "DROP TABLE IF EXISTS shop.part, shop.nothing",
    ]
    return ddl.Registry().script([(10 * k, text) for k, text in enumerate(statements)]).dataframe(spark).select("table_meta_id", "tbl", "start_offset", "end_offset", "column_count", "key_columns", F.col("columns_json").isNull().alias("is_drop"))


_add("ddl_from_text", ddl_from_text, """select * from (values (65536, 'part', 10, 30, 5, 'p_partkey', false), (65537, 'part', 30, 40, 6, 'p_partkey', false), (65538, 'part', 40, 70, 6, 'p_partkey', false), (65539, 'part', 70, 80, 6, 'p_partkey', false), (65540, 'part', 80, null, 0, null, true),
    (131072, 'part2', 20, 50, 5, 'p_partkey', false), (131073, 'part3', 50, 60, 5, 'p_partkey', false), (131074, 'part4', 60, null, 5, '', false)) t(table_meta_id, tbl, start_offset, end_offset, column_count, key_columns, is_drop)""")
