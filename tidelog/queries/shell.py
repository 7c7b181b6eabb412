"""The shell's SELECT surface, operators and functions over the star schema, each with its SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from tidelog.functions import scalar, udf
from tidelog.plans.common import table
from tidelog.sql import dialect

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, run, sql: str | None) -> None:
    run.__name__ = name
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


# operators: whole-number and floating operands of lineitem and part

_KEY = "l_orderkey, l_linenumber"
_OPS = {
    "add": ("l_partkey", "l_suppkey", "l_partkey + l_suppkey"),
    "sub": ("l_partkey", "l_suppkey", "l_partkey - l_suppkey"),
    "mul": ("l_partkey", "l_linenumber", "l_partkey * l_linenumber"),
    "intdiv": ("l_partkey - 900", "l_linenumber", "(l_partkey - 900) // l_linenumber"),
    "rem": ("l_partkey - 900", "l_linenumber", "(l_partkey - 900) % l_linenumber"),
    "shl": ("l_suppkey", "l_linenumber", "l_suppkey << l_linenumber"),
    "shr": ("l_partkey", "l_linenumber", "l_partkey >> l_linenumber"),
    "xor": ("l_partkey", "l_suppkey", "xor(l_partkey, l_suppkey)"),
    "bor": ("l_partkey", "l_suppkey", "l_partkey | l_suppkey"),
    "band": ("l_partkey", "l_suppkey", "l_partkey & l_suppkey"),
    "gt": ("l_tax", "l_discount", "l_tax > l_discount"),
    "lt": ("l_tax", "l_discount", "l_tax < l_discount"),
    "ge": ("l_tax", "l_discount", "l_tax >= l_discount"),
    "le": ("l_shipdate", "timestamp_ntz'1996-06-30 00:00:00'", "l_shipdate <= timestamp '1996-06-30 00:00:00'"),
    "eq": ("l_returnflag", "l_linestatus", "l_returnflag = l_linestatus"),
    "ne": ("l_linenumber", "3", "l_linenumber <> 3"),
    "and": ("l_tax > 0.02", "l_discount > 0.05", "l_tax > 0.02 and l_discount > 0.05"),
    "or": ("l_tax > 0.02", "l_discount > 0.05", "l_tax > 0.02 or l_discount > 0.05"),
}


def _operator(op: str, left: str, right: str):
    def run(spark, sf_dir):
        df = table(spark, sf_dir, "lineitem")
        return df.select("l_orderkey", "l_linenumber", scalar.binary(df, op, left, right).alias("v"))

    return run


for _op, (_a, _b, _text) in _OPS.items():
    _add(f"op_{_op}", _operator(_op, _a, _b), f"select {_KEY}, {_text} as v from lineitem")
for _op, _a, _text in (("bnot", "l_partkey", "~l_partkey"), ("not", "l_tax > 0.02", "not (l_tax > 0.02)")):
    _add(f"op_{_op}", lambda spark, d, o=_op, a=_a: table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.UNARY[o](F.expr(a)).alias("v")), f"select {_KEY}, {_text} as v from lineitem")
_add("op_ternary", lambda spark, d: table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", scalar.conditional(F.col("l_quantity") > 25, F.lit("bulk"), F.col("l_returnflag")).alias("v")), f"select {_KEY}, case when l_quantity > 25 then 'bulk' else l_returnflag end as v from lineitem")

_FUNCTIONS = {
    "concat": ("customer", "c_custkey", lambda: scalar.concat_strict(F.col("c_name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))), "c_name || case when c_acctbal > 0 then c_mktsegment end"),
    "concat_ws": ("customer", "c_custkey", lambda: scalar.concat_ws("/", F.col("c_name"), F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))), "concat_ws('/', c_name, case when c_acctbal > 0 then c_mktsegment end)"),
    "greatest": ("part", "p_partkey", lambda: scalar.greater(F.col("p_size") * 40, F.col("p_retailprice")), "greatest(p_size * 40, p_retailprice)"),
    "least": ("part", "p_partkey", lambda: scalar.lesser(F.col("p_size") * 40, F.col("p_retailprice")), "least(p_size * 40, p_retailprice)"),
    "abs": ("customer", "c_custkey", lambda: F.abs("c_acctbal"), "abs(c_acctbal)"),
    "ascii": ("customer", "c_custkey", lambda: scalar.ascii_code(F.col("c_mktsegment")).cast("long"), "ascii(c_mktsegment)::bigint"),
    "char_length": ("part", "p_partkey", lambda: scalar.char_length(F.col("p_name")).cast("long"), "length(p_name)"),
    "char_length_utf16": ("part", "p_partkey", lambda: scalar.char_length(scalar.convert_charset(F.encode("p_name", "UTF-8"), "UTF-8", "UTF-16LE"), "UTF-16LE").cast("long"), "length(p_name)"),
    "field": ("customer", "c_custkey", lambda: scalar.field(F.col("c_mktsegment"), F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("HOUSEHOLD")), "coalesce(list_position(['BUILDING', 'MACHINERY', 'HOUSEHOLD'], c_mktsegment), 0)::bigint"),
    "char_length_gbk": ("customer", "c_custkey", lambda: scalar.char_length(scalar.encode_charset(F.concat("c_name", F.lit("数据流é")), "gbk"), "gbk").cast("long"), "length(c_name || '数据流é')"),
    "char_length_sjis": ("customer", "c_custkey", lambda: scalar.char_length(scalar.encode_charset(F.concat("c_name", F.lit("潮の流れ")), "sjis"), "sjis").cast("long"), "length(c_name || '潮の流れ')"),
    "char_length_ujis": ("customer", "c_custkey", lambda: scalar.char_length(scalar.convert_charset(F.encode(F.concat("c_name", F.lit("潮の流れ")), "UTF-8"), "utf8mb4", "ujis"), "ujis").cast("long"), "length(c_name || '潮の流れ')"),
    "compare_nocase": ("customer", "c_custkey", lambda: scalar.compare_text(F.col("c_mktsegment"), F.lit("Building")) == 0, "lower(c_mktsegment) = 'building'"),
    "compare_order": ("nation", "n_nationkey", lambda: scalar.compare_text(F.col("n_name"), F.lit("jAPAN")), "(case when lower(n_name) < 'japan' then -1 when lower(n_name) = 'japan' then 0 else 1 end)::int"),
    "now": ("region", "r_regionkey", lambda: F.current_timestamp().isNotNull(), "now() is not null"),
    "offset_pack": ("orders", "o_orderkey", lambda: scalar.pack_offset(F.col("o_custkey"), F.col("o_orderkey")), "o_custkey * 17592186044416 + o_orderkey"),
    "enum": ("part", "p_partkey", lambda: scalar.enum_value(F.col("p_size") % 5, F.array(F.lit("low"), F.lit("mid"), F.lit("high"))), "case p_size % 5 when 0 then '' when 1 then 'low' when 2 then 'mid' when 3 then 'high' end"),
    "set": ("part", "p_partkey", lambda: F.concat_ws(",", scalar.set_values(F.col("p_size"), F.array(*(F.lit(c) for c in "abcdef")))), "array_to_string(list_filter(['a','b','c','d','e','f'], lambda v, i: ((p_size >> (i - 1)::int) & 1) = 1), ',')"),
    "year": ("part", "p_partkey", lambda: scalar.year_value(F.col("p_size")), "case when p_size = 0 then 0 else p_size + 1900 end"),
    "time_micros": ("part", "p_partkey", lambda: scalar.time_micros(F.col("p_size"), F.lit(7), F.lit(9), F.lit(11), F.col("p_partkey") % 2 == 1), "case when p_partkey % 2 = 1 then -1 else 1 end * (((p_size::bigint * 60 + 7) * 60 + 9) * 1000000 + 11)"),
    "bit": ("part", "p_partkey", lambda: scalar.bit_number(F.unhex(F.hex(F.col("p_size").cast("long")))).cast("long"), "p_size::bigint"),
    "render_text": ("part", "p_partkey", lambda: F.concat_ws(",", scalar.literal_text(F.col("p_name"), "text"), scalar.literal_text(F.col("p_size"), "number"), scalar.literal_text(F.encode("p_brand", "UTF-8"), "bytes")), "'''' || p_name || ''',' || p_size || ',0x' || hex(p_brand)"),
}
for _n, (_t, _k, _f, _text) in _FUNCTIONS.items():
    _add(f"fn_{_n}", lambda spark, d, t=_t, k=_k, f=_f: table(spark, d, t).select(k, f().alias("v")), f"select {_k}, {_text} as v from {_t}")
_add("fn_offset_unpack", lambda spark, d: table(spark, d, "change_records").select("delivery_id", scalar.offset_file(F.col("log_offset")).alias("file"), scalar.offset_position(F.col("log_offset")).alias("pos")), "select delivery_id, log_offset >> 44 as file, log_offset & 17592186044415 as pos from change_records")
_add("fn_meta_unpack", lambda spark, d: table(spark, d, "table_meta").select("table_meta_id", scalar.table_of(F.col("table_meta_id")).alias("t"), scalar.version_of(F.col("table_meta_id")).alias("v")), "select table_meta_id, table_meta_id >> 16 as t, (table_meta_id & 65535)::int as v from table_meta")

# statements: the text runs through the dialect's rewriter

_D = "cast({} as decimal(18,2))"
PARTITIONS = {"orders": {"p1995": "year(o_orderdate) = 1995", "p1996": "year(o_orderdate) = 1996"}}
_STATEMENTS: dict[str, tuple[str, str | None]] = {
    "op_in": ("SELECT l_orderkey, l_linenumber, l_linenumber IN (1, 3) AS v FROM lineitem", None),
    "op_notin": ("SELECT l_orderkey, l_linenumber, l_linenumber NOT IN (1, 3) AS v FROM lineitem", None),
    "op_symbols": (
        "SELECT l_orderkey, l_linenumber, (l_tax > 0.02 && !(l_discount == 0.05)) || l_linenumber <> 2 AS v, l_quantity > 25 ? 'bulk' : 'few' AS size FROM lineitem # both kinds",
        "select l_orderkey, l_linenumber, (l_tax > 0.02 and not (l_discount = 0.05)) or l_linenumber <> 2 as v, case when l_quantity > 25 then 'bulk' else 'few' end as size from lineitem",
    ),
    "op_precedence": ("SELECT l_orderkey, l_linenumber, 7 - l_suppkey * l_linenumber % 11 + -(l_partkey - 40) * (2 + l_linenumber) AS v, l_linenumber + 1 > 3 && l_suppkey < 9 || !(l_partkey = 12) AS w FROM lineitem", "select l_orderkey, l_linenumber, 7 - ((l_suppkey * l_linenumber) % 11) + (-(l_partkey - 40)) * (2 + l_linenumber) as v, ((l_linenumber + 1) > 3 and l_suppkey < 9) or not (l_partkey = 12) as w from lineitem"),
    "op_literals": ("SELECT r_regionkey, -40700612 AS a, 77.5e-1 AS b, 'tide''s' AS c, \"high water\" AS d, DATE '2023-11-05' AS e FROM region -- end", "select r_regionkey, -40700612 as a, 7.75::double as b, 'tide''s' as c, 'high water' as d, date '2023-11-05' as e from region"),
    "fn_rowmax": ("SELECT p_partkey, MAX(p_size, 25) AS a, MIN(p_size, 25) AS b, FIELD(p_size, 3, 7, 9) AS c FROM part", "select p_partkey, greatest(p_size, 25) as a, least(p_size, 25) as b, coalesce(list_position([3, 7, 9], p_size), 0)::bigint as c from part"),
    "agg_max": ("SELECT l_returnflag, MAX(l_quantity) AS v, MAX(l_shipdate) AS d FROM lineitem GROUP BY l_returnflag", None),
    "agg_min": ("SELECT l_returnflag, MIN(l_quantity) AS v, MIN(l_extendedprice) AS p FROM lineitem GROUP BY l_returnflag", None),
    "agg_sum": ("SELECT l_suppkey, SUM(l_partkey) AS v, SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS p FROM lineitem GROUP BY l_suppkey", "select l_suppkey, sum(l_partkey)::bigint as v, sum(l_extendedprice::decimal(18,2)) as p from lineitem group by l_suppkey"),
    "agg_avg": ("SELECT l_returnflag, ROUND(AVG(l_quantity), 4) AS v FROM lineitem GROUP BY l_returnflag", None),
    "agg_avg_whole": ("SELECT l_returnflag, SUM(l_partkey) DIV COUNT(1) AS v FROM lineitem GROUP BY l_returnflag", "select l_returnflag, (sum(l_partkey) // count(*))::bigint as v from lineitem group by l_returnflag"),
    "agg_count": ("SELECT o_orderstatus, COUNT(1) AS v FROM orders GROUP BY o_orderstatus", None),
    "agg_count_col": ("SELECT rec_type, COUNT(row_key) AS v, COUNT(1) AS n FROM change_records GROUP BY rec_type", None),
    "agg_global": ("SELECT COUNT(1) AS n, MAX(o_orderdate) AS d, MIN(o_totalprice) AS p FROM orders", None),
    "agg_having": ("SELECT l_partkey, COUNT(1) AS n FROM lineitem GROUP BY l_partkey HAVING COUNT(1) > 30 && MAX(l_tax) > 0.05", "select l_partkey, count(*) as n from lineitem group by l_partkey having count(*) > 30 and max(l_tax) > 0.05"),
    "agg_group_expr": ("SELECT YEAR(o_orderdate) AS y, o_custkey % 7 AS k, COUNT(1) AS n FROM orders GROUP BY YEAR(o_orderdate), o_custkey % 7", "select year(o_orderdate)::int as y, o_custkey % 7 as k, count(*) as n from orders group by 1, 2"),
    "agg_in_expr": ("SELECT l_returnflag, MAX(l_quantity) - MIN(l_quantity) + COUNT(1) AS v FROM lineitem GROUP BY l_returnflag", None),
    "agg_distinct": ("SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS v FROM lineitem GROUP BY l_returnflag", None),
    "agg_cube": ("SELECT l_returnflag, l_linestatus, COUNT(1) AS v, MAX(l_quantity) AS q FROM lineitem GROUP BY CUBE(l_returnflag, l_linestatus)", None),
    "agg_grouping_sets": ("SELECT l_returnflag, l_linestatus, COUNT(1) AS v FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())", None),
    "agg_approx_distinct": ("SELECT l_returnflag, APPROX_COUNT_DISTINCT(l_orderkey) BETWEEN 0.85 * COUNT(DISTINCT l_orderkey) AND 1.15 * COUNT(DISTINCT l_orderkey) AS near FROM lineitem GROUP BY l_returnflag", "select l_returnflag, true as near from lineitem group by l_returnflag"),
    "join_full": ("SELECT c_custkey, o_orderkey FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c FULL OUTER JOIN (SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 150000) o ON c_custkey = o_custkey", None),
    "op_div_text": (
        "SELECT l_orderkey, l_linenumber, l_partkey / l_linenumber AS a, -l_suppkey / 4 * 2 AS b, (l_partkey / 3) / (l_linenumber / 2 + 1) AS c, l_quantity / 4 AS d, ABS(l_suppkey) / 7 + 6 / 4 AS e FROM lineitem WHERE l_partkey / 10 > 2",
        "select l_orderkey, l_linenumber, (l_partkey // l_linenumber)::bigint as a, (-(l_suppkey // 4) * 2)::bigint as b, ((l_partkey // 3) // (l_linenumber // 2 + 1))::bigint as c, l_quantity / 4 as d, (l_suppkey // 7 + 1)::bigint as e from lineitem where l_partkey // 10 > 2",
    ),
    "agg_div_group": ("SELECT l_suppkey / 3 AS g, SUM(l_linenumber) / COUNT(1) AS v FROM lineitem GROUP BY l_suppkey / 3", "select (l_suppkey // 3)::bigint as g, (sum(l_linenumber) // count(*))::bigint as v from lineitem group by 1"),
    "sel_limit_nested": (
        "SELECT o_orderkey, k FROM (SELECT o_orderkey, o_custkey AS k FROM orders ORDER BY o_orderkey LIMIT 5, 100) a JOIN (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10, 500) b ON k = c_custkey ORDER BY o_orderkey LIMIT 1, 30",
        "select o_orderkey, k from (select o_orderkey, o_custkey as k from orders order by o_orderkey limit 100 offset 5) a join (select c_custkey from customer order by c_custkey limit 500 offset 10) b on k = c_custkey order by o_orderkey limit 30 offset 1",
    ),
    "agg_rollup": ("SELECT l_returnflag, l_linestatus, COUNT(1) AS v FROM lineitem GROUP BY ROLLUP(l_returnflag, l_linestatus)", None),
    "join_inner": ("SELECT o_orderkey, c_name FROM orders INNER JOIN customer ON o_custkey = c_custkey", None),
    "join_cross": ("SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_straight": ("SELECT c_custkey, n_name FROM customer STRAIGHT_JOIN nation ON c_nationkey = n_nationkey", "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey"),
    "join_left": ("SELECT c_custkey, o_orderkey FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'", None),
    "join_right": ("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON c_custkey = o_custkey AND o_totalprice > 300000", None),
    "join_natural": ("SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) n NATURAL JOIN (SELECT r_name, r_regionkey AS k FROM region) r", None),
    "join_natural_left": ("SELECT n_name, s_name FROM (SELECT n_name, n_nationkey AS k FROM nation) n NATURAL LEFT OUTER JOIN (SELECT s_name, s_nationkey AS k FROM supplier WHERE s_acctbal > 9000) s", None),
    "join_natural_right": ("SELECT n_name, s_name FROM (SELECT s_name, s_nationkey AS k FROM supplier WHERE s_acctbal > 9000) s NATURAL RIGHT JOIN (SELECT n_name, n_nationkey AS k FROM nation) n", None),
    "join_using": ("SELECT k, a.n, b.m FROM (SELECT l_partkey AS k, COUNT(1) AS n FROM lineitem GROUP BY l_partkey) a JOIN (SELECT p_partkey AS k, p_size AS m FROM part) b USING (k)", None),
    "join_theta": ("SELECT s.s_suppkey, n.n_nationkey FROM supplier s JOIN nation n ON s.s_nationkey > n.n_nationkey AND s.s_suppkey % 5 = n.n_regionkey", None),
    "join_multiway": ("SELECT r_name, COUNT(1) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name", None),
    "join_derived": ("SELECT c_custkey, t.n FROM customer JOIN (SELECT o_custkey, COUNT(1) AS n FROM orders GROUP BY o_custkey) t ON t.o_custkey = c_custkey", None),
    "join_lateral": ("SELECT r_name, t.n FROM region, LATERAL (SELECT COUNT(1) AS n FROM nation WHERE n_regionkey = r_regionkey) t", None),
    "join_oj_escape": ("SELECT c_custkey, o_orderkey FROM {OJ customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'}", "select c_custkey, o_orderkey from customer left join orders on c_custkey = o_custkey and o_orderstatus = 'P'"),
    "join_semi": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')", None),
    "join_anti": ("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    "sel_alias": ("SELECT o_orderkey AS k, o_totalprice p, k % 10 AS digit FROM orders", "select o_orderkey as k, o_totalprice as p, o_orderkey % 10 as digit from orders"),
    "sel_where": ("SELECT o_orderkey FROM orders o WHERE o.o_totalprice > 100000 && o_orderpriority != '1-URGENT'", "select o_orderkey from orders where o_totalprice > 100000 and o_orderpriority <> '1-URGENT'"),
    "sel_order_by": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey", None),
    "sel_limit": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20", None),
    "sel_limit_comma": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 10, 20", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 20 offset 10"),
    "sel_limit_offset": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 10", None),
    "sel_topk": ("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 50", None),
    "sel_comma_from": ("SELECT n_name, r_name FROM nation, (region) WHERE n_regionkey = r_regionkey", "select n_name, r_name from nation, region where n_regionkey = r_regionkey"),
    "sel_partition": ("SELECT o_orderkey FROM orders PARTITION (p1995, p1996) WHERE o_orderstatus = 'F'", "select o_orderkey from orders where year(o_orderdate) in (1995, 1996) and o_orderstatus = 'F'"),
    "sel_index_hints": ("SELECT o_orderkey FROM orders USE INDEX FOR ORDER BY (i1, i2) IGNORE KEY (i3) WHERE o_totalprice > 1000 ORDER BY o_orderkey", "select o_orderkey from orders where o_totalprice > 1000"),
}


def _statement(text: str):
    def run(spark, sf_dir):
        used = [t for t in (*TABLES, "change_records") if t in text]
        return dialect.select(spark, text, {t: table(spark, sf_dir, t) for t in used}, PARTITIONS)

    return run


for _n, (_mine, _theirs) in _STATEMENTS.items():
    _add(_n, _statement(_mine), _theirs or _mine)


# user functions


def udf_row(spark, sf_dir):
    udf.register_row(spark, "area", lambda a, b: a * b, "bigint", ("bigint", "bigint"))
    name = udf.resolve("area", ("bigint", "int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.call_function(name, F.col("l_partkey"), F.col("l_linenumber").cast("bigint")).alias("v"))


def udf_group(spark, sf_dir):
    """A user aggregate: only each group's own values meet in a task; where that is too much, a built-in aggregate is the way."""
    def spread(v: pd.Series) -> int:
        return int(v.max() - v.min())

    udf.register_group(spark, "spread", spread, "bigint", ("int",))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.call_function(udf.resolve("spread", ("int",)), F.col("p_size")).alias("v"))


class _Digits:
    def eval(self, number: int):
        for k, digit in enumerate(str(number)):
            yield k, int(digit)


def udf_table(spark, sf_dir):
    udf.register_table(spark, "digits", _Digits, "place: int, digit: int")
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql("SELECT c_custkey, d.place, d.digit FROM customer, LATERAL digits(c_custkey) d")


_add("udf_row", udf_row, "select l_orderkey, l_linenumber, l_partkey * l_linenumber as v from lineitem")
_add("udf_group", udf_group, "select p_brand, (max(p_size) - min(p_size))::bigint as v from part group by 1")
_add("udf_table", udf_table, "with d as (select c_custkey, unnest(range(0, length(c_custkey::varchar)::bigint))::int as place from customer) select c_custkey, place, substr(c_custkey::varchar, place + 1, 1)::int as digit from d")
_add("fn_hash", lambda spark, d: table(spark, d, "customer").select("c_custkey", F.crc32("c_name").alias("crc"), scalar.bucket(F.col("c_name"), F.col("c_nationkey")).alias("hash")), None)
