"""Holds queries against their SQL in DuckDB."""

import os
from collections import Counter

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in os.listdir(sf_dir):
        con.sql(f"create view {name.split('.')[0]} as select * from '{sf_dir}/{name}'")
    return con


def plain(value):
    if value is None:
        return None
    if hasattr(value, "tzinfo"):
        value = value.replace(tzinfo=None)
    return repr(value) if isinstance(value, float) else str(value)


def table(arrow):
    arrow = arrow.read_all() if hasattr(arrow, "read_all") else arrow
    names = sorted(arrow.column_names)
    return names, Counter(zip(*([plain(v) for v in arrow.column(n).to_pylist()] for n in names), strict=True))


def assert_same(spark_df, con, sql):
    mine, theirs = table(spark_df.toArrow()), table(con.sql(sql).arrow())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1], (list((mine[1] - theirs[1]).items())[:3], list((theirs[1] - mine[1]).items())[:3])
