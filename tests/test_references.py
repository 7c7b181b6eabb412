from tests.conftest import rows
from tidelog.operators import references

CAT = "table_meta_id long, table_id long, version int, start_offset long, columns_json string"


def catalog(spark):
    m = 1 << 16
    return spark.createDataFrame(
        [(m, 1, 0, 0, "[]"), (m, 1, 0, 0, "[]"), (m + 1, 1, 1, 50, "[]"), (m + 2, 1, 2, 80, None), (m + 3, 1, 3, 90, "[]"), (2 * m, 2, 0, 10, "[]"), (None, 1, 9, 1, None), (3 * m, None, 0, 0, "[]")], CAT
    )


def refs(spark, *pairs):
    return spark.createDataFrame(list(pairs), "table_meta_id long, log_offset long")


def test_missing_early_and_dropped(spark):
    m = 1 << 16
    df = refs(spark, (m, 5), (m + 1, 49), (m + 1, 50), (m, 60), (m, 80), (m + 2, 85), (m + 3, 85), (m, 95), (2 * m, 9), (2 * m, 10), (7 * m, 1), (None, 3), (m, 5), (3 * m, 5))
    found = [r.log_offset for r in references.orphan_references(df, catalog(spark)).collect()]
    assert sorted(found) == sorted([49, 80, 85, 85, 9, 1, 5])


def test_empty_catalog_and_log(spark):
    none = spark.createDataFrame([], CAT)
    assert rows(references.orphan_references(refs(spark, (1, 2), (1, 2)), none)) == [(1, 2), (1, 2)]
    assert rows(references.orphan_references(refs(spark), catalog(spark))) == []


def test_counts_for_each_table_and_day(spark):
    import datetime as dt

    m = 1 << 16
    df = spark.createDataFrame([(7 * m, 1, dt.datetime(2024, 1, 1, 5)), (7 * m + 1, 2, dt.datetime(2024, 1, 1, 6)), (7 * m, 3, None), (m, 5, None)], "table_meta_id long, log_offset long, ts timestamp_ntz")
    assert rows(references.orphan_counts(df, catalog(spark))) == [(7, None, 1, 1), (7, dt.date(2024, 1, 1), 2, 2)]


def test_a_lookup_that_is_not_small_is_salted(spark):
    from pyspark.sql import functions as F

    from tidelog.plans.common import lookup_join

    left = spark.createDataFrame([(1, k) for k in range(50)] + [(2, 99), (None, 7)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (3, "c")], "k long, name string")
    for how, n in (("inner", 50), ("left", 52), ("left_semi", 50), ("left_anti", 2)):
        small, salted = (lookup_join(left, right, ["k"], how, F.col("v"), rows=limit) for limit in (10, 1))
        assert rows(small) == rows(salted)
        assert small.count() == n
