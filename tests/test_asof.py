import random

import pytest

from tests.conftest import rows
from tidelog.operators.asof import attributes_at

REV = "revision_id long, table_id long, start_offset long, known_offset long"


def brute(events, revisions):
    out = {}
    for t, o in events:
        valid = [(s, k, r) for r, table, s, k in revisions if None not in (table, s, k) and table == t and s <= o]
        known = [v for v in valid if v[1] <= o]
        out[o] = (max(known)[2] if known else None, max(valid)[2] if valid else None)
    return out


@pytest.mark.parametrize("bucket", [3, 20, 10_000])
def test_against_brute_force(spark, bucket):
    rng = random.Random(bucket)
    revisions = [(r, rng.randrange(4), rng.randrange(80), rng.randrange(100)) for r in range(60)]
    revisions += [*revisions[:5], (90, None, 1, 1), (91, 1, None, 1), (92, 1, 1, None), (93, 2, 40, 40), (94, 2, 40, 40)]
    events = [(rng.choice([0, 0, 0, 1, 2, 3, 9, None]), o) for o in range(100)]
    found = attributes_at(spark.createDataFrame(events, "table_id long, log_offset long"), spark.createDataFrame(revisions, REV), bucket_events=bucket)
    assert {r[0]: (r[1], r[2]) for r in rows(found)} == brute(events, revisions)
    only = attributes_at(spark.createDataFrame(events, "table_id long, log_offset long"), spark.createDataFrame(revisions, REV), True, bucket)
    assert {r[0]: (r[1], r[2]) for r in rows(only)} == {o: v for o, v in brute(events, revisions).items() if v[0] != v[1]}


def test_empty(spark):
    none, some = spark.createDataFrame([], "table_id long, log_offset long"), spark.createDataFrame([(1, 5)], "table_id long, log_offset long")
    assert rows(attributes_at(none, spark.createDataFrame([(1, 1, 1, 1)], REV))) == []
    assert rows(attributes_at(some, spark.createDataFrame([], REV))) == [(5, None, None)]
