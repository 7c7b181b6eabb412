import random

import pytest

from tests.conftest import rows
from tidelog.operators import replay

SCHEMA = "delivery_id long, record_id long, log_offset long, txn_id long, rec_type int, table_meta_id long, row_key string, old_key string, extra string"


def log(spark, *changes):
    """(offset, txn, type, key, old) in order of delivery."""
    return spark.createDataFrame([(k, o, o, t, r, 65536, key, old, None) for k, (o, t, r, key, old) in enumerate(changes)], SCHEMA)


def state(df):
    return {(r.table_id, r.row_key): r.log_offset for r in df.collect()}


def test_only_committed_changes_count_in_log_order(spark):
    df = log(spark, (5, 1, 6, None, None), (3, 1, 1, "b", "a"), (2, 1, 0, "a", None), (1, 1, 5, None, None), (6, 2, 0, "z", None), (7, 3, 0, "y", None), (8, 3, 7, None, None))
    assert state(replay.replay_state(df, log_ended=True)) == {(1, "b"): 3}


def test_a_key_used_again_after_its_delete(spark):
    df = log(spark, (1, 1, 0, "a", None), (2, 1, 2, "a", None), (3, 1, 3, "a", None), (4, 1, 0, "b", None), (5, 1, 2, "b", None), (9, 1, 6, None, None))
    assert state(replay.replay_state(df, log_ended=True)) == {(1, "a"): 3}


def test_the_first_delivery_of_a_message_counts(spark):
    df = spark.createDataFrame([(2, 1, 1, None, 0, 65536, "late", None, None), (1, 1, 1, 1, 0, 65536, "a", None, None), (3, 2, 2, 1, 6, None, None, None, None), (1, 1, 1, 1, 0, 65536, "a", None, None)], SCHEMA)
    assert state(replay.replay_state(df, log_ended=True)) == {(1, "a"): 1}


def test_nulls_and_empty_old_keys(spark):
    df = log(spark, (1, 1, 0, None, None), (2, 1, 0, "a", None), (3, 1, 1, "a", ""), (4, 1, 1, None, "a"), (5, 1, 0, "c", None), (6, 1, 6, None, None), (None, 1, 0, "n", None), (8, None, 0, "m", None))
    assert state(replay.replay_state(df, log_ended=True)) == {(1, "c"): 5}


def test_empty_log(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert rows(replay.replay_state(df, log_ended=True)) == []
    assert rows(replay.replay_state(df)) == []
    assert replay.watermark(df).first().through is None


def test_state_waits_for_open_transactions_and_gaps(spark):
    changes = [(1, 1, 0, "a", None), (2, 1, 6, None, None), (3, 2, 0, "b", None), (4, 3, 0, "c", None), (5, 3, 6, None, None)]
    assert replay.watermark(log(spark, *changes)).first().through == 2
    assert state(replay.replay_state(log(spark, *changes))) == {(1, "a"): 1}
    closed = [*changes, (6, 2, 7, None, None)]
    assert state(replay.replay_state(log(spark, *closed))) == {(1, "a"): 1, (1, "c"): 4}
    gap = [c for c in closed if c[0] != 4]
    assert replay.watermark(log(spark, *gap)).first().through == 3
    assert state(replay.replay_state(log(spark, *gap))) == {(1, "a"): 1}


@pytest.mark.parametrize("missing", [[7], [16], [17], [7, 40], [32, 33], []])
def test_first_gap_over_buckets(spark, missing):
    numbers = [n for n in range(3, 60) if n not in missing]
    df = spark.createDataFrame([(n, n * 10) for n in numbers], "record_id long, log_offset long")
    found = [r.held_after for r in replay.first_gap(df, bucket_rows=8).collect()]
    assert found == ([(min(missing) - 1) * 10] if missing else [])


def test_a_gap_of_any_width_costs_nothing(spark):
    df = spark.createDataFrame([(1, 10), (2, 20), (10**17, 30), (10**17 + 1, 40), (None, 50)], "record_id long, log_offset long")
    assert [r.held_after for r in replay.first_gap(df).collect()] == [20]


def test_random_logs_equal_a_model(spark):
    rng = random.Random(3)
    for _ in range(3):
        changes, model, pending = [], {}, {}
        for o in range(1, 300):
            txn = rng.randrange(12)
            kind = rng.choice([0, 0, 1, 1, 2, 3, 6, 7])
            key, old = (str(rng.randrange(15)) for _ in range(2))
            changes.append((o, txn * 1000 + pending.setdefault(("n", txn), 0), kind, key if kind < 4 else None, old if kind == 1 and rng.random() < 0.4 else None))
            if kind in (6, 7):
                pending[("n", txn)] += 1
        done = {c[1] for c in changes if c[2] == 6}
        for o, txn, kind, key, old in changes:
            if kind < 4 and txn in done:
                if kind == 2:
                    model.pop((1, key), None)
                else:
                    if old and old != key:
                        model.pop((1, old), None)
                    model[(1, key)] = o
        rng.shuffle(changes)
        assert state(replay.replay_state(log(spark, *changes), log_ended=True)) == model


def test_the_registered_queries_wait_for_a_missing_record(spark, tmp_path):
    from tidelog.queries import queries

    changes = [(1, 1, 0, "a", None), (2, 1, 6, None, None), (3, 2, 0, "b", None), (4, 2, 6, None, None), (5, 3, 0, "c", None), (6, 3, 6, None, None)]
    log(spark, *(c for c in changes if c[0] != 3)).write.parquet(str(tmp_path / "change_records.parquet"))
    assert queries()["replay_watermark"](spark, str(tmp_path)).first().through == 2
    assert state(queries()["p1_watermarked"](spark, str(tmp_path))) == {(1, "a"): 1}
