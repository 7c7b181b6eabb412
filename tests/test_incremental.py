import pytest

from tests.conftest import rows
from tidelog.operators import incremental

RUNS = "consumer_id long, run_id long, first_delivery_id long, last_delivery_id long, status string, reported_at timestamp_ntz"


def runs(spark, *reports):
    import datetime as dt

    return spark.createDataFrame([(c, r, a, z, s, None if t is None else dt.datetime(2024, 1, 1, t)) for c, r, a, z, s, t in reports], RUNS)


def changes(spark, *deliveries):
    return spark.createDataFrame(list(deliveries), "delivery_id long, log_offset long")


def test_latest_report_decides(spark):
    r = runs(spark, (1, 1, 1, 2, "started", 1), (1, 1, 1, 2, " Succeeded ", 2), (1, 2, 3, 4, "succeeded", 1), (1, 2, 3, 4, "REVOKED", 3), (1, 3, 5, 5, "succeeded", None))
    c = changes(spark, *((k, k * 10) for k in range(1, 7)))
    assert rows(incremental.pending_messages(c, r)) == [(1, 30), (1, 40), (1, 60)]


def test_any_delivery_in_a_finished_range_suffices(spark):
    r = runs(spark, (1, 1, 1, 2, "succeeded", 1), (2, 2, 9, 9, "succeeded", 1), (3, 3, 1, 99, "failed", 1))
    c = changes(spark, (1, 10), (3, 10), (3, 10), (4, 20), (5, 20), (None, 30), (6, None))
    assert rows(incremental.pending_messages(c, r)) == [(1, 20), (2, 10), (2, 20), (3, 10), (3, 20)]


def test_overlapping_and_reversed_ranges(spark):
    r = runs(spark, (1, 1, 1, 5, "succeeded", 1), (1, 2, 2, 3, "succeeded", 1), (1, 3, 5, 7, "succeeded", 1), (1, 4, 9, 8, "succeeded", 1), (1, 5, None, 20, "succeeded", 1), (1, 6, 50, 60, "succeeded", 1))
    done = incremental.finished_runs(r).selectExpr("consumer_id", "'' as part", "first_delivery_id as lo", "last_delivery_id as hi")
    spans = spark.createDataFrame([(1, "", 0, 10), (2, "", 0, 10)], done.schema)
    assert rows(incremental.open_ranges(done, spans)) == [(1, "", 0, 0), (1, "", 8, 10), (2, "", 0, 10)]


def test_empty(spark):
    assert rows(incremental.pending_messages(changes(spark), runs(spark, (1, 1, 1, 5, "succeeded", 1)))) == []
    assert rows(incremental.pending_messages(changes(spark, (1, 1)), runs(spark))) == []


def test_wide_positions_are_cut_by_density(spark):
    c = changes(spark, *((k * 10**12, k) for k in range(1, 200)))
    r = runs(spark, (1, 1, 0, 150 * 10**12, "succeeded", 1))
    assert rows(incremental.pending_messages(c, r)) == [(1, k) for k in sorted(range(151, 200), key=lambda k: repr((1, k)))]


def log(spark, *records):
    return spark.createDataFrame(list(records), "source_partition string, position long, log_offset long, record_id long")


def runner(spark, root):
    from pyspark.sql import functions as F

    return incremental.IncrementalRun(spark, str(root), position="position", partition=F.col("source_partition"), bucket=F.floor(F.col("log_offset") / 5))


def sunk(run):
    return {(r.record_id, r.log_offset): r.batch for r in run.sink().collect()}


@pytest.mark.parametrize("fault", ["plan", "sink"])
def test_a_failed_run_is_replayed_as_planned(spark, tmp_path, fault):
    run = runner(spark, tmp_path)
    first = log(spark, ("a", 1, 1, 1), ("a", 2, 2, 2), ("b", 7, 7, 3), (None, 1, 1, 9))
    assert run.run(first) == 1
    assert run.run(first) is None
    more = first.unionAll(log(spark, ("a", 3, 3, 4), ("b", 8, 8, 5)))
    for _ in range(2):  # lost twice
        with pytest.raises(RuntimeError):
            runner(spark, tmp_path).run(more, fail_after=fault)
    later = more.unionAll(log(spark, ("a", 4, 4, 6)))
    again = runner(spark, tmp_path)  # after a restart
    assert again.plan(later)["until"]["a"] == 3
    assert again.run(later) == 2
    assert again.run(later) == 3
    assert again.run(later) is None
    assert again.committed() == {"": 1, "a": 4, "b": 8}
    assert sunk(again) == {(1, 1): 1, (2, 2): 1, (3, 7): 1, (4, 3): 2, (5, 8): 2, (6, 4): 3, (9, 1): 1}


@pytest.mark.parametrize("folder", ["plans", "commits"])
def test_a_torn_control_file_blocks_nothing(spark, tmp_path, folder):
    run, first = runner(spark, tmp_path), log(spark, ("a", 1, 1, 1))
    (tmp_path / folder).mkdir()
    (tmp_path / folder / "1.json").write_text('{"batch": 1, ')  # its writer was lost
    assert run.run(first) is not None
    assert run.run(first) is None
    assert run.sink().count() == 1


def test_two_drivers_cannot_both_commit(spark, tmp_path):
    from tidelog.plans.files import put_once

    put_once(spark, f"{tmp_path}/commits/1.json", "{}")
    with pytest.raises(FileExistsError):
        put_once(spark, f"{tmp_path}/commits/1.json", "{}")


def test_copies_are_written_once(spark, tmp_path):
    run = runner(spark, tmp_path)
    run.run(log(spark, ("a", 1, 1, 1), ("a", 2, 1, 1), ("a", 3, None, None), ("b", 3, None, None)))
    run.run(log(spark, ("a", 1, 1, 1), ("b", 5, 1, 1), ("a", 4, 9, 2), ("a", 5, None, None)))  # the same record by another way, and again
    assert sunk(run) == {(1, 1): 1, (None, None): 1, (2, 9): 2}


def test_buckets_of_any_name(spark, tmp_path):
    from pyspark.sql import functions as F

    run = incremental.IncrementalRun(spark, str(tmp_path), ("name",), "position", bucket=F.col("name"))
    made = lambda at: spark.createDataFrame([(at + k, n) for k, n in enumerate(["a/b:c %", "", None, "x=1"])], "position long, name string")
    assert [run.run(made(1)), run.run(made(1).unionAll(made(11)))] == [1, 2]
    assert {(r.name, r.batch) for r in run.sink().collect()} == {("a/b:c %", 1), ("", 1), (None, 1), ("x=1", 1)}


def test_records_that_land_late_come_in_the_next_batch(spark, tmp_path):
    run = runner(spark, tmp_path)
    first = log(spark, ("a", 1, 5, 1), ("a", 2, 9, 2), ("b", 1, 7, 3))
    assert run.run(first) == 1
    late = first.unionAll(log(spark, ("a", 3, 3, 4), ("a", 4, 6, 5), ("b", 2, None, 6), ("a", 5, 9, 2), ("c", 1, 1, 8), ("a", None, 2, 10)))  # below the offset reached, without offset, delivered again, a new partition, not appended yet
    with pytest.raises(RuntimeError):
        run.run(late, fail_after="sink")
    later = late.unionAll(log(spark, ("a", 6, 4, 7)))
    again = runner(spark, tmp_path)
    assert again.run(later) == 2  # as planned
    assert again.committed() == {"a": 5, "b": 2, "c": 1}
    assert again.run(later) == 3
    assert again.run(later) is None
    assert {r: b for (r, _), b in sunk(again).items()} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 8: 2, 7: 3}


def test_adopted_ranges_hold_for_later_batches(spark, tmp_path):
    run = incremental.IncrementalRun(spark, str(tmp_path), ("log_offset",))
    run.adopt(spark.createDataFrame([(1, 1, 2)], "consumer_id long, lo long, hi long"), spark.createDataFrame([(1,), (2,), (None,)], "consumer_id long"))
    early = changes(spark, (1, 10), (2, 20), (3, 30))
    assert run.run(early) == 1
    assert run.run(early.unionAll(changes(spark, (4, 10), (5, 30), (6, 60)))) == 2
    assert rows(run.sink().select("consumer_id", "log_offset", "batch")) == [(1, 30, 1), (1, 60, 2), (2, 10, 1), (2, 20, 1), (2, 30, 1), (2, 60, 2)]
