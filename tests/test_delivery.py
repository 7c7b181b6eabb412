import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tidelog.operators.delivery import DeliveryStore, duplicates

SCHEMA = "delivery_id long, log_offset long, day string, record_id long, note string"


def frame(spark, *deliveries):
    return spark.createDataFrame(list(deliveries), SCHEMA)


def store_at(spark, root):
    return DeliveryStore(spark, str(root), F.col("day"), bucket=F.floor(F.col("log_offset") / 100))


def kept(store):
    return {(r.log_offset, r.delivery_id, r.note, r._part) for r in store.rows().collect()}


def test_only_affected_partitions_are_rewritten(spark, tmp_path):
    store = store_at(spark, tmp_path)
    lost = store.merge(frame(spark, (1, 10, "d1", 1, "x"), (2, 10, "d1", 1, "y"), (3, 20, "d2", 2, "x"), (4, 30, None, 3, "x")))
    assert rows(lost) == [(2,)]
    before = store.manifest()["parts"]
    lost = store.merge(frame(spark, (0, 20, "d9", 2, "earlier"), (9, 40, "d3", 4, "new"), (8, 40, "d4/5 %", 4, "new"), (7, 10, "d1", 1, "again")))
    assert rows(lost) == [(3,), (7,), (9,)]
    after = store.manifest()["parts"]
    assert set(after) == {"d1", "none", "d2", "d4/5 %"}
    assert after["none"] == before["none"]
    assert after["d1"] != before["d1"] and after["d2"] != before["d2"]
    want = {(10, 1, "x", "d1"), (20, 0, "earlier", "d2"), (30, 4, "x", "none"), (40, 8, "new", "d4/5 %")}
    assert kept(store) == want
    assert store.vacuum() > 0
    assert kept(store) == want
    assert rows(store.index().groupBy("log_offset").count().filter("count > 1")) == []
    assert store.index().count() == 4


@pytest.mark.parametrize("vacuum", [False, True])
@pytest.mark.parametrize("step", ["folder", "manifest", "torn manifest"])
def test_a_merge_lost_at_any_step_is_repeated(spark, tmp_path, monkeypatch, step, vacuum):
    from tidelog.operators import delivery

    store = store_at(spark, tmp_path)
    store.merge(frame(spark, (1, 10, "d1", 1, "x"), (5, 250, "d2", 1, "x")))
    state = kept(store)
    more = frame(spark, (2, 10, "d1", 1, "y"), (0, 250, "d3", 1, "z"), (3, 30, "d1", 2, "x"))
    with monkeypatch.context() as m:

        def lost(session, path, text):
            if step == "torn manifest":
                real(session, path, text[:20])
            raise RuntimeError("lost")

        real = delivery.put_once
        m.setattr(delivery, "put_once", lost)
        if step == "folder":
            m.setattr(DeliveryStore, "_folders", lambda *_: lost(spark, "", ""))
        with pytest.raises(RuntimeError):
            store.merge(more)
    again = store_at(spark, tmp_path)
    assert kept(again) == state
    if vacuum:
        again.vacuum()
        assert kept(again) == state
    assert rows(again.merge(more)) == [(2,), (5,)]
    assert kept(again) == {(10, 1, "x", "d1"), (250, 0, "z", "d2"), (30, 3, "x", "d1")}


def test_index_reads_the_touched_buckets_and_is_merged(spark, tmp_path, monkeypatch):
    from tidelog.operators import delivery

    monkeypatch.setattr(delivery, "FRAGMENTS", 2)
    store = store_at(spark, tmp_path)
    for k in range(4):
        store.merge(frame(spark, (k, k, "d", k, "x"), (10 + k, 100 * (k + 5), "d", k, "x")))
    index = store.manifest()["index"]
    assert set(index) == {"0", "5", "6", "7", "8"}
    assert len(index["0"]) <= 2
    assert rows(store.index(["0"])) == [(0, "d"), (1, "d"), (2, "d"), (3, "d")]
    assert store.index().count() == 8


def test_nulls_empty_and_exact_repeats(spark, tmp_path):
    store = DeliveryStore(spark, str(tmp_path / "a"), F.col("day"))
    assert rows(store.merge(frame(spark))) == []
    assert rows(store.merge(frame(spark, (None, 10, "d1", 1, "x"), (1, None, "d1", 1, "x"), (2, 10, None, None, None), (2, 10, None, None, None)))) == []
    assert store.rows().count() == 1
    assert rows(store.merge(frame(spark))) == []


def test_duplicates_against_brute_force(spark, tmp_path):
    deliveries = [(k, (k * 7) % 23, k // 5, k % 3) for k in range(60)]
    df = spark.createDataFrame(deliveries, "delivery_id long, log_offset long, batch_id long, record_id long")
    found = {r[0] for r in rows(duplicates(df, str(tmp_path), F.col("batch_id"), ["record_id"]))}
    first = {}
    for d, o, *_ in deliveries:
        first[o] = min(first.get(o, d), d)
    assert found == {d for d, o, *_ in deliveries if d != first[o]}


def test_what_a_count_finds_large_is_never_broadcast(spark, tmp_path, monkeypatch):
    """Compressed files of many rows look small to Spark, which would gather them in the driver."""
    n, plans = 60_000, []
    messages = spark.range(n).select(F.col("id").alias("log_offset"), F.lit("d").alias("day"), F.lit(1).cast("long").alias("record_id"), F.lit("x").alias("note"))
    load = lambda *copies: messages.withColumn("delivery_id", F.explode(F.array(*(F.col("log_offset") + c * n for c in copies)))).select("delivery_id", "log_offset", "day", "record_id", "note")
    store, kind = DeliveryStore(spark, str(tmp_path), F.col("day"), bucket=F.shiftright("log_offset", 44)), type(messages)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda df: (collect(df), plans.append(df._jdf.queryExecution().executedPlan().toString()))[0])
    lost = [store.merge(load(0, 1)), store.merge(load(2))]
    for k, df in enumerate(lost):
        assert df.agg(F.count("*"), F.min("delivery_id"), F.max("delivery_id")).collect() == [(n, (k + 1) * n, (k + 2) * n - 1)]
    assert sum("SortMergeJoin" in p for p in plans) == 3
    assert not any("Broadcast" in p for p in plans)
    assert store.rows().count() == n
