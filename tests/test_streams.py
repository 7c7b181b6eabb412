from pyspark.sql import functions as F

from tests.conftest import rows
from tidelog.streaming import streams


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    s = streams.Streams(spark, str(tmp_path / "s"))
    follow = lambda: spark.readStream.schema("id long").parquet(source)
    s.take_in(follow())
    s.job("even", [streams.MAIN], streams.sql_job("select id from s1 where id % 2 = 0"))
    spark.range(5, 9).write.mode("append").parquet(source)
    for _ in range(2):
        s.take_in(follow())
        s.job("even", [streams.MAIN], streams.sql_job("select id from s1 where id % 2 = 0"))
    assert rows(s.read(streams.MAIN)) == [(k,) for k in range(9)]
    assert rows(s.read("even")) == [(0,), (2,), (4,), (6,), (8,)]


def test_open_transactions_are_held_back(spark, tmp_path):
    schema = "txn_id long, rec_type int"
    take = streams.transaction_sink(spark, str(tmp_path))
    take(spark.createDataFrame([(1, 0), (2, 0), (None, 16)], schema), 0)
    take(spark.createDataFrame([(1, 6), (3, 0)], schema), 1)
    take(spark.createDataFrame([(2, 7)], schema), 2)
    take(spark.createDataFrame([(2, 7)], schema), 2)  # a batch run twice
    done = spark.read.parquet(str(tmp_path / "done"))
    assert rows(done.select("batch", "txn_id", "rec_type")) == sorted([(0, None, 16), (1, 1, 0), (1, 1, 6), (2, 2, 0), (2, 2, 7)], key=repr)
    assert rows(spark.read.parquet(str(tmp_path / "held" / "2"))) == [(3, 0)]


def test_messages_after_the_end_of_their_transaction_are_published(spark, tmp_path):
    schema = "txn_id long, rec_type int"
    take = streams.transaction_sink(spark, str(tmp_path))
    take(spark.createDataFrame([(1, 6), (2, 0)], schema), 0)
    take(spark.createDataFrame([(1, 0), (2, 7)], schema), 1)
    for _ in range(2):  # a batch run twice
        take(spark.createDataFrame([(1, 1), (2, 2), (3, 0)], schema), 2)
    take(spark.createDataFrame([(4, 0)], schema), 3)
    done = spark.read.parquet(str(tmp_path / "done"))
    assert rows(done.select("batch", "txn_id", "rec_type")) == [(0, 1, 6), (1, 1, 0), (1, 2, 0), (1, 2, 7), (2, 1, 1), (2, 2, 2)]
    assert rows(spark.read.parquet(str(tmp_path / "held" / "3"))) == [(3, 0), (4, 0)]


def windows_of(spark, root, *parts, delay="10 minutes"):
    """The windows of an hour that close over micro-batches of (minute, rec_type) rows."""
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    for k, part in enumerate(parts):
        rows_ = [(None if m is None else base + dt.timedelta(minutes=m), t) for m, t in part]
        spark.createDataFrame(rows_, "ts timestamp_ntz, rec_type int").coalesce(1).write.parquet(f"{root}/log/{k}")
    source = spark.readStream.schema("ts timestamp_ntz, rec_type int").option("maxFilesPerTrigger", 1).parquet(f"{root}/log/*")
    hours = streams.with_heartbeat(source, delay=delay).groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n")).select(F.hour("window.start").alias("hour"), "n")
    hours.writeStream.format("parquet").option("checkpointLocation", f"{root}/c").option("path", f"{root}/out").trigger(availableNow=True).start().awaitTermination()
    return rows(spark.read.schema(hours.schema).parquet(f"{root}/out"))


def test_a_window_closes_by_a_heartbeat_alone(spark, tmp_path):
    changes = [(5, 0), (20, None), (None, 0), (30, 1)]
    assert windows_of(spark, tmp_path / "a", changes) == []
    assert windows_of(spark, tmp_path / "b", changes, [(69, 16)]) == []
    assert windows_of(spark, tmp_path / "c", changes, [(70, 16), (None, 16)]) == [(0, 3)]


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    assert windows_of(spark, tmp_path, [(5, 0)], [(100, 16)], [(101, 16)], [(10, 0), (95, 0)], [(200, 16)]) == [(0, 1), (1, 1)]


def test_count_windows_over_batches(spark):
    import numpy as np
    import pandas as pd

    class State:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    for seed in range(5):
        rng = np.random.default_rng(seed)
        w = streams.CountWindow(7, "v")
        w.state = State()
        values = rng.integers(-(10**17), 10**17, 100)
        out, at = [], 0
        for size in [0, 1, 6, 7, 14, 3, 30, 39]:
            out += [tuple(map(int, r[1:])) for f in w.handleInputRows(("k",), iter([pd.DataFrame({"v": values[at : at + size]})]), None) for r in f.itertuples(index=False)]
            at += size
        assert [(k, n) for k, n, _, _ in out] == [(k, 7) for k in range(14)]
        assert [h * w.HALF + lo for _, _, h, lo in out] == [sum(map(int, values[7 * k : 7 * k + 7])) for k in range(14)]


def test_log_source_prunes_row_groups(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from tidelog.sources import changelog

    path = str(tmp_path / "log.parquet")
    pq.write_table(pa.table({"log_offset": list(range(100)), "rec_type": [k % 3 for k in range(100)]}), path, row_group_size=10)
    changelog.register(spark)
    reader = changelog.LogReader({"path": path, "startingoffset": "35"}, changelog.ChangeLog({"path": path}).schema())
    meta = pq.read_metadata(path)
    assert reader.groups(meta, changelog.Piece(path)) == list(range(3, 10))
    assert sorted(g for k in range(3) for g in reader.groups(meta, changelog.Piece(path, k, 3))) == list(range(3, 10))
    df = spark.read.format("tidelog").option("path", path).option("startingOffset", 35).load()
    assert df.filter("log_offset <= 52 and rec_type in (0, 1)").count() == sum(k % 3 < 2 for k in range(35, 53))
    assert df.filter("log_offset > 1000").count() == 0
    assert spark.read.format("tidelog").option("path", f"file://{path}").load().count() == 100


def test_log_stream_reads_what_lands_late(spark, tmp_path):
    from tidelog.sources import changelog

    changelog.register(spark)
    root = tmp_path / "log"
    follow = lambda: spark.readStream.format("tidelog").schema("log_offset long").option("path", str(root)).load()
    for offsets in ([10, 30], [20], [None, 40]):  # 20 lands below a position read before
        spark.createDataFrame([(o,) for o in offsets], "log_offset long").write.mode("append").parquet(str(root))
        follow().writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(once=True).start().awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == sorted([(10,), (20,), (30,), (40,), (None,)], key=repr)


class Target:
    """Keeps what was committed, and the numbers of the transactions in it."""

    def __init__(self, log, errors, positions):
        self.log, self.errors, self.open, self.positions, self.marked = log, errors, [], positions, []

    def execute(self, text):
        if text.startswith("INSERT INTO apply_state"):
            txn = text.split("(")[2].split(",")[0]
            if txn in self.positions:
                raise RuntimeError(1062)
            self.marked.append(txn)
            return
        if self.errors.get(text):
            raise RuntimeError(self.errors[text].pop(0))
        self.open.append(text)

    def commit(self):
        if self.open or self.marked:
            self.log.append(list(self.open))
        self.positions.update(self.marked)
        self.open, self.marked = [], []

    def rollback(self):
        self.open, self.marked = [], []

    def close(self):
        pass


def test_applier_commits_retries_and_passes_over():
    from types import SimpleNamespace as Row

    import pytest

    statements = [Row(txn_id=k // 2, log_offset=k, statement=f"s{k}") for k in range(6)]

    def run(errors=None, positions=None, **more):
        log = []
        n = streams.Applier(lambda: Target(log, errors or {}, positions), **more).apply(iter(statements))
        return n, log

    held = set()
    assert run({"s1": [1213], "s3": [1146]}, held) == (6, [["s0", "s1"], ["s2"], ["s4", "s5"]])
    assert held == {"0", "1", "2"}
    assert run({}, held) == (0, [])  # all was applied before
    assert run({}, {"1"}) == (4, [["s0", "s1"], ["s4", "s5"]])
    assert run({}, {"1"}, batch_commit=3) == (4, [["s0", "s1"], ["s4", "s5"]])
    assert [len(c) for c in run({}, set(), batch_commit=2)[1]] == [4, 2]
    assert run({}, set(), dry_run=True) == (0, [])
    for code in (1064, 1062):  # a key that is there already is no success
        with pytest.raises(RuntimeError):
            run({"s2": [code]}, set())


def test_levels_are_applied_one_after_the_other(spark, tmp_path):
    """Against a real database: each change is right only if those before it of the same key are there."""
    import sqlite3

    path = str(tmp_path / "target.db")
    with sqlite3.connect(path) as db:
        db.execute("create table t (k integer primary key, v integer)")
        db.execute("create table apply_state (txn integer primary key, position integer)")

    class Db:
        def __init__(self):
            self.db = sqlite3.connect(path, timeout=60, isolation_level=None)
            self.db.execute("begin immediate")

        def execute(self, text):
            try:
                self.db.execute(text)
            except sqlite3.IntegrityError as e:
                raise RuntimeError(1062) from e

        def commit(self):
            self.db.execute("commit")
            self.db.execute("begin immediate")

        def rollback(self):
            self.db.execute("rollback")
            self.db.execute("begin immediate")

        def close(self):
            self.db.execute("rollback")
            self.db.close()

    import random

    from tidelog.operators import apply

    rng, made, state = random.Random(2), [], {}
    for k in range(40):
        key = rng.randrange(5)
        made.append((10 * k, k, 0, key in state, key))
        state[key] = state.get(key, 0) * 3 + k
    log = spark.createDataFrame([(o, t, 1 if there else 0, 65536, str(key), None, f"update t set v = v * 3 + {t} where k = {key}" if there else f"insert into t values ({key}, {t})") for o, t, _, there, key in made], "log_offset long, txn_id long, rec_type int, table_meta_id long, row_key string, old_key string, statement string")
    levels = apply.conflict_levels(log)
    for _ in range(2):  # the second run finds all of it applied
        streams.Applier(Db).sink(lambda batch: levels)(log.select("log_offset", "txn_id", "statement"), 0)
        with sqlite3.connect(path) as db:
            assert dict(db.execute("select k, v from t")) == state
            assert db.execute("select count(*) from apply_state").fetchone() == (40,)
