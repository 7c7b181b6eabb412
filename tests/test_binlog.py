import json

import pyarrow as pa
import pytest

from tests.oracle import assert_same, connect
from tidelog.queries import binlog as Q
from tidelog.sources import binlog as B

KINDS = [
    (B.TINY, (), -5), (B.SHORT, (), -300), (B.INT24, (), 70000), (B.LONG, (), -(2**31)), (B.LONGLONG, (), 2**62), (B.FLOAT, (4,), 1.5), (B.DOUBLE, (8,), -0.1), (B.NEWDECIMAL, (14, 4), "-1234567890.1234"),
    (B.NEWDECIMAL, (20, 0), "12345678901234567890"), (B.NEWDECIMAL, (5, 5), "0.00012"), (B.YEAR, (), 2024), (B.DATE, (), "2024-02-29"), (B.DATETIME2, (3,), "1999-12-31 23:59:59.123000"), (B.TIMESTAMP2, (6,), "2024-06-01 00:00:01.000007"),
    (B.TIME2, (0,), "-838:59:59"), (B.TIME2, (2,), "-00:00:01.500000"), (B.TIME2, (6,), "101:02:03.000004"), (B.BIT, (3, 1), 0b10100000001), (B.ENUM, (247, 1), 3), (B.SET, (248, 2), 257), (B.VARCHAR, (300,), "größe"), (B.VARCHAR, (20,), ""),
    (B.STRING, (40,), "x"), (B.STRING, (800,), "wide" * 100), (B.BLOB, (2,), "00ff10"), (B.GEOMETRY, (4,), "0101"),
]


@pytest.mark.parametrize(("kind", "meta", "value"), KINDS)
def test_values_go_round(kind, meta, value):
    raw = B.write_value(kind, meta, value)
    assert B.read_value(kind, meta, raw + b"rest", 0) == (value, len(raw))


def test_old_times_and_impossible_dates():
    assert B.read_value(B.DATE, (), (0).to_bytes(3, "little"), 0) == (None, 3)
    assert B.read_value(B.DATETIME, (), (20240102030405).to_bytes(8, "little"), 0)[0] == "2024-01-02 03:04:05"
    assert B.read_value(B.TIME, (), (-8385959).to_bytes(3, "little", signed=True), 0)[0] == "-838:59:59"
    assert B.read_value(B.TIMESTAMP, (), (86400).to_bytes(4, "little"), 0)[0] == "1970-01-02 00:00:00"
    assert B.read_value(B.TIMESTAMP2, (0,), bytes(4), 0)[0] == 0


def test_binary_json():
    # {"a": 1, "b": "x", "c": [true, null]}
    inner = b"\x02\x00\x0a\x00" + b"\x04\x01\x00" + b"\x04\x00\x00"
    head = 4 + 3 * 4 + 3 * 3
    keys = b"abc"
    values = b"\x05\x01\x00" + b"\x0c" + (head + 3).to_bytes(2, "little") + b"\x02" + (head + 5).to_bytes(2, "little")
    body = b"\x03\x00" + (head + 5 + len(inner)).to_bytes(2, "little") + b"".join((head + k).to_bytes(2, "little") + b"\x01\x00" for k in range(3)) + values + keys + b"\x01x" + inner
    assert json.loads(B.read_json(b"\x00" + body)) == {"a": 1, "b": "x", "c": [True, None]}


@pytest.fixture
def log(tmp_path):
    t = B.TableMap(7, "shop", "t", [k for k, _, _ in KINDS], [m for _, m, _ in KINDS])
    full, empty = [v for _, _, v in KINDS], [None] * len(KINDS)
    w = B.Writer(str(tmp_path / "bin.000001"))
    w.query(100, "shop", "BEGIN")
    w.rows(100, 30, t, [(None, full), (None, empty)])
    w.rows(101, 31, t, [(full, [9, *full[1:]])])
    w.commit(102, 5)
    w.query(103, "shop", "ALTER TABLE t ADD x int")
    w.rotate("bin.000002")
    w.close()
    w = B.Writer(str(tmp_path / "bin.000002"))
    w.query(200, "shop", "BEGIN")
    w.rows(200, 25, t, [(full, None)])
    w.query(201, "shop", "ROLLBACK")
    w.event(B.HEARTBEAT, 202, b"x")
    w.close()
    return tmp_path


def test_files_become_changes(spark, log):
    B.register(spark)
    names = {"shop.t": [f"k{k}" for k in range(len(KINDS))]}
    df = spark.read.format("tidelog_binlog").option("path", f"{log}/bin.*").option("columns", json.dumps(names)).load()
    found = df.orderBy("log_offset", "row_no").collect()
    assert [r.rec_type for r in found] == [5, 0, 0, 1, 6, 4, 5, 2, 7, 16]
    assert [r.log_offset >> 44 for r in found] == [1] * 6 + [2] * 4
    assert json.loads(found[1].after) == {f"k{k}": v for k, (_, _, v) in enumerate(KINDS)}
    assert set(json.loads(found[2].after).values()) == {None}
    assert (found[3].changed, json.loads(found[3].before)["k0"], json.loads(found[3].after)["k0"]) == (["k0"], -5, 9)
    assert found[5].ddl == "ALTER TABLE t ADD x int"
    later = spark.read.format("tidelog_binlog").option("path", f"{log}/bin.*").option("startingOffset", found[4].log_offset).load()
    assert later.count() == 6
    assert spark.read.format("tidelog_binlog").option("path", f"{log}/bin.*").option("startingOffset", 9 << 44).load().count() == 0


def test_files_are_followed_as_they_grow(spark, log, tmp_path):
    B.register(spark)
    grown, raw = tmp_path / "grow", (log / "bin.000001").read_bytes()
    grown.mkdir()
    (grown / "bin.000001").write_bytes(raw[:-7])  # the rotation isn't whole yet

    def follow():
        rows = spark.readStream.format("tidelog_binlog").option("path", f"{grown}/bin.*").load()
        rows.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(once=True).start().awaitTermination()
        return sorted(r.rec_type for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert follow() == [0, 0, 1, 4, 5, 6]
    (grown / "bin.000001").write_bytes(raw)
    (grown / "bin.000002").write_bytes((log / "bin.000002").read_bytes())
    assert follow() == sorted([0, 0, 1, 4, 5, 6, 5, 2, 7, 16])


def test_seek_by_time(log):
    paths = [f"{log}/bin.000001", f"{log}/bin.000002"]
    assert B.seek_timestamp(paths, 101)[0].endswith("1")
    assert B.seek_timestamp(paths, 150)[0].endswith("2")
    assert B.seek_timestamp(paths, 999) is None
    assert B.seek_timestamp(paths, 5)[0].endswith("1")
    with pytest.raises(B.BinlogError):
        B.seek_timestamp(paths, 5, strict=True)


def test_damage(tmp_path, log):
    raw = (log / "bin.000001").read_bytes()
    (tmp_path / "cut.000001").write_bytes(raw[:-10])
    assert len(list(B.changes(str(tmp_path / "cut.000001")))) == 6
    (tmp_path / "bad.000001").write_bytes(raw[:300] + bytes([raw[300] ^ 1]) + raw[301:])
    with pytest.raises(B.BinlogError, match="checksum"):
        list(B.changes(str(tmp_path / "bad.000001")))
    (tmp_path / "not.000001").write_bytes(b"text")
    with pytest.raises(B.BinlogError):
        list(B.changes(str(tmp_path / "not.000001")))
    w = B.Writer(str(tmp_path / "skip.000003"))
    w.rotate("skip.000005")
    w.close()
    with pytest.raises(B.BinlogError, match="goes on"):
        list(B.changes(str(tmp_path / "skip.000003")))
    w = B.Writer(str(tmp_path / "nomap.000001"))
    w.event(30, 1, B.write_rows(30, B.TableMap(9, "d", "t", [B.LONG], [()]), [(None, [1])]))
    w.close()
    with pytest.raises(B.BinlogError, match="no table map"):
        list(B.changes(str(tmp_path / "nomap.000001")))


def test_reading_begins_at_the_place_asked_for(log, monkeypatch):
    path = f"{log}/bin.000001"
    every = list(B.changes(path))
    read = []
    real = B.read_rows
    monkeypatch.setattr(B, "read_rows", lambda kind, body, maps: read.append(kind) or real(kind, body, maps))
    update = next(r for r in every if r[3] == 1)
    # the announcement of its table lies before this place
    assert list(B.changes(path, start=update[0])) == [r for r in every if r[0] >= update[0]]
    assert read == [31]
    assert [at for at, *_ in B.events(path, 4)][0] == 4
    assert list(B.changes(path, start=2 << 44 | 9)) == every  # a place in another file says nothing about this one


def test_the_statement_behind_rows(tmp_path):
    t = B.TableMap(9, "d", "t", [B.LONG], [()])
    w = B.Writer(str(tmp_path / "q.000001"))
    text = b"insert into t values (1)"
    w.event(B.ROWS_QUERY, 1, bytes([len(text)]) + text)
    w.rows(1, 30, t, [(None, [1])])
    w.commit(1, 4)
    w.rows(1, 30, t, [(None, [2])])
    w.close()
    assert [(r[3], r[10]) for r in B.changes(str(tmp_path / "q.000001"))] == [(0, text.decode()), (6, None), (0, None)]
    assert [b.num_rows for b in B.change_batches(str(tmp_path / "q.000001"))] == [3]


@pytest.fixture
def fresh(spark):
    """A session in which no source is registered."""
    sessions, own = spark._jvm.org.apache.spark.sql.classic.SparkSession, spark.newSession()
    sessions.setActiveSession(own._jsparkSession)
    yield own
    sessions.setActiveSession(spark._jsparkSession)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries_are_the_first_of_their_session(fresh, data, name):
    assert_same(Q.QUERIES[name](fresh, data), connect(data), Q.SQL[name])


def test_a_message_counts_once_across_batches():
    batches = [pa.record_batch({"log_offset": at, "kept": kept}) for at, kept in (([1, 1, 2], [True, True, False]), ([2, 2, 3], [True, True, True]))]
    assert [b["log_offset"].to_pylist() for b in Q._first_deliveries(iter(batches))] == [[1], [3]]
