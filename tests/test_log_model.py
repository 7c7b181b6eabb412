"""The log against a model in memory: 40 transactions over 12 key shapes, as a store of changes is tested."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidelog.operators import apply, images, log, windows

SHAPES = {"int_pk": "a", "char_pk": "c", "fixed_pk": "a,b", "var_pk": "a,c", "int_uk": "a", "char_uk": "c", "fixed_uk": "a,b", "var_uk": "a,c", "multi_uk": "a,c", "pk_and_uk": "a", "pk_multi_uk": "a", "no_pk": ""}
SCHEMA = "record_id long, log_offset long, ts timestamp_ntz, txn_id long, rec_type int, db string, tbl string, table_meta_id long, row_key string, old_key string, changed array<string>, before_img struct<a: int, b: int, c: string, d: int, f: timestamp_ntz>, after_img struct<a: int, b: int, c: string, d: int, f: timestamp_ntz>"


def image(pk):
    import datetime as dt

    return (pk, pk * pk, f"{pk}wad{pk + 1}_sw", pk >> 2, dt.datetime(2024, 1, 1, 0, 0, pk % 60))


def key(shape, img):
    return "|".join(str(img["abcdf".index(c)]) for c in SHAPES[shape].split(",")) if SHAPES[shape] else None


@pytest.fixture(scope="module")
def changes():
    rng, out, offset = random.Random(11), [], 0
    for txn in range(1, 41):
        for _ in range(rng.randrange(50)):
            offset += rng.randrange(1, 5)
            k = rng.randrange(12)
            shape, kind, pk = list(SHAPES)[k], rng.choice([0, 1, 2]), txn + rng.randrange(100)
            img = image(pk)
            before, after, old = (None, img, None) if kind == 0 else (img, None, None) if kind == 2 else (img[:4] + (None,), img, None)
            if kind == 1 and rng.random() < 0.2:
                before = image(pk - 1)
                old = key(shape, before)
            changed = None if kind != 1 else [c for c, x, y in zip("abcdf", before, after, strict=True) if x != y]
            out.append((len(out) + 1, offset, img[4], txn, kind, "d", shape, (k + 1) << 16, key(shape, img), old, changed, before, after))
    return out


@pytest.fixture(scope="module")
def df(spark, changes):
    return spark.createDataFrame(changes, SCHEMA)


def test_full_scan_is_in_input_order(df, changes):
    assert [r.record_id for r in log.ordered(log.scan_checkpoint(df, 0)).collect()] == [c[0] for c in changes]
    assert [r.record_id for r in log.ordered(log.scan_records(df, 17, True), True).collect()] == list(range(17, 0, -1))
    assert log.scan_records(df, 10**9).count() == 0


def test_lookup_finds_the_last_change_touching_a_key(df, changes):
    last = {}
    for c in changes:
        for k in {c[8], c[9]} - {None}:
            last[c[7] >> 16, k] = (c[1], c[4])
    assert {(r.table_id, r.key): (r.log_offset, r.rec_type) for r in log.key_lookup(df).collect()} == last


def test_lookup_after_reload(spark, df, tmp_path):
    df.write.parquet(str(tmp_path / "log"))
    again = spark.read.parquet(str(tmp_path / "log"))
    assert sorted(map(tuple, log.key_lookup(again).collect())) == sorted(map(tuple, log.key_lookup(df).collect()))


def test_old_values_come_back(df, changes):
    found = {r.log_offset: tuple(r)[1:] for r in images.before_image(df).collect()}
    for c in changes:
        if c[11] is not None:
            want = c[11] if c[12] is None else tuple(b if n in c[10] else a for n, b, a in zip("abcdf", c[11], c[12], strict=True))
            assert found[c[1]] == want


def test_levels_respect_every_conflict(df, changes):
    level = {r.txn_id: (r.segment, r.level) for r in apply.conflict_levels(df).collect()}
    keys, place = {}, {}
    for c in changes:
        place[c[3]] = c[1]
        for k in {c[8], c[9]} - {None}:
            keys.setdefault(c[3], set()).add((c[7], k))
    txns = sorted(keys, key=place.get)
    for i, b in enumerate(txns):
        waits = [level[a][1] for a in txns[:i] if keys[a] & keys[b]]
        assert level[b][1] == max(waits, default=-1) + 1


def test_statements_where_columns(spark, df):
    catalog = spark.createDataFrame([((k + 1) << 16, s) for k, s in enumerate(SHAPES.values())], "table_meta_id long, key_columns string")
    found = {r.log_offset: r.statement for r in apply.statements(df, catalog).collect()}
    for r in df.filter("rec_type = 2").collect():
        text = found[r.log_offset]
        assert text.startswith(f"DELETE FROM `d`.`{r.tbl}` WHERE ")
        assert text.endswith(" LIMIT 1") == (r.tbl == "no_pk")
        assert text.count(" AND ") == max(len(SHAPES[r.tbl].split(",")) - 1 if SHAPES[r.tbl] else 4, 0)


def test_purge_keeps_the_last_files(spark):
    import datetime as dt

    df = spark.createDataFrame([(f << 44 | p, dt.datetime(2024, 1, f)) for f in range(1, 10) for p in (4, 9)], "log_offset long, ts timestamp_ntz")
    assert {r.log_offset >> 44 for r in log.purge(df, 3600, 2).collect()} == {8, 9}
    assert {r.log_offset >> 44 for r in log.purge(df, 3 * 86_400, 2).collect()} == {6, 7, 8, 9}


def test_count_windows_number_rows_over_partitions(spark):
    from pyspark.sql import functions as F

    df = spark.range(1000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 1000).alias("o"))
    found = windows.numbered(df, ["o"], ["k"], parts=7).groupBy("k").agg(F.countDistinct("ordinal").alias("n"), F.max("ordinal").alias("m"), F.max_by("o", "ordinal").alias("last"), F.max("o").alias("most"))
    assert all(r.n == r.m + 1 and r.last == r.most for r in found.collect())


def test_point_select_needs_the_whole_key(spark):
    state = spark.createDataFrame([(1, 2, "x"), (1, None, "y")], "a int, b int, v string")
    assert [r.v for r in log.point_select(state, {"a": 1, "b": 2}, ["a", "b"]).collect()] == ["x"]
    assert [r.v for r in log.point_select(state, {"a": 1, "b": None}, ["a", "b"]).collect()] == ["y"]
    with pytest.raises(ValueError):
        log.point_select(state, {"a": 1}, ["a", "b"])


def test_mapped_columns_are_named_in_every_clause(spark, df):
    catalog = spark.createDataFrame([((k + 1) << 16, s) for k, s in enumerate(SHAPES.values())], "table_meta_id long, key_columns string")
    found = {r.log_offset: r.statement for r in apply.statements(df, catalog, {"a": "id", "c": "code"}).collect()}
    wheres = set()
    for r in df.select("log_offset", "rec_type", "tbl").collect():
        text = found.get(r.log_offset, "")
        assert "`a`" not in text and "`c`" not in text
        if r.rec_type in (1, 2) and text:
            wheres.add((r.rec_type, r.tbl, text.split(" WHERE ")[1].count("`id`"), text.split(" WHERE ")[1].count("`code`")))
    assert {(1, "int_pk", 1, 0), (2, "int_pk", 1, 0), (1, "var_pk", 1, 1), (2, "char_pk", 0, 1), (2, "no_pk", 1, 1)} <= wheres


def test_the_mapping_query_is_registered_over_all_dml(spark, data):
    from tidelog.queries.log import QUERIES

    kinds = {r.statement.split(" ")[0] for r in QUERIES["apply_column_map_dml"](spark, data).collect()}
    assert {"INSERT", "UPDATE", "DELETE"} <= kinds


def test_transactions_that_share_only_a_second_unique_key_wait(spark):
    dml = lambda o, txn, kind, before, after, changed=None: (o, o, None, txn, kind, "d", "multi_uk", 65536, "|".join(str((after or before)[k]) for k in (0, 2)), None, changed, before, after)
    df = spark.createDataFrame([
        dml(1, 1, 0, None, (1, 2, "x", 0, None)), dml(2, 2, 0, None, (1, 2, "y", 0, None)),  # the same (a,b), another c
        dml(3, 3, 0, None, (1, 7, "z", 0, None)), dml(4, 4, 1, (1, 7, "w", 0, None), (1, 8, "w", 0, None), ["b"]),  # the old (a,b)
        dml(5, 5, 2, (1, 8, "v", 0, None), None), dml(6, 6, 0, None, (5, 5, "u", 0, None)),
    ], SCHEMA)
    unique = spark.createDataFrame([(65536, ["a", "c"]), (65536, ["a", "b"])], "table_meta_id long, columns array<string>")
    assert apply.conflict_edges(df).count() == 0
    assert sorted((r.txn_id, r.after_txn) for r in apply.conflict_edges(df, unique).collect()) == [(2, 1), (4, 3), (5, 4)]
    assert {r.txn_id: r.level for r in apply.conflict_levels(df, unique).collect()} == {1: 0, 2: 1, 3: 0, 4: 1, 5: 2, 6: 0}


def test_where_takes_a_filled_unique_key_before_all_columns(spark):
    row = lambda o, img: (o, o, None, 1, 2, "d", "t", 65536, None, None, None, img, None)
    df = spark.createDataFrame([row(1, (1, 2, "x", 0, None)), row(2, (None, 2, "x", 0, None)), row(3, (None, None, "x", 0, None))], SCHEMA)
    catalog = spark.createDataFrame([(65536, "a")], "table_meta_id long, key_columns string")
    unique = spark.createDataFrame([(65536, ["a", "c"]), (65536, ["b", "c"])], "table_meta_id long, columns array<string>")
    found = {r.log_offset: r.statement.split(" WHERE ")[1] for r in apply.statements(df, catalog, unique=unique).collect()}
    assert found[1] == "`a` = 1"
    assert found[2] == "`b` = 2 AND `c` = 'x'"
    assert found[3].endswith(" LIMIT 1")


@pytest.mark.parametrize("limit", [3, 10])
def test_segments_of_levels_are_bounded(spark, df, changes, limit):
    found = {r.txn_id: (r.segment, r.level) for r in apply.conflict_levels(df, segment_keys=limit).collect()}
    keys, place = {}, {}
    for c in changes:
        place[c[3]] = max(place.get(c[3], 0), c[1])
        for k in {c[8], c[9]} - {None}:
            keys.setdefault(c[3], set()).add((c[7] >> 16, k))
    assert set(found) == set(keys)
    segments = {}
    for txn in sorted(keys, key=place.get):
        segments.setdefault(found[txn][0], []).append(txn)
    assert list(segments) == sorted(segments)
    for start, txns in segments.items():
        assert start == min(place[t] for t in txns)
        sizes = [len(keys[t]) for t in txns]
        assert len(txns) == 1 or (max(sizes) <= limit and sum(sizes[:-1]) < limit + max(sizes))
        for i, b in enumerate(txns):
            assert found[b][1] == max((found[a][1] for a in txns[:i] if keys[a] & keys[b]), default=-1) + 1


def test_statements_of_any_columns(spark):
    import datetime as dt

    schema = "log_offset long, txn_id long, rec_type int, db string, tbl string, table_meta_id long, changed array<string>, before_img struct<id: long, note: string, raw: binary, seen: date, price: decimal(8,2), ok: boolean>, after_img struct<id: long, note: string, raw: binary, seen: date, price: decimal(8,2), ok: boolean>"
    old = (7, "it's \\ here", b"\x01\xff", dt.date(2024, 2, 3), None, True)
    df = spark.createDataFrame([(1, 1, 0, "d", "t", 65536, None, None, old), (2, 1, 2, "d", "t", 65536, None, old, None), (3, 1, 2, "d", "t", 131072, None, old, None), (4, 1, 1, "d", "t", 65536, ["note", "gone"], old, (7, None, None, None, None, False)), (5, 1, 2, "d", "t", 9, None, old, None)], schema)
    fields = [{"name": n, "type": t} for n, t in (("price", "decimal"), ("note", "text"), ("id", "int64"), ("raw", "blob"), ("ok", "bool"), ("later", "string"))]
    catalog = spark.createDataFrame([(65536, None, json.dumps(fields)), (131072, "id", json.dumps(fields))], "table_meta_id long, key_columns string, columns_json string")
    found = {r.log_offset: r.statement for r in apply.statements(df, catalog).collect()}
    assert found[1] == "INSERT INTO `d`.`t` (`price`, `note`, `id`, `raw`, `ok`) VALUES (NULL, 'it''s \\\\ here', 7, 0x01FF, true)"
    assert found[2] == "DELETE FROM `d`.`t` WHERE `price` IS NULL AND `id` = 7 AND `ok` = true LIMIT 1"
    assert found[3] == "DELETE FROM `d`.`t` WHERE `id` = 7"
    assert found[4] == "UPDATE `d`.`t` SET `note` = NULL WHERE `price` IS NULL AND `id` = 7 AND `ok` = true LIMIT 1"
    assert found[5].count(" AND ") == 5
    text = df.withColumns({c: F.to_json(F.struct(F.col(f"{c}.id").alias("id"), F.col(f"{c}.note").alias("note"))) for c in ("before_img", "after_img")})
    found = {r.log_offset: r.statement for r in apply.statements(text, catalog).collect()}
    assert found[1] == "INSERT INTO `d`.`t` (`note`, `id`) VALUES ('it''s \\\\ here', 7)"
    assert found[3] == "DELETE FROM `d`.`t` WHERE `id` = 7"


def test_net_change_of_whole_rows(df):
    found = images.net_changes(df).collect()
    assert [c for c in found[0].asDict() if c.startswith(("first_", "last_"))] == [f"{s}_{c}" for s in ("first", "last") for c in "abcdf"]
    assert all(r.effect in ("update", "delete") or r.first_a is None for r in found)


def test_last_writer_against_brute_force(spark):
    import random

    rng = random.Random(4)
    entries = [(rng.randrange(9), rng.randrange(40), rng.choice([None] * 6 + [rng.randrange(40)])) for _ in range(120)] + [(None, 3, None), (5, None, None)]
    df = spark.createDataFrame(entries, "term long, log_index long, rolled_back_to long")
    want = {}
    for t, i, r in entries:
        if r is None and i is not None:
            want[i] = max(want.get(i, -1), -1 if t is None else t)
    cuts = [(r, t) for t, _, r in entries if r is not None]
    want = {i: t for i, t in want.items() if not any(r < i and t < c for r, c in cuts)}
    assert {r.log_index: r.term for r in log.last_writer(df).collect()} == want


def test_moves_from_key_to_key(spark, df):
    every = sorted({r.key for r in log.touches(df).filter("table_id = 1").collect()})
    for start, following, before in ((every[1], every[2], every[0]), ("", every[0], None), (every[-1], None, every[-2])):
        assert next((r.key for r in log.neighbour_key(df, start).collect() if r.table_id == 1), None) == following
        assert next((r.key for r in log.neighbour_key(df, start, True).collect() if r.table_id == 1), None) == before
    with pytest.raises(ValueError):
        log.visible(df, "serializable")
    with pytest.raises(ValueError):
        log.resume_position(df.limit(0))
