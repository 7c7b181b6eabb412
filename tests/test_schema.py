import pytest

from tidelog.schema import ddl
from tidelog.schema.types import CODES, spark_type
from tidelog.sql.dialect import DialectError


def built(*texts):
    r = ddl.Registry(default_db="d").script([(0, "CREATE DATABASE d"), *((k + 1, t) for k, t in enumerate(texts))])
    return r


def last(*texts):
    own = built(*texts)
    return max((v for vs in own.versions.values() for v in vs), key=lambda v: v.start).table


T3 = "a int primary key, b char(20), c char(20)"


@pytest.mark.parametrize(
    ("steps", "direct"),
    [
        ([f"CREATE TABLE t ({T3})", "CREATE TABLE t2 LIKE t"], f"CREATE TABLE t2 ({T3})"),
        ([f"CREATE TABLE t2 ({T3})", "ALTER TABLE t2 ADD COLUMN d text FIRST"], "CREATE TABLE t2 (d text, a int primary key, b char(20), c char(20))"),
        ([f"CREATE TABLE m ({T3}, d int, unique key (b, c))", "ALTER TABLE m MODIFY d bigint FIRST"], f"CREATE TABLE m (d bigint, {T3}, unique key (b, c))"),
        ([f"CREATE TABLE m ({T3}, d int unique)", "ALTER TABLE m MODIFY d bigint"], f"CREATE TABLE m ({T3}, d bigint unique)"),
        ([f"CREATE TABLE m ({T3}, d int unique, e int)", "ALTER TABLE m MODIFY d bigint AFTER e"], f"CREATE TABLE m ({T3}, e int, d bigint unique)"),
        ([f"CREATE TABLE m ({T3}, d int, unique key (b, c))", "ALTER TABLE m CHANGE d d1 bigint FIRST"], f"CREATE TABLE m (d1 bigint, {T3}, unique key (b, c))"),
        ([f"CREATE TABLE m ({T3}, d int unique)", "ALTER TABLE m CHANGE COLUMN d d1 bigint"], f"CREATE TABLE m ({T3}, d1 bigint unique)"),
        ([f"CREATE TABLE m ({T3}, d int unique, e int)", "ALTER TABLE m CHANGE d d1 bigint AFTER e"], f"CREATE TABLE m ({T3}, e int, d1 bigint unique)"),
        ([f"CREATE TABLE m ({T3})", "ALTER TABLE m ADD (quay smallint, slot varchar(7), tonnage decimal(9,1), flagged date), ADD UNIQUE KEY berth (quay, slot)"], f"CREATE TABLE m ({T3}, quay smallint, slot varchar(7), tonnage decimal(9,1), flagged date, unique key berth (quay, slot))"),
        ([f"CREATE TABLE m ({T3}, d int, key k (c, d))", "ALTER TABLE m DROP COLUMN d, DROP PRIMARY KEY"], "CREATE TABLE m (a int, b char(20), c char(20), key k (c))"),
        ([f"CREATE TABLE m ({T3})", "CREATE INDEX i ON m (b(5), c DESC)", "ALTER TABLE m RENAME INDEX i TO j", "DROP INDEX j ON m", "ALTER TABLE m RENAME COLUMN b TO bb"], "CREATE TABLE m (a int primary key, bb char(20), c char(20))"),
    ],
)
def test_histories_that_end_alike(steps, direct):
    assert last(*steps).same_as(last(direct))


def test_wide_table():
    kinds = ["smallint", "varchar(12)", "decimal(9,3)", "date", "binary(4)"]
    columns = ", ".join(f"gauge{k:02d} {kinds[k % 5]}" for k in range(45))
    t = last(f"CREATE TABLE w (station int, {columns}, PRIMARY KEY (station, gauge03), UNIQUE KEY by_two (gauge11, gauge40))")
    assert (len(t.columns), t.primary, t.unique) == (46, ("station", "gauge03"), (("by_two", ("gauge11", "gauge40")),))
    assert last(t.ddl().replace("`d`.", "")).same_as(t)


def test_versions_by_position():
    r = built(f"CREATE TABLE t ({T3})", "ALTER TABLE t ADD d int", "RENAME TABLE t TO d2.t", "DROP TABLE d2.t", f"CREATE TABLE t ({T3})")
    assert [len(v.table.columns) if (v := r.at("d", "T", o)) else None for o in range(7)] == [None, 3, 4, None, None, 3, 3]
    assert r.at("d2", "t", 3).version == 2
    assert r.by_id(1 << 16 | 1).table.names() == ["a", "b", "c", "d"]
    assert r.previous(1 << 16 | 1).version == 0
    r.purge(3)
    assert sorted(v.meta_id for vs in r.versions.values() for v in vs) == [1 << 16 | 2, 1 << 16 | 3, 2 << 16]
    r.purge(4)
    assert list(r.versions) == [2]


def test_character_sets():
    r = ddl.Registry(default_db="d").script([(1, "CREATE DATABASE d DEFAULT CHARACTER SET latin1"), (2, "CREATE TABLE t (a varchar(10), b varchar(10) CHARACTER SET utf8)"), (3, "ALTER TABLE t CONVERT TO CHARACTER SET utf8mb4")])
    assert [c.bytes for c in r.at("d", "t", 2).table.columns] == [10, 30]
    assert [c.bytes for c in r.at("d", "t", 3).table.columns] == [40, 40]
    r.apply("ALTER DATABASE d CHARACTER SET gbk", 4)
    assert r.charset("d") == "gbk"
    r.apply("DROP DATABASE d", 5)
    assert r.current("d", "t") is None


@pytest.mark.parametrize("text", ["DROP TABLE no", "ALTER TABLE t DROP COLUMN no", "ALTER TABLE t ADD b int", "CREATE TABLE t (a int)", "ALTER TABLE t DROP KEY no", "ALTER TABLE t ADD PRIMARY KEY (b)", "CREATE DATABASE d", "RENAME TABLE t TO t"])
def test_what_does_not_fit(text):
    with pytest.raises(ddl.SchemaError):
        built(f"CREATE TABLE t ({T3})", text)


@pytest.mark.parametrize("text", ["CREATE TABLE q SELECT * FROM t", "CREATE TABLE q (a unknown)", "CREATE TABLE q (a int", "GRANT ALL", "ALTER TABLE t ADD COLUMN x int nonsense,, y int"])
def test_what_is_refused(text):
    with pytest.raises(DialectError):
        built(f"CREATE TABLE t ({T3})", text)


def test_statements_without_definitions():
    r = built("BEGIN", "COMMIT", "CREATE VIEW v AS SELECT 1", "CREATE TRIGGER x BEFORE INSERT ON t FOR EACH ROW SET @a = 1", "CREATE TABLE IF NOT EXISTS t (a enum('x','it''s') default 'x' comment 'c', b decimal(12,3), c int unsigned, FOREIGN KEY f (a) REFERENCES o (i) ON DELETE CASCADE, CHECK (b > 0))", "ALTER TABLE t DROP FOREIGN KEY f", "USE other")
    assert len(r.ignored) == 2
    assert r.default_db == "other"
    t = r.current("d", "t").table
    assert [(c.kind, c.size, c.scale, c.values) for c in t.columns] == [("ENUM", None, None, ("x", "it's")), ("DECIMAL", 12, 3, ()), ("UINT32", None, None, ())]
    assert t.schema().simpleString() == "struct<a:string,b:decimal(12,3),c:bigint>"


def test_every_type_has_a_spark_type():
    for name in CODES:
        if name != "UNION":
            assert spark_type(name)
    assert spark_type("BIG_NUMBER", 60, 2).simpleString() == "string"


def test_differences():
    a, b = last(f"CREATE TABLE t ({T3})"), last(f"CREATE TABLE t ({T3})", "ALTER TABLE t DROP b, ADD z int FIRST, MODIFY c varchar(30)")
    assert sorted(ddl.differences(a, b)) == [("b", "removed"), ("c", "retyped"), ("z", "added")]
    assert ddl.differences(None, a) == [("a", "added"), ("b", "added"), ("c", "added")]


def test_snapshot_of_a_table(spark):
    df = spark.createDataFrame([], "a bigint, b string, c decimal(9,2), d array<int>, e timestamp_ntz")
    r = ddl.Registry().load([ddl.snapshot(df, "d", "t", ("a",))], 5).script([(9, "ALTER TABLE d.t DROP d")])
    assert r.at("d", "t", 4) is None
    assert [(c.name, c.kind) for c in r.at("d", "t", 6).table.columns] == [("a", "INT64"), ("b", "TEXT"), ("c", "DECIMAL"), ("d", "JSON"), ("e", "DATETIME")]
    assert r.at("d", "t", 9).table.schema().simpleString() == "struct<a:bigint,b:string,c:decimal(9,2),e:timestamp_ntz>"


@pytest.mark.parametrize(
    "text",
    [
        "ALTER TABLE t ENGINE=InnoDB AND SOMETHING ELSE", "ALTER TABLE t SIDEWAYS", "ALTER TABLE t ADD d int SIDEWAYS", "ALTER TABLE t RENAME INDEX nowhere TO x", "ALTER TABLE t RENAME INDEX by_b TO By_C",
        "ALTER TABLE t DROP PARTITION p9", "ALTER TABLE t COALESCE PARTITION 3", "ALTER TABLE t ADD PARTITION (PARTITION P0 VALUES IN (9))", "CREATE TABLE u (a int) WHATEVER", "CREATE TABLE u (a int) PARTITION BY MOON(a)",
        "DROP TABLE t SIDEWAYS", "CREATE INDEX i ON t (a) SIDEWAYS", "ALTER TABLE t ALTER INDEX by_b SHINY", "CREATE TABLE u (a int, KEY k (a) SIDEWAYS)", "ALTER TABLE t COMMENT",
    ],
)
def test_words_that_mean_nothing_are_refused(text):
    r = built(f"CREATE TABLE t ({T3}, KEY by_b (b), KEY by_c (c)) PARTITION BY LIST (a) (PARTITION p0 VALUES IN (1), PARTITION p1 VALUES IN (2))")
    before = r.current("d", "t")
    with pytest.raises((ddl.SchemaError, DialectError)):
        r.apply(text, 9)
    assert r.current("d", "t") == before


def test_options_that_change_no_column():
    t = last(
        "CREATE TABLE t (a int NOT NULL AUTO_INCREMENT COMMENT 'x' PRIMARY KEY, b varchar(9) GENERATED ALWAYS AS (concat(a, 'x')) STORED, c datetime(3) ON UPDATE CURRENT_TIMESTAMP(3), CHECK (a > 0) NOT ENFORCED) ENGINE=InnoDB, AUTO_INCREMENT 7 DEFAULT CHARSET=latin1 COMMENT='a, b' ROW_FORMAT = DYNAMIC",
        "ALTER TABLE t ENGINE = MyISAM, ALGORITHM=INPLACE, LOCK NONE, FORCE, ORDER BY a, b DESC, ALTER COLUMN b SET DEFAULT 'z', ALTER c DROP DEFAULT, DISABLE KEYS",
    )
    assert [(c.name, c.kind, c.nullable, c.default) for c in t.columns] == [("a", "INT32", False, None), ("b", "STRING", True, "'z'"), ("c", "DATETIME", True, None)]
    assert (t.charset, t.primary) == ("latin1", ("a",))


def test_keys_go_by_any_case_and_may_be_hidden():
    t = last(f"CREATE TABLE t ({T3}, KEY I1 (b) USING BTREE INVISIBLE)", "CREATE INDEX i2 ON t (c) COMMENT 'x' INVISIBLE", "ALTER TABLE t ALTER INDEX i1 VISIBLE, RENAME INDEX i2 TO I3")
    assert (t.indexes, t.hidden) == ((("I1", ("b",)), ("I3", ("c",))), ("I3",))
    assert last(f"CREATE TABLE t ({T3}, KEY I1 (b))", "DROP INDEX i1 ON t").indexes == ()


def test_partitions():
    t = f"CREATE TABLE t ({T3}) ENGINE=InnoDB PARTITION BY RANGE COLUMNS (a) SUBPARTITION BY HASH (a) SUBPARTITIONS 2 (PARTITION p0 VALUES LESS THAN (10) ENGINE = InnoDB (SUBPARTITION s0, SUBPARTITION s1), PARTITION p1 VALUES LESS THAN MAXVALUE COMMENT = 'rest')"
    assert last(t).partitions == ("p0", "p1")
    assert last(t, "ALTER TABLE t REORGANIZE PARTITION p0 INTO (PARTITION a VALUES LESS THAN (5), PARTITION b VALUES LESS THAN (10))").partitions == ("a", "b", "p1")
    assert last(t, "ALTER TABLE t DROP PARTITION P1", "ALTER TABLE t ADD PARTITION (PARTITION p2 VALUES LESS THAN (30))", "ALTER TABLE t TRUNCATE PARTITION ALL").partitions == ("p0", "p2")
    assert last(t, "ALTER TABLE t REMOVE PARTITIONING").partitions == ()
    assert last(f"CREATE TABLE t ({T3}) PARTITION BY LINEAR KEY ALGORITHM=2 () PARTITIONS 4", "ALTER TABLE t COALESCE PARTITION 1", "ALTER TABLE t ADD PARTITION PARTITIONS 2").partitions == ("p0", "p1", "p2", "p3", "p4")
    assert last(f"CREATE TABLE t ({T3})", "ALTER TABLE t ADD d int, COMMENT 'x' PARTITION BY HASH (a) PARTITIONS 3").partitions == ("p0", "p1", "p2")
