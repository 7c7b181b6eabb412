import json

from tests.conftest import rows
from tidelog.operators import drift

SCHEMA = "capture_id long, file_id long, row_no int, log_offset long, table_meta_id long, rec_type int, row_key string, payload string"


def captures(spark, *files):
    """(offset, rows): each row a dict, or a text kept as it is."""
    out = []
    for f, (offset, payloads) in enumerate(files):
        for k, p in enumerate(payloads):
            out.append((len(out), f, k, offset, 65536, 0, str(k), p if p is None or isinstance(p, str) else json.dumps(p)))
    return spark.createDataFrame(out, SCHEMA)


def changes(df):
    return sorted((r.log_offset, r.field, r.change) for r in drift.field_changes(df).collect())


def test_added_removed_and_retyped(spark):
    df = captures(spark, (1, [{"a": 1, "b": 2, "gone": 1}]), (2, [{"a": 1, "b": "2", "new": [1]}]))
    assert changes(df) == [(2, "b", "retyped"), (2, "gone", "removed"), (2, "new", "added")]


def test_renamed_by_what_it_holds(spark):
    df = captures(spark, (1, [{"a": k, "x": k * 3} for k in range(5)]), (2, [{"a": k, "y": k * 3 if k < 3 else -1} for k in range(5)]), (3, [{"a": k, "y": str(k * 3)} for k in range(5)]), (4, [{"a": k, "Y": k * 3} for k in range(5)]))
    assert changes(df) == [(2, "y", "renamed"), (3, "y", "retyped"), (4, "Y", "renamed"), (4, "Y", "retyped")]


def test_half_of_the_keys_is_no_rename(spark):
    df = captures(spark, (1, [{"x": k} for k in range(4)]), (2, [{"y": k if k < 2 else -1} for k in range(4)]))
    assert changes(df) == [(2, "x", "removed"), (2, "y", "added")]


def test_nulls_strays_and_unreadable_payloads(spark):
    df = captures(spark, (1, [{"a": 1.5, "n": None}] * 3 + [{"a": "n/a"}, '{"a": 1', None, "[1]", "5", ""]), (2, [{"a": 2.0}] * 2 + [{"a": True}]))
    assert changes(df) == []
    assert {r.kind for r in drift.cells(df).collect()} == {"fraction", "text", "flag"}


def test_files_of_one_position_are_one_file(spark):
    df = captures(spark, (1, [{"a": 1}]), (2, [{"a": 1}]), (2, [{"b": 1}]), (3, [{"a": 1, "b": 1}]))
    assert changes(df) == [(2, "b", "added")]


def test_control_rows_and_rows_without_table(spark):
    df = spark.createDataFrame([(1, 1, 1, 1, 65536, 16, None, '{"x": 1}'), (2, 1, 2, 1, None, 0, "k", '{"x": 1}'), (3, 1, 3, None, 65536, 0, "k", '{"x": 1}')], SCHEMA)
    assert rows(drift.field_changes(df)) == []
    assert rows(drift.field_changes(spark.createDataFrame([], SCHEMA))) == []


def test_one_consistent_table_and_failed_casts(spark):
    df = captures(spark, (1, [{"x": k} for k in range(4)]), (2, [{"y": k} for k in range(4)]), (3, [{"z": k, "t": [k]} for k in range(3)] + [{"z": "many"}]))
    values = drift.consistent_values(df, drift.field_changes(df))
    assert {r.name for r in values.collect()} == {"z", "t"}
    z = values.filter("name = 'z'").collect()
    assert len(z) == 12
    assert [(r.text, r.whole) for r in z if r.cast_failed] == [("many", None)]
    assert {tuple(r.items) for r in values.filter("name = 't'").collect()} == {("0",), ("1",), ("2",)}


def test_registry_differences(spark):
    df = captures(spark, (1, [{"a": 1, "b": "x"}]))
    known = spark.createDataFrame([(65536, "a", 28), (65536, "c", 6), (65536, "a", 28), (65537, "q", 6), (65536, None, 6)], "table_meta_id long, column_name string, col_type int")
    found = {(r.field, r.difference) for r in drift.registry_differences(df, known).collect()}
    assert found == {("a", "other_kind"), ("b", "unregistered"), ("c", "missing")}


def test_one_typed_table_for_each_captured_table(spark):
    first = [{"n": k, "old": f"v{k}", "on": True, "l": [k], "file_id": 1.5} for k in range(4)]
    c = captures(spark, (10, first), (20, [{"n": k or "x", "new": f"v{k}", "x": {"y": 1}} for k in range(4)]))
    values = drift.consistent_values(c, drift.field_changes(c))
    t = drift.consistent_table(values, 1)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in t.schema][4:] == ["file_id_ double", "l array<string>", "n bigint", "new string", "on boolean", "x string"]
    found = {(r.log_offset, r.row_key): (r.file_id_, r.l, r.n, r.new, r.on, r.x) for r in t.collect()}
    assert len(found) == 8
    assert found[10, "2"] == (1.5, ["2"], 2, "v2", True, None)
    assert found[20, "2"] == (None, None, 2, "v2", None, '{"y":1}')
    assert found[20, "0"] == (None, None, None, "v0", None, '{"y":1}')
    failed = {(r.log_offset, r.row_key): r.failed for r in drift.consistent_rows(values).collect()}
    assert failed[20, "0"] == ["n"] and failed[10, "0"] == []
