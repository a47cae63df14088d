"""Schema drift against a plain Python walk over the files."""

import json
import random
from datetime import datetime, timedelta

from skyloom.operators import drift

T0 = datetime(2024, 1, 1)


def table(spark, rows):
    return spark.createDataFrame(rows, "record_id bigint, series string, file string, grp string, payload string, produced timestamp, header string, type string")


def long(spark, rows):
    return drift.fields_of(table(spark, rows), "series", "file", "produced", "grp", "record_id", "payload")


def changes(spark, rows):
    return {(r["file"], r["field_name"], r["change_kind"], r["old_name"]) for r in drift.changes_of(long(spark, rows)).collect()}


def rows_of(files, series="s"):
    """files: list of {group: payload dict or text}."""
    out = []
    for n, f in enumerate(files):
        for g, p in f.items():
            out.append((len(out), series, f"{series}_{n}", g, p if isinstance(p, str) or p is None else json.dumps(p), T0 + timedelta(hours=20 * n), "clash", "clash"))
    return out


def test_kinds_of_changes(spark):
    files = [
        {"a": {"x": 1, "y": 0.5, "z": "t"}, "b": {"x": 2, "y": 0.25, "z": "u"}},
        {"a": {"x1": 1, "y": 0.5, "z": "t"}, "b": {"x1": 3, "y": 0.25, "z": "u"}, "c": {"x1": 9, "y": 1.5, "z": "v"}},  # half of the common groups agree
        {"a": {"x1": 1.0, "y": "0.5", "z": True, "w": None}, "b": {"x1": 3.0, "y": "0.25", "z": False}},
        {"a": {"x1": 1.0, "why": 0.5, "w": 3}, "b": {"x1": 3.0, "why": 0.25}},  # renamed and another type
        {"a": '{"x1": NaN, "why": 0.5}', "b": '{"x1": NaN, "why": 0.5, "w": 3}'},
        {"a": "not json", "b": None, "c": "[1]", "d": {"x1": 1}},
    ]
    got = changes(spark, rows_of(files) + rows_of(files)[:3])
    assert got == {
        ("s_1", "x1", "renamed", "x"), ("s_2", "x1", "type", None), ("s_2", "y", "type", None), ("s_2", "z", "type", None), ("s_2", "w", "added", None),
        ("s_3", "why", "renamed", "y"), ("s_3", "why", "type", "y"), ("s_3", "z", "removed", None),
        ("s_5", "why", "removed", None), ("s_5", "w", "removed", None),
    }


def test_no_rename_without_common_values(spark):
    assert changes(spark, rows_of([{"a": {"x": 1}, "b": {"x": 2}, "c": {"x": 3}}, {"a": {"v": 1}, "b": {"v": 7}, "c": {"v": 8}}])) == {("s_1", "v", "added", None), ("s_1", "x", "removed", None)}
    assert changes(spark, rows_of([{"a": {"x": 1}}, {"b": {"v": 1}}])) == {("s_1", "v", "added", None), ("s_1", "x", "removed", None)}


def test_the_best_pair_is_taken_and_names_only_once(spark):
    files = [{"a": {"x": 1, "y": 1}, "b": {"x": 2, "y": 3}}, {"a": {"p": 1, "q": 1}, "b": {"p": 2, "q": 4}}]
    assert changes(spark, rows_of(files)) == {("s_1", "p", "renamed", "x"), ("s_1", "q", "renamed", "y")}


def test_empty_table(spark):
    assert changes(spark, []) == set()


def test_files_far_apart_and_out_of_order_follow_production(spark):
    rows = [(i, "s", f"f{i}", "g", json.dumps({"a": 1} if i % 2 else {"a": 1, "b": 2}), T0 + timedelta(hours=7 * i), "", "") for i in range(30)]
    random.Random(1).shuffle(rows)
    assert changes(spark, rows) == {(f"f{i}", "b", "removed" if i % 2 else "added", None) for i in range(1, 30)}


def test_consistent_table_keeps_first_names_and_one_type(spark):
    files = [{"a": {"x": 1, "z": "t"}}, {"a": {"x1": "1", "z": True}}, {"a": {"x2": 1.0, "z": "5"}}, {"a": {"x2": 4}}]
    t = long(spark, rows_of(files))
    got = sorted((r["file"], r["field_name"], r["number"], r["text"]) for r in drift.consistent(t, drift.changes_of(t)).collect())
    assert got == [("s_0", "x", 1.0, None), ("s_0", "z", None, "t"), ("s_1", "x", 1.0, None), ("s_1", "z", None, "true"), ("s_2", "x", 1.0, None), ("s_2", "z", None, "5"), ("s_3", "x", 4.0, None)]


def test_lattice(spark):
    t = long(spark, rows_of([{"a": {"i": 1, "m": 1, "b": True}, "b": {"i": 2, "m": 1.5, "b": "x"}}]))
    assert drift.headers_of(t).first()["header"] == {"i": drift.INTEGER, "m": drift.NUMBER, "b": drift.STRING}


def test_union_schema_and_promotions(spark):
    files = [{"a": {"x": 1, "z": "t", "n": 1}}, {"a": {"x1": 1, "z": True, "n": 0.5}, "b": {"x1": 2}}, {"a": {"x1": 2, "n": None}}]
    t = long(spark, rows_of(files) + rows_of(files)[:1])
    got = {r["field_name"]: tuple(r)[2:] for r in drift.promotions(t, drift.changes_of(t)).collect()}
    assert got == {"x": ("integer", "integer", 2, 3, False), "z": ("string", "boolean,string", 1, 2, True), "n": ("number", "integer,number", 1, 2, True)}


def test_a_field_of_strings_stays_a_text(spark):
    t = long(spark, rows_of([{"a": {"code": "007", "m": 1}}, {"a": {"code": "12", "m": "x"}}]))
    got = sorted((r["file"], r["field_name"], r["number"], r["text"]) for r in drift.consistent(t, drift.changes_of(t)).collect())
    assert got == [("s_0", "code", None, "007"), ("s_0", "m", None, "1"), ("s_1", "code", None, "12"), ("s_1", "m", None, "x")]
