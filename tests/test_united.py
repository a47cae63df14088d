"""A field has one type over all files of its series."""

from test_drift import long, rows_of

from skyloom.operators import drift


def test_fields_are_cast_to_the_union_type(spark):
    big = 2**53 + 1
    files = [{"a": {"x": 1, "s": "007", "i": big, "n": 1, "b": True, "m": 5, "h": 2**70}}, {"a": {"x1": 1, "s": "abc", "i": 2, "n": 0.5, "b": False, "m": True, "h": 1}}, {"a": {"x1": "12"}}]
    t = long(spark, rows_of(files) + rows_of(files)[:1])
    got = {(r["file"], r["field_name"]): (r["type"], r["integer"], r["number"], r["boolean"], r["text"], r["spelling"]) for r in drift.united(t, drift.changes_of(t)).collect()}
    assert got == {
        ("s_0", "x"): ("string", None, None, None, "1", "1"), ("s_1", "x"): ("string", None, None, None, "1", "1"), ("s_2", "x"): ("string", None, None, None, "12", "12"),
        ("s_0", "s"): ("string", None, None, None, "007", "007"), ("s_1", "s"): ("string", None, None, None, "abc", "abc"),
        ("s_0", "i"): ("integer", big, None, None, None, str(big)), ("s_1", "i"): ("integer", 2, None, None, None, "2"),
        ("s_0", "n"): ("number", None, 1.0, None, None, "1"), ("s_1", "n"): ("number", None, 0.5, None, None, "0.5"),
        ("s_0", "b"): ("boolean", None, None, True, None, "true"), ("s_1", "b"): ("boolean", None, None, False, None, "false"),
        ("s_0", "m"): ("string", None, None, None, "5", "5"), ("s_1", "m"): ("string", None, None, None, "true", "true"),
        ("s_0", "h"): ("string", None, None, None, str(2**70), str(2**70)), ("s_1", "h"): ("string", None, None, None, "1", "1"),
    }
