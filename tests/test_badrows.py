import pytest

from skyloom.operators import badrows

RING = "POLYGON 1 2 3 4 5 6"
CASES = [
    (f"a,F200W,{RING}", None), (f'"a, ""b"" c",f200w,{RING}', None), (f'a,"F200W;CLEAR","{RING}"', None), ("a, f444w ; f470n ,", None), ('a,F090W,"polygon\n1 2\n3 4\t5 +6.5e0"', None),
    (f'a"x",F200W,{RING}', "quoting"), (f'a,"F200W,{RING}', "quoting"), (f'a,F200W, "{RING}"', "quoting"), (f'a,F200W,"{RING}" x', "quoting"), ('"', "quoting"),
    ("a", "columns"), ("", "columns"), (None, "columns"), (f"a,F200W,{RING},", "columns"), ("a,F200W,POLYGON,1,2", "columns"),
    (f" ,F200W,{RING}", "obs_id"), (f'"",--,{RING}', "obs_id"),
    (f"a,,{RING}", "filters"), (f"a,F200X,{RING}", "filters"), (f"a,CLEAR;F200W,{RING}", "filters"), (f"a,F200W;,{RING}", "filters"), (f"a,F200W;F444W;CLEAR,{RING}", "filters"), (f"a,F20٣W,{RING}", "filters"),
    ("a,F200W,POLYGON 1 2 3 4", "s_region"), ("a,F200W,POLYGON 1 2 3 4 5 6 7", "s_region"), ("a,F200W,POLYGON ICRS 1 2 3 4 5 6", "s_region"), ("a,F200W,POLYGON 361 2 3 4 5 6", "s_region"),
    ("a,F200W,POLYGON 1 -91 3 4 5 6", "s_region"), ("a,F200W,POLYGON 1 inf 3 4 5 6", "s_region"), ("a,F200W,POLYGON 1 1e999 3 4 5 6", "s_region"), ("a,F200W,POLYGON 0x1 2 3 4 5 6", "s_region"),
    ("a,F200W,CIRCLE 1 2 3 4 5 6", "s_region"), ("a,F200W,POLYGON 1_0 2 3 4 5 6", "s_region"),
]


def test_reasons(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, (t, _) in enumerate(CASES)], "line_id int, raw_line string, reason string")
    got = {r["id"]: r["reason"] for r in badrows.parsed_rows(df, "line_id", "raw_line").collect()}
    assert {CASES[i][0]: g for i, g in got.items()} == dict(CASES)


def test_typed_values_and_places(spark):
    df = spark.createDataFrame([(1, f'a,"f444w;f470n",{RING}'), (2, 'abc,F200W,"x')], "i int, t string")
    a, b = sorted(badrows.parsed_rows(df, "i", "t").collect())
    assert (a["obs_id"], a["filters"], a["ring"]) == ("a", ["F444W", "F470N"], [[1, 2], [3, 4], [5, 6]])
    assert (b["reason"], b["error_at"]) == ("quoting", 10)


def test_very_long_and_empty_tables(spark):
    long = "a,F200W,POLYGON " + "1 2 " * 200_000
    got = badrows.parsed_rows(spark.createDataFrame([(1, long)], "i int, t string"), "i", "t").first()
    assert got["reason"] is None and len(got["ring"]) == 200_000
    assert badrows.parsed_rows(spark.createDataFrame([], "i int, t string"), "i", "t").count() == 0


@pytest.mark.parametrize("block", [7, 10_000])
def test_files_resume_after_broken_quotes(spark, block):
    lines, want = [], []
    for i in range(60):
        if i % 13 == 5:
            lines.append(f'o{i},"F200W,{RING}')  # swallows what follows, up to the next record start
            want.append((len(lines) - 1, "quoting"))
        elif i % 11 == 3:
            lines += [f'o{i},F200W,"POLYGON', "1 2", '3 4 5 6"']
            want.append((len(lines) - 3, None))
        else:
            lines.append(f"o{i},F200W,{RING}")
            want.append((len(lines) - 1, None))
    df = spark.createDataFrame([("f", n, x) for n, x in enumerate(lines)] + [("f", 0, lines[0])], "f string, n int, t string")
    got = badrows.parsed_files(df, "f", "n", "t", block_lines=block, look_ahead=6).collect()
    assert sorted(((r["first_line"], r["reason"]) for r in got), key=lambda w: w[0]) == want
