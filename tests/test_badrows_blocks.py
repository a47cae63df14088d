"""Files cut into blocks give the records of the whole file, with the line numbers and blocks of the registered query."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from skyloom.operators import badrows

RING = "POLYGON 1 2 3 4 5 6"


def records(lines, columns=3):
    text, starts, out = "\n".join(lines), [], []
    for r in badrows.Records(text, columns).records():
        starts.append(text.count("\n", 0, r.start))
        out.append((starts[-1], text.count("\n", r.start, r.end) + 1, badrows.typed_observation(r)[3]))
    return out


def cut(spark, lines, **how):
    df = spark.createDataFrame([("f", n, x) for n, x in enumerate(lines)], "f string, n long, t string")
    return sorted((r["first_line"], r["n_lines"], r["reason"]) for r in badrows.parsed_files(df, "f", "n", "t", **how).collect())


def whole(i):
    return f"o{i},F200W,{RING}"


def test_damaged_lines_at_and_after_a_border_with_the_registered_parameters(spark, tmp_path):
    # borders at 1000, 2000 and 3000: damage on the border, over it, and a block without any anchor
    raw = [whole(i) for i in range(4_100)]
    for i in (999, 1000, 1001, 1002, *range(2000, 3000), 3000, 3001):
        raw[i] = "a,b" if i % 2 else f'o{i},"F200W,{RING}'
    raw[1003] = f'o1003,F200W,"POLYGON 1 2\n3 4\n5 6"'
    rows = [(i, "f.csv", i, x) for i, x in enumerate(raw)]
    spark.createDataFrame(rows + rows[:5], "line_id long, file_name string, line_no int, raw_line string").write.parquet(str(tmp_path / "obs_lines.parquet"))
    physical = [(i * 1000 + k, x) for i, t in enumerate(raw) for k, x in enumerate(t.split("\n"))]
    want = [(physical[first][0], n, reason) for first, n, reason in records([x for _, x in physical])]
    got = entry.queries()["p3_files"](spark, str(tmp_path)).select("first_line", "n_lines", F.col("reason")).collect()
    assert sorted(tuple(r) for r in got) == want


@pytest.mark.parametrize("block", [3, 5, 8])
def test_blocks_do_not_change_records(spark, block):
    lines = []
    for i in range(60):
        if i % 7 == 2:
            lines.append("a,b,c,d")
        elif i % 9 == 4:
            lines += [f'o{i},F200W,"POLYGON', f"x{i},F200W,{RING}", "3 4", f"y{i},F200W,", '5 6"']  # lines inside that look like record starts
        elif i % 11 == 5:
            lines.append(f'o{i},"F200W,{RING}')
        else:
            lines.append(whole(i))
    assert cut(spark, lines, block_lines=block, look_ahead=20) == records(lines)


def test_a_file_without_any_anchor(spark):
    assert cut(spark, ["a,b"] * 12, block_lines=4) == [(n, 1, "columns") for n in range(12)]


def placed(spark, raw, tmp_path):
    rows = [(i, "f.csv", i, x) for i, x in enumerate(raw)]
    spark.createDataFrame(rows, "line_id long, file_name string, line_no int, raw_line string").write.parquet(str(tmp_path / "obs_lines.parquet"))
    got = entry.queries()["p3_files"](spark, str(tmp_path)).collect()
    return sorted((r["line_no"], r["pos"], r["n_lines"], r["reason"]) for r in got)


def test_records_of_more_than_a_thousand_lines(spark, tmp_path):
    corners = "\n".join("3 4" for _ in range(1_500))
    raw = [whole(0), f'o1,F200W,"POLYGON 1 2 {corners}"', whole(2), f'o3,F200W,"POLYGON 1 2 {corners}"', whole(4)]
    assert placed(spark, raw, tmp_path) == [(0, 0, 1, None), (1, 0, 1_500, None), (2, 0, 1, None), (3, 0, 1_500, None), (4, 0, 1, None)]


def test_a_long_record_over_the_end_of_a_block(spark, tmp_path):
    # the record at 998 runs on for 700 lines into the next block, whose lines look like record starts
    inside = "\n".join(whole(90_000 + k) for k in range(700))
    raw = [whole(i) for i in range(998)] + [f'o998,F200W,"{inside}"'] + [whole(i) for i in range(999, 2_100)]
    got = placed(spark, raw, tmp_path)
    assert got == [(i, 0, 700 if i == 998 else 1, "s_region" if i == 998 else None) for i in range(2_100)]


@pytest.mark.parametrize("block", [4, 50])
def test_a_quote_never_closed(spark, block):
    lines = [whole(i) for i in range(30)]
    lines[7] = f'o7,F200W,"{RING}'
    assert cut(spark, lines, block_lines=block, look_ahead=3, longest=10) == [(n, 1, "quoting" if n == 7 else None) for n in range(30)]


def test_many_broken_quotes_are_read_in_one_pass():
    p = badrows.Records("\n".join(f'o{i},"F200W' for i in range(20_000)), 3)
    assert sum(1 for _ in p.records()) == 1 and p.found == len(p.text)
