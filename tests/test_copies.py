from datetime import datetime

import numpy as np
import pytest

from skyloom.functions.presence import Presence
from skyloom.operators import copies


@pytest.mark.parametrize("size", [0, 10, 3000, 200_000])
def test_presence_and_and_not(size):
    rng = np.random.default_rng(size)
    a, b = (np.unique(rng.integers(0, 300_000, size)) for _ in range(2))
    a = np.union1d(a, np.arange(70_000, 70_000 + size))  # a long run
    p, q = Presence(a), Presence(b)
    assert (p.and_not(q).ordinals() == np.setdiff1d(a, b)).all()
    assert (p.and_(q).ordinals() == np.intersect1d(a, b)).all()
    assert (p.ordinals() == a).all()
    assert p.nbytes() <= 8192 * 6


def side(spark, rows):
    return spark.createDataFrame(rows, "k string, seen timestamp, size bigint, name string, block int")


def diff(a, b, **how):
    return {tuple(r) for r in copies.differences(a, b, "k", "seen", ["size", "name"], ("no_right", "no_left"), **how).collect()}


def test_differences(spark):
    t1, t2 = datetime(2024, 1, 1), datetime(2024, 1, 2)
    a = side(spark, [("x", t1, 1, "n", 0), ("x", t2, 2, "n", 0), ("x", t2, 2, "n", 0), ("only", t1, 1, "", 0), ("nul", t1, None, None, 0), ("late", None, 5, "q", 0), ("late", t1, 6, "q", 0), ("same", t1, 1, "s", 1)])
    b = side(spark, [("x", t1, 1, "m", 0), ("right", t1, None, None, 0), ("nul", t1, 0, None, 0), ("late", t2, 6, "q", 0), ("same", t2, 1, "s", 9), (None, t1, 1, "z", 0)])
    want = {("only", "no_right", None, None), ("right", "no_left", None, None), ("", "no_left", None, None), ("x", "size", "2", "1"), ("x", "name", "n", "m"), ("nul", "size", None, "0")}
    assert diff(a, b) == want
    assert diff(a, b, block_keys=2) == want
    assert diff(a, a) == set()


def test_empty_sides(spark):
    none = side(spark, [])
    assert diff(none, none) == set()
    assert diff(side(spark, [("x", None, 1, "n", 0)]), none) == {("x", "no_right", None, None)}


def test_one_key_with_a_third_of_the_rows(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i}", datetime(2024, 1, 1 + i % 28), i, "n", 0) for i in range(900)]
    got = diff(side(spark, rows), side(spark, rows[:-1]))
    assert got == {(f"k{899}", "no_right", None, None)} 
