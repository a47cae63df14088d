import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skyloom.llm import packing as P

PATH = P.tokenizer_path()


def run(spark, texts, caps, parts=3, **how):
    d = spark.createDataFrame([(i, t, "clash", 7) for i, t in enumerate(texts)], "doc_id int, text string, window string, used int").repartition(parts)
    limits = spark.createDataFrame(list(enumerate(caps)), "limit_id int, capacity_tokens int")
    return P.packed(d, "doc_id", "text", limits, **how).collect()


def check(rows, texts, caps):
    size = [P.n_tokens(t, PATH) for t in texts]
    held, by_doc = defaultdict(int), defaultdict(list)
    for r in rows:
        held[r["limit_id"], r["container_id"]] += r["n_tokens"]
        by_doc[r["limit_id"], r["doc_id"]].append((r["piece"], r["start"], r["n_tokens"]))
    for (k, _), n in held.items():
        assert n <= caps[k]
    for k, cap in enumerate(caps):
        for i, n in enumerate(size):
            got = sorted(by_doc[k, i])
            assert sum(x[2] for x in got) == n and len(got) == max(1, -(-n // cap))
            assert all(x[1] == x[0] * cap for x in got)
        assert all(r["used"] == held[k, r["container_id"]] for r in rows if r["limit_id"] == k)
    return {k: (sum(1 for x in held if x[0] == k), -(-sum(size) // caps[k])) for k in range(len(caps))}


def test_every_text_whole_and_little_room_left(spark):
    rng = random.Random(1)
    texts = ["word " * rng.randint(1, 60) + str(i) for i in range(700)]
    for n, least in check(run(spark, texts, [64, 256, 1024]), texts, [64, 256, 1024]).values():
        assert n <= 1.12 * least + 1


def test_odd_texts(spark):
    texts = [None, "", "x", "longer " * 5000, "a" * 3000, "\ud83d", "日本語" * 200, "<|endoftext|>"] + [""] * 40
    check(run(spark, texts, [5, 512]), texts, [5, 512])


def test_few_open_windows_and_one_partition(spark):
    texts = ["w " * (i % 50) for i in range(300)]
    check(run(spark, texts, [64], parts=1, open_windows=1), texts, [64])


def test_empty_inputs(spark):
    assert run(spark, [], [64]) == []
    assert run(spark, ["a"], []) == []


def test_best_fit_and_fullest_first():
    o = P.Open(10, 2)
    assert list(o.put(6, ["a"])) == [] and list(o.put(7, ["b"])) == [] and list(o.put(3, ["c"])) == [(1, 10, ["b", "c"])]
    assert list(o.put(9, ["d"])) == [] and list(o.put(5, ["e"])) == [(2, 9, ["d"])]
    assert sorted(x[2] for x in o.rest()) == [["a"], ["e"]]


def test_limits_are_bounded(spark):
    d = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    many = spark.range(2000).select(F.col("id").cast("int").alias("limit_id"), F.lit(5).alias("capacity_tokens"))
    with pytest.raises(ValueError):
        P.packed(d, "doc_id", "text", many)


def test_an_id_with_several_capacities(spark):
    texts = ["word " * (k % 40) for k in range(120)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(2)
    limits = spark.createDataFrame([(1, 100), (1, 20), (1, 100)], "limit_id int, capacity_tokens int")
    held = defaultdict(int)
    for r in P.packed(d, "doc_id", "text", limits).collect():
        held[int(r["container_id"].split("-")[0]), r["container_id"]] += r["n_tokens"]
    total = sum(P.n_tokens(t, PATH) for t in texts)
    for cap in (100, 20):
        own = [n for (c, _), n in held.items() if c == cap]
        assert sum(own) == total and max(own) <= cap
