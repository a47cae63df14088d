import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skyloom.llm import leakage as L

N = [f"{a}{b}" for a in "bdfgklmnprstvz" for b in ("alor", "emin", "irus", "ovak", "unet", "yden", "arth", "esto")]


def sentence(rng, n, pool=N):
    return [rng.choice(pool) for _ in range(n)]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y and x >= 0 else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def fewest(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p):
        new = [i + 1]
        for j, y in enumerate(t):
            new.append(min(row[j] + (x != y or y < 0), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=20, max_size=20), st.lists(st.integers(-1, 5), min_size=1, max_size=60))
def test_bit_parallel_checks_are_exact(p, t):
    pattern, text = np.array([p], np.int32), np.array([t], np.int32)
    assert L.common_subsequence(pattern, text)[0] == lcs(p, t)
    assert L.least_changes(pattern, text)[0] == fewest(p, t)


def test_words_ignore_the_look():
    assert L.words("> <b>Sevêral</b> ＣＡＲＴＳ,\n> the раth&amp;more") == ["several", "carts", "the", "path", "more"]


@pytest.fixture(scope="module")
def case(spark):
    """A corpus with planted passages and near misses; half its words are those of the items."""
    rng = random.Random(4)
    items = {100 + k: sentence(rng, 60) for k in range(12)}
    other = [f"w{i}" for i in range(800)]
    docs, want = {}, set()

    def put(words, holds=None):
        d = len(docs)
        pre, post = (sentence(rng, rng.randint(0, 90), N + other) for _ in range(2))
        docs[d] = pre + words + post
        if holds:
            want.add((d, holds))

    for k, w in items.items():
        for n, e in ((20, 2), (24, 3), (40, 5), (60, 3), (20, 0)):
            s = rng.randint(0, 60 - n)
            p = w[s : s + n]
            for i in sorted(rng.sample(range(1, n - 1), e), reverse=True):
                how = rng.randint(0, 2)
                p[i : i + 1] = [rng.choice(other)] if how == 0 else [] if how == 1 else [p[i], rng.choice(other)]
            put(p, k)
        put(w[:14])  # too short
        shuffled = w[:40]
        rng.shuffle(shuffled)
        put(shuffled)
        put([rng.choice(other) if i % 4 == 0 else x for i, x in enumerate(w)])  # one in four changed
    for _ in range(150):
        put(sentence(rng, 60, N + other))
    long = sentence(rng, 9000, N + other)
    long[L.PART - 10 : L.PART - 10] = items[100][:22]  # over the cut of a part
    docs[len(docs)] = long
    want.add((len(docs) - 1, 100))
    return items, docs, want


def found(spark, items, docs, **how):
    d = spark.createDataFrame([(k, t, "clash", 1) for k, t in docs], "doc_id int, text string, ids string, item_id int").repartition(3)
    i = spark.createDataFrame(items, "item_id int, text string")
    got = [tuple(r) for r in L.leaked(d, "doc_id", "text", i, "item_id", "text", **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_planted_passages(spark, case):
    items, docs, want = case
    brute = {(d, k) for d, w in docs.items() for k, x in items.items() if L.holds([ids(w, x)])[0]}
    assert brute == want
    texts = [(k, " ".join(w)) for k, w in docs.items()]
    got = found(spark, [(k, "> " + ", ".join(w).upper()) for k, w in items.items()], texts + texts[:10] + [(None, "x"), (7000, None), (7001, "")])
    assert got == want


def ids(words, item):
    n = {w: i for i, w in enumerate(sorted(set(item)))}
    return np.array([n.get(w, -1) for w in words], np.int32), np.array([n[w] for w in item], np.int32)


def test_nothing_to_find(spark):
    assert found(spark, [(1, "too short")], [(1, "too short " * 30)]) == set()
    assert found(spark, [], [(1, "text")]) == set()
    assert found(spark, [(1, " ".join(N[:30]))], []) == set()
    assert found(spark, [(1, None)], [(1, "a")]) == set()


def test_passages_interrupted_once(spark):
    rng = random.Random(9)
    items = {k: [f"{x}{k}" if i % 5 == 0 else x for i, x in enumerate(sentence(rng, 40))] for k in range(5)}
    closing = "which of these is best supported by the passage above then".split()
    items = {k: w + closing for k, w in items.items()}
    noise = [f"w{i}" for i in range(25)]
    w = items[2]
    docs = {
        0: w[3:15] + noise + w[15:26],  # held, interrupted once
        1: w[3:9] + noise + w[9:15] + noise[::-1] + w[15:23],  # three shorter phrases
        2: w[3:13] + noise,  # a shorter phrase alone
        3: w[34:40] + noise + closing,  # the rest is in every item
        4: w[14:26] + noise + w[3:14],  # in another order
    }
    assert found(spark, [(k, " ".join(x)) for k, x in items.items()], [(k, " ".join(x)) for k, x in docs.items()]) == {(0, 2)}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=8, max_size=8), st.lists(st.integers(-1, 5), min_size=1, max_size=25), st.integers(1, 7))
def test_changes_in_two_parts_are_exact(p, t, at):
    marks = np.zeros((1, 8), bool)
    marks[0, at] = True
    want = min(fewest(p[:at], t[:k]) + fewest(p[at:], t[k:]) for k in range(len(t) + 1))
    assert L.least_changes_in_two(np.array([p], np.int32), np.array([t], np.int32), marks)[0] == want


def test_items_in_blocks_find_the_same(spark, case):
    items, docs, want = case
    long = [(900, " ".join(w for k in sorted(items) for w in items[k]))]  # more words than a block
    texts = [(k, " ".join(w)) for k, w in docs.items()]
    got = found(spark, [(k, " ".join(w)) for k, w in items.items()] + long, texts, block_words=200)
    assert {x for x in got if x[1] != 900} == want and {(d, 900) for d, _ in want} <= got
