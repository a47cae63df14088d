import itertools
import unicodedata

import pytest

from skyloom.llm import lookalike as L

SAME = [
    ("café", "café"), ("Ａｂｃ １２", "Abc 12"), ("a b", "a b"), ("a b c", "a b c"), ("zero​wi‍dth­", "zerowidth"),
    ("раураl", "paypal"), ("ΑΒΕ", "ABE"), ("ﬁne ﬂow", "fine flow"), ("ガ", "ガ"), ("ｶﾞ", "ガ"),
    ("non‑break", "non-break"), ("non‐break", "non-break"), ("x\r\ny", "x\ny"), ("각", "각"), ("ạ̈", "ạ̈"), ("\U0001f642️", "\U0001f642"),
    ("а́", "á"), ("ё", "ë"), ("Ⅷ", "VIII"), ("a\tb", "a b"),
]
DIFFERENT = ["a", "A", "á", "à", "a²", "a2", "a.", "a,", "a b", "ab", "аб", "O", "0", "l", "1", "I", "ё", "e", "a’", "a'", "a–", "a-", "①", "ß", "ss", "a\nb", ""]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert a != b and L.skeleton(a) == L.skeleton(b)


def test_visible_differences_stay():
    assert len({L.skeleton(x) for x in DIFFERENT}) == len(DIFFERENT)


def test_skeleton_is_stable_and_ascii_is_kept():
    for a, b in SAME:
        s = L.skeleton(a)
        assert L.skeleton(s) == s and L.skeleton(unicodedata.normalize("NFC", a)) == s and L.skeleton(L.consistent_form(a)) == s
    assert L.skeleton("plain text, 1 + 1") == "plain text, 1 + 1"


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, text string, look string, spelling int")


def test_pairs_against_brute_force(spark):
    rows = [(i, t, "clash", 0) for i, t in enumerate([x for p in SAME for x in p] + DIFFERENT + ["​", "⁠", None, "", "x" * 300_000, "х" * 300_000])]
    got = [tuple(r) for r in L.equal_looks(docs(spark, rows + rows[:20] + [(None, "cafe", "", 0)]), "doc_id", "text").collect()]
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if None not in (a[1], b[1]) and a[1] != b[1] and L.skeleton(a[1]) == L.skeleton(b[1])}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_third_of_all_rows_with_one_text(spark):
    rows = [(i, "thanks" if i % 3 else f"t{i}", "", 0) for i in range(900)] + [(9000, "th\u0430nks", "", 0)]
    assert L.equal_looks(docs(spark, rows), "doc_id", "text").count() == 600


def test_empty_table_and_forms(spark):
    assert L.equal_looks(docs(spark, []), "doc_id", "text").count() == 0
    got = {r["doc_id"]: (r["form"], r["changed"]) for r in L.forms(docs(spark, [(1, "\uff21", "", 0), (2, "A", "", 0), (3, None, "", 0)]), "doc_id", "text").collect()}
    assert got == {1: ("A", True), 2: ("A", False), 3: (None, False)}


def test_loose_looks():
    assert L.skeleton("I1l 0O “modern”", loose=True) == L.skeleton("lll OO \"rnodern\"", loose=True)
    assert L.skeleton("I1l") != L.skeleton("lll") and L.skeleton("ᏚᎠꓳ") == "SDO"


def test_a_look_of_ten_thousand_documents(spark):
    rows = [(i, "thanks" if i % 100 else "thаnks", "", 0) for i in range(10_000)]
    assert L.equal_looks(docs(spark, rows), "doc_id", "text").count() == 9_900 * 100
    got = L.groups(docs(spark, rows + rows[:50] + [(20_000, "alone", "", 0)]), "doc_id", "text")
    assert got.count() == 10_000 and {tuple(r) for r in got.select("class_id", "n_spellings").distinct().collect()} == {(0, 2)}
