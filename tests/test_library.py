"""Text keys, sequence kernels and merges against small cases and plain restatements."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quirework.functions import text as tx
from quirework.operators import intervals, merge, sequences


@pytest.mark.parametrize(("old", "new"), [("haue", "have"), ("heere", "here"), ("vnto", "unto"), ("stopt", "stopped"), ("groan'd", "groaned"), ("Musicke", "music"), ("ſelfe", "self")])
def test_spellings_share_a_key(spark, old, new):
    a, b = spark.createDataFrame([(old, new)], "a string, b string").select(tx.word_key(F.col("a")), tx.word_key(F.col("b"))).first()
    assert a == b != ""


def test_scalar_functions(spark):
    row = spark.createDataFrame([("xiv", "The Tempest, Act 1", ["A", "B", "C", "D"])], "r string, t string, n array<string>").select(tx.roman(F.col("r")), tx.slug(F.col("t")), tx.sort_title(F.col("t")), tx.authors(F.col("n")), tx.name_list(F.col("n")), tx.roman(F.col("t"))).first()
    assert tuple(row) == (14, "the-tempest-act-1", "tempest, act 1", "A, B, C et al.", "A, B, C and D", None)


def longest(a, b):
    return max((len(c) for k in range(len(a) + 1) for c in [p for p in itertools.combinations(a, k)] if is_sub(c, b)), default=0)


def is_sub(c, b):
    it = iter(b)
    return all(x in it for x in c)


def test_common_and_rising_against_brute_force():
    draw = random.Random(1)
    for _ in range(60):
        a, b = ([draw.choice("abc") for _ in range(draw.randrange(8))] for _ in range(2))
        for most in (1, 25_000_000):
            pairs = sequences.common(a, b, most)
            assert all(a[i] == b[j] for i, j in pairs) and len(pairs) == longest(a, b)
            assert all(x < y for x, y in zip(pairs, pairs[1:], strict=False))
        d = sequences.difference(a, b)
        assert [w for s, w in d if s != "right"] == a and [w for s, w in d if s != "left"] == b
        v = [draw.randrange(6) for _ in range(8)]
        up = lambda c: all(x < y for x, y in zip(c, c[1:], strict=False))
        assert up([v[i] for i in sequences.rising(v)]) and len(sequences.rising(v)) == max(len(c) for k in range(9) for c in itertools.combinations(v, k) if up(c))


def test_buckets_are_anchored_at_their_first_value():
    assert sequences.buckets([10, 11, 13.9, 14, 17, 900]) == [0, 0, 0, 1, 1, 2]


def test_align_blocks(spark):
    rows = [("s", "orig", 0, "line", ["haue", "you"]), ("s", "orig", 1, "sd", ["exit"]), ("s", "modern", 0, "line", ["haue", "you"]), ("s", "modern", 1, "line", ["more"]), ("s", "modern", 2, "sd", ["exit", "he"])]
    df = spark.createDataFrame(rows, "scene string, side string, n int, kind string, keys array<string>")
    got = [(r.orig, r.modern, r.relation) for r in sequences.align_blocks(df, ["scene"]).orderBy("entry").collect()]
    assert got == [([0], [0], "same"), ([], [1], "modern-only"), ([1], [2], "variant")]


def test_words_that_differ_by_a_third_are_equivalent(spark):
    assert sequences.equivalent(["haue", "sleaded"], ["have", "sledded"]) and not sequences.equivalent(["cat"], ["dog"]) and not sequences.equivalent(["a"], ["a", "b"])
    rows = [(["haue", "sleaded"], ["have", "sledded"]), (["cat"], ["dog"]), (["a"], ["a", "b"])]
    got = spark.createDataFrame(rows, "a array<string>, b array<string>").select(tx.equivalent(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [True, False, False]


def test_marks_of_early_print(spark):
    row = spark.createDataFrame([("ēuen", "cōmon", "co\u0304mon")], "a string, b string, c string").select(*[tx.word_key(F.col(c)) for c in "abc"], *[tx.plain(F.col(c)) for c in "ab"]).first()
    assert tuple(row) == ("euen", "comon", "comon", "euen", "comon")


def test_text_helpers(spark):
    row = spark.createDataFrame([("Don’t stop -- 'tis late!", "The  Tempest (1611)", "10.2")], "a string, b string, c string").select(tx.phrase_words(F.col("a")), tx.title_key(F.col("b")), tx.number_parts(F.col("c")), tx.is_form_of(F.lit("walked"), F.lit("walk")), tx.is_form_of(F.lit("walkabout"), F.lit("walk"))).first()
    assert tuple(row) == (["Don't", "stop", "'tis", "late"], "thetempest1611", [10, 2], True, False)


def test_upsert(spark):
    old, new = (spark.createDataFrame(r, "k int, v string") for r in ([(1, "a"), (2, "b")], [(2, "c"), (3, "d")]))
    assert sorted(map(tuple, merge.upsert(old, new, "k").collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_hide_merges_once(spark):
    old = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 20, 30)], "node int, start int, end int")
    new = spark.createDataFrame([(1, 3, 5)], "node int, start int, end int")
    assert sorted(map(tuple, intervals.add_hide(old, new, ["node"]).collect())) == [(1, 0, 8), (1, 20, 30)]


def test_repeated_keys_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "key int, text string")
    with pytest.raises(Exception, match="repeated key"):
        merge.stable_ids(df, df).collect()
