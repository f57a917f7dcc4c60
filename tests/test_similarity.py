import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from taxoweave.functions import similarity

def score(spark, a, b, f, kind="string"):
    return spark.createDataFrame([(a, b)], f"a {kind}, b {kind}").select(f(F.col("a"), F.col("b")).alias("s")).first().s


def test_direct(spark):
    assert score(spark, "abc", "abc", similarity.direct) == 1
    assert score(spark, "abc", "abcdef", similarity.direct) == 0.5
    assert score(spark, "abc", "xyz", similarity.direct) == 0
    # equal lengths count as equal in compat
    assert score(spark, "abc", "xyz", lambda a, b: similarity.direct(a, b, True)) == 1


def test_ratio_is_the_block_ratio_and_bounds_hold(spark):
    rng, A, B = random.Random(4), F.col("a"), F.col("b")
    word = lambda: "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 9)))
    pairs = [(word(), word()) for _ in range(150)] + [("", ""), ("a" * 250, "ab" * 120)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.ratio(A, B).alias("r"), similarity.letter_bound(A, B).alias("q"), similarity.length_bound(A, B).alias("l")).collect()
    for r in rows:
        assert r.r == SequenceMatcher(None, r.a, r.b).ratio()
        assert r.q == pytest.approx(SequenceMatcher(None, r.a, r.b).quick_ratio())
        assert r.r <= r.q + 1e-12 <= r.l + 2e-12


def test_synonyms_add_up_both_ways(spark):
    table = {"x": ["y"], "y": ["x"], "p q": ["z"]}
    f = lambda a, b: similarity.synonyms(a, b, table)
    assert score(spark, ["x"], ["y"], lambda a, b: similarity.synonyms(a, b, {"w": ["y"], "y": ["x"]}), "array<string>") == 0.9
    assert score(spark, ["x", "k"], ["y"], f, "array<string>") == pytest.approx(0.9)  # 1.8 over 2 words
    assert score(spark, ["p", "q"], ["z"], f, "array<string>") == 1
    assert score(spark, [], [], f, "array<string>") == 0


def test_partial_words(spark):
    assert score(spark, ["motoroil"], ["motorist", "oil"], similarity.partial_words, "array<string>") == pytest.approx((0.7 + 0.8) / 2)
    assert score(spark, [], ["x"], similarity.partial_words, "array<string>") == 0


def test_basic_synonyms_look_at_the_first_side_only(spark):
    assert score(spark, ["масло", "x"], ["oil", "y", "z"], similarity.basic_synonyms, "array<string>") == pytest.approx(0.45)
    assert score(spark, ["oil"], ["масло"], similarity.basic_synonyms, "array<string>") == pytest.approx(0.9)


def test_sets(spark):
    assert score(spark, ["a", "b"], ["b", "c"], similarity.jaccard, "array<string>") == pytest.approx(1 / 3)
    assert score(spark, [], [], similarity.jaccard, "array<string>") == 0
    assert score(spark, ["a", "b"], ["b"], similarity.overlap, "array<string>") == 0.5


def test_confidence(spark):
    rows = spark.createDataFrame([(None,), ("0.9",), ("x",), ("1.7",), ("-1",)], "a string").select(similarity.confidence(F.col("a")).alias("c")).collect()
    assert [r.c for r in rows] == [0, 0.9, 0, 1, 0]
