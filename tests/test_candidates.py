import pytest

from taxoweave.operators import candidates, tfidf

REFS = [("Глушники", 1, 1), ("Масла моторні", 2, 1), ("Розпродаж", 3, 1), ("Шоломи", 4, 1), ("Фільтри автомобільні", 5, 1)]
INPUTS = ["Глушители автомобильные", "Моторное масло синтетическое", "Товары со скидкой", "Шлемы мотоциклетные", "Фильтры воздушные для авто"]


@pytest.fixture(scope="module")
def refs(spark):
    return spark.createDataFrame(REFS, "ref string, ref_ord int, n int")


@pytest.fixture(scope="module")
def inputs(spark):
    return spark.createDataFrame([(x,) for x in INPUTS], "input string")


def test_smart_matches(inputs, refs):
    hits = candidates.top(candidates.smart(candidates.all_pairs(inputs, refs)).join(refs, "ref"), 3)
    got = {}
    for r in hits.orderBy("rank").collect():
        got.setdefault(r.input, []).append((r.ref, round(r.score, 6), r.reason))
    s = "synonym_match"
    assert got == {
        INPUTS[0]: [("Глушники", 0.9, s), ("Фільтри автомобільні", 0.9, s)],
        INPUTS[1]: [("Масла моторні", 1.2, s)],
        INPUTS[2]: [("Розпродаж", 0.45, s)],
        INPUTS[3]: [("Шоломи", 0.9, s)],
        INPUTS[4]: [("Фільтри автомобільні", 0.9, s)],
    }


def test_exact_pairs_classes_and_not_rows(spark):
    """Four hundred thousand equal names on either side: 160 billion pairs, which one by one would take hours."""
    from pyspark.sql import functions as F

    rows = [("Bolt",), ("bolt",), ("bolt",), ("nut",), (None,), ("",)]
    inputs = spark.createDataFrame(rows, "input string")
    refs = spark.createDataFrame([("BOLT",), ("bolt",), ("bolt",), ("Nuts",), (None,), ("",), ("",)], "ref string")
    got = {(r.input, r.ref): r.pairs for r in candidates.exact(inputs, refs).collect()}
    assert got == {("Bolt", "BOLT"): 1, ("Bolt", "bolt"): 2, ("bolt", "BOLT"): 2, ("bolt", "bolt"): 4, ("", ""): 2}
    many = spark.range(400_000).select(F.lit("Bolt").alias("input"))
    assert [(r.ref, r.pairs) for r in candidates.exact(many, many.select(F.lower("input").alias("ref"))).collect()] == [("bolt", 160_000_000_000)]


def test_automatic_match_takes_the_first_and_not_the_best(spark):
    refs = spark.createDataFrame([("масла", 1), ("масло", 2)], "ref string, ref_ord int")
    inputs = spark.createDataFrame([("Масло",), ("zzz",)], "input string")
    rows = candidates.auto_match(inputs, refs).collect()
    assert [(r.input, r.ref, r.score) for r in rows] == [("Масло", "масла", 0.9)]


def test_fuzzy_finds_what_all_pairs_would(spark):
    from difflib import SequenceMatcher

    names = ["red bolt", "red bolts", "old bolt", "gear", "big gear wheel", ""]
    a = spark.createDataFrame([(x,) for x in names], "input string")
    got = {(r.input, r.ref) for r in candidates.fuzzy(a, a.toDF("ref"), 0.6).collect()}
    assert got == {(x, y) for x in names for y in names if SequenceMatcher(None, x, y).ratio() >= 0.6}


def test_merge_and_hybrid(spark):
    rows = lambda *r: spark.createDataFrame(list(r) or [("-", "-", 0.0)], "input string, ref string, score double").where("input <> '-'")
    got = {(r.input, r.ref): r.score for r in candidates.merge(rows(("a", "x", 0.9)), rows(("a", "x", 5.0), ("a", "y", 1.0)), rows(("a", "y", 0.5))).collect()}
    assert got == {("a", "x"): 0.9, ("a", "y"): 0.6}
    got = {(r.input, r.ref): round(r.score, 6) for r in candidates.hybrid(rows(("a", "x", 1.0), ("b", "x", 0.5), ("a", "z", 1.0)), rows(("a", "x", 0.5), ("a", "y", 0.5))).collect()}
    assert got == {("a", "x"): 0.8, ("a", "y"): 0.2, ("a", "z"): 0.8, ("b", "x"): 0.5}


def test_cascade_may_name_a_reference_in_each_tier(spark):
    refs = spark.createDataFrame([("red bolt", 1), ("old bolt", 2)], "ref string, ref_ord int")
    rows = candidates.cascade(spark.createDataFrame([("Red bolt",)], "input string"), refs).orderBy("rank").collect()
    assert [(r.ref, r.tier) for r in rows][:2] == [("red bolt", 1), ("red bolt", 2)]
    assert rows[1].score == 1.0


def test_tfidf_by_hand(spark):
    import math

    docs = spark.createDataFrame([(1, "red bolt"), (2, "red red gear"), (3, "nut")], "key int, name string")
    posted = tfidf.postings(docs)
    model = {r.term: r.idf for r in tfidf.fit(posted, docs).collect()}
    assert model["red"] == pytest.approx(math.log(4 / 3) + 1)
    assert model["nut"] == pytest.approx(math.log(4 / 2) + 1)
    w = {(r.key, r.term): r.w for r in tfidf.weights(posted, tfidf.fit(posted, docs)).collect()}
    assert sum(v * v for (k, _), v in w.items() if k == 2) == pytest.approx(1)
    assert w[2, "red"] / w[2, "gear"] == pytest.approx((1 + math.log(2)) * model["red"] / model["gear"])


def test_funnel_keeps_its_limit_and_total_order(inputs, refs, spark):
    words = spark.createDataFrame([("Шоломи", 0, ["шоломи"])], "ref string, level int, tokens array<string>")
    rows = candidates.funnel(inputs, refs, words).collect()
    assert max(r.rank for r in rows) <= 25
    assert {r.input for r in rows if r.rank == 1} >= {INPUTS[0], INPUTS[1], INPUTS[3], INPUTS[4]}
