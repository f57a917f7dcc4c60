"""Candidates for each input name: blocking by tokens, scores, merges, bonuses and top-k."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import similarity, text
from ..functions.dictionaries import BRANCH_HINTS, SYNONYMS


def top(pairs: DataFrame, k: int, by: str = "input", score: str = "score", order: str = "ref_ord") -> DataFrame:
    """The k best rows of each input, ties in order of the reference."""
    w = Window.partitionBy(by).orderBy(F.col(score).desc(), order)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def token_pairs(inputs: DataFrame, refs: DataFrame, tokens: str = "tokens") -> DataFrame:
    """input, ref, shared: how many distinct tokens both have; only pairs with one meet."""
    a = inputs.select("input", F.explode(F.array_distinct(tokens)).alias("t"))
    b = refs.select("ref", F.explode(F.array_distinct(tokens)).alias("t"))
    return a.join(b, "t").groupBy("input", "ref").agg(F.count("*").alias("shared"))


def exact(inputs: DataFrame, refs: DataFrame) -> DataFrame:
    """input, ref, pairs: names that are equal but for case, and how many pairs of rows have them.

    inputs: input; refs: ref. Rows of one name are a class, which the name itself tells: classes meet once
    each, and their rows aren't paired one by one."""
    a = inputs.groupBy("input").agg(F.count("*").alias("n")).withColumn("k", F.lower("input"))
    b = refs.groupBy("ref").agg(F.count("*").alias("m")).withColumn("k", F.lower("ref"))
    return a.join(b, "k").select("input", "ref", (F.col("n") * F.col("m")).alias("pairs"))


def keyword_jaccard(inputs: DataFrame, refs: DataFrame) -> DataFrame:
    """Jaccard of keywords of pairs that share one. inputs: input; refs: ref."""
    a = inputs.select("input", text.keywords(F.col("input")).alias("tokens"))
    b = refs.select("ref", text.keywords(F.col("ref")).alias("tokens"))
    pairs = token_pairs(a, b).join(a.select("input", F.size("tokens").alias("n")), "input").join(b.select("ref", F.size("tokens").alias("m")), "ref")
    return pairs.select("input", "ref", (F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))).alias("score"))


def idf_keywords(inputs: DataFrame, refs: DataFrame, total: DataFrame | None = None, least: float = DEFAULT.keyword_jaccard) -> DataFrame:
    """Jaccard of advanced keywords times the shared ones' ln(N / df + 1), from ``least`` Jaccard up.

    N and df count references; refs has ref and n, how many references have the name."""
    a = inputs.select("input", text.advanced_keywords(F.col("input")).alias("tokens"))
    b = refs.select("ref", "n", text.advanced_keywords(F.col("ref")).alias("tokens"))
    corpus = (refs if total is None else total).agg(F.sum("n").alias("N"))
    posted = b.select("ref", "n", F.explode("tokens").alias("t"))
    weight = posted.groupBy("t").agg(F.sum("n").alias("df")).crossJoin(corpus).select("t", F.log(F.col("N") / F.col("df") + 1).alias("w"))  # one row of corpus size
    hits = a.select("input", F.explode("tokens").alias("t")).join(posted.join(weight, "t"), "t").groupBy("input", "ref").agg(F.count("*").alias("shared"), F.sum("w").alias("w"))
    pairs = hits.join(a.select("input", F.size("tokens").alias("na")), "input").join(b.select("ref", F.size("tokens").alias("nb")), "ref")
    share = F.col("shared") / (F.col("na") + F.col("nb") - F.col("shared"))
    return pairs.withColumn("j", share).where(F.col("j") >= least).select("input", "ref", (F.col("w") * F.col("j")).alias("score"))


def ngram_overlap(inputs: DataFrame, refs: DataFrame, above: float = DEFAULT.ngram_overlap) -> DataFrame:
    """Shared letter n-grams over the larger number of them, if over ``above``."""
    a = inputs.select("input", text.char_ngrams(F.col("input")).alias("tokens"))
    b = refs.select("ref", text.char_ngrams(F.col("ref")).alias("tokens"))
    pairs = token_pairs(a, b).join(a.select("input", F.size("tokens").alias("n")), "input").join(b.select("ref", F.size("tokens").alias("m")), "ref")
    return pairs.select("input", "ref", (F.col("shared") / F.greatest("n", "m")).alias("score")).where(F.col("score") > above)


def all_pairs(inputs: DataFrame, refs: DataFrame) -> DataFrame:
    """Every distinct input name with every distinct reference name: scores that no token blocks."""
    return inputs.select("input").distinct().crossJoin(refs.select("ref").distinct())


def fuzzy(inputs: DataFrame, refs: DataFrame, least: float = 0.8) -> DataFrame:
    """Pairs whose ratio reaches ``least``. Names are compared once each; pairs that the bounds by
    length and by letters rule out never reach Python, and none that qualifies is among them."""
    a, b = F.lower("input"), F.lower("ref")
    likely = all_pairs(inputs, refs).where(similarity.length_bound(a, b) >= least).where(similarity.letter_bound(a, b) >= least)
    return likely.withColumn("score", similarity.ratio(a, b)).where(F.col("score") >= least)


def smart(pairs: DataFrame, table: Mapping[str, list[str]] = SYNONYMS, settings: Settings = DEFAULT) -> DataFrame:
    """The best of five scores and its reason, the first in this order if some are equal: direct,
    synonym, fuzzy, transliteration, partial. Pairs without any score are left out."""
    a, b = text.normalize(F.col("input")), text.normalize(F.col("ref"))
    rows = pairs.withColumn("a", a).withColumn("b", b).withColumn("wa", text.meaningful_words(F.col("a"))).withColumn("wb", text.meaningful_words(F.col("b")))
    rows = rows.withColumn("s1", similarity.direct(F.col("a"), F.col("b"), settings.compat)).withColumn("s2", similarity.synonyms(F.col("wa"), F.col("wb"), table)).withColumn("s5", similarity.partial_words(F.col("wa"), F.col("wb")))
    rows = rows.withColumn("r3", similarity.ratio(F.col("a"), F.col("b"))).withColumn("r4", similarity.ratio(text.transliterate(F.col("a")), text.transliterate(F.col("b"))))
    over = lambda c, t: F.when(F.col(c) > t, F.col(c)).otherwise(F.lit(0.0))
    scores = [F.col("s1"), F.col("s2"), over("r3", settings.smart_fuzzy), over("r4", settings.smart_translit), over("s5", settings.smart_partial)]
    best = F.greatest(*scores)
    reason = F.lit("partial_match")
    for score, name in reversed(list(zip(scores[:4], ("direct_match", "synonym_match", "fuzzy_match", "transliteration_match"), strict=True))):
        reason = F.when(score == best, name).otherwise(reason)
    return rows.withColumn("score", best).withColumn("reason", reason).where("score > 0").drop("a", "b", "wa", "wb", "s1", "s2", "s5", "r3", "r4")


def merge(smart_hits: DataFrame, keyword_hits: DataFrame, ngram_hits: DataFrame) -> DataFrame:
    """The smart score where there is a sure one, else the better of 0.6 keyword and 0.4 n-gram scores."""
    rows = smart_hits.select("input", "ref", F.col("score").alias("s"), F.lit(None).cast("double").alias("o"))
    rows = rows.unionByName(keyword_hits.select("input", "ref", F.lit(None).cast("double").alias("s"), (F.col("score") * 0.6).alias("o")))
    rows = rows.unionByName(ngram_hits.select("input", "ref", F.lit(None).cast("double").alias("s"), (F.col("score") * 0.4).alias("o")))
    return rows.groupBy("input", "ref").agg(F.coalesce(F.max("s"), F.max("o")).alias("score"))


def merge_weighted(keyword_hits: DataFrame, ngram_hits: DataFrame) -> DataFrame:
    """0.7 of the keyword score and 0.3 of the n-gram score."""
    rows = keyword_hits.select("input", "ref", (F.col("score") * 0.7).alias("score")).unionByName(ngram_hits.select("input", "ref", (F.col("score") * 0.3).alias("score")))
    return rows.groupBy("input", "ref").agg(F.sum("score").alias("score"))


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame) -> DataFrame:
    """0.6 vector + 0.4 keyword score; a vector score alone counts 0.8, or in full if the input has
    no keyword hit at all."""
    v = vector_hits.select("input", "ref", F.col("score").alias("v"))
    k = keyword_hits.select("input", "ref", F.col("score").alias("k"))
    some = F.count("k").over(Window.partitionBy("input")) > 0
    score = F.when(~some, F.col("v")).when(F.col("k").isNull(), F.col("v") * 0.8).otherwise(F.coalesce("v", F.lit(0.0)) * 0.6 + F.col("k") * 0.4)
    return v.join(k, ["input", "ref"], "full").select("input", "ref", score.alias("score"))


def hierarchy_bonus(inputs: DataFrame, ref_words: DataFrame, hints: Mapping[str, list[str]] = BRANCH_HINTS, most: float = DEFAULT.hierarchy_most) -> DataFrame:
    """input, ref, bonus: 0.1 for each hint word of the input in the keywords of each level of the
    reference's path, up to ``most``. ref_words: ref, level, tokens."""
    a = inputs.select("input", F.explode(text.hint_words(F.col("input"), hints)).alias("t"))
    b = ref_words.select("ref", "level", F.explode("tokens").alias("t"))
    return a.join(b, "t").groupBy("input", "ref").agg(F.least(F.lit(most), F.count("*") * 0.1).alias("bonus"))


def with_bonus(hits: DataFrame, bonus: DataFrame, weight: float = DEFAULT.hierarchy_weight) -> DataFrame:
    return hits.join(bonus, ["input", "ref"], "left").withColumn("score", F.col("score") + weight * F.coalesce("bonus", F.lit(0.0))).drop("bonus")


def funnel(inputs: DataFrame, refs: DataFrame, ref_words: DataFrame, table=SYNONYMS, hints=BRANCH_HINTS, settings: Settings = DEFAULT) -> DataFrame:
    """All steps: sure smart matches, keywords, n-grams, merge, the fuzzy step for inputs without a
    sure match, the bonus, the best ``candidates``. refs: ref, ref_ord, n (references of the name)."""
    named = smart(all_pairs(inputs, refs), table, settings).join(refs.select("ref", "ref_ord"), "ref")
    sure = top(named, 2 * settings.candidates).where(F.col("score") >= settings.smart_sure)
    merged = merge(sure, idf_keywords(inputs, refs, least=settings.keyword_jaccard), ngram_overlap(inputs, refs, settings.ngram_overlap)).join(refs.select("ref", "ref_ord"), "ref")
    with_sure = sure.select("input").distinct()
    calm = merged.join(with_sure, "input", "left_semi")
    tried = top(merged.join(with_sure, "input", "left_anti"), settings.fuzzy_top)
    sim = similarity.ratio(F.lower("input"), F.lower("ref"))
    tried = tried.withColumn("sim", sim).where(F.col("sim") >= settings.fuzzy_ratio).withColumn("score", F.col("score") * 0.6 + F.col("sim") * 0.4)
    both = calm.select("input", "ref", "ref_ord", "score").unionByName(tried.select("input", "ref", "ref_ord", "score"))
    return top(with_bonus(both, hierarchy_bonus(inputs, ref_words, hints, settings.hierarchy_most), settings.hierarchy_weight), settings.candidates)


def cascade(inputs: DataFrame, refs: DataFrame, limit: int = 10, ratio_least: float = 0.6) -> DataFrame:
    """Exact, then fuzzy, then keyword matches of each input, up to ``limit``; a reference may come
    once in each tier. refs: ref, ref_ord."""
    tier = lambda df, n, score=None: df.select("input", "ref", F.lit(n).alias("tier"), (F.lit(1.0) if score is None else F.col(score)).alias("score"))
    rows = tier(exact(inputs, refs.select("ref")), 1).unionByName(tier(fuzzy(inputs, refs, ratio_least), 2, "score")).unionByName(tier(keyword_jaccard(inputs, refs), 3, "score"))
    rows = rows.join(refs.select("ref", "ref_ord"), "ref")
    w = Window.partitionBy("input").orderBy("tier", F.col("score").desc(), "ref_ord")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def prefilter(inputs: DataFrame, refs: DataFrame, each: int = 5) -> DataFrame:
    """The references that some input has as an exact match or among its 5 best fuzzy or keyword ones."""
    order = refs.select("ref", "ref_ord")
    hits = exact(inputs, refs.select("ref")).select("ref")
    for found in (fuzzy(inputs, refs, 0.6), keyword_jaccard(inputs, refs)):
        hits = hits.unionByName(top(found.join(order, "ref"), each).select("ref"))
    return refs.join(hits.distinct(), "ref", "left_semi")


def auto_match(inputs: DataFrame, refs: DataFrame, table: Mapping[str, list[str]] | None = None, settings: Settings = DEFAULT) -> DataFrame:
    """The first reference, in order, that is equal, nearly equal or a synonym: not the best one."""
    a, b = text.normalize(F.col("input")), text.normalize(F.col("ref"))
    words = lambda c: F.filter(F.split(c, " "), lambda w: w != "")
    own = {} if table is None else {"table": table}
    rows = all_pairs(inputs, refs).withColumn("a", a).withColumn("b", b).where((F.col("input") != "") & (F.col("ref") != ""))
    rows = rows.withColumn("syn", similarity.basic_synonyms(words(F.col("a")), words(F.col("b")), **own))
    possible = (F.col("a") == F.col("b")) | (F.col("syn") >= settings.auto_synonym) | ((similarity.length_bound(F.col("a"), F.col("b")) >= settings.auto_ratio) & (similarity.letter_bound(F.col("a"), F.col("b")) >= settings.auto_ratio))
    rows = rows.where(possible).withColumn("r", similarity.ratio(F.col("a"), F.col("b")))
    score: Column = F.when(F.col("a") == F.col("b"), 1.0).when(F.col("r") >= settings.auto_ratio, F.col("r")).when(F.col("syn") >= settings.auto_synonym, F.col("syn"))
    hits = rows.withColumn("score", score).where("score is not null").join(refs.select("ref", "ref_ord"), "ref")
    return hits.groupBy("input").agg(F.min_by(F.struct("ref", "score"), "ref_ord").alias("m")).select("input", "m.ref", "m.score")


def relevant(batched: DataFrame, refs: DataFrame, most: int = 100, by: str = "batch_id") -> DataFrame:
    """by, ref, ref_ord, shared, rank: the references that share most distinct words with all of a batch's
    names together, ties in their order. batched: by, input; refs: ref, ref_ord."""
    mine = batched.select(by, F.explode(text.batch_words(F.col("input"))).alias("t")).distinct()
    theirs = refs.select("ref", "ref_ord", F.explode(text.batch_words(F.col("ref"))).alias("t"))
    met = mine.join(theirs, "t").groupBy(by, "ref", "ref_ord").agg(F.count("*").alias("shared"))
    return top(met, most, by, "shared")


def filtered_then_vectors(found: DataFrame, vector_hits: DataFrame, limit: int = 10, fixed: float = 0.8) -> DataFrame:
    """input, ref, match_type, score, rank: the first ``limit`` of a funnel at a fixed score; an input with
    fewer is filled up by as many vector hits as are missing, without references that it has already.

    found: input, ref, rank; vector_hits: input, ref, score, rank."""
    first = found.where(F.col("rank") <= limit).select("input", "ref", F.lit("advanced_filter").alias("match_type"), F.lit(fixed).alias("score"), "rank")
    many = first.groupBy("input").agg(F.count("*").alias("n"))
    wanted = vector_hits.join(many, "input", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).where(F.col("rank") <= limit - F.col("n"))
    new = wanted.join(first.select("input", "ref"), ["input", "ref"], "left_anti")
    rows = first.unionByName(new.select("input", "ref", F.lit("vector_search").alias("match_type"), "score", (F.col("n") + F.col("rank")).alias("rank")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("input").orderBy("rank")))


def statistics(hits: DataFrame, inputs: DataFrame) -> DataFrame:
    """One row: inputs, those with a candidate, candidates, and the mean and the most of an input."""
    each = inputs.select("input").distinct().join(hits.groupBy("input").agg(F.count("*").alias("n")), "input", "left").select(F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return each.agg(F.count("*").alias("inputs"), F.count_if(F.col("n") > 0).alias("with_candidates"), F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("candidates"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean"), F.coalesce(F.max("n"), F.lit(0).cast("long")).alias("most"))


def vector_backfill(hits: DataFrame, vector_hits: DataFrame, most: int = DEFAULT.candidates) -> DataFrame:
    """hits, and after them vector hits of references that aren't among them, up to ``most``."""
    rows = hits.select("input", "ref", "ref_ord", "score", F.lit(0).alias("source")).unionByName(vector_hits.select("input", "ref", "ref_ord", "score", F.lit(1).alias("source")))
    once = rows.groupBy("input", "ref").agg(F.min(F.struct("source", (-F.col("score")).alias("s"), "ref_ord")).alias("m")).select("input", "ref", "m.source", (-F.col("m.s")).alias("score"), "m.ref_ord")
    w = Window.partitionBy("input").orderBy("source", F.col("score").desc(), "ref_ord")
    return once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
