"""Each operator as a query over the driver's tables, with the same in DuckDB's SQL where it can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import similarity, text
from ..functions.dictionaries import PART_HINTS, PART_SYNONYMS
from ..operators import cache, candidates, monitor, report, resolver, routing, tfidf, tree
from . import pipelines, sql
from .parts import IN_SQL, NAMES_SQL, REF_SQL, input_names, inputs, leaves, ref_names, ref_words, reference, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLE[f.__name__] = oracle
        return f

    return add


def rounded(c, places: int = 6):
    return F.round(c, places)


def digest(words) -> F.Column:
    return F.md5(F.array_join(F.array_sort(words), " "))


_DIGEST = "md5(array_to_string(list_sort({0}), ' '))"

# ---- trees ---------------------------------------------------------------------------------

_NODE = "ord, id, name, path, parent_id, children_count, is_leaf, full_path"


@query(f"WITH {REF_SQL} SELECT {_NODE} FROM ref_tree")
def tree_nodes(spark, d):
    return tree.build(reference(spark, d)).select(*_NODE.split(", "))


@query(f"WITH {IN_SQL} SELECT id, name, full_path FROM inp_tree WHERE is_leaf")
def tree_leaves(spark, d):
    return leaves(inputs(spark, d)).select("id", "name", "full_path")


@query(f"WITH {IN_SQL} SELECT i.id, i.name FROM inp_ids i WHERE len(i.ids) = 1 OR NOT EXISTS (SELECT 1 FROM inp o WHERE starts_with(o.path, i.path || '>'))")
def prefix_leaves(spark, d):
    return tree.prefix_leaves(inputs(spark, d)).select("id", "name")


@query(f"WITH {REF_SQL} SELECT id, name FROM ref_par WHERE id NOT IN (SELECT parent_id FROM ref_par WHERE parent_id IS NOT NULL)")
def parentless_leaves(spark, d):
    return tree.parentless_leaves(tree.with_parents(reference(spark, d))).select("id", "name")


@query(f"WITH {REF_SQL} SELECT x.id, (x.n - x.pos)::INTEGER AS level, x.part AS ancestor_id, r.name AS ancestor_name FROM (SELECT id, len(ids) AS n, unnest(ids) AS part, unnest(range(1, len(ids) + 1)) AS pos FROM ref_ids) x JOIN ref r ON r.id = x.part WHERE x.pos < x.n")
def tree_ancestors(spark, d):
    return tree.ancestors(reference(spark, d)).select("id", "level", "ancestor_id", "ancestor_name")


@query(f"WITH {IN_SQL} SELECT id, full_path, len(ids)::INTEGER AS depth FROM inp_tree")
def full_path(spark, d):
    return tree.build(inputs(spark, d)).select("id", "full_path", F.size("path_ids").alias("depth"))


@query(f"WITH {REF_SQL} SELECT id, children_count FROM ref_tree WHERE NOT is_leaf")
def children_count(spark, d):
    return tree.children_count(tree.with_parents(reference(spark, d))).where("not is_leaf").select("id", "children_count")


@query(f"WITH {REF_SQL}, p AS (SELECT ids[1] AS root_id, id, row_number() OVER (PARTITION BY ids[1] ORDER BY is_leaf DESC, ord) AS place FROM ref_tree) SELECT root_id, id, place::INTEGER AS place FROM p WHERE place <= 50")
def branch_context(spark, d):
    return tree.branch_context(tree.build(reference(spark, d)), DEFAULT.branch_context).select("root_id", "id", "place")


# ---- text ----------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({sql.normalize('text')}) AS normal, length({sql.normalize('text')}) AS n FROM documents")
def normalize_text(spark, d):
    n = text.normalize(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(n).alias("normal"), F.length(n).cast("long").alias("n"))


@query(f"SELECT doc_id, len({sql.keywords('text')}) AS n, {_DIGEST.format(sql.keywords('text'))} AS words FROM documents")
def keywords(spark, d):
    k = text.keywords(F.col("text"))
    return table(spark, d, "documents").select("doc_id", k.alias("k")).select("doc_id", F.size("k").cast("long").alias("n"), digest(F.col("k")).alias("words"))


@query(f"SELECT doc_id, len({sql.keyword_list('text')}) AS n, md5(array_to_string({sql.keyword_list('text')}, ' ')) AS words FROM documents")
def keyword_list(spark, d):
    return table(spark, d, "documents").select("doc_id", text.keyword_list(F.col("text")).alias("k")).select("doc_id", F.size("k").cast("long").alias("n"), F.md5(F.array_join("k", " ")).alias("words"))


@query(f"SELECT doc_id, len({sql.advanced('text')}) AS n, {_DIGEST.format(sql.advanced('text'))} AS words FROM documents")
def adv_keywords(spark, d):
    return table(spark, d, "documents").select("doc_id", text.advanced_keywords(F.col("text")).alias("k")).select("doc_id", F.size("k").cast("long").alias("n"), digest(F.col("k")).alias("words"))


@query(f"SELECT DISTINCT word, {sql.stem('word')} AS root FROM (SELECT unnest({sql.keywords('text')}) AS word FROM documents)")
def stem(spark, d):
    words = table(spark, d, "documents").select(F.explode(text.keywords(F.col("text"))).alias("word")).distinct()
    return words.select("word", text.stem(F.col("word")).alias("root"))


@query(f"SELECT item_id, len({sql.char_ngrams('text')}) AS n, {_DIGEST.format(sql.char_ngrams('text'))} AS grams FROM benchmark")
def char_ngrams(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.char_ngrams(F.col("text")).alias("g")).select("item_id", F.size("g").cast("long").alias("n"), digest(F.col("g")).alias("grams"))


@query(f"SELECT item_id, len({sql.word_ngrams('text')}) AS n, {_DIGEST.format(sql.word_ngrams('text'))} AS grams FROM benchmark")
def word_ngrams(spark, d):
    return table(spark, d, "benchmark").select("item_id", text.word_ngrams(F.col("text")).alias("g")).select("item_id", F.size("g").cast("long").alias("n"), digest(F.col("g")).alias("grams"))


@query(f"SELECT doc_id, md5({sql.translit('lower(text)')}) AS t FROM documents")
def translit(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.transliterate(F.lower("text"))).alias("t"))


@query("SELECT event_id, printf('%02d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) AS took FROM (SELECT event_id, floor(value * 1000)::BIGINT AS s FROM events)")
def duration_fmt(spark, d):
    return table(spark, d, "events").select("event_id", text.duration(F.col("value") * 1000).alias("took"))


@query(f"SELECT DISTINCT name, {_DIGEST.format(sql.meaningful(sql.normalize('name')))} AS words FROM (SELECT p_name || ' for the ' || p_type AS name FROM part)")
def meaningful_words(spark, d):
    rows = table(spark, d, "part").select(F.concat_ws(" for the ", "p_name", "p_type").alias("name")).distinct()
    return rows.select("name", digest(text.meaningful_words(text.normalize(F.col("name")))).alias("words"))


# ---- indexes and exact routes ----------------------------------------------------------------


@query(f"WITH {REF_SQL}, {IN_SQL} SELECT lower(i.name) AS k, count(*) AS pairs FROM (SELECT lower(name) AS name, count(*) AS n FROM inp GROUP BY 1) i JOIN ref r ON lower(r.name) = i.name, range(i.n) GROUP BY 1")
def exact_match(spark, d):
    met = candidates.exact(inputs(spark, d).select(F.col("name").alias("input")), reference(spark, d).select(F.col("name").alias("ref")))
    return met.groupBy(F.lower("input").alias("k")).agg(F.sum("pairs").alias("pairs"))


@query(f"WITH {REF_SQL} SELECT lower(name) AS token, count(*) AS n, min(id) AS first FROM ref_tree WHERE is_leaf GROUP BY 1")
def name_index(spark, d):
    return leaves(reference(spark, d)).groupBy(F.lower("name").alias("token")).agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query(f"WITH {REF_SQL} SELECT token, count(DISTINCT id) AS n, min(id) AS first FROM (SELECT id, unnest({sql.keywords('name')}) AS token FROM ref) GROUP BY 1")
def keyword_index(spark, d):
    return reference(spark, d).select("id", F.explode(text.keywords(F.col("name"))).alias("token")).groupBy("token").agg(F.countDistinct("id").alias("n"), F.min("id").alias("first"))


@query(f"WITH {REF_SQL} SELECT part, count(*) AS n FROM (SELECT unnest(ids) AS part FROM ref_ids) GROUP BY 1 HAVING count(*) > 1")
def path_index(spark, d):
    return reference(spark, d).select(F.explode(text.path_ids(F.col("path"))).alias("part")).groupBy("part").agg(F.count("*").alias("n")).where("n > 1")


@query(f"WITH {REF_SQL} SELECT (SELECT count(*) FROM ref) AS categories, count(DISTINCT token) AS words FROM (SELECT unnest({sql.keywords('name')}) AS token FROM ref)")
def index_metadata(spark, d):
    r = reference(spark, d)
    return r.agg(F.count("*").alias("categories")).crossJoin(r.select(F.explode(text.keywords(F.col("name"))).alias("t")).agg(F.countDistinct("t").alias("words")))


_ROUTE = f"""WITH {REF_SQL}, {IN_SQL},
b AS (SELECT lower(name) AS k, full_path AS rp, min(ord) AS ord, arg_min(id, ord) AS id, count(*) AS n FROM ref_tree WHERE is_leaf GROUP BY 1, 2),
a AS (SELECT DISTINCT lower(name) AS k, full_path AS ip FROM inp_tree WHERE is_leaf),
s AS (SELECT a.k, a.ip, b.id, b.ord, b.n, {sql.jaccard(sql.path_words('a.ip'), sql.path_words('b.rp'))} AS s FROM a JOIN b USING (k)),
best AS (SELECT k, ip, sum(n) OVER (PARTITION BY k, ip) AS n_refs, id, s, row_number() OVER (PARTITION BY k, ip ORDER BY s DESC, ord) AS r FROM s)"""


@query(_ROUTE + " SELECT i.id, CASE WHEN n_refs = 1 THEN 1.0 WHEN s > 0.3 THEN 0.9 END AS confidence, CASE WHEN n_refs = 1 OR s > 0.3 THEN best.id END AS match_id, CASE WHEN n_refs = 1 OR s > 0.3 THEN 'exact' END AS match_method FROM inp_tree i LEFT JOIN best ON best.k = lower(i.name) AND best.ip = i.full_path AND r = 1 WHERE i.is_leaf")
def exact_router(spark, d):
    return routing.exact_router(leaves(inputs(spark, d)), leaves(reference(spark, d))).select("id", "confidence", "match_id", "match_method")


@query(_ROUTE + " SELECT k AS name, ip AS input_path, count(*) AS n, round(avg(s), 6) AS mean FROM s GROUP BY 1, 2")
def path_jaccard(spark, d):
    a = leaves(inputs(spark, d)).select(F.lower("name").alias("name"), F.col("full_path").alias("input_path")).distinct()
    b = leaves(reference(spark, d)).select(F.lower("name").alias("name"), F.col("full_path").alias("rp")).distinct()
    s = similarity.jaccard(text.path_words(F.col("input_path")), text.path_words(F.col("rp")))
    return a.join(b, "name").groupBy("name", "input_path").agg(F.count("*").alias("n"), rounded(F.avg(s)).alias("mean"))


@query(_ROUTE + " SELECT k, ip AS input_path, n_refs::BIGINT AS n_refs, id AS ref_id, round(s, 6) AS score FROM best WHERE r = 1")
def best_path_match(spark, d):
    return routing.path_matches(leaves(inputs(spark, d)), leaves(reference(spark, d))).withColumn("score", rounded("score"))


# ---- scores ----------------------------------------------------------------------------------

_PAIRS = f"WITH {NAMES_SQL}, pairs AS (SELECT input, ref FROM inputs, refs)"
_A, _B = sql.normalize("input"), sql.normalize("ref")
_WA, _WB = sql.meaningful(_A), sql.meaningful(_B)


def _scored(spark, d, score) -> DataFrame:
    return candidates.all_pairs(input_names(spark, d), ref_names(spark, d)).select("input", "ref", rounded(score).alias("score")).where("score > 0")


def _a():
    return text.normalize(F.col("input"))


def _b():
    return text.normalize(F.col("ref"))


def _score_sql(score: str) -> str:
    return f"{_PAIRS} SELECT * FROM (SELECT input, ref, round(({score})::DOUBLE, 6) AS score FROM pairs) WHERE score > 0"


@query(_score_sql(sql.direct(_A, _B)))
def direct_match(spark, d):
    return _scored(spark, d, similarity.direct(_a(), _b()))


@query(_score_sql(sql.direct(_A, _B, True)))
def direct_match_compat(spark, d):
    return _scored(spark, d, similarity.direct(_a(), _b(), True))


@query(_score_sql(sql.synonyms(_WA, _WB, PART_SYNONYMS)))
def synonym_score(spark, d):
    return _scored(spark, d, similarity.synonyms(text.meaningful_words(_a()), text.meaningful_words(_b()), PART_SYNONYMS))


@query(_score_sql(sql.partial(_WA, _WB)))
def partial_word_score(spark, d):
    return _scored(spark, d, similarity.partial_words(text.meaningful_words(_a()), text.meaningful_words(_b())))


@query(_score_sql(sql.basic(f"string_split({_A}, ' ')", f"string_split({_B}, ' ')", PART_SYNONYMS)))
def basic_synonym_score(spark, d):
    return _scored(spark, d, similarity.basic_synonyms(F.split(_a(), " "), F.split(_b(), " "), PART_SYNONYMS))


@query(_score_sql(sql.letter_bound("lower(input)", "lower(ref)")))
def quick_ratio_bound(spark, d):
    return _scored(spark, d, similarity.letter_bound(F.lower("input"), F.lower("ref")))


@query(f"WITH {NAMES_SQL}, k AS (SELECT input, {sql.keywords('input')} AS a FROM inputs), r AS (SELECT ref, {sql.keywords('ref')} AS b FROM refs) SELECT input, ref, round({sql.jaccard('a', 'b')}, 6) AS score FROM k, r WHERE len(list_intersect(a, b)) > 0")
def keyword_jaccard(spark, d):
    return candidates.keyword_jaccard(input_names(spark, d), ref_names(spark, d)).withColumn("score", rounded("score"))


_IDF = f"""WITH {NAMES_SQL}, k AS (SELECT input, {sql.advanced('input')} AS a FROM inputs), r AS (SELECT ref, n, {sql.advanced('ref')} AS b FROM refs),
post AS (SELECT ref, n, unnest(b) AS t FROM r), w AS (SELECT t, ln((SELECT sum(n) FROM refs) / sum(n)::DOUBLE + 1) AS w FROM post GROUP BY 1),
kw AS (SELECT k.input, r.ref, (SELECT sum(w.w) FROM w WHERE list_contains(k.a, w.t) AND list_contains(r.b, w.t)) * {sql.jaccard('k.a', 'r.b')} AS score FROM k, r WHERE {sql.jaccard('k.a', 'r.b')} >= 0.15)"""


@query(_IDF + " SELECT input, ref, round(score, 6) AS score FROM kw")
def idf_keyword_score(spark, d):
    return candidates.idf_keywords(input_names(spark, d), ref_names(spark, d)).withColumn("score", rounded("score"))


_NGRAM = f"ga AS (SELECT input, {sql.char_ngrams('input')} AS a FROM inputs), gb AS (SELECT ref, {sql.char_ngrams('ref')} AS b FROM refs), ng AS (SELECT input, ref, len(list_intersect(a, b)) / greatest(len(a), len(b))::DOUBLE AS score FROM ga, gb WHERE len(list_intersect(a, b)) / greatest(len(a), len(b))::DOUBLE > 0.2)"


@query(f"WITH {NAMES_SQL}, {_NGRAM} SELECT input, ref, round(score, 6) AS score FROM ng")
def ngram_overlap(spark, d):
    return candidates.ngram_overlap(input_names(spark, d), ref_names(spark, d)).withColumn("score", rounded("score"))


@query()
def fuzzy_match(spark, d):
    return candidates.fuzzy(input_names(spark, d), ref_names(spark, d), 0.6).withColumn("score", rounded("score"))


@query()
def translit_ratio(spark, d):
    r = similarity.ratio(text.transliterate(_a()), text.transliterate(_b()))
    return _scored(spark, d, r).where(F.col("score") > DEFAULT.smart_translit)


@query()
def smart_match(spark, d):
    refs = ref_names(spark, d)
    hits = candidates.smart(candidates.all_pairs(input_names(spark, d), refs), PART_SYNONYMS)
    return candidates.top(hits.join(refs.select("ref", "ref_ord"), "ref"), 10).select("input", "ref", rounded("score").alias("score"), "reason", "rank")


@query()
def explain_match(spark, d):
    hits = candidates.smart(candidates.all_pairs(input_names(spark, d), ref_names(spark, d)), PART_SYNONYMS).where("score >= 0.8")
    return hits.select("input", "ref", report.explain(F.col("reason"), F.col("score")).alias("explanation"))


@query()
def auto_match_first_hit(spark, d):
    return candidates.auto_match(input_names(spark, d), ref_names(spark, d), PART_SYNONYMS)


@query()
def prefilter_semi(spark, d):
    return candidates.prefilter(input_names(spark, d), ref_names(spark, d)).select("ref", "ref_ord")


@query()
def candidate_funnel(spark, d):
    hits = candidates.funnel(input_names(spark, d), ref_names(spark, d), ref_words(spark, d), PART_SYNONYMS, PART_HINTS)
    return hits.select("input", "ref", rounded("score").alias("score"), "rank")


@query()
def find_similar(spark, d):
    return candidates.cascade(input_names(spark, d), ref_names(spark, d)).select("input", "ref", "tier", rounded("score").alias("score"), "rank")


_DIRECT_HITS = f"sm AS (SELECT input, ref, score FROM (SELECT input, ref, {sql.direct(_A, _B)} AS score FROM inputs, refs) WHERE score >= 0.5)"


def _hits(spark, d):
    a, r = input_names(spark, d), ref_names(spark, d)
    smart = candidates.all_pairs(a, r).withColumn("score", similarity.direct(_a(), _b())).where("score >= 0.5")
    return smart, candidates.idf_keywords(a, r), candidates.ngram_overlap(a, r)


@query(f"{_IDF}, {_NGRAM}, {_DIRECT_HITS}, u AS (SELECT input, ref, score AS s, NULL AS o FROM sm UNION ALL SELECT input, ref, NULL, score * 0.6::DOUBLE FROM kw UNION ALL SELECT input, ref, NULL, score * 0.4::DOUBLE FROM ng) SELECT input, ref, round(coalesce(max(s), max(o))::DOUBLE, 6) AS score FROM u GROUP BY 1, 2")
def candidate_merge(spark, d):
    return candidates.merge(*_hits(spark, d)).withColumn("score", rounded("score"))


@query(f"{_IDF}, {_NGRAM}, u AS (SELECT input, ref, score * 0.7::DOUBLE AS s FROM kw UNION ALL SELECT input, ref, score * 0.3::DOUBLE FROM ng) SELECT input, ref, round(sum(s), 6) AS score FROM u GROUP BY 1, 2")
def candidate_merge_weighted(spark, d):
    _, k, n = _hits(spark, d)
    return candidates.merge_weighted(k, n).withColumn("score", rounded("score"))


def _hint_sql(x: str) -> str:
    parts = [f"CASE WHEN {' OR '.join(f'contains({x}, {chr(39)}{w}{chr(39)})' for w in [k, *v])} THEN {sql.words([k, *v])} ELSE []::VARCHAR[] END" for k, v in PART_HINTS.items()]
    return f"list_distinct(list_concat({', '.join(parts)}))"


@query(f"WITH {NAMES_SQL}, f AS (SELECT p_name AS ref, arg_min(p_type, p_partkey) AS t FROM part GROUP BY 1), lv AS (SELECT ref, 1 AS level, {sql.advanced('t')} AS b FROM f UNION ALL SELECT ref, 2, {sql.advanced('ref')} FROM f), h AS (SELECT input, {_hint_sql('lower(input)')} AS a FROM inputs) SELECT input, ref, round(least(0.5, sum(len(list_intersect(a, b))) * 0.1)::DOUBLE, 6) AS bonus FROM h, lv GROUP BY 1, 2 HAVING sum(len(list_intersect(a, b))) > 0")
def hierarchy_bonus(spark, d):
    return candidates.hierarchy_bonus(input_names(spark, d), ref_words(spark, d), PART_HINTS).withColumn("bonus", rounded("bonus"))


@query(f"WITH {NAMES_SQL}, {_NGRAM} SELECT input, ref, rank::INTEGER AS rank FROM (SELECT input, ng.ref, row_number() OVER (PARTITION BY input ORDER BY round(score, 9) DESC, ref_ord) AS rank FROM ng JOIN refs USING (ref)) WHERE rank <= 5")
def topk_per_input(spark, d):
    hits = candidates.ngram_overlap(input_names(spark, d), ref_names(spark, d)).join(ref_names(spark, d).select("ref", "ref_ord"), "ref")
    return candidates.top(hits.withColumn("score", rounded("score", 9)), 5).select("input", "ref", "rank")


# ---- TF-IDF and vectors ------------------------------------------------------------------------

_TFIDF = f"""WITH docs AS (SELECT item_id AS key, text AS name FROM benchmark),
post AS (SELECT key, term, count(*) AS tf FROM (SELECT key, unnest({sql.word_ngrams('name')}) AS term FROM docs) GROUP BY 1, 2),
terms AS (SELECT term, count(*) AS df, sum(tf) AS uses FROM post GROUP BY 1 HAVING count(*) <= 0.95 * (SELECT count(*) FROM docs)),
model AS (SELECT term, ln((1 + (SELECT count(*) FROM docs)) / (1 + df)::DOUBLE) + 1 AS idf FROM terms ORDER BY uses DESC, term LIMIT 10000),
raw AS (SELECT key, term, (1 + ln(tf)) * idf AS r FROM post JOIN model USING (term)),
w AS (SELECT key, term, r / sqrt(sum(r * r) OVER (PARTITION BY key)) AS w FROM raw)"""


def _weights(spark, d):
    docs = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("name"))
    posted = tfidf.postings(docs)
    return tfidf.weights(posted, tfidf.fit(posted, docs))


_VECTOR = f"""vpost AS (SELECT key, term, count(*) AS tf FROM (SELECT p_partkey AS key, unnest({sql.word_ngrams('p_name')}) AS term FROM part) GROUP BY 1, 2),
vterms AS (SELECT term, count(*) AS df, sum(tf) AS uses FROM vpost GROUP BY 1 HAVING count(*) <= 0.95 * (SELECT count(*) FROM part)),
vmodel AS (SELECT term, ln((1 + (SELECT count(*) FROM part)) / (1 + df)::DOUBLE) + 1 AS idf FROM vterms ORDER BY uses DESC, term LIMIT 10000),
vname AS (SELECT 'i' AS side, input AS name FROM inputs UNION ALL SELECT 'r', ref FROM refs),
vtf AS (SELECT side, name, term, count(*) AS tf FROM (SELECT side, name, unnest({sql.word_ngrams('name')}) AS term FROM vname) GROUP BY 1, 2, 3),
vraw AS (SELECT side, name, term, (1 + ln(tf)) * idf AS r FROM vtf JOIN vmodel USING (term)),
vw AS (SELECT side, name, term, r / sqrt(sum(r * r) OVER (PARTITION BY side, name)) AS w FROM vraw),
vcos AS (SELECT a.name AS input, b.name AS ref, round(sum(a.w * b.w), 12) AS score FROM vw a JOIN vw b USING (term) WHERE a.side = 'i' AND b.side = 'r' GROUP BY 1, 2),
vec AS (SELECT input, ref, score FROM (SELECT *, row_number() OVER (PARTITION BY input ORDER BY score DESC, ref) AS rank FROM vcos) WHERE rank <= 15 AND score >= 0.3)"""


def _vector_hits(spark, d):
    refs = table(spark, d, "part").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    return tfidf.search(input_names(spark, d), refs, DEFAULT.backfill_top)


@query(f"{_IDF}, {_VECTOR}, h AS (SELECT coalesce(vec.input, kw.input) AS input, coalesce(vec.ref, kw.ref) AS ref, vec.score AS v, kw.score AS k FROM vec FULL JOIN kw ON vec.input = kw.input AND vec.ref = kw.ref) SELECT input, ref, round(CASE WHEN count(k) OVER (PARTITION BY input) = 0 THEN v WHEN k IS NULL THEN v * 0.8::DOUBLE ELSE coalesce(v, 0) * 0.6::DOUBLE + k * 0.4::DOUBLE END, 6) AS score FROM h")
def hybrid_score(spark, d):
    k = candidates.idf_keywords(input_names(spark, d), ref_names(spark, d))
    return candidates.hybrid(_vector_hits(spark, d), k).withColumn("score", rounded("score"))


@query(f"{_IDF}, {_VECTOR}, u AS (SELECT input, ref, 0 AS source, round(score, 9) AS score FROM kw UNION ALL SELECT input, ref, 1, round(score, 9) FROM vec), o AS (SELECT input, ref, source, score, row_number() OVER (PARTITION BY input, ref ORDER BY source, score DESC) AS q FROM u), f AS (SELECT o.input, o.ref, source, row_number() OVER (PARTITION BY o.input ORDER BY source, score DESC, ref_ord) AS rank FROM o JOIN refs USING (ref) WHERE q = 1) SELECT input, ref, source, rank::INTEGER AS rank FROM f WHERE rank <= 25")
def vector_backfill(spark, d):
    order = ref_names(spark, d).select("ref", "ref_ord")
    with_order = lambda h: h.withColumn("score", rounded("score", 9)).join(order, "ref")
    k = candidates.idf_keywords(input_names(spark, d), ref_names(spark, d))
    return candidates.vector_backfill(with_order(k), with_order(_vector_hits(spark, d))).select("input", "ref", "source", "rank")


@query(_TFIDF + " SELECT key, term, round(w, 6) AS w FROM w")
def tfidf_weights(spark, d):
    return _weights(spark, d).withColumn("w", rounded("w"))


@query(_TFIDF + ", c AS (SELECT a.key AS input, b.key AS ref, round(sum(a.w * b.w), 12) AS score FROM w a JOIN w b USING (term) GROUP BY 1, 2) SELECT input, ref, round(score, 6) AS score, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY input ORDER BY score DESC, ref) AS rank FROM c) WHERE rank <= 50 AND score >= 0.3")
def tfidf_topk(spark, d):
    w = _weights(spark, d)
    return tfidf.nearest(w, w).select("input", "ref", rounded("score").alias("score"), "rank")


@query("SELECT label, count(*) AS n, round(avg(list_cosine_similarity(embedding::DOUBLE[], c::DOUBLE[])), 6) AS mean FROM embeddings, (SELECT arg_min(embedding, vec_id) AS c FROM embeddings) GROUP BY 1")
def embedding_cosine(spark, d):
    e = table(spark, d, "embeddings")
    one = e.agg(F.min_by("embedding", "vec_id").alias("c"))  # one row
    return e.crossJoin(one).groupBy("label").agg(F.count("*").alias("n"), rounded(F.avg(tfidf.dense_cosine(F.col("embedding"), F.col("c")))).alias("mean"))


@query("WITH q AS (SELECT vec_id AS query_id, embedding AS c FROM embeddings ORDER BY vec_id LIMIT 20), s AS (SELECT query_id, vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], c::DOUBLE[]), 9) AS score FROM embeddings, q WHERE vec_id <> query_id), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s WHERE score IS NOT NULL) SELECT query_id, vec_id, label, round(score, 6) AS score, rank::INTEGER AS rank FROM o WHERE rank <= 10")
def embedding_cosine_topk(spark, d):
    """The 10 nearest other vectors of each of the 20 vectors with the smallest vec_id."""
    e = table(spark, d, "embeddings")
    few = F.broadcast(e.orderBy("vec_id").limit(20).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("c")))  # 20 rows
    scored = e.join(few, F.col("vec_id") != F.col("query_id")).withColumn("score", rounded(tfidf.dense_cosine(F.col("embedding"), F.col("c")), 9)).where("score is not null")
    return candidates.top(scored, 10, "query_id", order="vec_id").select("query_id", "vec_id", "label", rounded("score").alias("score"), "rank")


# ---- branches and batches ------------------------------------------------------------------------

_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(array_to_string(names, ' ')), '\s+'), lambda w: w <> ''))"
_BRANCH = f"""WITH {REF_SQL}, {IN_SQL},
rw AS (SELECT DISTINCT unnest({_WORDS}) AS w, ids[1] AS root_id FROM ref_tree WHERE is_leaf),
iw AS (SELECT id AS key, unnest({_WORDS}) AS w FROM inp_tree WHERE is_leaf),
targets AS (SELECT DISTINCT key, root_id FROM iw JOIN rw USING (w))"""
_BEST = f""", smp AS (SELECT root_id, full_path FROM (SELECT ids[1] AS root_id, full_path, row_number() OVER (PARTITION BY ids[1] ORDER BY ord) AS n FROM ref_tree WHERE is_leaf) WHERE n <= 5),
sc AS (SELECT t.key, t.root_id, round(avg({sql.jaccard(sql.path_words('i.full_path'), sql.path_words('s.full_path'))}), 12) AS s FROM targets t JOIN inp_tree i ON i.id = t.key JOIN smp s USING (root_id) GROUP BY 1, 2),
clear AS (SELECT key, arg_min(root_id, struct_pack(a := -s, b := root_id)) AS root_id FROM sc GROUP BY 1)"""
_GROUPS = """, grp AS (SELECT c.root_id, min(i.ord) AS first FROM clear c JOIN inp_tree i ON i.id = c.key GROUP BY 1),
turn AS (SELECT root_id, row_number() OVER (ORDER BY first) - 1 AS turn, count(*) OVER () AS g FROM grp),
rest AS (SELECT id AS key, row_number() OVER (ORDER BY ord) - 1 AS place FROM inp_tree WHERE is_leaf AND id NOT IN (SELECT key FROM clear)),
groups_of AS (SELECT key, root_id FROM clear UNION ALL SELECT key, root_id FROM rest JOIN turn ON place % g = turn)"""


def _inputs_refs(spark, d):
    return leaves(inputs(spark, d)), leaves(reference(spark, d))


@query(_BRANCH + " SELECT key, count(*) AS n, min(root_id) AS first FROM targets GROUP BY 1")
def target_branches(spark, d):
    return routing.target_branches(*_inputs_refs(spark, d)).groupBy("key").agg(F.count("*").alias("n"), F.min("root_id").alias("first"))


@query(_BRANCH + _BEST + " SELECT key, root_id FROM clear")
def best_branch(spark, d):
    a, r = _inputs_refs(spark, d)
    return routing.best_branch(a, r, routing.target_branches(a, r))


@query(_BRANCH + _BEST + _GROUPS + " SELECT root_id, count(*) AS n FROM groups_of GROUP BY 1")
def branch_groups(spark, d):
    return routing.branch_groups(*_inputs_refs(spark, d)).groupBy("root_id").agg(F.count("*").alias("n"))


@query(_BRANCH + _BEST + _GROUPS + " SELECT key, root_id FROM groups_of WHERE key IN (SELECT key FROM rest)")
def round_robin(spark, d):
    a, r = _inputs_refs(spark, d)
    unclear = a.join(routing.target_branches(a, r).select("key"), "key", "left_anti").select("key")
    return routing.branch_groups(a, r).join(unclear, "key", "left_semi").select("key", "root_id")


@query("SELECT s_suppkey, floor((row_number() OVER (ORDER BY s_suppkey) - 1) / 25)::BIGINT AS batch_id FROM supplier")
def batching(spark, d):
    return routing.batches(table(spark, d, "supplier"), "s_suppkey").select("s_suppkey", "batch_id")


@query("SELECT s_suppkey, s_nationkey, floor((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) / 15)::BIGINT AS batch_id FROM supplier")
def batching_by_branch(spark, d):
    return routing.batches(table(spark, d, "supplier"), "s_suppkey", 15, "s_nationkey").select("s_suppkey", "s_nationkey", "batch_id")


@query(f"WITH {REF_SQL}, {IN_SQL} SELECT ids[1] AS root_id, count(*) AS n FROM ref_tree GROUP BY 1")
def group_by_root(spark, d):
    return tree.build(reference(spark, d)).groupBy(text.root_of(F.col("path_ids")).alias("root_id")).agg(F.count("*").alias("n"))


# ---- requests and answers --------------------------------------------------------------------------

# every event as an answer of its own: fenced, bare, with words around it, or broken
_ANSWERS = """SELECT event_id AS batch_id, CASE event_id % 4 WHEN 0 THEN 'Here: ```json' || chr(10) || j || chr(10) || '``` done' WHEN 1 THEN j WHEN 2 THEN 'so ' || j || ' and so on' ELSE 'none {' || event_type END AS answer
FROM (SELECT *, '{"matches": [{"index": 1, "matched_id": "' || event_type || '", "confidence": ' || (CASE event_id % 3 WHEN 0 THEN '"x"' WHEN 1 THEN '0.9' ELSE '"1.7"' END) || '}, {"index": 3, "matched_id": "' || user_id || '", "confidence": 0.5}]}' AS j FROM {events})"""


def _answers(spark, d) -> DataFrame:
    return spark.sql(_ANSWERS.replace('"matches": [{"', '"matches": [{{"').replace('{"matches', '{{"matches').replace('{"index": 3', '{{"index": 3').replace("'}, {{", "'}}, {{").replace("0.5}]}'", "0.5}}]}}'").replace("'none {'", "'none {{'"), events=table(spark, d, "events"))


_PARSED = f"""a AS ({_ANSWERS.replace('{events}', 'events')}),
js AS (SELECT batch_id, CASE WHEN regexp_extract(answer, '(?s)```json\\s*(.*?)```', 1) <> '' THEN regexp_extract(answer, '(?s)```json\\s*(.*?)```', 1) ELSE regexp_extract(answer, '(?s)\\{{.*\\}}', 0) END AS j FROM a),
parsed AS (SELECT batch_id, i AS pos, try_cast(json_extract_string(j, '$.matches[' || i || '].index') AS INTEGER) AS index, json_extract_string(j, '$.matches[' || i || '].matched_id') AS matched_id,
  greatest(0, least(1, coalesce(try_cast(json_extract_string(j, '$.matches[' || i || '].confidence') AS DOUBLE), 0)))::DOUBLE AS confidence
  FROM js, (VALUES (0), (1)) v(i) WHERE j <> '' AND json_valid(j))"""


@query(f"WITH {_PARSED} SELECT batch_id, pos, index, matched_id, confidence FROM parsed")
def llm_parse(spark, d):
    return resolver.parsed(_answers(spark, d)).select("batch_id", "pos", "index", "matched_id", "confidence")


@query(f"WITH {_PARSED}, b AS (SELECT event_id AS batch_id, p AS pos, event_type AS input FROM events, (VALUES (1), (2)) v(p)), names AS (SELECT DISTINCT event_type AS id, upper(event_type) AS name FROM events) SELECT b.batch_id, b.pos, input, matched_id AS match_id, names.name AS match_name, coalesce(confidence, 0)::DOUBLE AS confidence, CASE WHEN confidence IS NULL THEN 'missing' ELSE 'batch' END AS processing_method, coalesce(confidence, 0) >= 0.95 AS is_exact_match, coalesce(confidence, 0) < 0.7 AS needs_review FROM b LEFT JOIN parsed ON parsed.batch_id = b.batch_id AND parsed.index = b.pos LEFT JOIN names ON names.id = matched_id")
def llm_index_join(spark, d):
    e = table(spark, d, "events")
    batch = e.select(F.col("event_id").alias("batch_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("pos"), F.col("event_type").alias("input"))
    names = e.select(F.col("event_type").alias("id"), F.upper("event_type").alias("name")).distinct()
    return resolver.by_index(batch, resolver.parsed(_answers(spark, d)), names)


@query("SELECT event_id, greatest(0, least(1, coalesce(try_cast(v AS DOUBLE), 0)))::DOUBLE AS confidence FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'x' WHEN 2 THEN (value / 100)::VARCHAR ELSE '-0.5' END AS v FROM events)")
def confidence_clamp(spark, d):
    v = F.when(F.col("event_id") % 4 == 0, None).when(F.col("event_id") % 4 == 1, "x").when(F.col("event_id") % 4 == 2, (F.col("value") / 100).cast("string")).otherwise("-0.5")
    return table(spark, d, "events").select("event_id", similarity.confidence(v).alias("confidence"))


@query("""WITH b AS (SELECT s_suppkey, s_name, s_nationkey, floor((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) / 15)::BIGINT AS batch_id FROM supplier),
i AS (SELECT s_nationkey, batch_id, count(*) AS n, string_agg(p || '. ' || s_name, chr(10) ORDER BY s_suppkey) AS l FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey, batch_id ORDER BY s_suppkey) AS p FROM b) GROUP BY 1, 2),
r AS (SELECT n_nationkey, 'ID: ' || n_nationkey || ', Name: ' || n_name AS l FROM nation)
SELECT i.s_nationkey, i.batch_id, i.n, 'Match these categories:' || chr(10) || i.l || chr(10) || chr(10) || 'with these:' || chr(10) || coalesce(r.l, '') || chr(10) || chr(10) || 'Answer with JSON only: {"matches": [{"index": 1, "matched_id": "id or null", "confidence": 0.0}]}' AS prompt FROM i LEFT JOIN r ON r.n_nationkey = i.s_nationkey""")
def prompt_build(spark, d):
    rows = routing.batches(table(spark, d, "supplier"), "s_suppkey", 15, "s_nationkey").select("s_nationkey", "batch_id", F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"))
    refs = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_nationkey").alias("ord"), F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    return resolver.prompts(rows, refs, ["s_nationkey", "batch_id"])


@query(f"WITH {_PARSED.split('parsed AS')[0].rstrip().rstrip(',')} SELECT batch_id, CASE WHEN j <> '' AND json_valid(j) THEN 2 ELSE 0 END AS matches, CASE WHEN j <> '' AND json_valid(j) THEN 2 ELSE 0 END AS incomplete FROM js")
def llm_validate(spark, d):
    return resolver.missing_fields(_answers(spark, d)).select("batch_id", "matches", "incomplete")


@query()
def resolve_offline(spark, d):
    hits = candidates.funnel(input_names(spark, d), ref_names(spark, d), ref_words(spark, d), PART_SYNONYMS, PART_HINTS)
    return resolver.offline(hits).withColumn("confidence", rounded("confidence"))


def _first_id(prompt: str) -> str:
    """A matcher: the first reference listed, for the first input; every tenth branch answers nothing."""
    found = re.search(r"ID: (\d+), Name", prompt)
    return "sorry" if found is None or int(found[1]) % 10 == 9 else f'{{"matches": [{{"index": 1, "matched_id": "{found[1]}", "confidence": 0.9}}]}}'


@query("WITH b AS (SELECT s_nationkey, floor((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) / 15)::BIGINT AS batch_id FROM supplier) SELECT DISTINCT s_nationkey, batch_id, 1 AS index, s_nationkey::VARCHAR AS matched_id, 0.9::DOUBLE AS confidence FROM b WHERE s_nationkey % 10 <> 9 AND s_nationkey IN (SELECT n_nationkey FROM nation)")
def llm_resolve(spark, d):
    """Requests through a matcher and its answers back."""
    return resolver.parsed(resolver.resolve(prompt_build(spark, d), _first_id)).select("s_nationkey", "batch_id", "index", "matched_id", "confidence")


@query("SELECT user_id::VARCHAR AS input_id, CASE WHEN user_id % 3 > 0 THEN max(event_type) END AS match_id, CASE WHEN user_id % 3 > 0 THEN 0.5 ELSE 0 END::DOUBLE AS confidence FROM events GROUP BY user_id")
def llm_id_join(spark, d):
    """Two answers name an id, of which the last counts; a third of the rows has none."""
    users = table(spark, d, "events").groupBy(F.col("user_id")).agg(F.min("event_type").alias("low"), F.max("event_type").alias("high"))
    said = lambda c, p: F.concat(F.lit('{"input_id": "'), F.col("user_id").cast("string"), F.lit('", "match_id": "'), F.col(c), F.lit(f'", "confidence": {p}}}'))
    answers = users.where("user_id % 3 > 0").select(F.concat(F.lit('{"matches": ['), said("low", 0.9), F.lit(", "), said("high", 0.5), F.lit("]}")).alias("answer"))
    return resolver.by_id(users.select(F.col("user_id").cast("string").alias("input_id")), resolver.parsed(answers)).select("input_id", "match_id", "confidence")


# ---- results ------------------------------------------------------------------------------------------

# orders as matches: priority as name, status as id, price as confidence
_MATCHES = "m AS (SELECT o_orderkey AS ord, o_custkey::VARCHAR AS input_name, CASE o_orderstatus WHEN 'P' THEN 'null' WHEN 'F' THEN o_custkey::VARCHAR ELSE 'X' || o_orderkey END AS match_id, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE o_orderpriority END AS match_name, least(1, o_totalprice / 500000)::DOUBLE AS confidence FROM orders)"


def _matches(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    cust = F.col("o_custkey").cast("string")
    return o.select(
        F.col("o_orderkey").alias("ord"), cust.alias("input_name"), F.when(F.col("o_orderstatus") == "P", "null").when(F.col("o_orderstatus") == "F", cust).otherwise(F.concat(F.lit("X"), F.col("o_orderkey").cast("string"))).alias("match_id"),
        F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderpriority")).alias("match_name"), F.least(F.lit(1.0), F.col("o_totalprice") / 500000).alias("confidence"),
    )


def _customers(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.concat(F.lit("N>"), F.col("c_custkey").cast("string")).alias("path"))


@query(f"WITH {_MATCHES} SELECT count(*) AS matched, count(*) FILTER (confidence >= 0.8) AS high_confidence, count(*) FILTER (confidence >= 0.5 AND confidence < 0.8) AS medium_confidence, count(*) FILTER (confidence < 0.5) AS low_confidence FROM m WHERE match_id <> 'null' AND match_id <> '' AND confidence >= 0.7")
def classify_confidence(spark, d):
    return report.classify(_matches(spark, d))


@query(f"WITH {_MATCHES} SELECT c_custkey::VARCHAR AS name FROM customer WHERE c_custkey::VARCHAR NOT IN (SELECT input_name FROM m WHERE match_id <> 'null' AND confidence >= 0.7)")
def unmatched_by_name(spark, d):
    return report.unmatched_by_name(table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("name")), _matches(spark, d))


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def unmatched_by_id(spark, d):
    urgent = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("input_id"))
    return report.unmatched_by_id(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), urgent)


@query(f"WITH {_MATCHES} SELECT ord, match_id, coalesce(nullif(match_name, ''), c_name) AS match_name, CASE WHEN c_custkey IS NULL THEN '' ELSE 'N>' || c_custkey END AS match_path, confidence FROM m LEFT JOIN customer ON c_custkey::VARCHAR = match_id")
def enrich_matches(spark, d):
    return report.enrich(_matches(spark, d), _customers(spark, d)).select("ord", "match_id", "match_name", "match_path", "confidence")


@query("SELECT user_id::VARCHAR AS id, min(event_id) AS ord FROM events GROUP BY 1")
def dedup_first(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("id"), F.col("event_id").alias("ord"))
    return report.first_of_each(rows, drop_empty=True)


@query("SELECT count(*) AS total, count(*) FILTER (m = 'exact') AS exact_matches, count(*) FILTER (m = 'ai') AS ai_matches, count(*) FILTER (m = 'none') AS none_matches, round(count(*) FILTER (m = 'exact') * 100.0 / count(*), 6)::DOUBLE AS exact_pct, round(count(*) FILTER (m = 'ai') * 100.0 / count(*), 6)::DOUBLE AS ai_pct, round(count(*) FILTER (m = 'none') * 100.0 / count(*), 6)::DOUBLE AS none_pct, round((count(*) - max(calls) * 25) * 100.0 / count(*), 6)::DOUBLE AS saved_pct FROM (SELECT CASE event_type WHEN 'click' THEN 'exact' WHEN 'view' THEN 'none' ELSE 'ai' END AS m, (SELECT count(DISTINCT user_id) FROM events) AS calls FROM events)")
def match_statistics(spark, d):
    e = table(spark, d, "events")
    m = F.when(F.col("event_type") == "click", "exact").when(F.col("event_type") == "view", "none").otherwise("ai")
    rows = e.select(m.alias("match_method")).crossJoin(e.agg(F.countDistinct("user_id").alias("calls")))  # one row
    out = report.match_statistics(rows, F.col("calls"))
    return out.select(*[rounded(c).alias(c) if c.endswith("_pct") else F.col(c) for c in out.columns])


@query("SELECT user_id, round(c * 100.0 / n, 6)::DOUBLE AS auto_match_rate, round((n - c) * 100.0 / n, 6)::DOUBLE AS ai_processing_rate, round((n - c) / greatest(k, 1)::DOUBLE, 6) AS api_call_efficiency, round(coalesce(n / nullif(s, 0), 0), 6) AS categories_per_second FROM (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'error') AS k, sum(value) AS s FROM events GROUP BY 1)")
def automatic_statistics(spark, d):
    g = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "click").alias("c"), F.count_if(F.col("event_type") == "error").alias("k"), F.sum("value").alias("s"))
    out = g.select("user_id", *report.automatic_statistics(F.col("n"), F.col("c"), F.col("k"), F.col("s")))
    return out.select("user_id", *[rounded(c).alias(c) for c in out.columns if c != "user_id"])


@query(f"WITH {_MATCHES} SELECT ord, confidence >= 0.95 AS is_exact_match, confidence < 0.7 AS needs_review FROM m")
def review_flags(spark, d):
    return _matches(spark, d).select("ord", *[c.alias(k) for k, c in resolver.review_flags(F.col("confidence")).items()])


@query(f"WITH {_MATCHES}, g AS (SELECT * FROM m WHERE match_id <> 'null' AND confidence >= 0.7), u AS (SELECT c_custkey FROM customer WHERE c_custkey::VARCHAR NOT IN (SELECT input_name FROM g)) SELECT 'Processed: now' || chr(10) || 'Time: 01:01:01' || chr(10) || 'Inputs: ' || (SELECT count(*) FROM customer) || chr(10) || 'Matched: ' || (SELECT count(*) FROM g) || ' (' || printf('%.1f', (SELECT count(*) FROM g) * 100.0 / (SELECT count(*) FROM customer)) || '%)' || chr(10) || 'Unmatched: ' || (SELECT count(*) FROM u) || ' (' || printf('%.1f', (SELECT count(*) FROM u) * 100.0 / (SELECT count(*) FROM customer)) || '%)' || chr(10) || 'High / medium / low: ' || (SELECT count(*) FROM g WHERE confidence >= 0.8) || ' / ' || (SELECT count(*) FROM g WHERE confidence < 0.8) || ' / 0' || chr(10) || 'Requests: 7' || chr(10) || 'Threshold: 0.7' || chr(10) || 'References: ' || (SELECT count(*) FROM part) AS summary")
def result_summary(spark, d):
    rows = report.enrich(_matches(spark, d), _customers(spark, d)).withColumn("reasoning", F.lit(""))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_custkey").cast("string").alias("name"))
    doc = report.document(rows, people, DEFAULT, table(spark, d, "part").count(), 7, 3661.5, "now")
    return report.summary(doc)


@query(f"WITH {_MATCHES} SELECT count(*) FILTER (NOT EXISTS (SELECT 1 FROM m WHERE match_id <> 'null' AND confidence >= 0.7 AND input_name = c_custkey::VARCHAR)) AS total_unmatched, 0.7::DOUBLE AS confidence_threshold FROM customer")
def unmatched_export(spark, d):
    rows = report.enrich(_matches(spark, d), _customers(spark, d)).withColumn("reasoning", F.lit(""))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_custkey").cast("string").alias("name"))
    out = report.unmatched_only(report.document(rows, people, DEFAULT, 0, 0, 0.0, "now"))
    return out.select(F.size("unmatched").cast("long").alias("total_unmatched"), "confidence_threshold")


@query(_ROUTE + ", x AS (SELECT i.id, CASE WHEN n_refs = 1 OR s > 0.3 THEN best.id END AS match_id FROM inp_tree i LEFT JOIN best ON best.k = lower(i.name) AND best.ip = i.full_path AND r = 1 WHERE i.is_leaf), c AS (SELECT count(*) AS n, count(match_id) AS e FROM x) SELECT printf('Hierarchical matching - now%sInputs: %d%sExact: %d (%.1f%%)%sBy matcher: 0 (0.0%%)%sUnmatched: %d (%.1f%%)%sMatch rate: %.1f%%%sRequests: 2%sSaved: %.1f%%%sTime: 1.50s', chr(10), n, chr(10), e, e * 100.0 / n, chr(10), chr(10), n - e, (n - e) * 100.0 / n, chr(10), e * 100.0 / n, chr(10), chr(10), (n - 50) * 100.0 / n, chr(10)) AS summary FROM c")
def hierarchical_summary(spark, d):
    """The exact routes alone as results."""
    routed = routing.exact_router(leaves(inputs(spark, d)), leaves(reference(spark, d)))
    none = lambda *names: [F.lit(None).cast("string").alias(n) for n in names]
    rows = routed.select(F.col("id").alias("input_id"), F.col("name").alias("input_name"), F.col("path").alias("input_path"), F.col("full_path").alias("input_full_path"), "match_id", *none("match_name", "match_path", "match_full_path", "reasoning"), "confidence", F.coalesce("match_method", F.lit("none")).alias("match_method"))
    return report.hierarchical_summary(report.hierarchical_document(rows, 2, 1.5, "now"))


@query()
def hierarchical_pipeline(spark, d):
    return pipelines.hierarchical(inputs(spark, d), reference(spark, d)).select("input_id", "match_id", rounded("confidence").alias("confidence"), "match_method")


@query()
def flat_pipeline(spark, d):
    return pipelines.flat(inputs(spark, d), leaves(reference(spark, d)), synonyms=PART_SYNONYMS, hints=PART_HINTS).select("ord", "input_name", "match_id", rounded("confidence").alias("confidence"))


@query()
def automatic_pipeline(spark, d):
    return pipelines.automatic(inputs(spark, d), reference(spark, d), synonyms=PART_SYNONYMS).select("input_id", "match_id", rounded("confidence").alias("confidence"), "processing_method")


# ---- caches --------------------------------------------------------------------------------------------

_NOW = "(SELECT max(ts) FROM events)"


def _entries(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("entry"), F.col("ts").alias("created_at"), F.col("ts").alias("accessed_at"), F.length("props").cast("long").alias("size_bytes"))


def _now(spark, d):
    return F.lit(table(spark, d, "events").agg(F.max("ts")).first()[0])


@query(f"SELECT event_id AS entry, user_id AS key FROM events WHERE ts >= {_NOW} - INTERVAL 86400 SECONDS")
def ttl_filter(spark, d):
    return cache.fresh(_entries(spark, d), _now(spark, d), 86400).select("entry", "key")


@query("SELECT user_id AS key, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS entry FROM events GROUP BY 1")
def cache_latest(spark, d):
    return cache.latest(_entries(spark, d)).select("key", "entry")


@query("SELECT event_id AS entry FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def lru_evict(spark, d):
    return cache.evict(_entries(spark, d), DEFAULT.cache_entries).select("entry")


@query("SELECT user_id AS key, event_id AS entry FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events) WHERE r > n // 4")
def evict_quarter(spark, d):
    return cache.evict_share(_entries(spark, d)).select("key", "entry")


@query(f"SELECT count(*) AS entries, sum(length(props))::BIGINT AS total_size, count(*) FILTER (ts >= {_NOW} - INTERVAL 3600 SECONDS) AS active FROM events")
def cache_stats(spark, d):
    return cache.statistics(_entries(spark, d), _now(spark, d), DEFAULT.cache_ttl_seconds)


@query("SELECT o_custkey AS key, count(*) AS misses FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events) GROUP BY 1")
def cache_misses(spark, d):
    _, misses = cache.lookup(table(spark, d, "orders").select(F.col("o_custkey").alias("key")), _entries(spark, d).select("key").distinct())
    return misses.groupBy("key").agg(F.count("*").alias("misses"))


@query(f"WITH e AS (SELECT user_id AS key, max(ts) AS t FROM events GROUP BY 1), n AS (SELECT key FROM e WHERE key % 2 = 0 AND t >= {_NOW} - INTERVAL 864000 SECONDS), f AS (SELECT key FROM e WHERE t >= {_NOW} - INTERVAL 864000 SECONDS), q AS (SELECT DISTINCT o_custkey AS key FROM orders) SELECT q.key, CASE WHEN n.key IS NOT NULL THEN 1 ELSE 2 END AS level FROM q JOIN f USING (key) LEFT JOIN n USING (key)")
def cache_levels(spark, d):
    far = _entries(spark, d).groupBy("key").agg(F.max("entry").alias("entry"), F.max("created_at").alias("created_at"), F.max("accessed_at").alias("accessed_at"))
    hits, _, _ = cache.two_levels(table(spark, d, "orders").select(F.col("o_custkey").alias("key")).distinct(), far.where("key % 2 = 0"), far, _now(spark, d), 864000, DEFAULT.cache_entries)
    return hits.select("key", "level")


@query("SELECT user_id AS key, max(event_id) AS entry FROM events WHERE user_id % 3 <> 0 GROUP BY 1 UNION ALL SELECT s_suppkey, -s_suppkey FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0")
def cache_put(spark, d):
    """Entries put in the place of others, and some deleted."""
    old = _entries(spark, d).groupBy("key").agg(F.max("entry").alias("entry")).where("key % 3 <> 0")
    new = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_suppkey").alias("key"), (-F.col("s_suppkey")).alias("entry"))
    stale = new.select("key", F.lit(0).cast("long").alias("entry"))
    return cache.delete(cache.put(old.unionByName(stale), new), new.where("key % 5 = 0"))


@query("SELECT user_id, md5(string_agg(event_type, chr(10) ORDER BY event_type) || '|' || count(DISTINCT event_type)) AS key FROM events GROUP BY 1")
def cache_key(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.collect_list("event_type").alias("l"), F.countDistinct("event_type").alias("n")).select("user_id", cache.batch_key(F.col("l"), F.col("n")).alias("key"))


# ---- metrics --------------------------------------------------------------------------------------------


def _metrics(spark, d) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "Error Rate").when(F.col("event_type") == "view", "CPU usage").otherwise(F.col("event_type")).alias("name"), "value", "ts")


@query("SELECT event_id, round(avg(value) OVER w, 9) AS avg, min(value) OVER w AS low, max(value) OVER w AS high, count(value) OVER w AS count FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)")
def rolling_metrics(spark, d):
    return monitor.rolling(_metrics(spark, d), 60, order=("ts", "event_id")).select("event_id", rounded("avg", 9).alias("avg"), "low", "high", "count")


@query("SELECT event_id, value FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def latest_metrics(spark, d):
    return monitor.latest(_metrics(spark, d), 100, ("ts", "event_id")).select("event_id", "value")


@query("SELECT event_id, CASE event_type WHEN 'error' THEN 5.0 ELSE 80.0 END::DOUBLE AS threshold, value FROM events WHERE (event_type = 'error' AND value > 5) OR (event_type = 'view' AND value > 80)")
def alerts(spark, d):
    return monitor.alerts(_metrics(spark, d)).select("event_id", "threshold", "value")


_SESSION = "s AS (SELECT user_id AS session, count(*) AS processed, count(*) FILTER (event_type = 'click') AS matched, count(*) FILTER (event_type = 'view') AS hits, count(*) FILTER (event_type = 'error') AS misses, sum(value) AS seconds FROM events GROUP BY 1)"


def _sessions(spark, d) -> DataFrame:
    is_ = lambda t: (F.col("event_type") == t).cast("long")
    rows = table(spark, d, "events").withColumnRenamed("user_id", "session")
    return monitor.session(rows, "session", processed=F.lit(1), matched=is_("click"), hits=is_("view"), misses=is_("error"), seconds=F.col("value"))


@query(f"WITH {_SESSION} SELECT session, processed, matched, round(matched / greatest(processed, 1)::DOUBLE * 100, 6) AS match_rate, round(hits / greatest(hits + misses, 1)::DOUBLE * 100, 6) AS cache_hit_rate, round(processed / seconds, 6) AS processing_speed FROM s")
def session_stats(spark, d):
    return _sessions(spark, d).select("session", "processed", "matched", *[rounded(c).alias(c) for c in ("match_rate", "cache_hit_rate", "processing_speed")])


@query(f"WITH {_SESSION}, l AS (SELECT * FROM s ORDER BY session DESC LIMIT 10) SELECT count(*) AS sessions, sum(processed)::BIGINT AS processed, sum(matched)::BIGINT AS matched, round(sum(seconds), 4) AS seconds, round(sum(matched) / greatest(1, sum(processed))::DOUBLE * 100, 6) AS match_rate, round(sum(processed) / greatest(1, sum(seconds)), 6) AS processing_speed, avg(processed) AS per_session FROM l")
def history_stats(spark, d):
    return monitor.history(_sessions(spark, d)).select("sessions", "processed", "matched", rounded("seconds", 4).alias("seconds"), rounded("match_rate").alias("match_rate"), rounded("processing_speed").alias("processing_speed"), "per_session")


@query(f"WITH {_SESSION}, r AS (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100), l AS (SELECT * FROM s ORDER BY session DESC LIMIT 10) SELECT (SELECT count(*) FROM r) AS metrics, (SELECT sum(event_id) FROM r)::BIGINT AS ids, (SELECT max(session) FROM s) AS session, (SELECT sum(processed) FROM l)::BIGINT AS processed")
def metrics_export(spark, d):
    out = monitor.export(_metrics(spark, d), _sessions(spark, d), "now", 100, ("ts", "event_id"))
    ids = F.aggregate("recent_metrics", F.lit(0).cast("long"), lambda n, m: n + m["event_id"])
    return out.select(F.size("recent_metrics").cast("long").alias("metrics"), ids.alias("ids"), F.col("current_session.session").alias("session"), F.col("historical_stats.processed").alias("processed"))


@query("SELECT event_type, count(*) AS runs, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS greatest, round(coalesce(stddev_samp(value), 0), 6) AS deviation FROM events GROUP BY 1")
def benchmark_stats(spark, d):
    return monitor.benchmark(table(spark, d, "events"), "event_type", "value").select("event_type", "runs", rounded("mean").alias("mean"), "least", "greatest", rounded("deviation").alias("deviation"))


@query(f"WITH {_SESSION} SELECT session, array_to_string(list_filter([CASE WHEN processed / seconds < 1 THEN 'raise the batch size or the parallelism' END, CASE WHEN hits / greatest(hits + misses, 1)::DOUBLE * 100 < 30 THEN 'keep the cache or lengthen its time to live' END, CASE WHEN seconds / processed > 10 THEN 'lower the batch size or retry' END, CASE WHEN matched * 20 > 80 THEN 'lower the cache size or the chunks' END], lambda x: x IS NOT NULL), '; ') AS advice FROM s")
def recommendations(spark, d):
    r = monitor.recommendations(F.col("processing_speed"), F.col("cache_hit_rate"), F.col("seconds") / F.col("processed"), F.col("matched") * 20)
    return _sessions(spark, d).select("session", F.array_join(r, "; ").alias("advice"))


_BATCH_WORDS = f"list_distinct(list_filter({sql.meaningful(sql.normalize('{0}'))}, lambda w: w NOT IN ('все', 'товары')))"


@query(f"WITH {NAMES_SQL}, b AS (SELECT s_nationkey AS batch_id, s_name || ' ' || p_type AS input FROM supplier JOIN part ON p_partkey = s_suppkey), m AS (SELECT DISTINCT batch_id, unnest({_BATCH_WORDS.replace('{0}', 'input')}) AS t FROM b), r AS (SELECT ref, ref_ord, unnest({_BATCH_WORDS.replace('{0}', 'ref')}) AS t FROM (SELECT p_type || ' ' || p_name AS ref, min(p_partkey) AS ref_ord FROM part GROUP BY 1)), c AS (SELECT batch_id, ref, ref_ord, count(*) AS shared FROM m JOIN r USING (t) GROUP BY 1, 2, 3), o AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY shared DESC, ref_ord) AS rank FROM c) SELECT batch_id, ref, shared, rank::INTEGER AS rank FROM o WHERE rank <= 100")
def relevant_references(spark, d):
    part = table(spark, d, "part")
    batched = table(spark, d, "supplier").join(part, F.col("p_partkey") == F.col("s_suppkey")).select(F.col("s_nationkey").alias("batch_id"), F.concat_ws(" ", "s_name", "p_type").alias("input"))
    refs = part.groupBy(F.concat_ws(" ", "p_type", "p_name").alias("ref")).agg(F.min("p_partkey").alias("ref_ord"))
    return candidates.relevant(batched, refs).select("batch_id", "ref", "shared", "rank")


@query(
    f"{_IDF}, {_VECTOR}, c1 AS (SELECT input, ref, row_number() OVER (PARTITION BY input ORDER BY round(score, 9) DESC, ref_ord) AS rank FROM kw JOIN refs USING (ref)), c2 AS (SELECT input, ref, rank FROM c1 WHERE rank <= 10), c3 AS (SELECT input, count(*) AS n FROM c2 GROUP BY 1), "
    "c4 AS (SELECT input, ref, score, row_number() OVER (PARTITION BY input ORDER BY score DESC, ref) AS rank FROM vec), c5 AS (SELECT c4.*, coalesce(c3.n, 0) AS n FROM c4 LEFT JOIN c3 USING (input)), "
    "c6 AS (SELECT input, ref, 'advanced_filter' AS match_type, 0.8::DOUBLE AS score, rank FROM c2 UNION ALL SELECT input, ref, 'vector_search', score, n + rank FROM c5 WHERE rank <= 10 - n AND NOT EXISTS (SELECT 1 FROM c2 WHERE c2.input = c5.input AND c2.ref = c5.ref)) "
    "SELECT input, ref, match_type, round(score, 6) AS score, row_number() OVER (PARTITION BY input ORDER BY rank)::INTEGER AS rank FROM c6"
)
def optimized_cascade(spark, d):
    """The keyword tier stands for the funnel, which has no SQL; vectors fill up."""
    k = candidates.idf_keywords(input_names(spark, d), ref_names(spark, d)).withColumn("score", rounded("score", 9))
    found = candidates.top(k.join(ref_names(spark, d).select("ref", "ref_ord"), "ref"), 10)
    near = candidates.top(_vector_hits(spark, d), 15, order="ref")
    return candidates.filtered_then_vectors(found, near).withColumn("score", rounded("score"))


@query(f"WITH {NAMES_SQL}, {_NGRAM}, c AS (SELECT inputs.input, count(ng.ref) AS n FROM inputs LEFT JOIN ng USING (input) GROUP BY 1) SELECT count(*) AS inputs, count(*) FILTER (n > 0) AS with_candidates, sum(n)::BIGINT AS candidates, round(avg(n), 6) AS mean, max(n) AS most FROM c")
def candidate_statistics(spark, d):
    hits = candidates.ngram_overlap(input_names(spark, d), ref_names(spark, d))
    return candidates.statistics(hits, input_names(spark, d)).withColumn("mean", rounded("mean"))
