"""The three ways to align an input taxonomy with a reference, from rows to rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import similarity, text
from ..functions.dictionaries import BASIC_SYNONYMS, BRANCH_HINTS, SYNONYMS
from ..operators import candidates, report, resolver, routing, tfidf, tree
from ..scratch import drop, keep

Answerer = Callable[[str], str]


def _names(refs: DataFrame) -> DataFrame:
    return refs.groupBy(F.col("name").alias("ref")).agg(F.min("ord").alias("ref_ord"), F.count("*").alias("n"), F.min_by("id", "ord").alias("ref_id"))


def _path_words(refs: DataFrame) -> DataFrame:
    """ref, level, tokens: keywords of the names on the path of the first reference of each name."""
    first = _names(refs).select("ref", "ref_id")
    ids = refs.select(F.col("id").alias("ref_id"), F.posexplode(text.path_ids(F.col("path"))).alias("level", "part"))
    named = ids.join(refs.select(F.col("id").alias("part"), F.col("name").alias("part_name")), "part")
    return named.join(first, "ref_id").select("ref", "level", text.advanced_keywords(F.col("part_name")).alias("tokens"))


def flat(inputs: DataFrame, refs: DataFrame, settings: Settings = DEFAULT, answer: Answerer | None = None, synonyms=SYNONYMS, hints=BRANCH_HINTS) -> DataFrame:
    """ord, input_name, match_id, match_name, match_path, confidence, reasoning for every input row.

    inputs: ord, name; refs: ord, id, name, path. Each distinct name is looked up once. Without
    ``answer`` the first candidate is the match; with it, an input's candidates are a request.
    Candidates are those of the funnel, filled up by the best ``backfill_top`` of the vector search.
    Inputs without candidates stay, unmatched."""
    names = inputs.select(F.col("name").alias("input")).distinct()
    refs_by_name = _names(refs)
    found = candidates.funnel(names, refs_by_name.select("ref", "ref_ord", "n"), _path_words(refs), synonyms, hints, settings)
    near = tfidf.search(names, refs.select(F.col("id").alias("key"), "name"), settings.backfill_top, settings.vector_cosine, settings.vocabulary, settings.most_df)
    near = near.join(refs_by_name.select("ref", "ref_ord"), "ref")
    hits = candidates.vector_backfill(found, near, settings.candidates).join(refs_by_name.select("ref", "ref_id"), "ref")
    if answer is None:
        best = resolver.offline(hits.where("rank = 1")).join(refs_by_name.select(F.col("ref").alias("match_name"), F.col("ref_id").alias("match_id")), "match_name").withColumn("reasoning", F.lit("best candidate"))
    else:
        asked = hits.select("input", F.col("rank").cast("long").alias("ord"), F.col("ref_id").alias("id"), F.col("ref").alias("name"))
        one = asked.select("input").distinct().withColumn("ord", F.lit(1).cast("long")).withColumn("name", F.col("input"))
        said = resolver.resolve(resolver.prompts(one, asked, ["input"], settings.candidates), answer)
        found = resolver.parsed(said).where("index = 1")
        best = found.groupBy("input").agg(F.max_by(F.struct(F.coalesce("matched_id", "match_id").alias("match_id"), "match_name", "confidence", "reasoning"), "pos").alias("a")).select("input", "a.*")
    rows = inputs.select("ord", F.col("name").alias("input_name")).join(best, F.col("input_name") == F.col("input"), "left").drop("input")
    done = report.enrich(rows, refs)
    return done.select("ord", "input_name", "match_id", "match_name", "match_path", "confidence", F.coalesce("reasoning", F.lit("no candidate")).alias("reasoning"))


_HIERARCHICAL = ("input_id", "input_name", "input_path", "input_full_path", "match_id", "match_name", "match_path", "match_full_path", "confidence", "reasoning", "match_method")


def best_in_branch(grouped: DataFrame, ref_tree: DataFrame) -> DataFrame:
    """key, match_id, confidence: of all nodes of the input's branch the one whose path shares most words, leaves
    first, then in order, on ties; inputs that share none are left out.

    Paths of the same words score alike, so on either side each such class is compared once."""
    words = lambda: F.array_sort(text.path_words(F.col("full_path")))
    mine = grouped.select("key", "root_id", words().alias("mine"))
    first = F.min(F.struct((~F.col("is_leaf")).alias("inner"), "ord", "id"))
    theirs = ref_tree.groupBy(text.root_of(F.col("path_ids")).alias("root_id"), words().alias("theirs")).agg(first.alias("r"))
    pairs = mine.select("root_id", "mine").distinct().join(theirs, "root_id").withColumn("s", similarity.set_jaccard(F.col("mine"), F.col("theirs"))).where("s > 0")
    best = pairs.groupBy("root_id", "mine").agg(F.min(F.struct((-F.col("s")).alias("s"), "r")).alias("m"))
    of_key = mine.join(best, ["root_id", "mine"]).groupBy("key").agg(F.min("m").alias("m"))  # ids may repeat
    return of_key.select("key", F.col("m.r.id").alias("match_id"), (-F.col("m.s")).alias("confidence"))


def hierarchical(inputs: DataFrame, refs: DataFrame, settings: Settings = DEFAULT, answer: Answerer | None = None) -> DataFrame:
    """A row for each input leaf: settled by name and path, else by its branch's request (or, without
    ``answer``, by the best path in its branch), else ``none``.

    Rows, trees and routes are written once each: every later step reads them several times, and a plan that
    holds them all as subplans takes more of the driver than its memory, whatever the number of rows."""
    keyed = lambda t: t.where("is_leaf").withColumn("key", F.col("id"))
    read = [keep(refs, "refs"), keep(inputs, "inputs")]
    ref_tree, mine = keep(tree.build(read[0]), "ref_tree"), keep(keyed(tree.build(read[1])), "input_leaves")
    theirs = keyed(ref_tree)
    routed = keep(routing.exact_router(mine, theirs, settings), "routed")
    for done in (*read, mine):
        drop(done)
    left = routed.where("match_id is null").drop("confidence", "match_id", "match_method")
    grouped = left.join(routing.branch_groups(left, theirs, settings).select("key", "root_id"), "key")
    if answer is None:
        best = best_in_branch(grouped, ref_tree).withColumn("reasoning", F.lit("best path in the branch"))
    else:
        context = tree.branch_context(ref_tree, settings.branch_context)  # a prompt has to be short
        batched = routing.batches(grouped, "ord", settings.batch_size, "root_id").select("root_id", "batch_id", "ord", "name", "key")
        ask = resolver.prompts(batched.select("root_id", "batch_id", "ord", "name"), context.select("root_id", "ord", "id", "name", "place"), ["root_id", "batch_id"], settings.branch_context)
        said = resolver.parsed(resolver.resolve(ask, answer)).where("index is not null")
        last = said.groupBy("root_id", "batch_id", "index").agg(F.max_by(F.struct(F.coalesce("matched_id", "match_id").alias("match_id"), "confidence", "reasoning"), "pos").alias("a")).select("root_id", "batch_id", F.col("index").alias("pos"), "a.*")
        numbered = batched.withColumn("pos", F.row_number().over(Window.partitionBy("root_id", "batch_id").orderBy("ord")))
        best = numbered.join(last, ["root_id", "batch_id", "pos"]).where(report.has_match(F.col("match_id"))).select("key", "match_id", "confidence", "reasoning")
    rest = left.join(best, "key", "left").withColumn("match_method", F.when(F.col("match_id").isNotNull(), "ai").otherwise("none"))
    exact = routed.where("match_id is not null").withColumn("reasoning", F.when(F.col("confidence") == 1, "same name").otherwise("same name, best path"))
    rows = exact.unionByName(rest.withColumn("confidence", F.coalesce("confidence", F.lit(0.0))), allowMissingColumns=True)
    named = ref_tree.select(F.col("id").alias("match_id"), F.col("name").alias("match_name"), F.col("path").alias("match_path"), F.col("full_path").alias("match_full_path"))
    out = rows.select(F.col("id").alias("input_id"), F.col("name").alias("input_name"), F.col("path").alias("input_path"), F.col("full_path").alias("input_full_path"), "match_id", "confidence", F.coalesce("reasoning", F.lit("no match")).alias("reasoning"), "match_method")
    return out.join(named, "match_id", "left").select(*_HIERARCHICAL)


def automatic(inputs: DataFrame, refs: DataFrame, settings: Settings = DEFAULT, answer: Answerer | None = None, synonyms=BASIC_SYNONYMS) -> DataFrame:
    """Inputs, the first of each id, with the first reference leaf (by path prefix) that is sure; what is left goes on
    as in flat(). compat leaves match_path empty."""
    mine, theirs = report.first_of_each(inputs), tree.prefix_leaves(refs)
    names = theirs.groupBy(F.col("name").alias("ref")).agg(F.min("ord").alias("ref_ord"), F.min_by("id", "ord").alias("match_id"))
    sure = candidates.auto_match(mine.select(F.col("name").alias("input")).distinct(), names, synonyms, settings).join(names.select("ref", "match_id"), "ref")
    auto = mine.join(sure.select(F.col("input").alias("name"), "match_id", F.col("score").alias("confidence")), "name")
    auto = report.enrich(auto.select("ord", F.col("id").alias("input_id"), F.col("name").alias("input_name"), "match_id", "confidence"), refs, settings.compat).withColumn("processing_method", F.lit("auto"))
    left = mine.join(sure.select(F.col("input").alias("name")), "name", "left_anti")
    rest = flat(left, theirs, settings, answer).join(left.select("ord", F.col("id").alias("input_id")), "ord").withColumn("processing_method", F.lit("batch"))
    if settings.compat:
        rest = rest.withColumn("match_path", F.lit(""))
    columns = ["ord", "input_id", "input_name", "match_id", "match_name", "match_path", "confidence", "processing_method"]
    return auto.select(*columns).unionByName(rest.select(*columns)).withColumns(resolver.review_flags(F.col("confidence")))
