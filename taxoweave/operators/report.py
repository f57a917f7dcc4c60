"""Enrichment, classes of confidence, leftovers, statistics and result documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Settings
from ..functions import similarity, text


def enrich(matches: DataFrame, refs: DataFrame, compat_paths: bool = False) -> DataFrame:
    """match_name where it was empty, and match_path, of the matched reference; unknown ids keep theirs."""
    named = refs.select(F.col("id").alias("match_id"), F.col("name").alias("__name"), F.col("path").alias("__path"))
    rows = matches.join(named, "match_id", "left").withColumn("confidence", similarity.confidence(F.col("confidence")))
    path = F.lit("") if compat_paths else F.coalesce("__path", F.lit(""))
    own = F.nullif(F.col("match_name"), F.lit("")) if "match_name" in matches.columns else F.lit(None).cast("string")
    return rows.withColumn("match_name", F.coalesce(own, "__name")).withColumn("match_path", path).drop("__name", "__path")


def has_match(match_id: Column) -> Column:
    return match_id.isNotNull() & ~match_id.isin("", "null")


def accepted(matches: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    if not 0 <= settings.confidence <= 1:
        raise ValueError("the confidence threshold lies between 0 and 1")
    return matches.where(has_match(F.col("match_id")) & (F.col("confidence") >= settings.confidence))


def confidence_class(confidence: Column, settings: Settings = DEFAULT) -> Column:
    return F.when(confidence >= settings.high_confidence, "high").when(confidence >= settings.medium_confidence, "medium").otherwise("low")


def classify(matches: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """One row: matched and its parts by class, after the threshold."""
    c, good = F.col("confidence"), accepted(matches, settings)
    return good.agg(F.count("*").alias("matched"), *[F.count_if(confidence_class(c, settings) == k).alias(f"{k}_confidence") for k in ("high", "medium", "low")])


def unmatched_by_name(inputs: DataFrame, matches: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Inputs whose name no accepted match has; repeats stay, so do both sides' repeats count."""
    return inputs.join(accepted(matches, settings).select(F.col("input_name").alias("name")).distinct(), "name", "left_anti")


def unmatched_by_id(inputs: DataFrame, matches: DataFrame) -> DataFrame:
    return inputs.join(matches.select(F.col("input_id").alias("id")).distinct(), "id", "left_anti")


def first_of_each(rows: DataFrame, key: str = "id", order: str = "ord", drop_empty: bool = False) -> DataFrame:
    """The first row of each key; null keys are the empty key, which can be left out."""
    keyed = rows.withColumn("__k", F.coalesce(key, F.lit("")))
    if drop_empty:
        keyed = keyed.where("__k <> ''")
    w = Window.partitionBy("__k").orderBy(order)
    return keyed.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__k", "__n")


def share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def match_statistics(matches: DataFrame, calls: Column, batch_size: int = DEFAULT.batch_size) -> DataFrame:
    """Counts and percentages by method; savings as documented, which can be negative."""
    n = F.count("*")
    by = {k: F.count_if(F.col("match_method") == k) for k in ("exact", "ai", "none")}
    return matches.agg(
        n.alias("total"),
        *[c.alias(f"{k}_matches") for k, c in by.items()],
        *[share(c, n).alias(f"{k}_pct") for k, c in by.items()],
        share(n - F.max(calls) * batch_size, n).alias("saved_pct"),
    )


def automatic_statistics(total: Column, auto: Column, calls: Column, seconds: Column) -> list[Column]:
    return [
        share(auto, total).alias("auto_match_rate"),
        share(total - auto, total).alias("ai_processing_rate"),
        ((total - auto) / F.greatest(calls, F.lit(1))).alias("api_call_efficiency"),
        F.coalesce(F.try_divide(total, seconds), F.lit(0.0)).alias("categories_per_second"),
    ]


def document(matches: DataFrame, inputs: DataFrame, settings: Settings, references: int, calls: int, seconds: float, processed_at: str) -> DataFrame:
    """The result document as one row. Its lists are the result itself, so its size is the caller's."""
    entry = F.struct(*[F.col(c) for c in ("input_name", "match_id", "match_name", "match_path", "confidence", "reasoning")])
    good = accepted(matches, settings).agg(F.array_sort(F.collect_list(F.struct("ord", entry.alias("e")))).alias("m"), *[F.count_if(confidence_class(F.col("confidence"), settings) == k).alias(k) for k in ("high", "medium", "low")])
    left = unmatched_by_name(inputs, matches, settings).agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(F.col("name").alias("input_name"), F.lit("no fitting category in the reference").alias("reasoning")).alias("e")))).alias("u"))
    one = good.crossJoin(left).crossJoin(inputs.agg(F.count("*").alias("n")))  # one row each
    statistics = F.struct(
        F.col("high").alias("high_confidence"), F.col("medium").alias("medium_confidence"), F.col("low").alias("low_confidence"), F.lit(calls).cast("long").alias("api_requests"),
        text.duration(F.lit(seconds)).alias("processing_time"), F.lit(settings.confidence).alias("confidence_threshold"), F.lit(references).cast("long").alias("reference_categories_count"),
    )
    return one.select(F.lit(processed_at).alias("processed_at"), F.col("n").alias("total_input"), F.size("m").cast("long").alias("total_matched"), F.size("u").cast("long").alias("total_unmatched"), F.col("m.e").alias("matches"), F.col("u.e").alias("unmatched"), statistics.alias("statistics"))


def summary(doc: DataFrame) -> DataFrame:
    """A few lines of text about a result document; no inputs: 0 percent."""
    pct = lambda c: F.format_string("%.1f", share(F.col(c), F.col("total_input")))
    s = lambda c: F.col(f"statistics.{c}").cast("string")
    lines = [
        F.concat(F.lit("Processed: "), "processed_at"), F.concat(F.lit("Time: "), s("processing_time")), F.concat(F.lit("Inputs: "), F.col("total_input").cast("string")),
        F.concat(F.lit("Matched: "), F.col("total_matched").cast("string"), F.lit(" ("), pct("total_matched"), F.lit("%)")),
        F.concat(F.lit("Unmatched: "), F.col("total_unmatched").cast("string"), F.lit(" ("), pct("total_unmatched"), F.lit("%)")),
        F.concat(F.lit("High / medium / low: "), s("high_confidence"), F.lit(" / "), s("medium_confidence"), F.lit(" / "), s("low_confidence")),
        F.concat(F.lit("Requests: "), s("api_requests")), F.concat(F.lit("Threshold: "), s("confidence_threshold")), F.concat(F.lit("References: "), s("reference_categories_count")),
    ]
    return doc.select(F.concat_ws("\n", *lines).alias("summary"))


def unmatched_only(doc: DataFrame) -> DataFrame:
    """Of a result document what is left over, for a closer look."""
    return doc.select("processed_at", "total_unmatched", F.col("statistics.confidence_threshold").alias("confidence_threshold"), "unmatched")


_INPUT_FIELDS = ("input_id", "input_name", "input_path", "input_full_path")
_MATCH_FIELDS = (*_INPUT_FIELDS, "match_id", "match_name", "match_path", "match_full_path", "confidence", "reasoning")


def result_rows(results: DataFrame) -> DataFrame:
    """Results of hierarchical() as rows of a table, which no task has to hold together: all of them, with
    matched saying on which side of the document each is. No threshold."""
    return results.withColumn("matched", F.coalesce(has_match(F.col("match_id")), F.lit(False)))


def hierarchical_document(results: DataFrame, calls: int, seconds: float, processed_at: str) -> DataFrame:
    """The result document of hierarchical() as one row, in order of input ids. Its lists are the result itself,
    so its size is the caller's; result_rows() has the same as a table."""
    rows, order = result_rows(results), F.col("input_id")
    entry = F.struct(*[F.col(c) for c in _MATCH_FIELDS], F.col("match_method").alias("method"))
    left = F.struct(*[F.col(c) for c in (*_INPUT_FIELDS, "reasoning")])
    listed = lambda c, e: F.transform(F.array_sort(F.collect_list(F.when(c, F.struct(order.alias("o"), e.alias("e"))))), lambda x: x["e"])
    by = {f"{k}_matches": F.count_if(F.col("match_method") == m) for k, m in (("exact", "exact"), ("ai", "ai"), ("no", "none"))}
    one = rows.agg(F.count("*").alias("total_input"), F.count_if("matched").alias("total_matched"), F.count_if(~F.col("matched")).alias("total_unmatched"), listed(F.col("matched"), entry).alias("matches"), listed(~F.col("matched"), left).alias("unmatched"), *[c.alias(k) for k, c in by.items()])
    statistics = F.struct(*by, F.lit(calls).cast("long").alias("api_requests"), F.format_string("%.2fs", F.lit(float(seconds))).alias("processing_time"))
    return one.select(F.lit(processed_at).alias("processed_at"), "total_input", "total_matched", "total_unmatched", "matches", "unmatched", statistics.alias("statistics"))


def hierarchical_summary(doc: DataFrame, batch_size: int = DEFAULT.batch_size) -> DataFrame:
    """A few lines of text about a document of hierarchical(): counts by method with their share, the
    share of matches, requests and what they saved. No inputs: 0 percent."""
    n, s = F.col("total_input"), lambda c: F.col(f"statistics.{c}")
    line = lambda name, c: F.format_string(f"{name}: %d (%.1f%%)", c, share(c, n))
    lines = [
        F.concat(F.lit("Hierarchical matching - "), "processed_at"), F.format_string("Inputs: %d", n), line("Exact", s("exact_matches")), line("By matcher", s("ai_matches")), line("Unmatched", s("no_matches")),
        F.format_string("Match rate: %.1f%%", share(s("exact_matches") + s("ai_matches"), n)), F.format_string("Requests: %d", s("api_requests")),
        F.format_string("Saved: %.1f%%", share(n - s("api_requests") * batch_size, n)), F.concat(F.lit("Time: "), s("processing_time")),
    ]
    return doc.select(F.concat_ws("\n", *lines).alias("summary"))


def explain(reason: Column, score: Column, pairs: Column | None = None) -> Column:
    """A reason and its score in words; pairs of synonyms, if any, in brackets."""
    said = F.when(reason == "direct_match", "Direct match").when(reason == "synonym_match", "Match by synonyms").when(reason == "fuzzy_match", "Similar text").when(reason == "transliteration_match", "Match after transliteration").when(reason == "partial_match", "Some words alike").otherwise("Unknown reason")
    listed = F.lit("") if pairs is None else F.when((reason == "synonym_match") & (F.size(pairs) > 0), F.concat(F.lit(" ("), F.array_join(pairs, ", "), F.lit(")"))).otherwise("")
    return F.concat(said, listed, F.format_string(". Confidence: %.2f", score))
