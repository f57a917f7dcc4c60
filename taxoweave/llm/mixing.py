"""Mixing sources to target weights, in SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .inputs import unused
from .scratch import keep

#: A word is a run of anything but space and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Fixed values of the contract: weights repeat in this order over the sources.
WEIGHTS = (5, 2, 1)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size, target, rate) from per-source totals (source, source_size).

    Sources in order of code points, the null source last, weigh ``weights``, repeating. They share
    share[0]/share[1] of all words by weight; no target exceeds ``most`` times its source's words,
    and what is cut off is shared again by weight until none is above. This has a closed form: in
    order of size / weight the sources that reach their limit come first, so the level at which the
    rest share is the first that leaves the next source below its limit. All sums are whole
    numbers. The windows run over one row per source, after aggregation.
    """
    n = len(weights)
    order = F.array(*[F.lit(w) for w in weights])
    placed = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weighed = placed.withColumn("weight", F.element_at(order, (F.pmod(F.col("place") - 1, F.lit(n)) + 1).cast("int")).cast("long"))
    by_ratio = Window.orderBy((F.col("source_size") / F.col("weight")).asc(), "place")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1))
    level = (
        weighed.withColumn("cut", F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0).cast("long")))
        .withColumn("left", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0).cast("long")))
        .withColumn("all", F.sum("source_size").over(all_rows))
        # scaled by share[1], so everything before the division is whole
        .withColumn("free", F.col("all") * share[0] - F.col("cut") * share[1])
        .withColumn("limited", F.col("source_size") * most * share[1] * F.col("left") <= F.col("free") * F.col("weight"))
    )
    # the first source that isn't limited fixes the level for itself and all after it
    level = level.withColumn("pivot", F.min(F.when(~F.col("limited"), F.struct(F.col("source_size") / F.col("weight"), F.col("place"), F.col("free"), F.col("left")))).over(all_rows))
    target = F.when(
        F.col("pivot").isNull() | (F.struct(F.col("source_size") / F.col("weight"), F.col("place"), F.col("free"), F.col("left")) < F.col("pivot")),
        (F.col("source_size") * most).cast("double"),
    ).otherwise(F.col("pivot.free") * F.col("weight") / (F.col("pivot.left") * share[1]))
    return level.select("source", "source_size", target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))


#: Sources whose rates are sent to all tasks: some megabytes. Beyond this the join is by key.
SENT = 100_000


def _rates(sizes: DataFrame) -> DataFrame:
    rates = keep(source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))), "rates")
    few, rates = rates.count() <= SENT, rates.withColumnRenamed("source", "__source")
    return rates.hint("broadcast") if few else rates


def seeded_fraction(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys only: 52 bits of an MD5 digest."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mix(docs: DataFrame, seed: str = "mix", key: str = "doc_id") -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken.

    Tokens are summed per source (combined before the shuffle, so one hot source is no hot task),
    a source's rate is its target over its words, and each document is taken floor(rate) times plus
    once more if its seeded number lies below the rate's fraction. Null text has no words; a null
    source is a source of its own, last in order. A null doc_id draws by its empty name; repeated
    rows with the same id draw alike. Sources without words have target 0 and rate 0. The join
    back is on the source: the rates are sent to all tasks if there are at most SENT sources; beyond
    that the join is by key, where adaptive execution splits the hot ones.
    """
    own = docs.select(F.col(key).alias("doc_id"), F.col("source"), F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rates = _rates(own)
    extra = (seeded_fraction(seed, F.col("doc_id")) < F.col("rate") - F.floor("rate")).cast("long")
    return (
        own.join(rates, F.col("source").eqNullSafe(F.col("__source")))
        .withColumn("copies", F.floor("rate") + extra)
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))
    )


def mixed_rows(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of documents, each as often as the mix takes it; all columns as they came, whatever their
    names. Null texts have no words and are taken by their source's rate all the same."""
    held, own = unused("row", docs.columns), unused("source", docs.columns)
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rates = _rates(docs.select("source", words.alias("size"))).select(F.col("__source").alias(own), "rate")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(held))  # no name of a column can clash
    copies = F.floor("rate") + (seeded_fraction(seed, F.col(held)["doc_id"]) < F.col("rate") - F.floor("rate")).cast("long")
    taken = rows.join(rates, F.col(held)["source"].eqNullSafe(F.col(own))).select(held, F.explode(F.array_repeat(F.lit(1), copies.cast("int"))))
    return taken.select(*[F.col(held).getField(c).alias(c) for c in docs.columns])


#: The same rows in DuckDB's SQL.
ORACLE = r"""
WITH own AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM own GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sizes),
weighed AS (SELECT *, (CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::BIGINT AS weight, source_size / (CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS ratio FROM placed),
ordered AS (SELECT *,
    coalesce(sum(2 * source_size) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cut,
    (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS remaining,
    (sum(source_size) OVER ())::BIGINT AS total FROM weighed),
judged AS (SELECT *, 3 * total - 2 * cut AS free, 4 * source_size * remaining <= (3 * total - 2 * cut) * weight AS limited FROM ordered),
fixing AS (SELECT ratio, place, free, remaining FROM judged WHERE NOT limited ORDER BY ratio, place LIMIT 1),
rates AS (SELECT j.source, j.source_size,
    CASE WHEN p.place IS NULL OR j.ratio < p.ratio OR (j.ratio = p.ratio AND j.place < p.place) THEN (2 * j.source_size)::DOUBLE
         ELSE (p.free * j.weight)::DOUBLE / (p.remaining * 2)::DOUBLE END AS target
  FROM judged j LEFT JOIN fixing p ON true),
drawn AS (SELECT own.doc_id, own.size, rates.source_size, rates.target,
    CASE WHEN rates.source_size > 0 THEN rates.target / rates.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('mix|' || coalesce(own.doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM own JOIN rates ON own.source IS NOT DISTINCT FROM rates.source)
SELECT doc_id, size, source_size, target, size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT) AS taken FROM drawn
"""


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs.select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")
