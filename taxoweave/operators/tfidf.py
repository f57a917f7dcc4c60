"""TF-IDF of word n-grams as a long table, and cosine by a join on terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text


def postings(names: DataFrame) -> DataFrame:
    """key, term, tf of names (key, name)."""
    return names.select("key", F.explode(text.word_ngrams(F.col("name"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))


def fit(posted: DataFrame, documents: DataFrame, vocabulary: int = DEFAULT.vocabulary, most_df: float = DEFAULT.most_df) -> DataFrame:
    """term, idf: ln((1 + n) / (1 + df)) + 1 of terms in at most ``most_df`` of the documents, the
    ``vocabulary`` with the most uses in the corpus, ties in order of the term. The limit also
    drops the terms that would make hot join keys."""
    n = documents.agg(F.count("*").alias("n"))
    terms = posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("uses")).crossJoin(n).where(F.col("df") <= most_df * F.col("n"))  # one row of corpus size
    best = terms.orderBy(F.col("uses").desc(), "term").limit(vocabulary)
    return best.select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def weights(posted: DataFrame, model: DataFrame) -> DataFrame:
    """key, term, w: (1 + ln tf) idf, at length 1 for each key."""
    raw = posted.join(model, "term").withColumn("raw", (1 + F.log("tf")) * F.col("idf"))
    return raw.withColumn("w", F.col("raw") / F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("key")))).select("key", "term", "w")


def cosine(inputs: DataFrame, refs: DataFrame) -> DataFrame:
    """input, ref, score of weights that share a term."""
    a = inputs.select(F.col("key").alias("input"), "term", F.col("w").alias("wa"))
    b = refs.select(F.col("key").alias("ref"), "term", F.col("w").alias("wb"))
    return a.join(b, "term").groupBy("input", "ref").agg(F.sum(F.col("wa") * F.col("wb")).alias("score"))


def save(weights: DataFrame, model: DataFrame, path: str) -> None:
    """An index as two tables: the references' weights by term, and the model."""
    weights.write.mode("overwrite").parquet(f"{path.rstrip('/')}/weights")
    model.write.mode("overwrite").parquet(f"{path.rstrip('/')}/model")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path.rstrip('/')}/weights"), spark.read.parquet(f"{path.rstrip('/')}/model")


def info(weights: DataFrame, model: DataFrame) -> DataFrame:
    """One row: references with a weight, terms of the model, weights."""
    return weights.agg(F.countDistinct("key").alias("references"), F.count("*").alias("weights")).crossJoin(model.agg(F.count("*").alias("terms")))


def nearest(inputs: DataFrame, refs: DataFrame, k: int = DEFAULT.vector_top, least: float = DEFAULT.vector_cosine) -> DataFrame:
    """The k best by cosine, of these those from ``least`` up."""
    w = Window.partitionBy("input").orderBy(F.col("score").desc(), "ref")
    ranked = cosine(inputs, refs).withColumn("score", F.round("score", 12)).withColumn("rank", F.row_number().over(w))
    return ranked.where((F.col("rank") <= k) & (F.col("score") >= least))


def search(inputs: DataFrame, refs: DataFrame, k: int = DEFAULT.vector_top, least: float = DEFAULT.vector_cosine, vocabulary: int = DEFAULT.vocabulary, most_df: float = DEFAULT.most_df) -> DataFrame:
    """input, ref, score, rank: the nearest reference names of each input name.

    inputs: input; refs: key, name. Every reference is a document of the model; names are compared
    once each, and words that no reference has say nothing."""
    model = fit(postings(refs), refs, vocabulary, most_df)
    named = lambda t, c: weights(postings(t.select(F.col(c).alias("key"), F.col(c).alias("name")).distinct()), model)
    return nearest(named(inputs, "input"), named(refs, "name"), k, least)


def dense_cosine(a, b):
    """Of two array columns, in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
