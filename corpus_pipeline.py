"""The corpus pipeline: each stage is one operator, whose result is written and read as the next one's documents.

Every stage takes documents with any further columns, whatever their names, and passes them on.
Rows without a doc_id, repeated rows and null, empty and very long texts go through all stages; what
each does with them stands at the stage. A table without rows gives one without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from taxoweave.llm import jaccard, mixing, packing, quality, substring
from taxoweave.llm.scratch import drop, keep


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among them.

    Rows are judged one by one by their texts alone. Null and empty texts get what the model's bias says."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest doc_id, of each group that 5-gram Jaccard links join.

    Null and empty texts are linked with nothing and stay, as do rows without a doc_id."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 50-word windows of earlier documents; untouched where there are
    none. Documents of which no word is left are gone; n_chars is that of the new text.

    Null, empty and short texts and rows without a doc_id stay as they are."""
    return substring.deduped_rows(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them. A null source is a source of its own; a
    source without words is not taken."""
    return mixing.mixed_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids, in their sequences. Each copy that the mix
    made is a document of its own; a null or empty text is the end token alone."""
    return packing.pack(docs, ids=True)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources", mixed_sources),
    ("best-fit packing", packed),
]

#: A trained classifier has no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
