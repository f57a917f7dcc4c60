"""Reading the columns that an operator needs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer partitions than there are cores out to all; larger ones stay as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, 8) else df


def repeats_ids(docs: DataFrame) -> bool:
    """Whether a doc_id is on more than one row."""
    return bool(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count())


def row_mark(docs: DataFrame, column: str = "text"):
    """What tells rows of one doc_id apart: nothing where ids don't repeat, else the text's hash."""
    return F.xxhash64(column) if repeats_ids(docs) else F.lit(0).cast("long")


def filled(df: DataFrame, column: str = "doc_id") -> DataFrame:
    """Null ids as 0 with a mark, since pandas would turn a column with nulls into floats."""
    return df.withColumn("__no_id", F.col(column).isNull()).withColumn(column, F.coalesce(F.col(column).cast("long"), F.lit(0).cast("long")))


def unfilled(df: DataFrame, column: str = "doc_id") -> DataFrame:
    """The nulls of filled() again."""
    return df.withColumn(column, F.when(~F.col("__no_id"), F.col(column))).drop("__no_id")


def unused(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that no column has (names don't tell upper and lower case apart)."""
    low = {c.lower() for c in taken}
    while name.lower() in low or name.lower() in ("doc_id", "text"):
        name = "_" + name
    return name
