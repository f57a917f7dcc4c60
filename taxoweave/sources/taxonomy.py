"""Taxonomies as rows: readers that keep the file's order, and writers of result documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType([T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("path", T.StringType())])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """ord, id, name, path, id_is_text of a JSON array of records, or of an object's ``categories``.

    ord is the place in the file. Ids and paths are read as text; id_is_text says whether the file
    had a string. One file is one task; large taxonomies belong in JSON lines or Parquet.
    """
    whole = spark.read.text(path, wholetext=True)
    listed = F.coalesce(F.from_json("value", "array<string>"), F.from_json(F.get_json_object("value", "$.categories"), "array<string>"))
    each = whole.select(F.posexplode(listed).alias("ord", "item"))
    raw = F.try_parse_json("item")
    kind = F.schema_of_variant(F.try_variant_get(raw, "$.id", "variant"))
    text = lambda k: F.try_variant_get(raw, f"$.{k}", "string")
    return each.select(F.col("ord").cast("long").alias("ord"), text("id").alias("id"), text("name").alias("name"), F.coalesce(text("path"), F.lit("")).alias("path"), F.coalesce(kind == "STRING", F.lit(False)).alias("id_is_text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Splittable input: one record a line, with its own ``ord``."""
    return spark.read.schema(T.StructType([T.StructField("ord", T.LongType()), *RECORD.fields])).json(path)


def required(df: DataFrame, columns: tuple[str, ...] = ("id", "name", "path")) -> DataFrame:
    """df, if it has the columns; their nulls are an error when the rows are read."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"the taxonomy lacks {missing}")
    return df.withColumns({c: F.coalesce(F.col(c), F.raise_error(F.lit(f"a row without {c}")).cast(df.schema[c].dataType)) for c in columns})


def latest(df: DataFrame, key: str = "id", order: str = "ord") -> DataFrame:
    """Of rows that share a key, the last."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(key, "r.*").select(*df.columns)


def write_document(document: DataFrame, path: str) -> None:
    """A one-row document as indented JSON."""
    text = F.to_json(F.struct(*document.columns), {"pretty": "true", "ignoreNullFields": "false"})
    document.select(text.alias("value")).coalesce(1).write.mode("overwrite").text(path)
