"""The catalogue of parts as two taxonomies, in Spark and in DuckDB's SQL.

Reference: brand > type > part. Input: type > brand > part, and the suppliers as leaves that match
nothing. Names of parts repeat often, so most have to be told apart by their paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import tree

_BRAND = "cast(substr(p_brand, 7) as bigint)"
_TYPE = "ascii(substr(p_type, 2, 1))"
_REFERENCE = f"""
SELECT DISTINCT {_BRAND} AS ord, 'B:' || p_brand AS id, p_brand AS name, 'B:' || p_brand AS path FROM part
UNION ALL SELECT DISTINCT 10000 + {_BRAND} * 256 + {_TYPE}, 'T:' || p_brand || '|' || p_type, p_type, 'B:' || p_brand || '>T:' || p_brand || '|' || p_type FROM part
UNION ALL SELECT 1000000 + p_partkey, 'P:' || p_partkey, p_name, 'B:' || p_brand || '>T:' || p_brand || '|' || p_type || '>P:' || p_partkey FROM part
"""
_INPUT = f"""
SELECT DISTINCT cast({_TYPE} as bigint) AS ord, 'IT:' || p_type AS id, p_type AS name, 'IT:' || p_type AS path FROM part
UNION ALL SELECT DISTINCT 10000 + {_BRAND} * 256 + {_TYPE}, 'IB:' || p_type || '|' || p_brand, p_brand, 'IT:' || p_type || '>IB:' || p_type || '|' || p_brand FROM part
UNION ALL SELECT 1000000 + p_partkey * 2, 'IP:' || p_partkey, p_name, 'IT:' || p_type || '>IB:' || p_type || '|' || p_brand || '>IP:' || p_partkey FROM part
UNION ALL SELECT 5000, 'IS', 'suppliers', 'IS'
UNION ALL SELECT 1000001 + s_suppkey * 2, 'IS:' || s_suppkey, s_name, 'IS>IS:' || s_suppkey FROM supplier
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_REFERENCE.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_INPUT.replace("FROM part", "FROM {part}").replace("FROM supplier", "FROM {supplier}"), part=table(spark, sf_dir, "part"), supplier=table(spark, sf_dir, "supplier"))


def leaves(nodes: DataFrame) -> DataFrame:
    """Built leaves, with key for id."""
    return tree.build(nodes).where("is_leaf").withColumn("key", F.col("id"))


def ref_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref, ref_ord, n: each distinct name of a part, its first place and how many have it."""
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("ref")).agg(F.min("p_partkey").alias("ref_ord"), F.count("*").alias("n"))


def input_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """input: type and name of parts, in that order, as one name; and the types."""
    part = table(spark, sf_dir, "part")
    return part.select(F.concat_ws(" ", F.lower("p_type"), "p_name").alias("input")).unionByName(part.select(F.col("p_type").alias("input"))).distinct()


def ref_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref, level, tokens: keywords of the name and of its first part's type."""
    part = table(spark, sf_dir, "part")
    first = part.groupBy(F.col("p_name").alias("ref")).agg(F.min_by("p_type", "p_partkey").alias("t"))
    level = lambda n, c: first.select("ref", F.lit(n).alias("level"), text.advanced_keywords(F.col(c)).alias("tokens"))
    return level(1, "t").unionByName(level(2, "ref"))


# ---- SQL -----------------------------------------------------------------------------------


def tree_sql(name: str, rows: str) -> str:
    return f"""
{name} AS ({rows}),
{name}_ids AS (SELECT *, string_split(path, '>') AS ids FROM {name}),
{name}_par AS (SELECT i.*, p.id AS parent_id FROM {name}_ids i LEFT JOIN {name} p ON len(i.ids) > 1 AND p.id = i.ids[len(i.ids) - 1]),
{name}_cnt AS (SELECT parent_id AS id, count(*) AS n FROM {name}_par WHERE parent_id IS NOT NULL GROUP BY 1),
{name}_nam AS (SELECT x.id, string_agg(n.name, ' > ' ORDER BY x.pos) AS full_path, list(n.name ORDER BY x.pos) AS names
  FROM (SELECT id, unnest(ids) AS part, unnest(range(1, len(ids) + 1)) AS pos FROM {name}_ids) x JOIN {name} n ON n.id = x.part GROUP BY 1),
{name}_tree AS (SELECT p.ord, p.id, p.name, p.path, p.ids, p.parent_id, coalesce(c.n, 0) AS children_count, coalesce(c.n, 0) = 0 AS is_leaf, f.full_path, f.names
  FROM {name}_par p LEFT JOIN {name}_cnt c USING (id) LEFT JOIN {name}_nam f USING (id))"""


REF_SQL = tree_sql("ref", _REFERENCE)
IN_SQL = tree_sql("inp", _INPUT)
NAMES_SQL = """
refs AS (SELECT p_name AS ref, min(p_partkey) AS ref_ord, count(*) AS n FROM part GROUP BY 1),
inputs AS (SELECT DISTINCT input FROM (SELECT lower(p_type) || ' ' || p_name AS input FROM part UNION ALL SELECT p_type FROM part))"""
