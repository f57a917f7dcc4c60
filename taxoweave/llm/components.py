"""Connected components by alternating large-star and small-star steps, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .scratch import drop, keep


def _nearest(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and all v of that u. The hot u are combined before the
    shuffle, and the join that brings m back can be split by adaptive execution."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _nearest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met = _nearest(down)
    moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(met.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The written edges, and their number and sum of hashes, observed while they were written."""
    seen = Observation()
    marked = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    return keep(marked, "edges"), (seen.get["n"], seen.get["h"])


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """A kept table (node, component) for every end of an edge of ``edges`` (u, v); component is its least node.

    Nulls in either end and edges from a node to itself say nothing and are left out, so a node
    with no other edge isn't in the result. No edges: an empty result. Each round is written to
    the shared folder; the loop ends when a round changes nothing.
    """
    now, seen = _kept(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds if seen[0] else 0):
        was, old = seen, now
        now, seen = _kept(_small_star(_large_star(old)))
        drop(old)
        if was == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    out = keep(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots), "components")
    drop(now)
    return out
