"""Trees of categories: parents, leaves by three rules, names along the path, branches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text


def with_parents(nodes: DataFrame) -> DataFrame:
    """path_ids and parent_id; a parent that is no node is none. compat inputs carry id_is_text:
    a path's parts are text, so they find no id that wasn't."""
    ids = nodes.withColumn("path_ids", text.path_ids(F.col("path")))
    named = nodes.where("id_is_text") if "id_is_text" in nodes.columns else nodes
    known = named.select(F.col("id").alias("known")).distinct()
    return ids.withColumn("up", text.parent_of(F.col("path_ids"))).join(known, F.col("up") == F.col("known"), "left").withColumn("parent_id", F.col("known")).drop("known", "up")


def children_count(nodes: DataFrame) -> DataFrame:
    """nodes (with parent_id) with children_count and is_leaf; combined before the shuffle."""
    counted = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("of")).agg(F.count("*").alias("n"))
    mine = F.col("id") == F.col("of")
    if "id_is_text" in nodes.columns:
        mine = mine & F.col("id_is_text")
    return nodes.join(counted, mine, "left").withColumn("children_count", F.coalesce("n", F.lit(0).cast("long"))).withColumn("is_leaf", F.col("children_count") == 0).drop("of", "n")


def with_names(nodes: DataFrame) -> DataFrame:
    """names: the names of the path's ids that are nodes, in order."""
    named = nodes.where("id_is_text") if "id_is_text" in nodes.columns else nodes
    names = named.select(F.col("id").alias("part"), F.col("name").alias("part_name"))
    parts = nodes.select(F.col("ord").alias("of"), F.posexplode("path_ids").alias("pos", "part")).join(names, "part")
    found = parts.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("pos", "part_name"))).alias("p")).select("of", F.col("p.part_name").alias("names"))
    return nodes.join(found, F.col("ord") == F.col("of"), "left").drop("of").withColumn("names", F.coalesce("names", text.no_words()))


def build(nodes: DataFrame) -> DataFrame:
    """ord, id, name, path, path_ids, parent_id, children_count, is_leaf, names, full_path."""
    return with_names(children_count(with_parents(nodes))).withColumn("full_path", text.displayed(F.col("names")))


def prefix_leaves(nodes: DataFrame) -> DataFrame:
    """Nodes of which no other path is a continuation, and all roots."""
    ids = nodes.withColumn("path_ids", text.path_ids(F.col("path")))
    # every strict prefix of a path, as a path: an equality join instead of a test of all pairs
    above = ids.where(F.size("path_ids") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("path_ids") - 1), lambda n: F.array_join(F.slice("path_ids", 1, n), ">"))).alias("above")).distinct()
    inner = ids.where(F.size("path_ids") > 1)
    return inner.join(above, F.col("path") == F.col("above"), "left_anti").unionByName(ids.where(F.size("path_ids") <= 1)).drop("path_ids")


def parentless_leaves(nodes: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Nodes that no node names as its parent."""
    parents = nodes.where(F.col(parent).isNotNull()).select(F.col(parent).alias("p")).distinct()
    return nodes.join(parents, F.col("id") == F.col("p"), "left_anti")


def ancestors(nodes: DataFrame) -> DataFrame:
    """id, level (1: parent), ancestor_id, ancestor_name for the ancestors that are nodes."""
    ids = nodes.withColumn("path_ids", text.path_ids(F.col("path")))
    up = ids.select("id", F.size("path_ids").alias("n"), F.posexplode("path_ids").alias("pos", "ancestor_id")).where("pos < n - 1").select("id", (F.col("n") - 1 - F.col("pos")).alias("level"), "ancestor_id")
    return up.join(nodes.select(F.col("id").alias("ancestor_id"), F.col("name").alias("ancestor_name")), "ancestor_id")


def branch_context(tree: DataFrame, most: int | None = 50) -> DataFrame:
    """For each root: its leaves first, then its other nodes, in order, up to ``most`` (all, if None)."""
    root = text.root_of(F.col("path_ids"))
    order = Window.partitionBy("root_id").orderBy(F.col("is_leaf").desc(), "ord")
    placed = tree.withColumn("root_id", root).withColumn("place", F.row_number().over(order))
    return placed if most is None else placed.where(F.col("place") <= most)
