import json

import pytest
from pyspark.sql import functions as F

from taxoweave.config import Settings
from taxoweave.operators import routing, tree
from taxoweave.sources import taxonomy

ROWS = [("1", "Root", "1"), ("2", "Red bolts", "1>2"), ("3", "Bolts", "1>2>3"), ("10", "Other", "10"), ("11", "Bolts", "10>11"), ("12", "Orphan", "99>12"), ("20", "Alone", "20")]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], "ord long, id string, name string, path string")


def by_id(df):
    return {r.id: r for r in df.collect()}


def test_build(nodes):
    t = by_id(tree.build(nodes))
    assert t["3"].parent_id == "2" and t["3"].full_path == "Root > Red bolts > Bolts" and t["3"].is_leaf
    assert t["1"].children_count == 1 and not t["1"].is_leaf
    assert t["12"].parent_id is None and t["12"].is_leaf and t["12"].full_path == "Orphan"


def test_three_kinds_of_leaves(nodes):
    assert {r.id for r in tree.build(nodes).where("is_leaf").collect()} == {"3", "11", "12", "20"}
    # by prefix every root is one
    assert {r.id for r in tree.prefix_leaves(nodes).collect()} == {"1", "3", "10", "11", "12", "20"}
    assert {r.id for r in tree.parentless_leaves(tree.with_parents(nodes)).collect()} == {"3", "11", "12", "20"}


def test_mixed_ids_in_a_file(spark, tmp_path):
    rows = [{"id": 5, "name": "a", "path": "5"}, {"id": "6", "name": "b", "path": "5>6"}]
    (tmp_path / "t.json").write_text(json.dumps(rows))
    (tmp_path / "w.json").write_text(json.dumps({"categories": rows}))
    t = taxonomy.read_json(spark, str(tmp_path / "t.json"))
    assert [(r.ord, r.id, r.id_is_text) for r in t.orderBy("ord").collect()] == [(0, "5", False), (1, "6", True)]
    # a number is no parent in compat, and one otherwise
    assert {r.id for r in tree.build(t).where("is_leaf").collect()} == {"5", "6"}
    assert {r.id for r in tree.build(t.drop("id_is_text")).where("is_leaf").collect()} == {"6"}
    assert taxonomy.read_json(spark, str(tmp_path / "w.json")).count() == 2
    with pytest.raises(ValueError):
        taxonomy.required(t.drop("name"))


def leaves(df):
    return tree.build(df).where("is_leaf").withColumn("key", F.col("id"))


def test_exact_router(spark, nodes):
    given = [(0, "a", "Root", "a"), (1, "b", "bolts", "a>b"), (2, "c", "ORPHAN", "c"), (3, "d", "none", "d")]
    inputs = leaves(spark.createDataFrame(given, "ord long, id string, name string, path string"))
    got = by_id(routing.exact_router(inputs, leaves(nodes)))
    assert (got["b"].match_id, got["b"].confidence) == ("3", 0.9)  # the path tells the two apart
    assert (got["c"].match_id, got["c"].confidence) == ("12", 1.0)
    assert got["d"].match_id is None and got["d"].match_method is None


def test_branches_and_compat_prefix(spark, nodes):
    inputs = leaves(spark.createDataFrame([(0, "a", "red", "a"), (1, "b", "zzz", "b"), (2, "c", "other", "c"), (3, "d", "yyy", "d")], "ord long, id string, name string, path string"))
    got = {r.key: r.root_id for r in routing.branch_groups(inputs, leaves(nodes)).collect()}
    assert got == {"a": "1", "c": "10", "b": "1", "d": "10"}  # unclear ones are dealt in turn
    assert {r.key: r.root_id for r in routing.branch_groups(inputs, leaves(nodes), Settings(compat=True)).collect()}["a"] == "1"
    none = leaves(spark.createDataFrame([(0, "a", "qqq", "a")], "ord long, id string, name string, path string"))
    assert [r.root_id for r in routing.branch_groups(none, leaves(nodes)).collect()] == ["general"]


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_numbering_does_not_depend_on_partitions(spark, parts):
    rows = spark.range(100).withColumnRenamed("id", "ord").repartition(parts)
    assert [(r.ord, r.batch_id) for r in routing.batches(rows, "ord", 7).orderBy("ord").collect()] == [(i, i // 7) for i in range(100)]


def test_branch_context_prefers_leaves(nodes):
    rows = tree.branch_context(tree.build(nodes), 2).where("root_id = '1'").orderBy("place").collect()
    assert [r.id for r in rows] == ["3", "1"]
