import json

import pytest
from pyspark.sql import functions as F

from taxoweave.config import Settings
from taxoweave.operators import cache, monitor, report, resolver
from taxoweave.plans import pipelines
from taxoweave.sources import taxonomy


@pytest.fixture(scope="module")
def matches(spark):
    rows = [(0, "a", "1", "", 0.8), (1, "b", "null", "x", 0.9), (2, "c", None, None, 0.9), (3, "d", "9", "kept", 0.69), (4, "e", "9", None, 0.7), (5, "a", "1", "own", 0.79)]
    return spark.createDataFrame(rows, "ord long, input_name string, match_id string, match_name string, confidence double")


def test_classes_after_the_threshold(matches):
    assert tuple(report.classify(matches).first()) == (3, 1, 2, 0)
    with pytest.raises(ValueError):
        report.accepted(matches, Settings(confidence=2))


def test_unmatched_are_by_name_and_keep_repeats(spark, matches):
    inputs = spark.createDataFrame([(0, "a"), (1, "a"), (2, "d"), (3, "d"), (4, "z")], "ord long, name string")
    assert sorted(r.ord for r in report.unmatched_by_name(inputs, matches).collect()) == [2, 3, 4]


def test_enrich_keeps_unknown_ids(spark, matches):
    refs = spark.createDataFrame([("1", "One", "0>1")], "id string, name string, path string")
    got = {r.ord: (r.match_name, r.match_path) for r in report.enrich(matches, refs).collect()}
    assert got[0] == ("One", "0>1") and got[5] == ("own", "0>1") and got[4] == (None, "")


def test_document_and_summary(spark, matches, tmp_path):
    inputs = spark.createDataFrame([(0, "a"), (1, "z")], "ord long, name string")
    rows = matches.withColumn("match_path", F.lit("")).withColumn("reasoning", F.lit("r"))
    doc = report.document(rows, inputs, Settings(), 7, 2, 61.0, "now")
    taxonomy.write_document(doc, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    got = json.loads(text)
    assert (got["total_input"], got["total_matched"], got["total_unmatched"]) == (2, 3, 1)
    assert [m["input_name"] for m in got["matches"]] == ["a", "e", "a"] and got["statistics"]["processing_time"] == "00:01:01"
    assert "Matched: 3 (150.0%)" in report.summary(doc).first().summary
    empty = report.document(rows.limit(0), inputs.limit(0), Settings(), 0, 0, 0.0, "now")
    assert "Matched: 0 (0.0%)" in report.summary(empty).first().summary


def test_first_of_each(spark):
    rows = spark.createDataFrame([(0, None), (1, ""), (2, "x"), (3, "x")], "ord long, id string")
    assert sorted(r.ord for r in report.first_of_each(rows).collect()) == [0, 2]
    assert [r.ord for r in report.first_of_each(rows, drop_empty=True).collect()] == [2]


def test_answers_in_all_shapes(spark):
    body = '{"matches": [{"index": 1, "matched_id": "7", "confidence": "0.9"}, {"index": 1, "matched_id": "8", "confidence": null}]}'
    rows = [(0, f"text ```json\n{body}\n``` end"), (1, body), (2, f"so {body} it is"), (3, "no {json"), (4, "")]
    parsed = resolver.parsed(spark.createDataFrame(rows, "batch_id long, answer string"))
    assert parsed.groupBy("batch_id").count().orderBy("batch_id").collect() == [(0, 2), (1, 2), (2, 2)]
    batch = spark.createDataFrame([(0, 1, "a"), (0, 2, "b"), (3, 1, "c")], "batch_id long, pos int, input string")
    refs = spark.createDataFrame([("8", "eight")], "id string, name string")
    got = {(r.batch_id, r.pos): (r.match_id, r.match_name, r.confidence, r.processing_method, r.needs_review) for r in resolver.by_index(batch, parsed, refs).collect()}
    assert got[0, 1] == ("8", "eight", 0.0, "batch", True)  # the last answer counts, a null confidence is 0
    assert got[0, 2] == got[3, 1] == (None, None, 0.0, "missing", True)


def test_failing_service_gives_rows(spark):
    def broken(prompt):
        raise RuntimeError("down")

    row = resolver.resolve(spark.createDataFrame([(1, "p")], "k int, prompt string"), broken, 2, 0).first()
    assert row.answer is None and row.error == "down"


def test_cache(spark):
    rows = spark.createDataFrame([(i, f"k{i % 3}", 1000 + i) for i in range(9)], "entry long, key string, t long").withColumn("created_at", F.timestamp_seconds("t")).withColumn("accessed_at", F.col("created_at")).withColumn("size_bytes", F.lit(2).cast("long"))
    now = F.timestamp_seconds(F.lit(1008))
    assert cache.fresh(rows, now, 3).count() == 4
    assert {r.key: r.entry for r in cache.latest(rows).collect()} == {"k0": 6, "k1": 7, "k2": 8}
    assert sorted(r.entry for r in cache.evict(rows, 2).collect()) == [7, 8]
    assert sorted(r.entry for r in cache.evict_share(rows).collect()) == list(range(2, 9))
    assert tuple(cache.statistics(rows, now, 3).first()) == (9, 18, 4)
    assert cache.content_hash(rows) == cache.content_hash(rows.repartition(5)) != cache.content_hash(rows.limit(8))


def test_materialized_by_content(spark, tmp_path):
    base = spark.range(3)
    first = cache.materialized(base, base.withColumn("x", F.rand()), str(tmp_path), "t")
    again = cache.materialized(base.repartition(2), base.withColumn("x", F.rand()), str(tmp_path), "t")
    assert sorted(first.collect()) == sorted(again.collect())


def test_monitor(spark):
    rows = spark.createDataFrame([("CPU usage", 81.0, 1), ("CPU usage", 80.0, 2), ("other", 999.0, 3)], "name string, value double, ts int")
    assert [r.ts for r in monitor.alerts(rows).collect()] == [1]
    assert {r.ts: r.avg for r in monitor.rolling(rows, 2).collect()} == {1: 81.0, 2: 80.5, 3: 999.0}
    assert monitor.benchmark(rows.where("name = 'other'"), "name", "value").first().deviation == 0


def test_pipelines_keep_every_input(spark):
    schema = "ord long, id string, name string, path string"
    refs = spark.createDataFrame([(0, "1", "Tools", "1"), (1, "2", "Hand saw", "1>2"), (2, "3", "Drill", "1>3"), (3, "4", "Garden", "4"), (4, "5", "Drill", "4>5")], schema)
    inputs = spark.createDataFrame([(0, "a", "Tools", "a"), (1, "b", "Drill", "a>b"), (2, "c", "Saws hand", "a>c"), (3, "d", "zzqq", "d"), (4, "e", "zzqq", "e")], schema)
    got = {r.input_id: (r.match_id, r.match_method) for r in pipelines.hierarchical(inputs, refs).collect()}
    assert set(got) == {"b", "c", "d", "e"} and got["b"] == ("3", "exact") and got["c"] == ("2", "ai")
    flat = {r.ord: r.match_id for r in pipelines.flat(inputs, refs).collect()}
    assert set(flat) == {0, 1, 2, 3, 4} and flat[0] == "1" and flat[1] == "3" and flat[3] is None
    auto = pipelines.automatic(inputs, refs).collect()
    assert len(auto) == 5 and {r.ord: r.processing_method for r in auto}[1] == "auto"
    answer = lambda prompt: 'Well: {"matches": [{"index": 1, "matched_id": "3", "confidence": 0.9}]}'
    asked = {r.input_id: (r.match_id, r.confidence) for r in pipelines.hierarchical(inputs, refs, answer=answer).collect()}
    assert ("3", 0.9) in asked.values() and set(asked) == {"b", "c", "d", "e"}


def test_best_path_may_be_late_in_its_branch(spark):
    schema = "ord long, id string, name string, path string"
    rows = [(0, "r", "Tools", "r")] + [(i, f"l{i}", f"leaf{i} tools", f"r>l{i}") for i in range(1, 70)] + [(70, "best", "blue hammer", "r>best")]
    inputs = spark.createDataFrame([(0, "a", "Tools", "a"), (1, "b", "hammer blue", "a>b")], schema)
    got = {r.input_id: r.match_id for r in pipelines.hierarchical(inputs, spark.createDataFrame(rows, schema)).collect()}
    assert got == {"b": "best"}


def test_hierarchical_plan_stays_small(spark):
    """The driver holds every subplan; before tables were written in between there were thousands of nodes."""
    schema = "ord long, id string, name string, path string"
    refs = spark.createDataFrame([(0, "1", "Tools", "1"), (1, "2", "Hand saw", "1>2"), (2, "3", "Drill", "1>3")], schema)
    inputs = spark.createDataFrame([(0, "a", "Tools", "a"), (1, "b", "Drill", "a>b"), (2, "c", "Saws hand", "a>c")], schema)
    nodes = lambda df: df._jdf.queryExecution().analyzed().treeString().count("\n")
    assert nodes(pipelines.hierarchical(inputs, refs)) < 300
    assert nodes(pipelines.hierarchical(inputs, refs, answer=lambda prompt: "{}")) < 500


def test_best_in_branch_by_classes_of_paths(spark):
    """Repeated paths, empty paths, repeated ids: as by comparing each input with each node of its branch."""
    nodes = [(i, f"n{i}", f"p{i % 3}", f"r{i % 2}>n{i}", [f"r{i % 2}", f"n{i}"], i % 4 == 0, ["Red Bolts", "red  nut", "", "bolts > red"][i // 2 % 4]) for i in range(24)]
    tree_rows = spark.createDataFrame(nodes, "ord long, id string, name string, path string, path_ids array<string>, is_leaf boolean, full_path string")
    given = [("a", "r0", "red bolts"), ("a", "r0", "red bolts"), ("b", "r1", "nut"), ("c", "r0", ""), ("d", "r1", "zzz"), ("e", "general", "red"), ("f", "r1", "RED bolts")]
    got = pipelines.best_in_branch(spark.createDataFrame(given, "key string, root_id string, full_path string"), tree_rows).collect()
    expected = {}
    for key, root, path in given:
        a = set(path.lower().split())
        scored = [(-len(a & b) / len(a | b), not leaf, o, i) for o, i, _, _, ids, leaf, full in nodes if ids[0] == root and a & (b := set(full.lower().split()))]
        if scored:
            expected[key] = (min(scored)[3], -min(scored)[0])
    assert {r.key: (r.match_id, r.confidence) for r in got} == expected and len(got) == len(expected) == 3


def test_flat_fills_up_with_vector_hits(spark):
    from dataclasses import replace

    from taxoweave.config import DEFAULT

    schema = "ord long, id string, name string, path string"
    refs = spark.createDataFrame([(0, "1", "zq x7", "1"), (1, "2", "garden chairs", "2"), (2, "3", "drills", "3")], schema)
    inputs = spark.createDataFrame([(0, "a", "x7 motorbikes and bearings", "a"), (1, "b", "wwww", "b")], schema)
    got = {r.ord: (r.match_id, r.confidence) for r in pipelines.flat(inputs, refs).collect()}
    # of the reference's three terms, all as rare, the input has one
    assert got[0] == ("1", pytest.approx(3**-0.5)) and got[1][0] is None
    none = {r.ord: r.match_id for r in pipelines.flat(inputs, refs, replace(DEFAULT, backfill_top=0)).collect()}
    assert none == {0: None, 1: None}
    auto = {r.ord: r.match_id for r in pipelines.automatic(inputs, refs).collect()}
    assert auto[0] == "1"


def test_streams(spark, tmp_path):
    from taxoweave.streaming import extension

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"ord": 0, "id": "x", "name": "Drill", "ts": "2024-01-01T00:00:00"}\n{"ord": 1, "id": "x", "name": "saw", "ts": "2024-01-01T00:00:01"}\n')
    refs = spark.createDataFrame([(0, "1", "drill")], "ord long, id string, name string")
    stream = spark.readStream.schema("ord long, id string, name string, ts timestamp").json(str(tmp_path / "in"))
    q = extension.match_stream(extension.first_within(stream), refs).writeStream.format("memory").queryName("matched").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.id, r.match_id) for r in spark.sql("select * from matched").collect()] == [("x", "1")]
    metrics = spark.createDataFrame([("m", 1.0, 5), ("m", 3.0, 59), ("m", 9.0, 60)], "name string, value double, t long").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted(r.avg for r in extension.metric_windows(metrics).collect()) == [2.0, 9.0]
