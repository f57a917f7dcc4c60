import pytest
from pyspark.sql import functions as F

from taxoweave.llm import mixing, urlfilter
from taxoweave.llm.components import connected_components

DOCS = "doc_id long, text string, source string"


def expected_targets(sizes: dict) -> dict:
    """Water-filling step by step: share, cap, share the rest again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, total, full = {}, 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        rest = total - sum(2 * sizes[s] for s in full)
        target = {s: 2 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > 2 * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10, "d": 10}, {"a": 1, "b": 1000, "c": 5, None: 7}, {"z": 4}, {"a": 0, "b": 3}, {"a": 100, "b": 1, "c": 1, "d": 1, "e": 50}])
def test_targets_are_those_of_water_filling(spark, sizes):
    docs = spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(sizes.items())], DOCS)
    got = {r.source: r.target for r in mixing.source_targets(docs.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(mixing.WORD))).cast("long").alias("source_size"))).collect()}
    assert got == pytest.approx(expected_targets(sizes))


def test_mix(spark):
    rows = [(i, "one two\x0bthree " * (i % 4), f"s{i % 3}") for i in range(3000)] + [(None, None, None), (5, "", "s0"), (5, "", "s0")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("target", F.lit("clash"))
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [0, r.target])[0] += r.taken
    assert all(abs(a - t) <= 0.06 * t + 1 for a, t in by.values())
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, got))
    again = mixing.mixed_rows(docs)
    assert again.columns == docs.columns and again.count() == sum(r.copies for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_relative_links_are_edges(spark):
    at = "http://a.com/x/y/page.html?q=1"
    want = {"../de/7": "/x/de/7", "other.html": "/x/y/other.html", "?id=3": "/x/y/page.html?id=3", "./": "/x/y/", "../../../../z?a=/../b#f": "/z?a=/../b", "..": "/x/", "/r": "/r"}
    rows = [(i, at, f'<link rel="canonical" href="{to}">') for i, to in enumerate([*want, "#top", "mailto:a@b.c", "javascript:void(0)"])]
    rows += [(90, "http://b.com", '<meta http-equiv="refresh" content="0; url=p/q">'), (91, "no url", '<link rel=canonical href="p">'), (92, at, "<link rel=canonical>")]
    edges = {(r.u, r.v) for r in urlfilter.link_edges(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert edges == {("a.com/x/y/page.html?q=1", "a.com" + v) for v in want.values()} | {("b.com", "b.com/p/q")}
    rows = [(0, "http://q.net/en/1", '<link rel="canonical" href="../de/7">'), (1, "http://q.net/de/7", "")]
    got = {r.page_id: (r.verdict, r.alias) for r in urlfilter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), rules=(("net/de/", "block"),)).collect()}
    assert got == {0: ("block", True), 1: ("block", False)}


def page(i, url, html=""):
    return (i, url, html)


def test_rules_and_parts(spark):
    rows = [
        page(0, "HTTP://WWW.Example.COM/en/7?x#y"), page(1, "http://a.b.com/en/x"), page(2, "http://com/en/"), page(3, "http://telecom/en/"), page(4, "no url"), page(5, None, None),
        page(6, "x://example.net/de/80"), page(7, "x://foo.net/DE/1"), page(8, "x://h?/en/"), page(9, "a://b://com/en/"), page(9, "a://b://com/en/"), page(10, "x://É.org/es/"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.url_verdicts(pages).collect()}
    assert urlfilter.url_verdicts(pages).count() == len(rows)
    assert got[0] == ("www.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1][2:] == ("com/en/", "block") and got[2][2:] == ("com/en/", "block") and got[3][2:] == (None, "allow")
    assert got[4] == got[5] == ("", "", None, "allow")
    assert got[6][2:] == ("example.net/de/8", "block") and got[7][2:] == (None, "allow")
    assert got[8] == ("h", "", None, "allow") and got[9][0] == "b:" and got[10] == ("É.org", "/es/", "org/es/", "block")


def test_decisions_pass_over_links(spark):
    link = lambda u: f'<LINK href="{u}" REL=canonical>'
    meta = lambda u: f"<meta http-equiv='Refresh' content='0; URL={u}'>"
    rows = [
        page(0, "http://a.xx/1", link("http://b.xx/2")), page(1, "http://b.xx/2", meta("https://spam.com/en/1")), page(2, "http://c.xx/3#f", link("//example.com/en/70")), page(3, "http://d.xx/4", link("/5")),
        page(4, "http://d.xx/5", link("http://c.xx/3") + link("http://a.xx/1")), page(5, "http://e.xx/6", link("http://spam.org/es/")), page(6, "http://f.xx/7", '<link rel="stylesheet" href="http://x.com/en/">'),
    ]
    got = {r.page_id: (r.verdict, r.alias) for r in urlfilter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    # 0 to 4 are one page, which has an allowed name: allow goes first
    assert got == {0: ("allow", True), 1: ("allow", True), 2: ("allow", True), 3: ("allow", True), 4: ("allow", True), 5: ("block", True), 6: ("allow", False)}
    extra = spark.createDataFrame([("x://f.xx/7", "x://e.xx/6")], "u string, v string")
    got = {r.page_id: r.verdict for r in urlfilter.url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), redirects=extra).collect()}
    assert got[6] == "block"


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, j) for j in range(101, 130)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(21)} | {i: 100 for i in range(100, 130)} | {200: 200, 201: 200}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0
