"""Columns of any name pass through, and the chunked sketch keeps what it promises."""

from types import SimpleNamespace

import numpy as np

from taxoweave.llm import chunks, jaccard, mixing, packing, quality, sketch, substring, vectors

NAMES = ("n_words", "n_removed", "kept_text", "kept_sha256", "__text", "__id", "__source", "__copies", "__copy", "mark", "id", "row", "rate", "key")


def _docs(spark):
    long = " ".join(f"w{i}" for i in range(70))
    rows = [(1, long, "a"), (2, long + " x", "a"), (3, "short one", None), (4, None, "b"), (None, long, "b"), (5, "", "b"), (5, "other words under one id here", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return docs.selectExpr("*", "length(text) AS n_chars", *[f"concat('own ', coalesce(doc_id, 0)) AS `{n}`" for n in NAMES])


def test_stages_pass_columns_of_any_name(spark):
    docs = _docs(spark)
    for out in (jaccard.one_of_each(docs), substring.deduped_rows(docs), mixing.mixed_rows(docs)):
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"own {r.doc_id or 0}" for r in rows for n in NAMES)


def test_carried_columns_are_renamed_and_not_lost(spark):
    out = substring.dedup_substrings(_docs(spark), carry=("n_words", "mark")).where("doc_id = 2").first()
    assert (out["_n_words"], out["mark"], out["n_words"], out["n_removed"]) == ("own 2", "own 2", 71, 70)


def test_accepted_passes_columns(spark):
    docs = _docs(spark)
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert quality.accepted(docs, labels).columns == docs.columns


def test_long_text_scores_as_a_whole():
    text = " ".join(f"word{i % 997} thing{i % 31}" for i in range(120_000))
    rng = np.random.default_rng(0)
    model = quality.Scorer(rng.normal(size=1 << quality.BUCKETS_BITS).astype(np.float32), 0.1)
    _, bucket = quality.features([text])
    whole = 1 / (1 + np.exp(-(model.lean[bucket].astype(float).mean() + model.bias)))
    assert len(text) > 4 * quality.SLICE
    assert abs(quality.scores([text], model)[0] - whole) < 1e-6


def test_sketch_never_estimates_too_low():
    rng = np.random.default_rng(1)
    rows, bits = [], 18
    for c in range(4):
        h = rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
        h[:500] = np.arange(500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)  # in every chunk
        rows.append((c, h, np.sort(rng.integers(0, 40, 4000)).astype(np.int32)))
    made = {c: sketch.Cells(h, d, bits) for c, h, d in rows}
    held = {}
    for c, cells in made.items():
        for row, (cell, n, _) in enumerate(cells.rows):
            for x, k in zip(cell.tolist(), n.tolist(), strict=True):
                held[row, x] = held.get((row, x), 0) + k
    total = {}
    for cells in made.values():
        for h in cells.hashes.tolist():
            total[h] = total.get(h, 0) + 1
    for cells in made.values():
        estimate = np.min([[held[row, x] for x in cell[at].tolist()] for row, (cell, _, at) in enumerate(cells.rows)], axis=0)
        assert (estimate >= [total[h] for h in cells.hashes.tolist()]).all()


def test_windows_stay_inside_documents():
    row = SimpleNamespace(ids=np.arange(3).astype("<i8").tobytes(), marks=np.zeros(3, "<i8").tobytes(), sizes=np.array([3, 0, 4], "<i8").tobytes(), tokens=chunks.pack(np.array([0, 1, 0, 1, 1, 2, 0], "<u4")), words=np.array([7, 8, 9], ">u8").tobytes())
    at, doc = chunks.windows(chunks.opened(row), 3)
    assert at.tolist() == [0, 3, 4] and doc.tolist() == [0, 2, 2]
    assert chunks.opened(row).one.tolist() == [7, 8, 7, 8, 8, 9, 7]


def test_exact_scores_rank_as_whole_numbers(spark):
    rows = spark.createDataFrame([(i, [float(1 << 22), i / 256]) for i in range(12)], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in vectors.exact_top(rows, queries=lambda c: c == 1).orderBy("rank").collect()]
    assert got == [11, 10, 9, 8, 7]
    huge = spark.createDataFrame([(0, [1e20]), (1, [1e20]), (2, [1e308]), (3, [2.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r.score) for r in vectors.exact_top(huge, queries=lambda c: c == 3).orderBy("rank").collect()] == [(0, (1 << 63) - 1), (1, (1 << 63) - 1)]


def test_packing_equals_a_plain_packing(spark):
    """Each sequence is what best-two-fit, done document by document, would make of what was left."""
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 61, 400).tolist()
    most, left, want = 60, sorted(lengths), []
    while left:
        bin_, gap = [], most
        while any(x <= gap for x in left):
            x = max(x for x in left if x <= gap)
            left.remove(x), bin_.append(x)
            gap -= x
        while gap and len(bin_) > 1:
            small = min(bin_)
            pool = sorted([*left, small])
            pairs = [(pool[i] + pool[j], i, j) for i in range(len(pool)) for j in range(i) if pool[i] + pool[j] <= gap + small]
            if not pairs or max(pairs)[0] <= small:
                break
            total, i, j = max(pairs, key=lambda p: (p[0], -min(pool[p[1]], pool[p[2]])))
            a, b = pool[i], pool[j]
            bin_.remove(small), left.append(small)
            left.remove(a), left.remove(b), bin_.extend((a, b))
            gap += small - total
        want.append(sum(bin_))
    plan = packing.Plan(np.bincount(lengths, minlength=most + 1), most)
    assert sum(t for _, t in plan.patterns) <= len(want) + 1
    assert sum(x * n * t for used, t in plan.patterns for x, n in used.items()) == sum(lengths)
