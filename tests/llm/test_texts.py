import functools
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from taxoweave.llm import bpe, jaccard, katz, licenses, packing, quality, substring
from taxoweave.llm.words import split

RNG = random.Random(7)
WORDS = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


PASSAGE = prose(80)


@functools.cache
def corpus():
    base = prose(200)
    rows = [(i, prose(RNG.randint(1, 160)), "en", f"s{i % 3}") for i in range(40)]
    rows += [(40 + i, f"{prose(30)}\n{PASSAGE}\t{prose(20)}", "en", "s0") for i in range(12)]
    rows += [(60 + i, base if i % 2 else base.replace(WORDS[i], "zz", 1), "en", "s1") for i in range(10)]
    rows += [(80, None, None, None), (81, "", "en", "s0"), (82, " \n\t ", "en", "s0"), (None, PASSAGE, "en", "s0"), (83, "word " * 3000, "en", "s2"), (41, PASSAGE, "en", "s0"), (41, PASSAGE, "en", "s0"), (84, "A\x1cb\u00a0c É 'S", "fr", "s2")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns whose names the operators use themselves
    return spark.createDataFrame(corpus(), "doc_id long, text string, lang string, source string").withColumn("n_words", F.lit("x")).withColumn("score", F.lit("y"))


def windows(words, k=50):
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


def test_substrings_by_brute_force(docs):
    rows = corpus()
    first = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            for w in windows(split(text)):
                first[w] = min(first.get(w, doc_id), doc_id)
    want = []
    for doc_id, text, *_ in rows:
        words, gone = split(text), set()
        for i, w in enumerate(windows(words)):
            if doc_id is not None and first[w] < doc_id:
                gone |= set(range(i, i + 50))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        want.append((str(doc_id), len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    got = substring.dedup_substrings(docs).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted(want)
    assert sum(r.n_removed > 0 for r in got) > 15
    assert all(r.kept_text == t for r, t in [(r, None) for r in got if r.doc_id == 80])
    assert substring.dedup_substrings(docs.limit(0)).count() == 0


def brute_components(rows):
    sets = []
    for doc_id, text, *_ in rows:
        w = [x.lower() for x in split(text)]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return [(str(r[0]), len(sets[i]), str(least.get(root(i)))) for i, r in enumerate(rows)]


def chains():
    """Near copies that change step by step, so that the first and the last aren't alike themselves."""
    rows, text, n = [], prose(120).split(), 200
    for step in range(40):
        text = list(text)
        text[step * 3 % 120] = f"step{step}"
        rows.append((n + (step * 17) % 40, " ".join(text), "en", "s"))
    return rows


def test_components_by_brute_force(spark, docs):
    got = jaccard.linked_components(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(brute_components(corpus()))
    rows = chains() + [(i, PASSAGE + " " + prose(12), "en", "s") for i in range(30)]
    got = jaccard.linked_components(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(brute_components(rows))
    assert jaccard.linked_components(docs.limit(0)).count() == 0


def brute_pairs(rows):
    """Every two different sets that are linked, by the smallest ids that have them."""
    least = {}
    for doc_id, text, *_ in rows:
        w = [x.lower() for x in split(text)]
        if doc_id is not None and w:
            s = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
            least[s] = min(least.get(s, doc_id), doc_id)
    ends = lambda a, b: sorted([(least[a], len(a)), (least[b], len(b))])
    pairs = [(*ends(a, b), len(a & b)) for i, a in enumerate(least) for b in list(least)[:i] if 100 * len(a & b) >= 80 * len(a | b)]
    return sorted((x[0], y[0], x[1], y[1], n) for x, y, n in pairs)


def test_all_pairs_by_brute_force(spark, docs, monkeypatch):
    # a group of different texts that are all linked with each other: k (k - 1) / 2 links, and not k - 1
    words = [f"w{i}" for i in range(200)]
    rows = [(1000 + i, " ".join(words[: 5 * i] + [f"new{i}"] + words[5 * i + 1 :]), "en", "s") for i in range(30)]
    schema = "doc_id long, text string, lang string, source string"
    want = brute_pairs(rows)
    assert len(want) == 30 * 29 // 2
    assert sorted(map(tuple, jaccard.linked_pairs(spark.createDataFrame(rows, schema)).collect())) == want
    monkeypatch.setattr(jaccard, "LEAVES", 4)  # several trees for a component
    rows += chains() + corpus()
    want = brute_pairs(rows)
    assert len(want) > 500
    assert sorted(map(tuple, jaccard.linked_pairs(spark.createDataFrame(rows, schema)).collect())) == want
    assert jaccard.linked_pairs(docs.limit(0)).count() == 0


def test_one_of_each(docs):
    left = jaccard.one_of_each(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert ids.count(41) <= 2 and ids.count(None) == 1 and not {61, 63, 65} & set(ids)


def test_one_of_each_judges_texts_of_one_id_apart(spark):
    a, b, clean = ([f"{x}{i}" for i in range(120)] for x in "abc")
    near = lambda words: " ".join(words[:-1] + ["new"])
    rows = [(1, " ".join(a)), (5, near(a)), (5, " ".join(clean)), (9, " ".join(b)), (9, near(b)), (None, near(a))]
    left = [tuple(r) for r in jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(r[0] for r in left if r[0]) == [1, 5, 9] and len(left) == 4
    assert (5, " ".join(clean)) in left and (1, " ".join(a)) in left


def test_tree_walks_find_what_brute_force_does():
    rng = random.Random(1)
    for _ in range(40):
        base = [sorted(rng.sample(range(1, 4000), rng.randint(5, 60))) for _ in range(4)]
        sets = []
        for _ in range(40):
            s = set(rng.choice(base))
            for _ in range(rng.randint(0, 8)):
                s ^= {rng.randint(1, 4000)}
            sets.append(sorted(s) or [1])
        tree = jaccard.PrefixTree([(np.array(s, ">u8").tobytes(), i) for i, s in enumerate(sets)])
        some = sorted(rng.sample(range(40), 15))
        for q in sets[:10]:
            want = {i for i, s in enumerate(sets) if 100 * len(set(s) & set(q)) >= 80 * len(set(s) | set(q))}
            assert {tree.names[i] for i, _ in tree.similar(np.array(q, np.uint64))} == want
            assert {tree.names[i] for i, _ in tree.similar(np.array(q, np.uint64), some)} == want & {tree.names[i] for i in some}


def test_word_ids_are_those_of_the_library():
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    library, known = Tokenizer.from_file(path), bpe.WordIds(path)
    letters = "abcdeéßñüÀÉΣσςİıЖж日本'.,!?-_0123 ²½<|>endoftxsrvmlÍ\u0301\u200d\x1c "
    rng = random.Random(3)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(1500)] + ["the" * 20, "a" * 50, "!" * 40, "<|endoftext|>", "it's don't 's 't hello... world!!! (x)", "", prose(50)]
    lists = [split(t) for t in texts]
    known.learn(set().union(*lists))
    for text, words in zip(texts, lists, strict=True):
        assert np.frombuffer(known.of(words), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(packing.tokenizer_path())
    most = 300
    got = packing.pack(docs, most=most, ids=True).collect()
    sequences, texts = {}, {}
    for r in got:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        texts.setdefault(str(r.doc_id), []).append((r.piece, r.start, ids.tolist()))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= most
    for doc_id, text, *_ in corpus():
        want = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert [p[2] for p in sorted(texts[str(doc_id)])[: 1 if doc_id == 41 else None]][0] == want[:most] or doc_id == 41
        if doc_id != 41:
            assert sum((p[2] for p in sorted(texts[str(doc_id)])), []) == want
    total = sum(r.length for r in got)
    assert len(sequences) <= 1.1 * total / most + 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_plan_replaces_the_smallest_by_two():
    # 60 leaves a gap of 40; 30 fits best, but 20 + 19 in its place fit more tightly
    counts = np.zeros(101, int)
    for x in (60, 30, 20, 19):
        counts[x] += 1
    plan = packing.Plan(counts, 100)
    assert plan.patterns[0][0] == {60: 1, 20: 1, 19: 1}
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(1, 101, 20_000), minlength=101)
    plan = packing.Plan(counts, 100)
    assert sum(t for _, t in plan.patterns) <= 1.005 * -(-(counts * np.arange(101)).sum() // 100) + 1
    left = counts.copy()
    for used, times in plan.patterns:
        for x, n in used.items():
            left[x] -= n * times
    assert (left[1:] == 0).all()


def test_quality(spark):
    good = [(i, prose(RNG.randint(20, 80)), 1) for i in range(150)]
    bad = [(200 + i, " ".join(w + RNG.choice(["***", "$$$"]) for w in prose(40).split()), 0) for i in range(80)]
    rows = [(i, t) for i, t, _ in good + bad] + [(900, None), (901, ""), (None, "x"), (5, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1))
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (5, 0), (901, None), (900, 7)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(rows)
    quality_of = {i: q for i, _, q in good + bad}
    held = [r for r in got if r.held_out and r.doc_id in quality_of and r.doc_id != 5]
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert len(held) > 30 and np.mean([r.predicted == quality_of[r.doc_id] for r in held]) > 0.95
    assert {r.score for r in got if r.doc_id in (900, 901)} == {next(r.score for r in got if r.doc_id == 901)}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert quality.accepted(docs, labels).columns == docs.columns
    assert {r.score for r in quality.classify(docs.limit(3), labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def katz_by_hand(rows):
    """The same model in dictionaries."""
    import math
    from collections import Counter, defaultdict

    tokens = [[w.lower() for w in split(t)] + [None] for _, t, *_ in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows]
    uni, pairs = Counter(), defaultdict(Counter)
    for t, h in zip(tokens, held, strict=True):
        if not h:
            uni.update(t)
            for a, b in zip([b" start "] + t, t):
                pairs[a][b] += 1
    n = sum(uni.values())
    seen = Counter(uni.values())
    model = katz.word_model([seen[c] for c in range(1, 7)], len(uni), n)
    p1 = lambda w: float(model.prob(np.array([uni[w]]))[0])
    seen = Counter(c for v in pairs.values() for c in v.values())
    keep = katz.discounts([seen[c] for c in range(1, 7)])
    cache = {}

    def context(v):
        if v not in cache:
            total = sum(pairs[v].values())
            kept = {w: (keep[c] if c <= 5 else 1) * c / total for w, c in pairs[v].items()}
            left = max(1 - sum(kept.values()), 1 / (total + 1))
            scale = (1 - left) / sum(kept.values())
            cache[v] = ({w: x * scale for w, x in kept.items()}, left / (1 - sum(p1(w) for w in kept)))
        return cache[v]

    out = []
    for (i, *_), t, h in zip(rows, tokens, held, strict=True):
        score = 0.0
        for a, b in zip([b" start "] + t, t):
            if a in pairs:
                own, weight = context(a)
                score += math.log10(own[b] if b in own else weight * p1(b))
            else:
                score += math.log10(p1(b))
        base = sum(math.log10((uni[w] + 0.1) / (n + 0.1 * (len(uni) + 1))) for w in t)
        out.append((str(i), h, len(t), sum(uni[w] > 0 for w in t), n, round(base, 6), round(score, 6)))
    sums = [sum(context(v)[0].values()) + context(v)[1] * (sum(p1(w) for w in uni if w not in context(v)[0]) + model.unknown) for v in list(pairs)[:50]]
    return out, sums


def test_katz_by_brute_force(spark, docs):
    rows = corpus() + [(300 + i, " ".join(["unseen%d" % i, "words", "here", RNG.choice(WORDS)]), "en", "s") for i in range(40)]
    want, sums = katz_by_hand(rows)
    assert sums == pytest.approx([1] * len(sums))  # over the learnt words and the unknown one
    got = katz.score_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n", F.lit(1))).collect()
    mine = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    for a, b in zip(mine, sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-4)
    assert katz.score_texts(docs.limit(0)).count() == 0
    only = katz.score_texts(spark.createDataFrame([(None, None)], "doc_id long, text string")).first()
    assert only.n_tokens == 1 and only.score <= 0


#: Counts of counts of the given documents' words and pairs, learnt ones only (sf0.001, sf0.01, sf0.1).
SEEN = [
    [16971, 3831, 1233, 563, 507, 210], [51654, 14844, 5474, 2713, 2570, 1129], [215810, 61309, 26017, 14862, 13741, 7222],
    [45803, 5857, 1222, 308, 371, 88], [206781, 32217, 5097, 1904, 2579, 670], [1655711, 262472, 56325, 23262, 20048, 8151],
]


def test_good_turing_discounts_hold():
    import math

    # n(c) = a / c^2: r* / r is c / (c + 1), of which Katz takes the common 1 / 6
    assert katz.discounts([3_600_000 // c**2 for c in range(1, 7)])[1:] == pytest.approx([0.4, 0.6, 0.7, 0.76, 0.8])
    for seen in SEEN:
        # the line by its normal equations
        x, y = [math.log(c) for c in range(1, 7)], [math.log(n) for n in seen]
        mx, my = sum(x) / 6, sum(y) / 6
        slope = sum((a - mx) * (b - my) for a, b in zip(x, y)) / sum((a - mx) ** 2 for a in x)
        ratio = [((c + 1) / c) ** (slope + 1) for c in range(1, 6)]
        common = 6 ** (slope + 1)
        got = katz.discounts(seen)
        assert got[1:] == pytest.approx([(r - common) / (1 - common) for r in ratio])
        assert got[0] == 1 and (np.diff(got[1:]) > 0).all() and 0 < got[1] and got[5] < 1
    # a gap: 5 stands for the width from 3 to 7
    assert katz.smoothed([100, 30, 10, 0, 4, 0])[0] == pytest.approx(math.exp(np.polyval(np.polyfit(np.log([1, 2, 3, 5]), np.log([100, 30, 20 / 3, 2]), 1), 0)))
    # nothing to fit
    assert katz.discounts([10, 0, 0, 0, 0, 0])[1:] == pytest.approx([1 - 0.9 / c for c in range(1, 6)])
    assert (katz.discounts([0] * 6) == 1).all()


def test_licenses(spark):
    mit, apache = licenses.TEMPLATES[14][1], licenses.TEMPLATES[13][1]
    rows = [(0, f"{prose(30)}\nReleased under the MIT License.\n{prose(10)}"), (1, prose(200)), (2, None), (3, ""), (4, f"{prose(77)} {mit} {prose(50)} {apache}"), (None, "licensed under cc BY-NC 4.0"), (5, mit.replace("copy", "clone", 1))]
    rows += [(6, " ".join(mit.split()[:40])), (7, ("Licensed under the Apache License, Version 2.0. " + prose(20) + " ") * 2), (7, "x")]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit(0))).collect()
    found = sorted((str(r.doc_id), r.license) for r in got)
    assert found == [("0", "MIT"), ("4", "Apache-2.0"), ("4", "MIT"), ("5", "MIT"), ("7", "Apache-2.0"), ("7", "Apache-2.0"), ("None", "CC-BY-NC-4.0")]
    at = {(str(r.doc_id), r.license): r for r in got}
    assert (at["0", "MIT"].start, at["0", "MIT"].end) == (30, 35) and at["5", "MIT"].containment < 1
    assert (at["4", "MIT"].start, at["4", "MIT"].end) == (77, 77 + len(mit.split()))
