"""Exact top-k by a pivot-distance index, and approximate nearest neighbours by a hash-prefix forest."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .inputs import spread
from .scratch import drop, keep

TOP = 5
EVERY = 50
#: Vectors that meet a query in one step, and queries that are answered together.
BLOCK, TOGETHER = 4096, 256
#: Bounds of the pivot index, whatever the number of vectors; the pivots come from a sample of bounded size.
PIVOTS, RINGS, SAMPLE = 64, 16, 4096
#: Trees of the forest, bits of a hash string, vectors in a shard, and the share of a shard at which the ascent ends.
TREES, BITS, SHARD, SHARE = 64, 32, 16384, 0.8


def usable(rows: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, v): rows with an id and a vector of finite components; of rows with one id, the least vector."""
    good = rows.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    if good.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        good = good.groupBy("id").agg(F.min("v").alias("v"))
    return good


def matrix(vectors: Iterable, width: int) -> np.ndarray:
    """Rows of one width; shorter vectors are continued with zeros."""
    rows = list(vectors)
    if all(len(x) == width for x in rows):
        return np.array(rows, np.float64).reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for i, x in enumerate(rows):
        out[i, : len(x)] = x
    return out


def unpack(column: pd.Series, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), width)


def best(scores: np.ndarray, ids: np.ndarray, top: int, exact: np.ndarray | None = None) -> np.ndarray:
    """Columns of the ``top`` highest scores of a row, ties to smaller ids; scores of -inf are none.

    exact: whole numbers of which the scores are the doubles next to them; they decide then."""
    if len(scores) > 8 * top:
        floor = np.partition(scores, len(scores) - top)[len(scores) - top]
        at = np.flatnonzero(scores >= floor)
    else:
        at = np.arange(len(scores))
    at = at[scores[at] > -np.inf]
    if exact is not None:
        return np.array(sorted(at.tolist(), key=lambda j: (-exact[j], ids[j]))[:top], np.int64)
    return at[np.lexsort((ids[at], -scores[at]))][:top]


def ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def meet(index: DataFrame, queries: DataFrame, keys: list[str], run: Callable, schema: str) -> DataFrame:
    """Queries with the vectors of their block: index rows (kind 0) come first, queries stream past them."""
    rows = index.withColumn("kind", F.lit(0)).unionByName(queries.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return rows.repartition(*keys).sortWithinPartitions(*keys, "kind").mapInPandas(run, schema)


def _stream(batches: Iterable[pd.DataFrame], keys: list[str], build: Callable, search: Callable) -> Iterator[pd.DataFrame]:
    """build(index rows of a block) once per block, then search(built, some of its queries)."""
    at, parts, built = None, [], None
    for pdf in batches:
        key = pdf[keys].to_numpy()
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1) | (np.diff(pdf["kind"].to_numpy()) != 0)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(pdf)]) if len(pdf) else []:
            if tuple(key[a]) != at:
                at, parts, built = tuple(key[a]), [], None
            part = pdf.iloc[a:b]
            if part["kind"].iloc[0] == 0:
                parts.append(part)
                continue
            if not parts and built is None:
                continue
            if built is None:
                built, parts = build(pd.concat(parts)), []
            for c in range(0, len(part), TOGETHER):
                yield search(built, part.iloc[c : c + TOGETHER])


# ---- exact top-k by inner product ----------------------------------------------------------


def _whole(batches: Iterable[pd.DataFrame], scale: int, width: int, kind: str, pivots) -> Iterator[pd.DataFrame]:
    p = pivots.value
    for pdf in batches:
        x = np.floor(scale * matrix(pdf["v"], width))
        with np.errstate(over="ignore", invalid="ignore"):
            far = np.nan_to_num(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0), nan=np.inf)
        near = far.argmin(1) if len(x) else np.zeros(0, int)
        dist = np.sqrt(((x - p[near]) ** 2).sum(1))
        yield pd.DataFrame({"id": pdf["id"], "pivot": near.astype(np.int32), "dist": dist, "norm": (x * x).sum(1), "v": [r.tobytes() for r in x.astype(kind)]})


def _bounds(q: np.ndarray, pivots: np.ndarray, cells: pd.DataFrame) -> np.ndarray:
    """The highest inner product that a vector of each cell can have with each query.

    2 q.x = |q|^2 + |x|^2 - d(q, x)^2, and d(q, x) is at least what the triangle inequality leaves of
    d(q, pivot) and the cell's least and greatest distance from its pivot."""
    p = pivots[cells["pivot"].to_numpy()]
    to = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * q @ p.T, 0))
    lo, hi, norm = (cells[c].to_numpy() for c in ("lo", "hi", "norm"))
    least = np.maximum(np.maximum(to - hi, lo - to) - 1e-6 * (1 + to + hi), 0)
    by_distance = ((q * q).sum(1)[:, None] + norm - least**2) / 2
    by_pivot = q @ p.T + np.sqrt((q * q).sum(1))[:, None] * hi
    # what is too large for doubles rules nothing out
    return np.nan_to_num(np.minimum(by_distance, by_pivot) * (1 + 1e-9) + 1e-6 * np.abs(by_pivot) + 1, nan=np.inf, posinf=np.inf)


def _route(batches: Iterable[pd.DataFrame], width: int, kind: str, shared, top: int, first: bool) -> Iterator[pd.DataFrame]:
    """Which cells a query goes to: at first those with the best bounds until they hold enough
    vectors, then all others whose bound reaches the score that the query has by then."""
    pivots, cells = shared.value
    n = cells["n"].to_numpy()
    for pdf in batches:
        for a in range(0, len(pdf), 1024):
            part = pdf.iloc[a : a + 1024]
            q = unpack(part["v"], kind, width).astype(np.float64)
            bound = _bounds(q, pivots, cells)
            order = np.argsort(-bound, axis=1, kind="stable")
            held = np.cumsum(n[order], axis=1) - n[order]
            start = held <= top  # one of the vectors may be the query's own
            if first:
                pick = start
            else:
                pick = ~start & (np.take_along_axis(bound, order, 1) >= part["floor"].fillna(-np.inf).to_numpy()[:, None])
            row, col = np.nonzero(pick)
            cell = order[row, col]
            out = part.iloc[row][["id", "v"]].assign(cell=cell.astype(np.int32), floor=-np.inf if first else part["floor"].fillna(-np.inf).to_numpy()[row])
            parts = cells["parts"].to_numpy()[cell]
            many = np.repeat(np.arange(len(out)), parts)
            yield out.iloc[many].assign(part=(np.arange(len(many)) - np.repeat(np.cumsum(parts) - parts, parts)).astype(np.int32))


def _products(batches: Iterable[pd.DataFrame], width: int, kind: str, top: int) -> Iterator[pd.DataFrame]:
    def build(rows):
        x = unpack(rows["v"], kind, width)
        return rows["id"].to_numpy(), x.astype(np.float64), np.abs(x.astype(np.float64)).max(initial=0)

    def search(built, rows):
        ids, x, most = built
        q = unpack(rows["v"], kind, width)
        if width * most * np.abs(q.astype(np.float64)).max(initial=0) < 2**53:
            s = q.astype(np.float64) @ x.T  # whole numbers below 2**53 are exact
            exact = None
        else:
            whole = np.vectorize(int, otypes=[object])
            exact = whole(q) @ whole(x).T
            s = np.vectorize(lambda v: float(v) if abs(v) < 1 << 1023 else math.copysign(1.7e308, v), otypes=[float])(exact)
        s[rows["id"].to_numpy()[:, None] == ids[None]] = -np.inf
        out = []
        for i, (query, floor) in enumerate(zip(rows["id"], rows["floor"], strict=True)):
            at = best(np.where(s[i] >= floor, s[i], -np.inf), ids, top, None if exact is None else exact[i])
            score = [max(-(1 << 63), min((1 << 63) - 1, int(v))) for v in (s[i][at] if exact is None else exact[i][at])]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[at], "score": score}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []})

    return _stream(batches, ["cell", "part"], build, search)


def exact_top(rows: DataFrame, queries: Callable[[Column], Column] = lambda c: c % EVERY == 0, top: int = TOP, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: each query's highest inner products of floor(scale * x).

    Queries are the rows whose id fulfils ``queries``; candidates are all rows with another id.
    Fewer than ``top`` candidates give fewer rows; ties go to the smaller vec_id. Vectors that are
    null or hold null or non-finite components, and rows without an id, take no part; shorter
    vectors are continued with zeros; rows that repeat an id count once, with the least vector.

    The index keys each vector by its nearest pivot and its distance from it; the distances of a
    pivot are cut into rings at their quantiles. A query takes rings in order of the bound that the
    triangle inequality gives, at first until they hold enough vectors, and then only rings whose
    bound reaches its k-th score so far: all others can't hold a result. Rings with many vectors
    are split into blocks. Pivots and rings are bounded in number, so their table is too.

    Scores are whole numbers and ranked as such; one beyond 64 bits counts as the nearest number
    within. Components so large that ``scale`` times them is no finite double are like
    non-finite ones.
    """
    spark = rows.sparkSession
    good = usable(rows).where(F.forall("v", lambda x: F.abs(x * scale) < float("inf")))
    about = good.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width"), F.max(F.array_max(F.transform("v", F.abs))).alias("most")).first()
    if not about.n or not about.width:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long") if not about.n else _flat(good, queries, top)
    cells_wanted = max(1, min(PIVOTS * RINGS, about.n // (BLOCK // 2)))
    n_pivots = max(1, min(PIVOTS, math.isqrt(cells_wanted) * 2, cells_wanted))
    n_rings = max(1, cells_wanted // n_pivots)
    top_value = scale * about.most + 1
    kind = "<i2" if top_value < 2**15 else "<i4" if top_value < 2**31 else "<f8"  # whole doubles
    sample = np.floor(scale * matrix([r.v for r in good.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()], about.width))
    chosen = [0]
    with np.errstate(over="ignore", invalid="ignore"):
        far = np.nan_to_num(((sample - sample[0]) ** 2).sum(1))
        while len(chosen) < min(n_pivots, len(sample)) and far.max() > 0:
            chosen.append(int(far.argmax()))  # the farthest from all pivots so far
            far = np.minimum(far, np.nan_to_num(((sample - sample[chosen[-1]]) ** 2).sum(1)))
    pivots = sample[chosen]
    keyed = keep(spread(good).mapInPandas(partial(_whole, scale=scale, width=about.width, kind=kind, pivots=spark.sparkContext.broadcast(pivots)), "id long, pivot int, dist double, norm double, v binary"), "keyed")
    cuts = keyed.groupBy("pivot").agg(F.percentile_approx("dist", [i / n_rings for i in range(1, n_rings)] or [0.5], 1000).alias("cuts"))
    ring = F.size(F.filter("cuts", lambda c: c < F.col("dist"))) if n_rings > 1 else F.lit(0)
    placed = keyed.join(F.broadcast(cuts), "pivot").withColumn("ring", ring)  # one row for each pivot
    cells = placed.groupBy("pivot", "ring").agg(F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.max("norm").alias("norm"), F.count("*").alias("n")).toPandas()
    cells = cells.sort_values(["pivot", "ring"], ignore_index=True)
    cells["parts"] = -(-cells["n"] // BLOCK)
    table = spark.createDataFrame(cells[["pivot", "ring", "parts"]].assign(cell=np.arange(len(cells), dtype=np.int32)), "pivot int, ring int, parts long, cell int")
    index = placed.join(F.broadcast(table), ["pivot", "ring"]).select("id", "v", "cell", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    shared = spark.sparkContext.broadcast((pivots, cells))
    asked = keyed.where(queries(F.col("id"))).select("id", "v", F.lit(None).cast("double").alias("floor"))
    route = lambda df, first: df.mapInPandas(partial(_route, width=about.width, kind=kind, shared=shared, top=top, first=first), "id long, v binary, cell int, floor double, part int")
    run = partial(_products, width=about.width, kind=kind, top=top)
    schema = "query_id long, vec_id long, score long"
    early = keep(ranked(meet(index, route(asked, True), ["cell", "part"], run, schema), top), "early")
    reached = early.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).select(F.col("query_id").alias("id"), F.when(F.col("n") >= top, F.col("floor").cast("double")).alias("floor"))
    again = asked.drop("floor").join(reached, "id", "left")
    late = meet(index, route(again, False), ["cell", "part"], run, schema)
    return ranked(early.select("query_id", "vec_id", "score").unionByName(late), top)


def _flat(good: DataFrame, queries, top: int) -> DataFrame:
    """All vectors are empty: every score is 0, so each query gets the smallest other ids."""
    least = good.orderBy("id").limit(top + 1).select(F.col("id").alias("vec_id"))
    asked = good.where(queries(F.col("id"))).select(F.col("id").alias("query_id"))
    return ranked(asked.join(F.broadcast(least), F.col("query_id") != F.col("vec_id")).withColumn("score", F.lit(0).cast("long")), top)


# ---- approximate neighbours by cosine ------------------------------------------------------


class Forest:
    """Trees over the vectors of one shard. A tree is the sorted array of the vectors' hash strings,
    each ``bits`` signs of products with random directions; a prefix is a range of the array."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, trees: int, bits: int, seed: int = 11):
        self.ids, self.x, self.bits = ids, x, bits
        self.unit = x / np.sqrt((x * x).sum(1))[:, None]
        self.directions = np.random.default_rng(seed).standard_normal((trees, bits, x.shape[1]))
        self.strings, self.order = [], []
        for t in range(trees):
            s = self._hash(self.unit, t)
            order = np.argsort(s, kind="stable")
            self.order.append(order)
            self.strings.append(s[order])

    def _hash(self, unit: np.ndarray, tree: int) -> np.ndarray:
        signs = (unit @ self.directions[tree].T > 0).astype(np.uint64)
        return signs @ (np.uint64(1) << np.arange(self.bits - 1, -1, -1, dtype=np.uint64))

    def _range(self, tree: int, strings: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        rest = np.uint64(self.bits - length)
        low = strings >> rest << rest
        return np.searchsorted(self.strings[tree], low), np.searchsorted(self.strings[tree], low + (np.uint64(1) << rest))

    def search(self, q: np.ndarray, own: np.ndarray, top: int, wanted: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and cosines of its best candidates.

        Down: in every tree to the longest prefix that any string shares with the query's. Up: one
        bit shorter in all trees at once, until their ranges hold ``wanted`` candidates together,
        and ``top`` different ones if there are so many.
        """
        unit = q / np.sqrt((q * q).sum(1))[:, None]
        strings = [self._hash(unit, t) for t in range(len(self.strings))]
        deepest = np.zeros(len(q), np.int64)
        for s, mine in zip(self.strings, strings, strict=True):
            at = np.searchsorted(s, mine)
            for near in (np.clip(at - 1, 0, len(s) - 1), np.clip(at, 0, len(s) - 1)):
                differ = s[near] ^ mine
                length = self.bits - np.ceil(np.log2(differ.astype(np.float64) + 1)).astype(np.int64)
                deepest = np.maximum(deepest, length)
        level, ranges = np.full(len(q), -1), {}
        for length in range(int(deepest.max(initial=0)), -1, -1):
            open_ = np.flatnonzero((level < 0) & (deepest >= length))
            if not len(open_):
                continue
            spans = [self._range(t, strings[t][open_], length) for t in range(len(self.strings))]
            enough = (sum(hi - lo for lo, hi in spans) >= wanted) | (length == 0)
            level[open_[enough]] = length
            for k in np.flatnonzero(enough):
                ranges[open_[k]] = [(lo[k], hi[k]) for lo, hi in spans]
        out = []
        for i in range(len(q)):
            mark, length = np.zeros(len(self.ids), bool), int(level[i])
            spans = ranges[i]
            while True:
                for order, (lo, hi) in zip(self.order, spans, strict=True):
                    mark[order[lo:hi]] = True
                at = np.flatnonzero(mark & (self.ids != own[i]))
                if len(at) >= top or length == 0:
                    break
                length -= 1  # the trees held the same few: further up
                spans = [tuple(int(e[0]) for e in self._range(t, strings[t][i : i + 1], length)) for t in range(len(self.strings))]
            # the measure on the original vectors
            cos = (self.x[at] @ q[i]) / (np.sqrt((self.x[at] ** 2).sum(1)) * np.sqrt(q[i] @ q[i]))
            pick = best(cos, self.ids[at], top)
            out.append((self.ids[at][pick], cos[pick]))
        return out


def _neighbours(batches: Iterable[pd.DataFrame], width: int, top: int, trees: int, bits: int, share: float) -> Iterator[pd.DataFrame]:
    def build(rows):
        return Forest(rows["id"].to_numpy(), unpack(rows["v"], "<f8", width), trees, bits)

    def search(forest, rows):
        found = forest.search(unpack(rows["v"], "<f8", width), rows["id"].to_numpy(), top, max(4 * top, math.ceil(share * len(forest.ids))))
        return pd.concat([pd.DataFrame({"query_id": query, "vec_id": ids, "score": cos}) for query, (ids, cos) in zip(rows["id"], found, strict=True)])

    return _stream(batches, ["shard"], build, search)


def _binary(batches: Iterable[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"id": pdf["id"], "v": [x.tobytes() for x in matrix(pdf["v"], width)]})


def nearest(rows: DataFrame, queries: Callable[[Column], Column] = lambda c: c % EVERY == 0, top: int = TOP, trees: int = TREES, bits: int = BITS, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest by cosine that a hash-prefix forest finds.

    Queries are the rows whose id fulfils ``queries``; candidates are all rows with another id.
    Every vector is indexed, in a shard dealt by a hash of its id; shards hold about SHARD vectors,
    and each query goes to each shard. ``share`` of a shard's vectors, counted over all trees,
    end the ascent; it sets the recall (README: measured). Scores are the cosine in double
    precision on the original vectors; ties go to the smaller vec_id. Vectors that are null, empty,
    zero or hold null or non-finite components take no part; shorter vectors are continued with
    zeros; rows that repeat an id count once, with the least vector.
    """
    good = usable(rows).where(F.exists("v", lambda x: x != 0))
    about = good.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    spark = rows.sparkSession
    if not about.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shards = max(1, -(-about.n // SHARD))
    packed = keep(spread(good).mapInPandas(partial(_binary, width=about.width), "id long, v binary"), "vectors")
    index = packed.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    asked = packed.where(queries(F.col("id"))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    run = partial(_neighbours, width=about.width, top=top, trees=trees, bits=bits, share=share)
    return ranked(meet(index, asked, ["shard"], run, "query_id long, vec_id long, score double"), top)


def op3_exact_topk(spark, sf_dir: str) -> DataFrame:
    return exact_top(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_hash_prefix_forest(spark, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE_3 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
