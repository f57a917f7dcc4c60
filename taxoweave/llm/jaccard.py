"""N-gram Jaccard join by prefix trees, and the groups of documents that its links make."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunk, chunked, windows
from .components import connected_components
from .inputs import repeats_ids, spread, unused
from .memory import frugal
from .scratch import drop, keep
from .sketch import Cells, answered
from .words import Rolling, mixed, split

WIDTH = 5
#: Shingles that the sketch estimates in this many documents come last in the global order.
HOT = 64
#: Shingles of the sets that one tree holds, and sets of a tree that gives every pair.
TREE, LEAVES = 250_000, 250
#: Documents of a family that are in one tree, and that are tried against it in one task.
MOST = 500
#: Pairs given out at once, and bytes of sets.
GIVEN, TOGETHER = 100_000, 4 << 20
#: Linked sets lie in the same or in neighbouring bands of lengths: a little over 1 / 0.8.
BAND = 1.26


def _shingles(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word n-grams of a chunk's documents, and the documents' places; a document with
    fewer words is one n-gram."""
    at, doc = windows(chunk, width)
    hashes, docs = [Rolling(width).of(chunk.one)[at] if len(at) else np.zeros(0, np.uint64)], [doc]
    for n in range(1, width):
        short = np.flatnonzero(chunk.sizes == n)
        if len(short):
            hashes.append(mixed(Rolling(n).of(chunk.one)[chunk.starts[short]] ^ np.uint64(n)))
            docs.append(short)
    return np.concatenate(hashes), np.concatenate(docs)


def _prefix(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The elements, and their places, of which linked sets share one: of the first n - 0.8 n + 1
    those that the sketch didn't prove to be in one document only."""
    n = len(keys)
    first = keys[: n - -(-4 * n // 5) + 1] if n else keys
    pos = np.flatnonzero(first >> np.uint64(62))
    return first[pos], pos


def _sets(chunk: Chunk, cells: Cells, replies: list) -> Iterator[pd.DataFrame]:
    """Of each document its set in the global order: shingles of one document, then of several, then of
    many; then by hash."""
    repeated, hot = cells.flags(replies)
    keys = (repeated.astype(np.uint64) + (repeated & hot)) << np.uint64(62) | cells.hashes >> np.uint64(2)
    order = np.lexsort((keys, cells.docs))
    keys, doc, h = keys[order], cells.docs[order], cells.hashes[order]
    n = np.bincount(doc, minlength=len(chunk.sizes))
    start = np.cumsum(n) - n
    pos = np.arange(len(doc)) - start[doc]
    pick = np.flatnonzero((pos < (n - -(-4 * n // 5) + 1)[doc]) & (keys >> np.uint64(62) > 0))
    per = np.bincount(doc[pick], minlength=len(n))
    some, f = np.flatnonzero(n), np.zeros((2, len(n)), np.uint64)
    if len(some):
        f[0, some] = np.add.reduceat(mixed(h), start[some])
        f[1, some] = np.add.reduceat(mixed(h ^ np.uint64(0xA0761D6478BD642F)), start[some])
    f = f.view(np.int64)
    t, pos, data = keys[pick].view(np.int64), pos[pick].astype(np.int32), keys.astype(">u8").tobytes()
    ends = np.cumsum(per)
    a = 0
    while a < len(n):  # so many documents at once that their sets are of bounded size, or one
        b = max(a + 1, int(np.searchsorted(8 * (start + n), 8 * start[a] + TOGETHER, side="right")))
        out = []
        for i in range(a, min(b, len(n))):
            some = slice(ends[i] - per[i], ends[i])
            out.append((chunk.ids[i], chunk.marks[i], n[i], f[0, i], f[1, i], t[some], pos[some], data[8 * start[i] : 8 * (start[i] + n[i])] if per[i] else None))
        yield pd.DataFrame(out, columns=["doc_id", "mark", "n", "f1", "f2", "t", "pos", "keys"])
        a = b


class PrefixTree:
    """A trie of globally ordered sets, held as its leaves in order and their shared prefix lengths.

    The leaves in lexicographic order with the length that each shares with the one before are the
    trie's depth-first walk: a branch is a run of leaves that share a prefix, and what was counted
    on the way to a branching point holds for all leaves below it.
    """

    def __init__(self, leaves: list[tuple[bytes, object]]):
        order = sorted(range(len(leaves)), key=lambda i: leaves[i][0])
        self.names = [leaves[i][1] for i in order]
        self.sets = [np.frombuffer(leaves[i][0], ">u8").astype(np.uint64) for i in order]
        self.shared = [0]
        for a, b in zip(self.sets, self.sets[1:]):
            n = min(len(a), len(b))
            other = np.flatnonzero(a[:n] != b[:n])
            self.shared.append(int(other[0]) if len(other) else n)

    def similar(self, probe: np.ndarray, among: Iterable[int] | None = None) -> Iterator[tuple[int, int]]:
        """(leaf, overlap) of the leaves (all, or those of the sorted numbers ``among``) whose Jaccard
        similarity with the probe is 0.8 or more.

        On the way down, elements of the leaf that the probe lacks and elements of the probe that
        were passed over use up what the remaining lengths allow; a subtree is left as soon as
        either is spent for the leaf's length.
        """
        m, before = len(probe), -1
        missed = passed = np.zeros(0, np.int64)
        stop = -1  # the depth at which the last walk was cut off, if it was
        for i in range(len(self.sets)) if among is None else among:
            leaf = self.sets[i]
            # what two leaves share is the least that any neighbours between them do
            common = int(min(self.shared[before + 1 : i + 1])) if before >= 0 else 0
            before, n = i, len(leaf)
            need = -(-4 * (n + m) // 9)
            missed, passed = missed[:common], passed[:common]
            stop = stop if stop < common else -1
            if need > min(n, m) or stop >= 0 and (missed[stop] > n - need or passed[stop] > m - need):
                continue
            done = len(missed)
            new = leaf[done:]
            at = np.searchsorted(probe, new)
            hit = probe[np.minimum(at, m - 1)] == new
            lacks = (int(missed[-1]) if done else 0) + np.cumsum(~hit)
            # of the probe's elements below this one, those that weren't met
            skips = at - (np.arange(done + 1, n + 1) - lacks - hit)
            missed, passed = np.concatenate([missed, lacks]), np.concatenate([passed, skips])
            spent = np.flatnonzero((missed > n - need) | (passed > m - need))
            if len(spent):
                stop = int(spent[0])
                missed, passed = missed[: stop + 1], passed[: stop + 1]
                continue
            stop = -1
            overlap = n - int(missed[-1])
            if 9 * overlap >= 4 * (n + m):
                yield i, overlap

    def starts(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """For each element of a prefix (without elements of one document only) its leaves and places."""
        first = [_prefix(keys) for keys in self.sets]
        leaf = np.repeat(np.arange(len(first)), [len(t) for t, _ in first])
        t, at = (np.concatenate(x) if len(x) else np.zeros(0, np.int64) for x in zip(*first, strict=True)) if first else (leaf, leaf)
        order = np.argsort(t, kind="stable")
        t, at, leaf = t[order], at[order], leaf[order]
        cuts = np.flatnonzero(t[1:] != t[:-1]) + 1
        return {int(k): (x, y) for k, x, y in zip(t[np.append(0, cuts)] if len(t) else [], np.split(leaf, cuts), np.split(at, cuts))}


@frugal
def _search(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (hub, part, kind): the hub's own set, then the sets to be tried against it."""
    at, probe, leaves = None, None, []

    def close() -> list:
        if at is None or probe is None or not leaves:
            return []
        tree = PrefixTree(leaves)
        return [(at[0], tree.names[i]) for i, _ in tree.similar(probe)]

    for pdf in batches:
        found = []
        for hub, part, kind, node, keys in zip(pdf["hub"], pdf["part"], pdf["kind"], pdf["node"], pdf["keys"], strict=True):
            if (hub, part) != at:
                found += close()
                at, probe, leaves = (hub, part), None, []
            if kind == 0:
                probe = np.frombuffer(keys, ">u8").astype(np.uint64)
            else:
                leaves.append((keys, node))
        yield pd.DataFrame(found, columns=["u", "v"])
    yield pd.DataFrame(close(), columns=["u", "v"])


def _near(probe: np.ndarray, starts: dict[int, tuple[np.ndarray, np.ndarray]], size: np.ndarray) -> np.ndarray:
    """The leaves, in order, that share elements of the prefix with the probe, so many that what comes
    after the last of them can still make up for the rest."""
    m, leaves, places, own = len(probe), [], [], []
    for t, i in zip(*_prefix(probe), strict=True):
        leaf, place = starts.get(int(t), ((), ()))
        if len(leaf):
            leaves.append(leaf), places.append(place), own.append(np.full(len(leaf), i))
    if not leaves:
        return np.zeros(0, np.int64)
    leaf = np.concatenate(leaves)
    order = np.argsort(leaf, kind="stable")  # of one leaf in order of its elements
    leaf, place, at = leaf[order], np.concatenate(places)[order], np.concatenate(own)[order]
    last = np.append(np.flatnonzero(leaf[1:] != leaf[:-1]), len(leaf) - 1)
    n, shared = size[leaf[last]], np.diff(last, prepend=-1)
    most = shared + np.minimum(n - 1 - place[last], m - 1 - at[last])
    return leaf[last][9 * most >= 4 * (n + m)]


@frugal
def _tree_join(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (hub, band, part, lane, kind): the sets of a tree, then the sets to be tried against them.

    A probe walks to the leaves that share enough of the prefix, and no more to a component that it
    is linked with already."""
    at, leaves, tree = None, [], None
    for pdf in batches:
        found = []
        for *key, kind, node, c, keys in zip(*(pdf[x] for x in ("hub", "band", "part", "lane", "kind", "node", "c", "keys")), strict=True):
            if key != at:
                at, leaves, tree = key, [], None
            if kind == 0:
                leaves.append((keys, (node, c)))
                continue
            if tree is None and not leaves:
                continue
            if tree is None:
                tree, leaves, joined = PrefixTree(leaves), [], {}
                starts, size = tree.starts(), np.array([len(x) for x in tree.sets])
                component = np.array([x[1] for x in tree.names], np.int64)
            while c in joined:
                c = joined[c]
            probe = np.frombuffer(keys, ">u8").astype(np.uint64)
            apart = (int(i) for i in _near(probe, starts, size) if component[i] != c)
            for i, _ in tree.similar(probe, apart):
                found.append((node, tree.names[i][0]))
                joined[int(component[i])] = c
                component[component == component[i]] = c
        yield pd.DataFrame(found, columns=["u", "v"])


@frugal
def _pair_join(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of (g, part, kind): the sets of a tree, then the sets to be tried against them.
    Every linked pair comes out, once: from the probe with the larger number."""
    names, at, leaves, tree = ["u", "v", "shared"], None, [], None
    for pdf in batches:
        found = []
        for g, part, kind, node, keys in zip(pdf["g"], pdf["part"], pdf["kind"], pdf["node"], pdf["keys"], strict=True):
            if (g, part) != at:
                at, leaves, tree = (g, part), [], None
            if kind == 0:
                leaves.append((keys, node))
                continue
            if tree is None:
                if not leaves:
                    continue
                tree, leaves = PrefixTree(leaves), []
                starts, size, node_of = tree.starts(), np.array([len(x) for x in tree.sets]), np.array(tree.names, np.int64)
            probe = np.frombuffer(keys, ">u8").astype(np.uint64)
            near = _near(probe, starts, size)
            found += [(tree.names[i], node, shared) for i, shared in tree.similar(probe, near[node_of[near] < node].tolist())]
            if len(found) >= GIVEN:
                yield pd.DataFrame(found, columns=names)
                found = []
        yield pd.DataFrame(found, columns=names)


def _all_pairs(label: DataFrame, small: DataFrame) -> DataFrame:
    """u, v, shared of every linked pair. Linked sets are in one component, so each component is joined
    with itself: its sets are dealt to trees of bounded size, and each set goes to each tree."""
    nodes = small.select("node", "n", "keys").join(label.withColumnRenamed("component", "g"), "node")
    parts = nodes.groupBy("g").agg(F.ceil(F.greatest(F.sum("n") / TREE, F.count("*") / LEAVES)).cast("int").alias("parts"))
    nodes = nodes.join(parts, "g")
    leaves = nodes.select("g", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), F.lit(0).alias("kind"), "node", "keys")
    probes = nodes.select("g", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "node", "keys")
    rows = leaves.unionByName(probes).repartition("g", "part").sortWithinPartitions("g", "part", "kind")
    return rows.mapInPandas(_pair_join, "u long, v long, shared long")


def _joined(met: DataFrame, label: DataFrame, by_node: DataFrame) -> DataFrame:
    """Links between components that share a prefix element, by trees and not pair by pair.

    Documents that were tried against one hub are a family: all documents of an element are in one.
    A family is a tree of its documents, and those outside its largest component are tried against
    it. Families too large for a tree are cut into bands of lengths, and these into parts by a hash;
    a document is tried in its own band and the two beside it, where all that it can be linked with
    is. Those that are tried are dealt to lanes, so that no tree meets more than MOST of them.
    """
    posted = keep(met.join(label, "node", "left").select("t", "hub", "node", "n", F.coalesce("component", "node").alias("c")), "postings")
    apart = posted.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("t")
    members = keep(posted.join(apart, "t", "left_semi").select("hub", "node", "n", "c").distinct(), "members")
    sizes = members.groupBy("hub", "c").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    main = sizes.groupBy("hub").agg(F.max(F.struct("m", "c")).getField("c").alias("bc"), (F.sum("n") > TREE).alias("cut"))
    band = F.when(F.col("cut"), F.floor(F.log("n") / float(np.log(BAND))).cast("int")).otherwise(0)
    placed = members.join(main, "hub").withColumn("band", band)
    parts = placed.groupBy("hub", "band").agg(F.ceil(F.greatest(F.sum("n") / TREE, F.count("*") / MOST)).cast("int").alias("parts"))
    tried = placed.where("c <> bc").select("hub", "node", "c", F.explode(F.when(F.col("cut"), F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).otherwise(F.array(F.lit(0)))).alias("band"))
    lanes = tried.groupBy("hub", "band").agg(F.ceil(F.count("*") / MOST).cast("int").alias("lanes"))
    grid = parts.join(lanes, ["hub", "band"])
    dealt = lambda n, *salt: F.pmod(F.xxhash64("node", *salt), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    leaves = placed.join(grid, ["hub", "band"]).select("hub", "band", dealt("parts").alias("part"), each("lanes").alias("lane"), F.lit(0).alias("kind"), "node", "c")
    probes = tried.join(grid, ["hub", "band"]).select("hub", "band", each("parts").alias("part"), dealt("lanes", F.lit(3)).alias("lane"), F.lit(1).alias("kind"), "node", "c")
    key = ["hub", "band", "part", "lane"]
    rows = leaves.unionByName(probes).join(by_node, "node").repartition(*key).sortWithinPartitions(*key, "kind")
    links = keep(rows.mapInPandas(_tree_join, "u long, v long"), "links")
    drop(posted), drop(members)
    return links


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (hub, node) that are linked. Sets are sent to their hub once each; a hub with many
    is split by total length, so that a tree stays within TREE shingles (or one set)."""
    size = pairs.groupBy("hub").agg(F.ceil(F.sum("n") / TREE).alias("parts"))
    dealt = pairs.join(size, "hub").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).select("hub", "part", "node")
    hubs = size.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"))
    both = dealt.withColumn("kind", F.lit(1)).unionByName(hubs.select("hub", "part", F.col("hub").alias("node"), F.lit(0).alias("kind")))
    rows = both.join(sets, "node").select("hub", "part", "kind", "node", "keys").repartition("hub", "part").sortWithinPartitions("hub", "part", "kind")
    return keep(rows.mapInPandas(_search, "u long, v long"), "links")


_POSSIBLE = "9 * (least(pos, hpos) + 1 + least(n - pos, hn - hpos) - 1) >= 4 * (n + hn)"


class _Linked(NamedTuple):
    """sets: n, f1, f2 of each document, with a mark of its text where ids repeat; classes: f1, f2, rep, node; small: the sets of the classes that may be linked;
    label: node, component of those that are; many: whether a doc_id is on several rows."""

    sets: DataFrame
    classes: DataFrame
    small: DataFrame
    label: DataFrame
    many: bool


def _linked(docs: DataFrame, width: int) -> _Linked:
    """The classes of equal sets, and the components that links make of them.

    The global order puts rare shingles first, by a count-min sketch over all documents. Linked sets
    share a shingle of their prefixes (the part that may be missing, plus one); shingles that the
    sketch proves to be in one document only are never sent, and of shingles that the same documents
    have in their prefixes only one is. For each shingle a hub is tried against all others by a
    prefix tree of their sets; links join components. What a hub has met it is done with; of what
    is left, shingles whose documents are in different components are tried in full, by prefix
    trees of the hub's family. So no two components that a link would join stay apart, and a large
    group of copies costs its size and not its square. Links inside a component that is joined
    already aren't looked for here: linked_pairs() has all of them.
    """
    many = repeats_ids(docs)
    mark = F.xxhash64("text") if many else F.lit(0).cast("long")
    own = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark.alias("mark"), "text").where("doc_id is not null"))
    chunks = chunked(own, lower=True)
    found = answered(chunks, partial(_shingles, width=width), _sets, "doc_id long, mark long, n long, f1 long, f2 long, t array<long>, pos array<int>, keys binary", HOT)
    full = keep(found, "sets")
    drop(chunks), drop(found._read)
    # two classes may have the same smallest id where ids repeat: a class is then named by a hash of its set
    node = F.xxhash64("f1", "f2") if many else F.col("rep")
    classes = keep(full.where("n > 0").groupBy("f1", "f2").agg(F.min("doc_id").alias("rep")).withColumn("node", node), "classes")
    one_each = full.where("keys is not null").join(classes, ["f1", "f2"]).where("doc_id = rep")
    if many:
        one_each = one_each.dropDuplicates(["f1", "f2"])
    small = keep(one_each.select("node", F.col("n").cast("int").alias("n"), "keys", "t", "pos"), "small")
    sets = keep(full.select("doc_id", "mark", "n", "f1", "f2"), "lengths")
    drop(full)
    by_node = small.select("node", "keys")
    posted = small.select("node", "n", F.explode(F.arrays_zip("t", "pos")).alias("x")).select(F.col("x.t").alias("t"), "node", "n", F.col("x.pos").alias("pos"))
    lists = posted.groupBy("t").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("node")).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(7))).alias("x2"), F.min(F.struct("node", "n", "pos")).alias("h")).where("k > 1")
    one = lists.groupBy("k", "x1", "x2").agg(F.min(F.struct("t", "h")).alias("one"))
    one = one.select(F.col("one.t").alias("t"), F.col("one.h.node").alias("hub"), F.col("one.h.n").alias("hn"), F.col("one.h.pos").alias("hpos"))
    met = keep(posted.join(one, "t").where("node <> hub"), "met")
    links = _verified(met.where(_POSSIBLE).select("hub", "node", "n").distinct(), by_node)
    label = connected_components(links)
    more = _joined(met, label, by_node)
    final = connected_components(links.unionByName(more))
    for table in (met, links, label, more):
        drop(table)
    return _Linked(sets, classes, small, final, many)


def linked_components(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, class_id, component_id.

    Documents with equal sets are one class, named by its smallest doc_id; classes are linked when
    their sets' Jaccard similarity is 0.8 or more; component_id is the smallest doc_id reachable
    by links. Null, empty and blank texts have no shingles and no links. Rows without a doc_id
    aren't linked and have no component. Rows that share a doc_id are documents of their own.
    The links themselves are in linked_pairs().
    """
    sets, classes, small, label, many = _linked(docs, width)
    label = label.select(F.col("node").alias("__node"), "component")
    named = classes.join(label, F.col("node") == F.col("__node"), "left").select("f1", "f2", F.col("rep").alias("class_id"), F.coalesce("component", "node").alias("component"))
    if many:
        least = named.groupBy("component").agg(F.min("class_id").alias("component_id"))
        named = named.join(least, "component").select("f1", "f2", "class_id", "component_id")
    else:
        named = named.withColumnRenamed("component", "component_id")
    drop(small)
    out = sets.where("n > 0").join(named, ["f1", "f2"]).select("doc_id", F.col("n").alias("n_shingles"), "class_id", "component_id")
    none = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    unnamed = docs.where("doc_id is null").select("text").mapInPandas(partial(_counted, width=width), "doc_id long, n_shingles long, class_id long, component_id long")
    return out.unionByName(none).unionByName(unnamed)


def linked_pairs(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """class_id, other_id, n_shingles, other_shingles, n_shared of every two classes whose Jaccard
    similarity is 0.8 or more, each pair once with the smaller class_id first.

    With the class_id of linked_components() these are all links between documents: those of one
    class, and those of linked classes. Their number is the square of a group's size if all of its
    texts are different and linked. Where rows share a doc_id, two classes may have one class_id.
    """
    _, classes, small, label, _ = _linked(docs, width)
    pairs = keep(_all_pairs(label, small), "pairs")
    named = small.select("node", "n").join(classes.select("node", "rep"), "node")
    one = named.select(F.col("node").alias("u"), F.col("rep").alias("a"), F.col("n").alias("na"))
    two = named.select(F.col("node").alias("v"), F.col("rep").alias("b"), F.col("n").alias("nb"))
    met = pairs.join(one, "u").join(two, "v")
    first = F.struct(F.col("a").alias("id"), F.col("na").alias("n"))
    second = F.struct(F.col("b").alias("id"), F.col("nb").alias("n"))
    met = met.select(F.least(first, second).alias("x"), F.greatest(first, second).alias("y"), "shared")
    return met.select(F.col("x.id").alias("class_id"), F.col("y.id").alias("other_id"), F.col("x.n").alias("n_shingles"), F.col("y.n").alias("other_shingles"), F.col("shared").alias("n_shared"))


@frugal
def _counted(batches: Iterable[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        words = [[w.lower() for w in split(x)] for x in pdf["text"]]
        n = [len({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}) if w else 0 for w in words]
        none = pd.array([None] * len(pdf), "Int64")
        yield pd.DataFrame({"doc_id": none, "n_shingles": n, "class_id": none, "component_id": none})


def one_of_each(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs without those that links or equal sets join to a smaller doc_id.

    Rows without a doc_id stay; of repeated rows with one doc_id and text one stays. Different texts
    under one doc_id are judged one by one; if they are linked, the one with the smaller hash stays."""
    key, own = unused("id", docs.columns), unused("mark", docs.columns)
    sets, classes, small, label, many = _linked(docs, width)
    drop(small)
    label = label.select(F.col("node").alias("__node"), "component")
    named = classes.join(label, F.col("node") == F.col("__node"), "left").select("f1", "f2", F.coalesce("component", "node").alias("component"))
    rows = sets.where("n > 0").join(named, ["f1", "f2"])
    if not many:  # a component's name is its smallest doc_id, so no group has to meet
        later = rows.where("doc_id <> component").select(F.col("doc_id").alias(key))
        return docs.join(later, F.col("doc_id") == F.col(key), "left_anti")
    rows = rows.select("component", F.struct("doc_id", "mark").alias("row"))
    first = rows.groupBy("component").agg(F.min("row").alias("first"))
    later = rows.join(first, "component").where("row <> first").select(F.col("row.doc_id").alias(key), F.col("row.mark").alias(own)).distinct()
    left = docs.where("doc_id is not null").join(later, (F.col("doc_id") == F.col(key)) & (F.xxhash64("text") == F.col(own)), "left_anti")
    return left.dropDuplicates(["doc_id", "text"]).unionByName(docs.where("doc_id is null"))


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return linked_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id", "class_id")


def op8_ngram_jaccard_pairs(spark, sf_dir: str) -> DataFrame:
    return linked_pairs(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, sha256(array_to_string(ws[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
bothways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (SELECT u, v FROM bothways UNION SELECT r.u, b.v FROM reach r JOIN bothways b ON r.v = b.u),
least_id AS (SELECT u, min(v) AS v FROM reach GROUP BY 1),
same AS (SELECT doc_id, string_agg(s, '' ORDER BY s) AS f FROM sh GROUP BY 1),
class AS (SELECT f, min(doc_id) AS class_id FROM same GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(l.v, w.doc_id)) AS component_id, coalesce(class.class_id, w.doc_id) AS class_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_id l ON l.u = w.doc_id LEFT JOIN same USING (doc_id) LEFT JOIN class USING (f)
"""

ORACLE_PAIRS = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, sha256(array_to_string(ws[i:i + 4], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
same AS (SELECT doc_id, count(*) AS n, string_agg(s, '' ORDER BY s) AS f FROM sh GROUP BY 1),
class AS (SELECT min(doc_id) AS doc_id, any_value(n) AS n FROM same GROUP BY f),
own AS (SELECT sh.* FROM sh JOIN class USING (doc_id))
SELECT a.doc_id AS class_id, b.doc_id AS other_id, any_value(x.n) AS n_shingles, any_value(y.n) AS other_shingles, count(*) AS n_shared
FROM own a JOIN own b ON a.s = b.s AND a.doc_id < b.doc_id JOIN class x ON x.doc_id = a.doc_id JOIN class y ON y.doc_id = b.doc_id
GROUP BY 1, 2 HAVING 100 * count(*) >= 80 * (any_value(x.n) + any_value(y.n) - count(*))
"""
