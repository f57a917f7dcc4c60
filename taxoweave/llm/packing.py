"""Best-two-fit packing of tokenized documents into sequences of bounded length."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import word_ids
from .inputs import spread
from .memory import frugal
from .scratch import keep

MAX_TOKENS = 4096
END_ID = 1
#: Rows of one length are ranked in parts: of this many rows at least, and so that there are about PARTS parts at most.
LEAST, PARTS = 500, 20_000
#: Bytes of text that are tokenized together.
TOGETHER = 4 << 20
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _token_ids(texts: pa.Array, known) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts in a row, and how many each has. Words are told apart in Arrow, so that Python
    sees each different word once."""
    texts = pc.fill_null(texts, "")
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    of = pc.list_parent_indices(lists).to_numpy()
    full = pc.greater(pc.binary_length(words), 0)  # white space at an end splits off an empty one
    if full.false_count:
        words, of = words.filter(full), of[full.to_numpy(zero_copy_only=False)]
    coded = words.dictionary_encode()
    ids = known.each(coded.dictionary.cast(pa.binary()).to_pylist())
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
    word = coded.indices.to_numpy()
    many = sizes[word]
    ends = np.cumsum(many)
    total = int(ends[-1]) if len(ends) else 0
    at = np.repeat(start[word] - ends + many, many)
    at += np.arange(total)
    return flat[at], np.bincount(of, many, minlength=len(texts)).astype(np.int64)


@frugal
def _pieces(batches: Iterable[pa.RecordBatch], path: str, most: int, end: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    known, last = word_ids(path), np.array([end], "<u4").tobytes()
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:  # so many texts at once that they are of bounded size, or one
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER, side="right")))
            part = batch.slice(at, to - at)
            flat, many = _token_ids(part["text"], known)
            flat, rows, a = flat.tobytes(), [], 0
            for row, n in enumerate(many.tolist()):
                ids = flat[a : a + 4 * n] + last
                a += 4 * n
                for piece, start in enumerate(range(0, len(ids), 4 * most)):
                    cut = ids[start : start + 4 * most]
                    rows.append((row, piece, start // 4, len(cut) // 4, zlib.crc32(cut), cut))
            row, piece, start, length, crc, cuts = zip(*rows, strict=True)
            columns = [part["doc_id"].take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [c.split()[0] for c in PIECE.split(", ")]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(cuts, pa.binary())] * with_ids, names=names + ["ids"] * with_ids)
            at = to


class Plan:
    """How many sequences of which make-up: patterns of lengths, each with how often it is used."""

    def __init__(self, counts: np.ndarray, most: int):
        """counts[x]: the documents of length x. The work depends on ``most`` and not on the counts."""
        left, size = counts.astype(np.int64).copy(), np.arange(most + 1)
        left[0] = 0
        self.patterns: list[tuple[dict[int, int], int]] = []
        while True:
            below = np.maximum.accumulate(np.where(left > 0, size, 0))  # the largest unpacked length up to x
            if not below[most]:
                break
            used, gap = self._fill(left, below, most)
            while gap and len(used) and sum(used.values()) > 1:
                better = self._two_for_smallest(left, used, gap)
                if better is None:
                    break
                smallest, a, b = better
                gap += smallest - a - b
                used[smallest] -= 1
                if not used[smallest]:
                    del used[smallest]
                for x in (a, b):
                    used[x] = used.get(x, 0) + 1
            times = min(int(left[x]) // n for x, n in used.items())
            for x, n in used.items():
                left[x] -= n * times
            self.patterns.append((used, times))

    @staticmethod
    def _fill(left: np.ndarray, below: np.ndarray, most: int) -> tuple[dict[int, int], int]:
        """Greedily the largest that still fits, again and again."""
        used, gap = {}, most
        at = int(below[gap])
        while at:
            n = min(int(left[at]), gap // at)
            used[at] = n
            gap -= n * at
            at = int(below[min(gap, at - 1)])
        return used, gap

    @staticmethod
    def _two_for_smallest(left: np.ndarray, used: dict[int, int], gap: int) -> tuple[int, int, int] | None:
        """The two unpacked lengths that fit best where the smallest document and the gap were."""
        smallest = min(used)
        room = gap + smallest
        free = left[: room + 1].copy()
        for x, n in used.items():
            if x <= room:
                free[x] -= n
        if smallest <= room:
            free[smallest] += 1
        size = np.arange(room + 1)
        below = np.maximum.accumulate(np.where(free > 0, size, 0))
        a = np.flatnonzero(free[1:] > 0) + 1
        if not len(a):
            return None
        b = below[room - a]
        twice = (b == a) & (free[a] < 2)
        b = np.where(twice, below[a - 1], b)
        both = np.where(b > 0, a + b, 0)
        at = int(np.argmax(both))
        return (smallest, int(a[at]), int(b[at])) if both[at] > smallest else None

    def places(self) -> pd.DataFrame:
        """For each length its runs of ranks: first rank, times, first sequence and offset there."""
        rows, taken, sequence = [], {}, 0
        for used, times in self.patterns:
            offset = 0
            for x in sorted(used, reverse=True):
                rows.append((x, taken.get(x, 0), times, sequence, offset))
                taken[x] = taken.get(x, 0) + used[x] * times
                offset += x * used[x]
            sequence += times
        return pd.DataFrame(rows, columns=["length", "first", "times", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


@frugal
def _place(batches: Iterable[pa.RecordBatch], places) -> Iterator[pa.RecordBatch]:
    """The last column, a rank, becomes sequence_id and offset."""
    runs = {x: g.to_numpy() for x, g in places.value.groupby("length")}
    for batch in batches:
        length, rank = (batch[c].to_numpy().astype(np.int64) for c in ("length", "rank"))
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else []:
            run, r = runs[length[part[0]]], rank[part]
            row = run[np.searchsorted(run[:, 1], r, side="right") - 1]
            nth, inside = divmod(r - row[:, 1], row[:, 2])
            sequence[part] = row[:, 3] + inside
            offset[part] = row[:, 4] + nth * row[:, 0]
        columns = [batch[i] for i in range(batch.num_columns - 1)] + [pa.array(sequence), pa.array(offset)]
        yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1] + ["sequence_id", "offset"])


def pack(docs: DataFrame, path: str | None = None, most: int = MAX_TOKENS, end: int = END_ID, ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with ``ids``, its ids.

    A document is its tokenizer ids and then ``end``; one longer than ``most`` is cut into pieces of
    ``most``. A null or empty text is ``end`` alone; a null doc_id stays null; each row of repeated
    rows is a document of its own; no rows give no rows.

    Only lengths matter for a place, and there are at most ``most`` of them, so the packing is found
    over counts of lengths: best-two-fit makes one sequence (the largest that fits, again and again,
    then the smallest document is replaced by the two unpacked ones that fit its widened gap more
    tightly, while any do), and uses it as often as the counts allow. The plan's size depends on
    ``most`` alone. A bin of one document isn't touched: as it holds the largest one that was left,
    two others in its place would put the hardest one off. Documents of one length are then ranked
    in parts dealt by a hash, and a rank says which sequence and place. A very long text is
    tokenized whole, by one task.
    """
    spark, columns = docs.sparkSession, PIECE + ", ids binary" * ids
    texts = spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    made = keep(texts.mapInArrow(partial(_pieces, path=path or tokenizer_path(), most=most, end=end, with_ids=ids), columns), "pieces")
    counts = np.zeros(most + 1, np.int64)
    for row in made.groupBy("length").agg(F.count("*").alias("n")).collect():  # at most ``most`` rows
        counts[row["length"]] = row["n"]
    places = spark.sparkContext.broadcast(Plan(counts, most).places())
    # a length is ranked in parts, whose number is at most ``most`` + PARTS, whatever the data
    together = max(LEAST, -(-int(counts.sum()) // PARTS))
    lengths = spark.createDataFrame([(int(x), int(-(-counts[x] // together))) for x in np.flatnonzero(counts)], "length long, parts long")
    dealt = made.join(F.broadcast(lengths), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), "parts"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "part").agg(F.count("*").alias("n")).select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("first"))
    inside = Window.partitionBy("length", "part").orderBy(F.col("doc_id").asc_nulls_last(), "piece", "ids_crc32")
    ranked = dealt.withColumn("nth", F.row_number().over(inside) - 1).join(F.broadcast(starts), ["length", "part"])
    names = [c.split()[0] for c in columns.split(", ")]
    ranked = ranked.select(*names, (F.col("first") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(partial(_place, places=places), columns + ", sequence_id long, offset long")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
