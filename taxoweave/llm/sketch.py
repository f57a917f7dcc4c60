"""A count-min sketch that lies in blocks over all tasks: chunks send cells, blocks count and answer."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunk, grouped, opened
from .memory import frugal, give_back
from .scratch import keep
from .words import mixed

#: Cells of one block; a counting task holds the counters of one block at a time.
BLOCK_BITS = 22
ROWS = 2
_ROW_1 = np.uint64(0xD6E8FEB86659FD93)
_SENT = "row int, block long, chunk long, cells binary"
_REPLY = "row int, block long, chunk long, repeated binary, hot binary"
#: What makes of a chunk the hashes that are counted, and each one's document.
Hashes = Callable[[Chunk], tuple[np.ndarray, np.ndarray]]


def cell_bits(chunks: DataFrame, least: int = 18) -> int:
    """Bits of a cell number: about four cells for each word. They lie in blocks, so nothing limits them."""
    n = chunks.agg(F.sum("n")).first()[0] or 0
    return max(least, int(4 * n).bit_length())


class Cells:
    """The cells of a chunk's hashes, each hash once for a document, in both rows of the sketch."""

    def __init__(self, hashes: np.ndarray, doc: np.ndarray, bits: int):
        kind = np.int32 if len(hashes) < 1 << 31 else np.int64
        self.order = np.argsort(hashes, kind="stable").astype(kind)  # places stay in order, so documents do
        h, d = hashes[self.order], doc[self.order]
        new = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])) if len(h) else np.zeros(0, bool)
        self.entry = np.cumsum(new, dtype=kind) - kind(1)  # of each hash in order, its place among the distinct ones
        self.hashes, self.docs = h[new], d[new]
        del h, d
        self.rows = []  # distinct cells in order, their counts, and the place of each entry's cell
        shift = np.uint64(64 - bits)
        for row in range(ROWS):
            cell = (mixed(self.hashes ^ _ROW_1) if row else self.hashes) >> shift
            by = np.argsort(cell, kind="stable") if row else slice(None)
            cell = cell[by]
            first = np.append(True, cell[1:] != cell[:-1]) if len(cell) else np.zeros(0, bool)
            at = np.empty(len(cell), kind)
            at[by] = np.cumsum(first, dtype=kind) - kind(1)
            starts = np.flatnonzero(first)
            self.rows.append((cell[starts], np.diff(starts, append=len(cell)).astype(np.uint32), at))

    def flags(self, replies: list) -> tuple[np.ndarray, np.ndarray]:
        """For each distinct (hash, document): whether it was estimated to be in two documents or more,
        and whether the first row's estimate reached the hot level."""
        unpack, parts = zstandard.ZstdDecompressor(), [[] for _ in range(ROWS)]
        hot = []
        for r in sorted(replies, key=lambda r: (r.row, r.block)):
            parts[int(r.row)].append(unpack.decompress(r.repeated))  # beside nulls pandas has floats
            if r.row == 0:
                hot.append(unpack.decompress(r.hot))
        out = np.ones(len(self.hashes), bool)
        for (_, _, at), data in zip(self.rows, parts, strict=True):
            out &= np.frombuffer(b"".join(data), bool)[at]
        return out, np.frombuffer(b"".join(hot), bool)[self.rows[0][2]]


def _kind(x: np.ndarray):
    most = int(x.max(initial=0))
    return np.uint8 if most < 256 else np.uint16 if most < 65536 else np.uint32


@frugal
def _send(batches: Iterable[pd.DataFrame], hashes: Hashes, bits: int) -> Iterator[pd.DataFrame]:
    low = min(bits, BLOCK_BITS)
    pack = zstandard.ZstdCompressor(level=1)
    for pdf in batches:
        for r in pdf.itertuples():
            found, out = Cells(*hashes(opened(r)), bits), []
            for row, (cell, count, _) in enumerate(found.rows):
                block = cell >> np.uint64(low)
                edges = np.flatnonzero(block[1:] != block[:-1]) + 1
                for a, b in zip([0, *edges], [*edges, len(cell)]) if len(cell) else []:
                    steps = np.diff(cell[a:b] & np.uint64((1 << low) - 1), prepend=np.uint64(0))
                    kinds = _kind(steps), _kind(count[a:b])
                    data = bytes([np.dtype(k).itemsize for k in kinds]) + pack.compress(steps.astype(kinds[0]).tobytes() + count[a:b].astype(kinds[1]).tobytes())
                    out.append((row, int(block[a]), r.chunk, data))
            yield pd.DataFrame(out, columns=["row", "block", "chunk", "cells"])


@frugal
def _count(batches: Iterable[pd.DataFrame], bits: int, hot: int) -> Iterator[pd.DataFrame]:
    """All counts of a block, then an answer to each chunk that sent to it."""
    low = min(bits, BLOCK_BITS)
    pack, unpack = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    kinds = {1: np.uint8, 2: np.uint16, 4: np.uint32}

    def cells(data: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw, (a, b) = unpack.decompress(data[2:]), data[:2]
        n = len(raw) // (a + b)
        return np.cumsum(np.frombuffer(raw, kinds[a], n), dtype=np.int64), np.frombuffer(raw, kinds[b], n, n * a)

    for _, rows in grouped((pdf.assign(key=list(zip(pdf["row"], pdf["block"], strict=True))) for pdf in batches), "key"):
        counts = np.zeros(1 << low, np.uint32)
        for r in rows:
            at, n = cells(r.cells)
            counts[at] = np.minimum(counts[at].astype(np.uint64) + n, 0xFFFFFFFF)
        out = []
        for r in rows:
            here = counts[cells(r.cells)[0]]
            out.append((r.row, r.block, r.chunk, pack.compress((here > 1).tobytes()), pack.compress((here >= hot).tobytes()) if r.row == 0 else None))
        yield pd.DataFrame(out, columns=["row", "block", "chunk", "repeated", "hot"])


def answered(chunks: DataFrame, hashes: Hashes, run: Callable, schema: str, hot: int = 1 << 30) -> DataFrame:
    """``run(row, Cells, replies)`` of every chunk, which gives a table of ``schema``.

    Each chunk's sketch goes, as the cells that it met with their counts, to the blocks that the
    cells lie in. A block adds up what all chunks sent and answers each: which of its cells have
    counted two or more, and which reached the hot level. The chunk then knows of each of its
    hashes what the merged sketch estimates. No task ever holds more than a block or a chunk, and
    nothing goes through the driver.
    """
    bits, spark = cell_bits(chunks), chunks.sparkSession
    sent = chunks.mapInPandas(partial(_send, hashes=hashes, bits=bits), _SENT)
    blocks = max(1, (ROWS << max(0, bits - BLOCK_BITS)) // 4)
    replies = keep(sent.repartition(blocks, "row", "block").sortWithinPartitions("row", "block").mapInPandas(partial(_count, bits=bits, hot=hot), _REPLY), "replies")
    own = chunks.withColumn("kind", F.lit(0)).unionByName(replies.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    tasks = max(chunks.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    met = own.repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind")
    out = met.mapInPandas(partial(_meet, hashes=hashes, bits=bits, run=run), schema)
    out._read = replies
    return out


@frugal
def _meet(batches: Iterable[pd.DataFrame], hashes: Hashes, bits: int, run: Callable) -> Iterator[pd.DataFrame]:
    for _, rows in grouped(batches, "chunk"):
        chunk = opened(rows[0])
        yield from run(chunk, Cells(*hashes(chunk), bits), rows[1:])
        del chunk
        give_back()
