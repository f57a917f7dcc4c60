"""Texts as chunks of word numbers: a table that later steps read instead of the texts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .memory import frugal
from .scratch import keep

#: Words of a chunk; a longer document is a chunk of its own.
CHUNK = 300_000
CHUNK_SCHEMA = "chunk long, n long, ids binary, marks binary, sizes binary, tokens binary, words binary"


def pack(x: np.ndarray) -> bytes:
    """Numbers byte by byte, first all lowest ones: most of the higher ones are alike."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


class _Numbers(dict):
    """Words in order of first use, and a hash of each."""

    def __init__(self, digest: Callable[[bytes], bytes]):
        super().__init__()
        self.digest, self.digests = digest, []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.digests)
        self.digests.append(self.digest(word))
        return n


@frugal
def _chunks(batches: Iterable[pd.DataFrame], lower: bool, twice: bool) -> Iterator[pd.DataFrame]:
    place, made = TaskContext.get().partitionId(), 0
    digest = xxhash.xxh3_128_digest if twice else xxhash.xxh3_64_digest
    known, ids, marks, parts, n = _Numbers(digest), [], [], [], 0

    def flush() -> pd.DataFrame:
        sizes = np.array([len(p) for p in parts], "<i8")
        row = ((place << 32) | made, n, np.array(ids, "<i8").tobytes(), np.array(marks, "<i8").tobytes(), sizes.tobytes(), pack(np.concatenate(parts)), b"".join(known.digests))
        return pd.DataFrame([row], columns=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])

    for pdf in batches:
        for doc_id, mark, text in zip(pdf["doc_id"], pdf["mark"], pdf["text"], strict=True):
            data = b"" if text is None else text.encode("utf-8", "surrogatepass")
            words = (data.lower() if lower else data).split()
            ids.append(doc_id), marks.append(mark)
            parts.append(np.fromiter(map(known.__getitem__, words), "<u4", len(words)))
            n += len(words)
            if n >= CHUNK:
                yield flush()
                known, ids, marks, parts, n, made = _Numbers(digest), [], [], [], 0, made + 1
    if parts:
        yield flush()


def chunked(docs: DataFrame, lower: bool, twice: bool = False) -> DataFrame:
    """A kept table of the words of docs (doc_id, mark, text): doc_id and mark without nulls; null texts have no words.
    A word goes by 64 bits of hash, or by two independent ones if ``twice``."""
    return keep(docs.select("doc_id", "mark", "text").mapInPandas(partial(_chunks, lower=lower, twice=twice), CHUNK_SCHEMA), "chunks")


class Chunk(NamedTuple):
    """ids and marks of documents, where their words start and how many they are, and the hashes of every word."""

    ids: np.ndarray
    marks: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    one: np.ndarray
    two: np.ndarray | None


def opened(row) -> Chunk:
    sizes = np.frombuffer(row.sizes, "<i8")
    tokens = unpack(row.tokens, "<u4")
    words = np.frombuffer(row.words, ">u8").astype(np.uint64)
    many = int(tokens.max()) + 1 if len(tokens) else 0  # each word has one hash or two
    two = words[1::2][tokens] if len(words) > many else None
    one = words[:: 1 if two is None else 2][tokens]
    return Chunk(np.frombuffer(row.ids, "<i8"), np.frombuffer(row.marks, "<i8"), np.cumsum(sizes) - sizes, sizes, one, two)


def windows(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all windows of ``width`` words inside one document, and the documents' places."""
    many = np.maximum(chunk.sizes - width + 1, 0)
    doc = np.repeat(np.arange(len(chunk.sizes), dtype=np.int32), many)
    return np.arange(len(doc)) - np.repeat(np.cumsum(many) - many - chunk.starts, many), doc


def grouped(batches: Iterable[pd.DataFrame], by: str) -> Iterator[tuple[int, list]]:
    """Rows of sorted batches, key by key."""
    at, rows = None, []
    for pdf in batches:
        for r in pdf.itertuples():
            key = getattr(r, by)
            if key != at and rows:
                yield at, rows
                rows = []
            at = key
            rows.append(r)
    if rows:
        yield at, rows
