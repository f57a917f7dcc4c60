"""Quality classifier: averaged hashed subword embeddings under a softmax, trained by SGD in numpy."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .inputs import filled, spread, unfilled
from .memory import frugal
from .words import mixed

BUCKETS_BITS = 18
DIM = 8
GRAMS = (3, 4, 5)
EPOCHS = 6
RATE = 4.0
#: The bound of the training sample: labelled documents, those with the smallest hashes of their ids.
SAMPLE = 3000
THRESHOLD = 0.7
#: Characters of text that are hashed together.
SLICE = 1 << 18
TOGETHER = 1000
_BLANKS = " \t\n\v\f\r"
_GAP = re.compile(f"[{_BLANKS}]")
_BASE = np.uint64(0x100000001B3)
_TWICE = np.uint64(1)


class Model(NamedTuple):
    vectors: np.ndarray  # a vector for each bucket
    softmax: np.ndarray  # two rows
    bias: np.ndarray


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE), np.full(n, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    up[:1] = down[:1] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def features(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(document, bucket) of every feature of the texts: each word, each two words in a row (equal ones
    as one feature), and each run of 3 to 5 characters of a word with the white space at its ends."""
    parts = ["  " if t is None else f" {t} " for t in texts]
    ends = np.cumsum([len(p) for p in parts])
    raw = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), "<u4")
    space = (raw == 32) | (raw - 9 < 5)  # unsigned: what is below 9 wraps
    char = np.where(space, 32, raw).astype(np.uint64)
    docs, hashes = [], []
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    stops = np.flatnonzero(~space[:-1] & space[1:]) + 1
    if len(starts):
        up, down = _powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((char + np.uint64(1)) * up[: len(raw)], dtype=np.uint64, out=sums[1:])
        word = mixed((sums[stops] - sums[starts]) * down[starts])
        of = np.searchsorted(ends, starts, side="right")
        docs.append(of)
        hashes.append(word)
        same = np.flatnonzero(of[1:] == of[:-1])
        docs.append(of[same])
        # a word said twice in a row is one feature, whatever the word: what its n-grams can't tell of unseen words
        hashes.append(np.where(word[same] == word[same + 1], _TWICE, word[same] * np.uint64(3) + word[same + 1]))
    run = char
    for n in range(2, max(GRAMS) + 1):
        if len(raw) < n:
            break
        run = run[:-1] * _BASE + char[n - 1 :]
        if n in GRAMS:
            whole = ~space[1 : len(raw) - n + 2]
            for k in range(2, n - 1):
                whole = whole & ~space[k : len(raw) - n + 1 + k]
            at = np.flatnonzero(whole)
            docs.append(np.searchsorted(ends, at, side="right"))
            hashes.append(run[at] + np.uint64(n << 56))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(docs), (mixed(np.concatenate(hashes)) >> np.uint64(64 - BUCKETS_BITS)).astype(np.int64)


def _packed(x: np.ndarray) -> bytes:
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def _opened(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), f"<u{data[0]}")


@frugal
def _sample_features(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each text its buckets, as steps from one to the next, and how often each is met."""
    for pdf in batches:
        rows = []
        for doc_id, quality, text in zip(pdf["doc_id"], pdf["quality"], pdf["text"], strict=True):
            n = sum(np.bincount(features([part])[1], minlength=1 << BUCKETS_BITS) * sign for part, sign in _parts(text))
            bucket = np.flatnonzero(n)
            rows.append((doc_id, int(quality), _packed(np.diff(bucket, prepend=0)), _packed(n[bucket])))
        yield pd.DataFrame(rows, columns=["doc_id", "quality", "buckets", "n"])


class _Examples(Sequence):
    """The sample as it is held: a document takes a few hundred kilobytes at most, whatever its length."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]]):
        self.rows = rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> tuple[int, np.ndarray, np.ndarray]:
        quality, buckets, n = self.rows[i]
        weight = _opened(n).astype(np.float32)
        return quality, np.cumsum(_opened(buckets), dtype=np.int32), weight / max(1, weight.sum())


@frugal
def _fit(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task has the whole sample, fits the model and gives what scoring needs of it."""
    rows = [r for pdf in batches for r in zip(pdf["quality"], pdf["buckets"], pdf["n"], strict=True)]
    model = fit(_Examples(rows))
    lean = (model.vectors @ (model.softmax[1] - model.softmax[0])).astype("<f4")
    yield pd.DataFrame({"lean": [lean.tobytes()], "bias": [float(model.bias[1] - model.bias[0])]})


def fit(examples: Sequence[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> Model:
    """Stochastic gradient descent, one document a step. examples: label, buckets, weights summing to 1.

    Without examples, or for texts without features, the model says what the bias says."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKETS_BITS, DIM)).astype(np.float32)
    softmax, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    step, steps = 0, max(1, epochs * len(examples))
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            label, bucket, weight = examples[i]
            now = rate * (1 - step / steps)
            x = weight @ vectors[bucket] if len(bucket) else np.zeros(DIM, np.float32)
            z = softmax @ x + bias
            p = np.exp(z - z.max())
            g = p / p.sum()
            g[label] -= 1
            back = softmax.T @ g
            # both steps are clipped at length one: equal texts with different labels would drive them up without end
            back /= max(1, np.sqrt(back @ back))
            softmax -= now * np.outer(g, x) / max(1, np.sqrt(x @ x))
            bias -= now * 0.1 * g
            if len(bucket):
                # a feature's share of the average is small: its step is scaled by the features' number
                vectors[bucket] -= (now * np.float32(len(bucket)) ** 0.5 * weight[:, None]) * back
            step += 1
    return Model(vectors, softmax, bias)


def held_out_by(key: Column, modulus: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


class Scorer(NamedTuple):
    lean: np.ndarray  # each bucket's vector times the difference of the softmax's rows
    bias: float


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """A model of the labelled documents that aren't held out: at most ``sample`` of them.

    Labels that are null or not 0 or 1 are left out, and so is any label of a document that has
    several different ones; of texts with one doc_id the least counts. The sample's texts become
    bucket counts where they lie; one task fits the model, and one number for each bucket comes
    back. Without labels the model is that of no example.
    """
    clean = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other")
    chosen = clean.where(~held_out_by(F.col("doc_id"), 4, 2)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("__id"), "quality")
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "quality", "text")
    found = texts.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text"))
    counted = found.mapInPandas(_sample_features, "doc_id long, quality int, buckets binary, n binary")
    row = counted.repartition(1).sortWithinPartitions("doc_id").mapInPandas(_fit, "lean binary, bias double").first()
    if row is None:
        model = fit([])
        return Scorer((model.vectors @ (model.softmax[1] - model.softmax[0])).astype(np.float32), 0.0)
    return Scorer(np.frombuffer(row.lean, "<f4"), row.bias)


def _parts(text: str | None) -> Iterator[tuple[str, int]]:
    """A long text in parts cut between words. Each begins with the last word of the one before, whose
    own features are then taken off once (-1). Only a word can be longer than a part."""
    text, last = text or "", ""
    while len(text) > 2 * SLICE:
        cut = _GAP.search(text, max(SLICE, len(last) + 1))
        if cut is None:
            break
        head, rest = text[: cut.start()].rstrip(_BLANKS), text[cut.start() :].lstrip(_BLANKS)
        yield head, 1
        last = head[max(head.rfind(c) for c in _BLANKS) + 1 :]
        if last:
            yield last, -1
        text = f"{last} {rest}"
    yield text, 1


def scores(texts: Sequence[str | None], model: Scorer) -> np.ndarray:
    """The softmax's probability of label 1.

    The average of vectors and the product with the softmax may change places, so that one number
    for each feature is enough. Texts are hashed together up to SLICE characters, longer ones in parts."""
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    parts, size = [], 0

    def add() -> None:
        doc, bucket = features([p for _, p, _ in parts])
        owner, sign = np.array([i for i, _, _ in parts])[doc], np.array([s for _, _, s in parts])[doc]
        total[:] += np.bincount(owner, model.lean[bucket] * sign, minlength=len(texts))
        n[:] += np.bincount(owner, sign, minlength=len(texts))
        parts.clear()

    for i, text in enumerate(texts):
        for part, sign in _parts(text):
            parts.append((i, part, sign))
            size += len(part)
            if size >= SLICE:
                add()
                size = 0
    if parts:
        add()
    return 1 / (1 + np.exp(-(total / np.maximum(n, 1) + model.bias)))


@frugal
def _score(batches: Iterable[pd.DataFrame], shared) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.drop(columns="text").assign(score=scores(list(pdf["text"]), shared.value))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    score is the probability of label 1; predicted is 1 from ``threshold`` up. Null, empty and
    blank texts have no features and get the score of the bias. Only the text makes the score:
    repeated texts score alike. A null doc_id is not held out. With no usable label all scores are
    one half. Texts are read whole, in slices of bounded size (or one text).
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    texts = filled(spread(docs.select("doc_id", "text")))
    made = unfilled(texts.mapInPandas(partial(_score, shared=shared), "doc_id long, __no_id boolean, score double"))
    return made.select("doc_id", held_out_by(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@frugal
def _accepted(batches: Iterable[pa.RecordBatch], shared, threshold: float, at: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for a in range(0, whole.num_rows, TOGETHER):
            batch = whole.slice(a, TOGETHER)
            yield batch.filter(pa.array(scores(batch[at].to_pylist(), shared.value) >= threshold))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that classify() predicts to be of label 1, with all their columns, whatever their
    names. Rows of any doc_id, null too, and repeated rows are judged one by one by their texts."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample))
    return spread(docs).mapInArrow(partial(_accepted, shared=shared, threshold=threshold, at=docs.columns.index("text")), docs.schema)


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
