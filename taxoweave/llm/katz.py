"""Katz backoff scores: Good-Turing discounted counts of words and word pairs in partitioned tables.

Texts are read once into chunks of tokens. What a chunk knows is pre-aggregated before anything is
sent: a word or a pair costs one entry for each chunk that has it. Words go to the bucket of their
hash and come back with their counts and numbers; pairs go to the bucket of their first word, where
a context's pairs are all together, so that its discounts and backoff weight are exact; what goes
back to the chunks is one sum for each document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inputs import filled, spread, unfilled
from .quality import held_out_by
from .scratch import drop, keep
from .words import WordHashes, split

#: Tokens of a chunk, and entries that a bucket is meant to hold.
CHUNK, BUCKET = 1_500_000, 1_500_000
#: Counts up to this are discounted.
K = 5
#: No word holds a space.
END = np.uint64(xxhash.xxh3_64_intdigest(b" end "))
UNKNOWN, START = -1, -2


def _pack(x: np.ndarray) -> bytes:
    """Numbers byte by byte, first all lowest ones: most of the higher ones are alike."""
    x = np.ascontiguousarray(x)
    return zstandard.ZstdCompressor(level=3).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _open(data: bytes, kind) -> np.ndarray:
    kind = np.dtype(kind)
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(kind.itemsize, -1).T).view(kind).ravel()


def _small(x: np.ndarray) -> tuple[str, bytes]:
    most = int(x.max(initial=0))
    kind = "u1" if most < 256 else "<u2" if most < 65536 else "<u4" if most < 1 << 32 else "<u8"
    return kind, _pack(x.astype(kind))


# ---- chunks --------------------------------------------------------------------------------


def _chunks(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known, place, made = WordHashes(), TaskContext.get().partitionId(), 0
    ids, none, held, sizes, parts, n = [], [], [], [], [], 0

    def flush():
        tokens = np.concatenate(parts)
        words, local = np.unique(tokens, return_inverse=True)
        learnt = np.repeat(~np.array(held, bool), sizes)
        counts = np.bincount(local[learnt], minlength=len(words))
        kind, packed = _small(counts)
        # tokens as ranks by frequency, which are small numbers mostly
        by_rank = np.argsort(-np.bincount(local, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), "<u4")
        rank[by_rank] = np.arange(len(words))
        return pd.DataFrame([((place << 32) | made, len(tokens), np.array(ids, "<i8").tobytes(), np.array(none, "u1").tobytes(), np.array(held, "u1").tobytes(), np.array(sizes, "<i8").tobytes(), _pack(rank[local]), _pack(by_rank.astype("<u4")), words.astype("<u8").tobytes(), kind, packed)], columns=["chunk", "n", "ids", "none", "held", "sizes", "tokens", "by_rank", "words", "kind_of", "counts"])

    for pdf in batches:
        for doc_id, no_id, out, text in zip(pdf["doc_id"], pdf["__no_id"], pdf["held"], pdf["text"], strict=True):
            h = np.append(known.of([w.lower() for w in split(text)]), END)
            ids.append(doc_id), none.append(no_id), held.append(out), sizes.append(len(h)), parts.append(h)
            n += len(h)
            if n >= CHUNK:
                yield flush()
                made += 1
                ids, none, held, sizes, parts, n = [], [], [], [], [], 0
    if parts:
        yield flush()


_CHUNK = "chunk long, n long, ids binary, none binary, held binary, sizes binary, tokens binary, by_rank binary, words binary, kind_of string, counts binary"


# ---- words ---------------------------------------------------------------------------------


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted bucket numbers."""
    if len(bucket):
        edge = np.flatnonzero(bucket[1:] != bucket[:-1]) + 1
        for a, b in zip([0, *edge], [*edge, len(bucket)]):
            yield int(bucket[a]), int(a), int(b)


def _word_bucket(words: np.ndarray, buckets: int) -> np.ndarray:
    return ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)  # in order of the hash


def _send_words(batches: Iterable[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for r in pdf.itertuples():
            words, counts = np.frombuffer(r.words, "<u8"), _open(r.counts, r.kind_of)
            rows = []
            for b, i, j in _cuts(_word_bucket(words, buckets)):
                rows.append((b, r.chunk, words[i:j].tobytes(), *_small(counts[i:j])))
            yield pd.DataFrame(rows, columns=["bucket", "chunk", "words", "kind_of", "counts"])


def _histogram(counts: np.ndarray) -> list[int]:
    return [int(x) for x in np.bincount(counts[counts <= K + 1], minlength=K + 2)[1:]]


def _grouped(batches: Iterable[pd.DataFrame], by: str) -> Iterator[tuple[int, list]]:
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


def _count_words(batches: Iterable[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """A bucket's words with their counts over all chunks; a reply to each chunk, in its order."""
    for bucket, rows in _grouped(batches, "bucket"):
        words = [np.frombuffer(r.words, "<u8") for r in rows]
        known, back = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(back, np.concatenate([_open(r.counts, r.kind_of) for r in rows]), minlength=len(known)).astype(np.int64)
        number = np.where(total > 0, np.arange(len(known)) * buckets + bucket, UNKNOWN)
        out, a = [], 0
        for r, w in zip(rows, words, strict=True):
            mine = back[a : a + len(w)]
            a += len(w)
            out.append((r.chunk, bucket, _pack(number[mine]), _pack(total[mine].astype("<u4" if total.max() < 1 << 32 else "<u8")), "<u4" if total.max() < 1 << 32 else "<u8", None, 0, 0))
        out.append((-1, bucket, None, None, None, _histogram(total), int((total > 0).sum()), int(total.sum())))
        yield pd.DataFrame(out, columns=["chunk", "bucket", "numbers", "totals", "kind_of", "seen", "types", "tokens"])


_WORDS = "chunk long, bucket int, numbers binary, totals binary, kind_of string, seen array<long>, types long, tokens long"


class Words(NamedTuple):
    """What is known of all words: tokens, types, the discount of each count up to K, the share of unknown ones."""

    tokens: int
    types: int
    keep: np.ndarray
    scale: float
    unknown: float

    def prob(self, count: np.ndarray) -> np.ndarray:
        """Discounted probability of a word with this count; of the unknown word, where it is 0.

        Over all known words and the one unknown it sums to 1."""
        kept = np.where(count <= K, self.keep[np.minimum(count, K)], 1.0)
        return np.where(count > 0, kept * count * self.scale / max(1, self.tokens), self.unknown)


def smoothed(seen: list[int]) -> np.ndarray | None:
    """Numbers of types seen 1 to K + 1 times as Good-Turing needs them: falling, without gaps.

    As in simple Good-Turing (Gale and Sampson) log n(c) is fitted as a line in log c; beside gaps a
    count stands for half the width up to its neighbours. None where the line doesn't fall faster
    than 1 / c, or where fewer than two counts were seen: then no count can be discounted by it."""
    n = np.array(seen, float)
    at = np.flatnonzero(n > 0) + 1.0
    if len(at) < 2:
        return None
    below = np.append(0, at[:-1])
    above = np.append(at[1:], 2 * at[-1] - at[-2])
    slope, start = np.polyfit(np.log(at), np.log(2 * n[n > 0] / (above - below)), 1)
    return np.exp(start + slope * np.log(np.arange(1, K + 2))) if slope < -1 - 1e-9 else None


def discounts(seen: list[int]) -> np.ndarray:
    """Katz's Good-Turing factors of counts 0 to K from the numbers of types seen 1 to K + 1 times.

    These numbers are smoothed first, so that every factor is between 0 and 1. Only where they
    allow no such line (see smoothed(): a handful of words) an absolute discount by the first two
    takes the place of Good-Turing."""
    out, c = np.ones(K + 1), np.arange(1, K + 1)
    n = smoothed(seen)
    if n is not None:
        common = (K + 1) * n[K] / n[0]
        out[1:] = ((c + 1) * n[1:] / n[:-1] / c - common) / (1 - common)
    elif seen[0]:
        out[1:] = 1 - seen[0] / (seen[0] + 2 * seen[1]) * 0.9 / c
    return out


def word_model(seen: list[int], types: int, tokens: int) -> Words:
    keep_ = discounts(seen)
    lost = sum((1 - keep_[c]) * c * seen[c - 1] for c in range(1, K + 1)) / max(1, tokens)
    unknown = max(lost, 1 / (tokens + 1))  # some share is always left for words never seen
    return Words(tokens, types, keep_, (1 - unknown) / (1 - lost) if tokens else 0.0, unknown if tokens else 1.0)


# ---- pairs ---------------------------------------------------------------------------------


def _context_bucket(contexts: np.ndarray, buckets: int) -> np.ndarray:
    x = contexts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _send_pairs(batches: Iterable[pd.DataFrame], buckets: int, model: Words) -> Iterator[pd.DataFrame]:
    """Of each chunk: its documents with what is known of them already, and its pairs by context."""
    names = ["bucket", "chunk", "kind", "n_first", "data", "kinds"]
    for chunk, rows in _grouped(batches, "chunk"):
        text, replies = rows[0], sorted(rows[1:], key=lambda r: r.bucket)
        number = np.concatenate([_open(r.numbers, "<i8") for r in replies])
        total = np.concatenate([_open(r.totals, r.kind_of).astype(np.int64) for r in replies])
        tokens, sizes = _open(text.by_rank, "<u4").astype(np.int64)[_open(text.tokens, "<u4")], np.frombuffer(text.sizes, "<i8")
        learnt = np.repeat(np.frombuffer(text.held, "u1") == 0, sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        count = total[tokens]
        base = np.log10((count + 0.1) / (model.tokens + 0.1 * (model.types + 1)))
        word, first = number[tokens], np.cumsum(sizes) - sizes
        context = np.concatenate([[START], word[:-1]])
        context[first] = START
        # after a word never seen the recursion ends at once
        plain = context == UNKNOWN
        alone = np.bincount(doc[plain], np.log10(model.prob(count[plain])), minlength=len(sizes))
        known = np.bincount(doc, count > 0, minlength=len(sizes)).astype("<i8")
        sums = np.stack([np.bincount(doc, base, minlength=len(sizes)), alone]).astype("<f8")
        docs = b"".join([text.ids, sizes.astype("<i8").tobytes(), known.tobytes(), sums.tobytes(), text.none, text.held])
        yield pd.DataFrame([(int(chunk) % buckets, chunk, 0, len(sizes), docs, None)], columns=names)
        # local numbers of distinct contexts and words, so that a pair is one integer
        c_of, c = np.unique(context[~plain], return_inverse=True)
        w_of, w_at, w = np.unique(word[~plain], return_index=True, return_inverse=True)
        times = count[~plain][w_at]
        pair, back = np.unique(c * len(w_of) + w, return_inverse=True)
        pair_c, pair_w = pair // max(1, len(w_of)), pair % max(1, len(w_of))
        seen = np.bincount(back[learnt[~plain]], minlength=len(pair))
        hit, n_hits = np.unique(back * len(sizes) + doc[~plain], return_counts=True)
        hit_pair, hit_doc = hit // len(sizes), hit % len(sizes)
        bucket = _context_bucket(c_of, buckets)[pair_c]
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(hit_pair, np.arange(len(pair) + 1))
        for b, i, j in _cuts(bucket[order]):
            mine = order[i:j]
            contexts, sizes_of = np.unique(pair_c[mine], return_counts=True)
            per = starts[mine + 1] - starts[mine]
            at = np.repeat(starts[mine] - np.cumsum(per) + per, per) + np.arange(per.sum())
            columns = [_small(sizes_of), _small(times[pair_w[mine]]), _small(seen[mine]), _small(per), _small(hit_doc[at]), _small(n_hits[at])]
            data = [_pack(c_of[contexts].astype("<i8")), _pack(w_of[pair_w[mine]].astype("<i8"))] + [x[1] for x in columns]
            yield pd.DataFrame([(b, chunk, 1, len(sizes), b"".join(len(x).to_bytes(4, "little") + x for x in data), ",".join(x[0] for x in columns))], columns=names)


_PAIRS = "bucket int, chunk long, kind int, n_first long, data binary, kinds string"


def _fields(data: bytes) -> list[bytes]:
    out, a = [], 0
    while a < len(data):
        n = int.from_bytes(data[a : a + 4], "little")
        out.append(data[a + 4 : a + 4 + n])
        a += 4 + n
    return out


def _merge_pairs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A bucket's table: its contexts' pairs with their counts over all chunks, and which documents hold them."""
    names = ["chunk", "kind", "n", "data", "seen"]
    for _, rows in _grouped(batches, "bucket"):
        yield pd.DataFrame([(r.chunk, 0, r.n_first, r.data, None) for r in rows if r.kind == 0], columns=names)
        rows = [r for r in rows if r.kind == 1]
        if not rows:
            continue
        contexts, words, times, seen, pers, docs, hits, chunks = [], [], [], [], [], [], [], []
        for i, r in enumerate(rows):
            kinds = r.kinds.split(",")
            f = _fields(r.data)
            sizes_of, t, s, per, d, h = (_open(x, k) for x, k in zip(f[2:], kinds, strict=True))
            contexts.append(np.repeat(_open(f[0], "<i8"), sizes_of))
            words.append(_open(f[1], "<i8"))
            times.append(t.astype(np.int64)), seen.append(s.astype(np.int64)), pers.append(per.astype(np.int64))
            docs.append(d.astype(np.int64)), hits.append(h.astype(np.int64)), chunks.append(np.full(len(d), i))
        context, word = np.concatenate(contexts), np.concatenate(words)
        order = np.lexsort((word, context))
        context, word = context[order], word[order]
        new = np.append(True, (context[1:] != context[:-1]) | (word[1:] != word[:-1]))
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(new) - 1
        count = np.bincount(pair, np.concatenate(seen)).astype(np.int64)
        size = np.diff(np.append(np.flatnonzero(np.append(True, np.diff(context[new]) != 0)), len(count)))
        hit_pair = np.repeat(pair, np.concatenate(pers))
        by_pair = np.argsort(hit_pair, kind="stable")
        columns = [_small(size), _small(np.concatenate(times)[order][new]), _small(count), _small(np.bincount(hit_pair, minlength=len(count))), _small(np.concatenate(chunks)[by_pair]), _small(np.concatenate(docs)[by_pair]), _small(np.concatenate(hits)[by_pair]), ("<i8", _pack(np.array([r.chunk for r in rows], "<i8"))), ("<i8", _pack(np.array([r.n_first for r in rows], "<i8")))]
        data = b"".join(len(x).to_bytes(4, "little") + x for k, v in columns for x in (k.encode(), v))
        yield pd.DataFrame([(-1, 1, len(count), data, _histogram(count[count > 0]))], columns=names)


_TABLE = "chunk long, kind int, n long, data binary, seen array<long>"


def _score(batches: Iterable[pd.DataFrame], model: Words, keep_: np.ndarray) -> Iterator[pd.DataFrame]:
    """log10 P of the pairs of a bucket, summed for each document."""
    for pdf in batches:
        for r in pdf.itertuples():
            f = _fields(r.data)
            size, times, count, per, chunk, doc, hits, chunks, n_docs = (_open(v, k.decode()) for k, v in zip(f[::2], f[1::2], strict=True))
            count, size = count.astype(np.int64), size.astype(np.int64)
            context = np.repeat(np.arange(len(size)), size)
            low = model.prob(times.astype(np.int64))
            kept = np.where(count <= K, keep_[np.minimum(count, K)], 1.0) * count
            total = np.bincount(context, count, minlength=len(size))
            held = np.bincount(context, kept, minlength=len(size)) / np.maximum(total, 1)
            # every context keeps some share for words it never had
            left = np.maximum(1 - held, 1 / (total + 1))
            others = 1 - np.bincount(context, np.where(count > 0, low, 0), minlength=len(size))
            # a context without learnt pairs passes all on; else what is left is spread over the others
            weight = np.where(total > 0, left / others, 1.0)
            scale = np.where(total > 0, (1 - left) / np.maximum(held, 1e-300), 0.0)
            p = np.where(count > 0, kept / np.maximum(total, 1)[context] * scale[context], weight[context] * low)
            each = np.repeat(np.log10(p), per) * hits
            order = np.argsort(chunk, kind="stable")
            rows = []
            for c, i, j in _cuts(chunk[order].astype(np.int64)):
                at = order[i:j]
                rows.append((int(chunks[c]), 1, int(n_docs[c]), np.bincount(doc[at].astype(np.int64), each[at], minlength=int(n_docs[c])).astype("<f8").tobytes()))
            yield pd.DataFrame(rows, columns=["chunk", "kind", "n", "data"])


def _finish(batches: Iterable[pd.DataFrame], tokens: int) -> Iterator[pd.DataFrame]:
    for _, rows in _grouped(batches, "chunk"):
        first, n = rows[0], rows[0].n
        ids, sizes, known = np.frombuffer(first.data, "<i8", 3 * n).reshape(3, n)
        base, score = np.frombuffer(first.data, "<f8", 2 * n, 24 * n).reshape(2, n)
        none, held = np.frombuffer(first.data, "u1", 2 * n, 40 * n).reshape(2, n)
        score = score.copy()
        for r in rows[1:]:
            score += np.frombuffer(r.data, "<f8")
        yield pd.DataFrame({"doc_id": ids, "__no_id": none > 0, "held_out": held > 0, "n_tokens": sizes, "n_known": known, "train_tokens": tokens, "base_score": base, "score": score})


def score_texts(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words with A-Z in lower case and one end for each text; a null or empty text is its
    end. Documents whose crc32(doc_id as text) mod 10 is 0 are held out; all others are learnt
    from, also rows without a doc_id and each of repeated rows. score is the text's log10
    probability: P(w | v) is the pair's discounted share of v where the pair was learnt, else v's
    backoff weight times P(w), which is the word's discounted share, or the unknown word's, which
    stands for all words never learnt. For each v these sum to 1 over the learnt words and the
    unknown one; v is the start of the text at first. base_score is the sum of
    log10((c + 0.1) / (N + 0.1 (V + 1))). If nothing is learnt, every token is unknown.
    """
    spark = docs.sparkSession
    texts = filled(spread(docs.select("doc_id", "text"))).withColumn("held", held_out_by(F.when(~F.col("__no_id"), F.col("doc_id")), 10, 0))
    chunks = keep(texts.mapInPandas(_chunks, _CHUNK), "chunks")
    n = chunks.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, min(1 << 20, -(-n // BUCKET)))
    tasks = max(buckets, spark.sparkContext.defaultParallelism)
    words = chunks.mapInPandas(partial(_send_words, buckets=buckets), "bucket int, chunk long, words binary, kind_of string, counts binary")
    words = keep(words.repartition(tasks, "bucket").sortWithinPartitions("bucket", "chunk").mapInPandas(partial(_count_words, buckets=buckets), _WORDS), "words")
    known = words.where("chunk = -1")
    seen = known.agg(*[F.sum(F.col("seen")[i]) for i in range(K + 1)], F.sum("types"), F.sum("tokens")).first()
    seen = [x or 0 for x in seen]
    model = word_model(seen[: K + 1], seen[K + 1], seen[K + 2])
    replies = words.where("chunk >= 0").select("chunk", F.lit(1).alias("kind"), "bucket", "numbers", "totals", "kind_of")
    own = chunks.select("chunk", F.lit(0).alias("kind"), F.lit(-1).alias("bucket"), "ids", "none", "held", "sizes", "tokens", "by_rank").unionByName(replies, allowMissingColumns=True)
    met = own.repartition(max(tasks, chunks.rdd.getNumPartitions()), "chunk").sortWithinPartitions("chunk", "kind", "bucket")
    pairs = met.mapInPandas(partial(_send_pairs, buckets=buckets, model=model), _PAIRS)
    table = keep(pairs.repartition(tasks, "bucket").sortWithinPartitions("bucket", "kind").mapInPandas(_merge_pairs, _TABLE), "pairs")
    drop(chunks), drop(words)
    seen = [x or 0 for x in table.where("kind = 1").agg(*[F.sum(F.col("seen")[i]) for i in range(K + 1)]).first()]
    sums = table.where("kind = 1").mapInPandas(partial(_score, model=model, keep_=discounts(seen)), "chunk long, kind int, n long, data binary")
    back = table.where("kind = 0").select("chunk", "kind", "n", "data").unionByName(sums).repartition(tasks, "chunk").sortWithinPartitions("chunk", "kind")
    out = back.mapInPandas(partial(_finish, tokens=model.tokens), "doc_id long, __no_id boolean, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return unfilled(out)


def op7_katz_scores(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
