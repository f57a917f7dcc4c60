"""Substring deduplication: windows of words that an earlier document has too are removed."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import Chunk, chunked, windows
from .inputs import row_mark, spread, unused
from .memory import frugal
from .scratch import drop, keep
from .sketch import Cells, answered
from .words import BASE_2, Rolling, split

WINDOW = 50


def _window_hashes(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    at, doc = windows(chunk, width)
    return (Rolling(width).of(chunk.one)[at] if len(at) else np.zeros(0, np.uint64)), doc


def _runs(starts: np.ndarray) -> np.ndarray:
    """Sorted starts as first and last of each unbroken run."""
    cut = np.flatnonzero(np.diff(starts) > 1)
    return np.stack([starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)]], axis=1).ravel()


def _own_repeats(k, more, doc_id, mark) -> pd.DataFrame:
    """What a task's candidates ask of the others, and what they settle among themselves.

    Of each window only the rows of the task's smallest doc_id are sent on by its hash: the others
    have an earlier document here already and go on as runs, a row for each document. So a window
    that a third of all documents hold costs a row for each task.
    """
    high = more >> np.uint64(32)
    order = np.lexsort((doc_id, high, k))
    k, more, high, doc_id, mark = (x[order] for x in (k, more, high, doc_id, mark))
    new = np.append(True, (k[1:] != k[:-1]) | (high[1:] != high[:-1]))
    least = doc_id[np.flatnonzero(new)][np.cumsum(new) - 1]
    late = np.flatnonzero(doc_id > least)
    ask = np.flatnonzero(doc_id == least)
    rows = pd.DataFrame({"k": k[ask].view(np.int64), "more": more[ask].view(np.int64), "doc_id": doc_id[ask], "mark": mark[ask], "runs": None})
    start = (more[late] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    by_doc = np.lexsort((start, mark[late], doc_id[late]))
    start, ids, marks = start[by_doc], doc_id[late][by_doc], mark[late][by_doc]
    cuts = np.flatnonzero((np.diff(ids) != 0) | (np.diff(marks) != 0)) + 1
    at = np.concatenate([[0], cuts]).astype(np.int64) if len(ids) else np.zeros(0, np.int64)
    found = [_runs(x).astype(np.int32) for x in np.split(start, cuts)] if len(ids) else []
    done = pd.DataFrame({"k": ids[at], "more": 0, "doc_id": ids[at], "mark": marks[at], "runs": found})
    return pd.concat([rows, done], ignore_index=True) if len(done) else rows


def _candidates(chunk: Chunk, cells: Cells, replies: list, width: int) -> Iterator[pd.DataFrame]:
    repeated, _ = cells.flags(replies)
    at, doc = windows(chunk, width)
    here = np.zeros(len(at), bool)
    here[cells.order] = repeated[cells.entry]  # a window that is twice in a document is judged at both places
    pick = np.flatnonzero(here)
    if len(pick):
        at, doc = at[pick], doc[pick]
        other = chunk.one * np.uint64(0xFF51AFD7ED558CCD) ^ chunk.one >> np.uint64(29)
        one, two = Rolling(width).of(chunk.one)[at], Rolling(width, BASE_2).of(other)[at]
        # 64 bits of one hash and 32 of another name the window; the low 32 say where it starts
        more = (two & np.uint64(0xFFFFFFFF00000000)) | (at - chunk.starts[doc]).astype(np.uint64)
        yield _own_repeats(one, more, chunk.ids[doc], chunk.marks[doc])


def repeated_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """A kept table (doc_id, mark, runs): from where to where windows begin that some document with a smaller id has too.

    Texts become chunks of word numbers with a 64-bit hash of each word. A chunk's windows
    go into a count-min sketch, whose merged blocks answer which of them they estimate two or more
    of. As estimates are never too low, all truly repeated windows are among those. What a chunk's
    own documents settle is settled there; the rest are grouped by 96 bits of two hashes of the word
    sequence, which finds the smallest doc_id that has each.
    """
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "mark", "text")
    chunks = chunked(texts, lower=False)
    asked = answered(chunks, partial(_window_hashes, width=width), partial(_candidates, width=width), "k long, more long, doc_id long, mark long, runs array<int>")
    found = keep(asked, "candidates")
    drop(chunks), drop(asked._read)
    same = Window.partitionBy("k", F.shiftright("more", 32))
    first = F.min(F.when(F.col("runs").isNull(), F.col("doc_id"))).over(same)
    hit = found.withColumn("first", first).where("runs is not null or first < doc_id")
    start = F.col("more").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    runs = keep(hit.groupBy("doc_id", "mark").agg(F.flatten(F.collect_list(F.coalesce("runs", F.array(start, start)))).alias("runs")), "runs")
    drop(found)
    return runs


def kept(words: list[bytes], runs, width: int) -> list[bytes]:
    """The words that no window of ``runs`` (first start, last start, ...) covers."""
    if runs is None or not len(runs):
        return words
    at = np.asarray(runs, np.int64)
    edge = np.bincount(at[::2], minlength=len(words) + 1) - np.bincount(at[1::2] + width, minlength=len(words) + 1)
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


@frugal
def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts, the last column, compressed more tightly than a shuffle would; all other columns as they are."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        at = batch.num_columns - 1
        packed = [None if t is None else pack.compress(t.encode("utf-8", "surrogatepass")) for t in batch[at].to_pylist()]
        yield batch.set_column(at, batch.schema.names[at], pa.array(packed, pa.binary()))


@frugal
def _apply(batches: Iterable[pa.RecordBatch], width: int, with_text: bool, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The last two columns, compressed text and runs, become n_words, n_removed, kept_sha256 (and kept_text)."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        n_words, n_removed, digests, texts = [], [], [], []
        own = batch.num_columns - 2
        for packed, runs in zip(batch[own].to_pylist(), batch[own + 1].to_pylist(), strict=True):
            text = None if packed is None else unpack.decompress(packed).decode("utf-8", "surrogatepass")
            words = split(text)
            left = kept(words, runs, width)
            joined = b" ".join(left)
            n_words.append(len(words)), n_removed.append(len(words) - len(left)), digests.append(hashlib.sha256(joined).hexdigest())
            if with_text:
                texts.append(joined.decode("utf-8", "surrogatepass") if len(left) < len(words) else text)
        made = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())] + [pa.array(texts, pa.string())] * with_text
        yield pa.RecordBatch.from_arrays([batch[i] for i in range(own)] + made, names=names)


def dedup_substrings(docs: DataFrame, width: int = WINDOW, text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, the columns ``carry``, n_words, n_removed, kept_sha256 and, with ``text``, kept_text.

    Each word that is covered by a window of ``width`` words whose sequence also starts in a
    document with a smaller doc_id is removed, judged on the input. kept_text is the text itself
    where nothing is removed, else the kept words joined by one space. Null and empty texts and
    texts under ``width`` words lose nothing (a null text has no words and stays null). Rows
    without a doc_id are neither compared nor changed. Rows that share a doc_id don't count as
    earlier than each other. No rows: none. Every word of a text counts, however long it is (a
    text is held whole by one task). A carried column whose name is one of the result's own comes
    out with an underscore before it.
    """
    made = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * text
    renamed = {c: unused(c, [*docs.columns, *made]) if c.lower() in made else c for c in carry}
    docs = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(n) for c, n in renamed.items()])
    carry = tuple(renamed.values())
    mark, hidden_text, hidden_runs, key, own_mark = (unused(n, docs.columns) for n in ("mark", "text_", "runs", "key", "own_mark"))
    rows = spread(docs.select("doc_id", "text", *carry)).withColumn(mark, row_mark(docs))
    runs = repeated_windows(rows.select("doc_id", F.col(mark).alias("mark"), "text"), width)
    runs = runs.select(F.col("doc_id").alias(key), F.col("mark").alias(own_mark), F.col("runs").alias(hidden_runs))
    rows = rows.select("doc_id", *carry, mark, F.col("text").alias(hidden_text))
    schema = T.StructType(rows.schema.fields[:-1] + [T.StructField(hidden_text, T.BinaryType())])
    met = rows.mapInArrow(_packed, schema).join(runs, (F.col("doc_id") == F.col(key)) & (F.col(mark) == F.col(own_mark)), "left")
    met = met.select("doc_id", *carry, hidden_text, hidden_runs)
    made = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType())]
    out = T.StructType(met.schema.fields[:-2] + made + [T.StructField("kept_text", T.StringType())] * text)
    return met.mapInArrow(partial(_apply, width=width, with_text=text, names=out.names), out)


def deduped_rows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs with texts without repeated windows; n_chars, if there is one, is that of the new text.

    Documents of which no word is left are gone. All other columns pass unchanged, whatever their names.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    held = unused("row", ["doc_id", "text"])
    packed = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in others]).alias(held) if others else F.lit(None).cast("int").alias(held))
    left = dedup_substrings(packed, width, carry=(held,)).where("n_removed = 0 or n_removed < n_words")
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in others:
        new["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return left.select(*[new[c].alias(c) if c in new else F.col(held).getField(c).alias(c) for c in docs.columns])


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"), text=False)


ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS ws FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
firsts AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
bad AS (SELECT win.doc_id, list(DISTINCT i) AS starts FROM win JOIN firsts USING (k) WHERE first < win.doc_id GROUP BY 1),
covered AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(s, s + 50)) AS p FROM (SELECT doc_id, unnest(starts) AS s FROM bad)) GROUP BY 1),
left_over AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) x
  LEFT JOIN (SELECT doc_id, unnest(gone) AS p, true AS hit FROM covered) g ON g.doc_id = x.doc_id AND g.p = x.p
  WHERE g.hit IS NULL GROUP BY 1)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(l.n, 0))::BIGINT AS n_removed, sha256(coalesce(l.t, '')) AS kept_sha256
FROM w LEFT JOIN left_over l ON l.doc_id = w.doc_id
"""
