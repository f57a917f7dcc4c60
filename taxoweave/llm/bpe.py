"""Byte-pair merges of many words at once.

A tokenizer of the ``tokenizers`` library spends most of its time on one object for each text.
Here the merges of its file are applied to a whole batch of distinct words in numpy; words that
aren't plain runs of letters go through the library. The tests hold both against each other.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Collection
from unicodedata import is_normalized

import numpy as np

NONE = np.int32(1 << 30)
LONGEST = 28
_ENDS = frozenset(".,;:!?*#$%&|-_()\"/+@")


def _byte_letters() -> dict[int, str]:
    """Byte-level tokenizers write a byte as a letter: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class Merges:
    """The merges of a tokenizer file whose words end in ``</w>``, as a table for vectorised look-up."""

    BITS = 18

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + end] for b in range(256)], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 17 | vocab[b] for a, b in pairs], np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        ranks = np.arange(len(pairs), dtype=np.int32)
        # a table of one slot for each hash; pairs whose slot is taken are kept in order beside it
        self.keys, self.ranks, self.made = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, NONE), np.zeros(1 << self.BITS, np.int32)
        slot = self._slot(keys)
        _, first = np.unique(slot, return_index=True)
        self.keys[slot[first]], self.ranks[slot[first]], self.made[slot[first]] = keys[first], ranks[first], made[first]
        rest = np.setdiff1d(np.arange(len(keys)), first)
        rest = rest[np.argsort(keys[rest])]
        self.more, self.more_ranks, self.more_made = keys[rest], ranks[rest], made[rest]
        self.crowded = np.zeros(1 << self.BITS, bool)
        self.crowded[slot[rest]] = True

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE: no merge) and result of each pair."""
        keys = a.astype(np.uint64) << np.uint64(17) | b.astype(np.uint64)
        slot = self._slot(keys)
        same = self.keys[slot] == keys
        rank, made = np.where(same, self.ranks[slot], NONE), self.made[slot]
        odd = np.flatnonzero(~same & self.crowded[slot])
        if len(odd):
            at = np.minimum(np.searchsorted(self.more, keys[odd]), len(self.more) - 1)
            hit = self.more[at] == keys[odd]
            rank[odd[hit]], made[odd[hit]] = self.more_ranks[at[hit]], self.more_made[at[hit]]
        return rank, made

    def apply(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian 32-bit bytes; words of 1 to LONGEST bytes."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        out: list[bytes] = [b""] * len(words)
        for n in np.unique(sizes):
            which = np.flatnonzero(sizes == n)
            raw = np.frombuffer(b"".join([words[i] for i in which]), np.uint8).reshape(len(which), n)
            ids = self.inner[raw]
            ids[:, -1] = self.last[raw[:, -1]]
            left = self._merge(ids)
            flat = ids.astype("<u4").tobytes()
            for i, a, k in zip(which.tolist(), range(0, 4 * n * len(which), 4 * int(n)), left.tolist(), strict=True):
                out[i] = flat[a : a + 4 * k]
        return out

    def _merge(self, ids: np.ndarray) -> np.ndarray:
        """Merge in place, always the pair of lowest rank and of those the first; how many ids are left."""
        n, width = ids.shape
        left = np.full(n, width)
        if width == 1:
            return left
        rank, made = self.find(ids[:, :-1].ravel(), ids[:, 1:].ravel())
        rank, made = rank.reshape(n, width - 1), made.reshape(n, width - 1)
        rows = np.arange(n)
        now, r, m = ids.copy(), rank, made
        columns = np.arange(width)
        while len(rows):
            at = r.argmin(axis=1)
            line = np.arange(len(rows))
            go = r[line, at] < NONE
            if not go.all():
                done = ~go
                ids[rows[done], : now.shape[1]] = now[done]
                rows, now, r, m, at = rows[go], now[go], r[go], m[go], at[go]
                line = np.arange(len(rows))
                if not len(rows):
                    break
            now[line, at] = m[line, at]
            left[rows] -= 1
            # all after the pair moves one place to the left
            take = columns[: now.shape[1] - 1] + (columns[: now.shape[1] - 1] > at[:, None])
            now = np.take_along_axis(now, take, 1)
            if now.shape[1] == 1:
                ids[rows, 0] = now[:, 0]
                break
            take = columns[: r.shape[1] - 1] + (columns[: r.shape[1] - 1] >= at[:, None])
            r, m = np.take_along_axis(r, take, 1), np.take_along_axis(m, take, 1)
            for side in (-1, 0):  # the pairs that the new id is part of
                j = at + side
                ok = np.flatnonzero((j >= 0) & (j < left[rows] - 1))
                if len(ok):
                    r[ok, j[ok]], m[ok, j[ok]] = self.find(now[ok, j[ok]], now[ok, j[ok] + 1])
            over = np.flatnonzero(left[rows] - 1 < r.shape[1])
            if len(over):
                r[over[:, None], np.minimum(np.arange(r.shape[1])[None], r.shape[1] - 1)] = np.where(np.arange(r.shape[1])[None] < left[rows][over, None] - 1, r[over], NONE)
        return left


class WordIds:
    """Token ids of words, as little-endian 32-bit bytes, remembered up to a limit.

    The tokenizer never joins across white space, so a text's ids are its words' ids in a row.
    """

    def __init__(self, path: str, limit: int = 350_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.known: dict[bytes, bytes] = {}
        self.tokenizer, self.merges, self.limit = Tokenizer.from_file(path), Merges(path), limit

    def by_library(self, words: list[bytes]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in coded]

    def learn(self, words: Collection[bytes]) -> None:
        """words: different ones."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
            new = list(words)
        self.known.update(self._worked_out(new))

    def _worked_out(self, new: list[bytes]) -> dict[bytes, bytes]:
        cores: dict[bytes, int] = {b"": 0}  # no end
        number = cores.setdefault
        plain, odd = [], []
        joined = b"\n".join(new).decode("utf-8", "replace")
        lower, composed = joined.lower(), is_normalized("NFC", joined)
        for w, text, low, key in zip(new, joined.split("\n"), lower.split("\n"), lower.encode().split(b"\n"), strict=True) if new else ():
            n = 0
            if not text.isalpha():
                last = text[-1]
                core = text.rstrip(last)
                n = len(text) - len(core)
                if last not in _ENDS or n > LONGEST or not core.isalpha():
                    odd.append(w)
                    continue
                text, low, key = core, low[:-n], key[:-n]
            # a sigma is lowered by its place in the word, and some letters become two
            if len(key) > LONGEST or not text.isascii() and not ((composed or is_normalized("NFC", text)) and "Σ" not in text and low.isalpha()):
                odd.append(w)
                continue
            plain.append((w, number(key, len(cores)), number(w[-n:], len(cores)) if n else 0))
        parts = [b"", *self.merges.apply(list(cores)[1:])]
        out = {w: parts[a] + parts[b] if b else parts[a] for w, a, b in plain}
        for at in range(0, len(odd), 10_000):
            out.update(zip(odd[at : at + 10_000], self.by_library(odd[at : at + 10_000]), strict=True))
        return out

    def each(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some different words. Once the limit is reached, the words known by then stay
        known, which frequent ones are, and others are worked out each time."""
        known = self.known
        fresh = self._worked_out([w for w in words if w not in known])
        if len(known) + len(fresh) <= self.limit:
            known.update(fresh)
        return [known[w] if w in known else fresh[w] for w in words]

    def of(self, words: list[bytes]) -> bytes:
        """Ids of words, in a row, that were learnt just now."""
        return b"".join(map(self.known.__getitem__, words))


@functools.lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for each Python process: tasks that follow find the file read and many words known."""
    return WordIds(path)
