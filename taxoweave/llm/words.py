"""Words of a text and rolling hashes over them."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers (B - 1 has a single factor two, so that orders of words stay apart).
BASE = np.uint64(0x9E3779B97F4A7C13 | 3)
BASE_2 = np.uint64(0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


def split(text: str | None) -> list[bytes]:
    """The runs of anything but space and the controls 9 to 13, in UTF-8; null text has none.

    ``bytes.split`` parts at just these six bytes, and no other character holds one of them.
    """
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a limit so that memory stays bounded."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.limit:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class Rolling:
    """Hashes of all windows of ``width`` words: sum of h[i + j] * base**j, all modulo 2**64."""

    def __init__(self, width: int, base: np.uint64 = BASE):
        self.width, self.base = width, base
        self.inverse = np.uint64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), 4096)
            for name, by in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, by, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def of(self, hashes: np.ndarray) -> np.ndarray:
        n = len(hashes) - self.width + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        self._powers(len(hashes))
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.up[: len(hashes)], dtype=np.uint64, out=sums[1:])
        return mixed((sums[self.width :] - sums[:n]) * self.down[:n])


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
