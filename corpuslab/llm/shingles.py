"""Word shingles of whole texts as sets of 64-bit hashes, made by numpy for a batch of texts at once."""

from __future__ import annotations

import numpy as np

#: Words of a shingle.
WORDS = 5
#: Bytes that part words: space and 09 to 0D.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Bytes hashed at a time; longer texts are hashed alone.
STRETCH = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (splitmix64's last steps)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base up to n, and of its inverse modulo 2 ** 64."""
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    out = []
    for b in (_BASE, inverse):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Shingler:
    """Holds tables of powers, which grow with the longest stretch met."""

    def __init__(self) -> None:
        self.up, self.down = _powers(1 << 16)

    def word_hashes(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words in bytes, and where each begins: the polynomial of a word's bytes, mixed."""
        if len(raw) >= len(self.up):
            self.up, self.down = _powers(len(raw) * 5 // 4 + 1)
        blank = _BLANK[raw]
        inside = ~blank
        edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
        starts, ends = edge[::2], edge[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _STEP), starts

    def sets(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the ascending distinct hashes of its shingles: runs of WORDS words, with fewer words the whole
        sequence as one, without words none. A-Z counts as a-z."""
        raws = [t.encode() for t in texts]
        out: list[np.ndarray] = []
        i = 0
        while i < len(raws):
            j, size = i, 0
            while j < len(raws) and (j == i or size + len(raws[j]) < STRETCH):
                size += len(raws[j]) + 1
                j += 1
            out += self._stretch(raws[i:j])
            i = j
        return out

    def _stretch(self, raws: list[bytes]) -> list[np.ndarray]:
        words, starts = self.word_hashes(np.frombuffer(b" ".join(raws) + b" ", np.uint8))
        bounds = np.cumsum([0, *(len(r) + 1 for r in raws)])
        first = np.searchsorted(starts, bounds)
        n = len(words)
        h = np.zeros(max(0, n - WORDS + 1), np.uint64)
        for k in range(WORDS):
            h = (h ^ words[k : n - WORDS + 1 + k]) * _BASE if n >= WORDS else h
        h = mix(h)
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= WORDS:
                out.append(np.unique(h[a : b - WORDS + 1]))
            elif b > a:
                one = np.array([b - a], np.uint64)
                for w in words[a:b]:
                    one = mix((one ^ w) * _BASE)
                out.append(one)
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def shingle_strings(text: str) -> set[tuple[str, ...]]:
    """The same set as tuples of words, by plain Python."""
    words = lower_words(text)
    return {tuple(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)} if len(words) >= WORDS else {tuple(words)} if words else set()


_BLANKS = str.maketrans("\t\n\x0b\x0c\r", "     ")
_CAPITALS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_words(text: str) -> list[str]:
    return [w for w in text.translate(_CAPITALS).translate(_BLANKS).split(" ") if w]
