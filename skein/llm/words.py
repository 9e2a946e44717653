"""Word and n-gram kernels over whole Arrow batches.

A *word* is a maximal run of Unicode letters and digits, lower-cased. Texts of a slice are laid end to end as one array of code
points, so finding words, hashing them and hashing n-grams are a handful of NumPy passes with no Python loop per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_CHARS = 1 << 20  # texts are handled in slices of about this many characters; a longer text is a slice of its own

_BASE = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _classes(top: int) -> tuple[np.ndarray, np.ndarray]:
    """For code points below 65,536, or all of them if ``top`` is beyond: whether each belongs to words, and its lower case."""
    size = 1 << 16 if top < 1 << 16 else 0x110000
    if size not in _tables:
        flag, low = np.zeros(size, bool), np.arange(size, dtype=np.uint32)
        for i in range(size):
            c = chr(i)
            if c.isalnum():
                flag[i] = True
                if len(x := c.lower()) == 1:
                    low[i] = ord(x)
        _tables[size] = flag, low
    return _tables[size]


def letters_in(points: np.ndarray) -> np.ndarray:
    """Whether each code point belongs to words."""
    return _classes(int(points.max(initial=0)))[0][points]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of some texts: ``doc`` is the index of the text of each word, ``h`` its 64-bit hash, ``start`` and ``end`` its
    place in ``points``, the lower-cased code points of all texts; ``first`` is where each text begins in ``points``."""

    __slots__ = ("doc", "end", "first", "h", "n", "points", "raw", "start")

    def __init__(self, texts: list[str]):
        self.n = len(texts)
        self.raw = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        lens = np.fromiter(map(len, texts), np.int64, self.n)
        self.first = np.concatenate(([0], np.cumsum(lens + 1)[:-1])) if self.n else np.zeros(0, np.int64)
        if not len(self.raw):
            self.points, self.start = self.raw, np.zeros(0, np.int64)
            self.end, self.doc, self.h = self.start, self.start, np.zeros(0, np.uint64)
            return
        flag, low = _classes(int(self.raw.max()))
        inside = flag[self.raw]
        self.points = low[self.raw]
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.start, self.end = edge[::2], edge[1::2]
        self.doc = np.repeat(np.arange(self.n), np.diff(np.searchsorted(self.start, self.first), append=len(self.start)))
        self.h = self._hashes(inside)

    def _hashes(self, inside: np.ndarray) -> np.ndarray:
        lens = self.end - self.start
        if not len(lens):
            return np.zeros(0, np.uint64)
        at = np.cumsum(lens) - lens
        power = np.full(int(lens.max()), _BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power)
        place = np.arange(int(lens.sum())) - np.repeat(at, lens)
        value = mix(self.points[inside].astype(np.uint64) + np.uint64(0x51ED2701))
        return mix(np.add.reduceat(value * power[place], at) + lens.astype(np.uint64))

    def text(self, i: int) -> str:
        """The word at ``i``."""
        return self.points[self.start[i] : self.end[i]].tobytes().decode("utf-32-le", "surrogatepass")

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every run of ``k`` consecutive words of a text, and the index of the run's first word."""
        n = len(self.h) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        g = np.zeros(n, np.uint64)
        for i in range(k):
            g = g * _BASE + self.h[i : i + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[k - 1 :])
        return mix(g[at] + np.uint64(k)), at


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of consecutive slices of ``texts`` of at most ``limit`` characters each, but of one text at least."""
    begin = total = 0
    for i, t in enumerate(texts):
        if i > begin and total + len(t) > limit:
            yield begin, i
            begin, total = i, 0
        total += len(t)
    if begin < len(texts):
        yield begin, len(texts)
