"""Pairs of names whose matching ratio may reach a threshold, by products of blocks of letters.

All names of a type meet: which of a pair's letters can match is one product of two rows of 0 and 1, so a pair costs a few nanoseconds. A type of many
names is cut into tiles, every two of which meet in a task of their own. The work grows with the square of the names of a type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import hot_keys

ROWS = 16_000  # names of a tile
SLAB = 256  # names compared with a tile at a time
PAIRS = 250_000  # pairs looked at closely at a time
LETTERS = 94  # columns of a product
BITS = 256  # of a name's pairs of neighbouring letters


def _times(row: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each key stands before in its row; 63 and more count as one."""
    order = np.lexsort((key, row))
    r, k, at = row[order], key[order], np.arange(len(order))
    new = np.ones(len(order), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.minimum(out, 63)


class Letters:
    """Names in the order of their length: the letters of each, the first, second and further of a kind apart, as a row of 0 and 1, and its pairs of neighbours as bits."""

    def __init__(self, names: list[str], first: np.ndarray):
        size = np.array([len(x) for x in names], np.int64)
        order = np.argsort(size, kind="stable")
        self.names, self.first, self.size = [names[i] for i in order], first[order], size[order]
        code = np.frombuffer("".join(self.names).encode("utf-32-le"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(names)), self.size)
        kind, at, n = np.unique(code * 64 + _times(row, code), return_inverse=True, return_counts=True)
        column = np.full(len(kind), -1)
        column[np.argsort(-n, kind="stable")[:LETTERS]] = np.arange(min(LETTERS, len(kind)))
        column = column[at]
        self.has = np.zeros((len(names), LETTERS), np.float32)
        self.has[row[column >= 0], column[column >= 0]] = 1
        self.rest = np.bincount(row[column < 0], minlength=len(names))  # letters without a column: they may all match
        pair = np.flatnonzero(row[1:] == row[:-1])
        key = code[pair] << 21 | code[pair + 1]
        mixed = (key * 64 + _times(row[pair], key)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        bits = np.zeros((len(names), BITS), bool)
        bits[row[pair], (mixed >> np.uint64(56)).astype(np.int64) % BITS] = True
        self.bits = np.packbits(bits, axis=1).view(np.uint64)

    def near(self, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of pairs, of names that are first and names that aren't, or of all where all are first, that may have a matching ratio of ``t``.

        Of names of m and n characters at least l = t (m + n) / 2 match, so they have as many letters in common; they match in at most m + n - 2 l + 1 stretches,
        each of which has one pair of neighbours fewer than characters, so at least 3 l - m - n - 1 pairs are common. Bits that only one of the names has
        tell pairs that aren't.
        """
        one, other = np.flatnonzero(self.first), np.flatnonzero(~self.first)
        alone = not len(other)
        other = one if alone else other
        size, half = self.size, t / 2
        wide = (2 - t) / t if t > 0 else np.inf
        ones = np.ones(len(size), np.float32)
        left = np.column_stack([self.has, self.rest - half * size, ones]).astype(np.float32)[one]
        right = np.column_stack([self.has, ones, -half * size]).astype(np.float32)[other]
        for lo in range(0, len(one), SLAB):
            x = one[lo : lo + SLAB]
            begin = max(lo if alone else 0, np.searchsorted(size[other], np.floor(size[x[0]] / wide)))
            end = np.searchsorted(size[other], np.ceil(size[x[-1]] * wide), "right")
            if begin >= end:
                continue
            slack = left[lo : lo + SLAB] @ right[begin:end].T
            hits = np.flatnonzero((slack >= -0.01 - 1e-6 * size[x[-1]]).ravel())
            for at in range(0, len(hits), PAIRS):
                i, j = np.divmod(hits[at : at + PAIRS], end - begin)
                i, j = x[i], other[j + begin]
                if alone:
                    i, j = i[i < j], j[i < j]
                m, n = size[i], size[j]
                common = 3 * np.ceil(half * (m + n) - 1e-9) - m - n - 1
                a, b = self.bits[i], self.bits[j]
                keep = (np.bitwise_count(a & ~b).sum(1, dtype=np.int64) <= m - 1 - common) & (np.bitwise_count(b & ~a).sum(1, dtype=np.int64) <= n - 1 - common)
                yield i[keep], j[keep]


def likely_pairs(n: DataFrame, t: float) -> DataFrame:
    """(entity_type, name_a, name_b): of distinct names (entity_type, name) the pairs of a type, each once, that may have a matching ratio of ``t`` or more, without those of which one
    contains the other."""
    hot = hot_keys(n, "entity_type", rows=ROWS)
    groups = hot.agg(F.sum(F.expr("_tiles * (_tiles + 1) / 2"))).first()[0] or 0
    tiles = F.coalesce("_tiles", F.lit(1))
    own, each = F.pmod(F.xxhash64("name"), tiles).cast("int"), F.explode(F.sequence(F.lit(0), tiles - 1))
    met = n.join(hot, "entity_type", "left").select("entity_type", "name", own.alias("own"), each.alias("each"))
    met = met.select("entity_type", F.least("own", "each").alias("a"), F.greatest("own", "each").alias("b"), (F.col("own") <= F.col("each")).alias("first"), "name")
    parts = max(int(n.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2000, 4 * int(groups)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        kind, letters = table.column("entity_type")[0].as_py(), Letters(table.column("name").to_pylist(), np.asarray(table.column("first")))
        for i, j in letters.near(t):
            pairs = [(min(x, y), max(x, y)) for x, y in ((letters.names[p], letters.names[q]) for p, q in zip(i.tolist(), j.tolist(), strict=True)) if x not in y and y not in x]
            if pairs:
                yield pa.RecordBatch.from_pydict({"entity_type": [kind] * len(pairs), "name_a": [p[0] for p in pairs], "name_b": [p[1] for p in pairs]})

    return met.repartition(parts, "entity_type", "a", "b").groupBy("entity_type", "a", "b").applyInArrow(compare, "entity_type string, name_a string, name_b string")
