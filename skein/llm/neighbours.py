"""Problem 4: the most similar vectors for every vector.

Index: p-stable hashing. A table has m Gaussian projections of the unit vector, cut into cells of width w; the m cells name a
bucket. A wall of each projection lies at the mean of the vectors, so that buckets are even; it is taken of a sample of about ``fit_rows``
vectors, all of them are filed. A
vector is filed in its own bucket and in the neighbouring buckets likeliest to hold its neighbours: moving projection i by one
cell costs the squared distance to that wall, and sets of moves are visited in the order of their summed cost (query-directed
multiprobe). As every vector is filed under all its probes, two vectors meet where any of their probes agree.

How many projections, probes and tables there are follows from the collision curve (:func:`plan`): of all settings whose buckets
hold about an eighth of the vectors (1,500 at least, ``coarse_rows`` at most), the one that ships a vector least often and finds a pair of
similarity ``similarity`` with probability ``recall``. A bucket of more than ``fine_rows`` is visited in memory by tables of its
own, planned by the same curve. Vectors that meet are compared as matrix products, and the candidates of all tables are merged
and reranked by the exact cosine in double precision.

Scale: by the curve, at a recall of 0.9 for a similarity of 0.72 in 96 dimensions, a vector is shipped 4 times up to a million
vectors and then about n^0.4 times in proportion, as the collision curve of Gaussian projections demands; no task holds more than
a bucket. A bucket of more than ``hot_rows`` rows (vectors crowd there) is split again by tables with its own mean and
spread, up to ``levels`` times, and what is still hot then is cut into tiles whose pairs are all visited, which is exact. Exactly equal vectors
share all their buckets and are one vector there, until the end.

Only arrays of ``dim`` finite values, not all zero, take part; null, empty, shorter, longer, NaN or zero vectors give no rows.
Ties in similarity (rounded to 6 decimals) go to the smaller id. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.tables import written

from .words import mix

WIDTH = 6.0  # of a cell, in standard deviations of a projection of a random unit vector
PROBES = (1, 2, 3, 4, 6, 8)
BLOCK = 2048
BELOW = np.tri(BLOCK, dtype=bool)


def usable(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, v): the vectors that take part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return _sized(df, id_col, vector_col, dim).where(~bad & F.exists("v", lambda x: x != 0))


def _sized(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    return df.select(F.col(id_col).cast("string").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where((F.size("v") == dim) & F.col("id").isNotNull())


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float32).reshape(-1, dim)


def _blobs(column: pa.Array, dim: int) -> np.ndarray:
    """Binary values of ``dim`` floats each as a matrix."""
    offsets, data = column.buffers()[1:]
    begin = int(np.frombuffer(offsets, np.int32)[column.offset]) if len(column) else 0
    return np.frombuffer(data, "<f4", len(column) * dim, begin).reshape(-1, dim) if len(column) else np.zeros((0, dim), np.float32)


def _move_sets(m: int) -> list[tuple[int, ...]]:
    """Sets of ranks in the sorted list of single moves, those that can come first in the order of summed cost."""
    n = min(2 * m, 8)
    return [(), *((i,) for i in range(n)), *itertools.combinations(range(min(n, 6)), 2), *itertools.combinations(range(min(n, 4)), 3)]


class Table:
    """One table of p-stable hash functions for unit vectors of ``dim`` numbers, spread around ``centre`` by ``scale``."""

    def __init__(self, dim: int, m: int, probes: int, seed: int, width: float = WIDTH, centre: np.ndarray | None = None, scale: float = 1.0):
        rng = np.random.default_rng(seed)
        self.m, self.width = min(m, dim), width
        self.axes = (np.linalg.qr(rng.normal(size=(dim, self.m)))[0] * (math.sqrt(dim) / scale)).astype(np.float32)
        self.shift = np.zeros(self.m, np.float32) if centre is None else -(centre @ self.axes).astype(np.float32)
        self.mult = rng.integers(1, 1 << 62, self.m).astype(np.uint64) | np.uint64(1)
        self.salt = np.array([seed], np.uint64)
        self.sets = _move_sets(self.m)
        self.probes = min(probes, len(self.sets))

    def buckets(self, x: np.ndarray) -> np.ndarray:
        """The probed buckets of each unit vector in the estimated order of success, as (n, probes) longs."""
        p = x @ self.axes + self.shift
        cell = np.floor(p / self.width)
        low = p - cell * self.width
        home = (cell.astype(np.int64).view(np.uint64) * self.mult).sum(1)
        if self.probes == 1:
            return mix(home[:, None] + mix(self.salt)).view(np.int64)
        cost = np.concatenate([low**2, (self.width - low) ** 2], 1)
        ranks = np.argsort(cost, 1)[:, : min(8, 2 * self.m)]
        cost = np.take_along_axis(cost, ranks, 1)
        step = np.concatenate([np.uint64(0) - self.mult, self.mult])[ranks]
        total = np.zeros((len(x), len(self.sets)), np.float32)
        moved = np.zeros((len(x), len(self.sets)), np.uint64)
        for i, s in enumerate(self.sets):
            for j in s:
                total[:, i] += cost[:, j]
                moved[:, i] += step[:, j]
            for a, b in itertools.combinations(s, 2):  # both walls of one cell can't be crossed at once
                total[(ranks[:, a] % self.m) == (ranks[:, b] % self.m), i] = np.inf
        best = np.argsort(total, 1, kind="stable")[:, : self.probes]
        return mix(home[:, None] + np.take_along_axis(moved, best, 1) + mix(self.salt)).view(np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@lru_cache(4096)
def collision(dim: int, m: int, probes: int, similarity: float) -> float:
    """The probability that two unit vectors of a similarity share a probe of a table, from 4,000 random pairs."""
    if m == 0:
        return 1.0
    rng = np.random.default_rng(29)
    a, r = unit(rng.normal(size=(2000, dim))), rng.normal(size=(2000, dim))
    r = unit(r - (r * a).sum(1, keepdims=True) * a)
    x, y = a.astype(np.float32), (similarity * a + math.sqrt(1 - similarity**2) * r).astype(np.float32)
    met = []
    for seed in (31, 37):
        t = Table(dim, m, probes, seed)
        met.append((t.buckets(x)[:, :, None] == t.buckets(y)[:, None, :]).any((1, 2)).mean())
    return float(np.mean(met))


@lru_cache(4096)
def plan(n: int, dim: int, rows: int, recall: float, similarity: float, work: float = 0.0) -> tuple[int, int, int]:
    """(projections, probes, tables) for buckets of at most ``rows`` of ``n`` vectors and a pair of ``similarity`` meeting with probability ``recall``: the setting
    with the fewest copies of a vector; with ``work`` the one with the least comparisons, a copy costing as much as that many."""
    best = None
    for probes in PROBES if dim > 1 else (1,):
        m = max(0, math.ceil(math.log2(max(1.0, n * probes / rows)) - 0.1))
        for m in ((m,) if not work else range(m, m + 8)):
            if m > dim or m == 0 and probes > 1 or probes > m + 1:
                continue
            p = collision(dim, m, probes, similarity)
            tables = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log(1 - max(p, 1e-6)))
            size = n * probes / 2**m
            cost = (tables * probes * (work + size) if work else tables * probes, tables * probes * size)
            best = min(best or (cost, m, probes, tables), (cost, m, probes, tables))
    return best[1:] if best else (dim, 2, 2)


class Index:
    """The tables that hash the vectors of one bucket of the level before, or of all."""

    def __init__(self, dim: int, n: int, centre: np.ndarray, bucket_rows: int, recall: float, similarity: float, seed: int):
        apart = max(1e-12, 1 - float(centre @ centre))  # the mean squared distance of unit vectors from their mean
        within = similarity if apart < 0.25 else min(0.95, max(0.3, (similarity - (1 - apart)) / apart))
        self.rows = (m, probes, tables) = plan(n, dim, bucket_rows, recall, round(within, 2))
        self.tables = [Table(dim, m, probes, seed + i, centre=centre, scale=math.sqrt(apart)) for i in range(tables)] if m else []
        self.whole = np.array([seed], np.uint64).view(np.int64)

    def buckets(self, x: np.ndarray) -> np.ndarray:
        if not self.tables:
            return np.broadcast_to(self.whole, (len(x), 1))
        return np.concatenate([t.buckets(x) for t in self.tables], 1)


def _keys(x: np.ndarray) -> np.ndarray:
    """A hash of each row; equal rows have equal ones."""
    mult = np.random.default_rng(5).integers(1, 1 << 62, x.shape[1]).astype(np.uint64) | np.uint64(1)
    return mix((np.ascontiguousarray(x, "<f4").view("<u4") * mult).sum(1))


def _once(key: np.ndarray, ids: pa.Array) -> np.ndarray:
    """One row for each key, that of the smallest id."""
    order = np.argsort(key, kind="stable")
    begin = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1]))) if len(key) else order
    out = order[begin]
    size = np.diff(np.append(begin, len(key)))
    for g in np.flatnonzero(size > 1).tolist():
        same = order[begin[g] : begin[g] + size[g]]
        names = ids.take(pa.array(same)).to_pylist()
        out[g] = same[names.index(min(names))]
    return out


def _batches(batches: Iterator[pa.RecordBatch], dim: int, size: int = 8192) -> Iterator[tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """(outer bucket, id, key, vectors) of the usable vectors of (bucket, id, v): of equal ones of a batch and bucket one."""
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            batch = whole.slice(at, size)
            x = (_blobs(batch.column(2), dim) if pa.types.is_binary(batch.column(2).type) else matrix(batch.column(2), dim)) + np.float32(0)
            good = np.flatnonzero(np.isfinite(x).all(1) & x.any(1))
            outer, ids, x = np.asarray(batch.column(0))[good], batch.column(1).take(pa.array(good)), x[good]
            key = _keys(x)
            once = _once(mix(outer.view(np.uint64)) ^ key, ids)
            yield outer[once], ids.take(pa.array(once)), key[once], x[once]


def _sums(dim: int):
    """(bucket, n, total): how many vectors a task holds of each bucket, and the sum of the unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for outer, _, _, x in _batches(batches, dim):
            u = unit(x)
            for b in np.unique(outer).tolist():
                mine = u[outer == b]
                row = held.setdefault(b, [0, np.zeros(dim)])
                row[0] += len(mine)
                row[1] += mine.sum(0)
        yield pa.record_batch([pa.array(list(held), pa.int64()), pa.array([r[0] for r in held.values()], pa.int64()), pa.array([r[1].tolist() for r in held.values()], pa.list_(pa.float64()))], names=["bucket", "n", "total"])

    return run, "bucket bigint, n bigint, total array<double>"


def _indexes(rows: DataFrame, dim: int, every: int, **how) -> dict[int, Index]:
    """An index for each bucket of ``rows`` (bucket, id, v), around the mean of one in ``every`` vectors. One row a bucket and task leaves the workers,
    and one a bucket and dimension goes to the driver, of as many buckets as are hot."""
    run, schema = _sums(dim)
    rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0) if every > 1 else rows
    summed = rows.mapInArrow(run, schema).select("bucket", "n", F.posexplode("total").alias("at", "x")).groupBy("bucket", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    n: dict[int, int] = {}
    total: dict[int, np.ndarray] = {}
    for b, at, c, x in summed.collect():
        n[b] = c * every
        total.setdefault(b, np.zeros(dim))[at] = x
    return {b: Index(dim, c, total[b] * every / c, min(how["coarse_rows"], how["hot_rows"], max(1500, c // 8)), how["recall"], how["similarity"], how["seed"]) for b, c in n.items() if c}


def _hashed(outer: np.ndarray, x: np.ndarray, index: dict[int, Index]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their buckets as a matrix) for the rows of each outer bucket."""
    u = unit(x).astype(np.float32)
    for b in np.unique(outer).tolist():
        mine = np.flatnonzero(outer == b)
        yield mine, mix((index[b].buckets(u[mine]).view(np.uint64) ^ mix(np.array([b], np.int64).view(np.uint64))) + np.uint64(1)).view(np.int64)


def _counts(dim: int, index: dict[int, Index]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, int] = {}
        for outer, _, _, x in _batches(batches, dim):
            for _, b in _hashed(outer, x, index):
                for k, c in zip(*(a.tolist() for a in np.unique(b, return_counts=True)), strict=True):
                    held[k] = held.get(k, 0) + c
        yield pa.record_batch([pa.array(list(held), pa.int64()), pa.array(list(held.values()), pa.int64())], names=["bucket", "n"])

    return run, "bucket bigint, n bigint"


def _file(dim: int, index: dict[int, Index], hot: dict[int, int], want_hot: bool, tiles_of: int | None = None):
    """(bucket, part, id, v): vectors under their buckets, those of hot ones only if ``want_hot``; with ``tiles_of`` hot buckets are cut into
    tiles of that many rows, and a vector goes to all pairs of tiles it belongs to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowded = np.array(sorted(hot), np.int64)
        for outer, ids, key, x in _batches(batches, dim, 2048):
            rows, buckets = [], []
            for mine, b in _hashed(outer, x, index):
                rows.append(np.repeat(mine, b.shape[1]))
                buckets.append(b.ravel())
            if not rows:
                continue
            at, b = np.concatenate(rows), np.concatenate(buckets)
            part = np.zeros(len(at), np.int64)
            is_hot = np.isin(b, crowded)
            if tiles_of is None:
                keep = is_hot == want_hot
                at, b, part = at[keep], b[keep], part[keep]
            elif is_hot.any():
                more = [(at[~is_hot], b[~is_hot], part[~is_hot])]
                for i in np.flatnonzero(is_hot).tolist():
                    n = math.ceil(hot[int(b[i])] / tiles_of)
                    mine, other = int(key[at[i]]) % n, np.arange(n)
                    more.append((np.full(n, at[i]), np.full(n, b[i]), np.minimum(mine, other) * n + np.maximum(mine, other)))
                at, b, part = (np.concatenate(c) for c in zip(*more, strict=True))
            blobs = np.ascontiguousarray(x[at], "<f4")
            offsets = np.arange(0, (len(at) + 1) * dim * 4, dim * 4, dtype=np.int32)
            yield pa.record_batch([pa.array(b), pa.array(part), ids.take(pa.array(at)), pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(blobs)])], names=["bucket", "part", "id", "v"])

    return run, "bucket bigint, part bigint, id string, v binary"


def _near_in(x: np.ndarray, groups: Iterator[np.ndarray], k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, other row) that meet in some group: of each row at least the ``k`` most similar beyond ``floor``, ties included."""
    least = np.full(len(x), floor, np.float32)  # below which a row needs no more neighbours
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def trimmed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, s = (np.concatenate(c) for c in zip(*found, strict=True))
        _, once = np.unique(i * len(x) + j, return_index=True)
        i, j, s = i[once], j[once], s[once]
        order = np.lexsort((-s, i))
        i, j, s = i[order], j[order], s[order]
        begin = np.flatnonzero(np.diff(i, prepend=-1))
        size = np.diff(np.append(begin, len(i)))
        last = s[begin + np.minimum(k, size) - 1] - 4e-6
        full = size >= k
        least[i[begin[full]]] = np.maximum(least[i[begin[full]]], last[full])
        ok = s >= np.repeat(last, size)
        return i[ok], j[ok], s[ok]

    held = 0
    for g in groups:
        y = x[g]
        for lo, co in ((a, b) for a in range(0, len(g), BLOCK) for b in range(a, len(g), BLOCK)):
            dots = y[lo : lo + BLOCK] @ y[co : co + BLOCK].T
            if lo == co:
                np.copyto(dots, -2, where=BELOW[: len(dots), : len(dots)])
            rows, columns = g[lo : lo + BLOCK], g[co : co + BLOCK]
            either = dots >= min(float(least[rows].min()), float(least[columns].min()))
            if np.count_nonzero(either) > 16 * (len(rows) + len(columns)):  # many pass: raise the bars by the k best of this block
                for who, axis in ((rows, 1), (columns, 0)):
                    if dots.shape[axis] > k:
                        bar = np.partition(dots, -k, axis=axis)
                        bar = (bar[:, -k] if axis else bar[-k]) - 4e-6
                        least[who] = np.maximum(least[who], bar)
                either = (dots >= least[rows][:, None]) | (dots >= least[columns][None, :])
            flat = np.flatnonzero(either.ravel())
            i, j = flat // dots.shape[1], flat % dots.shape[1]
            s = dots.ravel()[flat]
            forth, back = s >= least[rows[i]], s >= least[columns[j]]
            found.append((np.concatenate([rows[i[forth]], columns[j[back]]]), np.concatenate([columns[j[forth]], rows[i[back]]]), np.concatenate([s[forth], s[back]])))
            held += len(found[-1][0])
            if held > 4_000_000:
                found = [trimmed()]
                held = len(found[0][0])
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j, _ = trimmed()
    return i, j


def _visit(dim: int, k: int, min_similarity: float | None, recall: float, similarity: float, fine_rows: int, seed: int):
    floor = -1.5 if min_similarity is None else min_similarity - 2e-6

    def groups(x: np.ndarray) -> Iterator[np.ndarray]:
        if len(x) <= fine_rows:
            yield np.arange(len(x))
            return
        centre = x.mean(0, dtype=np.float64)
        apart = max(1e-12, 1 - float(centre @ centre))
        rounded = 1 << max(0, round(2 * math.log2(len(x))) // 2)
        m, probes, tables = plan(rounded, dim, fine_rows, recall, round(similarity, 2), 500.0)
        for t in range(tables):
            table = Table(dim, m, probes, seed + 1000 + t, centre=centre, scale=math.sqrt(apart))
            b = np.concatenate([table.buckets(x[lo : lo + 4096]) for lo in range(0, len(x), 4096)]).ravel()
            who = np.repeat(np.arange(len(x)), table.probes)
            order = np.argsort(b, kind="stable")
            for g in np.split(who[order], np.flatnonzero(np.diff(b[order])) + 1):
                if len(g) > 1:
                    yield g

    def of(ids: pa.Array, x: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
        once = _once(_keys(x), ids)
        ids, exact = ids.take(pa.array(once)), unit(x[once])
        i, j = _near_in(exact.astype(np.float32), groups(exact.astype(np.float32)), k, floor)
        s = np.concatenate([np.zeros(0), *((exact[i[lo : lo + 65536]] * exact[j[lo : lo + 65536]]).sum(1) for lo in range(0, len(i), 65536))])
        s = np.round(s, 6)
        if len(i):  # the k best of each row over all tables, ties included
            order = np.lexsort((-s, i))
            i, j, s = i[order], j[order], s[order]
            begin = np.flatnonzero(np.diff(i, prepend=-1))
            last = np.minimum(begin + k, np.append(begin[1:], len(i))) - 1
            ok = (s >= np.repeat(s[last], np.diff(np.append(begin, len(i))))) & (s >= (-1.5 if min_similarity is None else min_similarity))
            i, j, s = i[ok], j[ok], s[ok]
        return ids.take(pa.array(i)), ids.take(pa.array(j)), s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []
        here = None

        def emit() -> Iterator[pa.RecordBatch]:
            if held:
                a, b, s = of(pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                held.clear()
                for lo in range(0, len(a), 100_000):
                    yield pa.record_batch([a[lo : lo + 100_000], b[lo : lo + 100_000], pa.array(s[lo : lo + 100_000])], names=["a", "b", "similarity"])

        for batch in batches:
            place = np.stack([np.asarray(batch.column("bucket")), np.asarray(batch.column("part"))], 1)
            ids, x = batch.column("id"), _blobs(batch.column("v"), dim)
            edge = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1).tolist(), len(place)]
            for lo, hi in itertools.pairwise(edge):
                if hi > lo:
                    if (now := tuple(place[lo].tolist())) != here:
                        yield from emit()
                        here = now
                    held.append((ids[lo:hi], x[lo:hi].copy()))
        yield from emit()

    return run, "a string, b string, similarity double"


def nearest(
    df: DataFrame, id_col: str, vector_col: str, dim: int, k: int = 10, min_similarity: float | None = None, recall: float = 0.9, similarity: float = 0.72,
    coarse_rows: int = 128_000, fine_rows: int = 24_000, hot_rows: int = 256_000, levels: int = 3, fit_rows: int = 20_000, seed: int = 11,
) -> DataFrame:
    """(id, neighbour, similarity, rank): for every usable vector its ``k`` most similar others of ``min_similarity`` or more, rank from 1."""
    rows = _sized(df, id_col, vector_col, dim).select(F.lit(0).cast("long").alias("bucket"), "id", "v")
    every = max(1, df.count() // fit_rows)
    visit, found_schema = _visit(dim, k, min_similarity, 1 - (1 - recall) / 4, similarity, fine_rows, seed)
    sims = None
    for level in range(levels + 1):
        index = _indexes(rows, dim, every if level == 0 else 1, coarse_rows=coarse_rows, hot_rows=hot_rows, recall=recall, similarity=similarity, seed=seed + 100 * level)
        run, schema = _counts(dim, index)
        # at most copies * n / hot_rows buckets are hot
        hot = {r["bucket"]: r["n"] for r in rows.mapInArrow(run, schema).groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > hot_rows).collect()}
        run, schema = _file(dim, index, hot, False, hot_rows // 2 if level == levels else None)
        met = rows.mapInArrow(run, schema).repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(visit, found_schema)
        sims = met if sims is None else sims.unionByName(met)
        if not hot or level == levels:
            break
        run, schema = _file(dim, index, hot, True)
        rows = written(rows.mapInArrow(run, schema).select("bucket", "id", "v"))
    best = sims.repartition("a").dropDuplicates(["a", "b"]).withColumn("r", F.rank().over(Window.partitionBy("a").orderBy(F.desc("similarity")))).where(F.col("r") <= k).drop("r")
    return _lists(usable(df, id_col, vector_col, dim).select("id", F.xxhash64("v").alias("k")), written(best), k)


def _lists(ids: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """The k best of every id, from the best of the smallest id of each set of equal vectors. Of a vector stored many times only the k + 1
    smallest ids can be anyone's neighbour, so only those are expanded."""
    again = written(ids.join(ids.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("rep")).where("n > 1").select("k", "rep"), "k").select("rep", "id"))
    first = again.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).groupBy("rep").agg(F.collect_list("id").alias("ids"))
    order = [F.desc("similarity"), F.asc("neighbour")]
    near = best.join(first.withColumnRenamed("rep", "b"), "b", "left").select("a", F.explode(F.coalesce("ids", F.array("b"))).alias("neighbour"), "similarity")
    own = first.select(F.col("rep").alias("a"), F.explode("ids").alias("neighbour"), F.lit(1.0).alias("similarity"))
    listed = near.unionByName(own).withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(*order))).where(F.col("rank") <= k + 1)
    copied = first.select(F.col("rep").alias("a"))
    single = listed.join(copied, "a", "left_anti").where(F.col("rank") <= k).select(F.col("a").alias("id"), "neighbour", "similarity", "rank")
    members = listed.join(again.withColumnRenamed("rep", "a"), "a").where(F.col("id") != F.col("neighbour"))
    members = members.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(*order))).where(F.col("rank") <= k).select("id", "neighbour", "similarity", "rank")
    return single.unionByName(members)
