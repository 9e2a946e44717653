"""Dense search: a stated set of query vectors against all rows, as matrix products of blocks (see :mod:`.blocks`).

Queries are (query_id, query_vec), corpora (id, vec). Vectors are compared with those of their own length only. Null vectors and those with null or NaN
elements take no part. ``where`` is a condition on the corpus that holds before the best are chosen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.vectors import norm

from .blocks import BLOCK_BYTES, Found, best_columns, half_up, search
from .ranking import top

CELLS = 1 << 20  # of a product that are held at a time


def _by_length(column: pa.Array | pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The usable vectors of each length, as places and a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.asarray(column.value_lengths().fill_null(-1))
    out = {}
    for n in np.unique(size[size > 0]).tolist():
        at = np.flatnonzero(size == n)
        x = np.asarray(column.take(pa.array(at)).flatten(), np.float64).reshape(-1, n)
        good = np.isfinite(x).all(1)
        out[n] = at[good], x[good]
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(n > 0, n, 1)


def _cosines(block: dict, batch: pa.RecordBatch, k: int) -> Iterator[Found]:
    for n, (row, x) in _by_length(batch.column("vec")).items():
        if n in block:
            query, q = block[n]
            unit, step = _unit(x), max(1, CELLS // len(x)) if len(x) else 1
            for lo in range(0, len(q), step):
                s = half_up(unit @ q[lo : lo + step].T)
                i, j = best_columns(s, k, 0)
                yield query[j + lo], row[i], s[i, j]


def _distances(block: dict, batch: pa.RecordBatch, k: int) -> Iterator[Found]:
    for n, (row, x) in _by_length(batch.column("vec")).items():
        if n in block:
            query, q = block[n]
            sizes = (x * x).sum(1)[:, None] + (q * q).sum(1)
            i, j = best_columns(2 * (x @ q.T) - sizes, k, 2e-6 + 1e-9 * float(sizes.max(initial=0)))
            for lo in range(0, len(i), 100_000):  # the product only chooses; distances are summed exactly
                a, b = i[lo : lo + 100_000], j[lo : lo + 100_000]
                yield query[b], row[a], -half_up(((x[a] - q[b]) ** 2).sum(1))


def _rows(queries: DataFrame, corpus: DataFrame, where: Column | None) -> tuple[DataFrame, DataFrame]:
    kept = corpus if where is None else corpus.where(where)
    vector = lambda c: F.col(c).cast("array<double>").alias(c)
    return queries.where("query_vec is not null").select("query_id", vector("query_vec")), kept.where("vec is not null").select("id", vector("vec"))


def _searched(queries: DataFrame, corpus: DataFrame, k: int, prepare: Callable, score: Callable, block_bytes: int) -> DataFrame:
    return search(queries, corpus, k, 8 * F.size("query_vec") + 16, prepare, score, block_bytes)


def cosine_topk(queries: DataFrame, corpus: DataFrame, k: int, exclude_self: bool = False, where: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, id, similarity, semantic_score, rank): the ``k`` rows most similar to each query; semantic_score is the distance 1 - similarity.

    A query of no length or null has no results; rows of no length have similarity 0; null rows take no part.
    """
    q, c = _rows(queries, corpus, where)
    q = q.where(norm(F.col("query_vec")) > 0)
    found = _searched(q, c, k + exclude_self, lambda t: {n: (at, _unit(x)) for n, (at, x) in _by_length(t.column("query_vec")).items()}, _cosines, block_bytes)
    found = found.where("id <> query_id") if exclude_self else found
    return top(found.withColumnRenamed("value", "similarity"), k, F.col("similarity")).select("query_id", "id", "similarity", F.round(1 - F.col("similarity"), 6).alias("semantic_score"), "rank")


def l2_topk(queries: DataFrame, corpus: DataFrame, k: int, where: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, id, distance, raw_score, rank) by summed squared differences; raw_score is 100 / (1 + distance)."""
    q, c = _rows(queries, corpus, where)
    out = _searched(q, c, k, lambda t: _by_length(t.column("query_vec")), _distances, block_bytes).select("query_id", "id", (-F.col("value")).alias("distance"))
    return top(out, k, -F.col("distance")).select("query_id", "id", "distance", F.round(100 / (1 + F.col("distance")), 6).alias("raw_score"), "rank")


def cosine_topk_blocks(queries: DataFrame, corpus: DataFrame, dim: int, k: int, block_bytes: int = 4096) -> DataFrame:
    """As :func:`cosine_topk` for vectors of ``dim`` numbers, in blocks of few queries: the way of query sets that fit no broadcast."""
    return cosine_topk(queries.where(F.size("query_vec") == dim), corpus.where(F.size("vec") == dim), k, block_bytes=block_bytes).drop("semantic_score")


def self_recall(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(queries, hits, recall_percent): for how many queries, rows of the corpus themselves, the first result is the row itself."""
    first = cosine_topk(queries, corpus, 1)
    return first.agg(F.count("*").alias("queries"), F.sum((F.col("id") == F.col("query_id")).cast("int")).alias("hits")).select("queries", F.coalesce("hits", F.lit(0)).alias("hits"), F.round(100.0 * F.col("hits") / F.nullif("queries", F.lit(0)), 6).alias("recall_percent"))
