"""Searches of a stated set of queries against all rows, as matrix products of blocks.

A kernel scores a slice of the corpus against a block of queries; of each query only its ``k`` best rows leave a task. If the queries
are known to fit one block of ``block_bytes`` (their size is measured first), that block is broadcast and the corpus is scanned where it lies. More queries are cut
into blocks and the corpus into slices by hashes of their ids; every slice meets every block in a task of its own, and nothing goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BYTES = 32 << 20

#: What a kernel gives for a slice: (query, row, value), places in the block and in the slice; the greater value is the better.
Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def half_up(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rounded as SQL does, halves away from zero."""
    f = 10.0**digits
    return np.copysign(np.floor(np.abs(x) * f + 0.5) / f, x) + 0.0


def best_columns(score: np.ndarray, k: int, slack: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """(row, column): of each column of a matrix its ``k`` greatest entries, ties and what is within ``slack`` included; -inf is never one."""
    if score.shape[0] > k:
        cut = np.partition(score, -k, axis=0)[-k] - slack
        return np.nonzero((score >= cut) & (score > -np.inf))
    return np.nonzero(score > -np.inf)


class Best:
    """The ``k`` best rows of each query so far: greater values first, then smaller ids."""

    def __init__(self, k: int, queries: int):
        self.k, self.parts, self.held, self.bar = k, [], 0, 0
        self.least = np.full(queries, -np.inf)  # of the k-th of each query so far: what is less can't be among the best

    def add(self, query: np.ndarray, ids: np.ndarray, value: np.ndarray) -> None:
        good = value >= self.least[query]
        if not good.all():
            query, ids, value = query[good], ids[good], value[good]
        if len(query):
            self.parts.append((query, ids, value))
            self.held += len(query)
            if self.held > 2 * self.bar + 200_000:
                self.prune()

    def prune(self) -> None:
        query, ids, value = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((ids, -value, query))
        query = query[order]
        begin = np.maximum.accumulate(np.where(np.diff(query, prepend=-1) != 0, np.arange(len(query)), 0))
        place = np.arange(len(query)) - begin
        self.least[query[place == self.k - 1]] = value[order[place == self.k - 1]]
        keep = order[place < self.k]
        self.parts = [(np.concatenate([p[0] for p in self.parts])[keep], ids[keep], value[keep])]
        self.held = self.bar = len(keep)


def _ids(column: pa.Array) -> np.ndarray:
    return np.asarray(column.to_pylist(), str) if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else np.asarray(column)


def search(queries: DataFrame, corpus: DataFrame, k: int, size: Column, prepare: Callable[[pa.Table], object], score: Callable[[object, pa.RecordBatch, int], Iterator[Found]], block_bytes: int = BLOCK_BYTES, slice_rows: int = 50_000) -> DataFrame:
    """(query_id, id, value): at least the ``k`` best rows of ``corpus`` (id, ...) for each of ``queries`` (query_id, ...), ordered by value, then id.

    ``size`` is the bytes of a query. ``prepare`` makes of a block of queries what ``score`` takes, with a batch of the corpus and k.
    """
    kinds = dict(queries.dtypes)["query_id"], dict(corpus.dtypes)["id"]
    schema = f"query_id {kinds[0]}, id {kinds[1]}, value double"

    def result(best: Best, names: pa.Array, id_type: pa.DataType) -> pa.Table:
        if not best.parts:
            return pa.table({"query_id": names.slice(0, 0), "id": pa.array([], id_type), "value": pa.array([], pa.float64())})
        best.prune()
        query, ids, value = best.parts[0]
        return pa.table({"query_id": names.take(pa.array(query)), "id": pa.array(ids.tolist() if ids.dtype.kind == "U" else ids, id_type), "value": pa.array(value)})

    def visit(best: Best, block: object, batch: pa.RecordBatch) -> None:
        ids = _ids(batch.column("id"))
        for query, row, value in score(block, batch, k):
            best.add(query.astype(np.int64), ids[row], value)

    total = queries.agg(F.count("*").alias("n"), F.sum(size).alias("b")).first()
    blocks = max(1, min(total["n"], -(-int(total["b"] or 0) // block_bytes)))
    if blocks == 1:
        shared = corpus.sparkSession.sparkContext.broadcast(queries.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            block, best, kind = prepare(table), Best(k, table.num_rows), None
            for batch in batches:
                kind = batch.schema.field("id").type
                visit(best, block, batch)
            if kind is not None and best.parts:
                yield from result(best, table.column("query_id").combine_chunks(), kind).to_batches()

        return corpus.mapInArrow(run, schema)
    slices = max(1, -(-corpus.count() // slice_rows))
    part = F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int")
    left = corpus.withColumn("_slice", part).withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("_block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))

    def meet(rows: pa.Table, asked: pa.Table) -> pa.Table:
        best, names = Best(k, asked.num_rows), asked.column("query_id").combine_chunks() if asked.num_rows else pa.array([], asked.schema.field("query_id").type)
        if asked.num_rows and rows.num_rows:
            block = prepare(asked)
            for batch in rows.to_batches(max_chunksize=10_000):
                visit(best, block, batch)
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        return result(best, names, rows.schema.field("id").type)

    return left.groupBy("_slice", "_block").cogroup(right.groupBy("_slice", "_block")).applyInArrow(meet, schema)
