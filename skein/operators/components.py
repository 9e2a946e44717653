"""Connected components of an edge table: the edges of each task shrunk to a forest, what is left joined in one task or, if it is much, by alternating large-star and small-star contractions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.tables import written

FOLD = 32 << 20  # bytes of edges that a task shrinks at a time
WHOLE = 96 << 20  # bytes of edges that one task joins
PLAIN = ("string", "tinyint", "smallint", "int", "bigint")  # nodes that Arrow orders as Spark does


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of ``n`` nodes is connected to by the edges."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return root


def _forest(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Edges (u, v) to a star of each component of a task, its nodes with the smallest; ``whole``: the smallest with itself too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        size = 0

        def shrunk(last: bool) -> pa.Table:
            edges = pa.concat_tables(kept)
            both = pa.chunked_array([*edges.column(0).chunks, *edges.column(1).chunks], edges.schema.field(0).type)
            coded = both.dictionary_encode().combine_chunks()
            coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
            order = pc.sort_indices(coded.dictionary)
            nodes, rank = coded.dictionary.take(order), np.empty(len(order), np.int64)
            rank[np.asarray(order)] = np.arange(len(order))
            at = rank[np.asarray(coded.indices)]
            root = _roots(at[: len(edges)], at[len(edges) :], len(nodes))
            shown = np.arange(len(nodes)) if last and whole else np.flatnonzero(root != np.arange(len(nodes)))
            return pa.table({"u": nodes.take(pa.array(shown)), "v": nodes.take(pa.array(root[shown]))})

        for batch in batches:
            kept.append(pa.Table.from_batches([batch]))
            size += batch.nbytes
            if size > FOLD:
                kept[:] = [shrunk(False)]
                size = 0
        if kept:
            yield from shrunk(True).to_batches(max_chunksize=100_000)

    return run


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): every node of ``edges`` (src, dst) with the smallest node it is connected to.

    Each task shrinks its edges to stars first, so that many edges among few nodes cost one pass. If at most ``WHOLE`` bytes of edges are left, one task
    joins them. Else each round points the larger neighbours of a node at its smallest neighbour (large star), then the smaller ones (small star);
    the number of rounds grows with the logarithm of the largest component, not with its diameter, and no step gathers a node's
    neighbours in one place: the smallest neighbour is an aggregate. Self loops, repeated edges and null ends are ignored. Edges
    are written to the shared folder after each round, so a lost executor costs one round at most.
    """
    now = edges.select("src", "dst").where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    kind = now.schema["u"].dataType.simpleString()
    if kind in PLAIN:
        now = written(now.mapInArrow(_forest(False), f"u {kind}, v {kind}"))
        size = F.octet_length("u") + F.octet_length("v") if kind == "string" else F.lit(8)
        if (now.agg(F.sum(size + 8)).first()[0] or 0) <= WHOLE:
            joined = written(now.coalesce(1).mapInArrow(_forest(True), f"u {kind}, v {kind}"))
            return joined.select(F.col("u").alias("node"), F.col("v").alias("component"))
    now = written(now.distinct())
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        after = written(small)
        if after.exceptAll(now).isEmpty() and now.exceptAll(after).isEmpty():
            break
        now = after
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
