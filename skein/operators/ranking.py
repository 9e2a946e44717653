"""Ranked lists: top-k, fusion by reciprocal ranks, and the order of ties.

A ranked list is (query_id, id, score, ...). Every order is total: score descending, then id. Window ranks with a limit are planned as
group limits, so only k rows of a query leave each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(df: DataFrame, k: int, score: Column, *, by: str = "query_id", id_col: str = "id") -> DataFrame:
    """The ``k`` best rows of each query with their rank from 1; null scores come last."""
    order = Window.partitionBy(by).orderBy(score.desc_nulls_last(), F.col(id_col))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def fuse(lists: list[tuple[DataFrame, float]], k: int = 60, limit: int | None = None) -> DataFrame:
    """(query_id, id, score, first_list): reciprocal rank fusion of ranked lists (query_id, id, rank from 1), each with its weight.

    A result's score is the sum of weight / (k + rank - 1) over the lists that have it. ``first_list`` is the first list that
    has it, whose fields a caller keeps. Empty lists add nothing.
    """
    parts = [df.select("query_id", "id", (F.lit(float(w)) / (F.lit(k) + F.col("rank") - 1)).alias("part"), F.lit(i).alias("list")) for i, (df, w) in enumerate(lists)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    # the parts of a result are summed in the order of the lists, so that equal inputs give equal doubles
    gathered = both.groupBy("query_id", "id").agg(F.array_sort(F.collect_list(F.struct("list", "part"))).alias("parts"))
    fused = gathered.select("query_id", "id", F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["part"]).alias("score"), F.col("parts")[0]["list"].alias("first_list"))
    return fused if limit is None else top(fused, limit, F.col("score"))


def reorder(results: DataFrame, scores: DataFrame, k: int | None = None) -> DataFrame:
    """Results in the order of a reranker's scores (query_id, id, rerank_score), joined on the id, composite score 100 times that."""
    joined = results.drop("rank").join(scores, ["query_id", "id"]).withColumn("composite_score", F.col("rerank_score") * 100)
    return top(joined, k or 2**31 - 1, F.col("rerank_score"))
