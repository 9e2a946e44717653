"""Reranking of candidate lists (query_id, query_text, id, content, semantic_score, rank) by several factors.

Scores are from 0 to 100 and a bonus; ranks are 1-based positions in the incoming list. Null contents count as empty, a null distance as none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from skein.functions.text import FEW_STOP_WORDS, STOP_WORDS, keywords, length_score, proper_nouns, token_overlap

from .ranking import top

# The weights of the factors.
WEIGHTS = {"fuzzy": 0.25, "keywords": 0.25, "semantic": 0.35, "length": 0.15}


@F.pandas_udf(DoubleType())
def partial_ratio(query: pd.Series, content: pd.Series) -> pd.Series:
    """100 times the best SequenceMatcher ratio of the shorter text with a stretch as long of the longer one that starts where they match."""

    def one(a: str | None, b: str | None) -> float:
        if not a or not b:
            return 0.0
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        best = 0.0
        blocks = SequenceMatcher(None, short, long, autojunk=False).get_matching_blocks()
        for at in {max(0, j - i) for i, j, n in blocks if n}:
            m = SequenceMatcher(None, long[at : at + len(short)], short, autojunk=False)
            if m.real_quick_ratio() > best and m.quick_ratio() > best:
                best = max(best, m.ratio())
        return 100 * best

    return pd.Series([one(a, b) for a, b in zip(query, content, strict=True)], dtype=float)


def _coverage(query: Column, content: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    q = keywords(query, stop_words)
    return F.when(F.size(q) > 0, 100.0 * F.size(F.array_intersect(q, keywords(content, stop_words))) / F.size(q)).otherwise(0.0)


def _bonus() -> Column:
    return F.greatest(F.lit(0), 20 - F.col("rank")) + F.when(F.arrays_overlap(proper_nouns(F.col("query_text")), proper_nouns(F.col("content"))), 30).otherwise(0)


def multi_factor(candidates: DataFrame, k: int, exact_fuzzy: bool = False) -> DataFrame:
    """Adds composite_score and the new rank. The semantic factor of a distance d is 100 / (1 + d / 10) if d > 0 and 80 otherwise, as
    rank parity asks. ``exact_fuzzy`` takes the partial ratio of the lower-cased texts, else the share of common terms."""
    c = candidates.withColumn("content", F.coalesce("content", F.lit("")))
    fuzzy = partial_ratio(F.lower("query_text"), F.lower("content")) if exact_fuzzy else token_overlap(F.col("query_text"), F.col("content"))
    d = F.col("semantic_score")
    semantic = F.when(d > 0, 100 / (1 + 0.1 * d)).otherwise(80.0)
    score = WEIGHTS["fuzzy"] * fuzzy + WEIGHTS["keywords"] * _coverage(F.col("query_text"), F.col("content")) + WEIGHTS["semantic"] * semantic + WEIGHTS["length"] * length_score(F.col("content")) + _bonus()
    return top(c.withColumn("composite_score", F.round(score, 6)).drop("rank"), k, F.col("composite_score"))


def composite(candidates: DataFrame, k: int, exact_fuzzy: bool = False) -> DataFrame:
    """As :func:`multi_factor`, but case matters in the fuzzy factor, its plain form is 80 plus 20 times the ratio of lengths where
    one text contains the other and 50 otherwise, and only a missing distance counts as 80. Adds the factors fuzzy, kw and vec."""
    c = candidates.withColumn("content", F.coalesce("content", F.lit("")))
    q, t = F.col("query_text"), F.col("content")
    ratio = F.least(F.length(q), F.length(t)) / F.greatest(F.length(q), F.length(t), F.lit(1))
    plain = F.when(F.contains(t, q) | F.contains(q, t), 80 + 20 * ratio).otherwise(50.0)
    fuzzy = partial_ratio(q, t) if exact_fuzzy else plain
    d = F.col("semantic_score")
    semantic = F.when(d.isNull(), 80.0).otherwise(100 / (1 + 0.1 * d))
    c = c.withColumn("fuzzy", F.round(fuzzy, 6)).withColumn("kw", F.round(_coverage(q, t, FEW_STOP_WORDS), 6)).withColumn("vec", F.round(semantic, 6))
    score = WEIGHTS["fuzzy"] * F.col("fuzzy") + WEIGHTS["keywords"] * F.col("kw") + WEIGHTS["semantic"] * F.col("vec") + WEIGHTS["length"] * length_score(t) + _bonus()
    return top(c.withColumn("composite_score", F.round(score, 6)).drop("rank"), k, F.col("composite_score"))


def by_provider(candidates: DataFrame, rerank: Callable[[str, list[str]], list[tuple[int, float]]], k: int) -> DataFrame:
    """Reranks each query's candidates with a pluggable model ``rerank(query, documents) -> [(index, score)]``, joined back on ids.

    A query's candidates are the bounded output of a search, so they fit one call. An empty query keeps the order with scores of 0; empty
    documents are given as "(empty)".
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank", kind="stable").reset_index(drop=True)
        query = pdf["query_text"][0] or ""
        scores = [(i, 0.0) for i in range(len(pdf))] if not query.strip() else rerank(query, [x if x and x.strip() else "(empty)" for x in pdf["content"]])
        return pd.DataFrame([(pdf["query_id"][i], pdf["id"][i], float(s)) for i, s in scores], columns=["query_id", "id", "rerank_score"])

    types = dict(candidates.dtypes)
    scored = candidates.select("query_id", "query_text", "id", "content", "rank").groupBy("query_id").applyInPandas(one, f"query_id {types['query_id']}, id {types['id']}, rerank_score double")
    joined = candidates.drop("rank").join(scored, ["query_id", "id"]).withColumn("composite_score", F.round(100 * F.col("rerank_score"), 6))
    return top(joined, k, F.col("rerank_score"))
