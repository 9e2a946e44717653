"""Context assembly: from ranked results (query_id, rank, id, content, composite_score, semantic_score, ...) to one text a query.

The results of a query are the bounded output of a search, so gathering them into one row is safe. Queries without results have no row.
"""

from __future__ import annotations

import difflib
import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _joined(results: DataFrame, text: Column, separator: str) -> DataFrame:
    listed = F.array_sort(F.collect_list(F.struct("rank", text.alias("text"))))
    return results.groupBy("query_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), separator).alias("context"))


def percent(results: DataFrame) -> Column:
    """The composite score, or 100 times the similarity where there is none."""
    has = lambda c: F.col(c) if c in results.columns else F.lit(None).cast("double")
    return F.coalesce(has("composite_score"), (1 - has("semantic_score")) * 100, F.lit(0.0))


def simple(results: DataFrame) -> DataFrame:
    return _joined(results, F.coalesce("content", F.lit("")), "\n\n")


def detailed(results: DataFrame, source: str = "source", page: str | None = None) -> DataFrame:
    """"[i] Source: s (Page p) [Relevance: x.x%]" above each content, rules between."""
    where = F.concat(F.lit(" (Page "), F.col(page).cast("string"), F.lit(")")) if page else F.lit(None).cast("string")
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Source: "), F.coalesce(F.col(source), F.lit("unknown")), F.coalesce(where, F.lit("")), F.lit(" [Relevance: "), F.format_string("%.1f", percent(results)), F.lit("%]\n"))
    return _joined(results, F.concat(head, F.coalesce("content", F.lit(""))), "\n\n---\n\n")


def citations(results: DataFrame) -> DataFrame:
    return _joined(results, F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.coalesce("content", F.lit(""))), "\n\n")


def numbered(results: DataFrame) -> DataFrame:
    """"[Source i] (score: x.x)" above each content."""
    head = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] (score: "), F.format_string("%.1f", percent(results)), F.lit(")\n"))
    return _joined(results, F.concat(head, F.coalesce("content", F.lit(""))), "\n\n")


def with_metadata(results: DataFrame, metadata: str = "metadata") -> DataFrame:
    """"[Document i]", the content and its metadata."""
    text = F.concat(F.lit("[Document "), F.col("rank").cast("string"), F.lit("]\n"), F.coalesce("content", F.lit("")), F.lit("\nMetadata: "), F.coalesce(F.col(metadata).cast("string"), F.lit("{}")))
    return _joined(results, text, "\n\n")


def references(results: DataFrame, most: int = 800, file: str = "source", page: str | None = None) -> DataFrame:
    """One line a result: "[Ref i (file Pp)]" and up to ``most`` characters of the content without line breaks."""
    at = F.concat(F.lit(" P"), F.col(page).cast("string")) if page else F.lit(None).cast("string")
    text = F.concat(F.lit("[Ref "), F.col("rank").cast("string"), F.lit(" ("), F.coalesce(F.col(file), F.lit("unknown")), F.coalesce(at, F.lit("")), F.lit(")] "), F.substring(F.replace(F.coalesce("content", F.lit("")), F.lit("\n"), F.lit(" ")), 1, most))
    return _joined(results, text, "\n")


def preview(content: Column, most: int = 200) -> Column:
    """The first ``most`` characters, with "..." if there are more."""
    return F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("..."))).otherwise(content)


def truncated(context: DataFrame, budget: int) -> DataFrame:
    """Contexts cut to ``budget`` characters."""
    return context.withColumn("context", F.substring("context", 1, budget))


def within_budget(results: DataFrame, budget: int) -> DataFrame:
    """The results of each query, in order, whose contents together stay within ``budget`` characters."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("used_chars", F.sum(F.coalesce(F.length("content"), F.lit(0))).over(w)).where(F.col("used_chars") <= budget)


def with_graph(context: DataFrame, graph_text: str, budget: int) -> DataFrame:
    """Contexts with the head of a knowledge graph before them: a third of the budget, 8,000 characters at most."""
    head = graph_text[: min(8000, budget // 3)]
    return truncated(context.withColumn("context", F.concat(F.lit(head + "\n\n" if head else ""), "context")), budget)


def extraction_inputs(docs: DataFrame, budget: int) -> DataFrame:
    """(id, content): each text cut to its share of 25,000 characters or the budget if less, though never below 2,000."""
    share = docs.agg(F.greatest(F.lit(2000), F.floor(F.lit(min(budget, 25_000)) / F.greatest(F.count("*"), F.lit(1)))).cast("int").alias("_share"))
    return docs.join(share, F.lit(True)).select("id", F.substring(F.col("content"), F.lit(1), F.col("_share")).alias("content"))


def compared(one: DataFrame, two: DataFrame, most: int = 100) -> DataFrame:
    """(query_id, changed, diff): the answers (query_id, answer) of two runs line by line, as a unified difference of at most ``most`` lines; an answer that one
    run lacks is empty there, a null one too."""

    def lines(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(itertools.islice(difflib.unified_diff(x.splitlines(), y.splitlines(), "one", "two", lineterm=""), most)) for x, y in zip(a, b, strict=True)], dtype=object)

    diff = F.pandas_udf(lines, "string")
    both = one.select("query_id", F.col("answer").alias("_a")).join(two.select("query_id", F.col("answer").alias("_b")), "query_id", "full")
    both = both.select("query_id", F.coalesce("_a", F.lit("")).alias("_a"), F.coalesce("_b", F.lit("")).alias("_b"))
    return both.select("query_id", (F.col("_a") != F.col("_b")).alias("changed"), diff("_a", "_b").alias("diff"))
