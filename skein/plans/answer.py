"""From questions to answers: dense and keyword lists, fusion, reranking, context, graph, model.

Everything up to the context is one lazy plan for all questions; the model is called by the driver, on contexts of bounded size.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators import context, dense, graph, keyword, ranking, rerank, store

from .config import Profile
from .providers import LanguageModel, Reranker, hashed_embedding
from .tables import written


def hybrid(queries: DataFrame, corpus: DataFrame, k: int, p: Profile = Profile(), weights: tuple[float, float] | None = None) -> DataFrame:
    """(query_id, query_text, id, content, similarity, semantic_score, score, rank): the dense and BM25 lists of queries (query_id,
    query_text, query_vec) over a corpus (id, content, vec), fused. A result that only the keyword list has is without distance."""
    d = dense.cosine_topk(queries.select("query_id", "query_vec"), corpus.select("id", "vec"), p.top_k_dense)
    w = keyword.bm25_topk(queries.select("query_id", "query_text"), corpus.select("id", "content"), p.top_k_keyword)
    wd, wk = weights or (p.rrf_dense_weight, p.rrf_keyword_weight)
    fused = ranking.fuse([(d, wd), (w, wk)], p.rrf_k, k)
    return fused.join(d.select("query_id", "id", "similarity", "semantic_score"), ["query_id", "id"], "left").join(corpus.select("id", "content"), "id").join(queries.select("query_id", "query_text"), "query_id").select("query_id", "query_text", "id", "content", "similarity", "semantic_score", F.round("score", 9).alias("score"), "rank")


def fused(queries: DataFrame, corpus: DataFrame, p: Profile = Profile()) -> DataFrame:
    """(query_id, id, score, rank): as :func:`hybrid`, but all that either list has, and the dense list as it is for queries whose keyword list is empty."""
    d = written(dense.cosine_topk(queries.select("query_id", "query_vec"), corpus.select("id", "vec"), p.top_k_dense))
    w = written(keyword.bm25_topk(queries.select("query_id", "query_text"), corpus.select("id", "content"), p.top_k_keyword))
    both = ranking.fuse([(d, p.rrf_dense_weight), (w, p.rrf_keyword_weight)], p.rrf_k, p.top_k_dense + p.top_k_keyword)
    worded = w.select("query_id").distinct()
    alone = d.join(worded, "query_id", "left_anti").select("query_id", "id", F.col("similarity").alias("score"), "rank")
    return both.join(worded, "query_id", "left_semi").select("query_id", "id", F.round("score", 9).alias("score"), "rank").unionByName(alone)


def searched(queries: DataFrame, corpus: DataFrame, p: Profile = Profile()) -> DataFrame:
    """The hybrid list of ``rerank_candidates`` reranked by several factors, the first ``final_context_chunks`` kept."""
    return rerank.multi_factor(hybrid(queries, corpus, p.rerank_candidates, p), p.final_context_chunks)


def dense_reranked(queries: DataFrame, corpus: DataFrame, k: int, candidates: int | None = None, model: Reranker | None = None) -> DataFrame:
    """(query_id, query_text, id, content, semantic_score, composite_score, rank): the ``candidates`` most similar rows, twice ``k`` by default, reranked by a model, or by several factors, and the first ``k`` kept."""
    d = dense.cosine_topk(queries.select("query_id", "query_vec"), corpus.select("id", "vec"), candidates or 2 * k)
    found = d.join(corpus.select("id", "content"), "id").join(queries.select("query_id", "query_text"), "query_id")
    ranked = rerank.multi_factor(found, k) if model is None else rerank.by_provider(found, model.rerank, k)
    return ranked.select("query_id", "query_text", "id", "content", "semantic_score", "composite_score", "rank")


def expanded(queries: DataFrame, sub_queries: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, part, query_text): each question and up to ``most`` different sub-queries (query_id, position, text) of more than 10
    characters that aren't labels of a model's answer, part 0 being the question itself."""
    text = F.trim("text")
    good = sub_queries.where((F.length(text) > 10) & ~F.regexp_like(F.lower(text), F.lit("^(sub-query|example|note|here are)"))).groupBy("query_id", text.alias("text")).agg(F.min("position").alias("position"))
    ranked = ranking.top(good, most, -F.col("position"), id_col="text").select("query_id", F.col("rank").alias("part"), F.col("text").alias("query_text"))
    return queries.select("query_id", F.lit(0).alias("part"), "query_text").unionByName(ranked)


@dataclass
class Run:
    answer: str
    iterations: int
    depth: int
    trace: list[str] = field(default_factory=list)


def recursive_answer(model: LanguageModel, question: str, text: str, p: Profile = Profile(), depth: int = 0, quality: Callable[[str], float] | None = None) -> Run:
    """Asks until a response is final, qualities settle, or iterations are used up; a response RECURSE("question") asks that first,
    one level deeper. Beyond ``max_depth`` the model is asked once."""
    if depth >= p.max_depth:
        return Run(_final(model.complete(f"{text}\n\nQuestion: {question}")), 1, depth)
    trace: list[str] = []
    known, scores = text, []
    for i in range(1, p.max_iterations + 1):
        response = model.complete(f"{known}\n\nQuestion: {question}")
        trace.append(response)
        if "FINAL(" in response:
            return Run(_final(response), i, depth, trace)
        if m := re.search(r'RECURSE\("([^"]+)"\)', response):
            inner = recursive_answer(model, m[1], text, p, depth + 1, quality)
            known = f"{known}\n\n{m[1]}\n{inner.answer}"
            continue
        if quality:
            scores.append(quality(response))
            if i > 2 and len(scores) >= 3 and scores[-1] > 0.7 and abs(scores[-1] - scores[-2]) < 0.1 and abs(scores[-2] - scores[-3]) < 0.1:
                return Run(response, i, depth, trace)
        known = f"{known}\n\n{response}"
    return Run(_final(model.complete(f"{text}\n\nGive the final answer.\n\nQuestion: {question}")), p.max_iterations, depth, trace)


def _final(response: str) -> str:
    for quote in ('"""', "'''", '"', "'"):
        if m := re.search(rf"FINAL\({quote}(.*?){quote}\)", response, re.DOTALL):
            return m[1]
    return response


def in_parts(queries: DataFrame, sub_queries: DataFrame | None, corpus: DataFrame, p: Profile, embed: Callable[[Column], Column]) -> DataFrame:
    """:func:`searched` for questions with sub-queries: all parts are searched in one plan, of what several parts find the best counts, and
    the union is reranked by the question itself."""
    if not p.multi_query or sub_queries is None:
        return searched(queries, corpus, p)
    key = F.concat_ws("#", F.col("query_id").cast("string"), F.col("part").cast("string"))
    parts = written(expanded(queries, sub_queries).select("query_id", "part", "query_text", key.alias("key")))
    vec = queries.select("query_id", "query_vec", F.lit(0).alias("part"))
    asked = parts.join(vec, ["query_id", "part"], "left").select(F.col("key").alias("query_id"), "query_text", F.coalesce("query_vec", embed(F.col("query_text"))).alias("query_vec"))
    found = hybrid(asked, corpus, p.rerank_candidates, p).withColumnRenamed("query_id", "key").drop("query_text").join(parts.select("key", "query_id"), "key")
    one = found.groupBy("query_id", "id").agg(F.max("score").alias("score"), F.first("content").alias("content"), F.min("semantic_score").alias("semantic_score"))
    best = ranking.top(one, p.rerank_candidates, F.col("score")).join(queries.select("query_id", "query_text"), "query_id")
    return rerank.multi_factor(best, p.final_context_chunks)


def contexts(queries: DataFrame, corpus: DataFrame, p: Profile = Profile(), budget: int = 32_000, sub_queries: DataFrame | None = None, embed: Callable[[Column], Column] = hashed_embedding, graph_text: str = "", vertices: DataFrame | None = None, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((query_id, query_text, context), results): all that a model is given for each question, in the order knowledge graph, sources, graph
    context of the names in the question; the profile says whether parts and graph take part. Questions that find nothing have a null context."""
    results = in_parts(queries, sub_queries, corpus, p, embed)
    text = context.with_graph(context.numbered(results), graph_text, budget)
    if p.graph_augmented and vertices is not None and edges is not None:
        named = graph.augment(queries.select(F.col("query_id").alias("id"), F.col("query_text").alias("content")), edges, vertices, p.graph_hops)
        more = named.groupBy(F.col("id").alias("query_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seed", "context"))), lambda x: x["context"]), "").alias("more"))
        text = text.join(more, "query_id", "left").select("query_id", F.concat("context", F.coalesce("more", F.lit(""))).alias("context"))
    return queries.select("query_id", "query_text").join(context.truncated(text, budget), "query_id", "left"), results


def blended_corpus(parts: list[DataFrame]) -> DataFrame:
    """The corpora (id, content, vec) of several collections as one: of contents that several have, and of ids, the first collection's row counts."""
    return store.blended([store.blended(parts, "id", "content")], "content", "id")


def answers(queries: DataFrame, corpus: DataFrame, model: LanguageModel, p: Profile = Profile(), budget: int = 32_000, most: int = 1000, **given: object) -> tuple[DataFrame, DataFrame]:
    """((query_id, query_text, answer), results) of a stated set of up to ``most`` questions; ``given`` goes to :func:`contexts`."""
    if (n := queries.count()) > most:
        raise ValueError(f"{n} questions, more than {most}")
    texts, results = contexts(queries, corpus, p, budget, **given)
    rows = [(r["query_id"], r["query_text"], recursive_answer(model, r["query_text"], r["context"], p).answer if r["context"] else "No relevant documents found.") for r in texts.toLocalIterator()]
    types = dict(queries.dtypes)
    return queries.sparkSession.createDataFrame(rows, f"query_id {types['query_id']}, query_text string, answer string"), results
