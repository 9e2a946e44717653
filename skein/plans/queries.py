"""The queries of the retrieval operators over the test tables, each over whole tables.

Searches take as queries every row whose id is divisible by 100, a stated query set, against all rows. Documents and embeddings are paired by
doc_id = vec_id, as the tables relate them in no other way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import catalog, chunking, context, dense, entities, graph, keyword, ranking, rerank, store, usage
from skein.plans.providers import OverlapReranker, hashed_embedding

from . import answer
from .config import Profile
from .tables import read


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def _vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents", "doc_id", "text").where("doc_id % 100 = 0 and text is not null").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query_text"))


def _store(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "store_documents", "doc_id", "content").select(F.col("doc_id").alias("id"), "content")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "kg_relationships").dropDuplicates()


def _vertices(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "kg_entities", "record_id", "name", "entity_type", "description")


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    return _edges(spark, sf).where("edge_id % 100 = 0").select(F.col("source").alias("seed")).where("trim(seed) <> ''").distinct()


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.cosine_topk(_vector_queries(spark, sf), _vectors(spark, sf), 10)


def dense_topk_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return dense.cosine_topk_blocks(_vector_queries(spark, sf), _vectors(spark, sf), 64, 10)


def l2_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense.l2_topk(_vector_queries(spark, sf), _vectors(spark, sf), 10)


def self_recall(spark: SparkSession, sf: str) -> DataFrame:
    return dense.self_recall(_vector_queries(spark, sf), _vectors(spark, sf))


def keyword_substring(spark: SparkSession, sf: str) -> DataFrame:
    return keyword.substring_topk(_items(spark, sf), _docs(spark, sf), 50)


def keyword_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return keyword.overlap_topk(_items(spark, sf), _docs(spark, sf), 50)


def keyword_like(spark: SparkSession, sf: str) -> DataFrame:
    return keyword.like_filter(_items(spark, sf), _docs(spark, sf), 50)


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return keyword.bm25_topk(_items(spark, sf), _docs(spark, sf), 50)


def _hybrid_queries(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _vectors(spark, sf).select(F.col("id").alias("query_id"), F.col("vec").alias("query_vec"))
    return _items(spark, sf).join(vectors, "query_id")


def _hybrid_corpus(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).join(_vectors(spark, sf), "id", "left").where("content is not null")


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return answer.hybrid(_hybrid_queries(spark, sf), _hybrid_corpus(spark, sf), 30).select("query_id", "id", "score", "semantic_score", "rank")


def rerank_multifactor(spark: SparkSession, sf: str) -> DataFrame:
    found = answer.hybrid(_hybrid_queries(spark, sf), _hybrid_corpus(spark, sf), 30)
    return rerank.multi_factor(found, 10).select("query_id", "id", "composite_score", "rank")


def rerank_composite(spark: SparkSession, sf: str) -> DataFrame:
    found = answer.hybrid(_hybrid_queries(spark, sf), _hybrid_corpus(spark, sf), 30)
    return rerank.composite(found, 10).select("query_id", "id", "fuzzy", "kw", "vec", "composite_score", "rank")


def rerank_partial_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Names of entities as queries, as the ratio's cost grows with the product of the lengths."""
    q = _vertices(spark, sf).where("record_id % 100 = 0 and name is not null").select(F.col("record_id").alias("query_id"), F.col("name").alias("query_text"))
    found = keyword.overlap_topk(q, _docs(spark, sf), 30).join(_docs(spark, sf), "id").join(q, "query_id").withColumn("semantic_score", F.lit(None).cast("double"))
    return rerank.multi_factor(found, 10, exact_fuzzy=True).select("query_id", "id", "composite_score", "rank")


def rerank_provider(spark: SparkSession, sf: str) -> DataFrame:
    found = answer.hybrid(_hybrid_queries(spark, sf), _hybrid_corpus(spark, sf), 30)
    return rerank.by_provider(found, OverlapReranker().rerank, 10).select("query_id", "id", "composite_score", "rank")


def rrf_three_lists(spark: SparkSession, sf: str) -> DataFrame:
    q, d = _items(spark, sf), _docs(spark, sf)
    lists = [(keyword.substring_topk(q, d, 50), 4.0), (keyword.overlap_topk(q, d, 50), 1.0), (keyword.bm25_topk(q, d, 50), 2.0)]
    return ranking.fuse(lists, 60, 20).select("query_id", "id", F.round("score", 9).alias("score"), "first_list", "rank")


def context_citations(spark: SparkSession, sf: str) -> DataFrame:
    found = keyword.bm25_topk(_items(spark, sf), _docs(spark, sf), 5).join(_docs(spark, sf), "id")
    return context.citations(found)


def context_detailed(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text", "file_path").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("file_path").alias("source"))
    found = keyword.overlap_topk(_items(spark, sf), _docs(spark, sf), 5).join(docs, "id").withColumn("composite_score", F.col("keyword_score") * 100)
    return context.detailed(found)


def context_budget(spark: SparkSession, sf: str) -> DataFrame:
    found = keyword.bm25_topk(_items(spark, sf), _docs(spark, sf), 50).join(_docs(spark, sf), "id")
    return context.within_budget(found, 8000).select("query_id", "id", "rank", "used_chars")


def dedup_sha256(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "store_documents", "doc_id", "content")
    return store.deduplicated(df).select("doc_id", store.content_hash(F.col("content")).alias("content_hash"))


def stale_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose recorded hash is missing or not the first sixteen digits of the content's, by type."""
    df = read(spark, sf, "store_documents", "content", "content_hash", "doc_type")
    state = F.when(F.col("content_hash").isNull(), "missing").when(F.lower("content_hash") == F.substring(F.sha2("content", 256), 1, 16), "current").otherwise("stale")
    return df.groupBy(F.coalesce(F.lower("doc_type"), F.lit("unknown")).alias("doc_type"), state.alias("state")).agg(F.count("*").alias("n"))


def doc_stats_by_type(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "store_documents", "doc_type", "content")
    return df.groupBy(F.coalesce(F.lower("doc_type"), F.lit("unknown")).alias("doc_type")).agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


def ingest_only_new(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of the corpus that the store lacks, once each."""
    new = read(spark, sf, "documents", "doc_id", "text").where("trim(text) <> ''").withColumnRenamed("text", "content")
    old = read(spark, sf, "store_documents", "content")
    return store.deduplicated(store.not_stored(new, old)).select("doc_id")


def already_stored(spark: SparkSession, sf: str) -> DataFrame:
    new = read(spark, sf, "multimodal_documents", "id", "content")
    return store.stored(new, read(spark, sf, "store_documents", "content")).select("id")


def manifest_diff(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents", "file_path", "created_at", "ingested_at").where("file_path is not null").withColumnRenamed("file_path", "path")
    old = df.groupBy("path").agg(F.min("created_at").alias("mtime"))
    new = df.groupBy("path").agg(F.max("ingested_at").alias("mtime"))
    return store.changes(old, new)


def blend_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Blends the store and the corpus on their content, the store winning."""
    a = read(spark, sf, "store_documents", "doc_id", "content").select("content", F.col("doc_id").alias("item"), F.lit("store").alias("origin"))
    b = read(spark, sf, "documents", "doc_id", "text").where("text is not null").select(F.col("text").alias("content"), F.col("doc_id").cast("string").alias("item"), F.lit("corpus").alias("origin"))
    return store.blended([a, b], "content", "item").select("item", "origin")


def upsert_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """The entity table with the records of the graph's upserted by name."""
    old = read(spark, sf, "entity_nodes", "record_id", "name", "entity_type")
    new = read(spark, sf, "kg_entities", "record_id", "name", "entity_type").groupBy("name").agg(F.min(F.struct("record_id", "entity_type")).alias("x")).select("x.record_id", "name", "x.entity_type")
    return store.upsert(old, new, "name").groupBy(F.coalesce("entity_type", F.lit("none")).alias("entity_type")).agg(F.count("*").alias("n"), F.sum("record_id").alias("ids"))


def delete_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of the corpus by collection after deleting the files of its scanned pages."""
    df = read(spark, sf, "documents", "doc_id", "file_path", "collection_name", "doc_type")
    gone = df.where("doc_type = 'pdf' and file_path is not null").select("file_path")
    return store.delete(df, gone, "file_path").groupBy(F.coalesce("collection_name", F.lit("none")).alias("collection_name")).agg(F.count("*").alias("n"))


def list_files(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents", "file_path").where("file_path is not null").distinct()


def document_reassembly(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents", "doc_id", "file_path", "text").where("file_path is not null")
    return store.reassembled(df, "file_path", "doc_id", "text").select("file_path", F.md5("text").alias("content_md5"), F.length("text").alias("chars"))


def documents_left_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents", "doc_id", "lang").join(read(spark, sf, "embeddings", "vec_id", "label").withColumnRenamed("vec_id", "doc_id"), "doc_id", "left")
    return df.groupBy(F.coalesce(F.lower("lang"), F.lit("none")).alias("lang")).agg(F.count("*").alias("docs"), F.count("label").alias("with_vector"))


def usable_vectors(spark: SparkSession, sf: str) -> DataFrame:
    df = store.of_dimension(read(spark, sf, "multimodal_documents", "collection_name", "embedding"), "embedding", 96)
    return df.groupBy(F.coalesce("collection_name", F.lit("none")).alias("collection_name")).agg(F.count("*").alias("n"))


def metadata_filter(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "store_documents", "doc_id", "metadata")
    page = F.get_json_object("metadata", "$.page").cast("int")
    return df.select("doc_id", page.alias("page"), F.get_json_object("metadata", "$.source").alias("source")).where("page between 1 and 20")


def chunk_headers(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.by_headers(_store(spark, sf)).select("id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.fixed(_store(spark, sf), 1000, 200).select("id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


def chunk_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.units(_store(spark, sf), "\n\n").select("id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


def chunk_window(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.by_window(_store(spark, sf), 1000, 200).select("id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


def chunk_transcript(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.by_words(_store(spark, sf), 500).select("id", "chunk_no", F.md5("chunk").alias("chunk_md5"))


def csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents", "doc_id", "doc_type", "text").where("doc_type = 'csv'").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return chunking.table_rows(df)


def code_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("id", F.posexplode(T.code_blocks(F.col("content"))).alias("n", "code"))


def keyword_counts(spark: SparkSession, sf: str) -> DataFrame:
    df = _docs(spark, sf).where("content is not null")
    return df.select("id", F.size(T.keywords(F.col("content"))).alias("keywords"), F.size(T.proper_nouns(F.col("content"))).alias("proper_nouns"), F.size(T.words(F.col("content"))).alias("words"))


def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "documents", "lang", "text")
    return df.groupBy(F.coalesce(F.lower("lang"), F.lit("none")).alias("lang")).agg(F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


def response_quality(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where("content is not null").select("id", T.response_quality(F.col("content")).alias("quality"))


def final_answer_parse(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "eval_items", "item_id", "answer")
    said = F.concat(F.lit('The answer is FINAL("'), "answer", F.lit('") as FINAL_VAR(result_'), F.col("item_id").cast("string"), F.lit(")."))
    return df.select("item_id", T.final_answer(said).alias("final_answer"), T.final_variable(said).alias("variable"))


def report_grades(spark: SparkSession, sf: str) -> DataFrame:
    df = read(spark, sf, "events", "event_id", "value")
    score = T.report_score(F.concat(F.lit("Overall quality: "), (F.floor(F.abs("value")) % 101).cast("int").cast("string"), F.lit(" / 100")))
    return df.select(score.alias("score")).where("score is not null").groupBy("score", T.report_grade(F.col("score")).alias("grade")).agg(F.count("*").alias("n"))


def sub_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Items as questions and the sentences of their texts as sub-queries."""
    q = read(spark, sf, "eval_items", "item_id", "text").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    subs = q.select("query_id", F.posexplode(F.split("query_text", r"\. ")).alias("position", "text"))
    return answer.expanded(q.where("query_text is not null"), subs).select("query_id", "part", F.md5("query_text").alias("query_md5"))


def graph_parse(spark: SparkSession, sf: str) -> DataFrame:
    e, r = graph.parse_markdown(_docs(spark, sf))
    a = e.select("id", "line_no", F.lit("entity").alias("kind"), F.col("name").alias("a"), F.col("entity_type").alias("b"), F.col("description").alias("c"))
    return a.unionByName(r.select("id", "line_no", F.lit("relation").alias("kind"), F.col("source").alias("a"), F.col("relation").alias("b"), F.col("target").alias("c")))


def graph_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return graph.adjacency(_edges(spark, sf)).groupBy("node").agg(F.count("*").alias("edges"), F.countDistinct("neighbour").alias("neighbours"))


def graph_khop(spark: SparkSession, sf: str) -> DataFrame:
    return graph.expand(_seeds(spark, sf), _edges(spark, sf), 3)


def graph_described(spark: SparkSession, sf: str) -> DataFrame:
    return graph.described(graph.expand(_seeds(spark, sf), _edges(spark, sf), 2), _vertices(spark, sf))


def graph_paths(spark: SparkSession, sf: str) -> DataFrame:
    e = _edges(spark, sf)
    pairs = e.where("edge_id % 100 = 0").select("source", "target").where("trim(source) <> '' and trim(target) <> ''")
    return graph.simple_paths(pairs, e, 3).select("source", "target", F.array_join("path", " > ").alias("path"))


def graph_context(spark: SparkSession, sf: str) -> DataFrame:
    return graph.context_text(_seeds(spark, sf), _edges(spark, sf), _vertices(spark, sf))


def graph_augment(spark: SparkSession, sf: str) -> DataFrame:
    texts = read(spark, sf, "kg_entities", "record_id", "name").select(F.col("record_id").alias("id"), F.concat(F.lit('Tell me of "'), "name", F.lit('".')).alias("content")).where("id % 100 = 0")
    return graph.augment(texts, _edges(spark, sf), _vertices(spark, sf))


def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.stats(_vertices(spark, sf), _edges(spark, sf))


def graph_types(spark: SparkSession, sf: str) -> DataFrame:
    return graph.type_histogram(_vertices(spark, sf))


def graph_collapsed(spark: SparkSession, sf: str) -> DataFrame:
    return graph.collapsed(_edges(spark, sf))


def graph_mermaid(spark: SparkSession, sf: str) -> DataFrame:
    return graph.mermaid(_vertices(spark, sf), _edges(spark, sf))


def graph_dot(spark: SparkSession, sf: str) -> DataFrame:
    return graph.dot(_vertices(spark, sf), _edges(spark, sf))


def seed_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).where("content is not null").select("id", F.explode(T.named_phrases(F.col("content"))).alias("phrase"))


def _entity_records(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "entity_nodes", "record_id", "name", "entity_type").unionByName(read(spark, sf, "kg_entities", "record_id", "name", "entity_type"))


def entity_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _entity_records(spark, sf).select("record_id", T.normal_name(F.col("name")).alias("normal_name"))


def entity_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return entities.similar_names(_entity_records(spark, sf))


def entity_duplicates_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return entities.similar_names(_entity_records(spark, sf), exact_ratio=True)


def entity_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return entities.clusters(_entity_records(spark, sf))


def entity_report(spark: SparkSession, sf: str) -> DataFrame:
    return entities.report(_entity_records(spark, sf))


def entity_renamed_edges(spark: SparkSession, sf: str) -> DataFrame:
    return entities.renamed_edges(_edges(spark, sf), entities.clusters(_entity_records(spark, sf))).groupBy("source", "target").agg(F.count("*").alias("n"))


def _spelled_records(spark: SparkSession, sf: str) -> DataFrame:
    named = read(spark, sf, "kg_entities", "record_id", "name", "entity_type").withColumn("mentions", F.lit(None).cast("array<string>"))
    return read(spark, sf, "entity_nodes", "record_id", "name", "entity_type", "mentions").unionByName(named)


def entity_duplicates_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """Duplicates as the reference finds them: the best of all combinations of names and mentions, by the matching ratio."""
    return entities.similar_records(_spelled_records(spark, sf))


def entity_clusters_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return entities.clusters(_spelled_records(spark, sf), exact_ratio=True, mentions=True)


def entity_report_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return entities.report(_spelled_records(spark, sf), exact_ratio=True, mentions=True)


def entity_renamed_edges_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return entities.renamed_edges(_edges(spark, sf), entity_clusters_mentions(spark, sf)).groupBy("source", "target").agg(F.count("*").alias("n"))


def coreference(spark: SparkSession, sf: str) -> DataFrame:
    nodes = read(spark, sf, "entity_nodes", "doc_id", "name").where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("entities"))
    return entities.coreference(_store(spark, sf), nodes)


def coreference_triples(spark: SparkSession, sf: str) -> DataFrame:
    return entities.resolved_triples(read(spark, sf, "kg_relationships").distinct(), read(spark, sf, "kg_entities", "name"))


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "collections")


def collection_slugs(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf).select("name", T.slug(F.col("display_name")).alias("slug"))


def collection_stats(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.stats(_catalog(spark, sf), "2026-01-01")


def collection_totals(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.totals(_catalog(spark, sf))


def model_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.model_distribution(_catalog(spark, sf))


def tag_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.tag_distribution(_catalog(spark, sf))


def collection_search(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.search(_catalog(spark, sf), text="a", min_documents=10, max_documents=500).select("name", "document_count")


def collection_tags(spark: SparkSession, sf: str) -> DataFrame:
    tagged = catalog.remove_tags(catalog.add_tags(_catalog(spark, sf), F.array(F.lit("Field Notes"), F.lit("draft"))), F.array(F.lit("Draft")))
    return tagged.select("name", F.array_join("tags", ",").alias("tags"))


def collection_models(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.compatibility(_catalog(spark, sf), "hashing-64")


def collection_recount(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded document counts against those of the store."""
    held = read(spark, sf, "store_documents", "collection_name").groupBy(F.col("collection_name").alias("name")).agg(F.count("*").alias("held"))
    c = _catalog(spark, sf).select("name", F.coalesce("document_count", F.lit(0)).alias("recorded"))
    return c.join(held, "name", "left").select("name", "recorded", F.coalesce("held", F.lit(0)).alias("held"))


def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return usage.by(read(spark, sf, "token_usage"))


def usage_by_provider(spark: SparkSession, sf: str) -> DataFrame:
    return usage.by(read(spark, sf, "token_usage"), "provider")


def usage_by_model(spark: SparkSession, sf: str) -> DataFrame:
    return usage.by(read(spark, sf, "token_usage"), "model")


def usage_rates(spark: SparkSession, sf: str) -> DataFrame:
    return usage.priced_models(usage.calls(read(spark, sf, "token_usage")))


def quality_plateaus(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as iterations of a run, their values scaled to qualities."""
    e = read(spark, sf, "events", "event_id", "user_id", "ts", "value")
    it = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return usage.plateaus(e.select(F.col("user_id").alias("run_id"), it.alias("iteration"), F.least(F.lit(1.0), F.abs("value") / 100).alias("quality")))


def hashed_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    d = _docs(spark, sf).where("content is not null").select("id", hashed_embedding(F.col("content")).alias("v"))
    return d.select("id", F.posexplode("v").alias("dim", "x")).where("x > 0").groupBy("dim").agg(F.count("*").alias("n"))


def dense_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The search with a condition on the corpus that holds before the best are chosen."""
    labelled = read(spark, sf, "embeddings", "vec_id", "embedding", "label").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return dense.cosine_topk(_vector_queries(spark, sf), labelled, 10, exclude_self=True, where=F.col("label") < 5)


def keyword_filtered(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text", "doc_type").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), "doc_type")
    return keyword.like_filter(_items(spark, sf), docs, 50, where=F.lower("doc_type").isin("markdown", "text"))


def _media(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "multimodal_documents", "id", "content", "embedding", "image_path").select("id", "content", F.col("embedding").alias("vec"), "image_path")


def _media_queries(spark: SparkSession, sf: str) -> DataFrame:
    asked = _media(spark, sf).where("cast(substring(id, 4) as bigint) % 100 = 0")
    return asked.select(F.col("id").alias("query_id"), F.col("content").alias("query_text"), F.col("vec").alias("query_vec"))


def multimodal_dense(spark: SparkSession, sf: str) -> DataFrame:
    return dense.cosine_topk(_media_queries(spark, sf), _media(spark, sf), 10, exclude_self=True).select("query_id", "id", "similarity", "rank")


def multimodal_images(spark: SparkSession, sf: str) -> DataFrame:
    """The images of the items most similar to each query item."""
    return store.with_images(dense.cosine_topk(_media_queries(spark, sf), _media(spark, sf), 5), _media(spark, sf))


def hybrid_fused(spark: SparkSession, sf: str) -> DataFrame:
    return answer.fused(_hybrid_queries(spark, sf), _hybrid_corpus(spark, sf))


def dense_reranked(spark: SparkSession, sf: str) -> DataFrame:
    return answer.dense_reranked(_hybrid_queries(spark, sf), _hybrid_corpus(spark, sf), 10, 100).select("query_id", "id", "composite_score", "rank")


def reordered(spark: SparkSession, sf: str) -> DataFrame:
    """The dense list in the order of scores that a model gives, here the lengths of the ids."""
    found = dense.cosine_topk(_vector_queries(spark, sf), _vectors(spark, sf), 10)
    return ranking.reorder(found, found.select("query_id", "id", (F.col("id") % 7).cast("double").alias("rerank_score")), 5).select("query_id", "id", "composite_score", "rank")


def without_blank(spark: SparkSession, sf: str) -> DataFrame:
    kept = store.without_blank(read(spark, sf, "multimodal_documents", "id", "content"))
    return kept.select("id")


def point_get(spark: SparkSession, sf: str) -> DataFrame:
    return store.get(read(spark, sf, "store_documents"), "doc_id", "doc-0000000007").select("doc_id", F.md5("content").alias("content_md5"), "doc_type")


def store_cleared(spark: SparkSession, sf: str) -> DataFrame:
    return store.clear(read(spark, sf, "store_documents", "doc_id", "content")).agg(F.count("*").alias("n"))


def store_transcripts(spark: SparkSession, sf: str) -> DataFrame:
    return store.transcripts(read(spark, sf, "store_documents", "doc_id", "doc_type", "content")).select("doc_id")


def store_settings(spark: SparkSession, sf: str) -> DataFrame:
    """Models of collections as settings, those with a model of their own set again."""
    c = read(spark, sf, "collections", "name", "embedding_model")
    old = c.select(F.col("name").alias("key"), F.lit("none").alias("value"))
    return store.set_values(old, c.where("trim(embedding_model) <> ''").select(F.col("name").alias("key"), F.col("embedding_model").alias("value")))


def stores_merged(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus and the vectors' table as one store, ids of the second after those of the first."""
    a = read(spark, sf, "documents", "doc_id", "text").select(F.col("doc_id").alias("id"), F.md5("text").alias("content_md5"))
    b = read(spark, sf, "embeddings", "vec_id").select(F.col("vec_id").alias("id"), F.lit(None).cast("string").alias("content_md5"))
    return store.merged_stores([a, b])


def context_simple(spark: SparkSession, sf: str) -> DataFrame:
    return context.simple(keyword.bm25_topk(_items(spark, sf), _docs(spark, sf), 5).join(_docs(spark, sf), "id"))


def context_numbered(spark: SparkSession, sf: str) -> DataFrame:
    """With the head of a knowledge graph before it, within a budget."""
    found = keyword.overlap_topk(_items(spark, sf), _docs(spark, sf), 5).join(_docs(spark, sf), "id").withColumn("composite_score", F.col("keyword_score") * 100)
    return context.with_graph(context.numbered(found), "## Entities", 4000)


def context_metadata(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text", "source").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("source").alias("metadata"))
    return context.with_metadata(keyword.bm25_topk(_items(spark, sf), _docs(spark, sf), 5).join(docs, "id"))


def context_references(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents", "doc_id", "text", "file_path").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("file_path").alias("source"))
    return context.references(keyword.bm25_topk(_items(spark, sf), _docs(spark, sf), 5).join(docs, "id"))


def content_previews(spark: SparkSession, sf: str) -> DataFrame:
    return _store(spark, sf).select("id", F.md5(context.preview(F.col("content"), 120)).alias("preview_md5"))


def graph_extraction_inputs(spark: SparkSession, sf: str) -> DataFrame:
    return context.extraction_inputs(_docs(spark, sf), 25_000).select("id", F.md5("content").alias("content_md5"))


def unified_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """All that a model is given for each question: hybrid search, reranking, sources, graph context of the names in the question."""
    p = Profile(graph_augmented=True, multi_query=False)
    texts, _ = answer.contexts(_hybrid_queries(spark, sf), _hybrid_corpus(spark, sf), p, 12_000, graph_text="## Knowledge Graph", vertices=_vertices(spark, sf), edges=_edges(spark, sf))
    return texts.select("query_id", F.md5("context").alias("context_md5"), F.length("context").alias("chars"))


def multi_query_results(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of each question as its sub-queries; vectors by hashing."""
    docs = _docs(spark, sf).where("content is not null").withColumn("vec", hashed_embedding(F.col("content")))
    q = _items(spark, sf).withColumn("query_vec", hashed_embedding(F.col("query_text")))
    subs = q.select("query_id", F.posexplode(F.split("query_text", r"\. ")).alias("position", "text"))
    return answer.in_parts(q, subs, docs, Profile(multi_query=True), hashed_embedding).select("query_id", "id", "composite_score", "rank")


def blended_search(spark: SparkSession, sf: str) -> DataFrame:
    """A search of the store and the corpus as one collection, the store winning where both have a content."""
    a = read(spark, sf, "store_documents", "doc_id", "content").select(F.col("doc_id").alias("id"), "content")
    b = read(spark, sf, "documents", "doc_id", "text").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"))
    return keyword.bm25_topk(_items(spark, sf), answer.blended_corpus([a, b]), 10)


def entity_groups(spark: SparkSession, sf: str) -> DataFrame:
    return entities.merge_groups(_entity_records(spark, sf))


def collection_listed(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.listed(catalog.delete(_catalog(spark, sf), "Field Notes"))


def collection_saved(spark: SparkSession, sf: str) -> DataFrame:
    """The catalog with every fourth collection saved again under the model "new"."""
    c = _catalog(spark, sf)
    changed = c.where(F.pmod(F.length("name"), F.lit(4)) == 0).withColumn("embedding_model", F.lit("new"))
    return catalog.save(c, changed).groupBy("embedding_model").agg(F.count("*").alias("n"))


def collection_reindex(spark: SparkSession, sf: str) -> DataFrame:
    """The sources to be read again when all collections are built anew."""
    emptied, sources = catalog.reindexed(_catalog(spark, sf))
    left = emptied.agg(F.sum(F.coalesce("document_count", F.lit(0)) + F.coalesce(F.size("sources"), F.lit(0))).alias("left"))
    return sources.join(left, F.lit(True))


def collection_usage(spark: SparkSession, sf: str) -> DataFrame:
    held = read(spark, sf, "store_documents", "doc_id", "collection_name", "content", "image_path")
    edges = _edges(spark, sf).join(held.select("doc_id", "collection_name"), "doc_id")
    return catalog.usage_of(_catalog(spark, sf), held, edges)


def collection_graphs(spark: SparkSession, sf: str) -> DataFrame:
    """The graph texts of the corpus joined for each collection."""
    d = read(spark, sf, "documents", "doc_id", "collection_name", "text").where("text like '%## Entities%' and collection_name is not null")
    return catalog.joined_graphs(d.select(F.col("collection_name").alias("name"), F.col("doc_id").alias("position"), F.col("text").alias("graph"))).select("name", F.md5("graph").alias("graph_md5"))


def collection_search_tags(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.search(_catalog(spark, sf), tags=["Monthly", "quiet"], model="mini").select("name")


def answers_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What the corpus holds of answers and grades, as a model's responses are read."""
    c = F.col("content")
    return _docs(spark, sf).where("content is not null").agg(F.count("*").alias("texts"), F.count(T.final_answer(c)).alias("answers"), F.count(T.final_variable(c)).alias("variables"), F.count(T.report_score(c)).alias("scores"))


def queries() -> dict:
    return {k: v for k, v in globals().items() if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_") and k != "queries"}
