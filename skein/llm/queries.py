"""The queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.tables import read

from .keyword_pages import keyword_pages
from .leaks import leak_spans, leaks, without_leaks
from .mixing import mix_records, mix_shares
from .names import same_entities, same_entity_pairs
from .near_copies import near_copy_classes, near_copy_pairs
from .neighbours import nearest
from .scans import repair, scan_lines
from .splitting import pieces, profiled

# The domains of the sources of the test tables.
DOMAINS = {
    "web-crawl": "web", "press-archive": "press", "radio-scripts": "press", "product-manuals": "technical", "code-docs": "technical", "lab-reports": "technical",
    "wiki-export": "reference", "glossaries": "reference", "course-notes": "reference", "meeting-transcripts": "office", "support-mail": "office", "slide-decks": "office", "field-diaries": "personal",
}
NEAR = {"similarity": 0.6, "shingle": 3, "min_words": 20}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_copy_pairs(read(spark, sf, "store_documents", "doc_id", "content"), "doc_id", "content", **NEAR).select(F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    return near_copy_classes(read(spark, sf, "store_documents", "doc_id", "content"), "doc_id", "content", **NEAR, count_links=False).withColumnRenamed("id", "doc_id")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    columns = ("record_id", "name", "entity_type")
    nodes = read(spark, sf, "entity_nodes", *columns, "mentions")
    return nodes.unionByName(read(spark, sf, "kg_entities", *columns).withColumn("mentions", F.lit(None).cast("array<string>")))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_entity_pairs(_records(spark, sf), expand_up_to=None)


def p2_entities(spark: SparkSession, sf: str) -> DataFrame:
    return same_entities(_records(spark, sf))


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    items = profiled(read(spark, sf, "store_documents", "doc_id", "content", "profile_name"), read(spark, sf, "profiles"))
    return pieces(items, "doc_id", "content", "chunk_size", "chunk_overlap").withColumnRenamed("id", "doc_id")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Every item cut in more than one piece; the second piece tells, so nothing is grouped or shuffled."""
    return p3_pieces(spark, sf).where("piece_no = 2").select("doc_id").distinct()


def p3_rebuilt(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, text_md5, fits, overlaps): every item put together again from its pieces, and whether all are within the size and repeat the overlap."""
    items = profiled(read(spark, sf, "store_documents", "doc_id", "content", "profile_name"), read(spark, sf, "profiles"))
    sizes = items.select("doc_id", "chunk_size", "chunk_overlap")
    cut = p3_pieces(spark, sf).join(sizes, "doc_id")
    text = F.when(F.col("piece_no") == 1, F.col("piece")).otherwise(F.expr("substring(piece, chunk_overlap + 1)"))
    gathered = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", text.alias("text"), "begin", "end"))).alias("p"), F.max(F.length("piece") - F.col("chunk_size")).alias("over"), F.first("chunk_overlap").alias("o"))
    apart = F.zip_with(F.slice("p", 2, 1 << 30), F.slice("p", 1, F.size("p") - 1), lambda b, a: a["end"] - b["begin"] == F.col("o"))
    return gathered.select("doc_id", F.md5(F.array_join(F.transform("p", lambda x: x["text"]), "")).alias("text_md5"), (F.col("over") <= 0).alias("fits"), F.when(F.size("p") > 1, F.forall(apart, lambda x: x)).otherwise(True).alias("overlaps"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    lists = nearest(read(spark, sf, "multimodal_documents", "id", "embedding"), "id", "embedding", 96, 10, 0.7)
    return lists.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()


def p4_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The ten most similar of every usable vector, however unlike; tables are planned for pairs of 0.6."""
    return nearest(read(spark, sf, "multimodal_documents", "id", "embedding"), "id", "embedding", 96, 10, similarity=0.6)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return scan_lines(read(spark, sf, "store_documents", "doc_id", "content"), "doc_id", "content").withColumnRenamed("id", "doc_id")


def p5_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return repair(read(spark, sf, "store_documents", "doc_id", "content"), "doc_id", "content").withColumnRenamed("id", "doc_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks(read(spark, sf, "documents", "doc_id", "text"), read(spark, sf, "eval_items", "item_id", "text"))


def p6_spans(spark: SparkSession, sf: str) -> DataFrame:
    return leak_spans(read(spark, sf, "documents", "doc_id", "text"), read(spark, sf, "eval_items", "item_id", "text"))


def p6_clean(spark: SparkSession, sf: str) -> DataFrame:
    return without_leaks(read(spark, sf, "documents", "doc_id", "text"), read(spark, sf, "eval_items", "item_id", "text"))


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    domains = spark.createDataFrame(list(DOMAINS.items()), "source string, domain string")
    return mix_records(read(spark, sf, "documents", "doc_id", "text", "source", "lang"), read(spark, sf, "mix_targets"), domains=domains)


def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The records each mix uses, with how often."""
    return _mixed(spark, sf)[0].withColumnRenamed("id", "doc_id")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix_shares(*_mixed(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_pages(read(spark, sf, "documents", "doc_id", "text"), "doc_id", "text").select("doc_id")


def p8_parts(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_pages(read(spark, sf, "documents", "doc_id", "text"), "doc_id", "text")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k.startswith("p") and k[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    words = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
    pairs = f"""w AS (SELECT doc_id, {words.format('content')} AS ws FROM store_documents),
            g AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 20)),
            n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
            b AS (SELECT x.doc_id AS doc_id_a, y.doc_id AS doc_id_b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
            pairs AS (SELECT doc_id_a, doc_id_b FROM b JOIN n p ON p.doc_id = doc_id_a JOIN n q ON q.doc_id = doc_id_b WHERE c::DOUBLE / (p.n + q.n - c) >= 0.6)"""
    # words of documents with their places; runs are told by the words, as in p6_found
    runs = f"""i AS (SELECT item_id, {words.format('text')} AS ws FROM eval_items WHERE text IS NOT NULL), k AS (SELECT *, least(12, len(ws)) AS k FROM i WHERE len(ws) > 0),
            ig AS (SELECT DISTINCT item_id, k, array_to_string(ws[j:j + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS j FROM k)),
            d AS (SELECT doc_id, {words.format('text')} AS ws, regexp_split_to_array(text, '[\\p{{L}}\\p{{N}}]+') AS gs FROM documents WHERE text IS NOT NULL),
            pl AS (SELECT doc_id, j, sum(length(gs[j]) + coalesce(length(ws[j - 1]), 0)) OVER (PARTITION BY doc_id ORDER BY j) AS b, b + length(ws[j]) AS e FROM (SELECT doc_id, ws, gs, unnest(range(1, len(ws) + 1)) AS j FROM d)),
            dk AS (SELECT doc_id, ws, k FROM d, (SELECT DISTINCT k FROM k) WHERE len(ws) >= k),
            dg AS (SELECT doc_id, k, j, array_to_string(ws[j:j + k - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(ws) - k + 2)) AS j FROM dk)),
            r AS (SELECT dg.doc_id, item_id, x.b, y.e FROM dg JOIN ig USING (k, s) JOIN pl x ON x.doc_id = dg.doc_id AND x.j = dg.j JOIN pl y ON y.doc_id = dg.doc_id AND y.j = dg.j + k - 1)"""

    sims = """WITH v AS (SELECT id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM multimodal_documents WHERE len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
            u AS (SELECT id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM v WHERE list_dot_product(v, v) > 0),
            s AS (SELECT a.id AS x, b.id AS y, round(list_dot_product(a.v, b.v), 6) AS s FROM u a JOIN u b ON a.id <> b.id)"""

    def stretches(keys: str) -> str:
        w = f"OVER (PARTITION BY {keys} ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND {{0}})"
        return f"(SELECT {keys}, min(b) AS b, max(e) AS e FROM (SELECT *, sum(CASE WHEN m IS NULL OR b > m THEN 1 ELSE 0 END) {w.format('CURRENT ROW')} AS part FROM (SELECT {keys}, b, e, max(e) {w.format('1 PRECEDING')} AS m FROM r)) GROUP BY {keys}, part)"

    return {
        "p1_found": f"WITH {pairs} SELECT doc_id_a, doc_id_b FROM pairs",
        "p1_classes": f"""WITH RECURSIVE {pairs}, links AS (SELECT doc_id_a AS x, doc_id_b AS y FROM pairs UNION ALL SELECT doc_id_b, doc_id_a FROM pairs),
            reach AS (SELECT doc_id, doc_id AS node FROM store_documents UNION SELECT doc_id, y FROM reach JOIN links ON x = node), low AS (SELECT doc_id, min(node) AS class_id FROM reach GROUP BY doc_id)
            SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM low""",
        "p4_neighbours": f"""{sims} SELECT x AS id, y AS neighbour, s AS similarity, row_number() OVER (PARTITION BY x ORDER BY s DESC, y) AS rank FROM s QUALIFY rank <= 10""",
        "p4_found": f"""{sims},
            t AS (SELECT x, y FROM s WHERE s >= 0.7 QUALIFY row_number() OVER (PARTITION BY x ORDER BY s DESC, y) <= 10) SELECT DISTINCT least(x, y) AS id_a, greatest(x, y) AS id_b FROM t""",
        "p6_found": f"WITH {runs} SELECT DISTINCT doc_id, item_id FROM r",
        "p6_spans": f"WITH {runs} SELECT doc_id, item_id, b::INT AS begin, e::INT AS \"end\" FROM {stretches('doc_id, item_id')}",
        "p6_clean": f"""WITH {runs}, z AS {stretches('doc_id')}, c AS (SELECT doc_id, b, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY b) AS before FROM z),
            o AS (SELECT doc_id, string_agg(substr(text, (before + 1)::BIGINT, (b - before)::BIGINT), '' ORDER BY b) || substr(any_value(text), (max(e) + 1)::BIGINT) AS kept, sum(e - b)::BIGINT AS gone FROM c JOIN documents USING (doc_id) GROUP BY doc_id)
            SELECT doc_id, coalesce(kept, text) AS text, coalesce(gone, 0) AS removed_chars FROM documents LEFT JOIN o USING (doc_id) WHERE text IS NULL OR coalesce(gone, 0) = 0 OR gone < 0.5 * length(text)""",
        "p3_rebuilt": "SELECT doc_id, md5(content) AS text_md5, true AS fits, true AS overlaps FROM store_documents d JOIN profiles p ON p.name = d.profile_name WHERE content IS NOT NULL AND chunk_size > 0 AND chunk_overlap BETWEEN 0 AND chunk_size - 1",
        "p3_found": "SELECT d.doc_id FROM store_documents d JOIN profiles p ON p.name = d.profile_name WHERE length(d.content) > p.chunk_size AND p.chunk_overlap < p.chunk_size",
    }
