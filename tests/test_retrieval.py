import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.operators import chunking, context, dense, keyword, ranking, rerank


def rows(df):
    return [tuple(r) for r in df.collect()]


def one(spark, expr, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(expr).first()[0]


def lists(spark, ids):
    return spark.createDataFrame([(1, i, n) for n, i in enumerate(ids, 1)], "query_id int, id int, rank int")


def test_rrf_numbers(spark):
    got = {r["id"]: r["score"] for r in ranking.fuse([(lists(spark, [1, 2, 4]), 4.0), (lists(spark, [2, 3, 1]), 1.0)]).collect()}
    assert got == pytest.approx({1: 4 / 60 + 1 / 62, 2: 4 / 61 + 1 / 60, 4: 4 / 62, 3: 1 / 61})


def test_rrf_keeps_order_of_one_list(spark):
    assert [r["id"] for r in ranking.fuse([(lists(spark, [3, 1, 2]), 1.0)], limit=3).orderBy("rank").collect()] == [3, 1, 2]


def test_dense_edges(spark):
    corpus = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [0.0, 1.0]), (6, [1.0])], "id bigint, vec array<float>")
    queries = spark.createDataFrame([(1, [2.0, 0.0]), (9, [0.0, 0.0]), (8, None)], "query_id bigint, query_vec array<float>")
    got = dense.cosine_topk(queries, corpus, 10).orderBy("rank").select("query_id", "id", "similarity", "rank")
    assert rows(got) == [(1, 1, 1.0, 1), (1, 2, 1.0, 2), (1, 3, 0.0, 3), (1, 5, 0.0, 4)]
    blocks = dense.cosine_topk_blocks(queries, corpus, 2, 10).orderBy("rank").select("query_id", "id", "similarity", "rank")
    assert rows(blocks) == rows(got)
    assert rows(dense.l2_topk(queries.where("query_id = 1"), corpus, 1).select("id", "distance", "raw_score")) == [(1, 1.0, 50.0)]
    assert dense.cosine_topk(queries, corpus.limit(0), 3).count() == 0


def test_keyword_scorers(spark):
    corpus = spark.createDataFrame([(0, "Machine learning is fun, machine LEARNING"), (1, "deep learning"), (2, "natural language"), (3, None), (4, "")], "id int, content string")
    q = spark.createDataFrame([(1, "machine learning"), (2, None), (3, "  ")], "query_id int, query_text string")
    assert rows(keyword.substring_topk(q, corpus, 5).select("query_id", "id", "keyword_score")) == [(1, 0, 200.0), (1, 1, 50.0)]
    assert rows(keyword.overlap_topk(q, corpus, 5).select("id", "keyword_score")) == [(0, 1.0), (1, 0.5)]
    assert rows(keyword.bm25_topk(q, corpus, 5).orderBy("rank").select("id"))[0] == (0,)
    assert rows(keyword.like_filter(q, corpus, 5).select("id", "raw_score")) == [(0, 100.0), (1, 100.0)]
    assert keyword.bm25_topk(q, corpus.limit(0), 5).count() == 0


@pytest.mark.parametrize(("n", "score"), [(0, 50), (199, 99.75), (200, 100), (600, 100), (601, 99.95), (2000, 50)])
def test_length_score(spark, n, score):
    assert one(spark, T.length_score(F.col("c")), c="x" * n) == pytest.approx(score)


def test_rerank_distance_edges(spark):
    df = spark.createDataFrame([(1, "alpha", i, "alpha " * 50, d, 1) for i, d in enumerate([-1e-9, 0.0, 1e-3, 10.0, None])], "query_id int, query_text string, id int, content string, semantic_score double, rank int")
    got = {r["id"]: r["composite_score"] for r in rerank.multi_factor(df, 9).collect()}
    assert got[0] == got[1] == got[4] == pytest.approx(got[2] - 0.35 * (100 / 1.0001 - 80), abs=1e-4)
    vec = {r["id"]: r["vec"] for r in rerank.composite(df, 9).collect()}
    assert (vec[1], vec[3], vec[4]) == (100.0, 50.0, 80.0)
    assert rerank.by_provider(df, lambda q, d: [(i, i / 10) for i in range(len(d))], 2).count() == 2


def test_partial_ratio(spark):
    df = spark.createDataFrame([("abc", "xxabcxx"), ("", "a"), (None, "a")], "a string, b string")
    assert [r[0] for r in df.select(rerank.partial_ratio("a", "b")).collect()] == [100.0, 0.0, 0.0]


def test_texts(spark):
    assert one(spark, T.slug(F.col("c")), c="  Test Collection ") == "test-collection"
    assert one(spark, T.slug(F.col("c")), c="!!") is None
    assert one(spark, T.normal_name(F.col("c")), c="The  Acme, Inc.") == "acme,".replace(",", "")
    assert one(spark, T.final_answer(F.col("c")), c='so FINAL("""a "b" c""")') == 'a "b" c'
    assert one(spark, T.final_answer(F.col("c")), c="none") is None
    assert one(spark, T.final_variable(F.col("c")), c="FINAL_VAR( out )") == "out"
    assert one(spark, T.code_blocks(F.col("c")), c="```python\nx\n```\n```\ny\n```") == ["x\n"]
    assert one(spark, T.keywords(F.col("c")), c="The 知识 of Graphs, x") == ["知", "识", "graphs"]
    assert one(spark, T.report_score(F.col("c")), c="Score: 73 and 81/100") == 81
    assert one(spark, T.token_overlap(F.col("q"), F.col("c")), q="a b", c="b c d") == 50.0


def test_chunkers(spark):
    df = spark.createDataFrame([(1, "intro\n# A\nx\n  ## B\n\n"), (2, None), (3, ""), (4, "  \n")], "id int, content string")
    assert rows(chunking.by_headers(df)) == [(1, 1, "intro"), (1, 2, "# A\nx"), (1, 3, "  ## B\n\n")]
    long = spark.createDataFrame([(1, "Word " * 100)], "id int, content string")
    assert all(len(r["chunk"]) <= 101 for r in chunking.by_window(long, 100, 20).collect())
    assert chunking.sliding_window("x" * 250, 100, 20) == ["x" * 100, "x" * 100, "x" * 90]
    assert chunking.sliding_window("Short text", 100, 20) == ["Short text"]
    assert chunking.sliding_window("abc. " * 40, 100, 0)[0].endswith(".")
    with pytest.raises(ValueError):
        chunking.by_window(long, 100, 100)
    assert chunking.transcript("aa bb cc dd", 5) == ["aa bb", "cc dd"]
    assert [r["chunk"] for r in chunking.fixed(spark.createDataFrame([(1, "abcdefgh")], "id int, content string"), 4, 1).collect()] == ["abcd", "defg", "gh"]
    table = spark.createDataFrame([(1, "Name,City\nAlice,NYC\n,\nBob,,LA")], "id int, content string")
    assert [r["chunk"] for r in chunking.table_rows(table).collect()] == ["Name: Alice | City: NYC", "Name: Bob"]


def test_context(spark):
    r = spark.createDataFrame([(1, 2, "b", "two", 0.5), (1, 1, "a", "one", 0.1), (1, 3, "c", None, 0.2)], "query_id int, rank int, id string, content string, semantic_score double")
    assert context.simple(r).first()["context"] == "one\n\ntwo\n\n"
    assert context.citations(r).first()["context"] == "[1] one\n\n[2] two\n\n[3] "
    assert context.numbered(r).first()["context"].startswith("[Source 1] (score: 90.0)\none")
    assert context.detailed(r, "id").first()["context"].split("\n")[0] == "[1] Source: a [Relevance: 90.0%]"
    assert context.within_budget(r, 3).count() == 1
