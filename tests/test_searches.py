import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.functions.sql import register
from skein.operators import catalog, chunking, context, dense, entities, graph, keyword, rerank, skew, store
from skein.plans import answer, providers, tables
from skein.plans.config import Profile
from skein.plans.facade import Rag
from skein.sources import files, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


WORDS = "harbour garden museum kiln ferry bridge cellar mill opened moved sold the of a in".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    data = [(i, " ".join(rng.choice(WORDS, int(rng.integers(1, 30)))), rng.normal(size=6).round(3).tolist(), "ab"[i % 2]) for i in range(300)]
    data += [(900, None, None, "a"), (901, "", [0.0] * 6, "a"), (902, "kiln", [1.0], "b"), (903, "mill", [float("nan")] * 6, "b"), (904, data[0][1], data[0][2], "a")]
    return spark.createDataFrame(data, "id bigint, content string, vec array<double>, part string")


def asked(corpus):
    return corpus.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("content").alias("query_text"), F.col("vec").alias("query_vec"))


def test_broadcast_and_sliced_searches_agree(corpus):
    q, c = asked(corpus), corpus.select("id", "content", "vec")
    for how, k in ((dense.cosine_topk, 7), (dense.l2_topk, 7), (keyword.substring_topk, 7), (keyword.overlap_topk, 7), (keyword.like_filter, 7), (keyword.bm25_topk, 7)):
        whole = rows(how(q, c, k))
        assert whole == rows(how(q, c, k, block_bytes=200)) and len(whole) > 50
        some = {r[1] for r in rows(how(q, corpus, k, where=F.col("part") == "a"))}
        assert some and not some & {r[0] for r in rows(corpus.where("part = 'b'").select("id"))}


def test_searches_against_brute_force(corpus):
    data = [(r["id"], r["content"], r["vec"]) for r in corpus.collect()]
    good = [(i, np.array(v)) for i, _, v in data if v and len(v) == 6 and np.isfinite(v).all()]
    want = []
    for r in asked(corpus).collect():
        if r["query_vec"] is None or not any(r["query_vec"]):
            continue
        q = np.array(r["query_vec"])
        s = sorted((-round(float(v @ q / (np.linalg.norm(v) * np.linalg.norm(q) or 1)), 6), i) for i, v in good if i != r["query_id"])[:4]
        want += [(r["query_id"], i, -x) for x, i in s]
    got = rows(dense.cosine_topk(asked(corpus), corpus, 4, exclude_self=True).select("query_id", "id", "similarity"))
    assert [g[:2] for g in got] == sorted(w[:2] for w in want)
    for r in asked(corpus).collect():
        terms = set((r["query_text"] or "").split())
        if terms:
            s = sorted((-(100 * sum(t in c for t in terms) / len(terms) + 100 * (r["query_text"] in c)), i) for i, c, _ in data if c is not None)
            s = [x for x in s if x[0] < 0][:3]
            assert [i for _, i in s] == [x["id"] for x in keyword.substring_topk(asked(corpus).where(F.col("query_id") == r["query_id"]), corpus, 3).orderBy("rank").collect()]
            break
    zero = keyword.substring_topk(asked(corpus).limit(0).union(corpus.sparkSession.createDataFrame([(1, "zzz kiln", None)], asked(corpus).schema)), corpus, 500, keep_zero=True)
    assert zero.count() == corpus.where("content is not null").count()


def test_joins_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS", 10)
    left = spark.createDataFrame([("h", i) for i in range(95)] + [("c", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("h", 1), ("h", 2), ("c", 3), ("n", 4), (None, 5)], "k string, y int")
    assert rows(skew.in_tiles(left, right, ["k"], "x")) == rows(left.join(right, "k"))


def test_plain_store_operations(spark):
    a = spark.createDataFrame([(0, "x"), (5, None), (None, "y")], "id bigint, content string")
    assert [r["id"] for r in store.merged_stores([a, a]).orderBy("id").collect()] == [None, None, 0, 5, 6, 11]
    assert store.clear(a).count() == 0 and store.clear(a).columns == a.columns
    kv = store.set_values(spark.createDataFrame([("a", "1")], "key string, value string"), spark.createDataFrame([("a", "2"), (None, "3"), ("b", "4")], "key string, value string"))
    assert store.get_value(kv, "a") == "2" and store.get_value(kv, "z") is None
    assert rows(store.without_blank(a).select("id").where("id is not null")) == [(0,)]
    t = spark.createDataFrame([(1, "Audio", "said"), (2, "audio", " "), (3, "pdf", "x")], "id int, doc_type string, content string")
    assert rows(store.transcripts(t).select("id")) == [(1,)]
    twice = spark.createDataFrame([("k", "b", 1), ("k", "a", 2)], "id string, v string, n int")
    old = twice.limit(0)
    assert rows(store.upsert(old, twice, "id"))[0][1] == "a" and rows(store.upsert(old, twice, "id", order=F.col("n")))[0][1] == "b"
    parts = spark.createDataFrame([("f", i, str(i)) for i in range(5)], "file string, n int, content string")
    assert store.reassembled(parts, "file", "n", most=2).first()["content"] == "0\n\n1" and len(store.reassembled(parts, "file", "n", most=None).first()["content"]) == 13
    i = spark.createDataFrame([("p", "d")], "p string, d string").select(store.image_hash(F.col("p"), F.col("d")), store.image_hash(F.lit(None).cast("string"), F.col("d"))).first()
    assert len(i[0]) == 64 and i[0] != i[1]
    found = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 6, "c")], "query_id int, rank int, id string")
    images = spark.createDataFrame([("a", "1.png"), ("b", " "), ("b", "2.png"), ("c", "3.png")], "id string, image_path string")
    assert rows(store.with_images(found, images).select("image_path")) == [("1.png",), ("2.png",)]


def test_catalog_operations(spark):
    c = spark.createDataFrame([("a-b", "A b", 2, ["s", "s"]), ("z", "Z", None, None), (None, "n", 1, [])], "name string, display_name string, document_count int, paths array<string>")
    c = c.select("name", "display_name", "document_count", F.lit(0).alias("chunk_count"), F.transform("paths", lambda p: F.struct(p.alias("path"))).alias("sources"), F.array().cast("array<string>").alias("model_history"))
    assert catalog.exists(c, " A b") and not catalog.exists(c, "q")
    assert rows(catalog.listed(catalog.delete(c, "Z")).select("position", "name")) == [(1, "a-b")]
    assert catalog.delete(c, "z").count() == 2
    emptied, sources = catalog.reindexed(c, ["A b"])
    assert rows(sources) == [("a-b", 0, "s")] and {r["name"]: r["document_count"] for r in emptied.collect()} == {"a-b": 0, "z": None, None: 1}
    g = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("a", 3, " "), ("b", 1, None)], "name string, position int, graph string")
    assert rows(catalog.joined_graphs(g)) == [("a", "x\n\n---\n\ny")]
    s = spark.createDataFrame([("a-b", "éa", None), ("a-b", "b", "p.png")], "collection_name string, content string, image_path string")
    assert {r["name"]: tuple(r)[1:] for r in catalog.usage_of(c, s).collect()}["a-b"] == (2, 4, True, True, 0)


def test_headers_and_quoted_cells(spark):
    df = spark.createDataFrame([(1, "a\n\t# B\nx\n\n  ## C\n\n"), (2, "# A"), (3, "x # y")], "id int, content string")
    assert rows(chunking.by_headers(df)) == [(1, 1, "a"), (1, 2, "\t# B\nx\n"), (1, 3, "  ## C\n\n"), (2, 1, "# A"), (3, 1, "x # y")]
    assert [c for _, _, c in rows(chunking.by_headers(df.where("id = 1")))] == files.headed("a\n\t# B\nx\n\n  ## C\n\n")
    t = spark.createDataFrame([(1, 'Name,City\n"Doe, Jane",NYC\n"A ""b""\nc",\n'), (2, ""), (3, None)], "id int, content string")
    assert rows(chunking.table_rows(t)) == [(1, 1, "Name: Doe, Jane | City: NYC"), (1, 2, 'Name: A "b"\nc')]
    long = "\n".join("# h" if i % 2 else "x" for i in range(40_000))
    assert chunking.by_headers(spark.createDataFrame([(1, long)], "id int, content string")).count() == 20_001
    text, chunks = files.parse_csv(b"A,B\n1,2\n")
    assert text == "Columns: A, B\nTotal rows: 1\nRow 1: A | B\nRow 2: 1 | 2" and len(chunks) == 1
    assert files.parse_transcript(b"1\n00:00 --> 00:01\nhello there\n")[0] == "hello there"


def coreference_by_hand(text, names):
    """Straight from the definition: who was mentioned is kept with the time of the last mention."""
    last, out = {}, []
    for at, word in enumerate(text.split()):
        bare = re.sub(r"^[.,;:!?()\[\]{}\"']+|[.,;:!?()\[\]{}\"']+$", "", word.lower())
        recent = sorted(last, key=lambda n: -last[n])[:5]
        if bare in entities.PRONOUNS and recent:
            kind = {"he": 1, "him": 1, "his": 1, "it": 2, "its": 2}.get(bare, 0)
            fits = [n for n in recent if (kind == 1 and any(t in n.lower() for t in entities.TITLED)) or (kind == 2 and not any(t in n.lower() for t in ("mr", "mrs", "person")))]
            out.append(f"{word} [{(fits or recent)[0]}]")
            continue
        hit = next((n for n in names if bare and (bare in n.lower() or n.lower() in bare)), None)
        if hit is not None and hit.lower() != bare:
            last[hit] = at
        out.append(word)
    return " ".join(out)


def test_coreference_by_hand(spark):
    rng = np.random.default_rng(9)
    names = ["Dr Ada", "Mrs Bee", "Mill", "Old Kiln", "Sea Engine", "Prof Cy", "Harbour Light", "It"]
    words = ["he", "She,", "it.", "They", "his", "Ada", "(Bee)", "the", "mill", "Kiln", "engine", "Cy", "harbour", "ran", "sea", "—"]
    texts = [(i, "  ".join(rng.choice(words, int(rng.integers(0, 40))))) for i in range(120)] + [(500, None), (501, " \n")]
    lists = [(i, list(rng.permutation(names)[: int(rng.integers(0, 9))])) for i in range(0, 118)]
    df = spark.createDataFrame(texts, "id int, content string").withColumn("word", F.lit("other"))
    got = {r["id"]: r["content"] for r in entities.coreference(df, spark.createDataFrame([(i, [str(x) for x in n]) for i, n in lists], "id int, entities array<string>")).collect()}
    by = dict(lists)
    assert got == {i: None if t is None else coreference_by_hand(t, [str(x) for x in by.get(i, [])]) for i, t in texts}
    assert entities.coreference(df.limit(0), df.limit(0).select("id", F.array().cast("array<string>").alias("entities"))).count() == 0


def test_merge_groups(spark):
    df = spark.createDataFrame([(1, "acme", "ORG"), (2, "acme labs", "org"), (3, "zen", "org")], "record_id int, name string, entity_type string")
    assert rows(entities.merge_groups(df)) == [("org", "acme labs", "acme; acme labs")]


def embedded(spark, texts):
    e = providers.HashingEmbedder()
    return spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(zip(texts, e.embed(texts), strict=True))], "id bigint, content string, vec array<double>")


def test_unified_contexts(spark):
    texts = ["The harbour opened in 1920. It rains.", "Bread needs flour and water.", "Graphs have nodes.", "Ferry lines cross the harbour."]
    corpus = embedded(spark, texts)
    q = corpus.where("id = 0").select(F.lit(1).cast("bigint").alias("query_id"), F.lit('When was "Old Mill" and the harbour opened?').alias("query_text"), F.col("vec").alias("query_vec"))
    edges = spark.createDataFrame([(1, "Old Mill", "near", "Harbour", None)], "edge_id int, source string, relation string, target string, context string")
    v = spark.createDataFrame([("Harbour", "Location", "a port")], "name string, entity_type string, description string")
    subs = spark.createDataFrame([(1, 0, "Bread needs flour and water")], "query_id bigint, position int, text string")
    p = Profile(graph_augmented=True, multi_query=True)
    c, results = answer.contexts(q, corpus, p, 4000, subs, graph_text="# KG", vertices=v, edges=edges)
    text = c.first()["context"]
    assert text.startswith("# KG\n\n[Source 1]") and "- **Harbour** (Location)" in text and "flour" in text and results.count() == 4
    short, _ = answer.contexts(q, corpus, Profile(), 60)
    assert len(short.first()["context"]) == 60
    none, _ = answer.contexts(q, corpus.limit(0), Profile())
    assert none.first()["context"] is None
    with pytest.raises(ValueError):
        answer.answers(q, corpus, providers.EchoModel(), most=0)
    assert answer.dense_reranked(q, corpus, 2).count() == 2 and answer.dense_reranked(q, corpus, 2, 4, providers.OverlapReranker()).first()["rank"] == 1
    silent = q.withColumn("query_text", F.lit("zzz"))
    assert [r["id"] for r in answer.fused(silent, corpus).orderBy("rank").collect()][0] == 0
    assert answer.blended_corpus([corpus, corpus.withColumn("id", F.col("id") + 2)]).count() == 4


def test_facade(spark):
    rag = Rag(spark, providers.EchoModel())
    docs = spark.createDataFrame([("a", "The harbour opened in 1920."), ("b", "Bread needs flour."), ("c", None), ("d", "Bread needs flour.")], "id string, content string")
    rag.add(docs).add(docs)
    assert rag.corpus.count() == 2
    said, sources = rag.query_with_sources("When was the harbour opened?")
    assert "1920" in said and "1920" in rag.query("When was the harbour opened?") and sources.first()["id"] == "a#1"
    assert {r["id"] for r in rag.search(["bread flour", "harbour"], k=1, where=F.col("id").startswith("b")).collect()} == {"b#1"}
    with pytest.raises(ValueError):
        Rag(spark).query("x")


def test_sql_functions(spark):
    register(spark)
    got = spark.sql("SELECT t.id, w.chunk_no, w.chunk FROM (SELECT 1 AS id, repeat('x', 250) AS c UNION ALL SELECT 2, NULL) t, LATERAL skein_windows(t.c, 100, 20) w")
    assert [(r["id"], r["chunk_no"], len(r["chunk"])) for r in got.orderBy("chunk_no").collect()] == [(1, 1, 100), (1, 2, 100), (1, 3, 90)]
    assert [r["chunk"] for r in spark.sql("SELECT * FROM skein_transcript('aa bb cc dd', 5)").collect()] == ["aa bb", "cc dd"]


def test_contexts_and_sinks(spark, tmp_path):
    r = spark.createDataFrame([(1, 1, "a", "one\ntwo", "f.pdf", 3, 50.0)], "query_id int, rank int, id string, content string, source string, page int, composite_score double")
    assert context.references(r, page="page").first()["context"] == "[Ref 1 (f.pdf P3)] one two"
    assert context.with_metadata(r, "source").first()["context"] == "[Document 1]\none\ntwo\nMetadata: f.pdf"
    assert context.with_graph(context.numbered(r), "G" * 9000, 30_000).first()["context"].startswith("G" * 8000 + "\n\n[Source 1] (score: 50.0)")
    assert rows(context.extraction_inputs(r.select("id", F.lit("x" * 3000).alias("content")), 1000))[0][1] == "x" * 2000
    ranked = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "query_id int, rank int, id string")
    from skein.operators.ranking import reorder

    assert [x["id"] for x in reorder(ranked, spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.9)], "query_id int, id string, rerank_score double"), 1).collect()] == ["b"]
    v = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "v array<double>")
    assert sinks.write_vectors(v, str(tmp_path / "v"), "v", 2) == (1, 2)
    assert sinks.json_lines(r.select("id", F.lit(None).cast("string").alias("n"))).first()["json"] == '{"id":"a"}'


def test_shared_folder(spark):
    df = tables.written(spark.range(3))
    assert df.count() == 3 and tables.forget(spark) >= 1 and tables.forget(spark) == 0


def test_hub_expansion(spark, monkeypatch):
    monkeypatch.setattr(skew, "ROWS", 8)
    e = [("hub", "r", f"n{i:02}") for i in range(40)] + [("a", "r", "hub"), ("n01", "r", "far")]
    edges = spark.createDataFrame([(i, *t, None) for i, t in enumerate(e)], "edge_id int, source string, relation string, target string, context string")
    got = {(r["node"], r["depth"]) for r in graph.expand(spark.createDataFrame([("a",)], "seed string"), edges, 3).collect()}
    assert got == {("hub", 1), ("far", 3)} | {(f"n{i:02}", 2) for i in range(40)}


def test_partial_ratio_is_the_best_window(spark):
    df = spark.createDataFrame([("kiln sale", "the kiln sals is"), ("abc", "abc")], "a string, b string")
    got = [r[0] for r in df.select(rerank.partial_ratio("a", "b")).collect()]
    assert got[1] == 100 and 80 < got[0] < 100 and list(itertools.pairwise(got))


def test_transcripts_are_kept(spark, tmp_path):
    class Upper:
        def transcribe(self, paths):
            with open(paths[0].rsplit("/", 1)[0] + "/log", "a") as log:
                log.write("".join(p[-1] for p in paths))
            return [None if p.endswith("z") else p[-1].upper() for p in paths]

    df = spark.createDataFrame([(f"{tmp_path}/{c}", 1.0, 5) for c in "abz"] + [(None, 1.0, 1)], "path string, mtime double, length int").coalesce(1)
    first = providers.transcribed(df, Upper, str(tmp_path / "cache"))
    assert sorted(str(r["transcript"]) for r in first.collect()) == ["A", "B", "None"]
    again = providers.transcribed(df.withColumn("mtime", F.when(F.col("path").endswith("b"), 2.0).otherwise(F.col("mtime"))), Upper, str(tmp_path / "cache"))
    assert sorted(str(r["transcript"]) for r in again.collect()) == ["A", "B", "None"]
    assert sorted((tmp_path / "log").read_text()) == list("abbzz") and providers.transcribed(df.limit(0), Upper).count() == 0
    assert providers.progress(spark) == []


def test_runs_compared(spark):
    a = spark.createDataFrame([(1, "x\ny"), (2, "same"), (3, None)], "query_id int, answer string")
    b = spark.createDataFrame([(1, "x\nz"), (2, "same"), (4, "new")], "query_id int, answer string")
    got = {r["query_id"]: (r["changed"], r["diff"]) for r in context.compared(a, b).collect()}
    assert got[1] == (True, "--- one\n+++ two\n@@ -1,2 +1,2 @@\n x\n-y\n+z") and got[2] == (False, "") and got[3] == (False, "") and got[4][1].endswith("+new")
    assert context.compared(a, b, 2).where("query_id = 1").first()["diff"].count("\n") == 1


def test_many_queries_at_once_take_bounded_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from skein.operators import blocks, dense, keyword

    rng = np.random.default_rng(5)
    lists = [[f"w{i}" for i in rng.choice(60, 30, replace=False)] for _ in range(3000)]
    inc = keyword.Incidence(lists, [rng.random(30).tolist() for _ in lists])
    some = [{int(t): float(x) for t, x in zip(rng.choice(60, 40, replace=False), rng.random(40), strict=True)} for _ in range(120)]
    tracemalloc.start()
    got = inc.sums([*some, {}])
    assert tracemalloc.get_traced_memory()[1] < 100e6
    weight = np.zeros((len(inc.place), inc.n))
    np.add.at(weight, (np.repeat(np.arange(len(inc.place)), np.diff(inc.begin)), inc.query), inc.weight)
    worth = np.array([[r.get(t, 0.0) for t in range(len(inc.place))] for r in [*some, {}]])
    assert np.allclose(got, worth @ weight) and not got[-1].any()

    q, x, k = rng.normal(size=(4000, 8)), rng.normal(size=(5000, 8)), 3
    batch = pa.record_batch({"id": np.arange(5000), "vec": pa.array(x.tolist())})
    tracemalloc.reset_peak()
    before, best = tracemalloc.get_traced_memory()[0], blocks.Best(k, len(q)) if blocks.Best.__init__.__code__.co_argcount > 2 else blocks.Best(k)
    for part in (batch.slice(0, 4000), batch.slice(4000)):
        for query, row, value in dense._cosines({8: (np.arange(4000), dense._unit(q))}, part, k):
            best.add(query, np.asarray(part.column("id"))[row], value)
    assert tracemalloc.get_traced_memory()[1] - before < 150e6
    tracemalloc.stop()
    best.prune()
    s = blocks.half_up(dense._unit(x) @ dense._unit(q).T)
    for j in range(0, 4000, 97):
        want = sorted(range(5000), key=lambda i: (-s[i, j], i))[:k]
        mine = best.parts[0][0] == j
        assert best.parts[0][1][mine].tolist() == want
