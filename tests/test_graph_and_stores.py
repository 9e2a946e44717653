import itertools
import json
import random
import sqlite3
import tarfile
import zipfile
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from skein.operators import catalog, components, entities, graph, store, usage
from skein.operators.components import connected_components
from skein.plans import answer, config, providers
from skein.sources import files, sinks, stores
from skein.streaming.ingest import ingest, usage_windows


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def edges(spark):
    e = [("a", "r", "b"), ("b", "r", "c"), ("c", "r", "d"), ("a", "s", "c"), ("a", "r", "a"), ("x", "r", None), ("", "r", "a"), ("a", "r", "b")]
    return spark.createDataFrame([(i, *t, None) for i, t in enumerate(e)], "edge_id int, source string, relation string, target string, context string")


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (7, 7), (None, 3)]
    got = dict(rows(connected_components(spark.createDataFrame(chain, "src int, dst int"))))
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


def test_components_in_few_passes(spark, monkeypatch):
    rng = random.Random(5)
    name = lambda i: f"{'aé日𝒜'[i % 4]}{i:03}"
    pairs = [(name(i), name(i + 1)) for i in range(200) if i % 40] + [(name(a), name(a // 300 * 300 + rng.randrange(300))) for a in range(300, 900)] + [(None, "b"), ("c", "c")]
    root = {x: x for p in pairs if None not in p and p[0] != p[1] for x in p}
    for _ in range(200):
        for a, b in pairs:
            if a in root and b in root:
                root[a] = root[b] = min(root[a], root[b], key=lambda x: x.encode())
    made, write = [], components.written
    monkeypatch.setattr(components, "written", lambda df: made.append(1) or write(df))
    df = spark.createDataFrame(pairs, "src string, dst string").repartition(4)
    assert dict(rows(connected_components(df))) == root
    assert len(made) <= 2
    monkeypatch.setattr(components, "FOLD", 100)
    assert dict(rows(connected_components(df))) == root
    monkeypatch.setattr(components, "WHOLE", 0)  # the rounds
    assert dict(rows(connected_components(df))) == root


def test_expand_and_paths(spark, edges):
    seeds = spark.createDataFrame([("a",), ("zz",), (None,)], "seed string")
    assert rows(graph.expand(seeds, edges, 2)) == [("a", "b", 1), ("a", "c", 1), ("a", "d", 2)]
    pairs = spark.createDataFrame([("a", "d"), ("a", "a"), ("d", "a")], "source string, target string")
    assert rows(graph.simple_paths(pairs, edges, 3).select("path")) == [(["a", "r", "b", "r", "c", "r", "d"],), (["a", "s", "c", "r", "d"],)]
    v = spark.createDataFrame([("b", "Person", "the b")], "name string, entity_type string, description string")
    text = graph.context_text(seeds, edges, v, 2).first()["context"]
    assert "**Hop 1 Connections:**\n- **b** (Person)\n  - Description: the b" in text and "- **d** (Unknown)" in text


def test_parse_and_export(spark, edges, tmp_path):
    md = "## Entities\n- **A x** (Person): d\n- B (Tool): e\nbad\n**Relationships**\n- A x → likes → B (why)\n- B → is → C\n## Entities\n- C (X): "
    e, r = graph.parse_markdown(spark.createDataFrame([(1, md), (2, None)], "id int, content string"))
    assert rows(e.select("name", "entity_type")) == [("A x", "Person"), ("B", "Tool"), ("C", "X")]
    assert rows(r.select("source", "relation", "target", "context")) == [("A x", "likes", "B", "why"), ("B", "is", "C", "")]
    sinks.save_graph(e, r, str(tmp_path / "g.mmd"), "mermaid")
    assert (tmp_path / "g.mmd").read_text().startswith("graph TD\n") and 'A_x -->|"likes"| B' in (tmp_path / "g.mmd").read_text()
    sinks.save_graph(e, r.withColumn("edge_id", F.col("line_no")), str(tmp_path / "g.json"), "json")
    assert len(json.loads((tmp_path / "g.json").read_text())["links"]) == 2
    assert graph.collapsed(edges).where("source = 'a' and target = 'b'").first()["edge_id"] == 7


def test_entities(spark):
    df = spark.createDataFrame([(1, "The Acme Inc.", "ORG"), (2, "Acme Labs", "org"), (3, "acme", "PERSON"), (4, None, "ORG"), (5, "Zenith", "ORG"), (6, "Zenlth", "ORG"), (7, "ab", "ORG"), (8, "abc def", "ORG")], "record_id int, name string, entity_type string")
    assert rows(entities.similar_names(df).select("name_a", "name_b")) == [("ab", "abc def"), ("acme", "acme labs")]
    ratio = rows(entities.similar_names(df, 0.8, exact_ratio=True).select("name_a", "name_b"))
    assert ("zenith", "zenlth") in ratio
    assert {r["canonical"] for r in entities.clusters(df).where("name like 'acme%' and entity_type = 'org'").collect()} == {"acme labs"}
    texts = spark.createDataFrame([(1, "Dr Ada came. He saw Ada."), (2, None), (3, "It is")], "id int, content string")
    lists = spark.createDataFrame([(1, ["Dr Ada"])], "id int, entities array<string>")
    assert {r["id"]: r["content"] for r in entities.coreference(texts, lists).collect()} == {1: "Dr Ada came. He [Dr Ada] saw Ada.", 2: None, 3: "It is"}


def test_store(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", None), ("4", "y")], "doc_id string, content string")
    assert rows(store.deduplicated(a).select("doc_id")) == [("1",), ("3",), ("4",)]
    assert store.not_stored(a, a).where("content is not null").count() == 0
    new = spark.createDataFrame([("4", "z"), ("5", "w")], "doc_id string, content string")
    assert rows(store.upsert(a.where("content is not null"), new, "doc_id")) == [("1", "x"), ("2", "x"), ("4", "z"), ("5", "w")]
    m = lambda *x: spark.createDataFrame(list(x), "path string, mtime double")
    assert rows(store.changes(m(("a", 1.0), ("b", 1.0), ("c", 1.0)), m(("a", 1.0), ("b", 2.0), ("d", 1.0)))) == [("a", "unchanged"), ("b", "modified"), ("c", "deleted"), ("d", "new")]
    assert rows(store.blended([a.limit(1), new], "content", "doc_id")) == [("1", "x"), ("4", "z"), ("5", "w")]


def test_catalog_and_usage(spark):
    schema = "name string, display_name string, description string, created string, updated string, sources array<struct<path: string, added: string, embedding_model: string, documents: int, chunks: int>>, document_count int, chunk_count int, embedding_model string, model_history array<struct<timestamp: string, previous_model: string, new_model: string, source: string>>, tags array<string>"
    c = spark.createDataFrame([("a", "A", None, "2025-01-01T00:00:00", None, None, 5, 20, "m", None, ["x"]), ("b", "B", "", None, None, None, None, 10, None, None, None)], schema)
    c2 = catalog.record_source(c, "A", {"path": "p", "embedding_model": "n", "documents": 3, "chunks": 10}, "now")
    r = c2.where("name = 'a'").first()
    assert (r["document_count"], r["chunk_count"], r["embedding_model"], len(r["model_history"]), len(r["sources"])) == (8, 30, "n", 1, 1)
    assert rows(catalog.merged(c, "New One", ["a", "b"]).select("name", "document_count", "chunk_count")) == [("new-one", 5, 30)]
    assert catalog.create(c, spark.createDataFrame([("A", ""), ("My New", "d"), ("!", "")], "name string, description string"), F.lit("now")).count() == 3
    assert catalog.search(c, tags=["X"]).count() == 1
    u = spark.createDataFrame([(1, "OpenAI", "gpt-4o-mini-2024", 1000, 1000), (1, "OpenAI", "gpt-4o-mini-2024", 1000, 1000), (2, None, "m", None, 1000)], "call_id int, provider string, model string, input_tokens bigint, output_tokens bigint")
    got = {r["provider"]: (r["calls"], r["cost_usd"]) for r in usage.by(u, "provider").collect()}
    assert got == {"openai": (1, 0.00075), "unknown": (1, 0.002)}
    assert usage.by(u.limit(0)).first()["calls"] == 0


def test_files(spark, tmp_path):
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x.txt").write_text("no")
    (tmp_path / "a.md").write_text("# Heading\n\n## Subheading\ntext")
    (tmp_path / "b.csv").write_text("Name,Age\nAlice,30\n,\nBob,25,extra\n")
    (tmp_path / "c.xyz").write_text("?")
    (tmp_path / "d.docx").write_bytes(b"broken")
    with zipfile.ZipFile(tmp_path / "e.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    with zipfile.ZipFile(tmp_path / "f.pptx", "w") as z:
        z.writestr("ppt/slides/slide1.xml", '<p:sld xmlns:p="p" xmlns:a="a"><p:txBody><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:txBody></p:sld>')
    with zipfile.ZipFile(tmp_path / "g.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", '<w xmlns="s"><sheets><sheet name="S1"/></sheets></w>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="s"><si><t>k</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<w xmlns="s"><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></w>')
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.process(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.md", "b.csv", "c.xyz", "d.docx", "e.docx", "f.pptx", "g.xlsx"}
    assert got["c.xyz"]["type"] == "unsupported" and got["d.docx"]["error"] and not got["a.md"]["error"]
    c = {k: [x["content"] for x in v["chunks"]] for k, v in got.items()}
    assert c["b.csv"] == ["Name: Alice | Age: 30", "Name: Bob | Age: 25"] and len(c["a.md"]) == 2
    assert (c["e.docx"], c["f.pptx"], c["g.xlsx"]) == (["Hello", "a | b"], ["Title"], ["[Sheet: S1] k | 5"])
    assert files.discover(spark, str(tmp_path)).count() == 6
    assert files.chunks(files.process(spark, str(tmp_path))).count() == 8


def test_stores_and_sinks(spark, tmp_path):
    with sqlite3.connect(tmp_path / "s.db") as db:
        db.executescript("CREATE TABLE documents(doc_id TEXT, content TEXT, content_hash TEXT, doc_type TEXT, metadata TEXT, image_path TEXT); CREATE TABLE embeddings(doc_id TEXT, embedding BLOB); INSERT INTO documents VALUES('a','x','h','text','{}',NULL),('b','y','i','text','{}',NULL);")
        db.execute("INSERT INTO embeddings VALUES('a', ?)", (b"\0\0\x80?",))
    assert {r["doc_id"]: r["embedding"] for r in stores.read_sqlite(spark, [str(tmp_path / "s.db")]).collect()} == {"a": [1.0], "b": None}
    (tmp_path / "j.json").write_text(json.dumps({"d1": {"content": "c", "metadata": {"k": "v"}, "embedding": [1.0]}}))
    assert stores.read_json_store(spark, str(tmp_path / "j.json")).first()["metadata"] == {"k": "v"}
    m = spark.createDataFrame([("a", 1.5)], "path string, mtime double")
    sinks.write_manifest(m, str(tmp_path / "m.json"))
    assert rows(stores.read_manifest(spark, str(tmp_path / "m.json"))) == [("a", 1.5)]
    (tmp_path / "col").mkdir()
    (tmp_path / "col" / "f.txt").write_text("x")
    sinks.export_archive(str(tmp_path / "col"), str(tmp_path / "c.tgz"))
    assert (stores.import_archive(str(tmp_path / "c.tgz"), str(tmp_path), "new") / "f.txt").read_text() == "x"
    with tarfile.open(tmp_path / "bad.tgz", "w:gz") as t:
        t.add(tmp_path / "m.json", "../evil")
    with pytest.raises(ValueError):
        stores.import_archive(str(tmp_path / "bad.tgz"), str(tmp_path), "other")
    df = spark.createDataFrame([("1", "a"), ("2", "b")], "doc_id string, content string")
    sinks.write_store(df, str(tmp_path / "st"))
    sinks.upsert_store(str(tmp_path / "st"), spark.createDataFrame([("2", "z")], "doc_id string, content string"), "doc_id")
    assert rows(spark.read.parquet(str(tmp_path / "st"))) == [("1", "a"), ("2", "z")]


def test_streaming_is_idempotent(spark, tmp_path):
    src, st, cp = (str(tmp_path / x) for x in ("in", "st", "cp"))
    for batch in ([("1", "a"), ("2", "a"), ("3", None)], [("4", "a"), ("5", "b")]):
        spark.createDataFrame(batch, "doc_id string, content string").coalesce(1).write.mode("append").parquet(src)
        ingest(spark, src, st, cp).awaitTermination()
    assert rows(spark.read.parquet(st).select("content")) == [("a",), ("b",)]
    u = spark.createDataFrame([("2024-01-01 00:10:00", "A", 1, None), ("2024-01-01 00:50:00", "a ", 2, 3)], "ts string, provider string, input_tokens int, output_tokens int")
    assert rows(usage_windows(u).select("provider", "calls", "tokens")) == [("a", 2, 6)]


def test_answers(spark):
    e = providers.HashingEmbedder()
    texts = ["The harbour opened in 1920. It rains.", "Bread needs flour and water.", "Graphs have nodes."]
    corpus = spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(zip(texts, e.embed(texts), strict=True))], "id bigint, content string, vec array<double>")
    q = "When was the harbour opened?"
    queries = spark.createDataFrame([(1, q, e.embed([q])[0])], "query_id bigint, query_text string, query_vec array<double>")
    got, results = answer.answers(queries, corpus, providers.EchoModel())
    assert "1920" in got.first()["answer"] and results.count() == 3
    assert "1920" in sinks.report("R", got, results)
    same = corpus.select(providers.hashed_embedding(F.col("content")).alias("v"), "vec").first()
    assert same["v"] == pytest.approx(same["vec"])
    filled = providers.embedded(corpus.select("id", F.when(F.col("id") > 0, F.col("content")).alias("content")), providers.HashingEmbedder)
    assert filled.where("embedding is null").count() == 1


def test_models(spark):
    class Broken:
        def complete(self, prompt):
            raise RuntimeError("down")

    now = [0.0]
    f = providers.Fallback([("a", Broken()), ("b", providers.EchoModel())], clock=lambda: now[0])
    for _ in range(4):
        assert f.complete("x. Question: x").startswith("FINAL")
    assert f.failed["a"][0] == 3
    now[0] = 301
    f.complete("x. Question: x")
    assert f.failed["a"][0] == 4

    class Steps:
        def __init__(self, *said):
            self.said = list(said)

        def complete(self, prompt):
            return self.said.pop(0)

    assert answer.recursive_answer(Steps('RECURSE("sub")', "FINAL('1')", 'FINAL("""2""")'), "q", "t").answer == "2"
    assert answer.recursive_answer(Steps(*["r"] * 9), "q", "t", quality=lambda r: 0.9).iterations == 3
    assert config.profile("fast").chunk_size == 800
    with pytest.raises(ValueError):
        config.Profile(chunk_size=100, chunk_overlap=100)


def test_similar_names_against_all_pairs(spark):
    rng = random.Random(7)
    known = ["fi", "makozefi", "ksp", "sp", "msf", "sf", "fspb", "a", "ab", "abc", "ana", "anna", "abc def", "zenith", "zenlth", "banana banana", "banana bonana", "nananananana", "nanananana"]
    known += ["".join(rng.choice("abno ") for _ in range(rng.randint(1, 16))) for _ in range(150)]
    for word in ["levanzizu group holding", "brevuhabar publishing house", "kantolem works"]:
        known += ["".join(c for c in word if rng.random() > 0.1) for _ in range(15)]
    df = spark.createDataFrame([(i, n, "ORG") for i, n in enumerate(known)], "record_id int, name string, entity_type string")
    normal = sorted(r["name"] for r in entities.names(df).collect())
    for threshold, exact in ((0.85, False), (0.85, True), (0.8, True), (0.6, True), (0.75, False)):
        def alike(x, y):
            if x in y or y in x:
                return round(0.8 + 0.2 * min(len(x), len(y)) / max(len(x), len(y)), 6)
            return round(SequenceMatcher(None, x, y).ratio(), 6) if exact else 0
        want = [(x, y) for x, y in itertools.combinations(normal, 2) if alike(x, y) >= threshold]
        assert rows(entities.similar_names(df, threshold, exact).select("name_a", "name_b")) == want


def test_ratio_in_tiles_and_without_lookups_under_many_grams(spark, monkeypatch):
    rng = random.Random(11)
    base = ["".join(rng.choice("aeioubdgklmnrst ") for _ in range(rng.randint(8, 24))) for _ in range(90)]
    typed = lambda w: "".join(rng.choice("aeiné") if rng.random() < 0.06 else c for c in w if rng.random() > 0.04)
    data = [(i, typed(w), kind) for i, (w, kind) in enumerate((w, kind) for w in base for kind in ("person", "person", "person", "tool"))]
    df = spark.createDataFrame(data, "record_id int, name string, entity_type string")
    normal = [tuple(r) for r in entities.names(df).select("entity_type", "name").collect()]
    looked = []
    join = entities.in_tiles
    monkeypatch.setattr(entities, "in_tiles", lambda left, right, on, mark: looked.append(right.count()) or join(left, right, on, mark))
    for rows_ in (10, 70, 100_000):
        monkeypatch.setattr("skein.operators.likeness.ROWS", rows_)
        want = [(k, x, y) for (k, x), (l, y) in itertools.combinations(sorted(normal), 2) if k == l and x not in y and y not in x and round(SequenceMatcher(None, x, y).ratio(), 6) >= 0.85]
        got = [x for x in rows(entities.similar_names(df, exact_ratio=True).select("entity_type", "name_a", "name_b")) if x[1] not in x[2] and x[2] not in x[1]]
        assert want and got == want
    assert max(looked) <= len(normal)


def test_mentions_count_as_spellings(spark):
    data = [
        (1, "Ada Lovelace", "Person", ["the Countess", "she"]), (2, "Countess", "person", None), (3, "A. King", "person", ["Ada Lovelase", " ", None]), (4, "Zed", "person", ["she"]),
        (5, "Countess", "tool", []), (6, None, "person", ["Zed"]), (7, "Brevuhabar", "tool", ["x"]), (8, "Brevuhabra", "tool", None), (1, "Ada Lovelace", "Person", ["she"]),
    ]
    df = spark.createDataFrame(data, "record_id int, name string, entity_type string, mentions array<string>")
    by = {}
    for r in entities.spellings(df).collect():
        by.setdefault((r[0], r[1]), set()).add(r[2])
    sim = lambda x, y: 1.0 if x == y else round(0.8 + 0.2 * min(len(x), len(y)) / max(len(x), len(y)), 6) if x in y or y in x else round(SequenceMatcher(None, x, y).ratio(), 6)
    best = [(a[0], a[1], b[1], max(sim(min(x, y), max(x, y)) for x in by[a] for y in by[b])) for a, b in itertools.combinations(sorted(by), 2) if a[0] == b[0]]
    got = rows(entities.similar_records(df))
    assert got == [x for x in best if x[3] >= 0.85]
    assert [x[:3] for x in got] == [("person", "a king", "ada lovelace"), ("person", "ada lovelace", "countess"), ("person", "ada lovelace", "zed"), ("tool", "brevuhabar", "brevuhabra")]
    assert rows(entities.clusters(df, exact_ratio=True, mentions=True)) == [
        ("person", "a king", "ada lovelace", 4), ("person", "ada lovelace", "ada lovelace", 4), ("person", "countess", "ada lovelace", 4), ("person", "zed", "ada lovelace", 4),
        ("tool", "brevuhabar", "brevuhabar", 2), ("tool", "brevuhabra", "brevuhabar", 2), ("tool", "countess", "countess", 1),
    ]
    assert rows(entities.report(df, exact_ratio=True, mentions=True)) == [(7, 3, 2)]


@pytest.fixture
def spelled(spark, monkeypatch):
    """Records with mentions, and what is looked up under grams, to be told by the number of rows."""
    rng = random.Random(3)
    names = ["".join(rng.choice("aeioubdgklmnrst ") for _ in range(rng.randint(12, 22))) for _ in range(40)]
    typed = lambda w: "".join(c for c in w if rng.random() > 0.03)
    data = [(i, typed(w), "person", [typed(w), "the speaker"] if i % 9 == 0 else None) for i, w in enumerate(names * 2)]
    looked, join = [], entities.in_tiles
    monkeypatch.setattr(entities, "in_tiles", lambda left, right, on, mark: looked.append(right.count()) or join(left, right, on, mark))
    return spark.createDataFrame(data, "record_id int, name string, entity_type string, mentions array<string>"), looked


def test_clusters_by_mentions_look_up_each_spelling_once(spelled):
    df, looked = spelled
    got = {r["name"]: r["canonical"] for r in entities.clusters(df, exact_ratio=True, mentions=True).collect()}
    assert max(looked) <= entities.spellings(df).select("spelling").distinct().count()
    pairs = entities.similar_records(df).collect()
    assert pairs and all(got[p["name_a"]] == got[p["name_b"]] for p in pairs)


def test_similar_records_compare_once(spelled):
    df, _ = spelled
    plan = entities.similar_records(df)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "InArrow" not in plan


def test_report_by_mentions_looks_up_each_spelling_once(spelled):
    df, looked = spelled
    got = entities.report(df, exact_ratio=True, mentions=True).first()
    assert max(looked) <= entities.spellings(df).select("spelling").distinct().count()
    assert got["names"] == entities.names(df).count() > got["canonical_names"]


def test_report_by_mentions_normalises_names_once(spelled, monkeypatch):
    df, _ = spelled
    want = tuple(entities.report(df, exact_ratio=True, mentions=True).first())
    monkeypatch.setattr(entities, "names", lambda df: pytest.fail("the spellings hold the names"))
    assert tuple(entities.report(df, exact_ratio=True, mentions=True).first()) == want


def test_renamed_edges_by_mentions_look_up_each_spelling_once(spark, spelled):
    df, looked = spelled
    cluster = entities.clusters(df, exact_ratio=True, mentions=True)
    known = {r["name"]: r["canonical"] for r in cluster.collect()}
    edges = spark.createDataFrame([(a, "nobody") for a in known], "source string, target string")
    assert rows(entities.renamed_edges(edges, cluster).select("source", "target")) == sorted((c, "nobody") for c in known.values())
    assert max(looked) <= entities.spellings(df).select("spelling").distinct().count()


def test_rarest_grams_are_found_without_sorting(spark, spelled, monkeypatch):
    df, _ = spelled
    looked = []
    monkeypatch.setattr(entities, "in_tiles", lambda left, right, on, mark: looked.append(right) or left.join(right, on))
    n = entities.names(df).select("entity_type", "name").unionByName(spark.createDataFrame([("x", "aé"), ("x", "日本é日本"), ("x", "𝒜𝒜b𝒜𝒜c")], "entity_type string, name string"))
    entities._contained(n, 0.85)
    assert "SortAggregate" not in looked[0]._jdf.queryExecution().sparkPlan().toString()
    got = {r["x"]: r["gram"] for r in looked[0].collect()}
    grams = {r["name"]: {r["name"][i : i + 3] for i in range(max(1, len(r["name"]) - 2))} for r in n.collect()}
    held = Counter(g for x in grams.values() for g in x)
    assert got.keys() == grams.keys() and all(got[x] in grams[x] and held[got[x]] == min(held[g] for g in grams[x]) for x in got)


def test_resolved_triples(spark):
    data = [
        (1, "Dr Ada", "knows", "Engine", "d"), (2, "He", "built", "it", "d"), (3, "Nobody", "saw", "Engine", "d"), (4, "they", "own", "Mill", "d"), (5, "she", "sees", "Engine", "d"),
        (1, "it", "is", "Mill", "e"), (2, None, "is", "Mill", "e"), (3, "Mill", None, "Engine", "e"), (4, "its", "x", "Dr Ada", None), (5, "Mill", "x", "Mill", None),
    ]
    edges = spark.createDataFrame(data, "edge_id bigint, source string, relation string, target string, doc_id string")
    known = spark.createDataFrame([("Dr Ada",), ("Engine",), ("Mill",), ("Mill",), (None,)], "name string")
    got = {(r.doc_id, r.edge_id): (r.source, r.relation, r.target) for r in entities.resolved_triples(edges, known).collect()}
    assert got == {
        ("d", 1): ("Dr Ada", "knows", "Engine"), ("d", 2): ("Dr Ada", "built", "Engine"), ("d", 4): ("Engine", "own", "Mill"), ("d", 5): ("Mill", "sees", "Engine"),
        ("e", 3): ("Mill", None, "Engine"), (None, 5): ("Mill", "x", "Mill"),
    }
    assert entities.resolved_triples(edges.limit(0), known).count() == 0
