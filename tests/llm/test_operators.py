import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import leaks, mixing, names, near_copies, neighbours, scans, splitting
from skein.llm import keyword_pages as kp
from skein.llm import queries as llm
from skein.llm.words import Words, slices


def W(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def runs(words, k):
    return set(zip(*(words[i:] for i in range(k)), strict=False)) if k else set()


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def sentence(rng, n=30):
    return " ".join("w%d" % i for i in rng.integers(0, 400, n))


def clashing(df, *names_):
    """The same rows with further columns of names the operators use inside."""
    for n in names_:
        if n not in df.columns:
            df = df.withColumn(n, F.lit("other"))
    return df


# words


def test_words_are_runs_of_letters_and_digits():
    texts = ["Ab c_d1, É²!", "", "  ", "知识 图谱x", "ab C"]
    w = Words(texts)
    assert [(int(w.doc[i]), w.text(i)) for i in range(len(w.h))] == [(i, x) for i, t in enumerate(texts) for x in W(t)]
    assert w.h[0] == w.h[-2] and len(Words([]).h) == len(Words([""]).h) == 0
    g, at = Words(["a b c", "b c"]).grams(2)
    assert list(at) == [0, 1, 3] and g[1] == g[2]
    assert list(slices(["a" * 5, "b" * 5, "c" * 20], 10)) == [(0, 2), (2, 3)]


# problem 1


def brute_pairs(texts, k, least, min_words):
    words = {i: W(t) for i, t in texts}
    s = {i: runs(w, k) for i, w in words.items() if len(w) >= max(k, min_words)}
    return sorted((a, b) for a, b in itertools.combinations(sorted(s), 2) if len(s[a] & s[b]) / len(s[a] | s[b]) >= least)


@pytest.fixture(scope="module")
def copies():
    rng = np.random.default_rng(3)
    texts = []
    for i in range(60):
        words = sentence(rng, 60).split()
        texts.append((f"d{i:03}a", " ".join(words)))
        for j in range(int(rng.integers(0, 3))):
            changed = list(words)
            for p in rng.integers(0, 60, j * 3):
                changed[p] = "x%d" % p
            texts.append((f"d{i:03}{'bcd'[j]}", " ".join(changed)))
    return [*texts, ("n1", None), ("n2", ""), ("n3", "too short"), ("n4", None), ("z", "long " + "q " * 50_000)]


def test_near_copies_against_brute_force(spark, copies):
    df = clashing(spark.createDataFrame(copies, "doc string, body string"), "id", "text", "rep", "a", "keys")
    got = rows(near_copies.near_copy_pairs(df, "doc", "body", 0.6, 3, 20))
    assert got == brute_pairs(copies, 3, 0.6, 20) and len(got) > 20
    assert near_copies.near_copy_pairs(df.limit(0), "doc", "body").count() == 0


def test_near_copy_classes_and_large_groups(spark, copies):
    df = spark.createDataFrame(copies, "doc string, body string")
    got = {r["id"]: r for r in near_copies.near_copy_classes(df, "doc", "body", 0.6, 3, 20).collect()}
    assert set(got) == {i for i, _ in copies}
    pairs = brute_pairs(copies, 3, 0.6, 20)
    assert all(got[a]["class_id"] == got[b]["class_id"] for a, b in pairs)
    assert got["n1"]["class_size"] == 1 and got["n1"]["links"] == 0
    same = spark.createDataFrame([(f"{i:02}", "one two three four five six") for i in range(30)], "doc string, body string")
    assert near_copies.near_copy_pairs(same, "doc", "body", expand_up_to=10).count() == 29
    assert near_copies.near_copy_pairs(same, "doc", "body").count() == 30 * 29 // 2


def test_families_cost_no_square_of_links(spark, monkeypatch):
    rng = np.random.default_rng(8)
    word = lambda: "w%d" % rng.integers(0, 100_000)
    texts = []
    for f in range(3):
        base = [word() for _ in range(60)]
        for j in range(150):
            changed = list(base)
            for p in rng.integers(0, 60, int(rng.integers(0, 6))):
                changed[p] = word()
            texts.append((f"{f}-{j:03}", " ".join(changed)))
    bridge = texts[0][1].split()[:30] + texts[150][1].split()[:12]
    texts += [("9", " ".join(bridge)), ("8", None)]
    pairs = brute_pairs(texts, 3, 0.6, 20)
    group = {i: {i} for i, _ in texts}
    for a, b in pairs:
        if group[a] is not group[b]:
            group[a] |= group[b]
            for x in group[b]:
                group[x] = group[a]
    monkeypatch.setattr(near_copies, "HOT", 40)
    seen = []
    verify = near_copies._verified
    monkeypatch.setattr(near_copies, "_verified", lambda p, *a: seen.append(p.count()) or verify(p, *a))
    df = spark.createDataFrame(texts, "doc string, body string")
    got = {r["id"]: (r["class_id"], r["class_size"]) for r in near_copies.near_copy_classes(df, "doc", "body", 0.6, 3, 20, count_links=False).collect()}
    assert got == {i: (min(g), len(g)) for i, g in group.items()}
    assert sum(seen) < len(pairs) / 2 and len(pairs) > 10_000
    assert rows(near_copies.near_copy_pairs(df, "doc", "body", 0.6, 3, 20)) == pairs
    assert near_copies.near_copy_classes(df.limit(0), "doc", "body", count_links=False).count() == 0
    with pytest.raises(ValueError):
        near_copies.near_copy_pairs(df, "doc", "body", blocks=21)


# problem 2


def test_forms():
    p = lambda x: names.person(x)[1:5]
    assert p("Dr. Isabella M. Levanzizu") == p("LEVANZIZU, Bella M.") == p("Levanzizu Isabella Mary") == ("isabella", "m", "levanzizu", "")
    assert p("KatherineLinüdreso")[0::2] == ("katherine", "linudreso") and p("Ann Lee Jr.")[3] == "jr"
    o = lambda x: names.organisation(x)[1:4]
    assert o("The Fetengelpo Eng. S.A.") == o("Messrs. Fetengelpo Engineering (head office) SA") == ("fetengelpo", "engineering", "sa")
    assert o("Univ. of Vidrudangu Tex. Corp") == o("Vidrudangu University of Textiles Corporation")
    assert names.organisation("D.S.T.") is None and names.forms("Konatigel Reef", None, None) == [] and names.forms(None, ["she", " "], "PERSON") == []


def test_same_entities(spark):
    data = [
        (1, "Isabella Levanzizu", "PERSON", ["she"]), (2, "Bella Levanzizu", None, None), (3, "Levanzizu, I.", "per", []), (4, "Isabela Levanziuz", "Person", None),
        (5, "Charles Levanzizu", "PERSON", None), (6, "Isabella Levanzizu Jr.", "PERSON", None), (7, "Brevuhabar Publishing Inc", "ORG", None), (8, "the Brevuhabar Publ., Inc.", None, None),
        (9, "Brevuhabar Laboratories A.G.", "ORG", None), (10, "Brevuhabar Reef", "CONCEPT", None), (11, None, "PERSON", None), (12, "", None, None), (1, "Isabella Levanzizu", "PERSON", ["she"]),
    ]
    df = clashing(spark.createDataFrame(data, "record_id bigint, name string, entity_type string, mentions array<string>"), "id", "a", "b", "star", "forms")
    got = rows(names.same_entity_pairs(df).distinct())
    assert got == [(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4), (7, 8)]
    assert names.same_entity_pairs(df.limit(0)).count() == 0
    same = df.where("record_id = 5").withColumn("record_id", F.explode(F.sequence(F.lit(1), F.lit(30)))).withColumn("record_id", F.col("record_id").cast("bigint"))
    assert names.same_entity_pairs(same, expand_up_to=10).count() == 29


def test_all_pairs_of_a_large_entity(spark, tmp_path):
    spark.range(1, 302).selectExpr("id AS record_id", "'Isabella Levanzizu' AS name", "'PERSON' AS entity_type").write.parquet(str(tmp_path / "kg_entities.parquet"))
    spark.sql("SELECT 900L AS record_id, 'Bella Levanzizu' AS name, 'person' AS entity_type, array('she') AS mentions").write.parquet(str(tmp_path / "entity_nodes.parquet"))
    got = rows(llm.p2_found(spark, str(tmp_path)))
    assert got == list(itertools.combinations([*range(1, 302), 900], 2))
    with pytest.raises(RuntimeError):
        names.stars(spark.createDataFrame([(1, 2, 2.9), (2, 3, 2.9), (3, 4, 2.9), (4, 5, 2.9)], "a bigint, b bigint, score double"), max_rounds=1)


def test_bands_follow_the_collision_curve():
    b = names.bands_for(0.5, 3, 0.98)
    assert 1 - (1 - 0.5**3) ** b >= 0.98 > 1 - (1 - 0.5**3) ** (b - 1)
    assert names.distance("levanzizu", "levanizzu") == 1 and names.monge_elkan(["ab", "cd"], ["cd", "ab"]) == 1


def test_candidates_hold_all_pairs_the_verifier_accepts(spark):
    rng = np.random.default_rng(3)
    firsts = ["Robert", "Bob", "R.", "Ted", "Edmund", "Theodore", "Jo", "Johannes", "Josephine", "Amir", "Emir", "Bartholomeusz"]
    lasts = ["Kamol", "Kmaol", "Vendori", "Vednori", "Vnedroi", "Vendoir", "Li", "Le", "Ng", "Levanzizu", "Elvanzizu", "Levanizzuu"]
    texts = [f"{f} {x}" for f in firsts for x in lasts] + [f"{x} {b}" for x in ["Konate", "Kontae", "Fetengelpo", "Feetngepol"] for b in ["Publishing Inc", "Publ.", "GmbH"]]
    for _ in range(60):
        w = list("mirandelo"[: rng.integers(4, 10)])
        for _ in range(2):
            w[rng.integers(len(w))] = "abc"[rng.integers(3)]
        texts.append("Robert " + "".join(w).title())
    made = [(i, names.forms(t, None, "org" if t.split()[-1] in ("Inc", "Publ.", "GmbH") else "person")) for i, t in enumerate(texts)]
    found = set(rows(names.candidates(spark.createDataFrame([(i, [names._encode(x) for x in f]) for i, f in made], "id bigint, forms array<string>"))))
    want = {(i, j) for (i, f), (j, g) in itertools.combinations(made, 2) if names.verdict(f, g) > 0}
    at = {t: i for i, t in enumerate(texts)}
    assert {(at["Robert Kamol"], at["Robert Kmaol"]), (at["Bob Vendori"], at["Bob Vnedroi"]), (at["Amir Kamol"], at["Emir Kamol"]), (at["Ted Li"], at["Theodore Li"])} <= want
    assert want <= found and len(found) < len(texts) * (len(texts) - 1) / 4


def test_names_outside_the_lists_are_learned(spark):
    rng = np.random.default_rng(12)
    syllables = "ba be bi do du fa fe ga ge ho hu ka ke li lo ma me ni no pa pe ra re si so ta te va ve zu".split()
    made = lambda n: "".join(rng.choice(syllables, n))
    given = {made(4): made(2) for _ in range(12)}
    lines = {made(4): made(1) + made(1)[0] for _ in range(5)}
    data, truth, n = [], {}, 0

    def slip(w):
        i = int(rng.integers(1, len(w) - 1))
        return w[:i] + w[i + 1] + w[i] + w[i + 2 :] if rng.random() < 0.3 and i + 1 < len(w) else w

    for e in range(150):
        surname, first = made(4), str(rng.choice(list(given)))
        for form in (f"{first} {slip(surname)}", f"{given[first]} {surname}", f"{surname}, {first}", f"{surname} {first}"):
            n += 1
            data.append((n, form.title(), "PERSON", ["she"]))
            truth.setdefault(("p", e), []).append(n)
    for e in range(80):
        core, line = made(4), str(rng.choice(list(lines)))
        for form in (f"{core} {line} Inc", f"{core} {lines[line]}", f"{slip(core)} {line}"):
            n += 1
            data.append((n, form.title(), "ORG", None))
            truth.setdefault(("o", e), []).append(n)
    df = spark.createDataFrame(data, "record_id bigint, name string, entity_type string, mentions array<string>")
    want = {p for g in truth.values() for p in itertools.combinations(sorted(g), 2)}
    got = set(rows(names.same_entity_pairs(df, nicknames={}, business={}, modifiers={})))
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.97 * len(got)


# problem 3


@pytest.mark.parametrize(("size", "overlap"), [(10, 0), (10, 3), (10, 9), (50, 20), (7, 1)])
def test_pieces(spark, size, overlap):
    rng = np.random.default_rng(1)
    texts = ["", "short", "x" * 97, "a b. " * 40, "One two.\n\nThree four five six.\nSeven " * 9, "知识。图谱，" * 30, *(sentence(rng, 80) for _ in range(5)), "y" * 20_000, None]
    df = spark.createDataFrame([(str(i), t, size, overlap) for i, t in enumerate(texts)], "k string, body string, s int, o int")
    got = {}
    for r in splitting.pieces(clashing(df, "id", "text", "size", "overlap"), "k", "body", "s", "o").orderBy("id", "piece_no").collect():
        got.setdefault(int(r["id"]), []).append(r)
    for i, t in enumerate(texts):
        if t is None:
            assert i not in got
            continue
        p = got[i]
        assert [r["piece_no"] for r in p] == list(range(1, len(p) + 1)) and all(len(r["piece"]) <= size and t[r["begin"] : r["end"]] == r["piece"] for r in p)
        assert all(b["begin"] == a["end"] - overlap for a, b in itertools.pairwise(p))
        assert p[0]["piece"] + "".join(r["piece"][overlap:] for r in p[1:]) == t and (len(p) > 1) == (len(t) > size)


def test_pieces_cut_at_boundaries(spark):
    df = spark.createDataFrame([("1", "Alpha beta gamma. Delta epsilon zeta eta.", 25, 0), ("2", "x" * 9, 5, 5), ("3", "x" * 9, None, 0), ("4", "x" * 9, 5, None)], "k string, body string, s int, o int")
    got = [r["piece"] for r in splitting.pieces(df, "k", "body", "s", "o").orderBy("piece_no").collect()]
    assert got[0] == "Alpha beta gamma." and all(not p.strip()[-1:].isalpha() or p.endswith(("zeta", "epsilon", "eta")) for p in got)


# problem 4


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(80, 16))
    x = np.concatenate([c + rng.normal(size=(25, 16)) * 0.35 for c in centres]).astype(np.float32)
    data = [(f"v{i:04}", v.tolist()) for i, v in enumerate(x)]
    data += [("dup1", data[0][1]), ("dup2", data[0][1]), ("null", None), ("empty", []), ("short", [1.0]), ("zero", [0.0] * 16), ("nan", [float("nan")] * 16), ("hole", [None] + [1.0] * 15)]
    df = clashing(spark.createDataFrame(data, "k string, e array<float>"), "id", "v", "a", "b", "rank", "bucket")
    good = [(i, np.array(v, np.float64)) for i, v in data if v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    m = np.stack([v / np.sqrt((v * v).sum()) for _, v in good])
    s = np.round(m @ m.T, 6)
    true = {(good[i][0], good[j][0]) for i in range(len(good)) for j in sorted((j for j in range(len(good)) if j != i and s[i, j] >= 0.7), key=lambda j: (-s[i, j], good[j][0]))[:5]}
    for how in ({}, {"coarse_rows": 1000, "fine_rows": 300}, {"coarse_rows": 1000, "hot_rows": 400}):
        got = {(r["id"], r["neighbour"]) for r in neighbours.nearest(df, "k", "e", 16, 5, 0.7, **how).collect()}
        assert len(got & true) >= 0.9 * len(true) and not {i for p in got for i in p} & {"null", "empty", "short", "zero", "nan", "hole"}
    assert neighbours.nearest(df, "k", "e", 16, 3).groupBy("id").count().where("count <> 3").count() == 0
    assert neighbours.nearest(df.limit(0), "k", "e", 16, 3).count() == 0


def test_crowded_buckets_are_split_by_tables_of_their_own(spark):
    rng = np.random.default_rng(7)
    far = rng.normal(size=(400, 24))
    crowd = rng.normal(size=24) * 3 + rng.normal(size=(80, 24)).repeat(20, 0) * 0.05 + rng.normal(size=(1600, 24)) * 0.004
    x = np.concatenate([far, crowd]).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:04}", v.tolist()) for i, v in enumerate(x)], "k string, e array<float>")
    m = x.astype(np.float64)
    m /= np.sqrt((m * m).sum(1, keepdims=True))
    s = np.round(m @ m.T, 6)
    np.fill_diagonal(s, -2)
    true = {(f"v{i:04}", f"v{j:04}") for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -s[i]))[:5] if s[i, j] >= 0.7}
    for levels in (3, 0):  # without levels all crowded buckets are cut into tiles, which is exact within them
        got = {(r["id"], r["neighbour"]) for r in neighbours.nearest(df, "k", "e", 24, 5, 0.7, coarse_rows=300, hot_rows=300, levels=levels).collect()}
        assert len(got & true) >= 0.9 * len(true)


def test_many_equal_vectors(spark):
    df = spark.createDataFrame([(f"{i:03}", [1.0, 2.0]) for i in range(40)], "k string, e array<float>")
    got = neighbours.nearest(df, "k", "e", 2, 3).collect()
    assert len(got) == 120 and {r["neighbour"] for r in got} == {"000", "001", "002", "003"} and all(r["similarity"] == 1 for r in got)


# problem 5

BODY = "The quarterly report describes several important findings about regional harvest conditions. Every committee member reviewed the document carefully before signing. "


def scan():
    return "\n".join([
        "Annual harvest survey", "The quarterly rep0rt describes several import-", "ant findings about regional harvest conditi¬", "ons. Every committee mernber reviewed the", "p. 11", "Annual harvest survey",
        "document carefully before signing. The quarterly report", "describes several important findings.", "", "Every committee member reviewed the well-", "known document carefully.", "p. 12",
    ])


def test_scans(spark):
    docs = [(f"c{i}", BODY * 2 + "It is well known.") for i in range(12)] + [("s", scan()), ("t", "Total\n454\n\nTotal\n21.9\nplain text"), ("n", None), ("b", ""), ("l", "word " * 40_000)]
    df = clashing(spark.createDataFrame(docs, "k string, body string"), "id", "text", "n", "key")
    got = rows(scans.scan_lines(df, "k", "body"))
    assert got == [("s", n, k) for n, k in [(1, "header"), (2, "broken_word"), (2, "misread"), (3, "broken_word"), (4, "misread"), (5, "page_number"), (6, "header"), (12, "page_number")]]
    fixed = {r["id"]: r for r in scans.repair(df, "k", "body").collect()}
    assert fixed["s"]["text"] == (BODY + "The quarterly report describes several important findings.\n\nEvery committee member reviewed the well-known document carefully.")
    assert fixed["n"]["text"] is None and not fixed["t"]["repaired"] and fixed["l"]["text"] == docs[-1][1]
    assert scans.scan_lines(df.limit(0), "k", "body").count() == 0


def test_counts_and_ends_of_many_texts(monkeypatch):
    rng = np.random.default_rng(4)
    texts = ["".join(rng.choice(list("ab1é日𝒜 .?!\"'”),;-—\n\t"), rng.integers(0, 60))) for _ in range(400)] + ["", "a", "a. \"b\".c -d - e…”"]
    words = Words(texts)
    keys, many = kp._held(words.doc, words.h)
    held = {}
    for d, h in zip(words.doc.tolist(), words.h.tolist(), strict=True):
        held.setdefault(h, set()).add(d)
    assert dict(zip(keys.tolist(), many.tolist(), strict=True)) == {h: len(d) for h, d in held.items()} and sum(many) < len(words.h)
    assert len(kp._held(words.doc[:0], words.h[:0])[1]) == 0
    ended, broken = kp._ends(words)
    whole = "\n".join(texts)
    gaps = [(whole[a:b], whole[a : b + 1]) for a, b in zip(words.end[:-1], words.start[1:], strict=True)]
    assert broken.tolist() == [bool(kp.BREAK.search(x)) for x, _ in gaps]
    assert all(e or not kp.STOP.search(x) for e, (x, _) in zip(ended.tolist(), gaps, strict=True)) and 0 < ended.sum() < len(ended)
    told = np.sort(kp.pairs(words.h)[:5])
    counts = kp.Counts(9, 9, 1.0, told[:0], np.zeros(0, np.int64), told, np.arange(1, 6))
    asked = rng.integers(0, 1 << 63, 100_000).astype(np.uint64)
    looked, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda a, v, *rest, **kw: looked.append(np.size(v)) or search(a, v, *rest, **kw))
    got = counts.support(np.concatenate((asked, told)))
    assert got[-5:].tolist() == [1, 2, 3, 4, 5] and not got[:-5].any() and sum(looked) < 100


def test_scans_ask_for_many_words_at_once(monkeypatch):
    made, words = [], Words
    monkeypatch.setattr(scans, "Words", lambda texts: made.append(1) or words(texts))
    told = ["harbour", "flower", "silver", "window", "modem"]
    vocab = scans.Vocabulary(words([" ".join(told)]).h)
    forms = {"harb0ur": [4], "f1ow3r": [1], "f1owcr": [1, 4], "sllver": [], "s1lvcr": [1, 4], "win8ow": [3], "qx7zzz@": [6], "cdlmodem": [], "modcm": [3], "2021a": []} | {f"w{i}x{i}": [] for i in range(3000)}
    got = scans.misread(set(forms), vocab.knows)
    assert len(made) <= 10
    assert got == {w for w in forms if scans.places(w, vocab.knows) and (not w.isalpha() or any(vocab.knows([v])[v] for v, _ in scans.variants(w)))}
    assert {w: scans.places(w, vocab.knows) for w in list(forms)[:10]} == dict(list(forms.items())[:10])


def test_scans_know_rare_words(spark):
    docs = [(f"c{i}", BODY * 2 + "It is well known." + " Meet Kenkal and Varutol." * (i < 8) + " Dagu and Datu." * (i < 3)) for i in range(4600)]
    page = "\n".join([scan(), "Here kcnkal came, and varu-", "tol said that fagu met datu."])
    got = rows(scans.scan_lines(spark.createDataFrame([*docs, ("s", page)], "k string, body string"), "k", "body"))
    assert got == sorted(rows(scans.scan_lines(spark.createDataFrame([*docs[:12], ("s", scan())], "k string, body string"), "k", "body")) + [("s", 13, "broken_word"), ("s", 13, "misread")])
    fixed = {r["id"]: r["text"] for r in scans.repair(spark.createDataFrame([*docs, ("s", page), (None, None)], "k string, body string"), "k", "body").collect()}
    assert fixed["s"].endswith("Here kenkal came, and varutol said that fagu met datu.") and len(fixed) == 4602 and fixed["c0"] == docs[0][1]


def test_page_numbers():
    assert scans.page_number(" - l2 - ") == [12] and scans.page_number("xiv") == [14] and scans.page_number("Page 50 of 52") == [50] and scans.page_number("21.9") == [] and scans.page_number("word") == []


def test_alike_lines_are_found_by_their_pieces():
    rng = np.random.default_rng(6)
    lines = []
    for _ in range(150):
        base = "".join(rng.choice(list("abc de"), int(rng.integers(3, 40))))
        for _ in range(3):
            x = list(base)
            for _ in range(int(rng.integers(0, 5))):
                at = int(rng.integers(0, len(x)))
                x[at : at + int(rng.integers(0, 2))] = list(rng.choice(list("xyz"), int(rng.integers(0, 2))))
            lines.append("".join(x) or "q")
    rng.shuffle(lines)
    slow: list[list[int]] = []
    for i, f in enumerate(lines):
        g = next((g for g in slow if scans._alike(f, lines[g[0]])), None)
        slow.append([i]) if g is None else g.append(i)
    assert scans.alike_groups(list(range(len(lines))), [str(x) for x in lines]) == slow and 100 < len(slow) < 400


def test_page_numbers_chain_past_columns_of_numbers():
    body = ["The committee reviewed the quarterly report and its findings in detail,"] * 3
    column = [str(900 + 7 * i) for i in range(40)]
    lines = [*body, "17", *body, *column, *body, "18", *body]
    kinds = scans.Page("\n".join(lines), lambda ws: {w.lower(): True for w in ws}).kinds
    assert [i for i, k in enumerate(kinds) if "page_number" in k] == [3, len(lines) - 4]


# problem 6


def test_leaks_against_brute_force(spark):
    rng = np.random.default_rng(5)
    items = [(i, sentence(rng, n)) for i, n in enumerate([5, 8, 11, 12, 20, 40])] + [(90, None), (91, ""), (92, "— !")]
    docs = [(i, sentence(rng, 60)) for i in range(40)]
    for d, (_, t) in zip(range(0, 30, 5), items, strict=False):
        w = docs[d][1].split()
        docs[d] = (d, " ".join([*w[:20], t.upper().replace(" ", ",  "), *w[20:]]))
    docs += [(50, " ".join(items[5][1].split()[3:15])), (51, " ".join(items[5][1].split()[3:14])), (60, None), (61, ""), (62, items[4][1] + " x" * 60_000), (0, docs[0][1])]
    said = [(d, W(t)) for d, t in docs]
    want = {(d, i) for i, x in items if W(x) for k in [min(12, len(W(x)))] for g in [runs(W(x), k)] for d, t in said if g & runs(t, k)}
    df = clashing(spark.createDataFrame(docs, "d bigint, body string"), "doc_id", "text", "item_id")
    it = clashing(spark.createDataFrame(items, "i bigint, body string"), "item_id", "text")
    where = {"doc_id": "d", "text": "body", "item_id": "i", "item_text": "body"}
    assert set(rows(leaks.leaks(df, it, **where))) == want and len(want) > 6
    assert set(rows(leaks.leaks(df, it, **where, block_grams=20))) == want
    clean = {r["doc_id"]: r for r in leaks.without_leaks(df.where("d < 90"), it, **where).collect()}
    assert 50 not in clean and 51 in clean and clean[60]["text"] is None and clean[62]["removed_chars"] == len(items[4][1])
    assert leaks.leaks(df.limit(0), it, **where).count() == leaks.leaks(df, it.limit(0), **where).count() == 0


# problem 7


def test_shares():
    assert mixing.share_out(100, [1, 1, 2], [10, 100, 100]) == pytest.approx([10, 30, 60])
    assert mixing.share_out(1000, [1, 1], [10, 20]) == [10, 20] and mixing.share_out(5, [0, 0], [1, 1]) == [0, 0]


def test_mix(spark):
    docs = [(i, f"some words number {i} " * (1 + i % 7), "Web_Crawl " if i % 3 else "small", ["en", "DE", None][i % 3]) for i in range(300)] + [(900, None, "small", "en"), (901, "", "small", "en"), (902, "x", None, "en")]
    df = clashing(spark.createDataFrame(docs, "d bigint, body string, src string, lg string"), "id", "tokens", "h", "cell")
    t = spark.createDataFrame([("m", "web-crawl", 1.0, 1), ("m", "small", 3.0, 4), ("m", "absent", 1.0, 9), ("m", "void", None, None)], "mix_name string, source string, target_weight double, max_repeats int")
    how = {"id_col": "d", "text_col": "body", "source_col": "src", "lang_col": "lg"}
    selected, budgets = mixing.mix_records(df, t, **how)
    got = {(r["id"]): r for r in selected.collect()}
    assert len(got) == selected.count() and all(r["uses"] <= (4 if r["source"] == "small" else 1) for r in got.values()) and not {900, 901, 902} & set(got)
    shares = {r["source"]: r for r in mixing.mix_shares(selected, budgets).collect()}
    assert shares["absent"]["tokens"] == 0 and shares["small"]["actual_share"] == pytest.approx(0.75, abs=0.02)
    used = {(r["source"], r["lang"]): 0 for r in budgets.collect()}
    for r in got.values():
        used[r["source"], r["lang"]] += r["tokens"] * r["uses"]
    assert all(0 <= r["budget"] - used[r["source"], r["lang"]] + 1e-6 for r in budgets.collect())
    few, _ = mixing.mix_records(df, t, **how, cells=2)
    assert {r["id"] for r in few.collect()} <= set(range(300))
    assert mixing.mix_records(df.limit(0), t, **how)[0].count() == 0


def test_mix_domains_share_shortages_first(spark):
    docs = [(i, "word " * 10, s, "en") for i, s in enumerate(["a1"] * 2 + ["a2"] * 40 + ["b1"] * 40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, lang string")
    t = spark.createDataFrame([("m", s, 1.0, 1) for s in ("a1", "a2", "b1")], "mix_name string, source string, target_weight double, max_repeats int")
    total = 60 * 11.0
    for domains, b1 in (([("A1", "a"), ("a2", "a"), ("b1", None), (None, "x")], 1 / 3), ([], 29 / 60)):
        given = spark.createDataFrame(domains, "source string, domain string")
        _, budgets = mixing.mix_records(df, t, domains=given, budget=total)
        got = {r["source"]: (r["budget"], r["tokens"]) for r in budgets.collect()}
        assert got["a1"][0] == got["a1"][1] and got["b1"][0] / total == pytest.approx((total * b1 if domains else (total - got["a1"][0]) / 2) / total)
        assert sum(b for b, _ in got.values()) == pytest.approx(total)


# problem 8


def test_first_look_skips_only_what_parts_reject():
    rng = np.random.default_rng(4)
    nouns = ["kiln", "ferry", "mill", "deck", "harbour", "garden", "museum", "cellar", "42", "buy"]
    texts = ["", "  ", "one", "kiln sale in. " * 3]
    for i in range(400):
        parts = []
        for _ in range(int(rng.integers(1, 30))):
            parts.append(" ".join(rng.choice(nouns, int(rng.integers(1, 26)))))
        texts.append("".join(p + str(rng.choice([". ", ", ", "\n", " - ", ".", ') ', '." ', "; ", " ", "。"])) for p in parts))
    half = [t for i, t in enumerate(texts) if i % 2]
    word_keys, pair_keys = np.unique(kp.masked(Words([" ".join(nouns)]))), np.unique(kp.pairs(kp.masked(Words(half))))[::3]
    counts = kp.Counts(len(half), 4000, 4.0, word_keys, np.full(len(word_keys), 50), pair_keys, np.full(len(pair_keys), 9))
    looked = kp.suspects(texts, counts)
    found = [sum(f.values()) > 0.5 * n > 0 for n, f in (kp.parts(t, counts) for t in texts)]
    assert sum(found) > 30 and not looked.all() and all(x for x, f in zip(looked, found, strict=True) if f)



def test_keyword_pages(spark):
    rng = np.random.default_rng(2)
    verbs, nouns = "opened measured repaired painted moved sold".split(), "harbour garden museum kiln ferry bridge cellar mill".split()
    say = lambda: f"The {rng.choice(nouns)} was {rng.choice(verbs)} because the old {rng.choice(nouns)} of the town needed it."
    docs = [(i, " ".join(say() for _ in range(10))) for i in range(80)]
    spam = {
        100: " ".join(rng.choice(["cheap", "harbour", "garden", "sale", "kiln"], 120)), 101: "\n".join(f"cheap kiln in Town{i}" for i in range(40)), 102: "\n".join(f"http://a{i}.example/x" for i in range(30)),
        103: " ".join(f"#{n}" for n in rng.choice(nouns, 60)), 104: ", ".join(rng.choice(nouns, 60)), 105: "\n".join(f"- [kiln sale](https://b{i}.test/p)" for i in range(20)),
    }
    honest = {200: "[1] Source www.a.example/x\n" + docs[0][1], 201: " ".join([docs[1][1].replace(".", "").lower()] * 1), 202: "a,b,c\n" + "\n".join(f"Xq{i},{i},Zr{i * 7}" for i in range(40)), 203: None, 204: "", 205: docs[2][1] * 200}
    df = clashing(spark.createDataFrame([*docs, *spam.items(), *honest.items(), (300, spam[100])], "d bigint, body string"), "doc_id", "text", "n", "kind")
    assert {r["doc_id"] for r in kp.keyword_pages(df, "d", "body").collect()} == {*spam, 300}
    assert kp.keyword_pages(df.limit(0), "d", "body").count() == 0
