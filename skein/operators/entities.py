"""Entity resolution on vertex tables (record_id, name, entity_type, mentions where they count): similar names of the same type, clusters, canonical names, coreference."""

from __future__ import annotations

from collections import deque
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from skein.functions.text import normal_name
from skein.plans.tables import written

from .components import connected_components
from .likeness import likely_pairs
from .skew import in_tiles

# Words resolved to an entity mentioned before, and marks of people's names.
PRONOUNS = {"he", "she", "it", "they", "him", "her", "them", "his", "their", "its"}
TITLED = ("mr", "mrs", "dr", "prof")


def plain_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.8 to 1 by the ratio of lengths where one contains the other, else 0."""
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), F.round(0.8 + 0.2 * ratio, 6)).otherwise(0.0)


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """As the plain similarity, but the SequenceMatcher ratio where neither contains the other."""

    def one(x: str, y: str) -> float:
        if x == y:
            return 1.0
        if x in y or y in x:
            return round(0.8 + 0.2 * min(len(x), len(y)) / max(len(x), len(y)), 6)
        return round(SequenceMatcher(None, x, y).ratio(), 6)

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def names(df: DataFrame) -> DataFrame:
    """(entity_type, name, record_id): the distinct normal names of each type, folded, with the smallest record that has each."""
    kind = F.lower(F.trim(F.coalesce("entity_type", F.lit("unknown"))))
    return df.select(kind.alias("entity_type"), normal_name(F.col("name")).alias("name"), "record_id").where("name <> ''").groupBy("entity_type", "name").agg(F.min("record_id").alias("record_id"))


def spellings(df: DataFrame) -> DataFrame:
    """(entity_type, name, spelling): the normal names of each type with the normal forms of themselves and of the mentions of their records.
    Blank mentions are none; records without a name are left out, as in ``names``."""
    kind = F.lower(F.trim(F.coalesce("entity_type", F.lit("unknown"))))
    said = F.explode(F.concat(F.array("name"), F.coalesce("mentions", F.array().cast("array<string>"))))
    one = df.select(kind.alias("entity_type"), normal_name(F.col("name")).alias("normal"), said.alias("said"))
    return one.select("entity_type", F.col("normal").alias("name"), normal_name(F.col("said")).alias("spelling")).where("name <> '' and spelling <> ''").distinct()


def similar_names(df: DataFrame, threshold: float = 0.85, exact_ratio: bool = False) -> DataFrame:
    """(entity_type, name_a, name_b, similarity): pairs of different normal names of the same type alike by ``threshold`` or more, name_a < name_b.

    A name that is contained in another shares all its grams with it, so it is looked up under its rarest gram of three characters, or as many as it has.
    Names alike by their matching ratio are found by :mod:`.likeness`.
    """
    return _similar(names(df), threshold, exact_ratio)


def similar_records(df: DataFrame, threshold: float = 0.85, exact_ratio: bool = True) -> DataFrame:
    """(entity_type, name_a, name_b, similarity): as ``similar_names``, but the similarity is the greatest of any spelling, name or mention, of the one
    and any of the other; a mention that two names share makes it 1. The rows grow with the square of the names that share one."""
    s = written(spellings(df))
    alike = written(_similar(s.select("entity_type", F.col("spelling").alias("name")).distinct(), threshold, exact_ratio))  # each way round, compared once
    x, y = F.col("name_a").alias("x"), F.col("name_b").alias("y")
    same = s.select("entity_type", F.col("spelling").alias("x"), F.col("spelling").alias("y"), F.lit(1.0).alias("similarity")).distinct()
    links = alike.select("entity_type", x, y, "similarity").unionByName(alike.select("entity_type", F.col("name_b").alias("x"), F.col("name_a").alias("y"), "similarity")).unionByName(same)
    a = s.select("entity_type", F.col("spelling").alias("x"), F.col("name").alias("name_a"))
    b = s.select("entity_type", F.col("spelling").alias("y"), F.col("name").alias("name_b"))
    both = links.join(a, ["entity_type", "x"]).join(b, ["entity_type", "y"]).where("name_a < name_b")
    return both.groupBy("entity_type", "name_a", "name_b").agg(F.max("similarity").alias("similarity")).where(F.col("similarity") >= threshold)


def _similar(n: DataFrame, threshold: float, exact_ratio: bool) -> DataFrame:
    """The similar pairs of distinct normal names (entity_type, name)."""
    n, t = written(n.select("entity_type", "name")), threshold - 1e-6
    pairs = _contained(n, t)
    if exact_ratio:  # what does not match is at least the edits between the names
        x, y = F.col("name_a"), F.col("name_b")
        pairs = pairs.unionByName(likely_pairs(n, t).where(F.levenshtein(x, y) <= (1 - t) * (F.length(x) + F.length(y))))
    score = similarity("name_a", "name_b") if exact_ratio else plain_similarity(F.col("name_a"), F.col("name_b"))
    return pairs.withColumn("similarity", score).where(F.col("similarity") >= threshold)


def _contained(n: DataFrame, t: float) -> DataFrame:
    """(entity_type, name_a, name_b): the pairs of which one contains the other and that may be alike by ``t``, each once."""
    length, wide = F.length("name"), 0.2 / (t - 0.8) if t > 0.8 else None
    gram = lambda q: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - (q - 1)), lambda i: F.substring(F.col("name"), i, q)))
    # grams of one or two characters only serve names as short
    fits = lambda k: (length >= k) if k == 3 or wide is None else (length >= k) & (length <= k * max(1, wide))
    filed = written(n.select("entity_type", "name", F.explode(F.flatten(F.array(*(F.when(fits(k), gram(F.lit(k))).otherwise(F.array().cast("array<string>")) for k in (1, 2, 3))))).alias("gram")))
    held = filed.groupBy("entity_type", "gram").agg(F.count("*").alias("n"))
    own = filed.where(F.length("gram") == F.least(length, F.lit(3))).join(held, ["entity_type", "gram"])
    # the count and the place of the rarest as one number, which is aggregated by hashing
    rare = own.groupBy("entity_type", "name").agg(F.min(F.shiftleft(F.col("n"), 24).bitwiseOR(F.instr("name", F.col("gram")))).alias("rarest"))
    gram_of = F.substring("name", F.col("rarest").bitwiseAND((1 << 24) - 1).cast("int"), F.least(length, F.lit(3)))
    a = rare.select("entity_type", gram_of.alias("gram"), F.col("name").alias("x"))
    b = filed.select("entity_type", "gram", F.col("name").alias("y"))
    m, n_ = F.length("x"), F.length("y")
    near = (m < n_) & F.contains("y", "x")
    if wide is not None:
        near &= n_ <= m * max(1, wide)
    return in_tiles(b, a, ["entity_type", "gram"], "y").where(near).select("entity_type", F.least("x", "y").alias("name_a"), F.greatest("x", "y").alias("name_b"))


def clusters(df: DataFrame, threshold: float = 0.85, exact_ratio: bool = False, mentions: bool = False) -> DataFrame:
    """(entity_type, name, canonical, members): every normal name with the canonical one of its cluster, the longest (ties: the smallest), and the cluster's size.

    With ``mentions`` names are linked as in ``similar_records``: each to its spellings, and those among themselves, so that the links
    don't grow with the square of the names that share a mention.
    """
    key = lambda t, n: F.concat(t, F.lit("\x1f"), n)
    said = (lambda t, n: key(t, F.concat(F.lit("\x1f"), n))) if mentions else key
    s = written(spellings(df)) if mentions else None
    alike = _similar(s.select("entity_type", F.col("spelling").alias("name")).distinct(), threshold, exact_ratio) if mentions else similar_names(df, threshold, exact_ratio)
    links = alike.select(said(F.col("entity_type"), F.col("name_a")).alias("src"), said(F.col("entity_type"), F.col("name_b")).alias("dst"))
    if mentions:
        links = links.unionByName(s.select(key(F.col("entity_type"), F.col("name")).alias("src"), said(F.col("entity_type"), F.col("spelling")).alias("dst")))
    joined = connected_components(links)
    known = s.where("spelling = name").select("entity_type", "name") if mentions else names(df)  # every name is a spelling of itself
    n = known.withColumn("node", key(F.col("entity_type"), F.col("name"))).join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = n.groupBy("component").agg(F.min(F.struct((-F.length("name")).alias("l"), "name")).alias("c"), F.count("*").alias("members"))
    return n.join(best, "component").select("entity_type", "name", F.col("c.name").alias("canonical"), "members")


def report(df: DataFrame, threshold: float = 0.85, exact_ratio: bool = False, mentions: bool = False) -> DataFrame:
    """(names, canonical_names, merged_groups): before and after merging."""
    c = clusters(df, threshold, exact_ratio, mentions)
    return c.agg(F.count("*").alias("names"), F.countDistinct("entity_type", "canonical").alias("canonical_names"), F.countDistinct(F.when(F.col("members") > 1, F.struct("entity_type", "canonical"))).alias("merged_groups"))


def merge_groups(df: DataFrame, threshold: float = 0.85, exact_ratio: bool = False, mentions: bool = False) -> DataFrame:
    """(entity_type, canonical, names): the names of each cluster of several, in order, joined with "; "."""
    c = clusters(df, threshold, exact_ratio, mentions).where("members > 1")
    return c.groupBy("entity_type", "canonical").agg(F.array_join(F.array_sort(F.collect_set("name")), "; ").alias("names"))


def renamed_edges(edges: DataFrame, cluster: DataFrame) -> DataFrame:
    """Edges with both ends by their canonical names; ends that no cluster knows keep their normal name."""
    c = cluster.groupBy("name").agg(F.min("canonical").alias("canonical"))
    one = edges.withColumn("_n", normal_name(F.col("source"))).join(c.withColumnRenamed("name", "_n"), "_n", "left").withColumn("source", F.coalesce("canonical", "_n")).drop("_n", "canonical")
    return one.withColumn("_n", normal_name(F.col("target"))).join(c.withColumnRenamed("name", "_n"), "_n", "left").withColumn("target", F.coalesce("canonical", "_n")).drop("_n", "canonical")


#: Which of the entities mentioned before a pronoun may mean before others: those with a title, or those that are no person.
PREFERENCE = dict.fromkeys(("he", "him", "his"), "titled") | dict.fromkeys(("it", "its"), "thing")


def _held(e: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(F.lower(e), F.lit(m))
    return out


def meant(word: Column, recent: Column) -> Column:
    """The entity a pronoun means, of those mentioned before, the latest first: the first it prefers, or the first of all."""
    first = lambda keep: F.try_element_at(F.filter(recent, keep), F.lit(1))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in PREFERENCE.items() for x in kv]), word)
    wanted = F.when(kind == "titled", first(lambda e: _held(e, TITLED))).when(kind == "thing", first(lambda e: ~_held(e, ("mr", "mrs", "person"))))
    return F.coalesce(wanted, F.try_element_at(recent, F.lit(1)))


def coreference(texts: DataFrame, entity_lists: DataFrame, memory: int = 5) -> DataFrame:
    """(id, content): texts in which each pronoun is followed by the entity it means in brackets. ``entity_lists`` is (id, entities array).

    The last ``memory`` entities mentioned count. A word mentions the first entity that contains it or is contained in it, but isn't it. Before anything is
    mentioned a pronoun is a word like others. Null texts stay null; of white space one blank remains. A text id given twice counts once.

    Words are rows: what each mentions is looked up in the list that rides along, the entities last mentioned up to each mention are built from the
    mentions of a text alone, and a window hands them to the pronouns that follow.
    """
    source = texts.select("id", "content").dropDuplicates(["id"])
    lists = entity_lists.select("id", "entities").dropDuplicates(["id"])
    edge = r"[.,;:!?()\[\]{}\"']+"
    spoken = F.filter(F.split("content", r"(?U)\s+"), lambda w: w != "")
    words = source.where("content is not null").join(lists, "id", "left").select("id", "entities", F.posexplode(spoken).alias("pos", "word"))
    bare = F.regexp_replace(F.lower("word"), f"^{edge}|{edge}$", "")
    named = F.filter("entities", lambda e: (F.col("bare") != "") & (F.contains(F.lower(e), F.col("bare")) | F.contains(F.col("bare"), F.lower(e))))
    words = words.withColumn("bare", bare).withColumn("entity", F.try_element_at(named, F.lit(1))).drop("entities")
    words = words.withColumn("new", F.coalesce(F.lower("entity") != F.col("bare"), F.lit(False))).withColumn("pronoun", F.col("bare").isin(*sorted(PRONOUNS)))
    words = written(words.withColumn("first", F.min(F.when(F.col("new"), F.col("pos"))).over(Window.partitionBy("id"))))
    said = words.where(F.col("new") & (~F.col("pronoun") | (F.col("pos") == F.col("first")))).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "entity"))).alias("said"))
    kind = "array<struct<pos: int, recent: array<string>>>"
    after = F.aggregate(
        "said",
        F.array().cast(kind),
        lambda seen, m: F.concat(seen, F.array(F.struct(m["pos"].alias("pos"), F.slice(F.concat(F.array(m["entity"]), F.array_remove(F.coalesce(F.try_element_at(seen, F.lit(-1))["recent"], F.array().cast("array<string>")), m["entity"])), 1, memory).alias("recent"))).cast(kind)),
    )
    states = said.select("id", F.explode(after).alias("s")).select("id", "s.pos", "s.recent")
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    told = words.join(states, ["id", "pos"], "left").withColumn("recent", F.last("recent", ignorenulls=True).over(before))
    shown = F.when(F.col("pronoun") & F.col("recent").isNotNull(), F.concat("word", F.lit(" ["), meant(F.col("bare"), F.col("recent")), F.lit("]"))).otherwise(F.col("word"))
    whole = told.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", shown.alias("shown")))), lambda x: x["shown"]), " ").alias("told"))
    return source.join(whole, "id", "left").select("id", F.when(F.col("content").isNotNull(), F.coalesce("told", F.lit(""))).alias("content"))


def resolved_triples(edges: DataFrame, known: DataFrame, memory: int = 5) -> DataFrame:
    """(doc_id, edge_id, source, relation, target): the relationships of each document, in the order of edge_id, whose ends are both names of
    ``known`` (name), as they are spelled there, pronouns replaced by the entity they mean.

    The last ``memory`` ends of the relationships kept count, a target after its source. Null ends are unknown; edges without document are
    one graph. A document's edges are resolved in one place.
    """

    likes = {"titled": lambda e: any(t in e.lower() for t in TITLED), "thing": lambda e: not any(t in e.lower() for t in ("mr", "mrs", "person"))}

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        ends: deque[str] = deque(maxlen=memory)  # of the relationships kept, the latest first
        kept = []
        for r in pdf.sort_values(["edge_id", "source", "relation", "target"]).itertuples(index=False):
            stand = {}
            for side in ("source", "target"):
                said = getattr(r, side)
                if said.lower() in PRONOUNS and ends:
                    stand[side] = next(filter(likes.get(PREFERENCE.get(said.lower()), lambda _: True), ends), ends[0])
                elif getattr(r, f"{side}_known"):
                    stand[side] = said
            if len(stand) == 2:
                kept.append((r.doc_id, r.edge_id, stand["source"], r.relation, stand["target"]))
                ends.extendleft((stand["source"], stand["target"]))
        return pd.DataFrame(kept, columns=["doc_id", "edge_id", "source", "relation", "target"])

    n = known.select("name").where("name is not null").distinct()
    e = edges.select("doc_id", "edge_id", "source", "relation", "target").where("source is not null and target is not null")
    for end in ("source", "target"):
        e = e.join(n.select(F.col("name").alias(end), F.lit(True).alias(f"{end}_known")), end, "left").withColumn(f"{end}_known", F.coalesce(f"{end}_known", F.lit(False)))
    types = dict(edges.dtypes)
    return e.groupBy("doc_id").applyInPandas(resolve, f"doc_id {types['doc_id']}, edge_id {types['edge_id']}, source string, relation string, target string")
