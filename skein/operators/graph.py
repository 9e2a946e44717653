"""Knowledge graphs as tables: vertices (name, entity_type, description) and edges (source, relation, target, context).

Edges with a null or blank end are ignored throughout. Expansion and paths are unrolled joins on nodes, one a hop; frontiers are
distinct, so a hub is joined once for each seed that reaches it and not once for each way there, and its edges are spread over tiles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import named_phrases
from skein.plans.tables import written

from .skew import hot_keys, in_tiles

# Node colours by type in exports.
MERMAID = {"Person": "#e1f5fe", "Organisation": "#fff3e0", "Organization": "#fff3e0", "Concept": "#f3e5f5", "Technology": "#e8f5e9", "Location": "#ffebee", "Event": "#fffde7", "Metric": "#fce4ec"}
DOT = {"Person": "lightblue1", "Organisation": "lightgoldenrod1", "Organization": "lightgoldenrod1", "Concept": "plum1", "Technology": "palegreen1", "Location": "lightpink1", "Event": "lightyellow1", "Metric": "lightcoral"}


def clean(edges: DataFrame) -> DataFrame:
    return edges.where((F.trim("source") != "") & (F.trim("target") != ""))


def parse_markdown(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities (id, line_no, name, entity_type, description) and relationships (id, line_no, source, relation, target, context) of
    texts (id, content) in markdown: sections "Entities" and "Relationships", as headings or in bold, any number of times; lines
    "- **name** (type): description", bold or not, and "- source → relation → target (context)", with context or without."""
    line = F.posexplode(F.transform(F.split("content", "\n"), F.trim))
    lines = df.where("content is not null").select("id", line.alias("line_no", "line"))
    section = F.when(F.regexp_like("line", F.lit(r"^(\*\*Entities\*\*|## Entities)")), "e").when(F.regexp_like("line", F.lit(r"^(\*\*Relationships\*\*|## Relationships)")), "r")
    within = Window.partitionBy("id").orderBy("line_no")
    marked = lines.withColumn("section", F.last(section, ignorenulls=True).over(within)).withColumn("line_no", F.col("line_no") + 1).where(F.startswith("line", F.lit("- ")))
    entity = r"^- (?:\*\*(.+?)\*\*|([^(*]+?)) \(([^)]*)\): ?(.*)$"
    relation = r"^- (.+?) → (.+?) → (.+?)(?: \(([^)]*)\))?$"
    e = marked.where((F.col("section") == "e") & F.regexp_like("line", F.lit(entity))).select(
        "id", "line_no", F.coalesce(F.nullif(F.regexp_extract("line", entity, 1), F.lit("")), F.regexp_extract("line", entity, 2)).alias("name"), F.regexp_extract("line", entity, 3).alias("entity_type"), F.regexp_extract("line", entity, 4).alias("description")
    )
    r = marked.where((F.col("section") == "r") & F.regexp_like("line", F.lit(relation))).select("id", "line_no", *(F.trim(F.regexp_extract("line", relation, i)).alias(n) for i, n in enumerate(("source", "relation", "target", "context"), 1)))
    return e, r


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, relation, neighbour, context): every edge in its direction and against it, as inverse_<relation>; once each."""
    e = clean(edges)
    back = e.select(F.col("target").alias("node"), F.concat(F.lit("inverse_"), F.coalesce("relation", F.lit(""))).alias("relation"), F.col("source").alias("neighbour"), "context")
    return e.select(F.col("source").alias("node"), "relation", F.col("target").alias("neighbour"), "context").unionByName(back).distinct()


def expand(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(seed, node, depth): the nodes within ``hops`` of each seed (seed), either way along edges, with the hop of their first visit; the seeds themselves excluded."""
    e = clean(edges).select("source", "target")
    beside = written(e.select(F.col("source").alias("node"), F.col("target").alias("next")).unionByName(e.select(F.col("target").alias("node"), F.col("source").alias("next"))).where("node <> next").distinct())
    hubs = hot_keys(beside, "node")
    front = seeds.where("seed is not null").select("seed", F.col("seed").alias("node")).distinct()
    seen = front.withColumn("depth", F.lit(0))
    for depth in range(1, hops + 1):
        front = written(in_tiles(beside, front, ["node"], "next", hubs).select("seed", F.col("next").alias("node")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti"))
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    return seen.where("depth > 0")


def described(reached: DataFrame, vertices: DataFrame) -> DataFrame:
    """Adds entity_type and description of each node; a node that is no vertex is of type "Unknown", without description. Of a name given twice the first by type and description counts."""
    v = vertices.where("name is not null").groupBy("name").agg(F.min(F.struct(F.coalesce("entity_type", F.lit("Unknown")).alias("entity_type"), F.coalesce("description", F.lit("")).alias("description"))).alias("v"))
    return reached.join(v.select(F.col("name").alias("node"), "v"), "node", "left").select("seed", "node", "depth", F.coalesce("v.entity_type", F.lit("Unknown")).alias("entity_type"), F.coalesce("v.description", F.lit("")).alias("description"))


def related(edges: DataFrame, most: int = 3) -> DataFrame:
    """(node, names): the first ``most`` neighbours of each node by relation and name, as "name (relation)", joined with ", "."""
    w = Window.partitionBy("node").orderBy("relation", "neighbour")
    a = adjacency(edges).select("node", F.coalesce("relation", F.lit("")).alias("relation"), "neighbour").distinct()
    kept = a.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "neighbour", "relation"))), lambda x: F.concat(x["neighbour"], F.lit(" ("), x["relation"], F.lit(")")))
    return kept.groupBy("node").agg(F.array_join(listed, ", ").alias("names"))


def context_text(seeds: DataFrame, edges: DataFrame, vertices: DataFrame, hops: int = 2, most: int = 15) -> DataFrame:
    """(seed, context): for each seed its first ``most`` nodes by depth and name as markdown, grouped by hop, with description and
    related nodes of those not at the last hop. A seed that reaches nothing has no row."""
    reached = described(expand(seeds, edges, hops), vertices)
    w = Window.partitionBy("seed").orderBy("depth", "node")
    kept = reached.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).join(related(edges), "node", "left")
    first = F.lag("depth").over(w)
    text = F.concat(
        F.when(first.isNull() | (first < F.col("depth")), F.concat(F.when(first.isNotNull(), F.lit("\n")).otherwise(F.lit("")), F.lit("**Hop "), F.col("depth").cast("string"), F.lit(" Connections:**\n"))).otherwise(F.lit("")),
        F.lit("- **"), F.col("node"), F.lit("** ("), F.col("entity_type"), F.lit(")"),
        F.when(F.col("description") != "", F.concat(F.lit("\n  - Description: "), F.col("description"))).otherwise(F.lit("")),
        F.when((F.col("depth") < hops) & F.col("names").isNotNull(), F.concat(F.lit("\n  - Related: "), F.col("names"))).otherwise(F.lit("")),
    )
    lines = kept.select("seed", "n", text.alias("text"))
    return lines.groupBy("seed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n").alias("body")).select("seed", F.concat(F.lit("\n### Graph-Augmented Context\n\n"), "body", F.lit("\n")).alias("context"))


def augment(texts: DataFrame, edges: DataFrame, vertices: DataFrame, hops: int = 2, most: int = 15) -> DataFrame:
    """(id, seed, context): the graph context of the names that texts (id, content) mention. Texts without names or known nodes have none."""
    seeds = texts.where("content is not null").select("id", F.explode(named_phrases(F.col("content"))).alias("seed")).distinct()
    return seeds.join(context_text(seeds.select("seed").distinct(), edges, vertices, hops, most), "seed").select("id", "seed", "context")


def simple_paths(pairs: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(source, target, path): all paths along edges of up to ``most`` edges between given pairs (source, target), without a node
    twice, ended at the first visit of the target. ``path`` alternates nodes and relations. A pair of equal ends has none.

    Walks that can't reach the target in time are dropped as they grow: each step keeps only nodes from which the target is
    within the hops left, known from a backward expansion.
    """
    e = clean(edges).select(F.col("source").alias("node"), F.coalesce("relation", F.lit("")).alias("relation"), F.col("target").alias("next")).where("node <> next").distinct()
    p = pairs.where("source <> target").select("source", "target").distinct()
    near = p.select("target", F.col("target").alias("node"), F.lit(0).alias("left")).distinct()
    front = near
    back = e.select(F.col("next").alias("node"), F.col("node").alias("before")).distinct()
    for i in range(1, most):
        front = front.select("target", "node").join(back, "node").select("target", F.col("before").alias("node")).distinct().withColumn("left", F.lit(i))
        near = near.unionByName(front)
    near = written(near.groupBy("target", "node").agg(F.min("left").alias("left")))
    walks = p.select("source", "target", F.col("source").alias("node"), F.array("source").alias("seen"), F.array("source").alias("path"))
    done = None
    for i in range(1, most + 1):
        step = walks.join(e, "node").where(~F.array_contains("seen", F.col("next")))
        step = step.join(near.withColumnRenamed("node", "next"), ["target", "next"]).where(F.col("left") <= most - i)
        step = step.select("source", "target", F.col("next").alias("node"), F.concat("seen", F.array("next")).alias("seen"), F.concat("path", F.array("relation", "next")).alias("path"))
        ended = step.where("node = target").select("source", "target", "path")
        done = ended if done is None else done.unionByName(ended)
        walks = step.where("node <> target")
    return done


def stats(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(entities, relationships, connected_ratio): distinct rows of each, and relationships per entity."""
    v = vertices.agg(F.count("*").alias("entities"))
    return v.join(edges.agg(F.count("*").alias("relationships")), F.lit(True)).select("entities", "relationships", F.round(F.col("relationships") / F.greatest("entities", F.lit(1)), 6).alias("connected_ratio"))


def type_histogram(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy(F.coalesce("entity_type", F.lit("Unknown")).alias("entity_type")).agg(F.count("*").alias("n"))


def collapsed(edges: DataFrame, order: str = "edge_id") -> DataFrame:
    """One edge from each node to each other, the last in ``order``."""
    return clean(edges).groupBy("source", "target").agg(F.max_by(F.struct("relation", "context"), order).alias("e"), F.max(order).alias(order)).select(order, "source", "e.relation", "target", "e.context")


def node_id(name: Column) -> Column:
    """A name as an identifier: other characters than ASCII letters, digits and "_" as "_", "n" before a leading digit, "node" for nothing."""
    x = F.regexp_replace(name, "[^a-zA-Z0-9_]", "_")
    x = F.when(F.regexp_like(x, F.lit("^[0-9]")), F.concat(F.lit("n"), x)).otherwise(x)
    return F.coalesce(F.nullif(x, F.lit("")), F.lit("node"))


def _nodes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, name, entity_type): one row for each identifier; vertices before ends of edges, then by name."""
    e = clean(edges)
    v = vertices.where("name is not null").select(F.lit(0).alias("o"), "name", F.coalesce("entity_type", F.lit("")).alias("entity_type"))
    ends = e.select(F.lit(1).alias("o"), F.col("source").alias("name"), F.lit("").alias("entity_type")).unionByName(e.select(F.lit(1).alias("o"), F.col("target").alias("name"), F.lit("").alias("entity_type")))
    return v.unionByName(ends).withColumn("node", node_id(F.col("name"))).groupBy("node").agg(F.min(F.struct("o", "name", "entity_type")).alias("x")).select("node", "x.o", "x.name", "x.entity_type")


def _lookup(colours: dict[str, str], other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in colours.items() for x in kv]), F.col("entity_type")), F.lit(other))


def mermaid(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): the lines of a Mermaid graph: part 0 the head, 1 nodes with their style, 2 edges; lines of a part in any order."""
    n = _nodes(vertices, edges)
    head = edges.sparkSession.createDataFrame([(0, "graph TD")], "part int, line string")
    styled = F.when(F.col("o") == 0, F.concat(F.lit("\n    style "), "node", F.lit(" fill:"), _lookup(MERMAID, "#f5f5f5"))).otherwise(F.lit(""))
    nodes = n.select(F.lit(1).alias("part"), F.concat(F.lit("    "), "node", F.lit('["'), "name", F.lit('"]'), styled).alias("line"))
    arrows = clean(edges).select(F.lit(2).alias("part"), F.concat(F.lit("    "), node_id(F.col("source")), F.lit(' -->|"'), F.replace(F.coalesce("relation", F.lit("")), F.lit('"'), F.lit("&quot;")), F.lit('"| '), node_id(F.col("target"))).alias("line"))
    return head.unionByName(nodes).unionByName(arrows)


def dot(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): the lines of a Graphviz digraph, in the same parts, part 3 closing it."""
    n = _nodes(vertices, edges)
    spark = edges.sparkSession
    ends = spark.createDataFrame([(0, "digraph KnowledgeGraph {\n    rankdir=LR;"), (3, "}")], "part int, line string")
    quoted = lambda c: F.replace(c, F.lit('"'), F.lit('\\"'))
    colour = F.when(F.col("o") == 0, _lookup(DOT, "white")).otherwise(F.lit("white"))
    nodes = n.select(F.lit(1).alias("part"), F.concat(F.lit("    "), "node", F.lit(' [label="'), quoted(F.col("name")), F.lit('", fillcolor='), colour, F.lit(", style=filled];")).alias("line"))
    arrows = clean(edges).select(F.lit(2).alias("part"), F.concat(F.lit("    "), node_id(F.col("source")), F.lit(" -> "), node_id(F.col("target")), F.lit(' [label="'), quoted(F.coalesce("relation", F.lit(""))), F.lit('"];')).alias("line"))
    return ends.unionByName(nodes).unionByName(arrows)
