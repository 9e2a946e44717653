"""The catalog of collections: rows (name, display_name, description, created, updated, sources, document_count, chunk_count,
embedding_model, model_history, tags). Null arrays count as empty, null counts as 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import slug

from .store import upsert


def tag(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), " ", "-")


def create(catalog: DataFrame, names: DataFrame, now: Column) -> DataFrame:
    """The catalog with an empty collection for each display name (name, description) whose slug it lacks; names without a slug are refused."""
    new = names.select(slug(F.col("name")).alias("slug"), F.col("name").alias("display_name"), "description").where("slug is not null").dropDuplicates(["slug"])
    fresh = new.join(catalog.select(F.col("name").alias("slug")), "slug", "left_anti").select(F.col("slug").alias("name"), "display_name", "description", now.cast("string").alias("created"), now.cast("string").alias("updated"), F.lit(0).alias("document_count"), F.lit(0).alias("chunk_count"))
    return catalog.unionByName(fresh, allowMissingColumns=True)


def record_source(catalog: DataFrame, name: str, source: dict, now: str) -> DataFrame:
    """The catalog with a source (path, embedding_model, documents, chunks) added to a collection: counts grow, and a changed model
    leaves a row in the history, unless there was none before."""
    mine = F.col("name") == F.lit(slug_of(name))
    item = F.struct(F.lit(source["path"]).alias("path"), F.lit(now).alias("added"), F.lit(source["embedding_model"]).alias("embedding_model"), F.lit(source["documents"]).cast("int").alias("documents"), F.lit(source["chunks"]).cast("int").alias("chunks"))
    change = F.struct(F.lit(now).alias("timestamp"), F.col("embedding_model").alias("previous_model"), F.lit(source["embedding_model"]).alias("new_model"), F.lit(source["path"]).alias("source"))
    changed = (F.coalesce("embedding_model", F.lit("")) != "") & (F.col("embedding_model") != source["embedding_model"])
    when = lambda value, old: F.when(mine, value).otherwise(F.col(old))
    empty = lambda c: F.coalesce(F.col(c), F.array().cast(dict(catalog.dtypes)[c]))
    return catalog.withColumns({
        "sources": when(F.concat(empty("sources"), F.array(item).cast(dict(catalog.dtypes)["sources"])), "sources"),
        "model_history": when(F.when(changed, F.concat(empty("model_history"), F.array(change).cast(dict(catalog.dtypes)["model_history"]))).otherwise(F.col("model_history")), "model_history"),
        "document_count": when(F.coalesce("document_count", F.lit(0)) + source["documents"], "document_count"),
        "chunk_count": when(F.coalesce("chunk_count", F.lit(0)) + source["chunks"], "chunk_count"),
        "embedding_model": when(F.lit(source["embedding_model"]), "embedding_model"),
        "updated": when(F.lit(now), "updated"),
    })


def slug_of(name: str) -> str:
    return "".join(c for c in name.strip().lower().replace(" ", "-") if c.isalnum() or c in "-_")


def add_tags(catalog: DataFrame, new: Column) -> DataFrame:
    """Tags united with folded ``new`` ones, in order, once each."""
    return catalog.withColumn("tags", F.array_distinct(F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.transform(new, tag))))


def remove_tags(catalog: DataFrame, gone: Column) -> DataFrame:
    return catalog.withColumn("tags", F.array_except(F.coalesce("tags", F.array().cast("array<string>")), F.transform(gone, tag)))


def search(catalog: DataFrame, text: str | None = None, tags: list[str] | None = None, model: str | None = None, min_documents: int | None = None, max_documents: int | None = None) -> DataFrame:
    """Collections that meet all conditions: ``text`` in name, display name or description, any of ``tags``, ``model`` in the embedding model, bounds of documents."""
    out = catalog
    if text is not None:
        out = out.where(F.contains(F.lower(F.concat_ws("\n", "name", "display_name", "description")), F.lit(text.lower())))
    if tags:
        out = out.where(F.arrays_overlap("tags", F.array(*(tag(F.lit(t)) for t in tags))))
    if model is not None:
        out = out.where(F.contains(F.lower("embedding_model"), F.lit(model.lower())))
    count = F.coalesce("document_count", F.lit(0))
    if min_documents is not None:
        out = out.where(count >= min_documents)
    if max_documents is not None:
        out = out.where(count <= max_documents)
    return out


def compatibility(catalog: DataFrame, model: str) -> DataFrame:
    """(name, compatible, mixed, models): whether a collection has no other model than ``model``, and whether its sources have several."""
    models = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.transform("sources", lambda s: s["embedding_model"]), F.array().cast("array<string>")), lambda m: F.coalesce(m, F.lit("")) != "")))
    current = F.coalesce("embedding_model", F.lit(""))
    return catalog.select("name", ((current == "") | (current == model)).alias("compatible"), (F.size(models) > 1).alias("mixed"), F.array_join(models, ",").alias("models"))


def exists(catalog: DataFrame, name: str) -> bool:
    return not load(catalog, name).isEmpty()


def load(catalog: DataFrame, name: str) -> DataFrame:
    """The row of a collection by its name or display name; none if it isn't there."""
    return catalog.where(F.col("name") == F.lit(slug_of(name)))


def save(catalog: DataFrame, rows: DataFrame) -> DataFrame:
    """The catalog with rows in the place of those of the same name."""
    return upsert(catalog, rows, "name")


def delete(catalog: DataFrame, name: str) -> DataFrame:
    """The catalog without a collection; as it is if it has none of the name."""
    return catalog.where((F.col("name") != F.lit(slug_of(name))) | F.col("name").isNull())


def listed(catalog: DataFrame) -> DataFrame:
    """(position, name, display_name): the collections that have a name, in its order, from 1."""
    kept = catalog.where(F.trim("name") != "")
    return kept.select(F.row_number().over(Window.orderBy("name", "display_name")).alias("position"), "name", "display_name")


def sources_of(catalog: DataFrame) -> DataFrame:
    """(name, position, path): the recorded sources of each collection in order, once each: what a reindexing run reads again."""
    one = catalog.select("name", F.posexplode("sources").alias("position", "s")).where("s.path is not null")
    return one.groupBy("name", F.col("s.path").alias("path")).agg(F.min("position").alias("position")).select("name", "position", "path")


def reindexed(catalog: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(catalog, sources): the catalog with the counts, sources and history of the named collections, or of all, taken back to nothing, and the sources (name, position, path)
    to be recorded again with :func:`record_source` once their files are processed."""
    mine = F.lit(True) if names is None else F.coalesce(F.col("name").isin([slug_of(n) for n in names]), F.lit(False))
    types = dict(catalog.dtypes)
    empty = {c: F.array().cast(types[c]) for c in ("sources", "model_history")} | {c: F.lit(0).cast(types[c]) for c in ("document_count", "chunk_count")}
    return catalog.withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in empty.items()}), sources_of(catalog.where(mine))


def usage_of(catalog: DataFrame, store: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(name, items, bytes, has_items, has_images, graph_edges): what each collection holds in a store (collection_name, content, image_path) and, with edges (collection_name), in its graph."""
    images = F.max((F.trim("image_path") != "").cast("int"))
    held = store.groupBy(F.col("collection_name").alias("name")).agg(F.count("*").alias("items"), F.sum(F.octet_length("content")).alias("bytes"), images.alias("images"))
    out = catalog.select("name").join(held, "name", "left")
    if edges is not None:
        out = out.join(edges.groupBy(F.col("collection_name").alias("name")).agg(F.count("*").alias("edges")), "name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return out.select("name", zero(F.col("items")).alias("items"), zero(F.col("bytes")).alias("bytes"), (zero(F.col("items")) > 0).alias("has_items"), (zero(F.col("images")) > 0).alias("has_images"), zero(F.col("edges") if edges is not None else F.lit(0)).alias("graph_edges"))


def joined_graphs(graphs: DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """(name, graph): the graph texts (name, position, graph) of each collection as one, blank ones left out."""
    kept = graphs.where(F.trim("graph") != "")
    return kept.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "graph"))), lambda x: x["graph"]), separator).alias("graph"))


def stats(catalog: DataFrame, today: str) -> DataFrame:
    """(name, document_count, chunk_count, source_count, tag_count, model_changes, age_days, has_description)."""
    size = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return catalog.select(
        "name", F.coalesce("document_count", F.lit(0)).alias("document_count"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), size("sources").alias("source_count"), size("tags").alias("tag_count"),
        size("model_history").alias("model_changes"), F.datediff(F.lit(today).cast("date"), F.try_to_date(F.substring("created", 1, 10), "yyyy-MM-dd")).alias("age_days"), (F.coalesce(F.trim("description"), F.lit("")) != "").alias("has_description"),
    )


def totals(catalog: DataFrame) -> DataFrame:
    """(collections, documents, chunks, mean_documents, mean_chunks, unique_tags); means of nothing are 0."""
    tags = catalog.select(F.explode("tags").alias("t")).agg(F.countDistinct("t").alias("unique_tags"))
    d, c = F.coalesce("document_count", F.lit(0)), F.coalesce("chunk_count", F.lit(0))
    all_ = catalog.agg(F.count("*").alias("collections"), F.coalesce(F.sum(d), F.lit(0)).alias("documents"), F.coalesce(F.sum(c), F.lit(0)).alias("chunks"), F.round(F.coalesce(F.avg(d), F.lit(0.0)), 6).alias("mean_documents"), F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias("mean_chunks"))
    return all_.join(tags, F.lit(True))


def model_distribution(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy(F.coalesce(F.nullif(F.trim("embedding_model"), F.lit("")), F.lit("unknown")).alias("embedding_model")).agg(F.count("*").alias("n"))


def tag_distribution(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def merged(catalog: DataFrame, into: str, parts: list[str]) -> DataFrame:
    """(name, document_count, chunk_count, tags, merged_sources) of a collection made of others: counts added, tags united."""
    kept = catalog.where(F.col("name").isin(parts))
    return kept.agg(
        F.lit(slug_of(into)).alias("name"), F.coalesce(F.sum("document_count"), F.lit(0)).alias("document_count"), F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunk_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("tags", F.array().cast("array<string>")))))).alias("tags"), F.array_sort(F.collect_list("name")).alias("merged_sources"),
    )
