"""Operations on document stores: identity by content hash, point reads, deletions, upserts, blending.

A store is a DataFrame with an id column and a content column; other columns ride along. Writers rewrite what they change as a
whole; nothing here keeps state in a process.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(content: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, in lower-case hex; null for null."""
    return F.sha2(content, 256)


def image_hash(path: Column, description: Column) -> Column:
    """The hash that stands for an image: its path and description, null ones as empty."""
    return F.sha2(F.concat(F.lit("image:"), F.coalesce(path, F.lit("")), F.lit(":"), F.coalesce(description, F.lit(""))), 256)


def without_blank(df: DataFrame, content: str = "content") -> DataFrame:
    """Rows whose content has more than white space."""
    return df.where(F.regexp_replace(F.col(content), r"\s+", "") != "")


def first_of_each(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key in the given order, which must be total. Null keys are one key. Only one row a key leaves each task."""
    w = Window.partitionBy("_key").orderBy(*order)
    return df.withColumn("_key", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_key", "_n")


def deduplicated(df: DataFrame, id_col: str = "doc_id", content: str = "content") -> DataFrame:
    """One row for each different content, the one with the smallest id; null contents are one content."""
    return first_of_each(df, content_hash(F.col(content)), F.col(id_col))


def not_stored(new: DataFrame, stored: DataFrame, content: str = "content") -> DataFrame:
    """Rows of ``new`` whose content ``stored`` does not have; ingesting the same rows again adds nothing."""
    have = stored.select(content_hash(F.col(content)).alias("_h")).where("_h is not null").distinct()
    return new.withColumn("_h", content_hash(F.col(content))).join(have, "_h", "left_anti").drop("_h")


def stored(new: DataFrame, old: DataFrame, content: str = "content") -> DataFrame:
    """Rows of ``new`` whose content ``old`` has."""
    have = old.select(content_hash(F.col(content)).alias("_h")).where("_h is not null").distinct()
    return new.withColumn("_h", content_hash(F.col(content))).join(have, "_h", "left_semi").drop("_h")


def get(df: DataFrame, id_col: str, value: object) -> DataFrame:
    return df.where(F.col(id_col) == F.lit(value))


def delete(df: DataFrame, gone: DataFrame, *on: str) -> DataFrame:
    """Rows whose key is not in ``gone``; rows with a null in the key stay."""
    return df.join(gone.select(*on).distinct(), list(on), "left_anti")


def upsert(old: DataFrame, new: DataFrame, *on: str, order: Column | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in the place of those with the same key. Of a key given twice in ``new`` the first by ``order`` counts, by default
    the first of all its columns."""
    by = [order] if order is not None else []
    last = first_of_each(new, F.struct(*on), *by, *(F.to_json(F.struct(c)) for c in new.columns))
    return delete(old, last, *on).unionByName(last, allowMissingColumns=True)


def of_dimension(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows whose vector has exactly ``dim`` numbers, as a vector table takes them."""
    return df.where(F.size(vector) == dim)


def blended(parts: list[DataFrame], key: str, tie: str) -> DataFrame:
    """The union of collections, the first collection that has a key winning; ``tie`` orders rows of one collection with the same key."""
    both = None
    for i, p in enumerate(parts):
        q = p.withColumn("_part", F.lit(i))
        both = q if both is None else both.unionByName(q, allowMissingColumns=True)
    return first_of_each(both, F.col(key), F.col("_part"), F.col(tie)).drop("_part")


def reassembled(df: DataFrame, file_col: str, order_col: str, content: str = "content", most: int | None = 1000) -> DataFrame:
    """(file, content): the first ``most`` parts of each file in order, all with None, joined with blank lines. Null contents are left out."""
    w = Window.partitionBy(file_col).orderBy(order_col)
    kept = df.where(F.col(content).isNotNull()).withColumn("_n", F.row_number().over(w))
    kept = kept if most is None else kept.where(F.col("_n") <= most)
    parts = F.array_sort(F.collect_list(F.struct("_n", content)))
    return kept.groupBy(file_col).agg(F.array_join(F.transform(parts, lambda p: p[content]), "\n\n").alias(content))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of two manifests (path, mtime): new, modified (a strictly later time), deleted or unchanged."""
    o, n = old.select("path", F.col("mtime").alias("before")), new.select("path", F.col("mtime").alias("after"))
    status = F.when(F.col("before").isNull(), "new").when(F.col("after").isNull(), "deleted").when(F.col("after") > F.col("before"), "modified").otherwise("unchanged")
    return o.where("before is not null").join(n.where("after is not null"), "path", "full").select("path", status.alias("status"))


def clear(df: DataFrame) -> DataFrame:
    """A store of the same columns without rows."""
    return df.where(F.lit(False))


def set_values(pairs: DataFrame, new: DataFrame) -> DataFrame:
    """A table of settings (key, value) with others set in the place of those of the same key; null keys are left out."""
    return upsert(pairs, new.where("key is not null"), "key")


def get_value(pairs: DataFrame, key: str) -> str | None:
    row = get(pairs, "key", key).select("value").first()
    return None if row is None else row["value"]


def transcripts(df: DataFrame, kind: str = "doc_type", content: str = "content") -> DataFrame:
    """Rows of audio that has been transcribed, by their type; blank ones are none."""
    return without_blank(df.where(F.lower(kind).isin("audio", "transcript")), content)


def merged_stores(parts: list[DataFrame], id_col: str = "id") -> DataFrame:
    """The rows of several stores with numbered ids as one store: the ids of each part begin after the greatest of the part before. Null ids stay null."""
    both = parts[0].withColumn(id_col, F.col(id_col).cast("long"))
    for p in parts[1:]:
        offset = both.agg((F.coalesce(F.max(id_col), F.lit(-1)) + 1).alias("_o"))  # one row
        both = both.unionByName(p.join(offset, F.lit(True)).withColumn(id_col, F.col(id_col).cast("long") + F.col("_o")).drop("_o"), allowMissingColumns=True)
    return both


def with_images(results: DataFrame, images: DataFrame, documents: int = 5, most: int = 3) -> DataFrame:
    """(query_id, id, image_path): the first ``most`` images of the first ``documents`` results of each query, in their order; ``images`` is (id, image_path)."""
    found = results.where(F.col("rank") <= documents).select("query_id", "rank", "id").join(images.where("trim(image_path) <> ''").select("id", "image_path").distinct(), "id")
    w = Window.partitionBy("query_id").orderBy("rank", "image_path")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("query_id", "id", "image_path", "n")
