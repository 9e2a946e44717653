"""Problem 6: evaluation texts leaking into training text.

A document leaks an item if they share ``n`` consecutive words in the same order; an item of fewer words leaks where the document
holds all of its words as one run. The n-grams of the items are a table (item, length, hash, words). Only their hashes, 8 bytes each, are
broadcast, as sorted arrays in blocks of at most about ``block_grams`` hashes (16 MB): a larger evaluation set takes one pass over the corpus
per block, whose hits are written before the next is broadcast. The corpus is scanned with rolling n-gram hashes over whole Arrow
batches; a bitmap rules nearly all windows out before the binary search, and every hit is verified by joining its words with those of the items.

Null and blank texts on either side never match. Documents given twice with the same id and text count once; a repeated item id is looked up
by each of its texts. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.plans.tables import written

from .words import _BASE, Words, mix, slices

BITMAP = 22


def _grams(n: int):
    """(item_id, k, key, run): the n-grams of items, shorter items whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                words = Words(texts[lo:hi])
                count = np.bincount(words.doc, minlength=words.n) if len(words.doc) else np.zeros(words.n, np.int64)
                out: list[tuple] = []
                for k in np.unique(np.minimum(count, n)).tolist():
                    if k:
                        g, at = words.grams(k)
                        mine = np.minimum(count, n)[words.doc[at]] == k
                        for h, p in zip(g[mine].view(np.int64).tolist(), at[mine].tolist(), strict=True):
                            out.append((ids[lo + int(words.doc[p])], k, h, " ".join(words.text(p + i) for i in range(k))))
                yield pa.record_batch([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.string()))], names=["item_id", "k", "key", "run"])

    return run, "item_id bigint, k int, key bigint, run string"


def _hits(shared):
    """(doc_id, t, begin, end, key, run): the windows of documents whose hash an item has; begin and end are character places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = []
        for k, h in sorted(shared.value.items()):
            bitmap = np.zeros(1 << BITMAP, bool)
            bitmap[(h >> np.uint64(64 - BITMAP)).astype(np.int64)] = True
            table.append((k, h, bitmap))
        for batch in batches:
            ids, marks, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            out: list[tuple] = []
            for lo, hi in slices(texts):
                words = Words(texts[lo:hi])
                g, done = np.zeros(len(words.h), np.uint64), 0
                for k, h, bitmap in table:
                    n = len(words.h) - k + 1
                    if n <= 0:
                        break
                    g = g[:n]
                    for i in range(done, k):
                        g = g * _BASE + words.h[i : i + n]
                    done = k
                    full = mix(g + np.uint64(k))
                    at = np.flatnonzero(bitmap[(full >> np.uint64(64 - BITMAP)).astype(np.int64)])
                    at = at[words.doc[at] == words.doc[at + k - 1]]
                    place = np.minimum(np.searchsorted(h, full[at]), len(h) - 1)
                    for p in at[h[place] == full[at]].tolist():
                        d = int(words.doc[p])
                        begin, end = int(words.start[p] - words.first[d]), int(words.end[p + k - 1] - words.first[d])
                        out.append((ids[lo + d], marks[lo + d], begin, end, int(full[p].view(np.int64)), " ".join(words.text(p + i) for i in range(k))))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.record_batch([pa.array([r[j] for r in out], t) for j, t in enumerate(kinds)], names=["doc_id", "t", "begin", "end", "key", "run"])

    return run, "doc_id bigint, t bigint, begin int, end int, key bigint, run string"


def _runs(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, n: int, block_grams: int) -> DataFrame:
    """(doc_id, t, item_id, begin, end): every verified run; ``t`` is a hash of the document's text."""
    spark = docs.sparkSession
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.col(text).alias("text")).where("text is not null and doc_id is not null")
    run, schema = _grams(n)
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null and item_id is not null")
    grams = written(asked.mapInArrow(run, schema).distinct())
    blocks = max(1, -(-grams.count() // block_grams))
    found = None
    for b in range(blocks):
        keys = grams.where(F.pmod("key", F.lit(blocks)) == b).select("k", "key").distinct().toArrow()
        k, h = np.asarray(keys.column("k").combine_chunks()), np.asarray(keys.column("key").combine_chunks()).view(np.uint64)
        shared = spark.sparkContext.broadcast({int(x): np.sort(h[k == x]) for x in np.unique(k)})
        run, schema = _hits(shared)
        hits = source.mapInArrow(run, schema)
        if blocks > 1:
            hits = written(hits)
            shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    return found.join(grams.select("item_id", "key", "run"), ["key", "run"]).select("doc_id", "t", "item_id", "begin", "end")


def _stretches(runs: DataFrame, *keys: str) -> DataFrame:
    """Overlapping runs of the same keys as one (begin, end)."""
    w = Window.partitionBy(*keys).orderBy("begin", "end")
    fresh = F.coalesce(F.col("begin") > F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    part = F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return runs.withColumn("part", part).groupBy(*keys, "part").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("part")


def leak_spans(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 12, block_grams: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, begin, end): the stretches of each document that an item covers, in characters from 0, end excluded.
    Overlapping runs of the same item are one stretch."""
    return _stretches(_runs(docs, items, doc_id, text, item_id, item_text, n, block_grams), "doc_id", "t", "item_id").drop("t")


def leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 12, block_grams: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id): every document with the items it leaks."""
    return _runs(docs, items, doc_id, text, item_id, item_text, n, block_grams).select("doc_id", "item_id").distinct()


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 12, drop_share: float = 0.5, block_grams: int = 2_000_000) -> DataFrame:
    """(doc_id, text, removed_chars): the corpus with leaked stretches cut out; a document of which ``drop_share`` or more of the
    characters leak is removed as a whole. With several blocks of items the stretches of all blocks are cut."""
    runs = _stretches(_runs(docs, items, doc_id, text, item_id, item_text, n, block_grams), "doc_id", "t")
    spans = runs.groupBy("doc_id", "t").agg(F.array_sort(F.collect_set(F.struct("begin", "end"))).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, gone = [], []
            for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at, parts, removed = 0, [], 0
                for x in s or []:
                    b, e = max(x["begin"], at), x["end"]
                    if e > b:
                        parts.append(t[at:b])
                        removed += e - b
                        at = e
                kept.append("".join([*parts, t[at:]]) if t is not None else None)
                gone.append(removed)
            yield pa.record_batch([batch.column(0), pa.array(kept, pa.string()), pa.array(gone, pa.int64())], names=["doc_id", "text", "removed_chars"])

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("t", F.xxhash64("text"))
    joined = source.join(spans, ["doc_id", "t"], "left").drop("t")
    size = F.length("text")
    return joined.mapInArrow(cut, "doc_id bigint, text string, removed_chars bigint").where(F.col("text").isNull() | (F.col("removed_chars") == 0) | (F.col("removed_chars") < drop_share * (size + F.col("removed_chars"))))
