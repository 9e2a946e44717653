"""Problem 1: near-duplicate records with small edits.

Every text is turned into a *fingerprint*: one min-hash symbol for each of ``blocks * rows`` random permutations of its word
shingles. Two texts of Jaccard similarity s agree in each symbol with probability s, so the Hamming distance of their
fingerprints (symbols that differ) measures how unlike they are. The fingerprint is split into ``blocks`` blocks of ``rows``
symbols. By the pigeonhole principle two fingerprints that differ in fewer symbols than there are blocks agree in a whole block,
so joining on (block, its symbols) finds every such pair without comparing all pairs; pairs farther apart are found with the
probability 1 - (1 - s^rows)^blocks, 0.9999 at s = 0.6 with the defaults. The join verifies the Hamming distance of the
candidates (three bits of every symbol, packed into two longs) and an exact comparison of the shingle sets follows.

A block that many rows share is cut into tiles. Classes need no more links than join their texts: first each row of a block is compared with one
of it, and then what is still apart with the rest.

Texts with the same shingle set, exact copies above all, are one *class* before any join: only one representative of each takes
part, so a copy that makes up a third of all rows costs one row in the join.

Nulls, blanks and texts with fewer words than ``min_words`` take no part in pairs; in ``near_copy_classes`` each is a class of its
own. An empty table gives an empty result. Rows are told apart by the id column; a repeated id counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.components import connected_components
from skein.plans.tables import written

from .words import Words, mix, slices

SYMBOL_BITS, PER_LONG = 3, 20  # three bits of each symbol, twenty symbols in a long
_LOW = sum(1 << (SYMBOL_BITS * i) for i in range(PER_LONG))


def _shingles(words: Words, k: int, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all shingles of texts of enough words, where each text's run begins, and which text it is."""
    g, at = words.grams(k)
    doc = words.doc[at]
    enough = np.bincount(words.doc, minlength=words.n) >= max(min_words, k)
    keep = enough[doc]
    g, doc = g[keep], doc[keep]
    begin = np.flatnonzero(np.diff(doc, prepend=-1))
    return g, begin, doc[begin]


def _sets(g: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    return [np.unique(x) for x in np.split(g, begin[1:])] if len(begin) else []


def _fingerprint(k: int, min_words: int, blocks: int, rows: int, seed: int):
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 63, blocks * rows, dtype=np.uint64) | np.uint64(1)
    b = rng.integers(0, 1 << 63, blocks * rows, dtype=np.uint64)
    schema = pa.schema([("id", pa.string()), ("d1", pa.int64()), ("d2", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                g, begin, doc = _shingles(Words(texts[lo:hi]), k, min_words)
                if not len(doc):
                    continue
                sets = _sets(g, begin)
                digest = np.array([(np.bitwise_xor.reduce(mix(s)), np.add.reduce(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)))) for s in sets], np.uint64)
                u = np.concatenate(sets)
                at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
                symbols = np.stack([np.minimum.reduceat(u * x + y, at) for x, y in zip(a, b, strict=True)], 1)
                symbols = mix(symbols)
                bits = (symbols >> np.uint64(61)) & np.uint64(7)
                half = [np.zeros(len(doc), np.uint64), np.zeros(len(doc), np.uint64)]
                for i in range(min(bits.shape[1], 2 * PER_LONG)):
                    half[i // PER_LONG] |= bits[:, i] << np.uint64(SYMBOL_BITS * (i % PER_LONG))
                keys = np.zeros((len(doc), blocks), np.uint64)
                for i in range(blocks):
                    x = np.full(len(doc), i + 1, np.uint64)
                    for j in range(rows):
                        x = mix(x * np.uint64(0x9E3779B97F4A7C15) + symbols[:, i * rows + j])
                    keys[:, i] = x
                yield pa.record_batch(
                    [
                        pa.array([ids[lo + i] for i in doc], pa.string()),
                        *(pa.array(x.view(np.int64)) for x in (digest[:, 0].copy(), digest[:, 1].copy(), *half)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (len(doc) + 1) * blocks, blocks, dtype=np.int32)), pa.array(keys.ravel().view(np.int64))),
                    ],
                    schema=schema,
                )

    return run, "id string, d1 bigint, d2 bigint, f1 bigint, f2 bigint, keys array<bigint>"


def _shingle_sets(k: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in slices(texts):
                g, begin, doc = _shingles(Words(texts[lo:hi]), k, min_words)
                sets = [np.unique((s >> np.uint64(24)).astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes() for s in _sets(g, begin)]
                yield pa.record_batch([pa.array([ids[lo + i] for i in doc], pa.string()), pa.array(sets, pa.binary())], names=["id", "shingles"])

    return run, "id string, shingles binary"


def _unpack(x: bytes) -> np.ndarray:
    wide = np.zeros((len(x) // 5, 8), np.uint8)
    wide[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return wide.view("<u8").ravel()


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        last, mine = None, None
        out = np.zeros(len(a))
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            if x is not last:
                last, mine = x, _unpack(x)
            other = _unpack(y)
            both = len(np.intersect1d(mine, other, assume_unique=True))
            out[i] = both / (len(mine) + len(other) - both)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "similarity"])


def _distance(x: str, y: str) -> Column:
    """How many of twenty packed symbols differ."""
    d = F.col(x).bitwiseXOR(F.col(y))
    folded = d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseOR(F.shiftrightunsigned(d, 2))
    return F.bit_count(folded.bitwiseAND(F.lit(_LOW)))


HOT = 2000  # rows of a block that are compared in one task


def _fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int, min_words: int, blocks: int, rows: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, rep): the class of each text that takes part; (id, f1, f2, keys) of the representatives; (id, shingles) of all texts."""
    if blocks * rows > 2 * PER_LONG:
        raise ValueError(f"fingerprints have {2 * PER_LONG} symbols at most")
    texts = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    run, schema = _fingerprint(shingle, min_words, blocks, rows, seed)
    prints = written(texts.mapInArrow(run, schema))
    reps = written(prints.groupBy("d1", "d2").agg(F.min_by(F.struct("id", "f1", "f2", "keys"), "id").alias("rep")))
    classes = prints.select("id", "d1", "d2").join(reps.select("d1", "d2", F.col("rep.id").alias("rep")), ["d1", "d2"]).select("id", "rep").distinct()
    run, schema = _shingle_sets(shingle, min_words)
    return classes, reps.select("rep.*"), texts.mapInArrow(run, schema)


def _blocks_of(reps: DataFrame) -> DataFrame:
    return reps.withColumn("key", F.explode("keys")).drop("keys")


def _met(left: DataFrame, right: DataFrame, differ: Column, max_distance: int) -> DataFrame:
    """(id_a, id_b): pairs of rows (key, id, f1, f2) that share a block and are near by their fingerprints, smaller id first. A block of more than
    ``HOT`` rows is cut into tiles of the left side, each of which meets the right side in a task of its own."""
    hot = written(left.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("key", F.ceil(F.col("n") / HOT).cast("int").alias("tiles")))
    tiles = F.coalesce("tiles", F.lit(1))
    a = left.join(hot, "key", "left").select("key", F.pmod(F.xxhash64("id"), tiles).cast("int").alias("part"), *(F.col(c).alias(f"{c}_a") for c in left.columns if c != "key"))
    b = right.join(hot, "key", "left").select("key", F.explode(F.sequence(F.lit(0), tiles - 1)).alias("part"), *(F.col(c).alias(f"{c}_b") for c in right.columns if c != "key"))
    near = a.join(b, ["key", "part"]).where(differ & (_distance("f1_a", "f1_b") + _distance("f2_a", "f2_b") <= max_distance))
    return near.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b, similarity): the pairs whose shingle sets are alike."""
    return (
        pairs.join(sets.select(F.col("id").alias("id_a"), F.col("shingles").alias("x")), "id_a")
        .join(sets.select(F.col("id").alias("id_b"), F.col("shingles").alias("y")), "id_b")
        .select("id_a", "id_b", "x", "y")
        .mapInArrow(_exact, "a string, b string, similarity double")
        .where(F.col("similarity") >= similarity)
    )


def _joined(reps: DataFrame, sets: DataFrame, similarity: float, max_distance: int) -> DataFrame:
    """(node, component): the classes of representatives, without all their links.

    First each row of a block is compared with the block's first one only, so a family of m reworkings costs m comparisons a block. What these links
    have not joined with most of its block yet is then compared with all of the block that is in other components; no link between components is
    left out.
    """
    rows_ = _blocks_of(reps)
    first = rows_.groupBy("key").agg(F.min_by(F.struct("id", "f1", "f2"), "id").alias("c"), F.count("*").alias("n")).where("n > 1").select("key", F.col("c.id").alias("id_b"), F.col("c.f1").alias("f1_b"), F.col("c.f2").alias("f2_b"))
    near = rows_.select("key", *(F.col(c).alias(f"{c}_a") for c in ("id", "f1", "f2"))).join(first, "key").where((F.col("id_a") != F.col("id_b")) & (_distance("f1_a", "f1_b") + _distance("f2_a", "f2_b") <= max_distance))
    stars = written(_verified(near.select("id_b", "id_a").distinct().select(F.col("id_b").alias("id_a"), F.col("id_a").alias("id_b")), sets, similarity).select(F.col("a").alias("src"), F.col("b").alias("dst")))
    part = connected_components(stars)
    placed = _blocks_of(reps.join(part.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id")))
    most = placed.groupBy("key", "component").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("key", "most")
    open_ = written(placed.join(most, "key"))
    rest = _met(open_.where("component <> most").drop("most"), open_.drop("most"), F.col("component_a") != F.col("component_b"), max_distance)
    return connected_components(stars.unionByName(_verified(rest, sets, similarity).select(F.col("a").alias("src"), F.col("b").alias("dst"))))


def near_copy_pairs(df: DataFrame, id_col: str, text_col: str, similarity: float = 0.8, shingle: int = 5, min_words: int = 0, blocks: int = 20, rows: int = 2, max_distance: int = 26, seed: int = 7, expand_up_to: int = 200) -> DataFrame:
    """(id_a, id_b): pairs of texts whose shingle sets are alike by ``similarity`` or more, id_a < id_b as strings.

    All members of two linked classes are paired, and all members of a class with each other, as long as the classes have at most
    ``expand_up_to`` members. A larger class is given by its representative: each member is paired with it, and only it with
    members of other classes, so rows grow in proportion to the copies and no link between different texts is lost.
    """
    classes, reps, sets = _fingerprints(df, id_col, text_col, shingle, min_words, blocks, rows, seed)
    rows_ = _blocks_of(reps)
    links = _verified(_met(rows_, rows_, F.col("id_a") < F.col("id_b"), max_distance), sets, similarity)
    sized = classes.groupBy("rep").agg(F.count("*").alias("n"))
    many = sized.where("n > 1")
    copies = classes.join(many, "rep")
    stand = copies.where((F.col("n") <= expand_up_to) & (F.col("id") != F.col("rep"))).select("rep", "id")
    spread = stand.unionByName(copies.select("rep", F.col("rep").alias("id")).distinct())
    within = (
        copies.where((F.col("n") <= expand_up_to)).select("rep", F.col("id").alias("p"))
        .join(copies.where((F.col("n") <= expand_up_to)).select("rep", F.col("id").alias("q")), "rep")
        .where("p < q").select("p", "q")
        .unionByName(copies.where((F.col("n") > expand_up_to) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("p"), F.col("id").alias("q")))
    )
    across = (
        links.join(spread.select(F.col("rep").alias("a"), F.col("id").alias("p")), "a", "left")
        .join(spread.select(F.col("rep").alias("b"), F.col("id").alias("q")), "b", "left")
        .select(F.coalesce("p", "a").alias("p"), F.coalesce("q", "b").alias("q"))
    )
    return across.unionByName(within).select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))


def near_copy_classes(df: DataFrame, id_col: str, text_col: str, similarity: float = 0.8, shingle: int = 5, min_words: int = 0, blocks: int = 20, rows: int = 2, max_distance: int = 26, seed: int = 7, count_links: bool = True) -> DataFrame:
    """One row per text: (id, class_id, class_size, links). Texts chained by links are one class, named by its smallest id; ``links``
    counts the different texts a text is linked with directly. Texts that take no part are classes of one. Without ``count_links`` there is no
    such column, and the links of a family, which grow with the square of its texts, are not all looked at."""
    classes, reps, sets = _fingerprints(df, id_col, text_col, shingle, min_words, blocks, rows, seed)
    classes = written(classes)
    if count_links:
        rows_ = _blocks_of(reps)
        links = written(_verified(_met(rows_, rows_, F.col("id_a") < F.col("id_b"), max_distance), sets, similarity))
        joined = connected_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    else:
        joined = _joined(reps, sets, similarity, max_distance)
    ids = df.select(F.col(id_col).cast("string").alias("id")).where("id is not null").distinct()
    each = ids.join(classes, "id", "left").withColumn("rep", F.coalesce("rep", "id")).join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    each = each.select("id", "rep", F.coalesce("component", "rep").alias("class_id"))
    out = each.join(each.groupBy("class_id").agg(F.count("*").alias("class_size")), "class_id")
    if not count_links:
        return out.select("id", "class_id", "class_size")
    degree = links.select("a").unionByName(links.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("links"))
    return out.join(degree.withColumnRenamed("a", "rep"), "rep", "left").select("id", "class_id", "class_size", F.coalesce("links", F.lit(0)).cast("long").alias("links"))
