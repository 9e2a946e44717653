"""Problem 8: keyword-stuffed and link-list pages.

Corpus counts: of every word and every pair of neighbouring words, the number of different texts that hold it (words with digits
count as one word). Counts run over all texts, each different text once, so that mass copies of a spam page cannot make its
phrases look ordinary. Only what is *supported* is kept for the second pass: pairs held by a share ``pair_share`` of the texts or
more, and words held by ``word_share``. There are at most (pairs in a text, on average) / pair_share of them whatever the size
of the corpus, which bounds what is broadcast.

Pages: the words of a text are put down to links, to tags, to word salad, to repeated collocations or to strings of keywords, and
a page whose sum is more than ``share`` of its words is found. But for links and tags, which their form tells, mean pointwise mutual information (PMI) decides.

* *Salad* is a run of ``run_words`` words or more without punctuation whose neighbours have a mean PMI below ``low_pmi`` in the corpus (pairs
  that the page itself repeats count as 0); half of it if few words come again. In sentences, even unpunctuated ones, it is far higher.
* A sentence or line is a *repeated collocation* if its mean PMI with the page is ``high_pmi`` or more: the PMI of a pair of neighbours
  that occurs ``repeats`` times or more with the texts that hold it, the logarithm of texts over texts that hold it (0 below ``odd``).
* *Strings of keywords* are ``run_items`` or more items in a row of at most three words, made of words the corpus knows, whose neighbours have a mean PMI
  below ``list_pmi``; records and tables, whose items are names and numbers, are not.

A cheap vectorised look rules out texts that can't reach the share. Null and blank texts and texts of fewer than ``min_words`` words are never found.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.tables import written

from .words import _BASE, Words, letters_in, mix, slices

LINK = re.compile(r"<a\s[^>]*>[^<]*</a>|\[[^\]\n]*\]\([^)\s]*\)|(?:https?://|www\.)[^\s<>\"')\]]+|(?<![\w@./-])[\w-]+(?:\.[\w-]+)*\.[a-z]{2,}/[^\s<>\"')\]]*", re.IGNORECASE)
TAG = re.compile(r"#[^\W_]+")
WORD = re.compile(r"[^\W_]+")
STOP = re.compile(r"[.?!。！？…]+[\"'”’»)]*(?:\s|$)|\n")
BREAK = re.compile(r"[,;:|/()\[\]{}•*·–—!?.\n]|\s-\s")
NUMBER = np.uint64(0x1D2C3B4A59687761)


def masked(words: Words) -> np.ndarray:
    """Hashes of the words, all words with digits alike."""
    if not len(words.h):
        return words.h
    out = words.h.copy()
    out[np.searchsorted(words.start, np.flatnonzero((words.points >= 48) & (words.points <= 57)), "right") - 1] = NUMBER
    return out


def pairs(h: np.ndarray) -> np.ndarray:
    return mix(h[:-1] * _BASE + h[1:]) if len(h) > 1 else np.zeros(0, np.uint64)


def _held(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes and how many texts hold each."""
    if not len(h):
        return h, np.zeros(0, np.int64)
    order = np.argsort(h)
    x, many = h[order], int(doc.max()) + 1
    new = np.concatenate(([True], x[1:] != x[:-1]))
    both = (np.cumsum(new) - 1) * many + doc[order]
    both.sort()
    return x[new], np.bincount(both[np.concatenate(([True], both[1:] != both[:-1]))] // many)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept: dict[int, list] = {0: [], 1: []}
    size = texts_seen = held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for kind, parts in kept.items():
            if parts:
                k, n = (np.concatenate(x) for x in zip(*parts, strict=True))
                u, at = np.unique(k, return_inverse=True)
                yield pa.record_batch([pa.array(np.full(len(u), kind, np.int8)), pa.array(u.view(np.int64)), pa.array(np.bincount(at, n).astype(np.int64))], names=["kind", "key", "n"])
                parts.clear()

    for batch in batches:
        texts = batch.column(0).to_pylist()
        texts_seen += len(texts)
        for lo, hi in slices(texts):
            words = Words(texts[lo:hi])
            h = masked(words)
            same = words.doc[1:] == words.doc[:-1]
            for kind, (x, many) in ((0, _held(words.doc, h)), (1, _held(words.doc[:-1][same], pairs(h)[same]))):
                held += int(many.sum()) * (kind == 0)
                kept[kind].append((x, many))
                size += len(x)
            if size > 3_000_000:
                yield from flush()
                size = 0
    yield from flush()
    yield pa.record_batch([pa.array([2, 2], pa.int8()), pa.array([0, 1], pa.int64()), pa.array([texts_seen, held], pa.int64())], names=["kind", "key", "n"])


class Counts:
    """Supported words and pairs of a corpus of ``n`` texts, which hold ``held`` different words each, summed up."""

    def __init__(self, n: int, held: int, least: float, word_keys: np.ndarray, word_counts: np.ndarray, pair_keys: np.ndarray, pair_counts: np.ndarray):
        self.n, self.held, self.least = n, held, least
        self.word_keys, self.word_counts, self.pair_keys, self.pair_counts = word_keys, word_counts, pair_keys, pair_counts

    def support(self, keys: np.ndarray) -> np.ndarray:
        """How many texts hold each pair; 0 if it isn't supported."""
        if not len(self.pair_keys):
            return np.zeros(len(keys), np.int64)
        if self.marks is None:  # most pairs are told by the first bits of their hashes not to be supported
            self.marks = np.zeros(1 << 22, bool)
            self.marks[self.pair_keys >> np.uint64(42)] = True
        out = np.zeros(len(keys), np.int64)
        able = np.flatnonzero(self.marks[keys >> np.uint64(42)])
        at = np.minimum(np.searchsorted(self.pair_keys, keys[able]), len(self.pair_keys) - 1)
        out[able] = np.where(self.pair_keys[at] == keys[able], self.pair_counts[at], 0)
        return out

    marks: np.ndarray | None = None

    def pmi(self, h: np.ndarray, support: np.ndarray) -> np.ndarray:
        """The pointwise mutual information of each word with the next; 0 where the pair is not supported."""
        if not len(self.word_keys):
            return np.zeros(len(support))
        out, told = np.zeros(len(support)), np.flatnonzero(support > 0)
        df = []
        for x in (h[told], h[told + 1]):
            at = np.minimum(np.searchsorted(self.word_keys, x), len(self.word_keys) - 1)
            df.append(np.maximum(np.where(self.word_keys[at] == x, self.word_counts[at], 3), 3).astype(float))
        out[told] = np.maximum(0, np.log(support[told] * max(1, self.held) / (df[0] * df[1])))
        return out

    def rarity(self, support: np.ndarray) -> np.ndarray:
        """The pointwise mutual information of a text with a pair it holds."""
        return np.log(max(1, self.n) / np.maximum(support, self.least))

    def knows(self, h: np.ndarray) -> np.ndarray:
        if not len(self.word_keys):
            return np.zeros(len(h), bool)
        return self.word_keys[np.minimum(np.searchsorted(self.word_keys, h), len(self.word_keys) - 1)] == h


def corpus_counts(df: DataFrame, id_col: str, text_col: str, pair_share: float, word_share: float) -> Counts:
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    # exact copies are told by hashes; the texts themselves are shuffled only where there are too many copies to broadcast their ids
    marked = texts.select("id", F.xxhash64("text").alias("x"), F.xxhash64(F.reverse("text")).alias("y"))
    same = marked.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 1")
    again = written(marked.join(same, ["x", "y"]).where("id <> first").select("id"))
    counted = texts.join(again, "id", "left_anti").select("text").mapInArrow(_count, "kind tinyint, key bigint, n bigint").groupBy("kind", "key").agg(F.sum("n").alias("n"))
    counted = written(counted)
    sums = dict(counted.where("kind = 2").select("key", "n").collect())
    total = sums.get(0, 0)
    bars = max(3.0, word_share * total), max(4.0, pair_share * total)
    rows = counted.where((F.col("kind") < 2) & (F.col("n") >= F.when(F.col("kind") == 0, bars[0]).otherwise(bars[1]))).toArrow()
    kind, key, many = (np.asarray(rows.column(c).combine_chunks()) for c in ("kind", "key", "n"))
    key = key.view(np.uint64)
    order = np.argsort(key)
    word, pair = order[kind[order] == 0], order[kind[order] == 1]
    return Counts(total, sums.get(1, 0), max(1.0, pair_share * total), key[word], many[word], key[pair], many[pair])


SPACE, END, CLOSING, BREAKS, LINE = 1, 2, 4, 8, 16


@lru_cache(1)
def _kinds() -> np.ndarray:
    """What each code point below 65,536 is, as bits; none of those beyond is anything."""
    out = np.zeros(1 << 16, np.uint8)
    out[[i for i in range(0x3001) if chr(i).isspace()]] |= SPACE
    for bit, chars in ((END, ".?!。！？…"), (CLOSING, "\"'”’»)"), (BREAKS, ",;:|/()[]{}•*·–—!?.\n"), (LINE, "\n")):
        out[[ord(c) for c in chars]] |= bit
    return out


def _ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Whether ``STOP`` and whether ``BREAK`` is found between each word and the next."""
    points = words.raw
    top = int(points.max(initial=0))
    kind = _kinds()[points if top < 1 << 16 else np.where(points < 1 << 16, points, 0)]
    ended = (kind & LINE) > 0
    space = (kind & SPACE) > 0
    after = np.concatenate((space[1:] | letters_in(points[1:]), [True]))  # the next is white space or in a word
    ended[(kind & END) > 0] |= after[(kind & END) > 0]
    closing = np.flatnonzero(kind & CLOSING)
    if len(closing):  # signs that close a sentence count with what stands before them all
        begin = np.concatenate(([True], closing[1:] != closing[:-1] + 1))
        other = (closing[begin] - 1)[np.cumsum(begin) - 1]
        closed = (other >= 0) & ((kind[np.maximum(other, 0)] & END) > 0)
        ended[closing[closed & after[closing]]] = True
    broken = (kind & BREAKS) > 0
    dash = np.flatnonzero(points == 45)
    dash = dash[(dash > 0) & (dash < len(points) - 1)]
    broken[dash[space[dash - 1] & space[dash + 1]]] = True

    def between(mark: np.ndarray) -> np.ndarray:
        n = np.zeros(len(mark) + 1, np.int32)
        np.cumsum(mark, dtype=np.int32, out=n[1:])
        return n[words.start[1:]] > n[words.end[:-1]]

    return between(ended), between(broken)


def suspects(texts: list[str], counts: Counts, share: float = 0.5, repeats: int = 4, odd: float = 3.9, high_pmi: float = 2.0, run_words: int = 20, run_items: int = 8, low_pmi: float = 1.0) -> np.ndarray:
    """Whether :func:`parts` could put more than ``share`` of the words of each text down to stuffing, by a few passes over all of them.

    Texts with signs of links or tags are looked at in any case. Of others the words of units that could be repeated collocations, of
    long items of low information and of runs of short items are counted as there, without the conditions that only lower the counts.
    """
    words = Words(texts)
    out = np.array([any(x in t for x in ("://", "www.", "/", "](", "<a")) or "#" in t and TAG.search(t) is not None for t in texts], bool)
    if len(words.h) < 2:
        return out
    n = np.bincount(words.doc, minlength=words.n).astype(np.float64)
    h = masked(words)
    g = pairs(h)
    inner = words.doc[:-1] == words.doc[1:]
    own = mix(g + words.doc[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    ordered = np.sort(own)
    often = np.unique(ordered[repeats - 1 :][ordered[repeats - 1 :] == ordered[: max(0, len(ordered) - repeats + 1)]])
    marks = np.zeros(1 << 20, bool)
    marks[often >> np.uint64(44)] = True
    able = np.flatnonzero(marks[own >> np.uint64(44)] & inner)
    again = np.zeros(len(own), bool)
    again[able[np.isin(own[able], often)]] = True
    support = counts.support(g)
    pmi = np.where(inner & ~again, counts.pmi(h, support), 0.0)
    excess = np.zeros(len(h))
    rare = np.where(again, counts.rarity(support), 0.0)
    excess[:-1] = np.where(rare >= odd, rare, 0)
    excess[1:] = np.maximum(excess[1:], excess[:-1])
    ended, broken = _ends(words)
    unit = np.concatenate(([0], np.cumsum(ended | ~inner)))
    letters = words.end - words.start
    repeated = (np.bincount(unit, excess * letters) >= high_pmi * np.bincount(unit, letters) - 1e-9)[unit]
    item = np.concatenate(([0], np.cumsum(broken | ~inner)))
    length = np.bincount(item)
    within = item[:-1] == item[1:]
    mean = np.bincount(item[:-1][within], pmi[within], minlength=len(length)) / np.maximum(length - 1, 1)
    salad = ((length >= run_words) & (mean < low_pmi + 1e-9))[item]
    first = np.concatenate(([True], item[1:] != item[:-1]))
    short, doc = length <= 3, words.doc[first]
    run = np.concatenate(([0], np.cumsum((short[1:] != short[:-1]) | (doc[1:] != doc[:-1]))))
    listed = (short & (np.bincount(run)[run] >= run_items))[item]
    return out | (np.bincount(words.doc, repeated | salad | listed, words.n) > share * n)


def parts(text: str, counts: Counts, repeats: int = 4, odd: float = 3.9, high_pmi: float = 2.0, run_words: int = 20, run_items: int = 8, known: float = 0.85, low_pmi: float = 1.0, list_pmi: float = 2.0) -> tuple[int, dict[str, int]]:
    """The number of words of a text, and how many are put down to each kind of stuffing."""
    n = len(WORD.findall(text))
    found = dict.fromkeys(("link", "tag", "repeated", "keywords", "salad"), 0)

    def blank(kind: str):
        def f(m: re.Match) -> str:
            found[kind] += len(WORD.findall(m.group()))
            return "\n" * len(m.group())

        return f

    rest = TAG.sub(blank("tag"), LINK.sub(blank("link"), text))
    words = Words([rest])
    k = len(words.h)
    if not k:
        return n, found
    if found["link"] * 3 > n:  # names of links, on the same line as the link or alone on theirs, belong to the list of links
        for piece in re.split(r"\n\n+|[|•]", rest):
            if 0 < (m := len(WORD.findall(piece))) <= 4:
                found["link"] += m
    h = masked(words)
    g = pairs(h)
    support = counts.support(g)
    gaps = [rest[a:b] for a, b in zip(words.end[:-1].tolist(), words.start[1:].tolist(), strict=True)]
    kind = np.zeros(k, np.int8)
    letters = words.end - words.start  # units are weighed by letters, as texts without spaces have few and long words
    u, at, many = np.unique(g, return_inverse=True, return_counts=True)
    many = many[at] if k > 1 else np.zeros(0, np.int64)
    number = h == NUMBER
    pmi = np.zeros(k)  # of a word with the next in the corpus; 0 if the pair is not supported, or repeated as the corpus doesn't
    excess = np.zeros(k)  # of a repeated pair with this page
    if k > 1:
        pmi[:-1] = np.where(many < repeats, counts.pmi(h, support), 0)
        again = (many >= repeats) & ~(number[:-1] & number[1:])
        excess[:-1] = np.where(again, counts.rarity(support), 0)
    excess[excess < odd] = 0
    excess[1:] = np.maximum(excess[1:], excess[:-1])
    items = np.concatenate(([0], np.cumsum([bool(BREAK.search(x)) for x in gaps]))).astype(np.int64)
    length = np.bincount(items)
    begin = np.concatenate(([0], np.cumsum(length)))

    def mean_pmi(lo: int, hi: int, told: np.ndarray | None = None) -> float:
        x = pmi[lo : hi - 1] if told is None else pmi[lo : hi - 1][told[:-1] & told[1:]]
        return float(x.mean()) if len(x) else 0.0

    for i in np.flatnonzero(length >= run_words).tolist():
        lo, hi = int(begin[i]), int(begin[i + 1])
        variety = len(np.unique(h[lo:hi])) / (hi - lo)
        if mean_pmi(lo, hi) < (low_pmi if variety <= 0.8 else low_pmi / 2):
            kind[lo:hi] = 3
    units = np.concatenate(([0], np.cumsum([bool(STOP.search(x)) for x in gaps]))).astype(np.int64)
    mean_excess = np.bincount(units, excess * letters) / np.bincount(units, letters)
    kind[(mean_excess >= high_pmi)[units] & (kind == 0)] = 1
    common = counts.knows(h)
    short = np.concatenate(([False], length <= 3, [False]))
    edge = np.flatnonzero(short[1:] != short[:-1])
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a >= run_items:
            lo, hi = int(begin[a]), int(begin[b])
            told = ~number[lo:hi]
            if told.any() and common[lo:hi][told].mean() >= known and 4 * told.sum() >= hi - lo and mean_pmi(lo, hi, told) < list_pmi:
                kind[lo:hi][kind[lo:hi] == 0] = 2
    for i, name in enumerate(("repeated", "keywords", "salad"), 1):
        found[name] = int((kind == i).sum())
    return n, found


def keyword_pages(df: DataFrame, id_col: str, text_col: str, share: float = 0.5, min_words: int = 10, pair_share: float = 0.002, word_share: float = 0.0005) -> DataFrame:
    """(doc_id, words, link, tag, repeated, keywords, salad): the pages found, with their words and how many are of each kind."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(corpus_counts(df, id_col, text_col, pair_share, word_share))
    kinds = ("link", "tag", "repeated", "keywords", "salad")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[list] = []
            for lo, hi in slices(texts):
                for i in np.flatnonzero(suspects(texts[lo:hi], counts, share)).tolist():
                    n, found = parts(texts[lo + i], counts)
                    if n >= min_words and sum(found.values()) > share * n:
                        out.append([ids[lo + i], n, *(found[k] for k in kinds)])
            yield pa.record_batch([pa.array([r[j] for r in out], pa.int64()) for j in range(7)], names=["doc_id", "words", *kinds])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null and doc_id is not null")
    return source.mapInArrow(run, "doc_id bigint, words bigint, " + ", ".join(f"{k} bigint" for k in kinds))
