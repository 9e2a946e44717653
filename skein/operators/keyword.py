"""Keyword search: four scorers, each for a stated set of queries (query_id, query_text) over a corpus (id, content).

A block of queries is an incidence of terms and queries (see :mod:`.blocks`): of each content the terms it has are found in one pass, by an automaton or by its words,
and what they are worth is summed for all queries of the block at once. Null contents and queries without terms give no results. ``where`` is a
condition on the corpus that holds before the best are chosen.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import LIKE_STOP_WORDS, WORD, terms, words

from .blocks import BLOCK_BYTES, Found, best_columns, half_up, search
from .ranking import top

WORDS = re.compile(r"\w+")
ROWS = 256  # contents scored at a time
PIECE = 1 << 20  # common terms of contents and queries that are summed at a time, unless one content has more
LONG = 100  # terms of more characters are looked for one by one: an automaton walks as many steps back at each place of a text that repeats itself


class Incidence:
    """Which queries of a block have which terms, and with what weight."""

    def __init__(self, lists: list[list[str]], weights: list[list[float]] | None = None):
        self.n = len(lists)
        self.place: dict[str, int] = {}
        pairs = [(self.place.setdefault(t, len(self.place)), q, w) for q, l in enumerate(lists) for t, w in zip(l, weights[q] if weights else [1.0] * len(l), strict=True)]
        pairs.sort(key=lambda p: p[0])
        self.query = np.array([p[1] for p in pairs], np.int64)
        self.weight = np.array([p[2] for p in pairs], np.float64)
        self.begin = np.searchsorted(np.array([p[0] for p in pairs], np.int64), np.arange(len(self.place) + 1))
        self.sizes = np.array([len(l) for l in lists], np.float64)

    def sums(self, rows: list[dict[int, float]]) -> np.ndarray:
        """For each row, the terms it has with what they count, and each query the sum over their common terms."""
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        term = np.array([t for r in rows for t in r], np.int64)
        worth = np.array([x for r in rows for x in r.values()], np.float64)
        many = self.begin[term + 1] - self.begin[term]
        ends = np.concatenate(([0], np.cumsum(np.bincount(row, many, len(rows)).astype(np.int64))))
        first = np.concatenate(([0], np.cumsum([len(r) for r in rows], dtype=np.int64)))
        out, lo = np.zeros((len(rows), self.n)), 0
        while lo < len(rows):  # by whole contents, so that what belongs to a sum is added up in one order
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + PIECE, "right")) - 1)
            part = slice(first[lo], first[hi])
            out[lo:hi] = self._sum(row[part] - lo, term[part], worth[part], many[part], hi - lo)
            lo = hi
        return out

    def _sum(self, row: np.ndarray, term: np.ndarray, worth: np.ndarray, many: np.ndarray, rows: int) -> np.ndarray:
        at = np.repeat(self.begin[term] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(int(many.sum())) if len(term) else np.zeros(0, np.int64)
        cell = np.repeat(row, many) * self.n + self.query[at]
        return np.bincount(cell, np.repeat(worth, many) * self.weight[at], rows * self.n).reshape(rows, self.n)

    def automaton(self):
        """A function from a text to the terms it contains anywhere."""
        try:
            import ahocorasick
        except ImportError:
            return lambda text: {i: 1.0 for t, i in self.place.items() if t in text}
        a = ahocorasick.Automaton()
        long = {t: i for t, i in self.place.items() if len(t) > LONG}
        for t, i in self.place.items():
            if len(t) <= LONG:
                a.add_word(t, i)
        if not len(a):
            return lambda text: {i: 1.0 for t, i in long.items() if t in text}
        a.make_automaton()
        return lambda text: dict.fromkeys({i for _, i in a.iter(text)} | {i for t, i in long.items() if t in text}, 1.0)


def _contents(batch: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    texts = batch.column("content").to_pylist()
    for lo in range(0, len(texts), ROWS):
        yield lo, texts[lo : lo + ROWS]


def _best(value: np.ndarray, k: int, lo: int) -> Found:
    """All that a column's best may be; equal values beyond the k-th are told by id, so all of them count unless there are many rows."""
    i, j = best_columns(np.where(value > 0, value, -np.inf), k, 0)
    return j, i + lo, value[i, j]


def _searched(queries: DataFrame, corpus: DataFrame, k: int, prepare, score, where: Column | None, block_bytes: int) -> DataFrame:
    kept = (corpus if where is None else corpus.where(where)).where("content is not null").select("id", "content")
    q = queries.where(F.size("terms") > 0)
    size = F.aggregate("terms", F.lit(32), lambda s, t: s + F.length(t) * 2 + 24)
    found = search(q, kept, k, size, prepare, score, block_bytes)
    return top(found.withColumnRenamed("value", "keyword_score"), k, F.col("keyword_score"))


def _contained(table: pa.Table) -> tuple:
    inc = Incidence(table.column("terms").to_pylist())
    whole = table.column("whole").to_pylist() if "whole" in table.column_names else None
    return inc, inc.automaton(), whole


def _shares(block: tuple, batch: pa.RecordBatch, k: int) -> Iterator[Found]:
    inc, find, whole = block
    for lo, texts in _contents(batch):
        low = [t.lower() for t in texts]
        got = inc.sums([find(t) for t in low])
        share = got / inc.sizes
        if whole is not None:  # only a text with all terms of a query can contain it whole
            for i, j in zip(*np.nonzero(got == inc.sizes), strict=True):
                share[i, j] += whole[j] in low[i]
            share = 100 * share
        yield _best(half_up(share), k, lo)


def _any(block: tuple, batch: pa.RecordBatch, k: int) -> Iterator[Found]:
    inc, find, _ = block
    for lo, texts in _contents(batch):
        got = inc.sums([find(t.lower()) for t in texts])
        i, j = np.nonzero(got > 0)
        yield j, i + lo, np.full(len(i), 100.0)


def substring_topk(queries: DataFrame, corpus: DataFrame, k: int, keep_zero: bool = False, where: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, id, keyword_score, rank): the share of a query's terms that the content contains as substrings, and 1 more if it
    contains the whole query, times 100. Contents without any are dropped unless ``keep_zero``: then the smallest ids fill up the ``k`` rows with 0."""
    q = queries.select("query_id", terms(F.col("query_text")).alias("terms"), F.lower("query_text").alias("whole")).where("terms is not null")
    found = _searched(q, corpus, k, _contained, _shares, where, block_bytes)
    if not keep_zero:
        return found
    # k rows of score 0 are among the 2k smallest ids, as at most k rows have more
    kept = (corpus if where is None else corpus.where(where)).where("content is not null")
    first = kept.select("id").orderBy("id").limit(2 * k).agg(F.collect_list("id").alias("ids"))
    zero = q.where(F.size("terms") > 0).select("query_id").join(first, F.lit(True)).select("query_id", F.explode("ids").alias("id"))
    rest = zero.join(found.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("keyword_score", F.lit(0.0))
    return top(found.drop("rank").unionByName(rest), k, F.col("keyword_score"))


def overlap_topk(queries: DataFrame, corpus: DataFrame, k: int, where: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, id, keyword_score, rank): the share of a query's words that the content contains as substrings; only above 0."""
    q = queries.select("query_id", words(F.col("query_text")).alias("terms")).where("terms is not null")
    return _searched(q, corpus, k, _contained, _shares, where, block_bytes)


def like_terms(query: Column) -> Column:
    """The first five CJK and the first five Latin keywords of a query, each once."""
    kept = F.filter(F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9一-鿿]+"), F.lit(0)), lambda t: (F.length(t) > 1) & ~t.isin(LIKE_STOP_WORDS))
    latin = F.slice(F.filter(kept, lambda t: ~F.regexp_like(t, F.lit("[一-鿿]"))), 1, 5)
    cjk = F.slice(F.filter(kept, lambda t: F.regexp_like(t, F.lit("[一-鿿]"))), 1, 5)
    return F.array_distinct(F.concat(cjk, latin))


def like_filter(queries: DataFrame, corpus: DataFrame, k: int, where: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, id, raw_score, rank): contents that contain any of a query's first five Latin or first five CJK keywords as
    substrings, all with the score 100, in the order of the id. ``where`` and the keywords hold both, as in a filter expression joined with "and"."""
    q = queries.select("query_id", like_terms(F.col("query_text")).alias("terms")).where("terms is not null")
    return _searched(q, corpus, k, _contained, _any, where, block_bytes).withColumnRenamed("keyword_score", "raw_score")


def bm25_topk(queries: DataFrame, corpus: DataFrame, k: int, k1: float = 1.5, b: float = 0.75, where: Column | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, id, keyword_score, rank) by Okapi BM25 with idf ln(1 + (N - df + 0.5) / (df + 0.5)).

    Document frequencies are counted by words, combined in each task before the shuffle; postings are never shuffled. N and the mean length are one small
    aggregate over all contents, contents without words included.
    """
    kept = (corpus if where is None else corpus.where(where)).where("content is not null")
    tokens = F.regexp_extract_all(F.lower("content"), F.lit(WORD), F.lit(0))
    stats = kept.agg(F.count("*").alias("n"), F.avg(F.size(tokens)).alias("mean")).first()
    n, mean = stats["n"], stats["mean"] or 1.0
    df = kept.select(F.explode(F.array_distinct(tokens)).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    asked = queries.select("query_id", F.explode(words(F.col("query_text"))).alias("word")).join(df, "word")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    q = asked.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("word", idf.alias("idf")))).alias("x")).select("query_id", F.col("x.word").alias("terms"), F.col("x.idf").alias("idf"))

    def prepare(table: pa.Table) -> Incidence:
        return Incidence(table.column("terms").to_pylist(), table.column("idf").to_pylist())

    def score(inc: Incidence, batch: pa.RecordBatch, best: int) -> Iterator[Found]:
        for lo, texts in _contents(batch):
            rows = []
            for t in texts:
                found = WORDS.findall(t.lower())
                level = k1 * (1 - b + b * len(found) / mean)
                rows.append({i: c * (k1 + 1) / (c + level) for w, c in Counter(found).items() if (i := inc.place.get(w)) is not None})
            yield _best(half_up(inc.sums(rows)), best, lo)

    return _searched(q, corpus, k, prepare, score, where, block_bytes)
