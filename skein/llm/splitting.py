"""Problem 3: splitting oversized items at natural boundaries.

Every place of a text where a piece may end has one legal successor: the next piece starts ``overlap`` characters before it and
ends at the best boundary within ``size`` characters of that start. Boundaries are, from best to worst, paragraph ends, line
ends, sentence ends and word ends; the farthest boundary of the best kind is taken that lies in the last ``reach`` of the window
(paragraph, line and sentence ends) or anywhere in it (word ends), and where there is none the piece ends at the limit.

The cuts of all texts of a slice are then derived in parallel by pointer doubling instead of walking from cut to cut: the table
of successors is joined with itself to give the table of second successors, of fourth and so on, and after each squaring the
places reached so far are joined with it, doubling them. So the number of passes grows with the logarithm of the number of
pieces, and each is a gather over arrays.

Each piece has at most ``size`` characters and begins with the last ``overlap`` characters of the one before; pieces without
their overlap join to the text exactly. Texts no longer than ``size`` are one piece. Null texts, an unknown or non-positive size,
and an overlap that is unknown, negative or not below the size give no pieces. An empty text is one empty piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import slices

_SENTENCE = np.array([ord(c) for c in ".!?…。！？；;:"], np.uint32)
_CLOSING = np.array([ord(c) for c in "\"')]}”’»」』）"], np.uint32)
_WIDE_STOP = np.array([ord(c) for c in "。！？；，、"], np.uint32)


def _last(mark: np.ndarray, n: int) -> np.ndarray:
    """For each place the greatest marked place up to it, or -1."""
    return np.maximum.accumulate(np.where(mark, np.arange(n, dtype=np.int64), -1))


def cuts(points: np.ndarray, first: np.ndarray, lens: np.ndarray, size: np.ndarray, overlap: np.ndarray, reach: float) -> np.ndarray:
    """The places where pieces end, over texts laid end to end in ``points``; ``first`` and ``lens`` are where each begins and its length.

    Places count characters before them, in the whole array; the last end of a text is its end.
    """
    n = len(points) + 1
    text_of = np.repeat(np.arange(len(first)), lens + 1)  # a place for each character and one for the end of each text
    begin, end = first[text_of], (first + lens)[text_of]
    place = np.arange(n, dtype=np.int64)[: len(text_of)]
    n = len(place)
    before = np.concatenate(([np.uint32(10)], points))[:n]  # the character before each place
    after = np.concatenate((points, [np.uint32(10)]))[:n]
    space = (points <= 32) | (points == 0xA0) | (points == 0x3000)
    white = np.concatenate(([True], space))[:n]
    blank_after = np.concatenate((space, [True]))[:n]
    line = before == 10
    paragraph = line & (np.concatenate(([0], before[:-1])) == 10) & (after != 10)
    closing = np.isin(before, _CLOSING)
    stop_before = np.isin(before, _SENTENCE)
    stop = stop_before | closing & np.concatenate(([False], stop_before[:-1]))
    sentence = stop & blank_after | np.isin(before, _WIDE_STOP)
    word = white & ~blank_after | blank_after & ~white
    s, o = size[text_of], overlap[text_of]
    limit = np.minimum(place - o + s, end)
    nearest = np.maximum(place + 1, place - o + (s * (1 - reach)).astype(np.int64))
    following = limit.copy()
    chosen = limit >= end
    for mark, low in ((paragraph, nearest), (line & (after != 10), nearest), (sentence, nearest), (word, place + 1)):
        at = _last(mark, n)[limit]
        ok = ~chosen & (at >= low)
        following[ok] = at[ok]
        chosen |= ok
    # the first piece has no overlap before it: its end is the successor of an imaginary cut at begin + overlap
    head = first + overlap
    start_limit = np.minimum(first + size, first + lens)
    firsts = start_limit.copy()
    done = start_limit >= first + lens
    for mark in (paragraph, line & (after != 10), sentence, word):
        at = _last(mark, n)[start_limit]
        low = np.maximum(head + 1, first + (size * (1 - reach)).astype(np.int64)) if mark is not word else head + 1
        ok = ~done & (at >= low)
        firsts[ok] = at[ok]
        done |= ok
    reached = np.zeros(n, bool)
    reached[firsts] = True
    new, table = firsts, following
    table[place >= end] = place[place >= end]
    while True:
        more = table[new]
        more = more[~reached[more]]
        if not len(more):
            break
        reached[more] = True
        new = np.flatnonzero(reached)
        table = table[table]
    return np.flatnonzero(reached)


def _pieces(reach: float):
    schema = pa.schema([("id", pa.string()), ("piece_no", pa.int32()), ("begin", pa.int32()), ("end", pa.int32()), ("piece", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, sizes, overlaps = (c.to_pylist() for c in batch.columns)
            for lo, hi in slices(texts):
                some = texts[lo:hi]
                points = np.frombuffer("\n".join(some).encode("utf-32-le", "surrogatepass"), "<u4")
                lens = np.fromiter(map(len, some), np.int64, len(some))
                first = np.concatenate(([0], np.cumsum(lens + 1)[:-1]))
                overlap = np.array(overlaps[lo:hi], np.int64)
                at = cuts(points, first, lens, np.array(sizes[lo:hi], np.int64), overlap, reach)
                text = np.searchsorted(first, at, "right") - 1
                fresh = np.diff(text, prepend=-1) != 0
                number = np.arange(len(at)) - np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                begin = np.where(fresh, 0, np.concatenate(([0], at[:-1])) - overlap[text] - first[text])
                end = at - first[text]
                yield pa.record_batch(
                    [
                        pa.array([ids[lo + i] for i in text], pa.string()),
                        pa.array(number.astype(np.int32) + 1),
                        pa.array(begin.astype(np.int32)),
                        pa.array(end.astype(np.int32)),
                        pa.array([some[i][b:e] for i, b, e in zip(text.tolist(), begin.tolist(), end.tolist(), strict=True)], pa.string()),
                    ],
                    schema=schema,
                )

    return run, "id string, piece_no int, begin int, end int, piece string"


def pieces(df: DataFrame, id_col: str, text_col: str, size_col: str, overlap_col: str, reach: float = 0.5) -> DataFrame:
    """(id, piece_no, begin, end, piece): the ordered pieces of every text, piece_no from 1, begin and end in characters."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(size_col).cast("long").alias("size"), F.col(overlap_col).cast("long").alias("overlap"))
    rows = rows.where("text is not null and size > 0 and overlap >= 0 and overlap < size")
    run, schema = _pieces(reach)
    return rows.mapInArrow(run, schema)


def profiled(items: DataFrame, profiles: DataFrame, profile_col: str = "profile_name") -> DataFrame:
    """Items with the chunk_size and chunk_overlap of their profile; one row per item, null where the profile is unknown.

    Of a profile name given more than once the smallest size counts. Planned as a broadcast only where the profiles are small.
    """
    sizes = profiles.where("name is not null").groupBy("name").agg(F.min(F.struct("chunk_size", "chunk_overlap")).alias("p"))
    return items.join(sizes.select(F.col("name").alias(profile_col), F.col("p.chunk_size").alias("chunk_size"), F.col("p.chunk_overlap").alias("chunk_overlap")), profile_col, "left")
