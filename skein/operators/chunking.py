"""Chunkers: from texts (id, content) to ordered pieces (id, chunk_no from 1, chunk).

Null contents give no chunks. Everything about one text happens within its row, so no chunker shuffles.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _numbered(df: DataFrame, chunks: Column) -> DataFrame:
    return df.where("content is not null").select("id", F.posexplode(chunks).alias("chunk_no", "chunk")).withColumn("chunk_no", F.col("chunk_no") + 1)


def by_headers(df: DataFrame) -> DataFrame:
    """A chunk from each line that begins with "#", white space aside, up to the next; what comes before the first is one too.
    Chunks of nothing but white space are dropped. Lines keep their breaks."""
    pieces = F.split("content", r"(?U)\n(?=[^\S\n]*#)")
    return _numbered(df, F.filter(pieces, lambda c: F.regexp_replace(c, r"(?U)\s+", "") != ""))


def fixed(df: DataFrame, size: int, overlap: int) -> DataFrame:
    """Stretches of ``size`` characters that begin every ``size - overlap`` characters, until the text ends."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be below the size")
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("content") - size) / step)).cast("int")
    return _numbered(df, F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("content"), i * step + 1, F.lit(size)))).where("chunk <> ''")


def sliding_window(text: str, size: int, overlap: int) -> list[str]:
    """Windows of ``size`` characters that end after a sentence end among their last 100 characters, else before white space among
    their last 50, else at the limit; the next begins ``overlap`` characters before. Blank windows are dropped, others stripped."""
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            sentence = max(text.rfind(c, max(start + 1, end - 100), end + 1) for c in ".!?\n")
            if sentence > start:
                end = sentence + 1
            else:
                space = next((i for i in range(end, max(start, end - 50), -1) if text[i].isspace()), -1)
                end = space if space > start else end
        if piece := text[start:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        start = max(end - overlap, start + 1)
    return out


def transcript(text: str, size: int) -> list[str]:
    """Words gathered until they make ``size`` characters or more, blanks between included; the rest is the last chunk."""
    out, words, held = [], [], 0
    for w in text.split():
        words.append(w)
        held += len(w) + (held > 0)
        if held >= size:
            out.append(" ".join(words))
            words, held = [], 0
    return [*out, " ".join(words)] if words else out


def _in_arrow(df: DataFrame, split) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, n, c) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for n, c in enumerate(split(t), 1)]
            yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate((batch.schema.field(0).type, pa.int32(), pa.string()))], names=["id", "chunk_no", "chunk"])

    rows = df.where("content is not null").select("id", "content")
    return rows.mapInArrow(run, f"id {dict(df.dtypes)['id']}, chunk_no int, chunk string")


def by_window(df: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """:func:`sliding_window` of every text. An overlap that is not below the size is refused, as windows would not advance."""
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be below the size")
    return _in_arrow(df, lambda t: sliding_window(t, size, overlap))


def by_words(df: DataFrame, size: int = 500) -> DataFrame:
    """:func:`transcript` of every text."""
    return _in_arrow(df, lambda t: transcript(t, size))


def units(df: DataFrame, separator: str) -> DataFrame:
    """One chunk for each unit between ``separator``s (pages, slides, paragraphs) that isn't blank, stripped."""
    return _numbered(df, F.filter(F.transform(F.split("content", separator), lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")), lambda c: c != ""))


def csv_units(text: str) -> list[str]:
    """"header: value" pairs of each row of a comma-separated table joined with " | ", blank cells and blank rows left out; cells may be quoted.
    Cells beyond the header have no name and are left out."""
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if any(c.strip() for c in r)]
    named = (" | ".join(f"{h.strip()}: {v.strip()}" for h, v in zip(rows[0], r, strict=False) if v.strip()) for r in rows[1:])
    return [x for x in named if x]


def table_rows(df: DataFrame) -> DataFrame:
    """:func:`csv_units` of every text."""
    return _in_arrow(df, csv_units)
