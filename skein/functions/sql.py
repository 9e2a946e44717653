"""Chunkers and hashes for SQL: ``register(spark)``, then ``SELECT ... FROM t, LATERAL skein_windows(t.content, 1000, 200)``."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from skein.operators.chunking import sliding_window, transcript


@udtf(returnType="chunk_no int, chunk string", useArrow=False)
class Windows:
    """Windows of a text by size and overlap; none for null."""

    def eval(self, content: str, size: int, overlap: int):  # noqa: ANN201
        if not 0 <= overlap < size:
            raise ValueError("the overlap must be below the size")
        yield from enumerate(sliding_window(content, size, overlap) if content is not None else (), 1)


@udtf(returnType="chunk_no int, chunk string", useArrow=False)
class Transcript:
    """Words gathered to chunks of a size; none for null."""

    def eval(self, content: str, size: int):  # noqa: ANN201
        yield from enumerate(transcript(content, size) if content is not None else (), 1)


def register(spark: SparkSession) -> None:
    """Names the table functions ``skein_windows`` and ``skein_transcript`` for SQL."""
    spark.udtf.register("skein_windows", Windows)
    spark.udtf.register("skein_transcript", Transcript)
