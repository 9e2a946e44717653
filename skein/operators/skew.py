"""Joins on keys of which one may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.tables import written

ROWS = 5000  # of a key on the left that are joined in one task


def hot_keys(left: DataFrame, *on: str, rows: int | None = None) -> DataFrame:
    """(on, _tiles): the keys of more than ``rows`` rows, and into how many tiles they are cut. Counted with partial sums in each task."""
    rows = rows or ROWS
    return written(left.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > rows).select(*on, F.ceil(F.col("_n") / rows).cast("int").alias("_tiles")))


def in_tiles(left: DataFrame, right: DataFrame, on: list[str], mark: str, hot: DataFrame | None = None) -> DataFrame:
    """The inner join on ``on``. Rows of the left with a hot key go to the tile that a hash of ``mark`` names, those of the right to all
    tiles of their key, so that no task holds more than a tile of a key's left side."""
    hot = hot_keys(left, *on) if hot is None else hot
    tiles = F.coalesce("_tiles", F.lit(1))
    a = left.join(hot, on, "left").withColumn("_part", F.pmod(F.xxhash64(mark), tiles).cast("int")).drop("_tiles")
    b = right.join(hot, on, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), tiles - 1))).drop("_tiles")
    return a.join(b, [*on, "_part"]).drop("_part")
