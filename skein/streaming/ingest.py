"""Incremental ingestion as a stream of files: new documents are chunked and stored once, by content hash.

State is the stored table itself and the checkpoint of files seen, not the memory of a process, so a restart repeats nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators.store import content_hash, deduplicated, not_stored


def ingest(spark: SparkSession, folder: str, store: str, checkpoint: str, schema: str = "doc_id string, content string") -> StreamingQuery:
    """Reads parquet files as they arrive in ``folder`` and appends contents that ``store`` lacks. Runs until what is there is taken."""

    def add(batch: DataFrame, _: int) -> None:
        fresh = deduplicated(batch.where("content is not null"))
        try:
            fresh = not_stored(fresh, spark.read.schema(schema).parquet(store))
        except Exception as e:  # noqa: BLE001  the first batch finds no store
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.withColumn("content_hash", content_hash(F.col("content"))).write.mode("append").parquet(store)

    source = spark.readStream.schema(schema).parquet(folder)
    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def usage_windows(usage: DataFrame, window: str = "1 hour", late: str = "7 days") -> DataFrame:
    """Tokens by provider and window of event time over a stream or table of usage; rows later than ``late`` are left out of streams. An extension."""
    ts = usage.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    return ts.groupBy(F.window("ts", window), F.lower(F.trim("provider")).alias("provider")).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens")).select("window.start", "window.end", "provider", "calls", "tokens")
