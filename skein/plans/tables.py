"""Reading the test tables and cutting lineage.

Every operator takes DataFrames; only queries know about paths.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table ``name`` of a directory of parquet tables, pruned to ``columns`` if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session. Where that is unset one of our own is made, if all
    of Spark runs on this machine; on a cluster that is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given is None:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="skein-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given


_written: list[str] = []


def written(df: DataFrame) -> DataFrame:
    """``df`` written once as a compressed table in the shared folder and read back.

    Unlike a cached or locally checkpointed frame this survives the loss of any executor, and unlike an RDD checkpoint
    it stays columnar, so later readers prune columns. :func:`forget` removes what was written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/skein-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Removes the tables this process has written to the shared folder, once their results have been taken; how many."""
    jvm, n = spark._jvm, 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        n += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return n
