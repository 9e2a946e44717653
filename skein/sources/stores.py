"""Reading document stores: parquet and JSON natively, SQLite files by one task each, archives of collections by the driver."""

from __future__ import annotations

import json
import sqlite3
import tarfile
from collections.abc import Iterator
from contextlib import closing
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STORE = "doc_id string, content string, content_hash string, doc_type string, metadata string, image_path string, embedding array<float>"


def read_json_store(spark: SparkSession, path: str) -> DataFrame:
    """(id, content, metadata, embedding) of stores kept as one JSON object, id to document, in each file of ``path``."""
    kept = "map<string, struct<content: string, metadata: map<string, string>, embedding: array<float>, image_path: string>>"
    docs = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kept)).alias("id", "d"))
    return docs.select("id", "d.content", "d.metadata", "d.embedding", "d.image_path")


def read_sqlite(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Documents with their embeddings, if any, of SQLite files on a path that all executors see; a task a file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
                    found = db.execute("SELECT d.doc_id, d.content, d.content_hash, d.doc_type, d.metadata, d.image_path, e.embedding FROM documents d LEFT JOIN embeddings e ON e.doc_id = d.doc_id")
                    while rows := found.fetchmany(1000):
                        vectors = [None if r[6] is None else np.frombuffer(r[6], "<f4").tolist() for r in rows]
                        yield pa.record_batch([*(pa.array([r[i] for r in rows], pa.string()) for i in range(6)), pa.array(vectors, pa.list_(pa.float32()))], names=["doc_id", "content", "content_hash", "doc_type", "metadata", "image_path", "embedding"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(run, STORE)


def import_archive(archive: str, root: str, name: str) -> Path:
    """Unpacks an exported collection below ``root``; refuses existing ones and members that would leave their folder."""
    target = Path(root) / name
    if target.exists():
        raise FileExistsError(f"collection {name} exists")
    with tarfile.open(archive, "r:gz") as tar:
        for m in tar.getmembers():
            if not (m.isfile() or m.isdir()) or ".." in Path(m.name).parts or Path(m.name).is_absolute():
                raise ValueError(f"refused member {m.name}")
        target.mkdir(parents=True)
        tar.extractall(target, filter="data")
    return target


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(path, mtime) of a manifest {"files": {path: mtime}}; empty if there is none."""
    p = Path(path)
    files = json.loads(p.read_text()).get("files", {}) if p.exists() else {}
    return spark.createDataFrame([(k, float(v)) for k, v in files.items()], "path string, mtime double")
