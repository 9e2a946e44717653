"""Writing results: tables, JSON, manifests, archives, graph exports and markdown reports.

Reports and exports are of bounded results and are put together by the driver; tables are written in parallel.
"""

from __future__ import annotations

import json
import tarfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import graph
from skein.operators.context import preview
from skein.operators.store import of_dimension, upsert
from skein.plans.tables import written


def write_store(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """A store as a table; partitioned by collection if asked, so that a query of one collection reads only its files."""
    w = df.write.mode("overwrite")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def upsert_store(path: str, new: DataFrame, *on: str) -> None:
    """Replaces rows of a stored table by key. The new table is written beside the old before it takes its place."""
    spark = new.sparkSession
    write_store(written(upsert(spark.read.parquet(path), new, *on)), path)


def write_vectors(df: DataFrame, path: str, vector: str, dim: int) -> tuple[int, int]:
    """Appends the rows whose vector has ``dim`` numbers; (written, refused)."""
    once = written(df)
    good = of_dimension(once, vector, dim)
    good.write.mode("append").parquet(path)
    n, all_ = good.count(), once.count()
    return n, all_ - n


def json_lines(df: DataFrame) -> DataFrame:
    """(json): each row as a JSON object, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))


def write_manifest(manifest: DataFrame, path: str) -> None:
    Path(path).write_text(json.dumps({"files": {r["path"]: r["mtime"] for r in manifest.orderBy("path").toLocalIterator()}}))


def export_archive(folder: str, archive: str) -> None:
    with tarfile.open(archive, "w:gz") as tar:
        for p in sorted(Path(folder).rglob("*")):
            if p.is_file():
                tar.add(p, p.relative_to(folder))


def save_graph(vertices: DataFrame, edges: DataFrame, path: str, kind: str) -> None:
    """Writes a graph as "mermaid", "dot" or "json" (nodes and collapsed links) to one file."""
    out = Path(path)
    if kind in ("mermaid", "dot"):
        lines = (graph.mermaid if kind == "mermaid" else graph.dot)(vertices, edges).orderBy("part", "line")
        out.write_text("\n".join(r["line"] for r in lines.toLocalIterator()))
    elif kind == "json":
        nodes = [r.asDict() for r in vertices.select("name", "entity_type", "description").toLocalIterator()]
        out.write_text(json.dumps({"nodes": nodes, "links": [r.asDict() for r in graph.collapsed(edges).toLocalIterator()]}, default=str))
    else:
        raise ValueError(f"unknown kind of graph export: {kind}")


def report(title: str, answers: DataFrame, results: DataFrame, graph_text: str = "", most_sources: int = 5, shown: int = 100) -> str:
    """A markdown report: for each answer (query_id, query_text, answer) its question, answer and first sources with a preview."""
    lines = [f"# {title}", ""]
    if graph_text:
        lines += ["## Knowledge Graph", "", graph_text, ""]
    sources = results.where(F.col("rank") <= most_sources).select("query_id", "rank", "id", preview(F.col("content"), shown).alias("p"))
    by: dict = {}
    for r in sources.orderBy("query_id", "rank").toLocalIterator():
        by.setdefault(r["query_id"], []).append(f"{r['rank']}. `{r['id']}` {' '.join((r['p'] or '').split())}")
    for a in answers.orderBy("query_id").toLocalIterator():
        lines += [f"## {a['query_text']}", "", a["answer"] or "", "", "### Sources", "", *by.get(a["query_id"], ["No relevant documents found."]), ""]
    return "\n".join(lines)
