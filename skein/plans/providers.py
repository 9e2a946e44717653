"""Pluggable models. Embedders run in the executors a batch at a time; rerankers score the bounded candidates of a query; language
models are called by the driver only. Each has a deterministic form that needs no network."""

from __future__ import annotations

import hashlib
import math
import re
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import WORD

from .tables import written


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str], instruction: str | None = None) -> list[list[float]]: ...


class Reranker(Protocol):
    def rerank(self, query: str, documents: list[str]) -> list[tuple[int, float]]: ...


class Transcriber(Protocol):
    def transcribe(self, paths: list[str]) -> list[str | None]: ...


class LanguageModel(Protocol):
    def complete(self, prompt: str) -> str: ...


def hashed_embedding(text: Column, dim: int = 64) -> Column:
    """The unit vector of counts of words by the first eight hex digits of their MD5, modulo ``dim``; zeros for texts without words."""
    word = F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))
    bucket = F.transform(word, lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % dim)
    # lambda variables bind what is used for every dimension, so that it is computed once for a text
    counts = F.transform(F.array(bucket), lambda b: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double")))[0]
    scaled = F.transform(F.array(counts), lambda c: F.transform(F.array(F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))), lambda n: F.transform(c, lambda x: F.when(n > 0, x / n).otherwise(0.0)))[0])
    return F.when(text.isNotNull(), scaled[0])


class HashingEmbedder:
    """The same in Python, for queries and tests; instructions are part of the text."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str], instruction: str | None = None) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dim
            for w in re.findall(r"\w+", (f"{instruction}\n{t}" if instruction else t).lower()):
                v[int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % self.dim] += 1
            n = math.sqrt(sum(x * x for x in v))
            out.append([x / n if n else 0.0 for x in v])
        return out


def embedded(df: DataFrame, make: Callable[[], Embedder], text: str = "content", into: str = "embedding", batch: int = 64) -> DataFrame:
    """Adds the vectors of a model that each Python worker builds once. Null texts have null vectors, as failed calls should, never zeros."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for s in parts:
            out: list = [None] * len(s)
            at = [i for i, t in enumerate(s) if t is not None]
            for lo in range(0, len(at), batch):
                for i, v in zip(at[lo : lo + batch], model.embed([s.iloc[i] for i in at[lo : lo + batch]]), strict=True):
                    out[i] = v
            yield pd.Series(out)

    return df.withColumn(into, run(F.col(text)))


def transcribed(files: DataFrame, make: Callable[[], Transcriber], cache: str | None = None, batch: int = 16) -> DataFrame:
    """(path, key, transcript) of files (path, mtime, length), by a model that each Python worker builds once. The key is of path, time and length, so a file
    that changes is taken anew. With ``cache``, a folder that all executors see, what it has is not transcribed again and what is new is added to it;
    failed files, whose transcript is null, are not kept there and are tried again."""
    spark = files.sparkSession
    key = F.substring(F.sha2(F.concat_ws(":", "path", F.col("mtime").cast("string"), F.col("length").cast("string")), 256), 1, 16)
    asked = files.where("path is not null").select("path", key.alias("key")).dropDuplicates(["key"])
    have = None
    if cache is not None:
        try:
            have = spark.read.schema("path string, key string, transcript string").parquet(cache)
        except AnalysisException:  # the first run finds none
            have = None
    todo = asked if have is None else asked.join(have.select("key"), "key", "left_anti").select("path", "key")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            said: list = []
            for lo in range(0, len(part), batch):
                said += model.transcribe(part["path"].iloc[lo : lo + batch].tolist())
            yield part.assign(transcript=pd.Series(said, index=part.index, dtype=object))

    new = written(todo.mapInPandas(run, "path string, key string, transcript string"))
    if cache is None:
        return new
    known = new if have is None else new.unionByName(have.join(asked.select("key"), "key", "left_semi").select("path", "key", "transcript"))
    out = written(known)
    new.where("transcript is not null").write.mode("append").parquet(cache)
    return out


def progress(spark: SparkSession) -> list[tuple[int, int, int]]:
    """(stage, tasks done, tasks) of the stages that run now, for those who show how far a job is."""
    tracker = spark.sparkContext.statusTracker()
    found = [(i, tracker.getStageInfo(i)) for i in tracker.getActiveStageIds()]
    return sorted((i, s.numCompletedTasks, s.numTasks) for i, s in found if s is not None)


class OverlapReranker:
    """Scores documents by the share of the query's words they have."""

    def rerank(self, query: str, documents: list[str]) -> list[tuple[int, float]]:
        q = set(re.findall(r"\w+", query.lower()))
        scored = [(i, len(q & set(re.findall(r"\w+", d.lower()))) / len(q) if q else 0.0) for i, d in enumerate(documents)]
        return sorted(scored, key=lambda x: (-x[1], x[0]))


class EchoModel:
    """Answers with the first sentence of the context that shares most words with the question."""

    def complete(self, prompt: str) -> str:
        context, _, question = prompt.rpartition("Question:")
        q = set(re.findall(r"\w+", question.lower()))
        sentences = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", context) if s.strip()]
        best = max(sentences, key=lambda s: len(q & set(re.findall(r"\w+", s.lower()))), default="No relevant documents found.")
        return f'FINAL("{best.replace(chr(34), chr(39))}")'


class Fallback:
    """Models in order of preference. One that fails three times in a row is left out for ``cooldown`` seconds; a prompt that is too
    long for one is halved once before the next is asked."""

    def __init__(self, models: list[tuple[str, LanguageModel]], failures: int = 3, cooldown: float = 300.0, clock: Callable[[], float] = time.monotonic):
        self.models, self.failures, self.cooldown, self.clock = models, failures, cooldown, clock
        self.failed: dict[str, tuple[int, float]] = {}

    def complete(self, prompt: str) -> str:
        last: Exception | None = None
        for name, model in self.models:
            n, since = self.failed.get(name, (0, 0.0))
            if n >= self.failures and self.clock() - since < self.cooldown:
                continue
            for text in (prompt, prompt[len(prompt) // 2 :]):
                try:
                    answer = model.complete(text)
                except Exception as e:  # noqa: BLE001  any failure of a service counts
                    last = e
                    if not re.search(r"context|too long|maximum.*tokens", str(e), re.IGNORECASE):
                        break
                else:
                    self.failed.pop(name, None)
                    return answer
            n = self.failed.get(name, (0, 0.0))[0]
            self.failed[name] = (n + 1, self.clock())
        raise RuntimeError("no model answered") from last
