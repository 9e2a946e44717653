"""An object for those who want one: a corpus to add texts to and to ask questions of. It holds DataFrames, no rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import chunking, store

from . import answer
from .config import Profile
from .providers import LanguageModel, hashed_embedding

CORPUS = "id string, content string, vec array<double>"


class Rag:
    """A corpus of chunks. ``embed`` gives the vector of a text column, of chunks and questions alike; ``model`` writes answers."""

    def __init__(self, spark: SparkSession, model: LanguageModel | None = None, embed: Callable[[Column], Column] = hashed_embedding, profile: Profile = Profile(), corpus: DataFrame | None = None):
        self.spark, self.model, self.embed, self.profile = spark, model, embed, profile
        self.corpus = spark.createDataFrame([], CORPUS) if corpus is None else corpus

    def add(self, documents: DataFrame) -> Rag:
        """Documents (id, content) in chunks of the profile's size, as ``id#n``; contents the corpus has are left out, so adding twice adds once."""
        cut = chunking.by_window(documents.select(F.col("id").cast("string").alias("id"), "content"), self.profile.chunk_size, self.profile.chunk_overlap)
        chunks = cut.select(F.concat_ws("#", "id", F.col("chunk_no").cast("string")).alias("id"), F.col("chunk").alias("content"))
        fresh = store.deduplicated(store.not_stored(chunks, self.corpus), "id")
        self.corpus = self.corpus.unionByName(fresh.withColumn("vec", self.embed(F.col("content"))).select("id", "content", "vec"))
        return self

    def questions(self, texts: list[str]) -> DataFrame:
        q = self.spark.createDataFrame(list(enumerate(texts, 1)), "query_id bigint, query_text string")
        return q.withColumn("query_vec", self.embed(F.col("query_text")))

    def search(self, texts: list[str], k: int | None = None, where: Column | None = None) -> DataFrame:
        """The reranked results of questions, without answers."""
        corpus = self.corpus if where is None else self.corpus.where(where)
        return answer.in_parts(self.questions(texts), None, corpus, self.profile, self.embed).where(F.col("rank") <= (k or self.profile.final_context_chunks))

    def query(self, text: str) -> str:
        return self.query_with_sources(text)[0]

    def query_with_sources(self, text: str, **given: object) -> tuple[str, DataFrame]:
        """(answer, results); ``given`` are sub-queries and the graph, as :func:`.answer.contexts` takes them."""
        if self.model is None:
            raise ValueError("there is no model to answer with")
        said, results = answer.answers(self.questions([text]), self.corpus, self.model, self.profile, embed=self.embed, **given)
        return said.first()["answer"], results
