"""Profiles: named settings of retrieval, recursion and chunking."""

from __future__ import annotations

from dataclasses import asdict, dataclass, replace


@dataclass(frozen=True)
class Profile:
    top_k_dense: int = 50
    top_k_keyword: int = 50
    rrf_k: int = 60
    rrf_dense_weight: float = 4.0
    rrf_keyword_weight: float = 1.0
    rerank_candidates: int = 30
    final_context_chunks: int = 10
    max_depth: int = 3
    max_iterations: int = 10
    graph_augmented: bool = False
    graph_hops: int = 2
    multi_query: bool = False
    chunk_size: int = 1000
    chunk_overlap: int = 100
    output_format: str = "markdown"
    verbose: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be below chunk_size")


# The settings of the four profiles.
PROFILES = {
    "fast": Profile(top_k_dense=30, top_k_keyword=30, rerank_candidates=15, final_context_chunks=5, max_depth=2, max_iterations=5, chunk_size=800, chunk_overlap=50),
    "balanced": Profile(),
    "thorough": Profile(top_k_dense=100, top_k_keyword=100, rerank_candidates=50, final_context_chunks=15, max_depth=5, max_iterations=15, chunk_size=1500, chunk_overlap=150, multi_query=True, graph_augmented=True, graph_hops=3),
    "comprehensive": Profile(top_k_dense=100, top_k_keyword=100, rrf_keyword_weight=2.0, rerank_candidates=50, final_context_chunks=15, max_depth=5, max_iterations=15, graph_augmented=True, graph_hops=3, multi_query=True, chunk_size=1200, chunk_overlap=120, verbose=True),
}


def profile(name: str, **changes: object) -> Profile:
    """A profile by name with given settings changed."""
    if name not in PROFILES:
        raise KeyError(f"unknown profile {name!r}; there are {', '.join(PROFILES)}")
    return replace(PROFILES[name], **changes)


def summary(name: str) -> str:
    return "\n".join(f"{k}: {v}" for k, v in asdict(profile(name)).items())
