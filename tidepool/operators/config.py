"""Settings of retrieval and fusion: immutable, so that a preset or an override never outlives the request it was made for."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class FusionConfig:
    """Defaults of retrieval and fusion."""

    vector_weight: float = 0.7
    graph_weight: float = 0.3
    vector_top_k: int = 20
    graph_top_k: int = 15
    final_top_k: int = 10
    chunk_size: int = 400
    chunk_overlap: int = 50
    graph_confidence_threshold: float = 0.6
    graph_expansion_depth: int = 2
    entity_relevance_threshold: float = 0.7
    use_reranker: bool = True
    reranker_weight: float = 0.5
    context_budget: int = 8000
    prioritize_summaries: bool = True
    summary_boost: float = 1.2
    auto_strategy: bool = True
    force_hybrid_threshold: float = 0.5
    similarity_threshold: float = 0.7
    use_mmr: bool = True
    mmr_lambda: float = 0.7
    merge_strategy: str = "weighted"
    duplicate_handling: str = "max"
    parent_weight_boost: float = 1.05
    section_weight: float = 1.1

    def with_(self, **overrides: object) -> FusionConfig:
        """A copy with some settings changed; unknown names and weights outside 0..1 are errors. One weight sets the other."""
        unknown = set(overrides) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        for name, other in (("vector_weight", "graph_weight"), ("graph_weight", "vector_weight")):
            if name in overrides:
                value = float(overrides[name])  # type: ignore[arg-type]
                if not 0 <= value <= 1:
                    raise ValueError(f"{name} must lie in 0..1, not {value}")
                overrides.setdefault(other, round(1 - value, 12))
        return replace(self, **overrides)  # type: ignore[arg-type]


# Presets by use.
PRESETS: dict[str, dict[str, object]] = {
    "technical_documentation": {"vector_weight": 0.8, "graph_weight": 0.2, "chunk_size": 600, "prioritize_summaries": False, "use_reranker": True},
    "conceptual_learning": {"vector_weight": 0.3, "graph_weight": 0.7, "graph_expansion_depth": 3, "entity_relevance_threshold": 0.6, "prioritize_summaries": True},
    "code_search": {"vector_weight": 0.9, "graph_weight": 0.1, "chunk_size": 400, "chunk_overlap": 100, "use_reranker": False},
    "research_papers": {"vector_weight": 0.6, "graph_weight": 0.4, "chunk_size": 800, "context_budget": 12000, "use_reranker": True, "summary_boost": 1.5},
    "qa_chatbot": {"vector_weight": 0.5, "graph_weight": 0.5, "final_top_k": 5, "context_budget": 4000, "auto_strategy": True},
}


def preset(name: str, base: FusionConfig | None = None) -> FusionConfig:
    return (base or FusionConfig()).with_(**PRESETS[name])
