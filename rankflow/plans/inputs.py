"""Where the input files of a run are."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class KnowledgeBaseInputs:
    """Files of the knowledge-base variant; see FIXTURES.md for their formats."""

    quads: str
    queries: str
    grades: str
    title_map: str
    entity_names: str
    entity_vectors: str
    token_weights: str
    folds: str
    # A run made elsewhere; without one, the corpus is searched with BM25.
    run: str | None = None
    # A table of the projection head, for experiments with graph or weight vectors.
    head: str | None = None
    vector_dim: int = 200
    weight_dim: int = 100


@dataclass(frozen=True)
class WikiInputs:
    """Files of the encyclopedia variant."""

    pages: str
    queries: str
    article_grades: str
    run: str | None = None
