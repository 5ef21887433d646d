"""Scoring: embed the distinct texts, project the entity side, measure the distance."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.functions.text import score_name
from rankflow.functions.vectors import BATCH_DISTANCES, DISTANCES, TRIPLET_MARGIN, features, finite
from rankflow.operators.embedding import BATCH_SIZE, Encoder, attach_embedding, embed_sides, embed_texts, text_key
from rankflow.operators.losses import hinge_loss, sampled_sides
from rankflow.operators.triplets import triplet_loss
from rankflow.operators.vector_store import VectorStore
from rankflow.session import land

# What a score belongs to. The passage is part of it, because an entity may have two texts.
SCORE_KEYS = ("query_id", "dbpedia_entity", "passage_key")
SCORES = "experiment string, query_id string, dbpedia_entity string, passage_key string, score double"


def load_head(weights: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The layers of the projection head, in order; a head is part of a model, a few MB."""
    layers = weights.orderBy("layer").limit(3).collect()
    if len(layers) != 2:
        raise ValueError("a projection head has two layers")
    return [(np.array(r["w"], dtype=float), np.array(r["b"], dtype=float)) for r in layers]


def head_projection(
    rows: DataFrame, column: str, name: str, head: list[tuple[np.ndarray, np.ndarray]]
) -> DataFrame:
    """Linear, ReLU, linear: two matrix products per Arrow batch. ``w`` is (out, in)."""
    shared = rows.sparkSession.sparkContext.broadcast(head)

    @F.pandas_udf("array<double>")
    def project(batch: pd.Series) -> pd.Series:
        (w1, b1), (w2, b2) = shared.value
        known = batch.notna().to_numpy()
        out = pd.Series([None] * len(batch), dtype=object)
        if known.any():
            x = np.stack(batch[known].to_numpy())
            y = np.maximum(x @ w1.T + b1, 0.0) @ w2.T + b2
            out[known] = pd.Series(list(y), index=out.index[known])
        return out

    return rows.withColumn(name, project(F.col(column).cast("array<double>")))


def with_passage_key(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("passage_key", text_key("abstract"))


def unscored(candidates: DataFrame, scores: DataFrame, experiment: str) -> DataFrame:
    """Candidates that have no score yet in ``experiment``."""
    done = scores.where(F.col("experiment") == experiment).select(*SCORE_KEYS)
    keyed = with_passage_key(candidates)
    return keyed.join(done, list(SCORE_KEYS), "left_anti").select(*candidates.columns)


def score_candidates(
    candidates: DataFrame,
    experiment: str,
    load_encoder: Callable[[], Encoder],
    head: list[tuple[np.ndarray, np.ndarray]] | None = None,
    graph: bool = False,
    weights: bool = False,
    weight_dim: int = 100,
    metric: str = "euclidean",
    batch_size: int = BATCH_SIZE,
    existing: DataFrame | None = None,
    embedded: tuple[DataFrame, DataFrame] | None = None,
    store: VectorStore | None = None,
) -> DataFrame:
    """``experiment`` and score per candidate, lower is better.

    ``embedded`` holds the vectors of queries and passages where ``embed_sides`` has made them before;
    ``store`` keeps them between runs.

    Graph or weight vectors need a head that projects them back to the width of the encoder.

    Each distinct query and passage is encoded once. The vectors, the costly part, are landed: they
    are not computed again when an executor is lost, and their true size decides how they are
    joined. The result is written to a new place or appended to a score table; the candidate table
    stays as it is.
    """
    if existing is not None:
        candidates = unscored(candidates, existing, experiment)
    model = {"head": head, "graph": graph, "weights": weights, "weight_dim": weight_dim, "metric": metric}
    rows = candidate_distances(
        with_passage_key(candidates), SCORE_KEYS, load_encoder, **model,
        batch_size=batch_size, embedded=embedded, store=store,
    )
    return rows.select(F.lit(experiment).alias("experiment"), *SCORE_KEYS, F.col("distance").alias("score"))


def candidate_distances(
    candidates: DataFrame,
    keep: Sequence[str],
    load_encoder: Callable[[], Encoder],
    head: list[tuple[np.ndarray, np.ndarray]] | None = None,
    graph: bool = False,
    weights: bool = False,
    weight_dim: int = 100,
    metric: str = "euclidean",
    batch_size: int = BATCH_SIZE,
    embedded: tuple[DataFrame, DataFrame] | None = None,
    store: VectorStore | None = None,
) -> DataFrame:
    """The columns ``keep`` of every candidate, and the model's ``distance`` of its query and passage."""
    _check_head(head, graph, weights)
    vectors = ["biggraph_embedding"] * graph + ["deepct_weights"] * weights
    queries, passages = embedded or embed_sides(
        candidates.select(*SCORE_KEYS[:2], "query_text", "abstract"), load_encoder, batch_size, store
    )
    rows = candidates.select(
        *keep, *vectors, text_key("query_text").alias("_query_key"), text_key("abstract").alias("_passage_key")
    )
    rows = attach_embedding(rows, queries, "_query_key", "_query")
    rows = attach_embedding(rows, passages, "_passage_key", "_passage")
    rows = _entity_side(rows, "_passage", "biggraph_embedding", "deepct_weights", head, graph, weights, weight_dim)
    return rows.select(*keep, DISTANCES[metric](F.col("_query"), F.col("_passage")).alias("distance"))


def _check_head(head, graph: bool, weights: bool) -> None:
    if head is None:
        if graph or weights:
            raise ValueError("graph and weight vectors need a projection head")
        return
    (w1, b1), (w2, b2) = head
    if w2.shape[1] != w1.shape[0] or b1.shape != (w1.shape[0],) or b2.shape != (w2.shape[0],):
        raise ValueError("the layers of the head don't fit each other")
    if (graph or weights) and w2.shape[0] >= w1.shape[1]:
        raise ValueError("the head is not wide enough for graph or weight vectors")


def _entity_side(rows, passage, graph_column, weight_column, head, graph, weights, weight_dim) -> DataFrame:
    """``passage`` with its graph and weight vectors, projected back by the head."""
    joined = features(
        F.col(passage),
        F.col(graph_column) if graph else None,
        finite(F.col(weight_column), weight_dim) if weights else None,
    )
    rows = rows.withColumn(passage, joined)
    return rows if head is None else head_projection(rows, passage, passage, head)


def model_triplet_loss(
    triplets: DataFrame,
    load_encoder: Callable[[], Encoder],
    head: list[tuple[np.ndarray, np.ndarray]] | None = None,
    graph: bool = False,
    weights: bool = False,
    weight_dim: int = 100,
    metric: str = "euclidean",
    margin: float = TRIPLET_MARGIN,
    batch_size: int = BATCH_SIZE,
) -> DataFrame:
    """The mean loss of a model on a triplet table: encode, add vectors, project, compare.

    Each distinct query and passage is encoded once, whichever side of how many triplets it is on.
    """
    _check_head(head, graph, weights)
    queries = land(embed_texts(triplets.select("query_text"), "query_text", load_encoder, batch_size))
    # Keys are made distinct before texts; a text of n triplets is not shuffled n times.
    sides = [triplets.select(F.col(f"abstract_{s}").alias("abstract")) for s in "xy"]
    passages = land(embed_texts(sides[0].union(sides[1]), "abstract", load_encoder, batch_size))
    extra = ["biggraph_embedding"] * graph + ["deepct_weights"] * weights
    rows = triplets.select(
        text_key("query_text").alias("_query"),
        *[text_key(f"abstract_{s}").alias(f"_key_{s}") for s in "xy"],
        *[f"{c}_{s}" for c in extra for s in "xy"],
    )
    rows = attach_embedding(rows, queries, "_query", "_anchor")
    for s in "xy":
        rows = attach_embedding(rows, passages, f"_key_{s}", f"_side_{s}")
        rows = _entity_side(
            rows, f"_side_{s}", f"biggraph_embedding_{s}", f"deepct_weights_{s}", head, graph, weights, weight_dim
        )
    return triplet_loss(rows, "_anchor", "_side_x", "_side_y", metric, margin)


def model_sampled_loss(
    candidates: DataFrame,
    load_encoder: Callable[[], Encoder],
    margin: float = TRIPLET_MARGIN,
    seed: int = 42,
    **model,
) -> DataFrame:
    """(loss, n_pairs) of a model on the triplets of the candidates, none of which is built.

    Each candidate's distance is measured once; ``model_triplet_loss`` measures two in every triplet.
    """
    sides = land(sampled_sides(candidates, seed))
    measured = candidate_distances(sides, ("query_id", "query_text", "is_positive"), load_encoder, **model)
    query = [F.sha2(c, 256).alias(c) for c in ("query_id", "query_text")]
    return hinge_loss(
        measured.select(*query, "is_positive", "distance"), ("query_id", "query_text"), "distance", "is_positive", margin
    )


def attach_scores(
    candidates: DataFrame, scores: DataFrame, experiment: str, name: str
) -> DataFrame:
    """One score column per experiment, the wide form of the score table."""
    one = scores.where(F.col("experiment") == experiment)
    one = one.select(*SCORE_KEYS, F.col("score").alias(name)).dropDuplicates(list(SCORE_KEYS))
    joined = with_passage_key(candidates).join(one, list(SCORE_KEYS), "left")
    return joined.select(*candidates.columns, name)


def score_experiments(
    candidates: DataFrame, experiments: Sequence[dict], existing: DataFrame | None = None
) -> DataFrame:
    """All experiments in one long table; those of one encoder are one pass over the candidates.

    The vectors of an encoder are made and joined once; then every Arrow batch goes through all heads and
    distances of its experiments. With ``existing`` scores, a candidate is read if any experiment lacks it,
    and gets the scores it lacks.
    """
    shared: dict[tuple, list[dict]] = {}
    for e in experiments:
        encoder = (e["load_encoder"], e.get("batch_size", BATCH_SIZE), e.get("store"))
        shared.setdefault(encoder, []).append(e)
    return reduce(
        DataFrame.unionByName, [_score_group(candidates, group, existing, *key) for key, group in shared.items()]
    )


def _lacking(rows: DataFrame, names: Sequence[str], existing: DataFrame | None) -> DataFrame:
    """Candidates with the experiments that have not scored them in ``_lacks``."""
    every = F.array(*[F.lit(n) for n in names])
    if existing is None:
        return rows.withColumn("_lacks", every)
    done = existing.where(F.col("experiment").isin(list(names)))
    done = done.groupBy(*SCORE_KEYS).agg(F.collect_set("experiment").alias("_done"))  # one name per experiment
    marked = rows.join(done, list(SCORE_KEYS), "left")
    lacks = F.array_except(every, F.coalesce("_done", F.array().cast("array<string>")))
    return marked.withColumn("_lacks", lacks).drop("_done").where(F.size("_lacks") > 0)


def _score_group(candidates, experiments, existing, load_encoder, batch_size, store) -> DataFrame:
    models = [
        {"head": None, "graph": False, "weights": False, "weight_dim": 100, "metric": "euclidean"}
        | {k: v for k, v in e.items() if k not in ("experiment", "load_encoder", "batch_size", "store")}
        for e in experiments
    ]
    for m in models:
        _check_head(m["head"], m["graph"], m["weights"])
    extra = ["biggraph_embedding"] * any(m["graph"] for m in models)
    extra += ["deepct_weights"] * any(m["weights"] for m in models)
    rows = with_passage_key(candidates).select(*SCORE_KEYS, "query_text", "abstract", *extra)
    names = [e["experiment"] for e in experiments]
    rows = _lacking(rows, names, existing)
    queries, passages = embed_sides(rows, load_encoder, batch_size, store)
    rows = rows.withColumn("_query_key", text_key("query_text")).drop("query_text", "abstract")
    rows = attach_embedding(rows, queries, "_query_key", "_query")
    rows = attach_embedding(rows, passages, "passage_key", "_passage")
    dims = sorted({m["weight_dim"] for m in models if m["weights"]})
    columns = [F.col("_query").alias("query"), F.col("_passage").alias("passage")]
    columns += [F.col(c).cast("array<double>").alias("graph") for c in extra if c == "biggraph_embedding"]
    columns += [finite(F.col("deepct_weights"), d).alias(f"weights_{d}") for d in dims]
    score = _score_batches(rows.sparkSession.sparkContext.broadcast(models))
    scored = rows.select(*SCORE_KEYS, "_lacks", score(F.struct(*columns)).alias("_scores"))
    named = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), "_scores")
    long = scored.select(*SCORE_KEYS, F.explode("_lacks").alias("experiment"), named.alias("_named"))
    return long.select("experiment", *SCORE_KEYS, F.col("_named")[F.col("experiment")].alias("score"))


def _score_batches(models):
    """One score per model for every row of a batch; a row without a vector that a model needs has none."""

    @F.pandas_udf("array<double>")
    def score(batch: pd.DataFrame) -> pd.Series:
        known = {c: batch[c].notna().to_numpy() for c in batch.columns}
        matrices = {c: np.stack(batch[c][known[c]].to_numpy()) for c in batch.columns if known[c].any()}
        scores = np.full((len(batch), len(models.value)), np.nan)
        has = np.zeros(scores.shape, bool)
        for i, m in enumerate(models.value):
            parts = ["passage"] + ["graph"] * m["graph"] + [f"weights_{m['weight_dim']}"] * m["weights"]
            rows = np.logical_and.reduce([known[c] for c in ("query", *parts)])
            if not rows.any():
                continue
            taken = {c: matrices[c][rows[known[c]]] for c in ("query", *parts)}
            x = np.hstack([taken[c] for c in parts])
            if m["head"] is not None:
                (w1, b1), (w2, b2) = m["head"]
                x = np.maximum(x @ w1.T + b1, 0.0) @ w2.T + b2
            scores[rows, i] = BATCH_DISTANCES[m["metric"]](taken["query"], x)
            has[:, i] = rows
        listed = scores.astype(object)
        listed[~has] = None
        return pd.Series(list(listed))

    return score


def experiment_name(encoder: str, graph: bool, weights: bool, version: str) -> str:
    """The score name with the model version, so that two versions are not taken for one."""
    return f"{score_name(encoder, graph, weights)}@{version}"
