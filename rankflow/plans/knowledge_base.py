"""From a knowledge-base dump to candidate folds, triplets and scores.

Each stage is a table under ``out`` that is computed when it is missing or was made from other files, other
parameters or other earlier stages. So a run that was stopped goes on after its last finished stage, and a
changed file renews what depends on it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow import sources
from rankflow.operators import candidates as cand
from rankflow.operators import retrieval, triplets
from rankflow.operators.folds import split_folds
from rankflow.operators.scoring import SCORE_KEYS, SCORES, attach_scores, load_head, score_experiments
from rankflow.operators.vector_store import VectorStore
from rankflow.plans.inputs import KnowledgeBaseInputs
from rankflow.session import land
from rankflow.sinks import materialise, stage_rejects
from rankflow.sinks.fold_store import FoldStore, write_fold_store
from rankflow.sinks.lineage import described, frame_fingerprint
from rankflow.sinks.snapshots import VERSION, SnapshotTable

# Hits per query.
K = 1000


def _stage(
    spark, inputs, out: str, name: str, build, reads=(), after=(), write=None, read=None, **parameters
) -> DataFrame:
    """One stage, known by the inputs it reads, the stages it comes after, and its parameters."""
    return materialise(
        spark,
        f"{out}/{name}",
        build,
        parameters=parameters,
        write=write,
        read=read,
        reads=[getattr(inputs, r) for r in reads],
        after=[f"{out}/{a}" for a in after],
    )


def corpus(spark: SparkSession, inputs: KnowledgeBaseInputs, out: str) -> DataFrame:
    def build():
        return sources.parse_quads(sources.read_quad_lines(spark, inputs.quads))

    return _stage(spark, inputs, out, "corpus", build, reads=["quads"])


def rejects(spark: SparkSession, inputs: KnowledgeBaseInputs, out: str) -> DataFrame:
    """Lines of the dump that are no quad and that the corpus goes without."""

    def build():
        return sources.rejected_quads(sources.read_quad_lines(spark, inputs.quads))

    return _stage(spark, inputs, out, "rejects", build, reads=["quads"])


def index(spark: SparkSession, inputs: KnowledgeBaseInputs, out: str) -> retrieval.Index:
    """Document vectors and document frequencies, counted once for all searches."""
    texts = corpus(spark, inputs, out)

    def build():
        return retrieval.unique_documents(land(retrieval.doc_vectors(texts, "url_dbpedia", "abstract")))

    documents = _stage(spark, inputs, out, "index", build, after=["corpus"])
    frequencies = _stage(
        spark, inputs, out, "index_frequencies", lambda: retrieval.document_frequency(documents), after=["index"]
    )
    return retrieval.with_counts(documents, frequencies)


def queries(spark: SparkSession, inputs: KnowledgeBaseInputs, out: str) -> DataFrame:
    def build():
        return sources.checked_queries(spark, inputs.queries)

    return _stage(spark, inputs, out, "queries", build, reads=["queries"])


def grades(spark: SparkSession, inputs: KnowledgeBaseInputs, out: str) -> DataFrame:
    return _stage(spark, inputs, out, "grades", lambda: sources.checked_grades(spark, inputs.grades), reads=["grades"])


#: Stages whose sources are read line by line; their rejects lie beside them.
CHECKED_STAGES = ("queries", "grades", "run", "token_weights", "folds")


def source_rejects(spark: SparkSession, out: str) -> DataFrame:
    """(stage, file, line, reason, value) of all lines that the stages made so far go without."""
    parts = [stage_rejects(spark, f"{out}/{s}").withColumn("stage", F.lit(s)) for s in CHECKED_STAGES]
    return reduce(DataFrame.unionByName, parts).select("stage", "file", "line", "reason", "value")


def run(spark: SparkSession, inputs: KnowledgeBaseInputs, out: str, k: int = K) -> DataFrame:
    if inputs.run:
        return _stage(spark, inputs, out, "run", lambda: sources.checked_run(spark, inputs.run), reads=["run"])
    documents = index(spark, inputs, out)
    asked = queries(spark, inputs, out).select("query_index", "query_text")

    def build():
        return retrieval.bm25_search(documents, asked, k).withColumnRenamed("doc_id", "url_dbpedia")

    return _stage(spark, inputs, out, "run", build, after=["index", "index_frequencies", "queries"], k=k)


def candidates(spark: SparkSession, inputs: KnowledgeBaseInputs, out: str, k: int = K) -> DataFrame:
    """Hits with text, query and grade."""
    hits, texts = run(spark, inputs, out, k), corpus(spark, inputs, out)
    asked, judged = queries(spark, inputs, out), grades(spark, inputs, out)

    def build():
        return cand.build_candidates(hits, texts, asked, judged)

    return _stage(spark, inputs, out, "candidates", build, after=["run", "corpus", "queries", "grades"])


def skipped_queries(spark: SparkSession, inputs: KnowledgeBaseInputs, out: str, k: int = K) -> DataFrame:
    """Judged queries that give no triplets, and why."""
    rows = candidates(spark, inputs, out, k)

    def build():
        return triplets.skipped_queries(triplets.judged_counts(rows))

    return _stage(spark, inputs, out, "skipped_queries", build, after=["candidates"])


def entities(spark: SparkSession, inputs: KnowledgeBaseInputs, out: str, k: int = K) -> DataFrame:
    """Id, index and vector of the distinct entities among the candidates."""
    rows = candidates(spark, inputs, out, k)
    names = _stage(
        spark, inputs, out, "entity_names", lambda: sources.read_entity_names(spark, inputs.entity_names),
        reads=["entity_names"],
    )
    vectors = _stage(
        spark, inputs, out, "entity_vectors",
        lambda: sources.read_entity_vectors(spark, inputs.entity_vectors, inputs.vector_dim),
        reads=["entity_vectors"], dim=inputs.vector_dim,
    )

    def build():
        return cand.entity_table(rows, sources.read_title_map(spark, inputs.title_map), names, vectors)

    return _stage(
        spark, inputs, out, "entities", build,
        reads=["title_map"], after=["candidates", "entity_names", "entity_vectors"],
    )


def vector_candidates(
    spark: SparkSession, inputs: KnowledgeBaseInputs, out: str, k: int = K
) -> DataFrame:
    """Candidates with knowledge-base id, entity index and vector (null where there is none).

    ``ordinal`` numbers these merged rows in the order (query, hit): a title or name that stands twice
    in its file repeats a candidate, and each repeat has a line of its own among the weights.
    """
    known = entities(spark, inputs, out, k)
    rows = candidates(spark, inputs, out, k)

    def build():
        return cand.number_candidates(cand.attach_entities(rows, known))

    return _stage(spark, inputs, out, "candidates_vec", build, after=["candidates", "entities"])


def complete_candidates(
    spark: SparkSession, inputs: KnowledgeBaseInputs, out: str, k: int = K
) -> DataFrame:
    """Filled vectors, token weights by ordinal and clean texts."""
    rows = vector_candidates(spark, inputs, out, k)
    weights = _stage(
        spark, inputs, out, "token_weights", lambda: sources.checked_token_weights(spark, inputs.token_weights),
        reads=["token_weights"],
    )

    def build():
        filled = cand.fill_vectors(rows, inputs.vector_dim)
        return cand.clean_abstracts(cand.attach_token_weights(filled, weights))

    return _stage(
        spark, inputs, out, "candidates_complete", build,
        after=["candidates_vec", "token_weights"], dim=inputs.vector_dim,
    )


def _folds_of(spark, inputs, out: str, name: str, rows: DataFrame, after: str) -> FoldStore:
    """The folds of a stage: a store that holds each row once."""

    members = _stage(
        spark, inputs, out, "folds", lambda: sources.checked_folds(spark, inputs.folds), reads=["folds"]
    )

    def write(payload: DataFrame, path: str) -> None:
        write_fold_store(payload, members, path)

    _stage(
        spark, inputs, out, name, lambda: rows, after=["folds", after], write=write,
        read=lambda spark, path: FoldStore(spark, path).payload,
    )
    return FoldStore(spark, f"{out}/{name}")


def candidate_store(
    spark: SparkSession, inputs: KnowledgeBaseInputs, out: str, k: int = K
) -> FoldStore:
    """The complete candidates by folds; ``part`` reads one side of one fold."""
    rows = complete_candidates(spark, inputs, out, k)
    return _folds_of(spark, inputs, out, "fold_candidates", rows, "candidates_complete")


def fold_candidates(
    spark: SparkSession, inputs: KnowledgeBaseInputs, out: str, k: int = K
) -> DataFrame:
    """Every complete candidate once per fold."""
    return candidate_store(spark, inputs, out, k).all()


def all_triplets(
    spark: SparkSession, inputs: KnowledgeBaseInputs, out: str, seed: int = 42, k: int = K
) -> DataFrame:
    """Triplets of every query."""
    rows = complete_candidates(spark, inputs, out, k)

    def build():
        return triplets.build_triplets(rows, seed)

    return _stage(spark, inputs, out, "triplets", build, after=["candidates_complete"], seed=seed)


def triplet_store(
    spark: SparkSession, inputs: KnowledgeBaseInputs, out: str, seed: int = 42, k: int = K
) -> FoldStore:
    """The triplets by folds; ``part`` reads one side of one fold."""
    built = all_triplets(spark, inputs, out, seed, k)
    return _folds_of(spark, inputs, out, "fold_triplets", built, "triplets")


def fold_triplets(
    spark: SparkSession, inputs: KnowledgeBaseInputs, out: str, seed: int = 42, k: int = K
) -> DataFrame:
    """Triplets of every query once per fold: a query has the same triplets in all folds."""
    return triplet_store(spark, inputs, out, seed, k).all()


def scores(
    spark: SparkSession,
    inputs: KnowledgeBaseInputs,
    out: str,
    experiments: Sequence[dict],
    path: str,
    existing: DataFrame | None = None,
    k: int = K,
) -> DataFrame:
    """Scores of all candidates for all experiments, at a path of its own.

    An experiment that uses graph or weight vectors and brings no head takes the one of the inputs. The table is
    made anew when anything that decides a score is another: metric, flags, widths, the numbers of a head, the
    name of an encoder, or the files of ``existing``.

    The folds are not scored one by one: a query is tested in one fold, so a join of this table
    with the folds gives the scores of every fold.
    """
    rows = complete_candidates(spark, inputs, out, k)
    given = _with_heads(spark, inputs, experiments)
    return materialise(
        spark,
        path,
        lambda: score_experiments(rows, given, existing),
        parameters={"experiments": [described(e) for e in given], "existing": frame_fingerprint(existing)},
        after=[f"{out}/candidates_complete"],
    )


def append_scores(
    spark: SparkSession,
    inputs: KnowledgeBaseInputs,
    out: str,
    experiments: Sequence[dict],
    k: int = K,
) -> tuple[DataFrame, int]:
    """All scores of the score store under ``out``, and the version they were read at.

    Candidates that an experiment has not scored yet are scored now and appended; a row counts with its
    newest score. Vectors are kept as well, for experiments that name their encoder in ``encoder``.
    """
    rows = complete_candidates(spark, inputs, out, k)
    table = SnapshotTable(spark, f"{out}/score_store", SCORES)
    base = table.version()
    known = land(table.newest(["experiment", *SCORE_KEYS], base).drop(VERSION))
    given = []
    for e in _with_heads(spark, inputs, experiments):
        name = e.pop("encoder", None)
        given.append(e | {"store": VectorStore(spark, f"{out}/vector_store", name)} if name else e)
    missing = land(score_experiments(rows, given, known))
    if not missing.isEmpty():
        base = table.append(missing, {"experiments": [e["experiment"] for e in given]})
    return table.newest(["experiment", *SCORE_KEYS], base).drop(VERSION), base


def _with_heads(spark, inputs, experiments: Sequence[dict]) -> list[dict]:
    """Experiments with the weight width of the inputs, and their head where vectors need one."""
    head = load_head(sources.read_head(spark, inputs.head)) if inputs.head else None
    given = [{"weight_dim": inputs.weight_dim} | e for e in experiments]
    return [{"head": head} | e if e.get("graph") or e.get("weights") else e for e in given]


def wide_scores(
    spark: SparkSession, inputs: KnowledgeBaseInputs, out: str, scored: DataFrame, experiment: str, name: str, k: int = K
) -> DataFrame:
    """The complete candidates with one experiment's score as a column."""
    return attach_scores(complete_candidates(spark, inputs, out, k), scored, experiment, name)


def fold_scores(
    spark: SparkSession, inputs: KnowledgeBaseInputs, scored: DataFrame, split: str = "test"
) -> DataFrame:
    """The scores of one side of every fold."""
    members = sources.read_folds(spark, inputs.folds).where(F.col("split") == split)
    return split_folds(scored, members)
