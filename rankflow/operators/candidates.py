"""Candidates: a run joined with texts, queries, grades, knowledge-base vectors and weights.

The large tables (corpus, pages, names, vectors) are first cut to the keys that occur. The joins
themselves carry no broadcast hints: the small inputs are files or landed tables, whose size
Catalyst knows, so it broadcasts them below ``spark.sql.autoBroadcastJoinThreshold`` and shuffles
beyond it, where AQE splits a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.functions import text, vectors
from rankflow.operators.numbering import dense_ordinal
from rankflow.operators.reduction import BROADCAST_BYTES, keep_keys
from rankflow.session import land

CANDIDATE_COLUMNS = (
    "query_index",
    "url_dbpedia",
    "hit",
    "score",
    "predicate",
    "abstract",
    "url_wikipedia",
    "dbpedia_entity",
    "query_id",
    "query_text",
    "qrel",
)


def attach_corpus(
    run: DataFrame, corpus: DataFrame, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Only the texts of hits are shuffled, if any; the corpus is scanned once."""
    return run.join(keep_keys(corpus, run, "url_dbpedia", broadcast_bytes), "url_dbpedia")


def judged_queries(queries: DataFrame, grades: DataFrame) -> DataFrame:
    """Queries that have at least one grade."""
    kept = queries.join(grades, "query_id", "left_semi")
    return kept.select("query_index", "query_id", "query_text").dropDuplicates()


def query_grades(queries: DataFrame, grades: DataFrame) -> DataFrame:
    """Every grade with its query; a grade of an unknown query is dropped."""
    return queries.join(grades, "query_id").select("query_index", "dbpedia_entity", "qrel")


def attach_queries(run: DataFrame, queries: DataFrame) -> DataFrame:
    return run.join(queries, "query_index")


def attach_grades(candidates: DataFrame, graded: DataFrame) -> DataFrame:
    """A candidate without a grade keeps null: unjudged is not the same as grade 0."""
    return candidates.join(graded, ["query_index", "dbpedia_entity"], "left")


def build_candidates(
    run: DataFrame, corpus: DataFrame, queries: DataFrame, grades: DataFrame
) -> DataFrame:
    """The candidate table; sort it only where an ordered output is wanted."""
    candidates = attach_corpus(run, corpus).withColumn(
        "dbpedia_entity", text.entity_key(F.col("url_dbpedia"))
    )
    candidates = attach_queries(candidates, judged_queries(queries, grades))
    candidates = attach_grades(candidates, query_grades(queries, grades))
    return candidates.select(*CANDIDATE_COLUMNS)


def sort_candidates(candidates: DataFrame) -> DataFrame:
    return candidates.orderBy("query_index", "hit")


def number_candidates(candidates: DataFrame) -> DataFrame:
    """``ordinal`` 0..n-1 in the order (query_index, hit, url), then by the whole row.

    Only these keys are sorted; the number is joined back to the landed rows.
    """
    rows = land(candidates.withColumn("_row", F.monotonically_increasing_id()))
    tie = F.xxhash64(*candidates.columns).alias("_tie")
    keys = rows.select("query_index", "hit", "url_dbpedia", tie, "_row")
    numbered = dense_ordinal(keys, ["query_index", "hit", "url_dbpedia", "_tie", "_row"])
    return rows.join(numbered.select("_row", "ordinal"), "_row").drop("_row")


def attach_wikidata(candidates: DataFrame, title_map: DataFrame) -> DataFrame:
    """Knowledge-base id of the entity's title, and its IRI; null where the title is unknown."""
    ids = title_map.select(
        F.col("title").alias("_title"), F.col("wikidata_id").alias("title_to_id_wikidata")
    )
    titled = candidates.withColumn("_title", text.entity_title(F.col("dbpedia_entity")))
    ids = keep_keys(ids, titled, "_title")
    return (
        titled.join(ids, "_title", "left")
        .drop("_title")
        .withColumn("entity", text.wikidata_iri(F.col("title_to_id_wikidata")))
    )


def attach_entity_index(candidates: DataFrame, names: DataFrame) -> DataFrame:
    return candidates.join(keep_keys(names, candidates, "entity"), "entity", "left")


def needed_vectors(candidates: DataFrame, entity_vectors: DataFrame) -> DataFrame:
    """Vectors of the entities that occur among the candidates."""
    return keep_keys(entity_vectors, candidates, "entity")


def attach_vectors(candidates: DataFrame, entity_vectors: DataFrame) -> DataFrame:
    return candidates.join(needed_vectors(candidates, entity_vectors), "entity", "left")


def entity_table(
    candidates: DataFrame, title_map: DataFrame, names: DataFrame, entity_vectors: DataFrame
) -> DataFrame:
    """Id, index and vector of each distinct entity, so that a frequent one is looked up once."""
    entities = land(candidates.select("dbpedia_entity").distinct())
    titled = land(attach_wikidata(entities, title_map))
    return attach_vectors(attach_entity_index(titled, names), entity_vectors)


def attach_entities(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    return candidates.join(entities, "dbpedia_entity", "left")


def fill_vectors(candidates: DataFrame, dim: int = vectors.GRAPH_DIM) -> DataFrame:
    filled = vectors.to_doubles(vectors.zero_fill(F.col("biggraph_embedding"), dim))
    return candidates.withColumn("biggraph_embedding", filled)


def attach_token_weights(
    candidates: DataFrame, weights: DataFrame, check: bool = True
) -> DataFrame:
    """Join on the explicit ordinal, which must run from 0 without gaps or repeats on both sides.

    Number the candidates after all joins that can repeat a row: weights belong to the merged rows.
    """
    if check:
        n_candidates, n_weights = dense_size(candidates, "candidates"), dense_size(weights, "weight lines")
        if n_candidates != n_weights:
            raise ValueError(f"{n_candidates} candidates but {n_weights} weight lines")
    return candidates.join(weights, "ordinal", "left")


def dense_size(rows: DataFrame, what: str) -> int:
    """The number of rows, if their ordinals are 0..n-1."""
    seen = rows.agg(
        F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("least"), F.max("ordinal").alias("most"),
        F.countDistinct("ordinal").alias("different"),
    ).first()
    n = seen["n"]
    if n and (seen["least"], seen["most"], seen["different"]) != (0, n - 1, n):
        raise ValueError(f"the ordinals of {n} {what} are not 0 to {n - 1}")
    return n


def clean_abstracts(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("abstract", text.clean_literal(F.col("abstract")))


def build_wiki_candidates(
    run: DataFrame, queries: DataFrame, pages: DataFrame, article_grades: DataFrame
) -> DataFrame:
    """The encyclopedia variant: pages by numeric id, grades by (query, title)."""
    named = queries.withColumnRenamed("query_text", "query_string")
    by_id = pages.withColumn("id", F.col("id").cast("long"))
    hits = run.withColumn("id", F.col("id").cast("long"))
    found = attach_queries(hits, named).join(keep_keys(by_id, hits, "id"), "id")
    return found.join(article_grades, ["query_id", "title"], "left")
