"""Inputs of the checked queries, derived from the given tables.

The tables that a user would have on disk (index, run, candidates, triplets) are landed once per
session and folder.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.functions import text
from rankflow.operators import candidates as cand
from rankflow.operators import retrieval, triplets
from rankflow.session import land, spread

K = 100
SEED = 42
DIM = 64
RESOURCE = "http://dbpedia.org/resource/Doc_"
FOLDS = 5

_landed: dict[tuple[str, str, str], DataFrame] = {}


def once(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _landed:
        _landed[key] = land(build())
    return _landed[key]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"))


def pages(spark, sf) -> DataFrame:
    return table(spark, sf, "pages")


def corpus(spark, sf) -> DataFrame:
    """Documents as parsed quads: the abstract is still a quoted literal."""
    return documents(spark, sf).select(
        url(F.col("doc_id")).alias("url_dbpedia"),
        F.lit("http://www.w3.org/2000/01/rdf-schema#comment").alias("predicate"),
        F.concat(F.lit('"'), "text", F.lit('"@en ')).alias("abstract"),
        F.concat(F.lit("http://en.wikipedia.org/wiki/Doc_"), F.col("doc_id").cast("string")).alias(
            "url_wikipedia"
        ),
    )


def url(doc_id: Column) -> Column:
    return F.concat(F.lit(RESOURCE), doc_id.cast("string"))


def quad_lines(spark, sf) -> DataFrame:
    """One line per document; line breaks inside the text become blanks."""
    line = F.concat(
        F.lit("<"),
        "url_dbpedia",
        F.lit("> <"),
        "predicate",
        F.lit("> "),
        F.regexp_replace("abstract", r"[\r\n]", " "),
        F.lit("<"),
        "url_wikipedia",
        F.lit("> ."),
    )
    return corpus(spark, sf).select(line.alias("value"))


def queries(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_index"),
        F.concat(F.lit("Q_"), F.col("item_id").cast("string")).alias("query_id"),
        F.col("text").alias("query_text"),
    )


def index(spark, sf) -> DataFrame:
    build = lambda: retrieval.doc_vectors(documents(spark, sf), "doc_id", "text")
    return once(spark, sf, "index", build)


_prepared: dict[tuple[str, str], retrieval.Index] = {}


def search_index(spark, sf) -> retrieval.Index:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _prepared:
        _prepared[key] = retrieval.prepare(index(spark, sf))
    return _prepared[key]


def run(spark, sf) -> DataFrame:
    def build():
        # Without an index that is prepared already, only the terms of the queries are counted.
        prepared = _prepared.get((spark.sparkContext.applicationId, sf), index(spark, sf))
        hits = retrieval.bm25_search(prepared, queries(spark, sf), K)
        return hits.select("query_index", url(F.col("doc_id")).alias("url_dbpedia"), "hit", "score")

    return once(spark, sf, "run", build)


def doc_id_of(column: Column) -> Column:
    return F.substring_index(column, "Doc_", -1).cast("long")


def grades(spark, sf) -> DataFrame:
    """Pooled judgements: the labelled documents among the hits, graded 0, 1 or 2."""
    labels = table(spark, sf, "labels")
    pool = run(spark, sf).withColumn("doc_id", doc_id_of(F.col("url_dbpedia")))
    return pool.join(labels, "doc_id").select(
        F.concat(F.lit("Q_"), F.col("query_index").cast("string")).alias("query_id"),
        text.entity_key(F.col("url_dbpedia")).alias("dbpedia_entity"),
        (F.col("toxic") * (1 + F.col("quality"))).cast("int").alias("qrel"),
    )


def shown(vector: Column, change: Callable[[Column], Column] = lambda x: x) -> Column:
    """A vector as text, in millionths, so that its value compares exactly; ``change`` is applied to each number."""
    micro = F.transform(vector, lambda x: F.round(change(x) * 1_000_000).cast("long").cast("string"))
    return F.array_join(micro, ",")


def candidates(spark, sf) -> DataFrame:
    def build():
        built = cand.build_candidates(
            run(spark, sf), corpus(spark, sf), queries(spark, sf), grades(spark, sf)
        )
        return cand.clean_abstracts(built)

    return once(spark, sf, "candidates", build)


def title_map(spark, sf) -> DataFrame:
    doc_id = F.col("doc_id").cast("string")
    return table(spark, sf, "labels").select(
        F.concat(F.lit("Doc_"), doc_id).alias("title"),
        F.concat(F.lit("K"), doc_id).alias("wikidata_id"),
    )


def entity_names(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        text.wikidata_iri(F.concat(F.lit("K"), F.col("vec_id").cast("string"))).alias("entity"),
        F.col("vec_id").alias("entity_index"),
    )


def entity_vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        text.wikidata_iri(F.concat(F.lit("K"), F.col("vec_id").cast("string"))).alias("entity"),
        F.col("embedding").cast("array<double>").cast("array<string>").alias("biggraph_embedding"),
    )


def entity_table(spark, sf) -> DataFrame:
    """Id, index and vector of each distinct entity among the candidates."""

    def build():
        rows = candidates(spark, sf)
        return cand.entity_table(rows, title_map(spark, sf), entity_names(spark, sf), entity_vectors(spark, sf))

    return once(spark, sf, "entity_table", build)


def vector_candidates(spark, sf) -> DataFrame:
    """With graph vectors, and token weights that depend on the hit; one-letter tokens have none."""

    def build():
        rows = cand.fill_vectors(cand.attach_entities(candidates(spark, sf), entity_table(spark, sf)), DIM)
        weight = lambda t: F.when(F.length(t) == 1, F.lit(float("nan"))).otherwise(
            F.length(t).cast("double") / 10 + F.col("hit") / F.lit(1000.0)
        )
        return rows.withColumn("deepct_weights", F.transform(text.tokens(F.col("query_text")), weight))

    return once(spark, sf, "vector_candidates", build)


def built_triplets(spark, sf) -> DataFrame:
    build = lambda: triplets.build_triplets(vector_candidates(spark, sf), SEED)
    return once(spark, sf, "triplets", build)


def weight_lines(spark, sf) -> DataFrame:
    """Alternating token and weight over the whole text; a one-letter token has weight nan."""
    pairs = F.transform(
        text.tokens(F.col("text")),
        lambda t: F.array(
            t,
            F.when(F.length(t) == 1, F.lit("nan")).otherwise(
                (F.length(t).cast("double") / 10).cast("string")
            ),
        ),
    )
    return documents(spark, sf).select("doc_id", F.flatten(pairs).alias("items"))


def folds(spark, sf) -> DataFrame:
    """Every query is tested in one fold and trained on in the others."""
    fold = F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))
    rows = table(spark, sf, "benchmark").select("item_id", fold.alias("fold"))
    is_test = F.pmod("item_id", F.lit(FOLDS)) == F.col("fold")
    return rows.select(
        "fold",
        F.when(is_test, "test").otherwise("training").alias("split"),
        F.concat(F.lit("Q_"), F.col("item_id").cast("string")).alias("query_id"),
    )


def page_title(page_id: Column) -> Column:
    return F.concat(F.lit("Page "), page_id.cast("string"), F.lit("+x"))


def wiki_pages(spark, sf) -> DataFrame:
    return pages(spark, sf).select(
        F.col("page_id").cast("string").alias("id"),
        page_title(F.col("page_id")).alias("title"),
        F.col("html").alias("text"),
    )


def wiki_run(spark, sf) -> DataFrame:
    def build():
        html = spread(pages(spark, sf).select("page_id", "html"))
        built = retrieval.prepare(land(retrieval.doc_vectors(html, "page_id", "html")))
        return retrieval.bm25_search(built, queries(spark, sf), K)

    hits = once(spark, sf, "wiki_run", build)
    return hits.select("query_index", F.col("doc_id").cast("string").alias("id"), "hit", "score")


def article_grades(spark, sf) -> DataFrame:
    """Labelled pages among the hits, with percent-encoded titles as in a grade file."""
    labels = table(spark, sf, "labels").withColumn("id", F.col("doc_id").cast("string"))
    article = F.concat(F.lit("enwiki:Page%20"), "id", F.lit("+x"))
    return wiki_run(spark, sf).join(labels, "id").select(
        F.concat(F.lit("Q_"), F.col("query_index").cast("string")).alias("query_id"),
        text.article_title(article).alias("title"),
        (F.col("quality") + F.col("toxic")).cast("int").alias("qrel"),
    )


def label_articles(spark, sf) -> DataFrame:
    return table(spark, sf, "labels").select(
        page_title(F.col("doc_id")).alias("title"), F.col("quality").alias("qrel")
    )


def entity_lists(spark, sf) -> DataFrame:
    """Two page names per document, from its id and from its length; names repeat."""
    names = F.array(page_title(F.col("doc_id")), page_title(F.col("n_chars")))
    return table(spark, sf, "documents").select(names.alias("entities"))


LETTERS = "aeiourst"


def letter_encoder():
    """A tiny encoder with whole numbers: how often each of eight letters occurs in a text."""

    def encode(texts: np.ndarray) -> np.ndarray:
        return np.array([[str(t).count(c) for c in LETTERS] for t in texts], dtype=float)

    return encode


WEIGHT_DIM = 100


def wide_head() -> list[tuple[np.ndarray, np.ndarray]]:
    """From letters, graph vector and token weights back to letters."""
    width = len(LETTERS) + DIM + WEIGHT_DIM
    w1 = np.array([[((i * 3 + j * 5) % 13 - 6) / 20 for j in range(width)] for i in range(4)])
    w2 = np.array([[((i * 2 + j * 3) % 5 - 2) / 10 for j in range(4)] for i in range(len(LETTERS))])
    return [(w1, np.array([0.2, 0.0, -0.1, 0.3])), (w2, np.array([i / 4 for i in range(len(LETTERS))]))]


def test_head() -> list[tuple[np.ndarray, np.ndarray]]:
    """Weights from a rule, so that they can be written out in SQL."""
    w1 = np.array([[((i * 7 + j * 3) % 11 - 5) / 10 for j in range(DIM)] for i in range(4)])
    w2 = np.array([[((i * 5 + j * 2) % 7 - 3) / 10 for j in range(4)] for i in range(4)])
    return [(w1, np.array([0.1, -0.1, 0.2, 0.0])), (w2, np.array([0.0, 0.5, -0.5, 1.0]))]
