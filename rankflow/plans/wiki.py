"""The encyclopedia variant: pages, article grades, entity pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow import sources
from rankflow.operators import candidates as cand
from rankflow.operators import entities, retrieval
from rankflow.plans.inputs import WikiInputs
from rankflow.session import land
from rankflow.sinks import materialise, write_entity_pages, write_search_documents, write_topics


def _stage(spark, inputs, out: str, name: str, build, reads=(), after=(), **parameters) -> DataFrame:
    return materialise(
        spark,
        f"{out}/{name}",
        build,
        parameters=parameters,
        reads=[getattr(inputs, r) for r in reads],
        after=[f"{out}/{a}" for a in after],
    )


def index(spark: SparkSession, inputs: WikiInputs, out: str) -> retrieval.Index:
    def build():
        vectors = retrieval.doc_vectors(sources.read_wiki_pages(spark, inputs.pages), "id", "text")
        return retrieval.unique_documents(land(vectors))

    documents = _stage(spark, inputs, out, "index", build, reads=["pages"])
    frequencies = _stage(
        spark, inputs, out, "index_frequencies", lambda: retrieval.document_frequency(documents), after=["index"]
    )
    return retrieval.with_counts(documents, frequencies)


def run(spark: SparkSession, inputs: WikiInputs, out: str, k: int = 1000) -> DataFrame:
    if inputs.run:
        return _stage(spark, inputs, out, "run", lambda: sources.read_run(spark, inputs.run, "id"), reads=["run"])
    documents = index(spark, inputs, out)

    def build():
        queries = sources.read_queries(spark, inputs.queries).select("query_index", "query_text")
        return retrieval.bm25_search(documents, queries, k).withColumnRenamed("doc_id", "id")

    return _stage(spark, inputs, out, "run", build, reads=["queries"], after=["index", "index_frequencies"], k=k)


def candidates(spark: SparkSession, inputs: WikiInputs, out: str, k: int = 1000) -> DataFrame:
    hits = run(spark, inputs, out, k)

    def build():
        return cand.build_wiki_candidates(
            hits,
            sources.read_queries(spark, inputs.queries),
            sources.read_wiki_pages(spark, inputs.pages),
            sources.read_article_grades(spark, inputs.article_grades),
        )

    return _stage(
        spark, inputs, out, "candidates", build, reads=["queries", "pages", "article_grades"], after=["run"]
    )


def write_search_inputs(spark: SparkSession, inputs: WikiInputs, out: str) -> None:
    """Search documents and topics, for a search engine outside Spark."""
    pages = sources.read_wiki_pages(spark, inputs.pages)
    write_search_documents(pages, f"{out}/search_documents", "id", "text")
    write_topics(sources.read_queries(spark, inputs.queries), f"{out}/topics")


def write_pages_of_entities(spark: SparkSession, lists: str, pages: str, path: str) -> None:
    """CSV of the distinct entities in ``lists`` and their page texts."""
    named = entities.distinct_entities(sources.read_entity_lists(spark, lists))
    named = named.where(F.col("entity").isNotNull())
    write_entity_pages(entities.entity_pages(named, sources.read_wiki_pages(spark, pages)), path)
