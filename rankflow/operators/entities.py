"""Entity pages and unmatched grades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.operators.reduction import keep_keys


def distinct_entities(entity_lists: DataFrame) -> DataFrame:
    return entity_lists.select(F.explode("entities").alias("entity")).distinct()


def entity_pages(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """Page text per entity, null when there is no page."""
    documents = pages.select(F.col("title").alias("entity"), F.col("text").alias("document"))
    documents = keep_keys(documents, entities, "entity")
    return entities.join(documents, "entity", "left").select("entity", "document")


def unmatched_grades(grades: DataFrame, pages: DataFrame) -> DataFrame:
    return grades.join(pages.select("title"), "title", "left_anti")


def unmatched_ratio(grades: DataFrame, pages: DataFrame) -> DataFrame:
    """Share of grades whose title has no page, in one pass over the grades."""
    known = pages.select("title").distinct().withColumn("_known", F.lit(True))
    missing = F.count_if(F.col("_known").isNull())
    return grades.join(known, "title", "left").agg(
        missing.alias("n_unmatched"),
        F.count(F.lit(1)).alias("n_grades"),
        (missing / F.count(F.lit(1))).alias("ratio"),
    )
