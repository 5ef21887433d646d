"""Readers with explicit schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankflow.functions import text, vectors
from rankflow.operators.numbering import number_lines, running_total

CORPUS = "url_dbpedia string, predicate string, abstract string, url_wikipedia string"
GRADES = "query_id string, unused string, dbpedia_entity string, qrel int"
TITLE_MAP = "title string, wikidata_id string"
WIKI_PAGES = "id string, title string, text string"
ENTITY_LISTS = "entities array<string>"
HEAD = "layer int, w array<array<double>>, b array<double>"
FOLD_MAP = "map<string, struct<training: array<string>, testing: array<string>>>"


def read_table(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_wiki_pages(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, WIKI_PAGES)


def read_title_map(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, TITLE_MAP)


def read_head(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, HEAD)


def read_quad_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a quad dump (bz2 is splittable) without comments and without invalid bytes."""
    lines = spark.read.text(path).select(text.valid_utf8(F.col("value")).alias("value"))
    return lines.where(~F.col("value").startswith("#"))


def parse_quads(lines: DataFrame) -> DataFrame:
    """The corpus: one row per quad; lines that are no quad are left to ``rejected_quads``."""
    line = F.col("value")
    return lines.where(text.is_quad(line)).select(*text.quad_fields(line))


def rejected_quads(lines: DataFrame) -> DataFrame:
    return lines.where(~text.is_quad(F.col("value")))


def _field(parts: Column, index: int) -> Column:
    return F.get(parts, F.lit(index))


def read_run(spark: SparkSession, path: str, id_name: str = "url_dbpedia") -> DataFrame:
    """Run file: six fields, of which the second and the last are not used."""
    parts = F.split("value", r"\s")
    return spark.read.text(path).where("value <> ''").select(
        _field(parts, 0).cast("long").alias("query_index"),
        _field(parts, 2).alias(id_name),
        _field(parts, 3).cast("int").alias("hit"),
        _field(parts, 4).cast("double").alias("score"),
    )


def read_grades(spark: SparkSession, path: str) -> DataFrame:
    reader = spark.read.schema(GRADES).option("sep", "\t").option("quote", "")
    return reader.option("mode", "FAILFAST").csv(path).drop("unused")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Query file; ``query_index`` is the 0-based number of the line, blank lines not counted."""
    lines = number_lines(spark.read.text(path).where("value <> ''"), "query_index")
    parts = F.split("value", "\t")
    return lines.select(
        "query_index",
        _field(parts, 0).alias("query_id"),
        _field(parts, 1).alias("query_text"),
    )


def read_topics(spark: SparkSession, path: str) -> DataFrame:
    schema = "query_index long, query_text string"
    return spark.read.schema(schema).option("sep", "\t").option("quote", "").csv(path)


def read_article_grades(spark: SparkSession, path: str) -> DataFrame:
    parts = F.split("value", r"\s")
    return spark.read.text(path).where("value <> ''").select(
        _field(parts, 0).alias("query_id"),
        text.article_title(_field(parts, 2)).alias("title"),
        _field(parts, 3).cast("int").alias("qrel"),
    )


def read_entity_names(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of strings, in one file or cut into several between names; its position is ``entity_index``.

    The array is read piece by piece, cut at every comma, so that it is never one value. A comma
    inside a name leaves pieces with an odd number of quotes; such pieces are put together again.
    """
    pieces = number_lines(spark.read.option("lineSep", ",").text(path), "_piece")
    bare = F.regexp_replace("value", r"\\.", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    pieces = pieces.withColumn("_odd", F.pmod(quotes, F.lit(2)))
    if (pieces.agg(F.sum("_odd")).first()[0] or 0) % 2:
        raise ValueError(f"a quote is left open in {path}")
    pieces = running_total(pieces, "_piece", "_odd", "_open")
    # Between two files, or at the end of one, a piece may hold nothing.
    holds = F.regexp_replace("value", r"[\s\[\]]", "") != ""
    pieces = pieces.withColumn("_starts", ((F.pmod("_open", F.lit(2)) == 0) & holds).cast("int"))
    pieces = running_total(pieces, "_piece", "_starts", "_before")
    index = F.col("_before") + F.col("_starts") - 1
    parts = F.sort_array(F.collect_list(F.struct("_piece", "value")))
    item = F.regexp_extract(
        F.array_join(F.transform(parts, lambda p: p["value"]), ","), r'(?s)(".*")', 1
    )
    names = pieces.groupBy(index.alias("entity_index")).agg(item.alias("_item"))
    entity = F.from_json(F.concat(F.lit("["), "_item", F.lit("]")), "array<string>")
    return names.where("_item <> ''").select(
        _field(entity, 0).alias("entity"), F.col("entity_index").cast("long")
    )


def read_entity_vectors(
    spark: SparkSession, path: str, dim: int = vectors.GRAPH_DIM
) -> DataFrame:
    """Entity, then ``dim`` fields, behind one header line. A line of another width is an error.

    ``rejected_entity_vectors`` returns such lines. One task has to read a gzip file, but lines are
    dealt out before they are split. Land the result once and read the landed table from then on.
    """
    parts = F.split("value", "\t")
    problem = F.concat(F.lit(f"not an entity and {dim} numbers: "), F.left("value", F.lit(200)))
    checked = F.when(F.size(parts) == dim + 1, parts).otherwise(F.raise_error(problem).cast("array<string>"))
    rows = _vector_lines(spark, path).select(checked.alias("parts"))
    return rows.select(
        _field(F.col("parts"), 0).alias("entity"), F.slice("parts", 2, dim).alias("biggraph_embedding")
    )


def rejected_entity_vectors(
    spark: SparkSession, path: str, dim: int = vectors.GRAPH_DIM
) -> DataFrame:
    """Lines of a vector file, but for its header, that don't hold ``dim`` numbers."""
    return _vector_lines(spark, path).where(F.size(F.split("value", "\t")) != dim + 1)


def _vector_lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines but the header, which is the first line of the first file."""
    lines = spark.read.text(path)
    # Spark may begin with another file of a folder than the first one.
    firsts = (spark.read.text(p).first() for p in sorted(lines.inputFiles()))
    header = next((row for row in firsts if row is not None), None)
    if header is None:
        return lines
    lines = lines.where(F.col("value") != F.lit(header["value"]))
    return lines.repartition(spark.sparkContext.defaultParallelism, "value") if path.endswith(".gz") else lines


def read_token_weights(spark: SparkSession, path: str) -> DataFrame:
    """Alternating token and weight; line N, blank or not, belongs to candidate N."""
    lines = number_lines(spark.read.text(path), "ordinal")
    parts = F.when(F.col("value") != "", F.split("value", r"\s"))
    return lines.select(
        "ordinal",
        vectors.even_items(parts).alias("deepct_tokens"),
        vectors.to_weights(vectors.odd_items(parts)).alias("deepct_weights"),
    )


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    """``{fold: {training: [], testing: []}}`` as one row per fold, split and query id."""
    document = spark.read.text(path, wholetext=True)
    folds = document.select(F.explode(F.from_json("value", FOLD_MAP)).alias("fold", "lists"))
    splits = folds.select(
        F.col("fold").cast("int").alias("fold"),
        F.explode(
            F.create_map(
                F.lit("training"), F.col("lists.training"), F.lit("test"), F.col("lists.testing")
            )
        ).alias("split", "query_ids"),
    )
    return splits.select("fold", "split", F.explode("query_ids").alias("query_id"))


def read_entity_lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTITY_LISTS).option("mode", "FAILFAST").json(path)
