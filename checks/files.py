"""Every source and sink: a file derived from the given tables, written by Spark and read back."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixtures as fx
from rankflow import sinks, sources
from rankflow.functions import text, vectors
from rankflow.operators import candidates as cand
from rankflow.operators import entities, folds, scoring
from rankflow.operators.vector_store import VectorStore
from rankflow.session import shared_folder
from rankflow.sinks.fold_store import FoldStore, write_fold_store
from rankflow.sinks.snapshots import SnapshotTable


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}/{name}"


def write_lines(lines: DataFrame, path: str, **options) -> str:
    lines.write.options(**options).text(path)
    return path


def quad_dump(spark, sf) -> str:
    """Quads with a bad byte in every text, broken lines and comments, as bzip2."""
    bad = F.unhex(F.lit("FF")).cast("string")
    quads = fx.quad_lines(spark, sf).select(F.concat_ws("", F.substring_index("value", '"', 1), F.lit('"'), bad, F.expr("substring(value, length(substring_index(value, '\"', 1)) + 2)")).alias("value"))
    ids = fx.table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("id"))
    broken = ids.select(F.concat(F.lit("<broken "), "id").alias("value"))
    comments = ids.select(F.concat(F.lit("# line "), "id").alias("value"))
    return write_lines(quads.union(broken).union(comments), place(spark, "quads"), compression="bzip2")


def quad_file(spark, sf):
    parsed = sources.parse_quads(sources.read_quad_lines(spark, quad_dump(spark, sf)))
    return parsed.withColumn("abstract", F.md5("abstract"))


def quad_rejects(spark, sf):
    return sources.rejected_quads(sources.read_quad_lines(spark, quad_dump(spark, sf)))


def run_file(spark, sf):
    path = place(spark, "run")
    sinks.write_run(fx.run(spark, sf), path)
    return sources.read_run(spark, path)


def _with_broken(spark, sf, lines: DataFrame, name: str, before: str = "broken ") -> str:
    """The lines and as many broken ones as there are labels."""
    ids = fx.table(spark, sf, "labels").select(F.concat(F.lit(before), F.col("doc_id").cast("string")).alias("value"))
    return write_lines(lines.select("value").unionByName(ids), place(spark, name))


def _run_lines(spark, sf) -> DataFrame:
    columns = ["query_index", F.lit("Q0"), "url_dbpedia", "hit", F.format_string("%.6f", F.col("score")), F.lit("t")]
    return fx.run(spark, sf).select(F.concat_ws(" ", *columns).alias("value"))


def checked_run_file(spark, sf):
    """The good rows of a run file with broken lines."""
    return sources.checked_run(spark, _with_broken(spark, sf, _run_lines(spark, sf), "run")).rows


def checked_rejects(spark, sf):
    """The broken lines of all formats that are read line by line."""
    blank = spark.range(1).select(F.lit("").alias("value"))
    lists = fx.entity_lists(spark, sf).select(F.to_json(F.struct("entities")).alias("value"))
    files = {
        "run": _with_broken(spark, sf, _run_lines(spark, sf), "run"),
        "token_weights": _with_broken(spark, sf, blank, "weights", "broken 0.5 "),
        "entity_lists": _with_broken(spark, sf, lists, "lists", '{"entities": ['),
    }
    for name in ("grades", "queries", "article_grades"):
        files[name] = _with_broken(spark, sf, blank, name)
    found = [
        getattr(sources, f"checked_{name}")(spark, path).rejects.select(F.lit(name).alias("source"), "reason", "value")
        for name, path in files.items()
    ]
    return reduce(DataFrame.unionByName, found)


def grades_file(spark, sf):
    line = F.concat_ws("\t", "query_id", F.lit("Q0"), "dbpedia_entity", F.col("qrel").cast("string"))
    path = write_lines(fx.grades(spark, sf).select(line.alias("value")), place(spark, "grades"))
    return sources.read_grades(spark, path)


def _flat_queries(spark, sf) -> DataFrame:
    return fx.queries(spark, sf).withColumn("query_text", F.regexp_replace("query_text", r"[\r\n\t]", " "))


def queries_file(spark, sf):
    line = F.concat_ws("\t", "query_id", "query_text")
    lines = _flat_queries(spark, sf).orderBy("query_index").select(line.alias("value"))
    return sources.read_queries(spark, write_lines(lines, place(spark, "queries")))


def topics_file(spark, sf):
    path = place(spark, "topics")
    sinks.write_topics(_flat_queries(spark, sf), path)
    return sources.read_topics(spark, path)


def article_grades_file(spark, sf):
    line = F.concat(F.lit("Q 0 enwiki:Page%20"), F.col("doc_id").cast("string"), F.lit("+%C3%A9%x "), F.col("quality").cast("string"))
    lines = fx.table(spark, sf, "labels").select(line.alias("value"))
    return sources.read_article_grades(spark, write_lines(lines, place(spark, "qrels")))


def names_file(spark, sf):
    """A name has a comma, a quote and a backslash in it; the array is cut into gzipped parts."""
    names = fx.table(spark, sf, "embeddings").select(
        F.col("vec_id"), F.concat(F.lit('a, "b\\" '), F.col("vec_id").cast("string")).alias("name")
    )
    first = names.agg(F.min("vec_id")).first()[0]
    before = F.when(F.col("vec_id") == first, "[").otherwise(",")
    quoted = F.expr("substring(to_json(array(name)), 2, length(to_json(array(name))) - 2)")
    lines = names.select("vec_id", F.concat(before, quoted).alias("value"))
    end = spark.range(1).select(F.lit(None).cast("long").alias("vec_id"), F.lit("]").alias("value"))
    lines = lines.union(end).orderBy(F.asc_nulls_last("vec_id")).select("value")
    return sources.read_entity_names(spark, write_lines(lines, place(spark, "names"), compression="gzip"))


def vectors_file(spark, sf):
    """One header line in the first part, then the entity and its numbers; the fields become an array."""
    rows = fx.entity_vectors(spark, sf).select(
        F.lit(1).alias("order"), F.concat_ws("\t", "entity", F.array_join("biggraph_embedding", "\t")).alias("value")
    )
    header = spark.range(1).select(F.lit(0).alias("order"), F.lit(f"1\t{fx.DIM}").alias("value"))
    lines = rows.union(header).orderBy("order", "value").select("value")
    path = write_lines(lines, place(spark, "vectors"), compression="gzip")
    read = sources.read_entity_vectors(spark, path, fx.DIM)
    return read.select("entity", fx.shown(vectors.to_doubles(F.col("biggraph_embedding"))).alias("vector"))


def weights_file(spark, sf):
    """Line N belongs to query N; the last line may be blank."""
    tokens = text.tokens(F.col("query_text"))
    pairs = F.transform(tokens, lambda t: F.concat_ws(" ", t, (F.length(t).cast("double") / 10).cast("string")))
    lines = fx.queries(spark, sf).orderBy("query_index").select(F.array_join(pairs, " ").alias("value"))
    read = sources.read_token_weights(spark, write_lines(lines, place(spark, "weights")))
    return read.select(
        "ordinal", F.array_join("deepct_tokens", " ").alias("tokens"), fx.shown(F.col("deepct_weights")).alias("weights")
    )


def folds_file(spark, sf):
    def members(split):
        return F.collect_list(F.when(F.col("split") == split, F.col("query_id")))

    lists = fx.folds(spark, sf).groupBy("fold").agg(
        F.struct(members("training").alias("training"), members("test").alias("testing")).alias("lists")
    )
    entries = F.collect_list(F.struct(F.col("fold").cast("string"), "lists"))
    document = lists.agg(F.to_json(F.map_from_entries(entries)).alias("value"))
    return sources.read_folds(spark, write_lines(document, place(spark, "folds")))


def entity_lists_file(spark, sf):
    path = place(spark, "lists")
    fx.entity_lists(spark, sf).write.json(path)
    return sources.read_entity_lists(spark, path).select(F.array_join("entities", "|").alias("entities"))


def pages_csv(spark, sf):
    path = place(spark, "pages")
    named = entities.distinct_entities(fx.entity_lists(spark, sf))
    sinks.write_entity_pages(entities.entity_pages(named, fx.wiki_pages(spark, sf)), path)
    reader = spark.read.schema("row long, entity string, document string")
    read = reader.options(header=True, multiLine=True, escape='"').csv(path)
    return read.withColumn("document", F.md5("document"))


def search_docs_file(spark, sf):
    path = place(spark, "docs")
    sinks.write_search_documents(fx.wiki_pages(spark, sf), path, "id", "text")
    read = spark.read.schema("id string, contents string").json(path)
    return read.withColumn("contents", F.md5("contents"))


def fold_tables(spark, sf):
    path = place(spark, "fold_tables")
    keys = fx.candidates(spark, sf).select("query_id", "dbpedia_entity", "hit", "qrel")
    sinks.write_folds(folds.split_folds(keys, fx.folds(spark, sf)), path)
    return spark.read.schema("query_id string, dbpedia_entity string, hit int, qrel int, fold int, split string").parquet(path)


def _fold_store(spark, sf) -> FoldStore:
    path = place(spark, "fold_store")
    keys = fx.candidates(spark, sf).select("query_id", "dbpedia_entity", "hit", "qrel", "abstract")
    write_fold_store(keys, fx.folds(spark, sf), path)
    return FoldStore(spark, path)


def fold_store(spark, sf):
    """Each row is written once and read once per fold."""
    return _fold_store(spark, sf).all().withColumn("abstract", F.md5("abstract"))


def fold_store_part(spark, sf):
    """The test side of one fold and the training side of another, from their folders."""
    store = _fold_store(spark, sf)
    sides = [store.part(f, s).withColumns({"fold": F.lit(f), "split": F.lit(s)}) for f, s in ((1, "test"), (3, "training"))]
    return sides[0].unionByName(sides[1]).withColumn("abstract", F.md5("abstract"))


def stage_lineage(spark, sf):
    """Two stages, one after the other; the file below them is another one the second time."""
    source, first, second = (place(spark, n) for n in ("source", "first", "second"))
    for rows in (fx.queries(spark, sf).limit(0), fx.queries(spark, sf)):
        rows.write.mode("overwrite").parquet(source)
        sinks.materialise(spark, first, lambda: spark.read.parquet(source), reads=[source])
        judged = lambda: spark.read.parquet(first).join(fx.grades(spark, sf), "query_id", "left_semi")
        found = sinks.materialise(spark, second, judged, after=[first])
    return found


def stage_table(spark, sf):
    """A stage of other parameters is built anew; one of the same parameters is read."""
    path = place(spark, "stage")
    judged = cand.judged_queries(fx.queries(spark, sf), fx.grades(spark, sf))
    sinks.materialise(spark, path, lambda: judged.limit(0), parameters={"k": 1})
    sinks.materialise(spark, path, lambda: judged, parameters={"k": 2})
    return sinks.materialise(spark, path, lambda: judged.limit(0), parameters={"k": 2})


def score_snapshots(spark, sf):
    """Scores of two runs: pinned to the first, and the newest of each candidate."""
    table = SnapshotTable(spark, place(spark, "scores"), scoring.SCORES)
    rows = scoring.with_passage_key(fx.candidates(spark, sf))
    scored = rows.select(F.lit("m").alias("experiment"), *scoring.SCORE_KEYS, F.col("score"), "qrel")
    first = table.append(scored.drop("qrel"), {"run": 1})
    table.append(scored.where("qrel is not null").withColumn("score", -F.col("score")).drop("qrel"), {"run": 2})
    keys = ["experiment", *scoring.SCORE_KEYS]
    pinned = table.read(first).withColumn("reader", F.lit("pinned"))
    return pinned.unionByName(table.newest(keys).withColumn("reader", F.lit("newest")))


def vector_snapshots(spark, sf):
    """Vectors of all passages after two runs, and which of them made each: the first has the judged only."""
    store = VectorStore(spark, place(spark, "vectors"), "letters@1")
    rows = fx.candidates(spark, sf)
    for part in (rows.where("qrel is not null"), rows):
        store.embed(part, "abstract", fx.letter_encoder)
    return store.table.read().select("text_key", fx.shown(F.col("embedding")).alias("vector"), "snapshot")


def table_file(spark, sf):
    path = place(spark, "table")
    sinks.write_parquet(fx.corpus(spark, sf), path)
    return sources.read_table(spark, path, sources.CORPUS).withColumn("abstract", F.md5("abstract"))


def title_map_table(spark, sf):
    path = place(spark, "titles")
    sinks.write_parquet(fx.title_map(spark, sf), path)
    return sources.read_title_map(spark, path)


def wiki_pages_table(spark, sf):
    path = place(spark, "wiki")
    sinks.write_parquet(fx.wiki_pages(spark, sf), path)
    return sources.read_wiki_pages(spark, path).withColumn("text", F.md5("text"))


def stored_head(spark, layers) -> list:
    """A head as a scoring run gets it: from a table, through the reader."""
    path = place(spark, "head")
    rows = [(i, w.tolist(), b.tolist()) for i, (w, b) in enumerate(layers)]
    spark.createDataFrame(rows, sources.HEAD).write.parquet(path)
    return scoring.load_head(sources.read_head(spark, path))


def head_table(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select("vec_id", F.reverse("embedding").alias("embedding"))
    projected = scoring.head_projection(rows, "embedding", "projected", stored_head(spark, fx.test_head()))
    return projected.select(
        "vec_id", *[F.round(F.get("projected", F.lit(i)), 6).alias(f"p{i}") for i in range(4)]
    )


FILES = (
    quad_file, quad_rejects, run_file, checked_run_file, checked_rejects, grades_file, queries_file, topics_file, article_grades_file, names_file,
    vectors_file, weights_file, folds_file, entity_lists_file, pages_csv, search_docs_file, fold_tables,
    fold_store, fold_store_part, stage_lineage, stage_table,
    score_snapshots, vector_snapshots, table_file, title_map_table, wiki_pages_table, head_table,
)
