"""Writers, and the rule to compute a table only when it is not there yet."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankflow.operators.numbering import dense_ordinal
from rankflow.session import hadoop_path
from rankflow.sinks.lineage import digest_of, file_fingerprint
from rankflow.sources.quarantine import REJECTS, Checked


def write_parquet(df: DataFrame, path: str, compression: str = "zstd") -> None:
    df.write.option("compression", compression).parquet(path)


def write_search_documents(corpus: DataFrame, path: str, id_col: str, text_col: str) -> None:
    """JSON lines ``{id, contents}``; a null text is written as null."""
    documents = corpus.select(F.col(id_col).alias("id"), F.col(text_col).alias("contents"))
    documents.write.option("ignoreNullFields", "false").json(path)


def write_topics(queries: DataFrame, path: str) -> None:
    writer = queries.select("query_index", "query_text").write
    writer.option("sep", "\t").option("quote", "").csv(path)


def write_run(run: DataFrame, path: str, id_col: str = "url_dbpedia", tag: str = "bm25") -> None:
    """Six fields separated by blanks: query, 'Q0', id, rank, score with six decimals, tag."""
    line = F.concat_ws(
        " ",
        "query_index",
        F.lit("Q0"),
        id_col,
        "hit",
        F.format_string("%.6f", F.col("score")),
        F.lit(tag),
    )
    run.select(line.alias("value")).write.text(path)


def write_entity_pages(pages: DataFrame, path: str) -> None:
    """CSV with a leading row number; quotes keep texts of several lines whole."""
    numbered = dense_ordinal(pages, ["entity"], "row")
    writer = numbered.select("row", "entity", "document").write
    writer.option("header", True).option("escape", '"').csv(path)


def write_folds(
    df: DataFrame, path: str, compression: str = "zstd", mode: str = "errorifexists"
) -> None:
    """One folder per fold and split; large ones are written by several tasks."""
    balanced = df.hint("rebalance", "fold", "split")
    writer = balanced.write.mode(mode).partitionBy("fold", "split")
    writer.option("compression", compression).parquet(path)


MANIFEST, REJECTS_FOLDER = "_stage.json", "_rejects"


def is_complete(spark: SparkSession, path: str) -> bool:
    """A Spark write leaves ``_SUCCESS`` only when every task has committed."""
    files, at = hadoop_path(spark, f"{path}/_SUCCESS")
    return files.exists(at)


def read_json(spark: SparkSession, path: str):
    """A small JSON file of any file system."""
    files, at = hadoop_path(spark, path)
    stream = files.open(at)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def write_json(spark: SparkSession, path: str, value) -> None:
    files, at = hadoop_path(spark, path)
    stream = files.create(at, True)
    try:
        stream.write(json.dumps(value).encode())
    finally:
        stream.close()


def _manifest(spark: SparkSession, path: str) -> dict | None:
    if not is_complete(spark, path):
        return None
    files, at = hadoop_path(spark, f"{path}/{MANIFEST}")
    return read_json(spark, f"{path}/{MANIFEST}") if files.exists(at) else None


def _finish(spark: SparkSession, temporary: str, path: str, manifest: dict) -> None:
    """Put the manifest into a written table and move it to its place."""
    write_json(spark, f"{temporary}/{MANIFEST}", manifest)
    files, old = hadoop_path(spark, path)
    _, done = hadoop_path(spark, f"{temporary}/_SUCCESS")
    if not files.exists(done):  # a layout of several tables, all of them written by now
        files.create(done, True).close()
    _, new = hadoop_path(spark, temporary)
    files.delete(old, True)
    files.mkdirs(old.getParent())
    if not files.rename(new, old):
        raise OSError(f"cannot move {temporary} to {path}")


def stage_digest(spark: SparkSession, path: str) -> str:
    """The digest of the finished stage at a path."""
    manifest = _manifest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"there is no finished stage at {path}")
    return manifest["digest"]


def stage_counts(spark: SparkSession, path: str) -> dict[str, int]:
    """Rows and rejects by reason of a stage that was made from a checked source."""
    return (_manifest(spark, path) or {}).get("counts", {})


def stage_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The lines that a stage made from a checked source goes without; none for other stages."""
    files, at = hadoop_path(spark, f"{path}/{REJECTS_FOLDER}")
    reader = spark.read.schema(REJECTS)
    return reader.parquet(f"{path}/{REJECTS_FOLDER}") if files.exists(at) else spark.createDataFrame([], REJECTS)


def materialise(
    spark: SparkSession,
    path: str,
    build: Callable[[], DataFrame | Checked],
    compression: str = "zstd",
    parameters: dict | None = None,
    write: Callable[[DataFrame, str], None] | None = None,
    reads: Sequence[str] = (),
    after: Sequence[str] = (),
    read: Callable[[SparkSession, str], DataFrame] | None = None,
) -> DataFrame:
    """Read the table at ``path``; if there is none made from the same things, build and write it first.

    It is known by its ``parameters``, by the files of the sources it ``reads``, and by the digests of the
    finished stages it comes ``after``. The table is written beside its place and moved there when its write was
    committed, together with a manifest. The leftovers of a failed run, and a table that was made from
    other things, are replaced. Rejects of a checked source lie beside its rows and are counted in the manifest;
    ``stage_rejects`` reads them. ``write`` and ``read`` stand for other layouts than one Parquet table.
    """
    made_from = {
        "parameters": json.loads(json.dumps(parameters or {})),
        "sources": {source: file_fingerprint(spark, source) for source in reads},
        "stages": {stage: stage_digest(spark, stage) for stage in after},
    }
    # Where a stage lies is no part of what it is.
    known = made_from | {"stages": list(made_from["stages"].values())}
    digest = digest_of(known)
    manifest = _manifest(spark, path)
    if manifest is None or manifest.get("digest") != digest:
        built = build()
        df = built if isinstance(built, DataFrame) else built.rows
        temporary = f"{path.rstrip('/')}.{uuid.uuid4().hex}.tmp"
        if write is None:
            df.write.option("compression", compression).parquet(temporary)
        else:
            write(df, temporary)
        manifest = made_from | {"schema": df.schema.json(), "digest": digest}
        if df is not built:
            built.rejects.write.option("compression", compression).parquet(f"{temporary}/{REJECTS_FOLDER}")
            manifest["counts"] = built.counts
        _finish(spark, temporary, path, manifest)
    if read is not None:
        return read(spark, path)
    return spark.read.schema(StructType.fromJson(json.loads(manifest["schema"]))).parquet(path)
