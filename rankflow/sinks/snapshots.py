"""Append-only tables with versions.

    path/data/part=<id>/     Parquet files of one append
    path/versions/<n>.json   the parts of version n, with the version that brought each

An append first writes its part and then its manifest, which takes the next free number by a rename that never
replaces a file. Whoever finds the number taken reads the newer manifest and tries the next one, so no append
is lost. A writer that stops before the rename leaves a part that no manifest names. A reader is pinned to a
version: parts never change, and later versions don't touch the manifests before them.

The rename decides alone on file systems where it is atomic and refuses to replace (HDFS does). The local one
looks first and renames then, which is enough for tests.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankflow.session import hadoop_path
from rankflow.sinks.writers import read_json, write_json

VERSION = "snapshot"


class Conflict(RuntimeError):
    """Another writer has committed since the version that a rewrite is made from."""


def _rename_once(spark: SparkSession, source: str, target: str) -> bool:
    """Move a file; false where the target is there already."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    _, old = hadoop_path(spark, source)
    _, new = hadoop_path(spark, target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        old.toUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    no_options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(context.makeQualified(old), context.makeQualified(new), no_options)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            return False
        raise
    return True


class SnapshotTable:
    """A versioned table of one schema; ``schema`` names its columns before anything is written."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def versions(self) -> list[int]:
        files, folder = hadoop_path(self.spark, f"{self.path}/versions")
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n[0].isdigit() and n.endswith(".json"))

    def version(self) -> int:
        """The newest version; 0 before the first append."""
        return max(self.versions(), default=0)

    def parts(self, version: int) -> list[dict]:
        """What a version consists of: id, rows, note of the writer, and the version that brought it."""
        return read_json(self.spark, self._manifest(version))["parts"] if version else []

    def _manifest(self, version: int) -> str:
        return f"{self.path}/versions/{version:012d}.json"

    def _write_part(self, rows: DataFrame, note: dict | None) -> dict:
        names = self.schema.names
        if sorted(rows.columns) != sorted(names):
            raise ValueError(f"columns {rows.columns} where {names} are expected")
        ident = f"p{uuid.uuid4().hex}"  # never taken for a number
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]).write.parquet(self._part(ident))
        n = self.spark.read.schema(self.schema).parquet(self._part(ident)).count()
        return {"id": ident, "rows": n, "note": note or {}}

    def _part(self, ident: str) -> str:
        return f"{self.path}/data/part={ident}"

    def _commit(self, part: dict, base: int | None) -> int:
        while True:
            newest = self.version()
            if base is not None and newest != base:
                raise Conflict(f"version {newest} of {self.path} is newer than {base}")
            kept = [] if base is not None else self.parts(newest)
            manifest = {"version": newest + 1, "parts": [*kept, part | {"version": newest + 1}]}
            beside = f"{self.path}/versions/_{uuid.uuid4().hex}"
            write_json(self.spark, beside, manifest)
            if _rename_once(self.spark, beside, self._manifest(newest + 1)):
                return newest + 1
            files, left = hadoop_path(self.spark, beside)
            files.delete(left, False)

    def append(self, rows: DataFrame, note: dict | None = None) -> int:
        """Add rows; the version that holds them."""
        return self._commit(self._write_part(rows, note), None)

    def rewrite(self, rows: DataFrame, base: int, note: dict | None = None) -> int:
        """Put ``rows``, made from version ``base``, in the place of all parts, for instance to compact them.

        Rows that others have appended in the meantime would be lost, so that is a ``Conflict``.
        """
        return self._commit(self._write_part(rows, note), base)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, the newest by default, with the version that brought each in ``snapshot``."""
        parts = self.parts(self.version() if version is None else version)
        if not parts:
            return self.spark.createDataFrame([], self.schema).withColumn(VERSION, F.lit(0).cast("long"))
        reader = self.spark.read.schema(StructType([*self.schema.fields]).add("part", "string"))
        rows = reader.option("basePath", f"{self.path}/data").parquet(*[self._part(p["id"]) for p in parts])
        brought = F.create_map(*[F.lit(x) for p in parts for x in (p["id"], p["version"])])
        return rows.withColumn(VERSION, brought[F.col("part")].cast("long")).drop("part")

    def newest(self, keys: Sequence[str], version: int | None = None) -> DataFrame:
        """One row for each key: that of the last snapshot, the greatest where it has several."""
        return newest_rows(self.read(version), keys)


def newest_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of the last ``snapshot`` for each key; one row per key and task is shuffled."""
    rest = [c for c in rows.columns if c not in keys and c != VERSION]
    last = rows.groupBy(*keys).agg(F.max(F.struct(VERSION, *rest)).alias("_last"))
    return last.select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in rows.columns])
