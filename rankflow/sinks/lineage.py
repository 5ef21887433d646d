"""What a stage was made from: files, parameters, and the stages before it, as a chain of hashes.

The digest of a stage covers the names, sizes and times of its source files, its parameters, and the digests of
the stages it reads, which cover theirs in turn. So a changed file renews the stages that depend on it, directly
or through others, and no others; a stage that is made again from the same things keeps its digest.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.session import hadoop_path


def digest_of(value) -> str:
    """The hash of a JSON value, whatever the order of its keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def file_fingerprint(spark: SparkSession, path: str) -> dict:
    """Number, bytes and a digest of name, size and time of the files at a path; contents are not read.

    One file is asked for directly. A folder or a pattern is listed by Spark, and the rows of the listing are
    added up in the tasks, so that a source of any number of files is one row on the driver.
    """
    files, at = hadoop_path(spark, path)
    status = files.getFileStatus(at) if files.exists(at) else None
    if status is not None and status.isFile():
        entry = [status.getPath().toString(), status.getLen(), status.getModificationTime()]
        return {"files": 1, "bytes": entry[1], "digest": digest_of(entry)}
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    entry = F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
    n, n_bytes, one, two = listing.agg(
        F.count(F.lit(1)),
        F.coalesce(F.sum("length"), F.lit(0)),
        F.bit_xor(F.xxhash64(entry)),
        F.bit_xor(F.xxhash64(F.reverse(entry))),
    ).first()
    return {"files": n, "bytes": n_bytes, "digest": digest_of([one, two])}


def frame_fingerprint(df: DataFrame | None) -> dict | None:
    """What is known of a table that a caller hands over: its columns and the files behind it."""
    if df is None:
        return None
    return {"schema": df.schema.json(), "files": sorted(df.inputFiles())}


def described(experiment: Mapping) -> dict:
    """Everything that decides the scores of an experiment, as JSON: a head by its numbers, a function by its name."""

    def plain(value):
        if isinstance(value, np.ndarray):
            return {"shape": list(value.shape), "digest": hashlib.sha256(np.ascontiguousarray(value, "<f8").tobytes()).hexdigest()}
        if isinstance(value, (list, tuple)):
            return [plain(v) for v in value]
        if callable(value):
            return f"{getattr(value, '__module__', '')}.{getattr(value, '__qualname__', type(value).__qualname__)}"
        return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)

    return {key: plain(value) for key, value in sorted(experiment.items())}
