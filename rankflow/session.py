"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from pathlib import Path
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

import rankflow

RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Outer and semi joins on a hot key are split too, even at the price of one more shuffle.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    return builder


_shipped: set[tuple[str, str]] = set()


def ship(spark: SparkSession, *packages: ModuleType) -> None:
    """Send the code of this package, and of others, to the Python workers.

    Needless where the package is installed on the workers or passed with ``--py-files``.
    """
    for package in (rankflow, *packages):
        key = (spark.sparkContext.applicationId, package.__name__)
        if key not in _shipped:
            source = Path(package.__file__).parent
            archive = f"{tempfile.mkdtemp(prefix='ship-')}/{source.name}"
            archive = shutil.make_archive(archive, "zip", source.parent, source.name)
            spark.sparkContext.addPyFile(archive)
            _shipped.add(key)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Every executor must reach it, so only a local session may fall back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster is a cluster
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="rankflow-")
    spark.sparkContext.setCheckpointDir(folder)
    return shared_folder(spark)


def land(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, computes a frame that several
    branches read only once, and tells Catalyst the true size, so that it broadcasts the frame
    only when it is below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rankflow/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _landed.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_landed: dict[str, list[str]] = {}


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any scheme."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def drop_landed(spark: SparkSession) -> int:
    """Delete the tables that this application has landed; frames that read them can't be used again."""
    paths = _landed.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        files, at = hadoop_path(spark, path)
        files.delete(at, True)
    return len(paths)


# A scan of more splits than this (4 GB at the default split size) is never shuffled by ``spread``.
SMALL_SCAN_SPLITS = 32


def spread(df: DataFrame) -> DataFrame:
    """Repartition a small scan that has fewer splits than the cluster has cores."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")
    )
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size <= min(cores, SMALL_SCAN_SPLITS) * split else df
