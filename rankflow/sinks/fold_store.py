"""Folds of a table without a copy per fold.

Every row is written once, with the folds and splits of its query as a bitmap: two bits per fold, one for each
split. Rows lie in folders by bitmap, so that the queries that a fold tests share folders, and reading one side of
one fold opens only the folders whose bitmaps have its bit. In a cross-validation of n folds there are n bitmaps;
whatever their number, there are at most ``FOLDERS`` folders, and rows of other bitmaps in a folder are
left out by their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rankflow.session import land
from rankflow.sinks.writers import read_json, write_json

FOLDERS = 1024
SPLITS = ("training", "test")
MEMBERS, FOLDER = "fold_members", "fold_folder"
_WORD_BITS = 62
_SCHEMA = "_schema.json"


def _bit(fold: Column, split: Column) -> Column:
    return fold.cast("long") * 2 + F.when(split == SPLITS[1], 1).otherwise(0)


def fold_members(folds: DataFrame) -> DataFrame:
    """(query_id, fold_members): one bitmap per query, as an array of words. A repeated membership is one."""
    strange = folds.where("fold is null or fold < 0 or split is null or split not in ('training', 'test')")
    if not strange.isEmpty():
        raise ValueError(f"neither training nor test of a numbered fold: {strange.first()}")
    most = folds.agg(F.max("fold")).first()[0]
    n_words = (2 * (most or 0) + 1) // _WORD_BITS + 1
    bit = _bit(F.col("fold"), F.col("split"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (bit % _WORD_BITS).cast("int"))
    words = [
        F.coalesce(F.bit_or(F.when(F.floor(bit / _WORD_BITS) == i, one)), F.lit(0).cast("long")) for i in range(n_words)
    ]
    return folds.where("query_id is not null").groupBy("query_id").agg(F.array(*words).alias(MEMBERS))


def _has(fold: int, split: str) -> Column:
    """Whether a bitmap has the bit of one side of one fold; words that it lacks are zero."""
    word, bit = divmod(2 * fold + SPLITS.index(split), _WORD_BITS)
    return F.coalesce(F.get(MEMBERS, F.lit(word)), F.lit(0)).bitwiseAND(F.lit(1 << bit)) != 0


def write_fold_store(rows: DataFrame, folds: DataFrame, path: str, compression: str = "zstd") -> None:
    """Write the rows of all queries that are in a fold, once each; ``folds`` has fold, split, query_id."""
    members = land(fold_members(folds))
    stored = rows.join(members, "query_id").withColumn(FOLDER, F.pmod(F.xxhash64(MEMBERS), F.lit(FOLDERS)).cast("int"))
    writer = stored.hint("rebalance", FOLDER).write.partitionBy(FOLDER)
    writer.option("compression", compression).parquet(f"{path}/rows")
    folder = F.pmod(F.xxhash64(MEMBERS), F.lit(FOLDERS)).cast("int").alias(FOLDER)
    patterns = folds.join(members, "query_id").select(MEMBERS, folder, "fold", "split").distinct()
    patterns.write.parquet(f"{path}/patterns")
    # A store without rows has no file that tells its columns.
    write_json(rows.sparkSession, f"{path}/{_SCHEMA}", stored.schema.jsonValue())


class FoldStore:
    """What ``write_fold_store`` has written."""

    def __init__(self, spark: SparkSession, path: str):
        schema = StructType.fromJson(read_json(spark, f"{path}/{_SCHEMA}"))
        self.payload = spark.read.schema(schema).parquet(f"{path}/rows")
        self.patterns = spark.read.parquet(f"{path}/patterns")
        self.columns = [c for c in self.payload.columns if c not in (MEMBERS, FOLDER)]

    def part(self, fold: int, split: str) -> DataFrame:
        """The rows of one side of one fold; only their folders are read."""
        if split not in SPLITS:
            raise ValueError(f"a split is one of {SPLITS}")
        found = self.patterns.where((F.col("fold") == fold) & (F.col("split") == split)).select(FOLDER).distinct()
        folders = [r[0] for r in found.collect()]  # at most FOLDERS numbers
        return self.payload.where(F.col(FOLDER).isin(folders) & _has(fold, split)).select(*self.columns)

    def all(self) -> DataFrame:
        """Every row once per fold, with fold and split; copies are made by the reader, not on disk."""
        sides = self.patterns.select(MEMBERS, "fold", "split")
        return self.payload.join(sides, MEMBERS).select(*self.columns, "fold", "split")
