"""Cross-validation folds and the experiment grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_folds(candidates: DataFrame, folds: DataFrame) -> DataFrame:
    """Every candidate once per fold, with ``fold`` and ``split``."""
    return candidates.join(folds, "query_id")


def fold_part(candidates: DataFrame, folds: DataFrame, fold: int, split: str) -> DataFrame:
    """The candidates of one side of one fold."""
    members = folds.where((F.col("fold") == fold) & (F.col("split") == split))
    return candidates.join(members, "query_id", "left_semi")


def fold_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("fold", "split").agg(F.count(F.lit(1)).alias("n_rows"))


def experiment_grid(checkpoints: DataFrame, folds: Sequence[int]) -> DataFrame:
    """Every checkpoint on every test fold.

    ``checkpoints`` has ``experiment`` and ``train_fold``. Test queries of another fold than the
    training fold may have been trained on; ``seen_in_training`` marks those rows.
    """
    tested = F.explode(F.array(*[F.lit(f) for f in folds]))
    grid = checkpoints.withColumn("fold", tested)
    return grid.withColumn("seen_in_training", F.col("fold") != F.col("train_fold"))


def grid_work(grid: DataFrame, fold_rows: DataFrame) -> DataFrame:
    """Rows to score per experiment and test fold, counted once per fold and not once per run."""
    tests = fold_counts(fold_rows.where(F.col("split") == "test")).drop("split")
    return grid.join(tests, "fold", "left").fillna(0, ["n_rows"])
