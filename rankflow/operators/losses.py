"""The triplet loss of all pairs of positives and sampled negatives, without a row per pair.

A query with n positives has n squared pairs. Its loss, the sum of max(d_pos - d_neg + margin, 0), needs none of
them: with both sides in one order, by d_pos + margin and by d_neg, a positive at x adds x times the number of
negatives before it less the sum of their distances. That is one sort and two running sums.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.functions.vectors import DISTANCES, TRIPLET_MARGIN
from rankflow.operators.numbering import running_sums
from rankflow.operators.triplets import KEYS, draw_parts, negative_sample, positives


def hinge_loss(
    rows: DataFrame, group: Sequence[str], distance: str, is_positive: str | Column, margin: float = TRIPLET_MARGIN
) -> DataFrame:
    """(loss, n_pairs): the mean over all pairs of a positive and a negative of one group.

    Rows without a distance are in no pair; a pair with a distance that is not a number makes the loss not a
    number. Equal distances of a group are one row before anything is sorted, so that neither a hot
    group nor a distance that many rows share is one task's work. Without pairs the loss is null.
    """
    positive = is_positive if isinstance(is_positive, Column) else F.col(is_positive)
    keys = [f"_g{i}" for i in range(len(group))]
    sides = rows.select(
        *[F.col(c).alias(k) for c, k in zip(group, keys, strict=True)],
        F.when(positive, F.col(distance) + margin).otherwise(F.col(distance)).cast("double").alias("x"),
        positive.alias("_positive"),
    )
    for known in (*keys, "x", "_positive"):  # na.drop would take NaN for null
        sides = sides.where(F.col(known).isNotNull())
    placed = sides.groupBy(*keys, "x").agg(
        F.count_if("_positive").alias("n_pos"), F.count_if(~F.col("_positive")).alias("n_neg")
    )
    placed = placed.withColumn("neg_sum", F.when(F.col("n_neg") > 0, F.col("x") * F.col("n_neg")).otherwise(0.0))
    # A positive and a negative at one place add nothing, so it doesn't matter that the sums hold both.
    summed = running_sums(placed, keys, ["x"], {"n_before": "n_neg", "sum_before": "neg_sum"})
    hinge = F.col("n_pos") * (F.col("x") * F.col("n_before") - F.col("sum_before"))
    undefined = F.max(F.isnan("x").cast("int"))
    by_group = summed.groupBy(*keys).agg(
        F.sum(F.when((F.col("n_pos") > 0) & (F.col("n_before") > 0), hinge).otherwise(0.0)).alias("hinge"),
        (F.sum("n_pos") * F.sum("n_neg")).alias("n_pairs"),
        undefined.alias("undefined"),
    )
    by_group = by_group.where("n_pairs > 0")
    total = F.when(F.max("undefined") > 0, float("nan")).otherwise(F.sum("hinge"))
    return by_group.agg(
        (total / F.sum("n_pairs")).alias("loss"), F.coalesce(F.sum("n_pairs"), F.lit(0)).alias("n_pairs")
    )


def sampled_sides(candidates: DataFrame, seed: int = 42, **sample) -> DataFrame:
    """Positives, and as many sampled negatives, of the queries that give triplets, with ``is_positive``."""
    parts = draw_parts(candidates, seed, sample.get("identity", ("query_id", "dbpedia_entity")))
    negatives = negative_sample(candidates, seed, parts=parts, **sample).drop("n_pos")
    positive = positives(candidates).join(parts.select("query_id"), "query_id", "left_semi")
    sides = positive.withColumn("is_positive", F.lit(True))
    return sides.unionByName(negatives.withColumn("is_positive", F.lit(False)))


def sampled_loss(
    candidates: DataFrame,
    anchor: str,
    vector: str,
    metric: str = "euclidean",
    margin: float = TRIPLET_MARGIN,
    seed: int = 42,
    **sample,
) -> DataFrame:
    """The loss that ``triplet_loss`` has on the triplets of ``build_triplets``; a distance per candidate."""
    distance = DISTANCES[metric](F.col(anchor), F.col(vector))
    sides = sampled_sides(candidates, seed, **sample)
    query = [F.sha2(c, 256).alias(c) for c in KEYS]
    return hinge_loss(sides.select(*query, "is_positive", distance.alias("d")), KEYS, "d", "is_positive", margin)
