import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.fixtures import letter_encoder
from rankflow.functions.vectors import DISTANCES
from rankflow.operators import losses, numbering, scoring, triplets
from rankflow.operators.losses import hinge_loss


def plain(rows, margin):
    """(loss, pairs) by going through all pairs."""
    total, pairs = 0.0, 0
    for q, p, d in rows:
        for r, s, e in rows:
            if q is not None and q == r and p and s is False and d is not None and e is not None:
                total += max(d - e + margin, 0) if not math.isnan(d - e) else math.nan
                pairs += 1
    return (total / pairs if pairs else None), pairs


def loss_of(spark, rows, margin=0.5, partitions=5):
    df = spark.createDataFrame(rows, "q string, positive boolean, d double").repartition(partitions)
    row = hinge_loss(df, ["q"], "d", "positive", margin).first()
    return row["loss"], row["n_pairs"]


@pytest.mark.parametrize("seed", range(3))
def test_loss_equals_all_pairs(spark, seed):
    rng = random.Random(seed)
    rows = [("hot", rng.random() < 0.4, rng.choice([0.0, 1.0, rng.random() * 3])) for _ in range(500)]
    rows += [(f"q{rng.randint(0, 9)}", rng.random() < 0.5, round(rng.random(), 1)) for _ in range(150)]
    rows += [("only positives", True, 1.0), ("only negatives", False, 1.0), (None, True, 1.0), (None, False, 0.0)]
    rows += [("hot", True, None), ("hot", False, None), ("hot", None, 1.0)]
    want = plain(rows, 0.5)
    got = loss_of(spark, rows)
    assert got[1] == want[1] and got[0] == pytest.approx(want[0], rel=1e-12)


@pytest.mark.parametrize(
    "rows",
    [
        [("q", True, math.inf), ("q", False, 1.0)],
        [("q", True, 1.0), ("q", False, math.inf), ("q", False, 1.0)],
        [("q", True, math.inf), ("q", False, math.inf)],
        [("q", True, -math.inf), ("q", False, 1.0)],
        [("q", True, 1.0), ("q", False, -math.inf)],
        [("q", True, math.nan), ("q", False, 1.0), ("r", True, 1.0), ("r", False, 1.0)],
        [("q", True, 1.0), ("q", False, math.nan)],
        [("q", True, math.nan)],
        [("q", True, 1.0), ("q", False, None)],
        [("q", False, 1.0)],
    ],
)
def test_distances_that_are_no_numbers(spark, rows):
    assert loss_of(spark, rows, partitions=1) == pytest.approx(plain(rows, 0.5), nan_ok=True)


def test_without_rows(spark):
    df = spark.createDataFrame([], "q string, positive boolean, d double")
    assert tuple(hinge_loss(df, ["q"], "d", "positive").first()) == (None, 0)


def test_running_sums_of_hot_groups(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot", "hot", f"g{i % 9}"]), rng.randint(0, 400), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, at int, n long").repartition(6)
    got = numbering.running_sums(df, ["g"], ["at", "n"], {"total": "n", "places": "at"}).collect()
    assert len(got) == 900
    for r in got:
        upto = [x for x in rows if x[0] == r.g and (x[1], x[2]) <= (r["at"], r.n)]
        assert (r.total, r.places) == (sum(x[2] for x in upto), sum(x[1] for x in upto))


def candidates(spark):
    rng = np.random.default_rng(2)
    rows = []
    for q, n, judged in (("big", 120, 3), ("small", 12, 4), ("none", 5, 99)):
        anchor = rng.normal(size=4).tolist()
        for i in range(n):
            grade = 1 if i % judged == 0 and judged < 99 else (None if i % 7 == 3 else 0)
            vector = None if i == 5 else rng.normal(size=4).tolist()
            rows.append((q, f"text of {q}", f"e{i}", i, grade, f"abstract {q} {i % 30}", anchor, vector))
    return spark.createDataFrame(
        rows,
        "query_id string, query_text string, dbpedia_entity string, hit int, qrel int, abstract string,"
        " anchor array<double>, biggraph_embedding array<double>",
    )


@pytest.mark.parametrize("metric", DISTANCES)
def test_sampled_loss_equals_the_loss_on_the_triplets(spark, metric):
    rows = candidates(spark)
    anchors = rows.select("query_id", "anchor").distinct()
    built = triplets.build_triplets(rows).join(anchors, "query_id")
    built = built.where("biggraph_embedding_x is not null and biggraph_embedding_y is not null")
    want = triplets.triplet_loss(built, "anchor", "biggraph_embedding_x", "biggraph_embedding_y", metric).first()[0]
    got = losses.sampled_loss(rows, "anchor", "biggraph_embedding", metric).first()
    assert got["loss"] == pytest.approx(want, rel=1e-12) and got["n_pairs"] == built.count()


def test_no_step_has_a_row_per_pair(spark):
    """Rows of the largest table written on the way, against the pairs."""
    rows = [("q", f"text {i}", f"e{i}", i, int(i % 2 == 0), [float(i)], [0.0]) for i in range(600)]
    df = spark.createDataFrame(
        [(q, "t", e, i, g, t, v, a) for q, t, e, i, g, v, a in rows],
        "query_id string, query_text string, dbpedia_entity string, hit int, qrel int, abstract string,"
        " v array<double>, a array<double>",
    )
    loss = losses.sampled_loss(df, "a", "v")
    plan = loss._jdf.queryExecution().optimizedPlan().toString()
    # Joins with the counts of queries and partitions only.
    assert "abstract" not in plan and loss.first()["n_pairs"] == 300 * 300


def test_model_loss_without_triplets(spark):
    rows = candidates(spark)
    want = scoring.model_triplet_loss(triplets.build_triplets(rows), letter_encoder, margin=0.5).first()["loss"]
    got = scoring.model_sampled_loss(rows, letter_encoder, margin=0.5).first()
    assert got["loss"] == pytest.approx(want, rel=1e-12)
    assert got["n_pairs"] == triplets.build_triplets(rows).count()


def test_distances_keep_other_columns(spark):
    rows = candidates(spark)
    got = scoring.candidate_distances(rows, ("dbpedia_entity", "hit"), letter_encoder)
    assert got.columns == ["dbpedia_entity", "hit", "distance"] and got.count() == rows.count()
    assert got.where(F.col("distance").isNull()).isEmpty()
