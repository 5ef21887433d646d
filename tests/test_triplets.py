import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankflow.operators import triplets


def make(spark, rows):
    """rows: (query, entity, hit, grade)"""
    data = [(q, f"text {q}", e, h, g, f"abstract {e}", [float(h)]) for q, e, h, g in rows]
    return spark.createDataFrame(
        data,
        "query_id string, query_text string, dbpedia_entity string, hit int, qrel int,"
        " abstract string, biggraph_embedding array<double>",
    )


def expected_sample(rows, seed):
    groups = defaultdict(list)
    positive = defaultdict(int)
    for q, e, h, g in rows:
        if g is not None and g > 0:
            positive[q] += 1
        elif g == 0:
            groups[q].append((hashlib.md5(f"{seed}|{q}|{e}".encode()).hexdigest(), h, e))
    return {
        (q, e, h)
        for q, drawn in groups.items()
        if 0 < positive[q] <= len(drawn)
        for _, h, e in sorted(drawn)[: positive[q]]
    }


ROWS = (
    [("hot", f"e{i}", i, 1 if i % 20 == 0 else (0 if i % 3 else None)) for i in range(600)]
    + [("small", f"e{i}", i, 1 if i < 2 else 0) for i in range(6)]
    + [("no_positive", f"e{i}", i, 0) for i in range(4)]
    + [("few_negatives", f"e{i}", i, 1 if i else 0) for i in range(4)]
    + [("unjudged", "e1", 1, None)]
    + [("copies", "e1", i, 0) for i in range(30)]
    + [("copies", "e2", 99, 2)]
)


@pytest.mark.parametrize("limits", [{}, {"rows_per_task": 1}])
@pytest.mark.parametrize("seed", [42, 7])
def test_sample_is_the_start_of_the_draw(spark, limits, seed):
    drawn = triplets.negative_sample(make(spark, ROWS), seed, **limits)
    got = {(r.query_id, r.dbpedia_entity, r.hit) for r in drawn.collect()}
    assert got == expected_sample(ROWS, seed)
    assert drawn.count() == len(got)


def test_the_sample_does_not_depend_on_the_partitions(spark):
    """Many passages of one entity at one hit: only the text tells them apart."""
    rows = [("q", "text q", "e", 1, 0, f"passage {i}", [0.0]) for i in range(40)]
    rows += [("q", "text q", f"p{i}", 2, 1, "x", [0.0]) for i in range(5)]
    schema = make(spark, ROWS[:1]).schema
    samples = set()
    for n in (1, 2, 5, 9, 20):
        df = spark.createDataFrame(rows, schema).repartition(n)
        samples.add(tuple(sorted(r.abstract for r in triplets.negative_sample(df, 42).collect())))
    assert len(samples) == 1 and len(samples.pop()) == 5


@pytest.mark.parametrize("n_pos", [1, 30, 49, 50, 60])
def test_equal_rows_are_taken_as_often_as_needed(spark, n_pos):
    """Fifty negatives are one row, and ten more differ in the text alone."""
    rows = [("q", "text q", "e", 1, 0, "same", [0.0])] * 50
    rows += [("q", "text q", "e", 1, 0, f"passage {i}", [0.0]) for i in range(10)]
    rows += [("q", "text q", f"p{i}", 2, 1, "x", [0.0]) for i in range(n_pos)]
    df = spark.createDataFrame(rows, make(spark, ROWS[:1]).schema).repartition(7)
    got = triplets.negative_sample(df, 42)
    order = df.where("qrel = 0").select("abstract", F.xxhash64(*df.columns).alias("h")).orderBy("h").collect()
    assert sorted(r.abstract for r in got.collect()) == sorted(r.abstract for r in order[:n_pos])
    assert got.columns == [*df.columns, "n_pos"]


def test_payload_is_neither_landed_nor_shuffled(spark, monkeypatch):
    landed = []
    land = triplets.land
    monkeypatch.setattr(triplets, "land", lambda df: landed.append(df.columns) or land(df))
    drawn = triplets.negative_sample(make(spark, ROWS), 42)
    assert landed and not any({"abstract", "biggraph_embedding"} & set(columns) for columns in landed)
    plan = drawn._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_only_keys_are_sampled(spark, tmp_path, monkeypatch):
    landed = []
    land = triplets.land
    monkeypatch.setattr(triplets, "land", lambda df: landed.append(df) or land(df))
    triplets.negative_sample(make(spark, ROWS), 42)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in landed]
    sampling = next(p for p in plans if "Window" in p)
    for exchange in [line for line in sampling.splitlines() if "Exchange" in line or "Window" in line]:
        assert "abstract" not in exchange and "biggraph" not in exchange


def test_skipped_queries_are_reported(spark):
    skipped = triplets.skipped_queries(triplets.judged_counts(make(spark, ROWS)))
    assert {(r.query_id, r.reason) for r in skipped.collect()} == {
        ("no_positive", "no positives"),
        ("few_negatives", "too few negatives"),
    }


@pytest.mark.parametrize("pairs_per_task", [1_000_000, 50])
def test_triplets_are_positives_times_sample(spark, pairs_per_task):
    built = triplets.build_triplets(make(spark, ROWS), 42, rows_per_task=25, pairs_per_task=pairs_per_task)
    got = sorted((r.query_id, r.dbpedia_entity_x, r.dbpedia_entity_y) for r in built.collect())
    want = sorted(
        (q, p, n) for q, n, _ in expected_sample(ROWS, 42) for q2, p, _, g in ROWS if q2 == q and (g or 0) > 0
    )
    assert got == want
    per_query = {r.query_id: r["count"] for r in built.groupBy("query_id").count().collect()}
    counts = triplets.positive_counts(make(spark, ROWS)).collect()
    assert all(per_query.get(r.query_id) in (None, r.n_pos**2) for r in counts)
    assert {"abstract_x", "abstract_y", "qrel_x", "qrel_y", "biggraph_embedding_x"} <= set(built.columns)


def test_unjudged_is_neither(spark):
    df = make(spark, [("q", "a", 1, None), ("q", "b", 2, 0), ("q", "c", 3, 1)])
    assert [r.dbpedia_entity for r in triplets.positives(df).collect()] == ["c"]
    assert [r.dbpedia_entity for r in triplets.judged_negatives(df).collect()] == ["b"]


def test_loss(spark):
    df = spark.createDataFrame(
        [([0.0], [1.0], [3.0]), ([0.0], [0.0], [100.0])],
        "a array<double>, p array<double>, n array<double>",
    )
    loss = triplets.triplet_loss(df, "a", "p", "n").first()["loss"]
    assert loss == pytest.approx((max(1 - 3 + 5, 0) + 0) / 2, abs=1e-5)


def test_shapes(spark):
    built = triplets.build_triplets(make(spark, ROWS).withColumn("deepct_weights", F.array(F.lit(float("nan")))))
    shaped = triplets.shape_triplets(built, graph=True, weights=True, weight_dim=3)
    assert shaped.columns == [
        "query_sentence", "pos_sentence", "neg_sentence", "pos_biggraph", "neg_biggraph", "pos_deepct", "neg_deepct",
    ]
    assert shaped.first()["pos_deepct"] == [0.0, 0.0, 0.0]
    assert triplets.shape_candidates(make(spark, ROWS)).columns == ["query_sentence", "retrieval_sentence"]
