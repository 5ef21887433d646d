import pytest
from pyspark.sql import functions as F

from rankflow.operators import reduction
from rankflow.operators.reduction import bloom_filtered, keep_keys


@pytest.mark.parametrize("broadcast_bytes", [0, 64, 200, 1 << 20])
def test_keep_keys(spark, broadcast_bytes):
    """No filter, a filter of one word, of several words, and the keys themselves."""
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), ("c", 5)], "k string, v int")
    keys = spark.createDataFrame([("a",), ("c",), ("a",), (None,), ("z",)], "k string")
    got = keep_keys(rows, keys, "k", broadcast_bytes)
    assert got.columns == ["k", "v"]
    assert sorted(r.v for r in got.collect()) == [1, 2, 5]


@pytest.mark.parametrize("kind", ["bigint", "string", "double"])
@pytest.mark.parametrize("broadcast_bytes", [0, 8_000, 30_000, 1 << 30])
def test_all_ways_keep_the_same_rows(spark, kind, broadcast_bytes):
    rows = spark.range(20_000).select(F.pmod(F.xxhash64("id"), F.lit(15_000)).cast(kind).alias("k"), "id")
    keys = spark.range(1, 9_000, 3).select(F.col("id").cast(kind).alias("k"))
    want = rows.join(keys, "k", "left_semi")
    got = keep_keys(rows, keys, "k", broadcast_bytes)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_words_let_few_other_rows_pass(spark):
    keys = spark.range(30_000).select(F.concat(F.lit("key "), F.col("id").cast("string")).alias("k"))
    others = spark.range(50_000).select(F.concat(F.lit("other "), F.col("id").cast("string")).alias("k"))
    passed = bloom_filtered(others, keys, "k", 30_000 // reduction.KEYS_PER_WORD).count()
    assert passed < 0.05 * 50_000
    crowded = bloom_filtered(others, keys, "k", 30_000 // reduction.MOST_KEYS_PER_WORD).count()
    assert passed < crowded < 0.6 * 50_000
    assert bloom_filtered(keys, keys, "k", 100).count() == 30_000


def test_the_corpus_is_filtered_before_it_is_shuffled(spark):
    corpus = spark.range(4_000).select(F.col("id").cast("string").alias("k"), F.repeat(F.lit("x"), 50).alias("payload"))
    keys = corpus.where("k like '1%'").select("k")
    size = 12_000  # too little for the keys, enough for their words
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        kept = keep_keys(corpus, keys, "k", size)
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # In the plan, what lies below stands later: the corpus meets the words, then it is shuffled.
    assert plan.index("SortMergeJoin") < plan.index("Exchange hashpartitioning") < plan.index("BroadcastHashJoin")
    assert plan.count("Exchange hashpartitioning") == 2
    assert plan.index("BroadcastHashJoin") < plan.index("Range (0")
    assert kept.count() == keys.count()
