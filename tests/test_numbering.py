import pytest
from pyspark.sql import functions as F

from rankflow.operators.numbering import dense_ordinal, number_lines, rank_in_group, running_total


def test_dense_ordinal_with_one_hot_key(spark):
    """A third of the rows share a key and are spread over the sort all the same."""
    rows = [(0 if i % 3 == 0 else i, i * 7919 % 3001) for i in range(3000)]
    df = spark.createDataFrame(rows, "key int, value int").repartition(6)
    got = {(r.key, r.value): r.ordinal for r in dense_ordinal(df, ["key", "value"]).collect()}
    assert got == {row: i for i, row in enumerate(sorted(rows))}


def test_dense_ordinal_of_copies_is_dense(spark):
    df = spark.range(500).select(F.lit(1).alias("key"))
    got = sorted(r.ordinal for r in dense_ordinal(df, ["key"]).collect())
    assert got == list(range(500))


def test_dense_ordinal_of_nothing(spark):
    assert dense_ordinal(spark.range(0), ["id"]).collect() == []


def test_rank_in_group(spark):
    rows = [("hot" if i % 3 else f"q{i % 5}", i) for i in range(900)]
    df = spark.createDataFrame(rows, "q string, v int")
    got = {(r.q, r.v): r["rank"] for r in rank_in_group(df, ["q"], [F.desc("v")]).collect()}
    want = {}
    for q in {q for q, _ in rows}:
        for i, v in enumerate(sorted((v for k, v in rows if k == q), reverse=True)):
            want[q, v] = i + 1
    assert got == want


@pytest.mark.parametrize("split_bytes", ["64", "1000", "128m"])
def test_number_lines_over_many_splits(spark, tmp_path, split_bytes):
    lines = [f"line {i} " + "x" * (i % 17) for i in range(400)]
    (tmp_path / "a.txt").write_text("\n".join(lines[:250]) + "\n")
    (tmp_path / "b.txt").write_text("\n".join(lines[250:]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        got = number_lines(spark.read.text(str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.value for r in sorted(got, key=lambda r: r.ordinal)] == lines
    assert sorted(r.ordinal for r in got) == list(range(400))


def test_running_total(spark):
    values = [(i, i * 31 % 7) for i in range(300)]
    df = spark.createDataFrame(values, "i long, v int").repartition(5)
    got = {r.i: r.before for r in running_total(df, "i", "v", "before", block=16).collect()}
    assert got == {i: sum(v for j, v in values if j < i) for i, _ in values}
