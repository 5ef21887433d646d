import datetime
import decimal

import pytest
from pyspark.sql import functions as F

from rankflow.operators import difference
from rankflow.operators.difference import table_diff

SCHEMA = (
    "i long, s string, d double, f float, b binary, t timestamp, n decimal(10,2), day date, flag boolean,"
    " a array<string>, m map<string, array<int>>, r struct<x: int, y: string, z: array<double>>"
)
NOW = datetime.datetime(2020, 1, 1, 0, 0, 0, 1)


def row(**changed):
    base = {
        "i": 1, "s": "x", "d": 0.5, "f": 0.25, "b": b"\x00\xff", "t": NOW, "n": decimal.Decimal("1.10"),
        "day": datetime.date(2020, 1, 1), "flag": True, "a": ["p", "q"], "m": {"k": [1, 2], "l": []},
        "r": (1, "y", [1.0]),
    }
    return tuple((base | changed).values())


def different(spark, left, right):
    return table_diff(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).count()


@pytest.mark.parametrize(
    "change",
    [
        {"i": 2}, {"i": None}, {"s": ""}, {"s": None}, {"s": "-"}, {"d": 0.5000000001}, {"d": float("nan")}, {"f": 0.5},
        {"b": b"\x00\xfe"}, {"t": NOW + datetime.timedelta(microseconds=1)}, {"n": decimal.Decimal("1.11")},
        {"day": None}, {"flag": False}, {"a": ["p:q"]}, {"a": ["pq"]}, {"a": ["p", None]}, {"a": []}, {"a": None},
        {"m": {"k": [1], "l": [2]}}, {"m": {}}, {"m": None}, {"m": {"k": [1, 2], "l": None}},
        {"r": (1, None, [1.0])}, {"r": None}, {"r": (None, None, None)}, {"r": (1, "y", [])},
    ],
)
def test_rows_that_differ_in_one_value(spark, change):
    assert different(spark, [row()], [row(**change)]) == 2
    assert different(spark, [row(**change)], [row(**change)]) == 0


def test_values_that_are_equal(spark):
    assert different(spark, [row(d=0.0, f=0.0)], [row(d=-0.0, f=-0.0)]) == 0
    assert different(spark, [row(d=float("nan"))], [row(d=float("nan"))]) == 0
    assert different(spark, [row(m={"k": [1], "l": [2]})], [row(m={"l": [2], "k": [1]})]) == 0


def test_values_do_not_run_into_each_other(spark):
    left = spark.createDataFrame([("a", "b:c"), ("1:a", ""), (None, "x")], "p string, q string")
    right = spark.createDataFrame([("a:b", "c"), ("", "1:a"), ("x", None)], "p string, q string")
    assert table_diff(left, right).count() == 6


def test_copies_and_names(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (3, "c")], "id long, `_print` string")
    right = spark.createDataFrame([(2, "b"), (4, "d"), (5, None), (5, None)], "other long, name string")
    right = right.withColumnRenamed("name", "_text")
    got = table_diff(left.withColumnRenamed("_print", "v"), right)
    assert got.columns == ["id", "v"] and sorted(map(tuple, got.collect())) == [(1, "a"), (4, "d")]
    assert table_diff(left.limit(0), left.limit(0)).isEmpty()


def test_fingerprints_that_unlike_rows_share(spark, monkeypatch):
    """With sixteen fingerprints in all, rows are told apart by their text."""
    monkeypatch.setattr(difference, "fingerprint", lambda text: F.unhex(F.substring(F.md5(text), 1, 1)))
    left = spark.range(200).select("id", F.concat(F.lit("v"), "id").alias("v"))
    right = spark.range(190, 210).select("id", F.concat(F.lit("v"), "id").alias("v"))
    got = table_diff(left.union(left.where("id = 7")), right)
    assert sorted(r.id for r in got.collect()) == [i for i in [*range(190), *range(200, 210)] if i != 7]


def test_rows_that_are_equal_on_both_sides_are_not_shuffled(spark):
    left = spark.range(1000).select("id", F.repeat(F.lit("x"), 100).alias("payload"))
    got = table_diff(left, left.union(spark.createDataFrame([(5000, "new")], left.schema)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Aggregate" not in plan
    assert [tuple(r) for r in got.collect()] == [(5000, "new")]


def test_types_without_an_order_of_values_are_refused(spark):
    odd = spark.sql("select parse_json('{}') as v")
    with pytest.raises(TypeError, match="variant"):
        table_diff(odd, odd)
