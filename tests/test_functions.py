import math
import sys
from urllib.parse import unquote

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankflow.functions import text, vectors
from rankflow.sources import parse_quads, rejected_quads


def one(spark, column, **values):
    names = ", ".join(f"{n} {t}" for n, (t, _) in values.items())
    df = spark.createDataFrame([tuple(v for _, v in values.values())], names)
    return df.select(column.alias("x")).first()["x"]


QUAD = '<http://dbpedia.org/resource/A> <http://p/comment> "{}"@en <http://en.wikipedia.org/wiki/A> .'


@pytest.mark.parametrize("literal", ["plain", "a < b > c", 'x "quoted" y', "1> <2> 3", ""])
def test_quad_with_marks_inside_the_literal(spark, literal):
    lines = spark.createDataFrame([(QUAD.format(literal),)], "value string")
    row = parse_quads(lines).first()
    assert row.url_dbpedia == "http://dbpedia.org/resource/A"
    assert row.predicate == "http://p/comment"
    assert row.abstract == f'"{literal}"@en '
    assert row.url_wikipedia == "http://en.wikipedia.org/wiki/A"


def test_rejected_quads_are_kept_apart(spark):
    lines = spark.createDataFrame([(QUAD.format("x"),), ("no quad",), ("",)], "value string")
    assert parse_quads(lines).count() == 1
    assert sorted(r.value for r in rejected_quads(lines).collect()) == ["", "no quad"]


def test_entity_key_title_and_iri(spark):
    url = "http://dbpedia.org/resource/a resource/Big Apple"
    key = one(spark, text.entity_key(F.col("u")), u=("string", url))
    assert key == "<dbpedia:" + url.split("resource/")[-1] + ">"
    assert one(spark, text.entity_title(F.col("k")), k=("string", key)) == key[9:-1].replace(" ", "_")
    assert one(spark, text.entity_title(F.col("k")), k=("string", "short")) == "short"[9:-1]
    assert one(spark, text.wikidata_iri(F.col("i")), i=("string", None)) is None
    assert (
        one(spark, text.wikidata_iri(F.col("i")), i=("string", "Q1"))
        == "<http://www.wikidata.org/entity/Q1>"
    )


@pytest.mark.parametrize(
    "literal", ['"abc"@en ', '"a"@en b"@en ', '"no tag', '"', "", '"x"@de ', '"q "in" q"@en ']
)
def test_clean_literal(spark, literal):
    got = one(spark, text.clean_literal(F.col("a")), a=("string", literal))
    assert got == literal[1:].split('"@en ')[0]


@pytest.mark.parametrize(
    "article",
    ["enwiki:A%20B", "enwiki:C++", "enwiki:100%", "enwiki:%zz%20x", "enwiki:%C3%A9t%c3%a9", "enwiki:a%2"],
)
def test_article_title_decodes_like_unquote(spark, article):
    got = one(spark, text.article_title(F.col("a")), a=("string", article))
    assert got == unquote(article.split("enwiki:")[1])


def test_tokens(spark):
    got = one(spark, text.tokens(F.col("t")), t=("string", "  Ärger, 2-mal\nAB's "))
    assert got == ["ärger", "2", "mal", "ab", "s"]


def test_fill_and_cast(spark):
    filled = vectors.to_doubles(vectors.zero_fill(F.col("v"), 3))
    assert one(spark, filled, v=("array<string>", None)) == [0.0, 0.0, 0.0]
    assert one(spark, filled, v=("array<string>", ["1", "-2.5"])) == [1.0, -2.5]


def test_finite(spark):
    top = sys.float_info.max
    got = one(
        spark,
        vectors.finite(F.col("v"), 6),
        v=("array<double>", [1.5, float("nan"), float("inf"), float("-inf"), None]),
    )
    assert got == [1.5, 0.0, top, -top, 0.0, 0.0]
    assert one(spark, vectors.finite(F.col("v"), 2), v=("array<double>", None)) == [0.0, 0.0]


def test_longer_weights_are_not_cut(spark):
    with pytest.raises(Exception, match="3 items where 2 are expected"):
        one(spark, vectors.finite(F.col("v"), 2), v=("array<double>", [1.0, 2.0, 3.0]))


@pytest.mark.parametrize("name", list(vectors.DISTANCES))
def test_distances_of_unequal_lengths_fail(spark, name):
    distance = vectors.DISTANCES[name](F.col("a"), F.col("b"))
    with pytest.raises(Exception, match="vectors of 2 and 1 numbers"):
        one(spark, distance, a=("array<double>", [1.0, 2.0]), b=("array<double>", [1.0]))
    assert one(spark, distance, a=("array<double>", None), b=("array<double>", [1.0])) is None


def test_deinterleave(spark):
    items = ["a", "0.5", "b", "nan", "c", "?"]
    assert one(spark, vectors.even_items(F.col("i")), i=("array<string>", items)) == ["a", "b", "c"]
    weights = one(
        spark, vectors.to_weights(vectors.odd_items(F.col("i"))), i=("array<string>", items)
    )
    assert weights[0] == 0.5 and math.isnan(weights[1]) and weights[2] is None


numbers = st.floats(-100, 100, allow_nan=False)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(numbers, numbers), min_size=1, max_size=6))
def test_distances(spark, pairs):
    a, b = (np.array(v) for v in zip(*pairs))
    values = {"a": ("array<double>", a.tolist()), "b": ("array<double>", b.tolist())}
    got = {n: one(spark, d(F.col("a"), F.col("b")), **values) for n, d in vectors.DISTANCES.items()}
    gap = a - b + 1e-6
    assert got["euclidean"] == pytest.approx(np.sqrt((gap**2).sum()), abs=1e-9)
    assert got["manhattan"] == pytest.approx(np.abs(gap).sum(), abs=1e-9)
    norms = max(np.linalg.norm(a), 1e-8) * max(np.linalg.norm(b), 1e-8)
    assert got["cosine"] == pytest.approx(1 - (a @ b) / norms, abs=1e-9)
    assert got["euclidean"] >= 0 and got["manhattan"] >= 0


def test_score_name():
    assert text.score_name("m", True, False) == "score_m_True_False"
