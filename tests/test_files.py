"""Text formats: written by hand or by our writers, read back."""

import bz2
import gzip
import json

import pytest
from pyspark.sql import functions as F

from rankflow import sinks, sources


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_quad_file_with_comments_and_bad_bytes(spark, tmp_path):
    line = '<http://dbpedia.org/resource/{}> <http://p/c> "text {}"@en <http://w/{}> .'
    body = b"# started\n" + line.format("A", "é�", "A").encode()
    body += b"\n" + line.format("B", "x", "B").encode().replace(b"text x", b"te\xffxt \xc3x")
    body += b"\n" + line.format("C", "q", "C").encode().replace(b"text q", "te�xt \x00".encode() + b"\xff\xe2\x82")
    body += b"\n# completed\n"
    path = tmp_path / "abstracts.tql.bz2"
    path.write_bytes(bz2.compress(body))
    parsed = sources.parse_quads(sources.read_quad_lines(spark, str(path)))
    assert values(parsed, "url_dbpedia", "abstract") == [
        ("http://dbpedia.org/resource/A", '"text é�"@en '),
        ("http://dbpedia.org/resource/B", '"text x"@en '),
        ("http://dbpedia.org/resource/C", '"te�xt \x00"@en '),
    ]


def test_run_round_trip(spark, tmp_path):
    run = spark.createDataFrame(
        [(0, "http://d/A", 1, 12.345678), (7, "http://d/B", 2, 0.5)],
        "query_index long, url_dbpedia string, hit int, score double",
    )
    sinks.write_run(run, str(tmp_path / "run"))
    assert sources.read_run(spark, str(tmp_path / "run")).exceptAll(run).isEmpty()
    assert "7 Q0 http://d/B 2 0.500000 bm25" in "".join(
        p.read_text() for p in (tmp_path / "run").glob("part-*")
    )


def test_grades_keep_quotes(spark, tmp_path):
    path = tmp_path / "grades.tsv"
    path.write_text('Q1\tQ0\t<dbpedia:"Heroes">\t2\nQ2\tQ0\t<dbpedia:B>\t0\n')
    assert values(sources.read_grades(spark, str(path)), "query_id", "dbpedia_entity", "qrel") == [
        ("Q1", '<dbpedia:"Heroes">', 2),
        ("Q2", "<dbpedia:B>", 0),
    ]


def test_grade_that_is_no_number_fails(spark, tmp_path):
    path = tmp_path / "grades.tsv"
    path.write_text("Q1\tQ0\t<dbpedia:A>\thigh\n")
    with pytest.raises(Exception):
        sources.read_grades(spark, str(path)).collect()


def test_queries_and_topics(spark, tmp_path):
    path = tmp_path / "queries.tsv"
    path.write_text('Q_b\tfirst "one"\n\nQ_a\tsecond\n')
    queries = sources.read_queries(spark, str(path))
    assert values(queries, "query_index", "query_id", "query_text") == [
        (0, "Q_b", 'first "one"'),
        (1, "Q_a", "second"),
    ]
    sinks.write_topics(queries, str(tmp_path / "topics"))
    topics = sources.read_topics(spark, str(tmp_path / "topics"))
    assert values(topics, "query_index", "query_text") == [(0, 'first "one"'), (1, "second")]


def test_article_grades(spark, tmp_path):
    path = tmp_path / "car.qrels"
    path.write_text("Q1 0 enwiki:New%20York+x 1\nQ2 0 enwiki:50%_off 0\n")
    got = values(sources.read_article_grades(spark, str(path)), "query_id", "title", "qrel")
    assert got == [("Q1", "New York+x", 1), ("Q2", "50%_off", 0)]


@pytest.mark.parametrize("spaced", [True, False])
def test_entity_names_with_commas_and_quotes(spark, tmp_path, spaced):
    names = ["<http://e/1>", "a, b", 'say "x", y', "back\\slash, z", "é", ",,", "", 'q\\", "r', "e\n,"]
    body = json.dumps(names, separators=None if spaced else (",", ":"), indent=1 if spaced else None)
    path = tmp_path / "names.json.gz"
    path.write_bytes(gzip.compress(body.encode()))
    got = sources.read_entity_names(spark, str(path))
    assert [r.entity for r in sorted(got.collect(), key=lambda r: r.entity_index)] == names
    assert sorted(r.entity_index for r in got.collect()) == list(range(len(names)))


def test_entity_names_empty(spark, tmp_path):
    path = tmp_path / "names.json"
    path.write_text("[]")
    assert sources.read_entity_names(spark, str(path)).collect() == []


def test_entity_vectors_skip_the_header(spark, tmp_path):
    path = tmp_path / "vectors.tsv.gz"
    path.write_bytes(gzip.compress(b"2\t3\nA\t0.1\t0.2\t0.3\nB\t1\t-2\t3e-1\n"))
    got = sources.read_entity_vectors(spark, str(path), dim=3)
    assert values(got, "entity", "biggraph_embedding") == [
        ("A", ["0.1", "0.2", "0.3"]),
        ("B", ["1", "-2", "3e-1"]),
    ]


def test_vectors_of_another_width_are_reported(spark, tmp_path):
    path = tmp_path / "vectors.tsv"
    path.write_text("2\t3\nA\t0.1\t0.2\t0.3\nB\t1\t2\nC\n")
    rejected = sources.rejected_entity_vectors(spark, str(path), dim=3)
    assert values(rejected, "value") == [("B\t1\t2",), ("C",)]
    with pytest.raises(Exception, match="not an entity and 3 numbers"):
        sources.read_entity_vectors(spark, str(path), dim=3).collect()
    path.write_text("")
    assert sources.read_entity_vectors(spark, str(path), dim=3).collect() == []


def test_names_with_an_open_quote_fail(spark, tmp_path):
    path = tmp_path / "names.json"
    path.write_text('["a", "b, "c"]')
    with pytest.raises(ValueError):
        sources.read_entity_names(spark, str(path))


def test_token_weights_keep_blank_lines(spark, tmp_path):
    path = tmp_path / "weights.txt"
    path.write_text("a 0.5 b nan\n\nc inf\n")
    rows = sorted(sources.read_token_weights(spark, str(path)).collect(), key=lambda r: r.ordinal)
    assert [r.ordinal for r in rows] == [0, 1, 2]
    assert [r.deepct_tokens for r in rows] == [["a", "b"], None, ["c"]]
    assert rows[0].deepct_weights[0] == 0.5 and rows[2].deepct_weights == [float("inf")]


def test_folds(spark, tmp_path):
    path = tmp_path / "folds.json"
    folds = {"0": {"training": ["a", "b"], "testing": ["c"]}, "1": {"training": [], "testing": ["a"]}}
    path.write_text(json.dumps(folds, indent=2))
    assert values(sources.read_folds(spark, str(path)), "fold", "split", "query_id") == [
        (0, "test", "c"),
        (0, "training", "a"),
        (0, "training", "b"),
        (1, "test", "a"),
    ]


def test_entity_lists(spark, tmp_path):
    path = tmp_path / "entities.json"
    path.write_text('{"entities": ["A", "B"]}\n{"entities": []}\n')
    assert [r.entities for r in sources.read_entity_lists(spark, str(path)).collect()] == [["A", "B"], []]


def test_search_documents(spark, tmp_path):
    corpus = spark.createDataFrame([("u", 'a "b"\nc')], "url_dbpedia string, abstract string")
    sinks.write_search_documents(corpus, str(tmp_path / "docs"), "url_dbpedia", "abstract")
    lines = "".join(p.read_text() for p in (tmp_path / "docs").glob("part-*")).splitlines()
    assert [json.loads(line) for line in lines] == [{"id": "u", "contents": 'a "b"\nc'}]


def test_entity_pages_csv(spark, tmp_path):
    pages = spark.createDataFrame(
        [("B", 'two\nlines, "quoted"'), ("A", None)], "entity string, document string"
    )
    sinks.write_entity_pages(pages, str(tmp_path / "pages"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    got = back.csv(str(tmp_path / "pages"))
    assert values(got, "row", "entity", "document") == [
        ("0", "A", None),
        ("1", "B", 'two\nlines, "quoted"'),
    ]


def test_parquet_compression_and_folds(spark, tmp_path):
    df = spark.createDataFrame([(0, "test", 1), (1, "training", 2)], "fold int, split string, v int")
    sinks.write_parquet(df, str(tmp_path / "t"), "gzip")
    assert list((tmp_path / "t").glob("*.gz.parquet"))
    sinks.write_folds(df, str(tmp_path / "folds"))
    assert (tmp_path / "folds" / "fold=0" / "split=test").is_dir()
    part = spark.read.parquet(str(tmp_path / "folds")).where("fold = 1")
    assert values(part, "split", "v") == [("training", 2)]


def test_materialise_builds_once_and_replaces_leftovers(spark, tmp_path):
    path = tmp_path / "stage"
    path.mkdir()
    (path / "part-0.parquet").write_text("left over by a failed run")
    calls = []

    def build():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert values(sinks.materialise(spark, str(path), build), "id") == [(0,), (1,), (2,)]
    assert len(calls) == 1


def test_a_stage_is_built_anew_for_other_parameters(spark, tmp_path):
    path = str(tmp_path / "stage")
    for k, rows in ((3, 3), (1, 1), (1, 5), (3, 2)):
        got = sinks.materialise(spark, path, lambda n=rows: spark.range(n), parameters={"k": k})
        assert got.count() == {(3, 3): 3, (1, 1): 1, (1, 5): 1, (3, 2): 2}[k, rows]
    assert got.dtypes == spark.range(1).dtypes
    assert [p.name for p in tmp_path.iterdir()] == ["stage"]  # nothing temporary stays


def test_fold_stage_replaces_leftovers(spark, tmp_path):
    df = spark.createDataFrame([(0, "test", 1), (1, "training", 2)], "fold int, split string, v int")
    left = tmp_path / "folds" / "fold=7"
    left.mkdir(parents=True)
    (left / "part-0.parquet").write_text("left over")
    got = sinks.materialise(spark, str(tmp_path / "folds"), lambda: df, write=sinks.write_folds)
    assert values(got, "fold", "split", "v") == [(0, "test", 1), (1, "training", 2)]


def test_read_table_reads_only_the_declared_columns(spark, tmp_path):
    spark.range(2).select("id", F.lit("x").alias("extra")).write.parquet(str(tmp_path / "t"))
    assert sources.read_table(spark, str(tmp_path / "t"), "id long").columns == ["id"]
