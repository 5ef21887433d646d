import gzip

import pytest

from rankflow import sources


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def rejects(checked):
    return [(r.line, r.reason, r.value) for r in checked.rejects.orderBy("file", "line").collect()]


def good_and_bad(checked):
    bad = sum(n for why, n in checked.counts.items() if why != "rows")
    assert checked.rows.count() == checked.counts["rows"] and checked.rejects.count() == bad
    return checked


def test_run(spark, tmp_path):
    lines = ["0 Q0 a 1 2.5 t", "", "x Q0 a 1 2.5 t", "1 Q0 b 2", "1 Q0 b two 1 t", "1 Q0 b 2 ? t", "1\tQ0\tb\t2\t1e3\tt"]
    (tmp_path / "run").write_text("\n".join(lines))
    got = good_and_bad(sources.checked_run(spark, str(tmp_path / "run")))
    assert values(got.rows, "query_index", "url_dbpedia", "hit", "score") == [(0, "a", 1, 2.5), (1, "b", 2, 1000.0)]
    assert rejects(got) == [
        (2, "the query is no number", lines[2]), (3, "not six fields", lines[3]),
        (4, "the rank is no number", lines[4]), (5, "the score is no number", lines[5]),
    ]
    assert got.rows.schema == sources.read_run(spark, str(tmp_path / "run")).schema


def test_good_files_give_what_the_plain_readers_give(spark, tmp_path):
    (tmp_path / "g").write_text('q\tQ0\t"e"\t2\nq\tQ0\tf\t-1\n')
    (tmp_path / "q").write_text("a\tx y\n\nb\tz\tmore\n")
    (tmp_path / "c").write_text("Q 0 enwiki:A%20b+c 2\n")
    (tmp_path / "w").write_text("a 0.5 b nan\n\nc inf\n")
    (tmp_path / "l").write_text('{"entities": ["A", "B"]}\n{"entities": []}\n')
    (tmp_path / "f").write_text('{"0": {"training": ["a"], "testing": ["b", "c"]}, "1": {"training": [], "testing": ["a"]}}')
    pairs = [
        (sources.checked_grades, sources.read_grades, "g"),
        (sources.checked_queries, sources.read_queries, "q"),
        (sources.checked_article_grades, sources.read_article_grades, "c"),
        (sources.checked_token_weights, sources.read_token_weights, "w"),
        (sources.checked_entity_lists, sources.read_entity_lists, "l"),
        (sources.checked_folds, sources.read_folds, "f"),
    ]
    for checked, plain, name in pairs:
        got, want = good_and_bad(checked(spark, str(tmp_path / name))), plain(spark, str(tmp_path / name))
        assert got.rows.columns == want.columns and got.rows.dtypes == want.dtypes
        assert sorted(map(str, got.rows.collect())) == sorted(map(str, want.collect()))
        assert got.rejects.isEmpty()


def test_grades_and_article_grades(spark, tmp_path):
    (tmp_path / "g").write_text("q\tQ0\te\t2\nq\tQ0\te\nq\tQ0\te\tx\n")
    assert rejects(good_and_bad(sources.checked_grades(spark, str(tmp_path / "g")))) == [
        (1, "not four fields", "q\tQ0\te"), (2, "the grade is no number", "q\tQ0\te\tx"),
    ]
    (tmp_path / "c").write_text("Q 0 enwiki:A\nQ 0 enwiki:A b\nQ 0 enwiki:A 1\n")
    got = good_and_bad(sources.checked_article_grades(spark, str(tmp_path / "c")))
    assert [r[:2] for r in rejects(got)] == [(0, "not four fields"), (1, "the grade is no number")]
    assert values(got.rows, "title", "qrel") == [("A", 1)]


def test_numbers_of_lines_stand_after_broken_ones(spark, tmp_path):
    folder = tmp_path / "queries"
    folder.mkdir()
    (folder / "a.tsv").write_text("q0\tzero\n\nbroken\nq2\ttwo\n\tno id\n")
    (folder / "b.tsv.gz").write_bytes(gzip.compress(b"q4\tfour\n"))
    got = good_and_bad(sources.checked_queries(spark, str(folder)))
    assert values(got.rows, "query_index", "query_id") == [(0, "q0"), (2, "q2"), (4, "q4")]
    assert rejects(got) == [(2, "no text", "broken"), (4, "no query id", "\tno id")]
    assert {r.file.rsplit("/", 1)[1] for r in got.rejects.collect()} == {"a.tsv"}


def test_numbers_over_many_splits(spark, tmp_path):
    rows = [f"q{i}\ttext {i}" if i % 7 else ("" if i % 2 else "broken") for i in range(3000)]
    (tmp_path / "q").write_text("\n".join(rows))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = good_and_bad(sources.checked_queries(spark, str(tmp_path / "q")))
        found = dict(values(got.rows, "query_id", "query_index"))
        bad = [r[0] for r in rejects(got)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    kept = [r for r in rows if r]
    assert found == {r.split("\t")[0]: i for i, r in enumerate(kept) if "\t" in r}
    assert bad == [i for i, r in enumerate(rows) if r == "broken"]


def test_token_weights(spark, tmp_path):
    (tmp_path / "w").write_text("a 0.5 b\n\nc x\nd 1\n")
    got = good_and_bad(sources.checked_token_weights(spark, str(tmp_path / "w")))
    assert [(r.ordinal, r.deepct_tokens, r.deepct_weights) for r in got.rows.orderBy("ordinal").collect()] == [
        (1, None, None), (3, ["d"], [1.0]),
    ]
    assert rejects(got) == [(0, "a token without a weight", "a 0.5 b"), (2, "a weight is no number", "c x")]


def test_entity_lists(spark, tmp_path):
    (tmp_path / "l").write_text('{"entities": ["A"]}\n{"entities": "A"}\n{"other": 1}\nnot json\n{"entities": ["A"\n')
    got = good_and_bad(sources.checked_entity_lists(spark, str(tmp_path / "l")))
    assert [r.entities for r in got.rows.collect()] == [["A"]]
    assert [r[0] for r in rejects(got)] == [1, 2, 3, 4]


def test_folds(spark, tmp_path):
    (tmp_path / "f").write_text(
        '{"0": {"training": ["a"], "testing": ["b"]}, "one": {"training": [], "testing": []}, "2": {"training": ["a"]}}'
    )
    got = good_and_bad(sources.checked_folds(spark, str(tmp_path / "f")))
    assert values(got.rows, "fold", "split", "query_id") == [(0, "test", "b"), (0, "training", "a")]
    assert [r[:2] for r in rejects(got)] == [(1, "the fold is no number"), (2, "a list is missing")]
    (tmp_path / "g").write_text("[1, 2")
    got = good_and_bad(sources.checked_folds(spark, str(tmp_path / "g")))
    assert got.rows.isEmpty() and rejects(got) == [(0, "not a JSON object of folds", "[1, 2")]


@pytest.mark.parametrize("reader", ["run", "grades", "queries", "article_grades", "token_weights", "entity_lists"])
def test_empty_files(spark, tmp_path, reader):
    (tmp_path / "e").write_text("")
    got = getattr(sources, f"checked_{reader}")(spark, str(tmp_path / "e"))
    assert got.rows.isEmpty() and got.rejects.isEmpty() and got.counts == {"rows": 0}


def test_one_scan_of_the_files(spark, tmp_path, monkeypatch):
    """Rows, rejects and counts all come from what was landed."""
    (tmp_path / "g").write_text("q\tQ0\te\t2\nbroken\n")
    got = sources.checked_grades(spark, str(tmp_path / "g"))
    (tmp_path / "g").unlink()
    assert got.rows.count() == 1 and got.rejects.count() == 1
