import pytest
from pyspark.sql import functions as F

from rankflow.operators import candidates as cand
from rankflow.operators import difference, entities, folds

RES = "http://dbpedia.org/resource/"


@pytest.fixture(scope="module")
def tables(spark):
    run = spark.createDataFrame(
        [(0, RES + "A", 1, 9.0), (0, RES + "B", 2, 8.0), (0, RES + "Gone", 3, 7.0), (1, RES + "A", 1, 5.0)],
        "query_index long, url_dbpedia string, hit int, score double",
    )
    corpus = spark.createDataFrame(
        [(RES + n, "p", f'"{n} text"@en ', "w/" + n) for n in ("A", "B", "C")],
        "url_dbpedia string, predicate string, abstract string, url_wikipedia string",
    )
    queries = spark.createDataFrame(
        [(0, "Q0", "zero"), (1, "Q1", "one")], "query_index long, query_id string, query_text string"
    )
    grades = spark.createDataFrame(
        [("Q0", "<dbpedia:A>", 2), ("Q0", "<dbpedia:A>", 1), ("Q0", "<dbpedia:C>", 0), ("Q9", "<dbpedia:A>", 1)],
        "query_id string, dbpedia_entity string, qrel int",
    )
    return run, corpus, queries, grades


def test_candidates(tables):
    """No text for 'Gone', no grades for Q1, two grades for A, none for B."""
    built = cand.build_candidates(*tables)
    assert built.columns == list(cand.CANDIDATE_COLUMNS)
    rows = [(r.query_id, r.dbpedia_entity, r.hit, r.qrel) for r in cand.sort_candidates(built).collect()]
    assert sorted(rows, key=str) == sorted(
        [("Q0", "<dbpedia:A>", 1, 2), ("Q0", "<dbpedia:A>", 1, 1), ("Q0", "<dbpedia:B>", 2, None)], key=str
    )


def test_clean_abstracts(tables):
    built = cand.clean_abstracts(cand.build_candidates(*tables))
    assert {r.abstract for r in built.collect()} == {"A text", "B text"}


def test_vectors_of_known_and_unknown_entities(spark, tables):
    built = cand.build_candidates(*tables)
    title_map = spark.createDataFrame([("A", "Q10")], "title string, wikidata_id string")
    names = spark.createDataFrame(
        [("<http://www.wikidata.org/entity/Q10>", 5)], "entity string, entity_index long"
    )
    stored = spark.createDataFrame(
        [("<http://www.wikidata.org/entity/Q10>", ["1.5", "2"]), ("<other>", ["7", "7"])],
        "entity string, biggraph_embedding array<string>",
    )
    titled = cand.attach_entity_index(cand.attach_wikidata(built, title_map), names)
    filled = cand.fill_vectors(cand.attach_vectors(titled, stored), 2)
    got = {(r.dbpedia_entity, r.title_to_id_wikidata, r.entity_index, tuple(r.biggraph_embedding)) for r in filled.collect()}
    assert got == {
        ("<dbpedia:A>", "Q10", 5, (1.5, 2.0)),
        ("<dbpedia:B>", None, None, (0.0, 0.0)),
    }
    assert [r.entity for r in cand.needed_vectors(titled, stored).collect()] == [
        "<http://www.wikidata.org/entity/Q10>"
    ]


def test_weights_by_position(spark, tables):
    numbered = cand.number_candidates(cand.build_candidates(*tables))
    weights = spark.createDataFrame(
        [(i, [f"t{i}"], [i / 10]) for i in range(3)],
        "ordinal long, deepct_tokens array<string>, deepct_weights array<double>",
    )
    rows = cand.attach_token_weights(numbered, weights).orderBy("ordinal").collect()
    assert [(r.ordinal, r.hit, r.deepct_tokens) for r in rows] == [(0, 1, ["t0"]), (1, 1, ["t1"]), (2, 2, ["t2"])]
    with pytest.raises(ValueError):
        cand.attach_token_weights(numbered, weights.where("ordinal > 0"))
    twice = weights.withColumn("ordinal", F.greatest("ordinal", F.lit(1)).cast("long"))
    with pytest.raises(ValueError):  # as many lines, but one number twice
        cand.attach_token_weights(numbered, twice)


def test_wiki_candidates(spark):
    run = spark.createDataFrame([(0, "5", 1, 2.0)], "query_index long, id string, hit int, score double")
    queries = spark.createDataFrame([(0, "Q0", "zero")], "query_index long, query_id string, query_text string")
    pages = spark.createDataFrame([("05", "T", "text")], "id string, title string, text string")
    grades = spark.createDataFrame([("Q0", "T", 1)], "query_id string, title string, qrel int")
    row = cand.build_wiki_candidates(run, queries, pages, grades).first()
    assert (row.id, row.title, row.query_string, row.qrel) == (5, "T", "zero", 1)


def test_folds(spark, tables):
    built = cand.build_candidates(*tables)
    members = spark.createDataFrame(
        [(0, "test", "Q0"), (1, "training", "Q0"), (1, "test", "Q1")], "fold int, split string, query_id string"
    )
    rows = folds.split_folds(built, members)
    assert {(r.fold, r.split, r.n_rows) for r in folds.fold_counts(rows).collect()} == {(0, "test", 3), (1, "training", 3)}
    assert folds.fold_part(built, members, 1, "test").isEmpty()
    assert folds.fold_part(built, members, 0, "test").count() == 3
    checkpoints = spark.createDataFrame([("m@1", 0), ("m@2", 0)], "experiment string, train_fold int")
    grid = folds.experiment_grid(checkpoints, [0, 1])
    work = {(r.experiment, r.fold, r.seen_in_training, r.n_rows) for r in folds.grid_work(grid, rows).collect()}
    assert work == {(m, f, f != 0, 3 if f == 0 else 0) for m in ("m@1", "m@2") for f in (0, 1)}


def test_entity_pages_and_unmatched(spark):
    lists = spark.createDataFrame([(["A", "B", "A"],), ([],), (["B"],)], "entities array<string>")
    named = entities.distinct_entities(lists)
    pages = spark.createDataFrame([("1", "A", "text A")], "id string, title string, text string")
    assert {(r.entity, r.document) for r in entities.entity_pages(named, pages).collect()} == {("A", "text A"), ("B", None)}
    grades = spark.createDataFrame([("Q", "A", 1), ("Q", "Z", 1), ("R", "Z", 0)], "query_id string, title string, qrel int")
    assert entities.unmatched_grades(grades, pages).count() == 2
    row = entities.unmatched_ratio(grades, pages.unionAll(pages)).first()
    assert (row.n_unmatched, row.n_grades, row.ratio) == (2, 3, pytest.approx(2 / 3))


def test_table_diff_drops_rows_that_repeat_in_one_table(spark):
    left = spark.createDataFrame([(1, "a"), (2, None), (2, None), (3, "c")], "i int, s string")
    right = spark.createDataFrame([(1, "a"), (4, "d")], "i int, s string")
    assert {(r.i, r.s) for r in difference.table_diff(left, right).collect()} == {(3, "c"), (4, "d")}


def test_entity_table_equals_joins_per_candidate(spark, tables):
    built = cand.build_candidates(*tables)
    title_map = spark.createDataFrame([("A", "Q10"), ("A", "Q11")], "title string, wikidata_id string")
    iri = "<http://www.wikidata.org/entity/Q10>"
    names = spark.createDataFrame([(iri, 5), (iri, 6)], "entity string, entity_index long")
    stored = spark.createDataFrame([(iri, ["1"])], "entity string, biggraph_embedding array<string>")
    one = cand.attach_entity_index(cand.attach_wikidata(built, title_map), names)
    one = cand.attach_vectors(one, stored)
    other = cand.attach_entities(built, cand.entity_table(built, title_map, names, stored))
    assert set(one.columns) == set(other.columns)
    assert sorted(one.select(*other.columns).collect(), key=str) == sorted(other.collect(), key=str)
    assert other.count() == 2 * 3 + 1
