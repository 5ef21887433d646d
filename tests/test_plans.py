"""Whole pipelines on files written by hand."""

import gzip
import json
import os
import shutil
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.fixtures import letter_encoder
from rankflow.plans import knowledge_base as kb
from rankflow.plans import wiki
from rankflow.plans.inputs import KnowledgeBaseInputs, WikiInputs
from rankflow.sinks import writers

RES = "http://dbpedia.org/resource/"
TEXTS = {
    "Sky": "The sky is blue.",
    "Sea": "The sea is blue and deep.",
    "Fire": "Fire is red < hot >.",
    "Grass": "Grass is green.",
    "Snow": "Snow is white like no sky.",
}


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("kb")
    quad = '<{0}{1}> <http://p/c> "{2}"@en <http://en.wikipedia.org/wiki/{1}> .'
    lines = ["# begin", *(quad.format(RES, n, t) for n, t in TEXTS.items()), "broken line", "# end"]
    (at / "abstracts.tql").write_text("\n".join(lines) + "\n")
    (at / "queries.tsv").write_text("Q_a\tblue sky\nQ_b\tred\nQ_c\tis\n")
    grades = [("Q_a", "Sky", 2), ("Q_a", "Sea", 0), ("Q_a", "Snow", 0), ("Q_c", "Fire", 1), ("Q_c", "Grass", 1), ("Q_c", "Sky", 0)]
    (at / "grades.tsv").write_text("".join(f"{q}\tQ0\t<dbpedia:{e}>\t{g}\n" for q, e, g in grades))
    iri = "<http://www.wikidata.org/entity/{}>"
    (at / "names.json.gz").write_bytes(gzip.compress(json.dumps(["<x>", iri.format("Q1"), iri.format("Q2")]).encode()))
    vectors = f"2\t2\n{iri.format('Q1')}\t0.5\t1.5\n<x>\t9\t9\n"
    (at / "vectors.tsv.gz").write_bytes(gzip.compress(vectors.encode()))
    title_map = spark.createDataFrame([("Sky", "Q1"), ("Sea", "Q2")], "title string, wikidata_id string")
    title_map.write.parquet(str(at / "title_map"))
    folds = {"0": {"training": ["Q_c"], "testing": ["Q_a"]}, "1": {"training": ["Q_a"], "testing": ["Q_c"]}}
    (at / "folds.json").write_text(json.dumps(folds))
    # Judged queries Q_a (3 hits: Sky, Sea, Snow) and Q_c (5 hits).
    (at / "weights.txt").write_text("".join(f"t{i} 0.{i} u nan\n" for i in range(8)))
    return KnowledgeBaseInputs(
        quads=str(at / "abstracts.tql"),
        queries=str(at / "queries.tsv"),
        grades=str(at / "grades.tsv"),
        title_map=str(at / "title_map"),
        entity_names=str(at / "names.json.gz"),
        entity_vectors=str(at / "vectors.tsv.gz"),
        token_weights=str(at / "weights.txt"),
        folds=str(at / "folds.json"),
        vector_dim=2,
        weight_dim=2,
    )


@pytest.fixture(scope="module")
def out(tmp_path_factory):
    return str(tmp_path_factory.mktemp("stages"))


def test_candidate_folds(spark, files, out):
    rows = kb.fold_candidates(spark, files, out)
    assert kb.corpus(spark, files, out).count() == 5
    assert {(r.fold, r.split, r.query_id, r.n) for r in rows.groupBy("fold", "split", "query_id").agg(F.count("*").alias("n")).collect()} == {
        (0, "test", "Q_a", 3), (0, "training", "Q_c", 5), (1, "test", "Q_c", 5), (1, "training", "Q_a", 3),
    }
    first = rows.where("fold = 0 and ordinal = 0").first()
    assert (first.query_id, first.dbpedia_entity, first.hit, first.abstract) == ("Q_a", "<dbpedia:Sky>", 1, TEXTS["Sky"])
    assert (first.entity_index, first.biggraph_embedding) == (1, [0.5, 1.5])
    assert first.deepct_tokens == ["t0", "u"] and first.deepct_weights[0] == 0.0
    fire = rows.where("fold = 0 and dbpedia_entity = '<dbpedia:Fire>'").first()
    assert fire.abstract == TEXTS["Fire"] and fire.biggraph_embedding == [0.0, 0.0]


def test_triplets_of_folds(spark, files, out):
    """Q_c has two positives but one negative, so it is skipped."""
    got = kb.fold_triplets(spark, files, out).collect()
    assert {(r.fold, r.split, r.query_id, r.dbpedia_entity_x) for r in got} == {
        (0, "test", "Q_a", "<dbpedia:Sky>"), (1, "training", "Q_a", "<dbpedia:Sky>"),
    }
    assert {r.dbpedia_entity_y for r in got} <= {"<dbpedia:Sea>", "<dbpedia:Snow>"} and len(got) == 2


def test_scores_go_to_their_own_table(spark, files, out):
    experiments = [{"experiment": "letters@1", "load_encoder": letter_encoder}]
    first = kb.scores(spark, files, out, experiments, f"{out}/scores/1")
    assert first.count() == 8
    tests = kb.fold_scores(spark, files, first)
    assert {(r.fold, r.query_id) for r in tests.collect()} == {(0, "Q_a"), (1, "Q_c")}
    assert tests.count() == 8
    more = [*experiments, {"experiment": "letters@2", "load_encoder": letter_encoder}]
    second = kb.scores(spark, files, out, more, f"{out}/scores/2", existing=first)
    assert {r.experiment for r in second.collect()} == {"letters@2"}


def test_a_finished_stage_is_not_computed_again(spark, files, out):
    before = kb.candidates(spark, files, out).inputFiles()
    assert sorted(kb.candidates(spark, files, out).inputFiles()) == sorted(before)


def test_reports_of_rejects_and_skipped_queries(spark, files, out):
    assert [r.value for r in kb.rejects(spark, files, out).collect()] == ["broken line"]
    assert {(r.query_id, r.reason) for r in kb.skipped_queries(spark, files, out).collect()} == {
        ("Q_c", "too few negatives")
    }


def test_other_parameters_make_other_stages(spark, files, tmp_path):
    at = str(tmp_path)
    assert kb.run(spark, files, at, k=3).where("query_index = 2").count() == 3
    assert kb.run(spark, files, at, k=1).where("query_index = 2").count() == 1
    assert kb.candidates(spark, files, at, k=3).count() == 3 + 3
    assert kb.run(spark, files, at, k=3).where("query_index = 2").count() == 3


def test_repeated_titles_have_weights_of_their_own(spark, files, tmp_path):
    """The weight file has a line for each merged row, also where a title stands twice in its map."""
    title_map = spark.createDataFrame(
        [("Sky", "Q1"), ("Sky", "Q2"), ("Sea", "Q2")], "title string, wikidata_id string"
    )
    title_map.write.parquet(str(tmp_path / "titles"))
    lines = 8 + 2  # Sky is a hit of both judged queries
    (tmp_path / "weights.txt").write_text("".join(f"t{i} 0.{i} u nan\n" for i in range(lines)))
    inputs = replace(files, title_map=str(tmp_path / "titles"), token_weights=str(tmp_path / "weights.txt"))
    rows = kb.complete_candidates(spark, inputs, str(tmp_path / "out")).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(lines))
    assert [r.deepct_tokens[0] for r in rows] == [f"t{i}" for i in range(lines)]
    assert [(r.query_index, r.hit) for r in rows] == sorted((r.query_index, r.hit) for r in rows)
    assert {r.title_to_id_wikidata for r in rows if r.dbpedia_entity == "<dbpedia:Sky>"} == {"Q1", "Q2"}


def test_scores_with_vectors_take_the_head_of_the_inputs(spark, files, out, tmp_path):
    layers = [
        (0, [[0.1 * (i + j) for j in range(12)] for i in range(3)], [0.0, 0.1, 0.2]),
        (1, [[0.2 * (i - j) for j in range(3)] for i in range(8)], [0.0] * 8),
    ]
    head = spark.createDataFrame(layers, "layer int, w array<array<double>>, b array<double>")
    head.write.parquet(str(tmp_path / "head"))
    inputs = replace(files, head=str(tmp_path / "head"))
    experiments = [{"experiment": "letters@1", "load_encoder": letter_encoder, "graph": True, "weights": True}]
    scored = kb.scores(spark, inputs, str(tmp_path / "out"), experiments, str(tmp_path / "scores"))
    assert scored.count() == 8 and scored.where("score is null").isEmpty()
    wide = kb.wide_scores(spark, inputs, str(tmp_path / "out"), scored, "letters@1", "s")
    assert wide.where("s is not null").count() == 8


def test_wiki(spark, tmp_path):
    pages = spark.createDataFrame(
        [("7", "Blue+Sky", "the sky is blue"), ("8", "Red", "red fire")], "id string, title string, text string"
    )
    pages.write.parquet(str(tmp_path / "pages"))
    (tmp_path / "queries.tsv").write_text("Q_a\tblue\nQ_b\tfire\n")
    (tmp_path / "car.qrels").write_text("Q_a 0 enwiki:Blue+Sky 2\nQ_b 0 enwiki:Gone%20Page 1\n")
    inputs = WikiInputs(str(tmp_path / "pages"), str(tmp_path / "queries.tsv"), str(tmp_path / "car.qrels"))
    rows = wiki.candidates(spark, inputs, str(tmp_path / "out")).collect()
    assert {(r.query_id, r.id, r.hit, r.qrel) for r in rows} == {("Q_a", 7, 1, 2), ("Q_b", 8, 1, None)}


def test_search_inputs(spark, tmp_path):
    pages = spark.createDataFrame([("7", "t", "sky"), ("8", "u", None)], "id string, title string, text string")
    pages.write.parquet(str(tmp_path / "pages"))
    (tmp_path / "queries.tsv").write_text("Q_a\tblue\n")
    inputs = WikiInputs(str(tmp_path / "pages"), str(tmp_path / "queries.tsv"), "unused")
    wiki.write_search_inputs(spark, inputs, str(tmp_path / "out"))
    lines = sorted("".join(p.read_text() for p in (tmp_path / "out/search_documents").glob("part-*")).splitlines())
    assert [json.loads(x) for x in lines] == [{"id": "7", "contents": "sky"}, {"id": "8", "contents": None}]
    assert "".join(p.read_text() for p in (tmp_path / "out/topics").glob("part-*")) == "0\tblue\n"


def test_pages_of_entities(spark, tmp_path):
    (tmp_path / "entities.json").write_text('{"entities": ["A", "B", "A"]}\n{"entities": ["B"]}\n')
    pages = spark.createDataFrame([("1", "B", "text\nof B")], "id string, title string, text string")
    pages.write.parquet(str(tmp_path / "pages"))
    wiki.write_pages_of_entities(spark, str(tmp_path / "entities.json"), str(tmp_path / "pages"), str(tmp_path / "csv"))
    back = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv"))
    assert sorted((r.row, r.entity, r.document) for r in back.collect()) == [("0", "A", None), ("1", "B", "text\nof B")]


@pytest.fixture
def renewed(monkeypatch):
    """The names of the stages that are written, since the list was last cleared."""
    names = []
    finish = writers._finish

    def seen(spark, temporary, path, manifest):
        names.append(path.rsplit("/", 1)[1])
        return finish(spark, temporary, path, manifest)

    monkeypatch.setattr(writers, "_finish", seen)
    return names


def copied(files, folder):
    """The inputs as files of their own, which a test may change."""
    shutil.copytree(str(files.quads).rsplit("/", 1)[0], folder)
    names = [n for n, v in vars(files).items() if isinstance(v, str)]
    return replace(files, **{n: f"{folder}/{getattr(files, n).rsplit('/', 1)[1]}" for n in names})


def test_a_changed_file_renews_what_depends_on_it(spark, files, tmp_path, renewed):
    inputs, at = copied(files, tmp_path / "in"), str(tmp_path / "out")

    def changed_by(change):
        change()
        del renewed[:]
        kb.fold_candidates(spark, inputs, at)
        kb.fold_triplets(spark, inputs, at)
        return set(renewed)

    everything = changed_by(lambda: None)
    assert {"corpus", "index", "run", "candidates", "entities", "fold_triplets"} <= everything
    assert changed_by(lambda: None) == set()

    late = {"candidates_complete", "fold_candidates", "triplets", "fold_triplets"}
    grades = tmp_path / "in" / "grades.tsv"
    got = changed_by(lambda: grades.write_text(grades.read_text().replace("Snow>\t0", "Snow>\t1")))
    assert got == {"grades", "candidates", "entities", "candidates_vec", *late}
    weights = tmp_path / "in" / "weights.txt"
    assert changed_by(lambda: weights.write_text(weights.read_text().replace("t0", "s0"))) == {"token_weights", *late}
    folds = tmp_path / "in" / "folds.json"
    assert changed_by(lambda: folds.write_text(folds.read_text() + "\n")) == {"folds", "fold_candidates", "fold_triplets"}
    title_map = spark.createDataFrame([("Sky", "Q2")], "title string, wikidata_id string")
    got = changed_by(lambda: title_map.write.mode("overwrite").parquet(inputs.title_map))
    assert got == {"entities", "candidates_vec", *late}
    # The same time and size under the same name: taken for the same file. Another time is another file.
    assert changed_by(lambda: os.utime(inputs.quads, (1, 1))) == everything - {
        "queries", "grades", "entity_names", "entity_vectors", "token_weights", "folds",
    }


def test_a_stage_made_again_from_the_same_things_renews_nothing(spark, files, tmp_path, renewed):
    inputs, at = copied(files, tmp_path / "in"), str(tmp_path / "out")
    kb.candidates(spark, inputs, at)
    del renewed[:]
    os.remove(f"{at}/run/_SUCCESS")  # a stage that was lost
    kb.candidates(spark, inputs, at)
    assert renewed == ["run"]


def test_scores_are_renewed_by_all_that_decides_them(spark, files, tmp_path, renewed):
    at, path = str(tmp_path / "out"), str(tmp_path / "scores")
    head = [(np.ones((2, 12)) / 10, np.zeros(2)), (np.ones((8, 2)), np.zeros(8))]
    base = {"experiment": "m", "load_encoder": letter_encoder, "head": head, "graph": True, "weights": True}

    def scored(**other):
        existing = other.pop("existing", None)
        del renewed[:]
        rows = kb.scores(spark, files, at, [base | other], path, existing=existing)
        rows = {(r.query_id, r.dbpedia_entity): round(r.score, 9) for r in rows.collect()}
        return "scores" in renewed, rows

    new, first = scored()
    assert new and scored() == (False, first)
    other_head = [(np.ones((2, 12)) / 10, np.zeros(2)), (np.ones((8, 2)) * 2, np.zeros(8))]
    narrow = [(np.ones((2, 10)) / 10, np.zeros(2)), (np.ones((8, 2)), np.zeros(8))]
    for other in ({"metric": "cosine"}, {"head": other_head}, {"weights": False, "head": narrow}, {"experiment": "n"}):
        new, rows = scored(**other)
        assert new and len(rows) == 8
        assert other == {"experiment": "n"} or rows != first
    assert scored()[0]
    keep = kb.scores(spark, files, at, [base], path).where("query_id = 'Q_a'")
    keep.write.parquet(str(tmp_path / "keep"))
    new, rows = scored(existing=spark.read.parquet(str(tmp_path / "keep")))
    assert new and {q for q, _ in rows} == {"Q_c"}


def test_scores_are_kept_between_runs(spark, files, tmp_path):
    at = str(tmp_path / "out")
    first = {"experiment": "m@1", "load_encoder": letter_encoder, "encoder": "letters@1"}
    rows, version = kb.append_scores(spark, files, at, [first])
    assert version == 1 and rows.count() == 8
    rows, version = kb.append_scores(spark, files, at, [first])
    assert version == 1 and rows.count() == 8
    rows, version = kb.append_scores(spark, files, at, [first, first | {"experiment": "m@2", "metric": "manhattan"}])
    assert version == 2 and rows.groupBy("experiment").count().count() == 2 and rows.count() == 16


def test_broken_lines_are_kept_beside_the_stages(spark, files, tmp_path):
    inputs, at = copied(files, tmp_path / "in"), str(tmp_path / "out")
    with open(inputs.grades, "a") as f:
        f.write("Q_a\tQ0\t<dbpedia:Snow>\n\nQ_a\tQ0\t<dbpedia:Snow>\tgood\n")
    with open(inputs.queries, "a") as f:
        f.write("Q_d without a tab\n")
    assert kb.fold_candidates(spark, inputs, at).count() == kb.fold_candidates(spark, files, str(tmp_path / "o")).count()
    got = kb.source_rejects(spark, at).collect()
    assert {(r.stage, r.line, r.reason) for r in got} == {
        ("grades", 6, "not four fields"), ("grades", 8, "the grade is no number"), ("queries", 3, "no text"),
    }
    assert writers.stage_counts(spark, f"{at}/grades") == {"rows": 6, "not four fields": 1, "the grade is no number": 1}
    assert {r.file.rsplit("/", 1)[1] for r in got} == {"grades.tsv", "queries.tsv"}
