import numpy as np
import pytest

from checks.fixtures import letter_encoder
from rankflow.operators import scoring
from rankflow.operators.vector_store import VectorStore
from rankflow.session import hadoop_path
from rankflow.sinks import snapshots
from rankflow.sinks.snapshots import Conflict, SnapshotTable

SCHEMA = "k string, n long"


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, str(tmp_path / "table"), SCHEMA)


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def seen(df):
    return sorted(tuple(r) for r in df.collect())


def test_an_empty_table_has_its_columns(table):
    assert table.version() == 0 and table.versions() == []
    assert table.read().columns == ["k", "n", "snapshot"] and table.read().isEmpty()
    assert table.newest(["k"]).isEmpty()


def test_readers_are_pinned(spark, table):
    assert table.append(rows(spark, ("a", 1), ("b", 1))) == 1
    early = table.read()
    pinned = table.read(1)
    assert table.append(rows(spark, ("b", 2), ("c", 2), (None, 2)).select("n", "k"), {"why": "more"}) == 2
    assert seen(early) == seen(pinned) == [("a", 1, 1), ("b", 1, 1)]
    assert table.versions() == [1, 2] and table.read().count() == 5
    newest = {(r.k, r.n, r.snapshot) for r in table.newest(["k"]).collect()}
    assert newest == {("a", 1, 1), ("b", 2, 2), ("c", 2, 2), (None, 2, 2)}
    assert seen(table.newest(["k"], 1)) == seen(pinned)
    assert [(p["version"], p["rows"], p["note"]) for p in table.parts(2)] == [(1, 2, {}), (2, 3, {"why": "more"})]


def test_the_greatest_of_several_rows_of_one_snapshot(spark, table):
    table.append(rows(spark, ("a", 1), ("a", 3), ("a", None), ("a", 2)))
    assert seen(table.newest(["k"])) == [("a", 3, 1)]


def test_two_writers_lose_nothing(spark, table, monkeypatch):
    """The second commits between the first one's look at the versions and its rename."""
    other = SnapshotTable(spark, table.path, SCHEMA)
    write, looked = snapshots.write_json, []

    def late(spark_, path, value):
        write(spark_, path, value)
        if not looked:
            looked.append(value["version"])
            other.append(rows(spark, ("other", 2)))

    monkeypatch.setattr(snapshots, "write_json", late)
    assert table.append(rows(spark, ("mine", 1))) == 2
    assert looked == [1]
    assert seen(table.read()) == [("mine", 1, 2), ("other", 2, 1)]
    assert seen(table.read(1)) == [("other", 2, 1)]


def test_a_stopped_writer_leaves_nothing_that_is_read(spark, table, monkeypatch):
    table.append(rows(spark, ("a", 1)))

    def stop(*_):
        raise KeyboardInterrupt

    for step in ("_rename_once", "write_json"):
        with monkeypatch.context() as m:
            m.setattr(snapshots, step, stop)
            with pytest.raises(KeyboardInterrupt):
                table.append(rows(spark, ("half", 2)))
    with pytest.raises(Exception, match="stopped"):
        table.append(rows(spark, ("half", 3)).selectExpr("k", "cast(raise_error('stopped') as bigint) as n"))
    assert table.version() == 1 and seen(table.read()) == [("a", 1, 1)]
    assert table.append(rows(spark, ("b", 2))) == 2
    assert seen(table.read()) == [("a", 1, 1), ("b", 2, 2)]


def test_a_rewrite_replaces_what_it_was_made_from(spark, table):
    table.append(rows(spark, ("a", 1)))
    base = table.append(rows(spark, ("a", 2)))
    assert table.rewrite(table.newest(["k"]).select("k", "n"), base) == 3
    assert seen(table.read()) == [("a", 2, 3)] and len(table.parts(3)) == 1
    assert seen(table.read(2)) == [("a", 1, 1), ("a", 2, 2)]
    table.append(rows(spark, ("b", 1)))
    with pytest.raises(Conflict):
        table.rewrite(rows(spark, ("a", 9)), 3)
    assert table.version() == 4


def test_other_columns_are_refused(spark, table):
    with pytest.raises(ValueError, match="columns"):
        table.append(rows(spark, ("a", 1)).withColumnRenamed("n", "m"))


def test_a_manifest_is_never_replaced(spark, table):
    files, folder = hadoop_path(spark, f"{table.path}/versions")
    files.mkdirs(folder)
    for name in ("one", "two"):
        snapshots.write_json(spark, f"{table.path}/versions/{name}", name)
    target = f"{table.path}/versions/000000000001.json"
    assert snapshots._rename_once(spark, f"{table.path}/versions/one", target)
    assert not snapshots._rename_once(spark, f"{table.path}/versions/two", target)
    assert snapshots.read_json(spark, target) == "one"


def logged_encoder(folder):
    def load():
        import uuid

        encode = letter_encoder()

        def logged(texts):
            (folder / uuid.uuid4().hex).write_text("\n".join(texts))
            return encode(texts)

        return logged

    return load


def calls(folder):
    return sorted(t for p in folder.iterdir() for t in p.read_text().split("\n"))


def test_a_second_run_encodes_only_new_texts(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    first = spark.createDataFrame([("x",), ("ea",), ("x",), (None,)], "t string")
    second = spark.createDataFrame([("ea",), ("new",), ("x",), ("new",)], "t string").repartition(3)
    store = VectorStore(spark, str(tmp_path / "store"), "letters@1")
    assert store.embed(first, "t", logged_encoder(log)).count() == 2 and calls(log) == ["ea", "x"]
    got = VectorStore(spark, str(tmp_path / "store"), "letters@1").embed(second, "t", logged_encoder(log))
    assert calls(log) == ["ea", "new", "x"]
    want = scoring.embed_texts(second, "t", letter_encoder)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 3
    store.embed(second, "t", logged_encoder(log))
    assert len(calls(log)) == 3 and store.table.version() == 2
    other = VectorStore(spark, str(tmp_path / "store"), "letters@2")
    other.embed(first, "t", logged_encoder(log))
    assert len(calls(log)) == 5 and other.table.version() == 1
    none = store.embed(first.where("t is null"), "t", logged_encoder(log))
    assert none.isEmpty() and len(calls(log)) == 5


def test_a_stopped_encoder_leaves_no_half_version(spark, tmp_path):
    texts = spark.createDataFrame([("x",), ("boom",), ("y",)], "t string").repartition(3)

    def breaking():
        encode = letter_encoder()

        def run(batch):
            if "boom" in batch:
                raise ValueError("boom")
            return encode(batch)

        return run

    store = VectorStore(spark, str(tmp_path / "store"), "letters@1")
    with pytest.raises(Exception, match="boom"):
        store.embed(texts, "t", breaking)
    assert store.table.version() == 0 and store.table.read().isEmpty()
    assert store.embed(texts, "t", letter_encoder).count() == 3


def test_scores_with_a_store_equal_scores_without(spark, tmp_path):
    rows = spark.createDataFrame(
        [("q1", "a test", "e1", "some text"), ("q1", "a test", "e2", "other"), ("q2", "some text", "e1", "some text")],
        "query_id string, query_text string, dbpedia_entity string, abstract string",
    )
    log = tmp_path / "calls"
    log.mkdir()
    store = VectorStore(spark, str(tmp_path / "store"), "letters@1")
    want = {tuple(r) for r in scoring.score_candidates(rows, "m", letter_encoder).collect()}
    for _ in range(2):
        got = scoring.score_candidates(rows, "m", logged_encoder(log), store=store)
        assert {tuple(r) for r in got.collect()} == want
    # A text that is a query and a passage is encoded once.
    assert calls(log) == ["a test", "other", "some text"]
    assert np.isfinite([r[-1] for r in want]).all()
