import re

import numpy as np
import pyarrow as pa
import pytest

from checks.fixtures import letter_encoder
from rankflow.operators import pooling, retrieval, scoring
from rankflow.session import land

HEAD = [(np.arange(22).reshape(2, 11) / 10, np.array([0.5, -3.0])), (np.ones((8, 2)), np.zeros(8))]


@pytest.fixture(scope="module")
def candidates(spark):
    rows = [
        ("q1", "a test", "e1", "some text", [1.0, 2.0], [0.5]),
        ("q1", "a test", "e2", "other text", [0.0, 0.0], [float("nan")]),
        ("q2", "area", "e1", "some text", [1.0, 2.0], None),
        ("q2", "area", "e1", "second text of e1", [1.0, 2.0], [0.1]),
    ]
    return spark.createDataFrame(
        rows,
        "query_id string, query_text string, dbpedia_entity string, abstract string,"
        " biggraph_embedding array<double>, deepct_weights array<double>",
    )


def letters(text):
    return letter_encoder()(np.array([text]))[0]


def test_scores_without_head(candidates):
    scores = scoring.score_candidates(candidates, "m", letter_encoder).collect()
    texts = {r.passage_key: None for r in scores}
    assert len(scores) == 4 and len(texts) == 3
    for r in candidates.withColumn("passage_key", scoring.text_key("abstract")).collect():
        want = np.linalg.norm(letters(r.query_text) - letters(r.abstract) + 1e-6)
        got = [s.score for s in scores if (s.query_id, s.passage_key) == (r.query_id, r.passage_key)]
        assert got == [pytest.approx(want, abs=1e-9)]


def test_scores_with_vectors_and_head(candidates):
    scores = scoring.score_candidates(
        candidates, "m", letter_encoder, HEAD, graph=True, weights=True, weight_dim=1, metric="manhattan"
    )
    got = {(r.query_id, r.passage_key): r.score for r in scores.collect()}
    for r in candidates.withColumn("passage_key", scoring.text_key("abstract")).collect():
        weights = [0.0 if w != w else w for w in (r.deepct_weights or [0.0])]
        x = np.r_[letters(r.abstract), r.biggraph_embedding, weights]
        (w1, b1), (w2, b2) = HEAD
        y = w2 @ np.maximum(w1 @ x + b1, 0) + b2
        want = np.abs(letters(r.query_text) - y + 1e-6).sum()
        assert got[r.query_id, r.passage_key] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("extra", [{"graph": True}, {"weights": True}])
def test_vectors_without_a_fitting_head_fail(candidates, extra):
    with pytest.raises(ValueError):
        scoring.score_candidates(candidates, "m", letter_encoder, **extra)
    narrow = [(np.ones((2, 8)), np.zeros(2)), (np.ones((8, 2)), np.zeros(8))]
    with pytest.raises(ValueError):
        scoring.score_candidates(candidates, "m", letter_encoder, narrow, **extra)


def test_loss_of_a_model_on_triplets(spark, candidates):
    rows = candidates.collect()
    pairs = [(a, b) for a in rows for b in rows if a.query_id == b.query_id and a is not b]
    data = [
        (a.query_text, a.abstract, b.abstract, a.biggraph_embedding, b.biggraph_embedding, a.deepct_weights, b.deepct_weights)
        for a, b in pairs
    ]
    triplets = spark.createDataFrame(
        data,
        "query_text string, abstract_x string, abstract_y string, biggraph_embedding_x array<double>,"
        " biggraph_embedding_y array<double>, deepct_weights_x array<double>, deepct_weights_y array<double>",
    )

    def side(text, graph, weights):
        (w1, b1), (w2, b2) = HEAD
        x = np.r_[letters(text), graph, [0.0 if w != w else w for w in (weights or [0.0])]]
        return w2 @ np.maximum(w1 @ x + b1, 0) + b2

    def distance(a, b):
        return np.sqrt(((a - b + 1e-6) ** 2).sum())

    losses = [
        max(distance(letters(q), side(x, gx, wx)) - distance(letters(q), side(y, gy, wy)) + 0.5, 0)
        for q, x, y, gx, gy, wx, wy in data
    ]
    loss = scoring.model_triplet_loss(
        triplets, letter_encoder, HEAD, graph=True, weights=True, weight_dim=1, margin=0.5
    ).first()["loss"]
    assert loss == pytest.approx(np.mean(losses), abs=1e-9)


def test_every_text_is_encoded_once(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()

    def load():
        import uuid

        encode = letter_encoder()

        def logged(texts):
            (log / uuid.uuid4().hex).write_text("\n".join(texts))
            return encode(texts)

        return logged

    df = spark.createDataFrame([("x",), ("y",), ("x",), (None,)], "t string").repartition(3)
    assert scoring.embed_texts(df, "t", load, batch_size=2).count() == 2
    scoring.embed_texts(df, "t", load, batch_size=2).collect()
    seen = [t for p in log.iterdir() for t in p.read_text().split("\n")]
    assert sorted(seen) == ["x", "y"]


def test_existing_scores_are_skipped_per_experiment(candidates):
    first = scoring.score_candidates(candidates, "m@1", letter_encoder).where("query_id = 'q1'")
    rest = scoring.score_candidates(candidates, "m@1", letter_encoder, existing=first)
    assert {r.query_id for r in rest.collect()} == {"q2"}
    assert scoring.score_candidates(candidates, "m@2", letter_encoder, existing=first).count() == 4


def test_experiments_of_one_encoder_share_its_vectors(candidates, monkeypatch):
    calls = []
    embed = scoring.embed_sides
    monkeypatch.setattr(scoring, "embed_sides", lambda *a: calls.append(a) or embed(*a))
    experiments = [
        {"experiment": "a", "load_encoder": letter_encoder},
        {"experiment": "b", "load_encoder": letter_encoder, "metric": "manhattan"},
    ]
    together = scoring.score_experiments(candidates, experiments)
    assert len(calls) == 1
    for e in experiments:
        alone = scoring.score_candidates(candidates, **e)
        assert alone.exceptAll(together).isEmpty()
    assert together.count() == 8


def test_a_grid_is_one_pass(candidates):
    """Twenty experiments: one scan of the candidates, one join with each side, and the scores of single runs."""
    plain = [{"metric": m} for m in ("euclidean", "manhattan", "cosine")] * 4
    other = [(HEAD[0][0] * 2, HEAD[0][1]), (HEAD[1][0], HEAD[1][1] + 1)]
    headed = [
        {"head": h, "graph": True, "weights": True, "weight_dim": 1, "metric": m}
        for h in (HEAD, other) for m in ("euclidean", "manhattan", "cosine")
    ]
    narrow = [(np.ones((2, 10)), np.zeros(2)), (np.ones((8, 2)), np.zeros(8))]
    more = [{"head": narrow, "graph": True}, {"head": [(np.ones((3, 8)), np.zeros(3)), (np.ones((8, 3)), np.zeros(8))]}]
    experiments = [
        {"experiment": f"m@{i}", "load_encoder": letter_encoder} | e for i, e in enumerate([*plain, *headed, *more])
    ]
    assert len(experiments) == 20
    rows = land(candidates)
    together = scoring.score_experiments(rows, experiments)
    plan = together._jdf.queryExecution().executedPlan().toString()
    scan = rows.inputFiles()[0].rsplit("/", 1)[0].rsplit("/", 1)[1]
    assert plan.count(scan) == 1 and len(re.findall(r"(?:HashJoin|SortMergeJoin) \[", plan)) == 2
    got = {tuple(r)[:-1]: r.score for r in together.collect()}
    assert len(got) == 20 * 4
    for e in experiments:
        for r in scoring.score_candidates(candidates, **e).collect():
            want = r.score if e.get("head") is None else pytest.approx(r.score, rel=1e-12)
            assert got[tuple(r)[:-1]] == want


def test_a_grid_scores_what_is_lacking(candidates):
    experiments = [
        {"experiment": "a", "load_encoder": letter_encoder},
        {"experiment": "b", "load_encoder": letter_encoder, "metric": "cosine"},
    ]
    whole = scoring.score_experiments(candidates, experiments)
    done = whole.where("(experiment = 'a' and query_id = 'q1') or (experiment = 'b' and dbpedia_entity = 'e2')")
    rest = scoring.score_experiments(candidates, experiments, land(done))
    want = {tuple(r) for r in whole.collect()} - {tuple(r) for r in done.collect()}
    assert {tuple(r) for r in rest.collect()} == want and rest.count() == len(want) == 5
    assert scoring.score_experiments(candidates, experiments, land(whole)).isEmpty()


def test_a_grid_over_missing_vectors(spark, candidates):
    """A row without a text or a graph vector has no score where the model needs it."""
    rows = candidates.unionByName(
        spark.createDataFrame([("q3", "x", "e9", None, [1.0, 2.0], [0.5]), ("q3", "x", "e8", "t", None, [0.5])], candidates.schema)
    )
    narrow = [(np.ones((2, 10)), np.zeros(2)), (np.ones((8, 2)), np.zeros(8))]
    experiments = [
        {"experiment": "a", "load_encoder": letter_encoder},
        {"experiment": "b", "load_encoder": letter_encoder, "head": narrow, "graph": True},
    ]
    got = scoring.score_experiments(rows, experiments).where("score is null").collect()
    assert {(r.experiment, r.dbpedia_entity) for r in got} == {("a", "e9"), ("b", "e9"), ("b", "e8")}
    with pytest.raises(Exception, match="vectors of"):
        short = [(np.ones((2, 8)), np.zeros(2)), (np.ones((5, 2)), np.zeros(5))]
        scoring.score_experiments(rows, [{"experiment": "c", "load_encoder": letter_encoder, "head": short}]).collect()


def test_attached_scores(candidates):
    experiments = [{"experiment": e, "load_encoder": letter_encoder} for e in ("m@1", "m@2")]
    scores = scoring.score_experiments(candidates, experiments)
    assert scores.count() == 8
    wide = scoring.attach_scores(candidates, scores.where("query_id = 'q1'"), "m@2", "score_m")
    assert wide.columns == [*candidates.columns, "score_m"]
    assert sorted((r.query_id, r.score_m is None) for r in wide.collect()) == [
        ("q1", False), ("q1", False), ("q2", True), ("q2", True),
    ]


def test_head_from_a_table(spark):
    rows = [(1, [[1.0, 2.0]], [0.5]), (0, [[1.0], [0.0]], [0.0, 0.0])]
    stored = spark.createDataFrame(rows, "layer int, w array<array<double>>, b array<double>")
    head = scoring.load_head(stored)
    assert [w.shape for w, _ in head] == [(2, 1), (1, 2)]
    df = spark.createDataFrame([([3.0],), (None,)], "v array<double>")
    got = [r.y for r in scoring.head_projection(df, "v", "y", head).collect()]
    assert got == [[3.5], None]
    with pytest.raises(ValueError):
        scoring.load_head(stored.where("layer = 0"))


@pytest.mark.parametrize("broadcast_values", [0, 100])
def test_mean_pool(spark, monkeypatch, broadcast_values):
    monkeypatch.setattr(pooling, "_CHUNK_VALUES", 3)
    texts = [(1, "a a b unknown"), (2, "unknown"), (3, "b"), (4, ""), (5, "c a b a")]
    index = retrieval.doc_vectors(spark.createDataFrame(texts, "id long, text string"), "id", "text")
    rows = [("a", [1.0, 0.0]), ("b", [4.0, 3.0]), ("c", [-2.0, 6.0])]
    table = spark.createDataFrame(rows, "token string, vector array<double>")
    got = {r.doc_id: r.mean_vector for r in pooling.mean_pool(index, table, broadcast_values).collect()}
    vectors = {t: np.array(v) for t, v in rows}
    want = {}
    for i, text in texts:
        known = [vectors[t] for t in text.split() if t in vectors]
        if known:
            want[i] = pytest.approx(np.mean(known, axis=0).tolist())
    assert got == want


@pytest.mark.parametrize("broadcast_values", [0, 100])
def test_mean_pool_with_gaps_and_repeats(spark, broadcast_values):
    """A null vector shifts nothing; a repeated token has its mean; a repeated id is one document."""
    texts = [(1, "red"), (2, "sky"), (3, "red sky aaa"), (3, "red"), (4, "aaa"), (None, "red")]
    index = retrieval.doc_vectors(spark.createDataFrame(texts, "id long, text string"), "id", "text")
    rows = [("aaa", None), ("red", [1.0]), ("sky", [1.0]), ("sky", [3.0]), ("zzz", [3.0]), ("bad", [None]), (None, [9.0])]
    table = spark.createDataFrame(rows, "token string, vector array<double>")
    got = {r.doc_id: r.mean_vector for r in pooling.mean_pool(index, table, broadcast_values).collect()}
    assert got == {1: [1.0], 2: [2.0], 3: [pytest.approx(4 / 3)]}


@pytest.mark.parametrize("broadcast_values", [0, 100])
def test_token_vectors_of_unequal_length_fail(spark, broadcast_values):
    index = retrieval.doc_vectors(spark.createDataFrame([(1, "a")], "id long, text string"), "id", "text")
    table = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "token string, vector array<double>")
    with pytest.raises(ValueError):
        pooling.mean_pool(index, table, broadcast_values)


def test_a_vocabulary_of_many_bytes_is_joined(spark):
    """Tokens count in the bound as well as their vectors; few long ones are not sent to the workers."""
    long = "x" * 2000
    index = retrieval.doc_vectors(spark.createDataFrame([(1, f"a {long}"), (2, "a")], "id long, text string"), "id", "text")
    table = spark.createDataFrame([("a", [1.0, 3.0]), (long, [2.0, 5.0])], "token string, vector array<double>")
    for bound, way in ((100, False), (1000, True)):
        pooled = pooling.mean_pool(index, table, bound)
        assert ("MapInArrow" in pooled._jdf.queryExecution().optimizedPlan().toString()) == way
        assert {r.doc_id: r.mean_vector for r in pooled.collect()} == {1: [1.5, 4.0], 2: [1.0, 3.0]}


def test_mean_pool_looks_up_bounded_slices(spark, monkeypatch):
    index = spark.createDataFrame([(i, f"a b c{i}") for i in range(40)], "id long, text string")
    batch = retrieval.doc_vectors(index, "id", "text").select("doc_id", "terms").toArrow().combine_chunks().to_batches()[0]
    seen, lookup = [], pooling.known_postings
    monkeypatch.setattr(pooling, "_CHUNK_POSTINGS", 10)
    monkeypatch.setattr(pooling, "known_postings", lambda terms, v: seen.append(len(terms)) or lookup(terms, v))

    class Shared:
        value = {"tokens": pa.array(["a", "b"]), "vectors": np.array([[1.0], [3.0]])}

    got = [b.to_pydict() for b in pooling._pool_documents(Shared)(iter([batch]))]
    assert max(seen) == 3 and sum(len(b["doc_id"]) for b in got) == 40
    assert all(v == [2.0] for b in got for v in b["mean_vector"])


def test_mean_pool_without_vectors(spark):
    index = retrieval.doc_vectors(spark.createDataFrame([(1, "a")], "id long, text string"), "id", "text")
    table = spark.createDataFrame([], "token string, vector array<double>")
    assert pooling.mean_pool(index, table).collect() == []


def test_experiment_name():
    assert scoring.experiment_name("m", True, False, "5") == "score_m_True_False@5"
