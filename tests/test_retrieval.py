import math
import random
import re
import tracemalloc
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest

from rankflow.operators import batches, retrieval

WORDS = "red green blue red-green the a of sky Sea 42 été".split()


def corpus(n, hot=False):
    """Small texts; with ``hot`` a third of them are copies of one text."""
    texts = []
    for i in range(n):
        words = [WORDS[(i * 7 + j * j) % len(WORDS)] for j in range(i % 9)]
        texts.append("the blue sky" if hot and i % 3 == 0 else " ".join(words))
    return texts


def words(text):
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def expected(texts, queries, k, stop=()):
    bags = [Counter(words(t)) for t in texts]
    full = [b for b in bags if b]
    average = sum(sum(b.values()) for b in full) / len(full)
    run = set()
    for q, query in enumerate(queries):
        wanted = Counter(w for w in words(query) if w not in stop)
        scores = []
        for d, bag in enumerate(bags):
            score = 0.0
            for w, n in wanted.items():
                if bag[w]:
                    df = sum(1 for b in full if b[w])
                    idf = math.log(1 + (len(full) - df + 0.5) / (df + 0.5))
                    norm = 0.9 * (0.6 + 0.4 * sum(bag.values()) / average)
                    score += n * idf * bag[w] / (bag[w] + norm)
            if any(bag[w] for w in wanted):
                scores.append((-round(score, 6), d))
        run |= {(q, d, i + 1, -s) for i, (s, d) in enumerate(sorted(scores)[:k])}
    return run


QUERIES = ["the red sky", "blue blue Sea", "nothing known", "42", ""]


def frames(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, body string").repartition(5)
    queries = spark.createDataFrame(list(enumerate(QUERIES)), "query_index long, query_text string")
    return retrieval.doc_vectors(docs, "id", "body"), queries


def found(run):
    return {(r.query_index, r.doc_id, r.hit, r.score) for r in run.collect()}


@pytest.mark.parametrize("block_bytes", [50, 200, 1 << 20])
@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("k", [1, 7, 1000, 1500])
def test_search_equals_brute_force(spark, block_bytes, hot, k):
    texts = corpus(150, hot)
    index, queries = frames(spark, texts)
    run = retrieval.bm25_search(index, queries, k, block_bytes=block_bytes)
    assert found(run) == expected(texts, QUERIES, k)


@pytest.mark.parametrize("block_bytes", [50, 1 << 20])
def test_rows_with_one_id_are_one_document(spark, block_bytes):
    docs = [(1, "red sky"), (1, "blue sky sky"), (2, "red"), (3, ""), (3, "sea"), (None, "sea sea"), (4, None), (4, "")]
    merged = ["", "red sky blue sky sky", "red", "sea", ""]
    index = retrieval.doc_vectors(spark.createDataFrame(docs, "id long, body string").repartition(3), "id", "body")
    asked = ["sky sea", "red"]
    queries = spark.createDataFrame(list(enumerate(asked)), "query_index long, query_text string")
    run = retrieval.bm25_search(index, queries, 10, block_bytes=block_bytes)
    assert found(run) == expected(merged, asked, 10)
    assert found(retrieval.bm25_search(retrieval.prepare(index), queries, 10)) == expected(merged, asked, 10)


@pytest.mark.parametrize("few", [True, False])
def test_only_asked_terms_are_merged_and_counted(spark, few):
    docs = [(1, "red sky"), (1, "blue sky sky"), (2, "red sea"), (3, ""), (3, "sea"), (None, "sky")]
    index = retrieval.doc_vectors(spark.createDataFrame(docs, "id long, body string"), "id", "body")
    queries = spark.createDataFrame([(0, "sky sky"), (1, "red none")], "query_index long, query_text string")
    asked = retrieval.query_terms(queries)
    prepared = retrieval.prepare(index, asked, broadcast_keys=3 if few else 2)
    merged = prepared.documents.where("doc_id = 1").first()
    assert merged.doc_length == 5
    assert [(t.term, t.tf) for t in merged.terms] == [("red", 1), ("sky", 3)] if few else len(merged.terms) == 3
    counted = {r.term: r.df for r in prepared.frequencies.collect()}
    whole = retrieval.prepare(index)
    assert counted == {r.term: r.df for r in whole.frequencies.collect() if not few or r.term in ("red", "sky")}
    assert (prepared.n_docs, prepared.avg_length) == (whole.n_docs, whole.avg_length)
    assert found(retrieval.bm25_search(prepared, queries, 9)) == found(retrieval.bm25_search(whole, queries, 9))


def test_small_buffers_change_nothing(spark, monkeypatch):
    texts = corpus(150, True)
    index, queries = frames(spark, texts)
    monkeypatch.setattr(retrieval, "_CHUNK_ROWS", 3)
    monkeypatch.setattr(retrieval, "_BUFFER_ROWS", 5)
    shared = found(retrieval.bm25_search(index, queries, 4))
    assert shared == expected(texts, QUERIES, 4)


def test_stop_words(spark):
    texts = corpus(60)
    index, queries = frames(spark, texts)
    stop = spark.createDataFrame([("the",), ("blue",)], "term string")
    run = retrieval.bm25_search(index, queries, 5, stop_words=stop)
    assert found(run) == expected(texts, QUERIES, 5, {"the", "blue"})


def test_text_ids(spark):
    docs = spark.createDataFrame([("é", "x y"), ("a", "x y"), ("b", "z")], "id string, body string")
    queries = spark.createDataFrame([(3, "x")], "query_index long, query_text string")
    run = retrieval.bm25_search(retrieval.doc_vectors(docs, "id", "body"), queries, 2)
    assert [(r.query_index, r.doc_id, r.hit) for r in run.orderBy("hit").collect()] == [
        (3, "a", 1),
        (3, "é", 2),
    ]


def test_no_query_word_is_known(spark):
    index, _ = frames(spark, corpus(20))
    queries = spark.createDataFrame([(0, "zzz")], "query_index long, query_text string")
    assert retrieval.bm25_search(index, queries, 5).collect() == []


def test_null_and_empty_texts_do_not_count(spark):
    docs = spark.createDataFrame([(0, None), (1, "..."), (2, "a b")], "id long, body string")
    index = retrieval.doc_vectors(docs, "id", "body")
    stats = retrieval.corpus_stats(index).first()
    assert (stats.n_docs, stats.avg_length) == (1, 2.0)
    assert retrieval.document_frequency(index).count() == 2


def test_postings(spark):
    docs = spark.createDataFrame([(1, "B a, b A b")], "id long, body string")
    got = {r.term: (r.doc_id, r.tf, r.positions) for r in retrieval.postings(docs, "id", "body").collect()}
    assert got == {"a": (1, 2, [1, 3]), "b": (1, 3, [0, 2, 4])}


def test_index_is_built_without_a_shuffle(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "id long, body string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for built in (retrieval.doc_vectors(docs, "id", "body"), retrieval.postings(docs, "id", "body")):
        assert "Exchange" not in plan(built)


def test_search_shuffles_only_the_best(spark, tmp_path):
    """One shuffle, by query, and the rows are cut to k per partition before it."""
    index, queries = frames(spark, corpus(50))
    index.write.parquet(str(tmp_path / "i"))
    prepared = retrieval.prepare(spark.read.parquet(str(tmp_path / "i")))
    text = plan(retrieval.bm25_search(prepared, queries, 10))
    assert text.count("Exchange") == 1
    assert text.count("FileScan") == 1  # the index, once
    blocks = plan(retrieval.bm25_search(prepared, queries, 10, block_bytes=60))
    assert blocks.count("FileScan") > 1 and "MapInArrow" not in blocks and "doc_id, 4" not in blocks  # landed hits
    before = text[text.index("Exchange") :]
    assert "WindowGroupLimit" in before and "MapInArrow" in before


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_with_a_hot_group(spark):
    rows = [(0 if i % 3 else 1, i, float(i * 17 % 101)) for i in range(3000)]
    df = spark.createDataFrame(rows, "query_index long, doc_id long, score double").repartition(4)
    got = {(r.query_index, r.doc_id, r.hit) for r in retrieval.top_k(df, 1200).collect()}
    want = set()
    for q in (0, 1):
        ordered = sorted((-s, d) for g, d, s in rows if g == q)[:1200]
        want |= {(q, d, i + 1) for i, (_, d) in enumerate(ordered)}
    assert got == want


@pytest.mark.parametrize("broadcast_keys", [0, 100])
def test_document_frequency_of_a_vocabulary(spark, broadcast_keys):
    index, _ = frames(spark, corpus(40))
    vocabulary = spark.createDataFrame([("the",), ("sky",), ("the",), ("zzz",)], "term string")
    got = retrieval.document_frequency(index, vocabulary, broadcast_keys).collect()
    bags = [set(words(t)) for t in corpus(40)]
    assert {r.term: r.df for r in got} == {w: sum(w in b for b in bags) for w in ("the", "sky")}


def test_merged_documents_are_landed_and_blocks_given_up(spark, monkeypatch):
    landed, destroyed = [], []
    land = retrieval.land
    monkeypatch.setattr(retrieval, "land", lambda df: landed.append(df.columns) or land(df))
    docs = spark.createDataFrame([(1, "red sky"), (1, "red sea"), (2, "blue sky"), (3, "green")], "id long, text string")
    index = retrieval.prepare(retrieval.doc_vectors(docs, "id", "text"))
    assert ["doc_id", "doc_length", "terms"] in landed and "Aggregate" not in str(
        index.documents._jdf.queryExecution().optimizedPlan()
    )
    queries = spark.createDataFrame([(0, "red sky"), (1, "sea"), (2, "green blue")], "query_index long, query_text string")
    want = sorted(map(tuple, retrieval.bm25_search(index, queries, 2).collect()))
    broadcast = type(spark.sparkContext).broadcast

    def watched(self, value):
        shared = broadcast(self, value)
        destroy = shared.destroy
        shared.destroy = lambda *a: destroyed.append(1) or destroy(*a)
        return shared

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", watched)
    assert sorted(map(tuple, retrieval.bm25_search(index, queries, 2, block_bytes=40).collect())) == want
    assert len(destroyed) > 1


def test_a_large_batch_is_scored_in_little_memory():
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [[{"term": w, "tf": 1 + i % 3} for i, w in enumerate(rng.sample(vocabulary, 200))] for _ in range(1000)]
    terms = pa.array(rows * 5, pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())])))
    columns = [pa.array(range(5000)), pa.array([200] * 5000, pa.int32()), terms]
    batch = pa.RecordBatch.from_arrays(columns, ["doc_id", "doc_length", "terms"])
    asked = [(q, w, 1 + q / 100, 0.5, 0.001) for q in range(50) for w in vocabulary[q * 20 : q * 20 + 40]]
    weights = pd.DataFrame(asked, columns=["query_index", "term", "weight", "norm_base", "norm_per_term"])

    class Shared:
        value = retrieval._packed(weights)

    tracemalloc.start(1)
    try:
        # a million postings at once: 58 MB
        found = pd.concat(b.to_pandas() for b in retrieval._score_documents(Shared, 10, 6)(iter([batch])))
        assert tracemalloc.get_traced_memory()[1] < 30 << 20
    finally:
        tracemalloc.stop()
    assert found.groupby("query_index").size().tolist() == [10] * 50


def test_slices_of_postings_hold_every_row_once():
    entry = {"term": "a", "tf": 1}
    rows = [[], None, [entry] * 3, [entry] * 9, [], [entry], [entry]]
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(rows, kind)], ["doc_id", "terms"])
    cut = [b.column("doc_id").to_pylist() for b in batches.posting_slices(batch, 4)]
    assert sum(cut, []) == list(range(7)) and [0, 1, 2] in cut and max(map(len, cut)) < 7
    assert list(batches.posting_slices(batch.slice(0, 0), 4)) == []
