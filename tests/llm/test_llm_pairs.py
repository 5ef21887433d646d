"""Jaccard join, embedding links, connected components."""

import numpy as np
import pytest
from llm_cases import awkward_docs, plain_classes, plain_shingles, small
from pyspark.sql import functions as F

from rankflow.llm import jaccard_join as forest
from rankflow.llm.components import components
from rankflow.llm.embedding_links import embedding_classes, table_sizes
from rankflow.llm.jaccard_join import jaccard_classes, keep_one_per_class, match_depth


def test_components_of_a_path_a_star_and_loops(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(8, 60)]
    edges = spark.createDataFrame([*path, *star, (1, 1), (2, 1), (5, 5), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in range(7, 60)} | {1: 1, 2: 1, 5: 5}
    assert found == want


def test_components_end_at_stars(spark, monkeypatch):
    """Stars end the rounds: one round for them, and no round that only finds that nothing changes."""
    from rankflow.llm import components as module

    landed, land = [], module.land
    monkeypatch.setattr(module, "land", lambda df: landed.append(1) or land(df))
    edges = spark.createDataFrame([(9, 2), (2, 1), (3, 1), (8, 7), (7, 7), (1, 1), (5, 5)], "a long, b long")
    found = {r.node: r.component for r in components(edges.where("a != 9")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 5: 5, 7: 7, 8: 7} and len(landed) == 6
    assert {r.node: r.component for r in components(edges).collect()} == {**found, 9: 1}
    assert components(edges.where("a > 9")).collect() == []


def test_prefix_is_shortened_until_the_recall_is_met():
    d = match_depth(20, 8, 0.8, 0.999)
    assert 1 - (1 - 0.8**d) ** 20 >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** 20


def plain_forest(labels, trees, threshold, recall, shortest):
    """[{(rep, members of a node)} by level] from tries of plain tuples; labels[rep][tree] is a tuple."""
    top = len(labels[0][0])
    asking, levels = set(range(len(labels))), []
    for d in range(top, shortest - 1, -1):
        tries = {}
        for rep, row in enumerate(labels):
            for tree, label in enumerate(row):
                tries.setdefault((tree, label[:d]), set()).add(rep)
        nodes = [frozenset(m) for m in tries.values() if len(m) > 1 and m & asking]
        levels.append({(rep, m) for m in nodes for rep in m})
        fullest = {}
        for m in nodes:
            for rep in m:
                fullest[rep] = max(fullest.get(rep, 0), len(m))
        asking = {r for r in asking if fullest.get(r, 0) * (1 - threshold**d) ** trees > 1 - recall}
        if not asking:
            break
    return levels


@pytest.mark.parametrize("recall, shortest", [(0.5, 1), (0.3, 2), (0.3, 5)])
def test_prefixes_are_shortened_row_by_row(spark, recall, shortest):
    trees, top = 3, 5
    rng = np.random.default_rng(3)
    labels = [[tuple(rng.integers(0, 2, top).tolist()) for _ in range(trees)] for _ in range(40)]
    labels += [[tuple(rng.integers(5, 4096, top).tolist()) for _ in range(trees)] for _ in range(20)]
    labels += [labels[-1], [(*x[:3], 4095, 4095) for x in labels[-2]]]
    pack = lambda label: sum(x << forest.LABEL_BITS * (top - 1 - i) for i, x in enumerate(label))
    rows = [(rep, [pack(x) for x in row]) for rep, row in enumerate(labels)]
    table = spark.createDataFrame(rows, "rep long, keys array<long>").repartition(3)
    members = {}
    for r in forest.forest_nodes(table, trees, top, 0.8, recall, shortest).collect():
        members.setdefault(r.key, set()).add(r.rep)
        assert r.least <= r.rep
    got = {frozenset(m) for m in members.values()}
    levels = plain_forest(labels, trees, 0.8, recall, shortest)
    assert got == {m for level in levels for _, m in level}
    assert len(levels) == {1: 5, 2: 4, 5: 1}[shortest]


def test_a_group_is_met_in_full_through_shorter_prefixes(spark):
    """With few trees the whole signatures lose links of a large group; shortened prefixes find them."""
    rng = np.random.default_rng(0)
    base = [f"b{x}" for x in rng.integers(0, 10**6, 120)]
    rows = [(i, " ".join([*base[:at], f"x{i}", *base[at + 1 :]])) for i, at in enumerate(rng.integers(10, 110, 60).tolist())]
    sets = [plain_shingles(t) for _, t in rows]
    linked = {(i, j) for i in range(60) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_hash", F.lit(0).cast("long"))
    trees, top = 3, 5
    made = docs.mapInArrow(
        forest.signatures(5, trees, top),
        "rep long, row_hash long, h1 long, h2 long, n_shingles long, keys array<long>",
    )
    texts = forest.land(made.select("rep", "keys"))
    lost = {}
    for shortest in (5, 1):
        members = {}
        for r in forest.forest_nodes(texts, trees, top, 0.8, 0.5, shortest).collect():
            members.setdefault(r.key, []).append(r.rep)
        met = {(max(i, j), min(i, j)) for m in members.values() for i in m for j in m if i != j}
        lost[shortest] = len(linked - met)
    assert len(linked) > 1000 and lost[5] > 0.05 * len(linked) and lost[1] <= 0.01 * len(linked)


@pytest.mark.parametrize("block_shingles", [64, 1 << 15])
def test_classes_equal_brute_force(spark, block_shingles):
    docs = small(spark, "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    want = sorted((rows[i][0], *v) for i, v in plain_classes(rows).items())
    assert sorted(map(tuple, jaccard_classes(docs, block_shingles=block_shingles).collect())) == want


def test_classes_of_awkward_rows(spark):
    docs = awkward_docs(spark)
    named = [tuple(r) for r in docs.where("doc_id is not null").select("doc_id", "text").collect()]
    want = sorted((named[i][0], *v) for i, v in plain_classes(named).items())
    got = [tuple(r) for r in jaccard_classes(docs).collect()]
    assert sorted(r for r in got if r[0] is not None) == want
    assert [r for r in got if r[0] is None] == [(None, None, 0)] * 2
    assert {r[0]: r for r in got}[4] == (4, 4, 0)
    assert jaccard_classes(awkward_docs(spark, empty=True)).isEmpty()


def test_one_row_of_each_class_stays(spark):
    docs = awkward_docs(spark)
    kept = keep_one_per_class(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect())
    # 5, 6, 6 and 7 are near copies of each other, 8 repeats the same words; null ids stay.
    assert ids[:7] == [-1, -1, 1, 2, 3, 4, 5] and 6 not in ids and 9 in ids
    assert keep_one_per_class(awkward_docs(spark, empty=True)).isEmpty()


def words(seed, n=40):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))


def repeated_ids():
    """Unlike texts under one id, each with near copies of its own, and one id in two classes and in one twice."""
    a, b, c = words(1), words(2), words(3)
    rows = [(1, a), (1, b), (5, a + " z"), (6, b + " z"), (1, a), (7, c), (7, c + " y"), (7, words(4)), (6, words(5))]
    return rows + [(2, ""), (2, None), (2, ""), (None, a), (8, a + " z"), (1, b + " q")]


@pytest.mark.parametrize("block_shingles", [64, 1 << 15])
def test_unlike_texts_of_one_id(spark, block_shingles):
    rows = repeated_ids()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    named = [r for r in rows if r[0] is not None]
    want = sorted((named[i][0], *v) for i, v in plain_classes(named).items())
    got = [tuple(r) for r in jaccard_classes(docs, block_shingles=block_shingles).collect()]
    assert sorted(r for r in got if r[0] is not None) == want
    probe = spark.createDataFrame(rows[:4], docs.schema)
    assert sorted(map(tuple, jaccard_classes(probe).collect())) == [(1, 1, 1), (1, 1, 1), (5, 1, 1), (6, 1, 1)]


def test_each_class_keeps_a_row_whatever_the_ids(spark):
    rows = repeated_ids()
    schema = "doc_id long, text string, row_hash string, kept string"
    kept = []
    for n in (1, 5):
        docs = spark.createDataFrame([(*r, "mine", None) for r in rows], schema).repartition(n)
        got = keep_one_per_class(docs)
        assert got.columns == docs.columns and {r.row_hash for r in got.collect()} == {"mine"}
        kept.append(sorted((r.doc_id or -1, r.text or "") for r in got.collect()))
    assert kept[0] == kept[1]
    texts = [t for _, t in kept[0]]
    assert len(texts) == 8  # classes a, b, c, two lone texts, an empty one, a null one, and the row without an id
    assert sum(words(1) in t for t in texts) == 2 and sum(words(2) in t for t in texts) == 1
    assert sum(words(3) in t for t in texts) == 1 and {(7, words(4)), (6, words(5))} <= set(kept[0])


@pytest.mark.parametrize("block", [2, 512])
def test_unlike_vectors_of_one_id(spark, block):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (5, [1.0, 0.1, 0.0]), (6, [0.1, 1.0, 0.0]), (6, [0.0, 0.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(r)[:3] for r in embedding_classes(table, block=block).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (5, 1, 1), (6, 0, 6), (6, 1, 1)]


def vectors(spark):
    rng = np.random.default_rng(0)
    made = []
    for center in rng.normal(size=(30, 16)):
        for _ in range(rng.integers(1, 30)):
            made.append(center + rng.normal(size=16) * rng.choice([0.05, 0.15, 0.2, 0.3]))
    made = [[float(np.float32(x)) for x in v] for v in made]
    made += [made[0]] * 300
    bad = [None, [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [], [None, *[1.0] * 15]]
    rows = [(i, v, 0) for i, v in enumerate(made)] + [(9000 + i, v, 0) for i, v in enumerate(bad)]
    rows += [(None, made[0], 0)]
    return made, spark.createDataFrame(rows, "vec_id long, embedding array<float>, keys int").repartition(3)


@pytest.mark.parametrize("block", [64, 512])
def test_links_of_vectors(spark, block):
    made, table = vectors(spark)
    unit = np.array(made)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    rows = embedding_classes(table, block=block).collect()
    got = {r.vec_id: r for r in rows}
    n_links = np.array([got[i].n_links for i in range(len(made))])
    assert (n_links <= linked.sum(axis=1)).all()  # none below the threshold
    assert n_links.sum() >= 0.99 * linked.sum()
    for i in range(9000, 9006):
        assert tuple(got[i]) == (i, 0, i, True)
    assert tuple(got[None]) == (None, 0, None, False)
    assert len(rows) == len(made) + 7
    for i in range(len(made)):
        assert got[i].kept == (got[i].component_id == i)
        assert got[i].component_id <= i
    assert len({got[i].component_id for i in range(len(made) - 300, len(made))}) == 1


def test_no_vectors_and_table_sizes(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_classes(none).isEmpty()
    bits, tables = table_sizes(10**9, 0.95, 0.995)
    assert bits == 24 and tables < 80
