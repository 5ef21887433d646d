"""N-gram Jaccard self join with a MinHash LSH forest.

Every text has a signature of ``depth`` min-hashes over its word shingles in each of ``trees`` trees. A signature is one
number, 12 bits a min-hash with the first on top, so the numbers of a tree in their order are its prefix trie:
the texts below a node are a range of them, and a shorter prefix is a shift. A text starts with the whole
signature as its matched prefix. Two texts at the threshold share no prefix of d in any tree with probability
(1 - threshold**d)**trees; times the number of texts in the fullest of its nodes, itself counted, this estimates the
links that a text loses there. While the estimate is above 1 - ``recall``, its prefix is shortened by one, down to
``shortest``. So a text among many like it looks further down the tries than a lone one, of which one possible link is
asked for; levels at which not even a lone text would be done are left out for all. At a shortened level the nodes
of the texts that ask are held against the signatures of all texts. Texts that meet are compared exactly on all
their shingles.

How it stays bounded: texts with the same words are one row (with a count) from the start. Only
8-byte hashes of nodes are shuffled, once per tree and level, and at shortened levels only those of nodes that were
asked for. Texts linked by a shared node form clusters; a cluster's shingles are dealt into blocks of bounded
volume, and only blocks that share a node are compared, in one task per pair of blocks. That task returns link
counts and a spanning forest of its links, never the links themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.llm.components import components
from rankflow.llm.session import ready, released
from rankflow.llm.text_arrays import constants, mix, shingles, slices, words
from rankflow.operators.reduction import keep_keys
from rankflow.session import land

#: Shingles of one block, about 8 bytes each; a single longer text makes a longer block. A block has
#: about a 128th as many texts at most.
BLOCK_SHINGLES = 1 << 15


#: Bits of a min-hash in a signature.
LABEL_BITS = 12
#: The longest signature that a signed 64-bit number holds.
MOST_LABELS = 5
#: The shortest prefix: at 0.8 and 20 trees it misses one link of 1.7 million, in a group of any size.
SHORTEST = 3


def miss(trees: int, d: int, threshold: float) -> float:
    """The probability that a pair at the threshold shares a prefix of ``d`` in no tree."""
    return (1 - threshold**d) ** trees


def match_depth(trees: int, depth: int, threshold: float, recall: float) -> int:
    """The longest prefix at which one link at the threshold is met with the wanted probability."""
    for d in range(min(depth, MOST_LABELS), 0, -1):
        if miss(trees, d, threshold) <= 1 - recall:
            return d
    raise ValueError("no prefix length reaches the recall; use more trees")


def _nodes(top: int, d: int) -> Column:
    """The hashes of a row's nodes at level ``d``, one per tree, from its signatures of ``top`` min-hashes."""
    shift = LABEL_BITS * (top - d)
    return F.transform("keys", lambda key, tree: F.xxhash64(F.shiftrightunsigned(key, shift), tree, F.lit(d)))


def forest_nodes(
    texts: DataFrame, trees: int, top: int, threshold: float, recall: float, shortest: int = SHORTEST
) -> DataFrame:
    """(rep, key, least): the nodes of two texts or more that a text meets others in, with their least text.

    ``texts`` (rep, keys) is landed. Starts at level ``top`` with all texts. Those whose estimate of lost links is above
    1 - ``recall`` ask again one level up, and so on; the nodes they ask for take in every text below them.
    """
    asking, levels = texts.select("rep"), []
    for d in range(top, max(min(shortest, top), 1) - 1, -1):
        each = texts.select("rep", F.explode(_nodes(top, d)).alias("key"))
        if d < top:
            asked = texts.join(asking, "rep", "left_semi").select(F.explode(_nodes(top, d)).alias("key"))
            each = keep_keys(each, asked, "key")
        full = each.groupBy("key").agg(F.min("rep").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
        level = land(each.join(full, "key"))
        levels.append(level.select("rep", "key", "least"))
        lost = F.max("n") * miss(trees, d, threshold)
        short = level.groupBy("rep").agg(lost.alias("lost")).where(F.col("lost") > 1 - recall).select("rep")
        # A text that did not ask at this level was done at a longer prefix.
        asking = land(short if d == top else short.join(asking, "rep", "left_semi"))
        if asking.isEmpty():
            break
    return reduce(DataFrame.unionByName, levels)


def _min_hashes(values: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """n min-hashes (columns) of every row with a shingle (rows)."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.empty((len(full), n), np.uint64)
    keys = constants(n, 2)
    step = 0
    while step < len(full):  # about 64k shingles at a time stay in cache
        to = max(step + 1, int(np.searchsorted(offsets[full], offsets[full[step]] + (1 << 16))))
        low, high = offsets[full[step]], offsets[full[to - 1] + 1]
        part, starts = values[low:high], offsets[full[step:to]] - low
        product = np.empty_like(part)
        for k in range(n):
            np.multiply(part, keys[k], out=product)
            out[step:to, k] = np.minimum.reduceat(product, starts)
        step = to
    return out


def _sequence_hashes(found) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each row's sequence of words."""
    counts = np.diff(found.offsets)
    full = np.flatnonzero(counts)
    at = np.arange(len(found.hashes)) - np.repeat(found.offsets[:-1], counts)
    at = at.astype(np.uint64)
    out = []
    for key in constants(2, 3):
        placed = mix(found.hashes ^ (at * key + key))
        sums = np.zeros(len(counts), np.uint64)
        if len(full):
            sums[full] = np.add.reduceat(placed, found.offsets[full])
        out.append(mix(sums + counts.astype(np.uint64) * key))
    return out[0], out[1]


def signatures(size: int, trees: int, prefix: int):
    """A mapInArrow function: row keys, words' hash, number of shingles, one signature per tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = words(batch.column("text"))
                values, offsets = shingles(found, size)
                counts = np.diff(offsets)
                full = np.flatnonzero(counts)
                mins = _min_hashes(values, offsets, trees * prefix).reshape(-1, trees, prefix)
                keys = np.zeros((len(full), trees), np.uint64)
                for d in range(prefix):
                    keys = keys << np.uint64(LABEL_BITS) | mix(mins[:, :, d]) >> np.uint64(64 - LABEL_BITS)
                lists = np.zeros(len(counts) + 1, np.int32)
                np.cumsum((counts > 0) * trees, out=lists[1:])
                first, second = _sequence_hashes(found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"),
                        batch.column("row_hash"),
                        pa.array(first.view(np.int64)),
                        pa.array(second.view(np.int64)),
                        pa.array(counts.astype(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(lists), pa.array(keys.ravel().view(np.int64))
                        ),
                    ],
                    names=["doc_id", "row_hash", "h1", "h2", "n_shingles", "keys"],
                )

    return run


def shingle_sets(size: int):
    """A mapInArrow function: the words' hash and the sorted distinct shingles of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = words(batch.column("text"))
                first, second = _sequence_hashes(found)
                values, offsets = shingles(found, size)
                sets = [
                    np.unique(values[a:b]).view(np.int64)
                    for a, b in zip(offsets[:-1], offsets[1:], strict=True)
                ]
                lists = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(s) for s in sets], out=lists[1:])
                flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(first.view(np.int64)),
                        pa.array(second.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(lists), pa.array(flat)),
                    ],
                    names=["h1", "h2", "shingles"],
                )

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets of distinct values."""
    if not left or not right:
        return np.zeros((len(left), len(right)), np.int64)
    a, b = np.concatenate(left), np.concatenate(right)
    row_a = np.repeat(np.arange(len(left)), [len(x) for x in left])
    row_b = np.repeat(np.arange(len(right)), [len(x) for x in right])
    shared = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), np.float64)
    at_a, at_b = np.searchsorted(shared, a), np.searchsorted(shared, b)
    in_a = (at_a < len(shared)) & (shared[np.minimum(at_a, len(shared) - 1)] == a) if len(shared) else []
    in_b = (at_b < len(shared)) & (shared[np.minimum(at_b, len(shared) - 1)] == b) if len(shared) else []
    width = 4096
    for low in range(0, len(shared), width):  # incidence matrices of one strip of values at a time
        x = np.zeros((len(left), width), np.float32)
        y = np.zeros((len(right), width), np.float32)
        pick = in_a & (at_a >= low) & (at_a < low + width)
        x[row_a[pick], at_a[pick] - low] = 1
        pick = in_b & (at_b >= low) & (at_b < low + width)
        y[row_b[pick], at_b[pick] - low] = 1
        out += x @ y.T
    return np.rint(out).astype(np.int64)


def spanning_forest(u: np.ndarray, v: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of links between n rows."""
    root = np.arange(n)

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    kept = []
    for i, j in zip(u.tolist(), v.tolist(), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            kept.append((i, j))
            if len(kept) == n - 1:
                break
    return kept


def compare_blocks(threshold: float):
    """An applyInPandas function over one pair of blocks: partial link counts and a forest of links.

    A row (rep, null, n) adds n links to rep; a row (rep, other, null) links two representatives.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        same = bool(pdf["same"].iloc[0])
        pdf = pdf.sort_values(["side", "rep"])
        sets = [np.asarray(s) for s in pdf["shingles"]]
        reps, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy()
        n = len(sets) if same else int((pdf["side"] == 0).sum())
        left, right = (sets, sets) if same else (sets[:n], sets[n:])
        shift = 0 if same else n
        shared = _common(left, right)
        sizes_l = np.array([len(s) for s in left])[:, None]
        sizes_r = np.array([len(s) for s in right])[None, :]
        # shared / union >= threshold, with the division done as a user would do it
        union = sizes_l + sizes_r - shared
        linked = shared / np.maximum(union, 1) >= threshold
        if same:
            np.fill_diagonal(linked, False)
        u, v = np.nonzero(linked)
        counts = np.zeros(len(sets), np.int64)
        np.add.at(counts, u, copies[v + shift])
        if not same:
            np.add.at(counts, v + shift, copies[u])
        links = spanning_forest(u, v + shift, len(sets))
        hit = np.flatnonzero(counts)
        return pd.DataFrame(
            {
                "rep": np.concatenate([reps[hit], reps[[i for i, _ in links]]]).astype("int64"),
                "other": pd.array([None] * len(hit) + [int(reps[j]) for _, j in links], "Int64"),
                "n": pd.array(counts[hit].tolist() + [None] * len(links), "Int64"),
            }
        )

    return run


def _block_pairs(members: DataFrame, nodes: DataFrame, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Members with their block, and the pairs of blocks that hold texts with a common node."""
    # A short text counts as a longer one, so that a block has few texts as well as few shingles.
    volume = members.groupBy("cluster").agg(F.sum(F.greatest("n_shingles", F.lit(128))).alias("volume"))
    n_blocks = F.ceil(F.col("volume") / block_shingles)
    block = F.pmod(F.xxhash64("rep", F.lit(9)), n_blocks)
    members = land(
        members.join(volume, "cluster").select(
            "rep", "least", "h1", "h2", "copies", "cluster", block.alias("block"), n_blocks.alias("n_blocks")
        )
    )
    single = members.where("n_blocks = 1").select("cluster", F.lit(0).alias("b1"), F.lit(0).alias("b2"))
    several = members.where("n_blocks > 1").select("rep", "cluster", "block")
    there = nodes.select("rep", "key").join(several, "rep").select("cluster", "block", "key").distinct()
    other = there.select("key", "cluster", F.col("block").alias("b2"))
    pairs = there.withColumnRenamed("block", "b1").join(other, ["key", "cluster"]).where("b1 <= b2")
    pairs = pairs.select("cluster", "b1", "b2").union(single).distinct()
    return members, land(pairs)


def jaccard_classes(
    docs: DataFrame,
    size: int = 5,
    threshold: float = 0.8,
    trees: int = 20,
    depth: int = MOST_LABELS,
    recall: float = 0.999,
    block_shingles: int = BLOCK_SHINGLES,
    shortest: int = SHORTEST,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, n_links.

    Two rows are linked if the Jaccard similarity of their sets of ``size``-word shingles is at least
    ``threshold``. ``class_id`` is the least doc_id reachable by links, ``n_links`` the number of other
    rows linked directly, copies included.

    Null and empty texts and texts without a word have no shingle: no links, their own class. A text
    of fewer than ``size`` words is one shingle. A repeated row is a copy of itself and counts as a
    link. Unlike rows of one doc_id are compared as rows like others. Rows with a null doc_id are not compared:
    class_id null, n_links 0. Other columns are ignored, so their names can't clash.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("row_hash"))
    classes = _classified(docs, size, threshold, trees, depth, recall, block_shingles, shortest)
    return classes.select("doc_id", "class_id", "n_links")


def _classified(
    docs: DataFrame, size: int, threshold: float, trees: int, depth: int, recall: float, block_shingles: int, shortest: int
) -> DataFrame:
    """doc_id, row_hash, h1, h2, class, class_id, n_links of every row of doc_id, text, row_hash.

    A text is known by a number of its own, not by a document id, which unlike texts may share; ids are put to
    the finished classes. ``class`` is the number of the class; it and the hashes are null for rows that
    are not compared.
    """
    ready(docs.sparkSession)
    prefix = match_depth(trees, depth, threshold, recall)
    features = land(
        docs.mapInArrow(
            released(signatures(size, trees, prefix)),
            "doc_id long, row_hash long, h1 long, h2 long, n_shingles long, keys array<long>",
        )
    )
    texts = features.where("doc_id is not null and n_shingles > 0").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("least"),
        F.count(F.lit(1)).alias("copies"),
        F.first("n_shingles").alias("n_shingles"),
        F.first("keys").alias("keys"),
    )
    texts = land(texts.withColumn("rep", F.monotonically_increasing_id()))
    nodes = forest_nodes(texts.select("rep", "keys"), trees, prefix, threshold, recall, shortest)
    clusters = components(nodes.select("rep", "least"))
    members = texts.join(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep")
    members, pairs = _block_pairs(members, nodes, block_shingles)
    members = members.select("rep", "least", "h1", "h2", "copies", "cluster", "block")
    wanted = keep_keys(
        docs.where("doc_id is not null"), members.select(F.col("least").alias("doc_id")), "doc_id"
    )
    # Other texts of a wanted id fall out of the join.
    sets = wanted.mapInArrow(released(shingle_sets(size)), "h1 long, h2 long, shingles array<long>")
    sets = land(members.drop("least").join(sets.dropDuplicates(["h1", "h2"]), ["h1", "h2"]).drop("h1", "h2"))
    task = ["cluster", "b1", "b2"]
    left = pairs.withColumn("block", F.col("b1")).withColumn("side", F.lit(0))
    right = pairs.where("b1 != b2").withColumn("block", F.col("b2")).withColumn("side", F.lit(1))
    dealt = left.union(right).join(sets, ["cluster", "block"])
    compared_blocks = land(
        dealt.select(*task, (F.col("b1") == F.col("b2")).alias("same"), "side", "rep", "copies", "shingles")
        .groupBy(*task)
        .applyInPandas(compare_blocks(threshold), "rep long, other long, n long")
    )
    n_links = compared_blocks.where("n is not null").groupBy("rep").agg(F.sum("n").alias("n"))
    linked = components(compared_blocks.where("other is not null").select("rep", "other"))
    classed = land(
        texts.drop("keys", "n_shingles")
        .join(linked.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .join(n_links, "rep", "left")
        .withColumn("class", F.coalesce("component", "rep"))
    )
    least = classed.groupBy("class").agg(F.min("least").alias("class_id"))
    by_text = classed.join(least, "class").select(
        "h1", "h2", "class", "class_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    is_compared = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    rows = features.select(
        "doc_id", "row_hash", *[F.when(is_compared, F.col(h)).alias(h) for h in ("h1", "h2")]
    )
    none = F.lit(None).cast("long")
    alone = rows.where("h1 is null").withColumns(
        {"class": none, "class_id": F.col("doc_id"), "n_links": F.lit(0).cast("long")}
    )
    return rows.join(by_text, ["h1", "h2"]).unionByName(alone)


def keep_one_per_class(
    docs: DataFrame,
    size: int = 5,
    threshold: float = 0.8,
    trees: int = 20,
    depth: int = MOST_LABELS,
    recall: float = 0.999,
    block_shingles: int = BLOCK_SHINGLES,
    shortest: int = SHORTEST,
) -> DataFrame:
    """``docs`` with one row of each class: of its rows with the least doc_id the first by hashes of words and row.

    All columns stay. Rows with a null doc_id stay. Rows without a shingle are classes of their own, and of equal
    rows one stays. Unlike texts of one doc_id are rows like others: each class keeps one.
    """
    comparable = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    mark = "_hash_of_row"
    marked = docs.withColumn(mark, F.xxhash64(*comparable))
    narrow = marked.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(mark).alias("row_hash"))
    classes = _classified(narrow, size, threshold, trees, depth, recall, block_shingles, shortest).where("doc_id is not null")
    first = classes.where("class is not null").groupBy("class").agg(
        F.min(F.struct("doc_id", "h1", "h2", "row_hash")).alias("kept")
    )
    kept = first.select("kept.doc_id", "kept.row_hash").union(classes.where("class is null").select("doc_id", "row_hash"))
    kept = kept.distinct().withColumnRenamed("row_hash", mark)
    one = marked.join(kept, ["doc_id", mark], "left_semi").dropDuplicates(["doc_id", mark])
    return one.select(*docs.columns).union(docs.where("doc_id is null"))
