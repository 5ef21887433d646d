"""A Merkle tree over a dataset: one subtree per group, a proof for every row.

A leaf is the digest of a row's fields. Within a group the leaves are numbered by a range-partitioned sort, and
sixteen consecutive nodes are a run, whose digest is a node of the next level; the groups' last nodes are the
leaves of one more tree, which ends in the root. A run is the window of its nodes: lag and lead columns at the
fixed offsets 1 to 15, masked by the node's slot and the length of the run, give its siblings, and the row in
slot 0 hashes the run to the parent. A window never holds more than a run, so a group of any size, one source
with a third of all rows too, is spread over all tasks; texts are hashed where they are read and never move.

Proofs come from the top down: a node's path is its own siblings and then its parent's path, joined by number.
Only the rows of the highest levels, a sixteenth of the leaves at most, are kept with their paths; every level
is a table in the shared folder. The driver sees one number per level and the root.

Rows with a null group form a group of their own, before all others. Within a group null keys come first, rows
of one key in the order of their digests; equal rows are leaves of their own. An empty table has no root.
Other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankflow.operators.numbering import dense_ordinal
from rankflow.session import land

FANOUT = 16
#: monotonically_increasing_id() holds the partition above these bits.
_PART_BITS = 33


class Tree(NamedTuple):
    """Node tables from the leaves up: ``levels`` of the groups, ``upper`` of the tree over them, and the root.

    A node table has key, p (place within the key), n (nodes of the key on this level) and digest; that of the
    leaves also has their other columns. A key's last node has n = 1.
    """

    levels: list[DataFrame]
    upper: list[DataFrame]
    root: str | None


def field(value: Column) -> Column:
    """A value as its bytes' count, a colon and its UTF-8 text; a null is a hyphen."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _numbered(leaves: DataFrame, group: str, order: str) -> DataFrame:
    """Leaves with key, p and n. Equal rows are told apart by a row number, so that no range is one key."""
    sorted_ = leaves.withColumn("_tie", F.monotonically_increasing_id()).orderBy(group, order, "digest", "_tie")
    placed = land(
        sorted_.drop("_tie").withColumns({"key": field(F.col(group)), "_place": F.monotonically_increasing_id()})
    ).withColumn("_part", F.shiftright("_place", _PART_BITS))
    runs = placed.groupBy("_part", "key").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_start"))
    whole = Window.partitionBy("key")  # one row per sorted partition that holds rows of the key
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumns(
        {"_before": F.coalesce(F.sum("_rows").over(before), F.lit(0)), "n": F.sum("_rows").over(whole)}
    )
    numbered = placed.join(land(runs.drop("_rows")), ["_part", "key"])
    place = (F.col("_before") + F.col("_place") - F.col("_start")).alias("p")
    return numbered.select("key", place, "n", *leaves.columns)


def _slot() -> Column:
    return F.col("p") % FANOUT


def _offsets(towards: int) -> list[Column]:
    """The digests beside a node, from left to right: those before it, or those after it, in its run."""
    window = Window.partitionBy("key", "run").orderBy("p")
    length = F.least(F.lit(FANOUT), F.col("n") - F.col("run") * FANOUT)
    if towards < 0:
        return [F.when(_slot() >= i, F.lag("digest", i).over(window)) for i in range(FANOUT - 1, 0, -1)]
    return [F.when(_slot() + i < length, F.lead("digest", i).over(window)) for i in range(1, FANOUT)]


def _in_runs(nodes: DataFrame) -> DataFrame:
    """The nodes that have a level above them, with the number of their run: the parent's place."""
    return nodes.where(F.col("n") > 1).withColumn("run", F.floor(F.col("p") / FANOUT))


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: the first child of each run hashes the run."""
    led = _in_runs(nodes).select("key", "p", "n", "run", "digest", F.concat_ws("", *_offsets(1)).alias("after"))
    return led.where(_slot() == 0).select(
        "key",
        F.col("run").alias("p"),
        F.ceil(F.col("n") / FANOUT).alias("n"),
        F.sha2(F.concat("digest", "after"), 256).alias("digest"),
    )


def siblings(nodes: DataFrame) -> DataFrame:
    """The nodes below another level, with the digests before and after them in their run."""
    beside = F.struct(
        F.concat_ws("", *_offsets(-1)).alias("before"), F.concat_ws("", *_offsets(1)).alias("after")
    )
    return _in_runs(nodes).withColumn("beside", beside)


def _levels(nodes: DataFrame, most: int) -> list[DataFrame]:
    found = [nodes]
    while most > 1:
        found.append(land(parents(found[-1])))
        most = -(-most // FANOUT)
    return found


def build_tree(leaves: DataFrame, group: str = "source", order: str = "doc_id") -> Tree:
    """The tree of a table with a column ``digest``, the leaf, a group and a key to order its rows by."""
    nodes = _numbered(leaves, group, order)
    levels = _levels(nodes, nodes.agg(F.max("n")).first()[0] or 0)
    last = [nodes.where(F.col("n") == 1).select("key", "digest") for nodes in levels]
    subroots = last[0]
    for more in last[1:]:
        subroots = subroots.unionByName(more)
    names = nodes.groupBy("key").agg(F.min(group).alias("_name"))
    subroots = dense_ordinal(subroots.join(names, "key"), ["_name", "key"], "p").withColumnRenamed("key", "group_key")
    count = subroots.count()
    top = subroots.select(F.lit("").alias("key"), "p", F.lit(count).cast("long").alias("n"), "digest", "group_key")
    upper = _levels(top, count)
    root = upper[-1].select("digest").first()
    return Tree(levels, upper, root[0] if root else None)


_NO_PATH = "cast(array() as array<struct<before: string, after: string>>)"


def _paths(levels: Sequence[DataFrame], above: DataFrame) -> DataFrame:
    """The first level with path and subroot; ``above`` has those of each key's last node."""
    found = None
    for level, nodes in reversed(list(enumerate(levels))):
        alone = nodes.where(F.col("n") == 1).join(above, "key")
        if found is not None:
            up = found.select("key", F.col("p").alias("run"), F.col("path").alias("rest"), "subroot")
            # The window of the siblings and this join share one partitioning by key and run.
            inner = siblings(nodes).join(up, ["key", "run"])
            inner = inner.withColumn("path", F.concat(F.array("beside"), "rest")).drop("beside", "rest", "run")
            alone = alone.unionByName(inner)
        found = land(alone) if level else alone
    return found


def proofs(tree: Tree) -> DataFrame:
    """Every leaf with ``subroot`` and ``path``: for each level up to the root, the digests before and after."""
    top = tree.upper[0].select("key").distinct().select(
        "key", F.expr(_NO_PATH).alias("path"), F.lit(None).cast("string").alias("subroot")
    )
    subtrees = _paths(tree.upper, top).select(
        F.col("group_key").alias("key"), "path", F.col("digest").alias("subroot")
    )
    return _paths(tree.levels, land(subtrees))


def path_digest(path: Column) -> Column:
    """The digest of all siblings of a proof, level by level and from left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s["before"], s["after"]))), 256)


def fold(path: Column, leaf: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def lower_cased(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def verify_tampered(docs: DataFrame, tampered: Column) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row of ``docs``.

    Where ``tampered`` holds, the text is lower-cased (A-Z) before its leaf is made anew and folded with the
    proof of the original row.
    """
    values = [F.col(c) for c in FIELDS]
    claimed = F.when(tampered, row_digest(*values[:-1], lower_cased(values[-1])))
    leaves = docs.select("doc_id", "source", row_digest(*values).alias("digest"), claimed.alias("claimed"))
    tree = build_tree(leaves)
    folded = fold(F.col("path"), F.coalesce("claimed", "digest"))
    return proofs(tree).select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        F.lit(tree.root).cast("string").alias("root"),
        path_digest(F.col("path")).alias("proof_sha256"),
        folded.alias("folded_root"),
        F.coalesce(folded == F.lit(tree.root), F.lit(False)).alias("verified"),
    )
