"""Connected components of an edge table by alternating large-star and small-star steps.

No step gathers the neighbours of a node: both steps are a minimum per node (summed up before the
shuffle) and a join. The rounds end when all links are stars, which a further round would not change. Nodes with more than a thousandth of the rows, of which there are fewer than a thousand,
meet their minimum by a broadcast; the rows of all others are shuffled. Each round is landed in the shared
folder, so a lost executor costs no more than the round it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.session import land

_MAX_ROUNDS = 60
#: A node is hot if it has more than one of this many parts of all rows.
HOT_PARTS = 1000


def _with_least(rows: DataFrame, least: DataFrame, n_rows: int) -> DataFrame:
    """``rows`` (u, v), at most ``n_rows``, with m of ``least`` (u, m, n), landed, where n counts the rows of u."""
    is_hot = F.col("n") > -(-n_rows // HOT_PARTS)
    # Bounded: the n of all nodes add up to the rows, so fewer than HOT_PARTS nodes are hot.
    hot = least.where(is_hot).select("u", F.col("m").alias("hot_m"))
    marked = rows.join(F.broadcast(hot), "u", "left")
    of_hot = marked.where("hot_m is not null").select("u", "v", F.col("hot_m").alias("m"))
    others = marked.where("hot_m is null").select("u", "v").join(least.where(~is_hot).select("u", "m"), "u")
    return of_hot.union(others)


def _stars(edges: DataFrame, n_edges: int) -> DataFrame:
    """Large-star: link larger neighbours of each node to the least node in its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = land(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("v").alias("n")))
    return (
        _with_least(both, least, 2 * n_edges)
        .where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_stars(edges: DataFrame, n_edges: int) -> DataFrame:
    """Small-star: link smaller neighbours and the node itself to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = land(down.groupBy("u").agg(F.min("v").alias("m"), F.count("v").alias("n")))
    moved = _with_least(down, least, n_edges).where(F.col("v") != F.col("m"))
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.select("u", F.col("m").alias("v"))
    )


def _counts(links: DataFrame) -> tuple[int, int]:
    """Number of links, and of nodes that keep them from being stars, where every node links to a centre or is one."""
    ups = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    downs = links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    nodes = ups.union(downs).groupBy("node").agg(F.sum("up").alias("ups"), F.max("down").alias("centre"))
    is_chained = (F.col("ups") + F.col("centre") > 1).cast("long")
    counts = nodes.agg(F.coalesce(F.sum("ups"), F.lit(0)), F.coalesce(F.sum(is_chained), F.lit(0))).first()
    return counts[0], counts[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, for every node of an edge.

    ``edges`` has two columns u and v of one orderable type. Loops and repeated edges are allowed;
    edges with a null are ignored. A node that only has a loop is its own component.
    """
    u, v = edges.columns
    edges = edges.select(F.col(u).alias("u"), F.col(v).alias("v"))
    edges = land(edges.where("u is not null and v is not null").distinct())
    loops = edges.where("u = v").select("u")
    links = edges.where("u != v")
    n_links = links.count()
    for _ in range(_MAX_ROUNDS):
        large = land(_stars(links, n_links).distinct())
        links = land(_small_stars(large, 2 * n_links).distinct())
        n_links, n_chained = _counts(links)
        if not n_chained:
            break
    else:
        raise RuntimeError("connected components did not settle")
    # The centre of a star is its least node; of a node that has a loop as well the star's row is the lesser one.
    found = links.union(links.select("v", "v")).union(loops.select("u", "u")).toDF("node", "component")
    return land(found.groupBy("node").agg(F.min("component").alias("component")))
