"""Training triplets: positives times as many sampled negatives, per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from rankflow.functions.vectors import DISTANCES, TRIPLET_MARGIN, WEIGHT_DIM, finite
from rankflow.operators.numbering import running_sums
from rankflow.session import land

KEYS = ("query_id", "query_text")
PAYLOAD = (
    "abstract",
    "dbpedia_entity",
    "qrel",
    "biggraph_embedding",
    "deepct_weights",
    "deepct_tokens",
)

# Equal parts of the draw keys that the negatives of a query are counted in.
DRAW_PARTS = 64
# Rows of one query that one task sorts, and pairs of one query that one task emits.
ROWS_PER_TASK = 100_000
PAIRS_PER_TASK = 1_000_000


def positives(candidates: DataFrame) -> DataFrame:
    return candidates.where("qrel > 0")


def judged_negatives(candidates: DataFrame) -> DataFrame:
    """Grade 0; an unjudged candidate is neither positive nor negative."""
    return candidates.where("qrel = 0")


def positive_counts(candidates: DataFrame) -> DataFrame:
    return positives(candidates).groupBy("query_id").agg(F.count("query_text").alias("n_pos"))


def judged_counts(candidates: DataFrame) -> DataFrame:
    """Positives and judged negatives per query, in one pass."""
    return candidates.where("qrel >= 0").groupBy("query_id").agg(
        F.count(F.when(F.col("qrel") > 0, F.col("query_text"))).alias("n_pos"),
        F.count_if(F.col("qrel") == 0).alias("n_neg"),
    )


def skipped_queries(counts: DataFrame) -> DataFrame:
    """Judged queries that give no triplets, and why."""
    reason = F.when(F.col("n_pos") == 0, "no positives").otherwise("too few negatives")
    return counts.where("n_pos = 0 or n_pos > n_neg").withColumn("reason", reason)


def draw_key(seed: int, *parts: str) -> Column:
    """Order of the draw: a hash of seed and identity, the same on every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def negative_sample(
    candidates: DataFrame,
    seed: int = 42,
    identity: tuple[str, ...] = ("query_id", "dbpedia_entity"),
    tie: tuple[str, ...] = ("hit",),
    parts: DataFrame | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """As many judged negatives per query as it has positives, without replacement.

    The sample is the first ``n_pos`` negatives in draw order; rows that tie are told apart by
    ``tie``, then by a hash of the whole row, so the sample does not depend on the partitions. No query's
    negatives are sorted: ``draw_parts`` counts them, and only the part that holds a query's last sampled row
    is ranked. That gives a cut per query, and the candidates are filtered by it where they lie;
    nothing but keys is shuffled before.
    """
    parts = draw_parts(candidates, seed, identity) if parts is None else parts
    negatives = judged_negatives(candidates)
    keys = list(dict.fromkeys(("query_id", *identity, *tie)))
    cuts, in_excess = _key_cuts(_with_draw(negatives.select(*keys), seed, identity, tie), parts, rows_per_task)
    marked = _with_draw(negatives, seed, identity, tie).join(cuts, "query_id")
    below = (F.col("_part") < F.col("_cut")) | ((F.col("_part") == F.col("_cut")) & (F.col("_key") < F.col("_last")))
    at = (F.col("_part") == F.col("_cut")) & (F.col("_key") == F.col("_last"))
    columns = [*candidates.columns, "n_pos"]
    whole = marked.where(below | (at & (F.col("_take") == F.col("_same")))).select(*columns)
    if not in_excess:
        return whole
    tied = marked.where(at & (F.col("_take") < F.col("_same")))
    return whole.unionByName(_first_by_hash(tied, candidates.columns).select(*columns))


def draw_parts(
    candidates: DataFrame, seed: int = 42, identity: tuple[str, ...] = ("query_id", "dbpedia_entity")
) -> DataFrame:
    """(query_id, n_pos, n_neg, _cut, _need) of the queries that are sampled, landed, from one pass over the keys.

    The draw keys of a query fall in ``DRAW_PARTS`` equal parts, whose counts the tasks add up. The last sampled
    negative lies in part ``_cut``, of which ``_need`` rows are sampled.
    """
    judged = candidates.where("qrel >= 0")
    keys = list(dict.fromkeys(("query_id", *identity)))
    marked = judged.select(
        *keys, (F.col("qrel") > 0).alias("_positive"), (F.col("query_text").isNotNull() | (F.col("qrel") == 0)).alias("_counts")
    ).where("_counts and query_id is not null")
    drawn = marked.withColumn("_draw", draw_key(seed, *identity))
    part = F.when(F.col("_positive"), -1).otherwise(_part_of(F.col("_draw")))
    sizes = drawn.groupBy("query_id", part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    query = Window.partitionBy("query_id")  # one row per part
    n_pos = F.sum(F.when(F.col("_part") < 0, F.col("_rows")).otherwise(0)).over(query)
    before = F.sum(F.when(F.col("_part") >= 0, F.col("_rows")).otherwise(0)).over(
        query.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = sizes.withColumns({"n_pos": n_pos, "_all": F.sum("_rows").over(query), "_before": F.coalesce(before, F.lit(0))})
    last = sizes.where("_part >= 0 and _before < n_pos and n_pos <= _before + _rows")
    return land(
        last.select(
            "query_id", "n_pos", (F.col("_all") - F.col("n_pos")).alias("n_neg"), F.col("_part").alias("_cut"),
            (F.col("n_pos") - F.col("_before")).alias("_need"), "_rows",
        )
    )


def _part_of(draw: Column) -> Column:
    return F.floor(F.conv(F.substring(draw, 1, 8), 16, 10).cast("double") * F.lit(DRAW_PARTS / 2.0**32)).cast("int")


def _with_draw(rows: DataFrame, seed: int, identity, tie) -> DataFrame:
    """The draw key, its part, and the whole key in draw order."""
    drawn = rows.withColumn("_draw", draw_key(seed, *identity))
    return drawn.withColumns({"_part": _part_of(F.col("_draw")), "_key": F.struct("_draw", *tie)})


def _key_cuts(drawn: DataFrame, parts: DataFrame, rows_per_task: int) -> tuple[DataFrame, bool]:
    """Per query the key of the last sampled row, and whether any has more rows at that key than are sampled.

    Of the ``_same`` rows at that key, ``_take`` are sampled.
    """
    edge = drawn.join(parts.select("query_id", "_cut"), "query_id").where(F.col("_part") == F.col("_cut"))
    edge = edge.groupBy("query_id", "_key").agg(F.count(F.lit(1)).alias("_same"))
    if (parts.agg(F.max("_rows")).first()[0] or 0) <= rows_per_task:
        upto = Window.partitionBy("query_id").orderBy("_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        edge = edge.withColumn("_upto", F.sum("_same").over(upto))
    else:
        edge = running_sums(edge, ["query_id"], ["_key"], {"_upto": "_same"})
    cuts = edge.join(parts, "query_id").where("_upto - _same < _need and _need <= _upto")
    take = F.expr("_need - _upto + _same")
    cuts = cuts.select("query_id", "n_pos", "_cut", F.col("_key").alias("_last"), "_same", take.alias("_take"))
    excess = Observation()
    # Written with the table: no further pass to find out.
    cuts = land(cuts.observe(excess, F.max(F.col("_same") - F.col("_take")).alias("most")))
    return cuts, (excess.get["most"] or 0) > 0


def _first_by_hash(tied: DataFrame, columns: list[str]) -> DataFrame:
    """Of rows that agree in the draw key, the first ``_take`` per query by a hash of the whole row."""
    tied = tied.withColumn("_hash", F.xxhash64(*columns))
    hashes = tied.groupBy("query_id", "_hash", "_take").agg(F.count(F.lit(1)).alias("_n"))
    hashes = running_sums(hashes, ["query_id"], ["_hash"], {"_upto": "_n"}).where("_upto - _n < _take")
    hashes = land(hashes.withColumn("_copies", F.least(F.col("_n"), F.expr("_take - _upto + _n"))).drop("_take", "_upto"))
    full = tied.join(hashes.where("_copies = _n").select("query_id", "_hash"), ["query_id", "_hash"], "left_semi")
    # Rows of one hash are equal: one of them stands for as many as are taken.
    some = tied.join(hashes.where("_copies < _n").drop("_n"), ["query_id", "_hash"]).dropDuplicates(["query_id"])
    some = some.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return full.unionByName(some.drop("_copies", "_copy"))


def _side(rows: DataFrame, suffix: str) -> DataFrame:
    renamed = {c: f"{c}_{suffix}" for c in PAYLOAD if c in rows.columns}
    keep = [c for c in (*KEYS, "_salt", *PAYLOAD) if c in rows.columns]
    return rows.select(*keep).withColumnsRenamed(renamed)


def build_triplets(
    candidates: DataFrame,
    seed: int = 42,
    pairs_per_task: int = PAIRS_PER_TASK,
    **sample,
) -> DataFrame:
    """Each positive (``_x``) with each sampled negative (``_y``) of its query.

    A query gives n_pos squared rows. Where that is more than ``pairs_per_task``, its positives are
    dealt over salts and its few negatives are repeated for each salt.
    """
    parts = draw_parts(candidates, seed, sample.get("identity", ("query_id", "dbpedia_entity")))
    salts = F.ceil(F.col("n_pos") * F.col("n_pos") / pairs_per_task)
    negatives = negative_sample(candidates, seed, parts=parts, **sample)
    negatives = negatives.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    positive = positives(candidates).join(parts.select("query_id", "n_pos"), "query_id")
    positive = positive.withColumn(
        "_salt", F.pmod(F.xxhash64("dbpedia_entity", "abstract"), salts)
    )
    pairs = _side(positive, "x").join(_side(negatives, "y"), [*KEYS, "_salt"])
    return pairs.drop("_salt")


def triplet_loss(
    triplets: DataFrame,
    anchor: str,
    positive: str,
    negative: str,
    metric: str = "euclidean",
    margin: float = TRIPLET_MARGIN,
) -> DataFrame:
    """Mean of max(d(anchor, positive) - d(anchor, negative) + margin, 0).

    A triplet without one of its vectors has no loss and doesn't count.
    """
    distance = DISTANCES[metric]
    gap = distance(F.col(anchor), F.col(positive)) - distance(F.col(anchor), F.col(negative))
    hinge = F.when(gap.isNotNull(), F.greatest(gap + F.lit(margin), F.lit(0.0)))
    return triplets.agg(F.avg(hinge).alias("loss"))


def shape_triplets(
    triplets: DataFrame, graph: bool = False, weights: bool = False, weight_dim: int = WEIGHT_DIM
) -> DataFrame:
    """The columns a training step reads."""
    return _shape(
        triplets,
        {"query_sentence": "query_text", "pos_sentence": "abstract_x", "neg_sentence": "abstract_y"},
        {"pos_biggraph": "biggraph_embedding_x", "neg_biggraph": "biggraph_embedding_y"},
        {"pos_deepct": "deepct_weights_x", "neg_deepct": "deepct_weights_y"},
        graph,
        weights,
        weight_dim,
    )


def shape_candidates(
    candidates: DataFrame, graph: bool = False, weights: bool = False, weight_dim: int = WEIGHT_DIM
) -> DataFrame:
    """The columns a scoring step reads."""
    return _shape(
        candidates,
        {"query_sentence": "query_text", "retrieval_sentence": "abstract"},
        {"biggraph": "biggraph_embedding"},
        {"deepct": "deepct_weights"},
        graph,
        weights,
        weight_dim,
    )


def _shape(rows, sentences, graph_columns, weight_columns, graph, weights, weight_dim) -> DataFrame:
    columns = [F.col(c).alias(n) for n, c in sentences.items()]
    if graph:
        columns += [F.col(c).alias(n) for n, c in graph_columns.items()]
    if weights:
        columns += [finite(F.col(c), weight_dim).alias(n) for n, c in weight_columns.items()]
    return rows.select(*columns)
