"""One query per operator group, run over whole tables."""

from __future__ import annotations

import sys
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import checks
from checks import fixtures as fx
from checks.files import FILES, stored_head
from checks.fixtures import shown
from rankflow.functions import text, vectors
from rankflow.operators import candidates as cand
from rankflow.operators import difference, entities, folds, losses, pooling, retrieval, scoring, triplets
from rankflow.operators.numbering import rank_in_group
from rankflow.session import land, ship
from rankflow.sources import parse_quads

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        ship(spark, checks)
        return fn(spark, sf)

    QUERIES[fn.__name__] = run
    return run


@query
def tokenize_counts(spark, sf):
    terms = retrieval.token_counts(fx.documents(spark, sf), "doc_id", "text")
    return terms.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@query
def query_terms(spark, sf):
    return retrieval.query_terms(fx.queries(spark, sf))


@query
def postings(spark, sf):
    found = retrieval.postings(fx.documents(spark, sf), "doc_id", "text")
    positions = F.array_join(F.transform("positions", lambda p: p.cast("string")), ",")
    return found.withColumn("positions", positions)


@query
def doc_vectors(spark, sf):
    entries = F.transform(
        "terms", lambda t: F.concat(t["term"], F.lit(":"), t["tf"].cast("string"))
    )
    return retrieval.doc_vectors(fx.documents(spark, sf), "doc_id", "text").select(
        "doc_id", "doc_length", F.array_join(entries, " ").alias("terms")
    )


@query
def corpus_stats(spark, sf):
    stats = retrieval.corpus_stats(fx.index(spark, sf))
    return stats.withColumn("avg_length", F.round("avg_length", 6))


@query
def document_frequency(spark, sf):
    return retrieval.document_frequency(fx.index(spark, sf))


@query
def bm25_topk(spark, sf):
    return retrieval.bm25_search(fx.search_index(spark, sf), fx.queries(spark, sf), fx.K)


@query
def bm25_repeated_ids(spark, sf):
    """Documents named by their length: those of one length are one document."""
    docs = fx.table(spark, sf, "documents").select("n_chars", "text")
    index = land(retrieval.doc_vectors(docs, "n_chars", "text"))
    return retrieval.bm25_search(index, fx.queries(spark, sf), fx.K)


@query
def bm25_topk_stopped(spark, sf):
    index = fx.search_index(spark, sf)
    stop = index.frequencies.where(F.col("df") * 4 > index.n_docs).select("term")
    return retrieval.bm25_search(index, fx.queries(spark, sf), fx.K, stop_words=land(stop))


@query
def quad_parse(spark, sf):
    parsed = parse_quads(fx.quad_lines(spark, sf))
    return parsed.withColumn("abstract", F.md5("abstract"))


@query
def literal_clean(spark, sf):
    parsed = parse_quads(fx.quad_lines(spark, sf))
    return parsed.select("url_dbpedia", text.clean_literal(F.col("abstract")).alias("abstract"))


@query
def entity_key(spark, sf):
    entity = text.entity_key(F.col("url_dbpedia"))
    return fx.corpus(spark, sf).select(
        "url_dbpedia", entity.alias("dbpedia_entity"), text.entity_title(entity).alias("title")
    )


@query
def run_corpus_join(spark, sf):
    found = cand.attach_corpus(fx.run(spark, sf), fx.corpus(spark, sf))
    return found.withColumn("abstract", F.md5("abstract"))


@query
def run_corpus_filtered(spark, sf):
    """The same with a Bloom filter of the keys, as if they were too many for a broadcast."""
    found = cand.attach_corpus(fx.run(spark, sf), fx.corpus(spark, sf), broadcast_bytes=64 << 10)
    return found.withColumn("abstract", F.md5("abstract"))


@query
def run_grades(spark, sf):
    built = cand.build_candidates(
        fx.run(spark, sf), fx.corpus(spark, sf), fx.queries(spark, sf), fx.grades(spark, sf)
    )
    kept = ("query_index", "hit", "score", "dbpedia_entity", "query_id", "query_text", "qrel")
    return cand.sort_candidates(built.select(*kept))


def _with_entities(spark, sf) -> DataFrame:
    """Each distinct entity is looked up once and then joined to all its candidates."""
    return cand.attach_entities(fx.candidates(spark, sf), fx.entity_table(spark, sf))


@query
def title_lookup(spark, sf):
    return _with_entities(spark, sf).select(
        "query_index", "hit", "dbpedia_entity", "title_to_id_wikidata", "entity"
    )


@query
def entity_index(spark, sf):
    return _with_entities(spark, sf).select("query_index", "hit", "entity", "entity_index")


@query
def vector_attach(spark, sf):
    filled = cand.fill_vectors(_with_entities(spark, sf), fx.DIM)
    return filled.select(
        "query_index", "hit", "entity", shown(F.col("biggraph_embedding")).alias("vector")
    )


@query
def position_attach(spark, sf):
    """Weights by row position, different for every row, where titles stand twice in their map."""
    ids = fx.title_map(spark, sf)
    twice = ids.union(ids.select("title", F.concat("wikidata_id", F.lit("b")).alias("wikidata_id")))
    keys = fx.candidates(spark, sf).select("query_index", "hit", "url_dbpedia", "dbpedia_entity", "query_text")
    entities_of = land(cand.attach_wikidata(keys.select("dbpedia_entity").distinct(), twice))
    merged = cand.number_candidates(cand.attach_entities(keys, entities_of))
    tokens = text.tokens(F.col("query_text"))
    weights = merged.select(
        "ordinal",
        tokens.alias("deepct_tokens"),
        F.transform(tokens, lambda t: F.length(t).cast("double") / 10 + F.col("ordinal")).alias("deepct_weights"),
    )
    rows = cand.attach_token_weights(merged, weights)
    # Rows of one hit differ in the id alone, and which comes first is a matter of the row's hash.
    by_hit = rows.groupBy("query_index", "hit")
    return by_hit.agg(
        F.min("ordinal").alias("first_ordinal"),
        F.count(F.lit(1)).alias("n_rows"),
        F.array_join(F.min("deepct_tokens"), " ").alias("tokens"),
        shown(F.min("deepct_weights")).alias("weights"),
    )


@query
def ranked_negatives(spark, sf):
    """Rank of every judged negative of a query in draw order, without a window per query."""
    drawn = triplets.judged_negatives(fx.candidates(spark, sf)).select(
        "query_id", "dbpedia_entity", triplets.draw_key(fx.SEED, "query_id", "dbpedia_entity").alias("draw")
    )
    return rank_in_group(drawn, ["query_id"], ["draw"], "draw_rank")


@query
def weights_deinterleave(spark, sf):
    items = F.col("items")
    return fx.weight_lines(spark, sf).select(
        "doc_id",
        F.array_join(vectors.even_items(items), " ").alias("tokens"),
        F.array_join(vectors.odd_items(items), " ").alias("weights"),
    )


@query
def nan_fill(spark, sf):
    """One weight per word of a turn, in rows of one width; short words are not finite."""
    words = text.tokens(F.col("text"))
    raw = F.transform(
        words,
        lambda t: F.when(F.length(t) == 1, "nan")
        .when(F.length(t) == 2, "inf")
        .when(F.length(t) == 3, "-inf")
        .when(F.length(t) == 4, "?")
        .otherwise((F.length(t).cast("double") / 10).cast("string")),
    )
    turns = fx.table(spark, sf, "conversations")
    width = turns.agg(F.max(F.size(words))).first()[0]
    filled = vectors.finite(vectors.to_weights(raw), width)
    top = F.lit(sys.float_info.max)

    def marked(x):
        return F.when(x == top, 1e6).when(x == -top, -1e6).otherwise(x)

    turns = turns.select("conv_id", "turn", filled.alias("filled"))
    return turns.select("conv_id", "turn", F.size("filled").alias("n"), F.md5(shown(F.col("filled"), marked)).alias("weights"))


@query
def fold_split(spark, sf):
    rows = folds.split_folds(fx.candidates(spark, sf), fx.folds(spark, sf))
    return rows.select("fold", "split", "query_id", "dbpedia_entity", "hit", "qrel")


@query
def fold_counts(spark, sf):
    return folds.fold_counts(folds.split_folds(fx.candidates(spark, sf), fx.folds(spark, sf)))


@query
def fold_triplets(spark, sf):
    rows = folds.split_folds(
        fx.built_triplets(spark, sf).select("query_id", "dbpedia_entity_x", "dbpedia_entity_y"),
        fx.folds(spark, sf),
    )
    return folds.fold_counts(rows)


@query
def positive_counts(spark, sf):
    return triplets.positive_counts(fx.candidates(spark, sf))


@query
def skipped_queries(spark, sf):
    """With quality as the grade, most queries have too few negatives."""
    quality = fx.table(spark, sf, "labels").select(
        F.concat(F.lit("<dbpedia:Doc_"), F.col("doc_id").cast("string"), F.lit(">")).alias(
            "dbpedia_entity"
        ),
        F.col("quality").alias("qrel"),
    )
    graded = fx.candidates(spark, sf).drop("qrel").join(quality, "dbpedia_entity", "left")
    return triplets.skipped_queries(triplets.judged_counts(graded))


@query
def negative_sample(spark, sf):
    drawn = triplets.negative_sample(fx.candidates(spark, sf), fx.SEED)
    return drawn.select("query_id", "dbpedia_entity", "hit", "n_pos")


@query
def triplet_rows(spark, sf):
    rows = triplets.build_triplets(fx.candidates(spark, sf), fx.SEED)
    return rows.withColumn("abstract_x", F.md5("abstract_x")).withColumn(
        "abstract_y", F.md5("abstract_y")
    )


@query
def training_rows(spark, sf):
    rows = triplets.shape_triplets(fx.built_triplets(spark, sf), graph=True)
    return rows.select(
        "query_sentence",
        F.md5("pos_sentence").alias("pos_sentence"),
        F.md5("neg_sentence").alias("neg_sentence"),
        shown(F.col("pos_biggraph")).alias("pos_biggraph"),
        shown(F.col("neg_biggraph")).alias("neg_biggraph"),
    )


@query
def scoring_rows(spark, sf):
    """Candidates with their weights, not a number where a token has one letter."""
    shaped = triplets.shape_candidates(
        fx.vector_candidates(spark, sf), graph=True, weights=True, weight_dim=fx.WEIGHT_DIM
    )
    return shaped.select(
        "query_sentence",
        F.md5("retrieval_sentence").alias("retrieval_sentence"),
        shown(F.col("biggraph")).alias("biggraph"),
        shown(F.col("deepct")).alias("deepct"),
    )


def _vector_pairs(spark, sf) -> DataFrame:
    """Query and document vectors of every hit; a missing one is zero."""
    embedded = fx.table(spark, sf, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    left = embedded.select(F.col("vec_id").alias("query_index"), F.col("v").alias("a"))
    right = embedded.select(F.col("vec_id").alias("doc_id"), F.col("v").alias("b"))
    hits = fx.run(spark, sf).select(
        "query_index", fx.doc_id_of(F.col("url_dbpedia")).alias("doc_id")
    )
    joined = hits.join(left, "query_index", "left").join(right, "doc_id", "left")
    filled = {c: vectors.zero_fill(F.col(c), fx.DIM, 0.0) for c in "ab"}
    return joined.withColumns(filled)


def _distance(name: str):
    def run(spark, sf):
        score = vectors.DISTANCES[name](F.col("a"), F.col("b"))
        return _vector_pairs(spark, sf).select(
            "query_index", "doc_id", F.round(score, 6).alias("distance")
        )

    run.__name__ = f"dist_{name}"
    return query(run)


for _name in vectors.DISTANCES:
    _distance(_name)


def _anchored(spark, sf, rows: DataFrame) -> DataFrame:
    """Rows with the vector of their query; null where there is none."""
    anchors = fx.table(spark, sf, "embeddings").select(
        F.concat(F.lit("Q_"), F.col("vec_id").cast("string")).alias("query_id"),
        F.col("embedding").alias("anchor"),
    )
    return rows.join(anchors, "query_id", "left")


def _sampled_loss(metric: str):
    def run(spark, sf):
        """The loss of all pairs of positives and sampled negatives, none of which is built."""
        rows = _anchored(spark, sf, fx.vector_candidates(spark, sf))
        loss = losses.sampled_loss(rows, "anchor", "biggraph_embedding", metric, margin=0.5, seed=fx.SEED)
        return loss.select(F.round("loss", 6).alias("loss"), "n_pairs")

    run.__name__ = f"sampled_loss_{metric}"
    return query(run)


for _name in vectors.DISTANCES:
    _sampled_loss(_name)


@query
def triplet_loss(spark, sf):
    """The query's vector against the filled vectors of positive and negative."""
    rows = _anchored(spark, sf, fx.built_triplets(spark, sf))
    return triplets.triplet_loss(
        rows, "anchor", "biggraph_embedding_x", "biggraph_embedding_y", margin=0.5
    ).select(F.round("loss", 6).alias("loss"))


@query
def feature_concat(spark, sf):
    joined = vectors.features(
        F.col("embedding"), F.reverse("embedding"), F.array(F.col("label").cast("double"))
    )
    return fx.table(spark, sf, "embeddings").select("vec_id", shown(joined).alias("features"))


@query
def head_projection(spark, sf):
    rows = fx.table(spark, sf, "embeddings").select("vec_id", "embedding")
    projected = scoring.head_projection(rows, "embedding", "projected", fx.test_head())
    return projected.select(
        "vec_id", *[F.round(F.get("projected", F.lit(i)), 6).alias(f"p{i}") for i in range(4)]
    )


@query
def mean_pool(spark, sf):
    length = F.length("token") * F.lit(0.7310585786)
    bare = F.length(F.replace("token", F.lit("e"), F.lit(""))) * F.lit(0.7310585786)
    table = land(
        retrieval.document_frequency(fx.index(spark, sf))
        .select(F.col("term").alias("token"))
        .select("token", F.array(length, bare).alias("vector"))
    )
    pooled = pooling.mean_pool(fx.index(spark, sf), table)
    return pooled.select(
        "doc_id", *[F.round(F.get("mean_vector", F.lit(i)), 6).alias(f"m{i}") for i in range(2)]
    )


def _scores(spark, sf, **more) -> DataFrame:
    return scoring.score_candidates(
        fx.candidates(spark, sf), "letters@1", fx.letter_encoder, **more
    )


@query
def score_candidates(spark, sf):
    return _scores(spark, sf).withColumn("score", F.round("score", 6))


def _vector_model(spark) -> dict:
    """Letters, graph and weight vectors, and a head that comes from a table."""
    head = stored_head(spark, fx.wide_head())
    return {"head": head, "graph": True, "weights": True, "weight_dim": fx.WEIGHT_DIM}


@query
def score_graph_weights_head(spark, sf):
    rows = scoring.score_candidates(
        fx.vector_candidates(spark, sf), "letters@3", fx.letter_encoder, **_vector_model(spark)
    )
    return rows.withColumn("score", F.round("score", 6))


@query
def model_triplet_loss(spark, sf):
    """Loss of the whole model, from texts and vectors to one number."""
    loss = scoring.model_triplet_loss(
        fx.built_triplets(spark, sf), fx.letter_encoder, margin=0.5, **_vector_model(spark)
    )
    return loss.select(F.round("loss", 6).alias("loss"))


@query
def model_sampled_loss(spark, sf):
    """The same number from the candidates, without triplets."""
    loss = scoring.model_sampled_loss(
        fx.vector_candidates(spark, sf), fx.letter_encoder, margin=0.5, seed=fx.SEED, **_vector_model(spark)
    )
    return loss.select(F.round("loss", 6).alias("loss"), "n_pairs")


@query
def score_skip_existing(spark, sf):
    """Judged candidates are scored already, so only the unjudged are scored now."""
    judged = scoring.with_passage_key(fx.candidates(spark, sf).where("qrel is not null"))
    existing = judged.select(
        F.lit("letters@1").alias("experiment"), *scoring.SCORE_KEYS, F.lit(0.0).alias("score")
    )
    return _scores(spark, sf, existing=existing).withColumn("score", F.round("score", 6))


@query
def score_grid(spark, sf):
    """Three distances and a model with a head, in one pass over the candidates."""
    plain = [
        {"experiment": f"letters@1 {m}", "load_encoder": fx.letter_encoder, "metric": m} for m in vectors.DISTANCES
    ]
    model = {"experiment": "letters@3", "load_encoder": fx.letter_encoder} | _vector_model(spark)
    rows = scoring.score_experiments(fx.vector_candidates(spark, sf), [*plain, model])
    return rows.withColumn("score", F.round("score", 6))


@query
def scored_columns(spark, sf):
    name = text.score_name("letters", False, False)
    rows = scoring.attach_scores(fx.candidates(spark, sf), _scores(spark, sf), "letters@1", name)
    return rows.select("query_id", "dbpedia_entity", "hit", F.round(name, 6).alias(name.lower()))


@query
def article_grades(spark, sf):
    built = cand.build_wiki_candidates(
        fx.wiki_run(spark, sf),
        fx.queries(spark, sf),
        fx.wiki_pages(spark, sf),
        fx.article_grades(spark, sf),
    )
    return cand.sort_candidates(built.withColumn("text", F.md5("text")))


@query
def unmatched_grades(spark, sf):
    return entities.unmatched_grades(fx.label_articles(spark, sf), fx.wiki_pages(spark, sf))


@query
def unmatched_ratio(spark, sf):
    ratio = entities.unmatched_ratio(fx.label_articles(spark, sf), fx.wiki_pages(spark, sf))
    return ratio.withColumn("ratio", F.round("ratio", 6))


@query
def table_diff(spark, sf):
    left = fx.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), "toxic")
    right = fx.pages(spark, sf).select(F.col("page_id").alias("id"), F.lit(0).alias("toxic"))
    return difference.table_diff(left, right)


@query
def document_diff(spark, sf):
    """Whole documents, a map among the columns, against themselves with the German texts in lower case."""
    docs = fx.table(spark, sf, "documents").select(
        "doc_id", "text", "lang", F.create_map("source", F.col("n_chars")).alias("sizes")
    )
    lowered = docs.withColumn("text", F.when(F.col("lang") == "de", F.lower("text")).otherwise(F.col("text")))
    changed = difference.table_diff(docs, lowered)
    size = F.map_entries("sizes")[0]
    return changed.select("doc_id", F.md5("text").alias("text"), size["key"].alias("source"), size["value"].alias("n_chars"))


@query
def distinct_entities(spark, sf):
    return entities.distinct_entities(fx.entity_lists(spark, sf))


@query
def entity_pages(spark, sf):
    named = entities.distinct_entities(fx.entity_lists(spark, sf))
    found = entities.entity_pages(named, fx.wiki_pages(spark, sf))
    return found.withColumn("document", F.md5("document"))


@query
def experiment_grid(spark, sf):
    """Two models over the test rows of five folds."""
    checkpoints = spark.createDataFrame(
        [("letters@1", 0), ("letters@2", 1)], "experiment string, train_fold int"
    )
    grid = folds.experiment_grid(checkpoints, range(fx.FOLDS))
    rows = folds.split_folds(fx.candidates(spark, sf), fx.folds(spark, sf))
    return folds.grid_work(grid, rows)


for _file in FILES:
    query(_file)
