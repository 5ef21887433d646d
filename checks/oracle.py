"""The same queries in SQL."""

from __future__ import annotations

from checks import fixtures as fx

WORDS = r"string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+')"


def words(column: str) -> str:
    return f"list_filter({WORDS.format(column)}, lambda x: x <> '')"


def shown(vector: str) -> str:
    return f"array_to_string(list_transform({vector}, lambda x: round(x * 1000000)::bigint::varchar), ',')"


def search_ctes(prefix: str, table: str, ident: str, column: str, stopped: bool = False) -> str:
    """BM25 top hits of the benchmark texts; names start with ``prefix``."""
    p = prefix
    stop = (
        f"where term not in (select term from {p}df where df * 4 > (select n_docs from {p}stats))"
        if stopped
        else ""
    )
    return f"""
{p}tok as (select {ident} as doc_id, unnest({words(column)}) as term from {table}),
{p}len as (select doc_id, count(*) as dl from {p}tok group by doc_id),
{p}stats as (select count(*) as n_docs, avg(dl) as avgdl from {p}len),
{p}tf as (select doc_id, term, count(*) as tf from {p}tok group by doc_id, term),
{p}df as (select term, count(*) as df from {p}tf group by term),
{p}qt as (select item_id as query_index, term, count(*) as qtf
  from (select item_id, unnest({words('text')}) as term from benchmark) {stop} group by item_id, term),
{p}w as (select query_index, term, qtf * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) as weight
  from {p}qt join {p}df using (term), {p}stats),
{p}score as (select query_index, doc_id,
    round(sum(weight * tf / (tf + 0.9 * (1 - 0.4 + 0.4 * dl / avgdl))), 6) as score
  from {p}tf join {p}w using (term) join {p}len using (doc_id), {p}stats group by query_index, doc_id),
{p}run as (select * from (select query_index, doc_id, score,
    row_number() over (partition by query_index order by score desc, doc_id) as hit from {p}score)
  where hit <= {fx.K})"""


SEARCH = search_ctes("d_", "documents", "doc_id", "text")

CANDIDATES = (
    SEARCH
    + f""",
cand as (select r.query_index, r.doc_id, '{fx.RESOURCE}' || r.doc_id as url_dbpedia, r.hit::int as hit, r.score,
    '<dbpedia:Doc_' || r.doc_id || '>' as dbpedia_entity, 'Q_' || r.query_index as query_id,
    q.text as query_text, d.text as abstract, (l.toxic * (1 + l.quality))::int as qrel
  from d_run r join benchmark q on q.item_id = r.query_index join documents d on d.doc_id = r.doc_id
  left join labels l on l.doc_id = r.doc_id
  where r.query_index in (select query_index from d_run join labels using (doc_id))),
vcand as (select c.*, case when l.doc_id is not null then 'K' || l.doc_id end as kid,
    case when l.doc_id is not null then '<http://www.wikidata.org/entity/K' || l.doc_id || '>' end as entity,
    case when l.doc_id is not null then e.vec_id end as vec_id,
    coalesce(case when l.doc_id is not null then e.embedding::double[] end,
      list_transform(range({fx.DIM}), lambda x: 0.0::double)) as vec
  from cand c left join labels l on l.doc_id = c.doc_id left join embeddings e on e.vec_id = c.doc_id)"""
)

TRIPLETS = (
    CANDIDATES
    + f""",
counts as (select query_id, count(*) filter (qrel > 0) as n_pos, count(*) filter (qrel = 0) as n_neg
  from vcand where qrel is not null group by query_id),
drawn as (select v.*, n_pos, n_neg, md5('{fx.SEED}|' || query_id || '|' || dbpedia_entity) as draw
  from vcand v join counts using (query_id) where qrel = 0),
ranked as (select *, row_number() over (partition by query_id order by draw, hit) as draw_rank from drawn),
neg as (select * from ranked where n_pos > 0 and n_pos <= n_neg and draw_rank <= n_pos),
trip as (select p.query_id, p.query_text, p.abstract as abstract_x, n.abstract as abstract_y,
    p.dbpedia_entity as dbpedia_entity_x, n.dbpedia_entity as dbpedia_entity_y,
    p.qrel as qrel_x, n.qrel as qrel_y, p.vec as vec_x, n.vec as vec_y, p.query_index, p.hit as hit_x, n.hit as hit_y
  from vcand p join neg n on p.query_id = n.query_id and p.query_text = n.query_text where p.qrel > 0)"""
)

FOLDS = f"""
folds as (select f::int as fold, case when item_id % {fx.FOLDS} = f then 'test' else 'training' end as split,
    'Q_' || item_id as query_id
  from (select item_id, unnest(range({fx.FOLDS})) as f from benchmark))"""

WIKI = (
    search_ctes("w_", "pages", "page_id", "html")
    + """,
wcand as (select r.query_index, r.doc_id as id, r.hit::int as hit, r.score, 'Q_' || r.query_index as query_id,
    q.text as query_string, 'Page ' || r.doc_id || '+x' as title, md5(p.html) as text,
    (l.quality + l.toxic)::int as qrel
  from w_run r join benchmark q on q.item_id = r.query_index join pages p on p.page_id = r.doc_id
  left join labels l on l.doc_id = r.doc_id)"""
)

ZEROS = f"list_transform(range({fx.DIM}), lambda x: 0.0::double)"

PAIRS = (
    SEARCH
    + f""",
pairs as (select r.query_index, r.doc_id, coalesce(a.embedding::double[], {ZEROS}) as a,
    coalesce(b.embedding::double[], {ZEROS}) as b
  from d_run r left join embeddings a on a.vec_id = r.query_index left join embeddings b on b.vec_id = r.doc_id)"""
)


def total(items: str) -> str:
    return f"list_sum({items})"


def zipped(a: str, b: str, formula: str) -> str:
    return f"list_transform(list_zip({a}, {b}), lambda p: {formula})"


def euclidean(a: str, b: str) -> str:
    return f"sqrt({total(zipped(a, b, 'pow(p[1] - p[2] + 1e-6::double, 2)'))})"


def manhattan(a: str, b: str) -> str:
    return total(zipped(a, b, "abs(p[1] - p[2] + 1e-6::double)"))


def cosine(a: str, b: str) -> str:
    norm = "greatest(sqrt(" + total("list_transform({0}, lambda x: x * x)") + "), 1e-8)"
    return f"1 - {total(zipped(a, b, 'p[1] * p[2]'))} / ({norm.format(a)} * {norm.format(b)})"


def distance(formula) -> str:
    return (
        f"with {PAIRS} select query_index, doc_id, round({formula('a', 'b')}, 6) as distance from pairs"
    )


def letter_distance(a: str, b: str) -> str:
    def count(column: str, letter: str) -> str:
        return f"(length({column}) - length(replace({column}, '{letter}', '')))"

    squares = [f"pow({count(a, c)} - {count(b, c)} + 1e-6::double, 2)" for c in fx.LETTERS]
    return f"sqrt({' + '.join(squares)})"


def layer(weights, bias, vector: str, rectify: bool) -> str:
    """One layer of a head, as a list."""
    sums = [
        f"{total(zipped(vector, f'{w.tolist()}::double[]', 'p[1] * p[2]'))} + ({b})" for w, b in zip(weights, bias)
    ]
    return "[" + ", ".join(f"greatest({s}, 0)" if rectify else s for s in sums) + "]"


WIDE1, WIDE2 = fx.wide_head()


def letter_vector(column: str) -> str:
    counts = [f"(length({column}) - length(replace({column}, '{c}', '')))::double" for c in fx.LETTERS]
    return "[" + ", ".join(counts) + "]"


WEIGHTS = (
    f"list_resize(list_transform({words('query_text')}, lambda t: case when length(t) = 1 then 0"
    f" else length(t)::double / 10 + hit / 1000.0::double end), {fx.WEIGHT_DIM}, 0.0::double)"
)


def projected(ctes: str, source: str, columns: str, sides: dict[str, tuple[str, str, str]]) -> str:
    """Letters, graph vector and weights of each side, through both layers of the wide head."""
    joined = ", ".join(
        f"list_concat(list_concat({letter_vector(text)}, {vec}), {weights}) as x_{n}"
        for n, (text, vec, weights) in sides.items()
    )
    hidden = ", ".join(f"{layer(*WIDE1, f'x_{n}', True)} as h_{n}" for n in sides)
    out = ", ".join(f"{layer(*WIDE2, f'h_{n}', False)} as y_{n}" for n in sides)
    return (
        f"{ctes}, model_in as (select {columns}, {letter_vector('query_text')} as anchor, {joined} from {source}),"
        f" model_hidden as (select *, {hidden} from model_in), model_out as (select *, {out} from model_hidden)"
    )


MODEL_LOSS = f"""with {projected(TRIPLETS, 'trip', 'query_id', {
    'x': ('abstract_x', 'vec_x', WEIGHTS.replace('+ hit', '+ hit_x')),
    'y': ('abstract_y', 'vec_y', WEIGHTS.replace('+ hit', '+ hit_y'))})}
select round(avg(greatest({euclidean('anchor', 'y_x')} - {euclidean('anchor', 'y_y')} + 0.5, 0)), 6) as loss,
count(*) as n_pairs from model_out"""


MODEL = projected(
    CANDIDATES, 'vcand',
    f"query_id, dbpedia_entity, sha256(abstract) as passage_key, {letter_vector('abstract')} as bare",
    {'p': ('abstract', 'vec', WEIGHTS)})
MODEL_SCORES = f"""select 'letters@3' as experiment, query_id, dbpedia_entity, passage_key,
round({euclidean('anchor', 'y_p')}, 6) as score from model_out"""


def vector_loss(formula) -> str:
    """Loss over all triplets whose query has a vector, and their number."""
    return f"""with {TRIPLETS}, a as (select vec_id, embedding::double[] as anchor from embeddings)
select round(avg(greatest(({formula('anchor', 'vec_x')}) - ({formula('anchor', 'vec_y')}) + 0.5, 0)), 6) as loss,
count(*) as n_pairs from trip join a on a.vec_id = trip.query_index"""


def head(vector: str = "embedding::double[]") -> str:
    (w1, b1), (w2, b2) = fx.test_head()
    hidden = [
        f"greatest(list_sum(list_transform(list_zip(e, {w.tolist()}::double[]), lambda p: p[1] * p[2]))"
        f" + ({b}), 0) as h{i}"
        for i, (w, b) in enumerate(zip(w1, b1))
    ]
    out = [
        "round(" + " + ".join(f"({w}::double) * h{j}" for j, w in enumerate(row)) + f" + ({b}), 6) as p{i}"
        for i, (row, b) in enumerate(zip(w2, b2))
    ]
    return (
        f"with h as (select vec_id, {', '.join(hidden)} from"
        f" (select vec_id, {vector} as e from embeddings))"
        f" select vec_id, {', '.join(out)} from h"
    )


QUADS = (
    "select '" + fx.RESOURCE + "' || doc_id as url_dbpedia,"
    " 'http://www.w3.org/2000/01/rdf-schema#comment' as predicate,"
    " '\"' || regexp_replace(text, '[\\r\\n]', ' ', 'g') || '\"@en ' as abstract,"
    " 'http://en.wikipedia.org/wiki/Doc_' || doc_id as url_wikipedia from documents"
)

FLAT = "regexp_replace(text, '[\\r\\n\\t]', ' ', 'g')"

SCORED = (
    CANDIDATES
    + f""",
scored as (select *, sha256(abstract) as passage_key,
    round({letter_distance('query_text', 'abstract')}, 6) as dist from cand)"""
)

RUN_CORPUS = f"""with {SEARCH} select query_index, hit::int as hit, score, c.url_dbpedia,
c.predicate, md5('"' || d.text || '"@en ') as abstract, c.url_wikipedia
from d_run r join documents d using (doc_id)
join ({QUADS}) c on c.url_dbpedia = '{fx.RESOURCE}' || r.doc_id"""

JUDGED = (
    f"with {SEARCH} select item_id as query_index, 'Q_' || item_id as query_id, text as query_text"
    " from benchmark where item_id in (select query_index from d_run join labels using (doc_id))"
)

#: Of each format, why a broken line is rejected, and the line.
REJECTED = {
    "run": ("not six fields", "'broken ' || doc_id"),
    "grades": ("not four fields", "'broken ' || doc_id"),
    "queries": ("no text", "'broken ' || doc_id"),
    "article_grades": ("not four fields", "'broken ' || doc_id"),
    "token_weights": ("a token without a weight", "'broken 0.5 ' || doc_id"),
    "entity_lists": ("not a JSON object with a list of names", "'{\"entities\": [' || doc_id"),
}

ORACLE = {
    "tokenize_counts": f"select term, count(*) as n from (select unnest({words('text')}) as term"
    " from documents) group by term",
    "query_terms": f"select query_index, term, count(*) as qtf from (select item_id as query_index,"
    f" unnest({words('text')}) as term from benchmark) group by query_index, term",
    "postings": f"""
with t as (select doc_id, {words('text')} as w from documents),
e as (select doc_id, unnest(w) as term, unnest(range(len(w))) as pos from t)
select term, doc_id, count(*)::int as tf, string_agg(pos::varchar, ',' order by pos) as positions
from e group by term, doc_id""",
    "doc_vectors": f"""
with t as (select doc_id, {words('text')} as w from documents),
f as (select doc_id, term, count(*) as tf from (select doc_id, unnest(w) as term from t) group by all),
v as (select doc_id, string_agg(term || ':' || tf, ' ' order by term) as terms from f group by doc_id)
select t.doc_id, len(w)::int as doc_length, coalesce(terms, '') as terms from t left join v using (doc_id)""",
    "corpus_stats": f"with {SEARCH} select n_docs, round(avgdl, 6) as avg_length from d_stats",
    "document_frequency": f"with {SEARCH} select term, df from d_df",
    "bm25_topk": f"with {SEARCH} select query_index, doc_id, hit::int as hit, score from d_run",
    "bm25_topk_stopped": f"with {search_ctes('s_', 'documents', 'doc_id', 'text', True)}"
    " select query_index, doc_id, hit::int as hit, score from s_run",
    "bm25_repeated_ids": f"with {search_ctes('r_', 'documents', 'n_chars', 'text')}"
    " select query_index, doc_id, hit::int as hit, score from r_run",
    "quad_file": f"select url_dbpedia, predicate, md5(abstract) as abstract, url_wikipedia from ({QUADS})",
    "quad_rejects": "select '<broken ' || doc_id as value from labels",
    "run_file": f"with {SEARCH} select query_index, '{fx.RESOURCE}' || doc_id as url_dbpedia,"
    " hit::int as hit, score from d_run",
    "checked_run_file": f"with {SEARCH} select query_index, '{fx.RESOURCE}' || doc_id as url_dbpedia,"
    " hit::int as hit, score from d_run",
    "checked_rejects": " union all ".join(
        f"select '{source}' as source, '{reason}' as reason, {value} as value from labels"
        for source, (reason, value) in REJECTED.items()
    ),
    "grades_file": f"with {SEARCH} select 'Q_' || query_index as query_id, '<dbpedia:Doc_' || doc_id || '>'"
    " as dbpedia_entity, (toxic * (1 + quality))::int as qrel from d_run join labels using (doc_id)",
    "queries_file": f"select row_number() over (order by item_id) - 1 as query_index, 'Q_' || item_id as query_id,"
    f" {FLAT} as query_text from benchmark",
    "topics_file": f"select item_id as query_index, {FLAT} as query_text from benchmark",
    "article_grades_file": "select 'Q' as query_id, 'Page ' || doc_id || '+é%x' as title, quality as qrel from labels",
    "names_file": "select 'a, \"b\\\" ' || vec_id as entity, row_number() over (order by vec_id) - 1 as entity_index"
    " from embeddings",
    "vectors_file": "select '<http://www.wikidata.org/entity/K' || vec_id || '>' as entity,"
    f" {shown('embedding::double[]')} as vector from embeddings",
    "weights_file": f"""with t as (select item_id, {words('text')} as w from benchmark)
select row_number() over (order by item_id) - 1 as ordinal, array_to_string(w, ' ') as tokens,
{shown('list_transform(w, lambda t: length(t)::double / 10)')} as weights from t""",
    "folds_file": f"with {FOLDS.strip()} select fold, split, query_id from folds",
    "entity_lists_file": "select 'Page ' || doc_id || '+x|Page ' || n_chars || '+x' as entities from documents",
    "pages_csv": "select row_number() over (order by entity) - 1 as row, entity, md5(html) as document from"
    " (select distinct unnest(['Page ' || doc_id || '+x', 'Page ' || n_chars || '+x']) as entity from documents)"
    " left join pages on entity = 'Page ' || page_id || '+x'",
    "search_docs_file": "select page_id::varchar as id, md5(html) as contents from pages",
    "fold_tables": f"with {CANDIDATES}, {FOLDS} select query_id, dbpedia_entity, hit, qrel, fold, split"
    " from cand join folds using (query_id)",
    "fold_store": f"with {CANDIDATES}, {FOLDS} select query_id, dbpedia_entity, hit, qrel, md5(abstract) as abstract,"
    " fold, split from cand join folds using (query_id)",
    "fold_store_part": f"with {CANDIDATES}, {FOLDS} select query_id, dbpedia_entity, hit, qrel, md5(abstract) as abstract,"
    " fold, split from cand join folds using (query_id)"
    " where (fold = 1 and split = 'test') or (fold = 3 and split = 'training')",
    "stage_lineage": JUDGED,
    "stage_table": JUDGED,
    "score_snapshots": f"""with {CANDIDATES},
keyed as (select 'm' as experiment, query_id, dbpedia_entity, sha256(abstract) as passage_key, score, qrel from cand)
select * exclude qrel, 1::bigint as snapshot, 'pinned' as reader from keyed
union all select * exclude qrel replace (case when qrel is null then score else -score end as score),
  case when qrel is null then 1 else 2 end::bigint, 'newest' from keyed""",
    "vector_snapshots": f"""with {CANDIDATES},
texts as (select abstract, bool_or(qrel is not null) as judged from cand group by abstract)
select sha256(abstract) as text_key, {shown(letter_vector('abstract'))} as vector,
  case when judged then 1 else 2 end::bigint as snapshot from texts""",
    "table_file": f"select url_dbpedia, predicate, md5(text) as abstract, url_wikipedia from (select *,"
    f" '\"' || doc_text || '\"@en ' as text from (select url_dbpedia, predicate, url_wikipedia, text as doc_text"
    f" from ({QUADS}) c join documents d on c.url_dbpedia = '{fx.RESOURCE}' || d.doc_id))",
    "title_map_table": "select 'Doc_' || doc_id as title, 'K' || doc_id as wikidata_id from labels",
    "wiki_pages_table": "select page_id::varchar as id, 'Page ' || page_id || '+x' as title, md5(html) as text from pages",
    "head_table": head("list_reverse(embedding::double[])"),
    "quad_parse": f"select url_dbpedia, predicate, md5(abstract) as abstract, url_wikipedia from ({QUADS})",
    "literal_clean": "select url_dbpedia, string_split(substr(abstract, 2), '\"@en ')[1] as abstract"
    f" from ({QUADS})",
    "entity_key": f"select '{fx.RESOURCE}' || doc_id as url_dbpedia,"
    " '<dbpedia:Doc_' || doc_id || '>' as dbpedia_entity, 'Doc_' || doc_id as title from documents",
    "run_corpus_join": RUN_CORPUS,
    "run_corpus_filtered": RUN_CORPUS,
    "run_grades": f"with {CANDIDATES} select query_index, hit, score, dbpedia_entity, query_id,"
    " query_text, qrel from cand",
    "title_lookup": f"with {CANDIDATES} select query_index, hit, dbpedia_entity,"
    " kid as title_to_id_wikidata, entity from vcand",
    "entity_index": f"with {CANDIDATES} select query_index, hit, entity, vec_id as entity_index from vcand",
    "vector_attach": f"with {CANDIDATES} select query_index, hit, entity, {shown('vec')} as vector from vcand",
    "position_attach": f"""with {CANDIDATES},
merged as (select c.*, l.doc_id is not null as known from cand c left join labels l on l.doc_id = c.doc_id),
twice as (select * from merged union all select * from merged where known),
numbered as (select *, row_number() over (order by query_index, hit, url_dbpedia) - 1 as ordinal from twice),
hits as (select query_index, hit, any_value(query_text) as query_text, min(ordinal) as first_ordinal,
  count(*) as n_rows from numbered group by query_index, hit)
select query_index, hit, first_ordinal, n_rows, array_to_string({words('query_text')}, ' ') as tokens,
{shown(f"list_transform({words('query_text')}, lambda t: length(t)::double / 10 + first_ordinal)")} as weights from hits""",
    "ranked_negatives": f"with {TRIPLETS} select query_id, dbpedia_entity, draw, draw_rank from ranked",
    "weights_deinterleave": f"""with t as (select doc_id, {words('text')} as w from documents)
select doc_id, array_to_string(w, ' ') as tokens, array_to_string(list_transform(w,
lambda t: case when length(t) = 1 then 'nan' else (length(t)::double / 10)::varchar end), ' ') as weights from t""",
    "nan_fill": f"""with t as (select conv_id, turn, coalesce({words('text')}, []) as w from conversations),
m as (select max(len(w)) as width from t),
f as (select conv_id, turn, width, list_resize(list_transform(w, lambda t: case when length(t) in (1, 4) then 0
  when length(t) = 2 then 1e6 when length(t) = 3 then -1e6 else length(t)::double / 10 end), width, 0.0::double) as f
  from t, m)
select conv_id, turn, len(f)::int as n, md5({shown('f')}) as weights from f""",
    "fold_split": f"with {CANDIDATES}, {FOLDS} select fold, split, query_id, dbpedia_entity, hit, qrel"
    " from cand join folds using (query_id)",
    "fold_counts": f"with {CANDIDATES}, {FOLDS} select fold, split, count(*) as n_rows"
    " from cand join folds using (query_id) group by fold, split",
    "fold_triplets": f"with {TRIPLETS}, {FOLDS} select fold, split, count(*) as n_rows"
    " from trip join folds using (query_id) group by fold, split",
    "positive_counts": f"with {CANDIDATES} select query_id, count(query_text) as n_pos from cand"
    " where qrel > 0 group by query_id",
    "skipped_queries": f"""with {CANDIDATES}, n as (select query_id, count(*) filter (quality > 0) as n_pos,
  count(*) filter (quality = 0) as n_neg from cand join labels using (doc_id) group by query_id)
select query_id, n_pos, n_neg, case when n_pos = 0 then 'no positives' else 'too few negatives' end as reason
from n where n_pos = 0 or n_pos > n_neg""",
    "negative_sample": f"with {TRIPLETS} select query_id, dbpedia_entity, hit, n_pos from neg",
    "triplet_rows": f"with {TRIPLETS} select query_id, query_text, md5(abstract_x) as abstract_x,"
    " md5(abstract_y) as abstract_y, dbpedia_entity_x, dbpedia_entity_y, qrel_x, qrel_y from trip",
    "training_rows": f"with {TRIPLETS} select query_text as query_sentence, md5(abstract_x) as pos_sentence,"
    f" md5(abstract_y) as neg_sentence, {shown('vec_x')} as pos_biggraph, {shown('vec_y')} as neg_biggraph"
    " from trip",
    "scoring_rows": f"""with {CANDIDATES} select query_text as query_sentence, md5(abstract) as retrieval_sentence,
{shown('vec')} as biggraph, {shown(WEIGHTS)} as deepct from vcand""",
    "dist_euclidean": distance(euclidean),
    "dist_manhattan": distance(manhattan),
    "dist_cosine": distance(cosine),
    "triplet_loss": f"select loss from ({vector_loss(euclidean)})",
    "sampled_loss_euclidean": vector_loss(euclidean),
    "sampled_loss_manhattan": vector_loss(manhattan),
    "sampled_loss_cosine": vector_loss(cosine),
    "feature_concat": "with f as (select vec_id, list_concat(embedding::double[],"
    " list_reverse(embedding::double[]), [label::double]) as f from embeddings)"
    f" select vec_id, {shown('f')} as features from f",
    "head_projection": head(),
    "mean_pool": f"""with t as (select doc_id, unnest({words('text')}) as token from documents)
select doc_id, round(avg(length(token) * 0.7310585786::double), 6) as m0,
round(avg(length(replace(token, 'e', '')) * 0.7310585786::double), 6) as m1
from t group by doc_id""",
    "score_candidates": f"with {SCORED} select 'letters@1' as experiment, query_id, dbpedia_entity,"
    " passage_key, dist as score from scored",
    "score_graph_weights_head": f"with {MODEL} {MODEL_SCORES}",
    "score_grid": f"""with {MODEL}, plain as (select query_id, dbpedia_entity, passage_key,
  {euclidean('anchor', 'bare')} as euclidean, {manhattan('anchor', 'bare')} as manhattan,
  {cosine('anchor', 'bare')} as cosine from model_out)
{MODEL_SCORES} union all select 'letters@1 ' || metric, query_id, dbpedia_entity, passage_key, round(score, 6)
from (unpivot plain on euclidean, manhattan, cosine into name metric value score)""",
    "model_triplet_loss": f"select loss from ({MODEL_LOSS})",
    "model_sampled_loss": MODEL_LOSS,
    "score_skip_existing": f"with {SCORED} select 'letters@1' as experiment, query_id, dbpedia_entity,"
    " passage_key, dist as score from scored where qrel is null",
    "scored_columns": f"with {SCORED} select query_id, dbpedia_entity, hit,"
    " dist as score_letters_false_false from scored",
    "article_grades": f"with {WIKI} select * from wcand",
    "unmatched_grades": "select 'Page ' || doc_id || '+x' as title, quality as qrel from labels"
    " where doc_id not in (select page_id from pages)",
    "unmatched_ratio": "select count(*) filter (page_id is null) as n_unmatched, count(*) as n_grades,"
    " round(count(*) filter (page_id is null) / count(*), 6) as ratio"
    " from labels left join pages on page_id = doc_id",
    "table_diff": "select id, toxic from (select doc_id as id, toxic from labels union all"
    " select page_id, 0 from pages) group by id, toxic having count(*) = 1",
    "document_diff": "select doc_id, md5(text) as text, source, n_chars from (select doc_id, text, lang, source, n_chars"
    " from documents union all select doc_id, case when lang = 'de' then lower(text) else text end, lang, source, n_chars"
    " from documents) group by all having count(*) = 1",
    "distinct_entities": "select distinct unnest(['Page ' || doc_id || '+x', 'Page ' || n_chars || '+x'])"
    " as entity from documents",
    "entity_pages": "select entity, md5(html) as document from (select distinct unnest(['Page ' || doc_id ||"
    " '+x', 'Page ' || n_chars || '+x']) as entity from documents)"
    " left join pages on entity = 'Page ' || page_id || '+x'",
    "experiment_grid": f"""with {CANDIDATES}, {FOLDS},
grid as (select experiment, train_fold::int as train_fold, unnest(range({fx.FOLDS}))::int as fold
  from (values ('letters@1', 0), ('letters@2', 1)) v(experiment, train_fold)),
n as (select fold, count(*) as n_rows from cand join folds using (query_id) where split = 'test' group by fold)
select fold, experiment, train_fold, fold <> train_fold as seen_in_training, coalesce(n_rows, 0) as n_rows
from grid left join n using (fold)""",
}
