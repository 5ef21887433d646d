"""The registered queries of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm.chat import conversation_digests, read_conversations, write_conversations
from rankflow.llm.decontaminate import contaminated
from rankflow.llm.embedding_links import embedding_classes
from rankflow.llm.importance import resample
from rankflow.llm.jaccard_join import jaccard_classes
from rankflow.llm.licenses import scan_licenses
from rankflow.llm.merkle import verify_tampered
from rankflow.llm.packing import cut_documents, pack
from rankflow.llm.pii import KINDS, find_pii, span_text
from rankflow.llm.style_tree import extract_pages
from rankflow.llm.target_resampling import resample_to_target
from rankflow.llm.token_files import read_tokens, token_digests, write_tokens
from rankflow.llm.toxicity import toxicity_scores
from rankflow.session import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op10_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate class and number of links of every document."""
    return jaccard_classes(table(spark, sf, "documents").select("doc_id", "text"))


@query
def op9_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold part of a benchmark item, with the item."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return contaminated(docs, table(spark, sf, "benchmark").select("item_id", "text"))


@query
def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return toxicity_scores(docs, table(spark, sf, "labels").select("doc_id", "toxic"))


@query
def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Every token piece of every document with its place in a sequence."""
    pieces = cut_documents(table(spark, sf, "documents").select("doc_id", "text"))
    return pack(pieces).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@query
def op3_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of all rows, read back from the ORC files they were written to."""
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf, "documents").select("doc_id", "text"), path)
    return token_digests(read_tokens(spark, path))


@query
def op1_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = find_pii(table(spark, sf, "documents").select("doc_id", "text"))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )


@query
def op4_embedding_links(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate links and component of every vector."""
    return embedding_classes(table(spark, sf, "embeddings").select("vec_id", "embedding"))


@query
def op7_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Importance weight of every document, and whether the sample keeps it."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return resample(docs, table(spark, sf, "labels").select("doc_id", "quality"))


@query
def op8_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """License phrases and passages of every document."""
    found = scan_licenses(table(spark, sf, "documents").select("doc_id", "text"))
    base = F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"])))
    more = F.transform("found", lambda t: t["template"])
    share = F.coalesce(F.array_max(F.transform("found", lambda t: t["share"])), F.lit(0.0))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.get("base", F.lit(0))["start"].cast("long").alias("first_word"),
        F.get("base", F.size("base") - 1)["start"].cast("long").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(share).alias("score"),
    )


@query
def op6_style_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf, "pages").select("page_id", "url", "html"))


@query
def op11_target_resampling(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents against the benchmark texts, and the ranks of those drawn."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return resample_to_target(docs, table(spark, sf, "benchmark").select("text"))


@query
def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf, proof and verification of every document, a fifth of them tampered with."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return verify_tampered(table(spark, sf, "documents"), tampered)


#: A text that holds control strings, the escape character included.
CONTROL_TURNS = [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(["user", "assistant"])]


@query
def op13_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of all conversations, read back from the files they were written to."""
    columns = ["conv_id", "turn", "role", "text"]
    more = spark.createDataFrame(CONTROL_TURNS, "conv_id long, turn long, role string, text string")
    path = f"{shared_folder(spark)}/chat-{uuid.uuid4().hex}"
    write_conversations(table(spark, sf, "conversations").select(*columns).unionByName(more), path)
    return conversation_digests(read_conversations(spark, path))


#: (s, crc) of the strings of a relation; DuckDB has no CRC-32 of its own.
def _crc_sql(strings: str) -> str:
    return f"""
bits as (
  select 0 as k, range::bigint as c, range as i from range(256)
  union all select k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, i from bits where k < 8),
tab as (select list(c order by i) as t from bits where k = 8),
crc as (
  select s, xor(list_reduce(
    list_transform(range(1, strlen(s) + 1), lambda i: ('0x' || hex(encode(s))[2 * i - 1:2 * i])::bigint),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::bigint), 4294967295) as crc
  from (select distinct s from {strings}), tab)"""


ORACLE["op11_target_resampling"] = rf"""
with recursive texts as (
  select row_number() over () as n, false as target, doc_id, text from documents
  union all select -row_number() over (), true, null, text from benchmark),
w as (
  select n, target, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') as w from texts),
feature as (
  select n, target, s, count(*) as c from (
    select n, target, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as s from w)
  group by n, target, s),
{_crc_sql("feature")},
counted as (
  select crc % 10000 as bucket, sum(case when target then 0 else c end) as s, sum(case when target then c else 0 end) as t
  from feature join crc using (s) group by bucket),
whole as (select sum(s) as s, sum(t) as t from counted),
gain as (
  select bucket, floor(1000 * ln((c.t + 1.0::double) * (w.s + 10000.0::double)
    / ((c.s + 1.0::double) * (w.t + 10000.0::double))))::bigint as gain from counted c, whole w),
weighed as (
  select n, sum(c)::bigint as n_features, floor(sum(c * gain) / sum(c)::double)::bigint as weight
  from feature join crc using (s) join gain on bucket = crc % 10000 where not target group by n),
scored as (
  select w.n, doc_id, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    (coalesce(weight, 0) + floor(-1000.0::double * ln(-ln(
      (('0x' || sha256('7:' || doc_id)[1:8])::bigint + 0.5::double) / 4294967296.0::double))))::bigint as score
  from w left join weighed using (n) where not target),
ranked as (
  select n, row_number() over (order by score desc, doc_id) as r, count(*) over () as n_able
  from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when r <= n_able * 25 // 100 then r end as rank
from scored left join ranked using (n)"""

_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _tree_sql(name: str, leaves: str) -> str:
    """All nodes (key, level, p, n, digest) over (key, p, n, digest), level by level."""
    return f"""
{name} as (
  select key, 0 as level, p, n, digest from {leaves}
  union all
  select key, level + 1, p // 16, (any_value(n) + 15) // 16, sha256(string_agg(digest, '' order by p))
  from {name} where n > 1 group by key, level, p // 16)"""


ORACLE["op12_merkle_manifest"] = f"""
with recursive docs as (
  select row_number() over () as id, doc_id, source, {_leaf_sql("text")} as leaf, {_leaf_sql(_LOWER)} as low
  from documents),
words as (select doc_id::varchar as s from documents),
{_crc_sql("words")},
leaves as (
  select id, doc_id, coalesce(source, '') || (source is null)::varchar as key, source, leaf as digest,
    case when crc.crc % 5 = 0 then low else leaf end as claimed,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as p,
    count(*) over (partition by source) as n
  from docs left join crc on s = doc_id::varchar),
{_tree_sql("nodes", "leaves")},
subroots as (
  select l.key as group_key, '' as key, digest, row_number() over (order by source nulls first) - 1 as p,
    count(*) over () as n
  from nodes join (select distinct key, source from leaves) l using (key) where nodes.n = 1),
{_tree_sql("upper", "subroots")},
root as (select digest as root from upper where n = 1),
steps as (
  select l.id, x.level, string_agg(y.digest, '' order by y.p) filter (y.p < x.p) as before,
    string_agg(y.digest, '' order by y.p) filter (y.p > x.p) as after
  from leaves l join nodes x on x.key = l.key and x.n > 1 and x.p = l.p // (16 ** x.level)::bigint
  join nodes y on y.key = x.key and y.level = x.level and y.p // 16 = x.p // 16
  group by l.id, x.level
  union all
  select l.id, 100 + x.level, string_agg(y.digest, '' order by y.p) filter (y.p < x.p),
    string_agg(y.digest, '' order by y.p) filter (y.p > x.p)
  from leaves l join subroots s on s.group_key = l.key join upper x on x.n > 1 and x.p = s.p // (16 ** x.level)::bigint
  join upper y on y.level = x.level and y.p // 16 = x.p // 16
  group by l.id, x.level),
ordered as (
  select id, row_number() over (partition by id order by level) as step, coalesce(before, '') as before,
    coalesce(after, '') as after from steps),
proof as (select id, count(*) as n, sha256(string_agg(before || after, '' order by step)) as proof from ordered group by id),
folded as (
  select id, 0 as step, claimed as node from leaves
  union all
  select id, o.step, sha256(before || node || after) from folded f join ordered o using (id) where o.step = f.step + 1)
select doc_id, l.digest as leaf, s.digest as subroot, root, coalesce(proof, sha256('')) as proof_sha256,
  node as folded_root, node = root as verified
from leaves l join subroots s on s.group_key = l.key cross join root left join proof using (id)
join folded f on f.id = l.id and f.step = coalesce(proof.n, 0)"""

ORACLE["op13_chat_format"] = r"""
with t as (
  select conv_id, turn, role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
c as (
  select conv_id, string_agg(role || chr(10) || text || chr(10), '' order by turn) as turns, count(*) as n_turns,
    coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '') as loss,
    sum(length('<turn ' || role || '>') + length(regexp_replace(text, '</?turn|<(image|audio|document):', '+\0', 'g'))
      + length('+</turn>++'))::bigint as formatted_chars
  from t group by conv_id)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256,
  formatted_chars
from c"""

ORACLE["op4_embedding_links"] = """
with recursive v as (
  select vec_id, embedding::double[] as e, sqrt(list_sum(list_transform(embedding::double[], lambda x: x * x))) as norm
  from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
links as (
  select a.vec_id as a, b.vec_id as b from v a join v b
  on a.vec_id <> b.vec_id and a.norm > 0 and b.norm > 0 and len(a.e) = len(b.e)
  where list_inner_product(a.e, b.e) / (a.norm * b.norm) >= 0.95),
reach as (
  select vec_id as a, vec_id as b from embeddings
  union select r.a, l.b from reach r join links l on r.b = l.a),
n as (select a as vec_id, count(*) as n_links from links group by a),
c as (select a as vec_id, min(b) as component_id from reach group by a)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept
from embeddings join c using (vec_id) left join n using (vec_id)"""

# On every diagonal, 11 equal words within 13 (of shorter items four fifths of all words).
ORACLE["op9_decontaminate"] = """
with d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as w from documents),
b as (
  select row_number() over () as i, item_id,
    regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as w
  from benchmark where item_id is not null),
x as (select r, unnest(w) as word, generate_subscripts(w, 1) as p from d),
y as (
  select i, least(len(w), 13) as n, ceil(least(len(w), 13) * 4 / 5)::bigint as needed, unnest(w) as word,
    generate_subscripts(w, 1) as q from b),
equal as (select r, i, n, needed, p - q as start, q from x join y using (word)),
far as (
  select r, i, n, start, q, lead(q, needed - 1) over (partition by r, i, start order by q) as last from equal),
lines as (
  select r, i, start, count(*) as n_equal, bool_or(coalesce(last - q < n, false)) as agrees from far group by r, i, start),
best as (
  select r, i, min(start) as start, arg_min(n_equal, start) as n_equal from lines where agrees group by r, i)
select doc_id, item_id, greatest(start, 0)::bigint as first_word, n_equal::bigint as n_equal,
  len(b.w)::bigint as n_item_words
from best join d using (r) join b using (i)"""

ORACLE["op10_jaccard_join"] = """
with recursive w as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\\x{80}-\\x{10FFFF}]+') as w from documents),
s as (
  select distinct doc_id, unnest(case when len(w) >= 5
    then list_transform(range(1, len(w) - 3), lambda i: hash(array_to_string(w[i:i + 4], ' ')))
    when len(w) > 0 then [hash(array_to_string(w, ' '))] else [] end) as shingle from w),
size as (select doc_id, count(*) as n from s group by doc_id),
common as (
  select x.doc_id as a, y.doc_id as b, count(*) as n from s x join s y on x.shingle = y.shingle and x.doc_id <> y.doc_id
  group by x.doc_id, y.doc_id),
links as (
  select a, b from common join size p on p.doc_id = a join size q on q.doc_id = b
  where common.n / (p.n + q.n - common.n) >= 0.8),
reach as (
  select doc_id as a, doc_id as b from documents
  union select r.a, l.b from reach r join links l on r.b = l.a),
n as (select a as doc_id, count(*) as n_links from links group by a),
c as (select a as doc_id, min(b) as class_id from reach group by a)
select doc_id, class_id, coalesce(n_links, 0) as n_links
from documents join c using (doc_id) left join n using (doc_id)"""
