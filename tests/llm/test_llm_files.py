"""Packing, token files, pages, pipeline."""

import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import SMALL, awkward_docs, plain_classes, small
from pyspark.sql import functions as F

from rankflow.llm import packing, session, style_tree, token_files, tokens
from rankflow.llm.queries import QUERIES
from rankflow.llm.session import released


def placed(histogram, capacity):
    """Fill of every sequence of a plan; checks that each piece is placed once."""
    fill, seen = {}, {n: [0] * c for n, c in histogram.items()}
    for length, first, end, per, sequence in packing.plan_packing(histogram, capacity):
        for number in range(first, end):
            seen[length][number] += 1
            at = sequence + (number - first) // per
            fill[at] = fill.get(at, 0) + length
    assert all(x == 1 for counts in seen.values() for x in counts)
    assert sorted(fill) == list(range(len(fill)))
    assert max(fill.values(), default=0) <= capacity
    return fill


@pytest.mark.parametrize("seed", range(12))
def test_plans_place_each_piece_once_and_waste_little(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 100, 2048])
    histogram = {}
    for _ in range(rng.choice([0, 1, 30, 20_000])):
        n = rng.randint(1, max(1, int(capacity * rng.choice([0.2, 0.6, 1]))))
        histogram[n] = histogram.get(n, 0) + 1
    fill = placed(histogram, capacity)
    least = -(-sum(n * c for n, c in histogram.items()) // capacity)
    assert len(fill) <= 1.01 * least + 2


def test_plan_meets_the_lower_bound_of_large_pieces():
    assert len(placed({1100: 500, 900: 500}, 2048)) == 500
    assert len(placed({700: 300}, 2048)) == 150


def library_ids(text):
    return [*tokens._tokenizer(tokens.default_tokenizer()).encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packed_pieces_equal_the_library_s_ids(spark):
    rows = QUERIES["op2_packing"](spark, SMALL).collect()
    texts = {r.doc_id: r.text for r in small(spark, "documents").collect()}
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = library_ids(texts[doc_id])
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.length == 2048 for r in pieces[1:]) and sum(r.length for r in pieces) == len(ids)
        at = 0
        for r in pieces:
            assert (r.start, r.ids_crc32) == (at, crc(ids[at : at + r.length]))
            at += r.length
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(r.length for r in rows) // 2048)
    assert len(by_sequence) <= 1.05 * least + 1


def test_packing_of_awkward_rows(spark):
    docs = awkward_docs(spark)
    pieces = packing.cut_documents(docs, with_ids=True)
    rows = packing.sequences(packing.pack(pieces)).collect()
    want = sorted(i for r in docs.collect() for i in library_ids(r.text))
    assert sorted(i for r in rows for i in r.ids) == want
    assert all(len(r.ids) <= 2048 for r in rows)
    assert packing.pack(packing.cut_documents(docs.limit(0))).isEmpty()


def test_token_files_round_trip(spark, tmp_path):
    docs = awkward_docs(spark)
    path = str(tmp_path / "tokens")
    token_files.write_tokens(docs, path)
    rows = sorted(token_files.read_tokens(spark, path).collect(), key=lambda r: r.start)
    want = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in docs.collect())
    got, at = [], 0
    for r in rows:
        assert r.start == at
        at += len(r.ids)
        got.append((r.doc_id if r.doc_id is not None else -1, r.ids))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert sorted((i, tuple(x)) for i, x in got) == sorted((i, tuple(library_ids(t))) for i, t in want)
    none = str(tmp_path / "none")
    token_files.write_tokens(docs.limit(0), none)
    assert token_files.read_tokens(spark, none).isEmpty()


def test_token_query_and_lookup_by_id(spark, tmp_path):
    want, at = {}, 0
    for r in sorted(small(spark, "documents").collect(), key=lambda r: r.doc_id):
        ids = library_ids(r.text)
        want[r.doc_id] = (at, len(ids), crc(ids))
        at += len(ids)
    rows = QUERIES["op3_token_files"](spark, SMALL).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == want
    path = str(tmp_path / "tokens")
    token_files.write_tokens(small(spark, "documents"), path)
    one = spark.read.schema(token_files.SCHEMA).orc(path).where("doc_id = 7")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in one._jdf.queryExecution().toString()
    assert len(one.first().ids) == want[7][1]


def plain_article(page):
    import html

    found = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    parts = re.split(r"</?(?:p|h1|div)[^>]*>", found[1]) if found else []
    lines = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n".join(x for x in lines if x)


def test_pages_equal_their_articles(spark):
    pages = {r.page_id: r for r in small(spark, "pages").collect()}
    rows = QUERIES["op6_style_tree"](spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == plain_article(pages[r.page_id].html) and r.n_chars == len(r.text)
        assert r.url == pages[r.page_id].url


PAGE = (
    "<body><div class=top><span>Site {host}</span></div><div class=x1><p>Story {n} about &eacute;{n} &amp; more"
    "<p>Second   part {n}</div><div class=x2><div>Subscribe now</div></div><script>var a='</p>'</script>"
)


@pytest.mark.parametrize("max_nodes", [1_000_000, 0])
def test_branches_that_repeat_on_a_site_are_removed(spark, max_nodes):
    rows = [(i, f"http://a.example/{i}", PAGE.format(host="a", n=i)) for i in range(30)]
    rows += [(100, "http://b.example/1", PAGE.format(host="b", n=1))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in style_tree.extract_pages(pages, max_nodes=max_nodes).collect()}
    for i in range(30):
        assert got[i] == f"Story {i} about é{i} & more\nSecond part {i}"
    # a site with one page tells nothing about what repeats
    assert got[100] == "Site b\nStory 1 about é1 & more\nSecond part 1\nSubscribe now"


ARTICLE = (
    "<article><div class='entry-header'><h1>Title {n}</h1></div><div class='elementor-widget-container'><p>Story {n}</div>"
    "<h2 id='related-work'>Work {n}</h2><section id='sharing-data'><p>Data {n}</p></section>"
    "<div class='share-buttons'><p>Tell your friends</p></div><div class='widget'><p>Poll {n}</p></div></article>"
)


def test_parts_of_names_and_ids_do_not_remove_what_differs(spark):
    rows = [(i, f"http://a.example/{i}", ARTICLE.format(n=i)) for i in range(20)]
    pages = spark.createDataFrame([*rows, (99, "http://b.example/", ARTICLE.format(n=99))], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in style_tree.extract_pages(pages).collect()}
    for i in range(20):
        assert got[i] == f"Title {i}\nStory {i}\nWork {i}\nData {i}"
    # a site with one page has no entropy to go by
    assert got[99] == "Title 99\nStory 99\nWork 99\nData 99\nTell your friends"


def test_doubtful_names_lower_importance(spark):
    def importances(label):
        page = "<article><p>Story {n}</p><div class='" + label + "'><p>Part {k}</p></div></article>"
        rows = [(f"http://a.example/{i}", page.format(n=i, k=i // 2)) for i in range(20)]
        nodes = style_tree.node_importance(spark.createDataFrame(rows, "url string, html string")).collect()
        return sorted(r.importance for r in nodes)

    plain, doubtful = importances("x-y"), importances("x-share")
    assert plain[-1] == doubtful[-1] == 1.0
    assert abs(min(doubtful) - style_tree.DOUBTFUL * min(plain)) < 1e-9


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain & simple", "plain & simple"),
        ("<p>a < b <a href='x>y'>link</a> end", "a < b link end"),
        ("<main><h1>T</h1>x<br>y<ul><li>1<li>2</ul><div class='user comments'>c</div>z</main>rest", "T\nx y\n1\n2\nz"),
        ("<article>a<aside>b</aside><form>c</form><style>d</style><nav>e</nav></article>", "a"),
        ("<article>a<!-- <p>b</p> -->c</article", "ac"),
        ("<div>a&nbsp;&#233;&lt;b&gt;</div><footer>f</footer>", "a é<b>"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"),
        ("<div>" * 3000 + "deep" + "</x>" * 3000, "deep"),
    ],
)
def test_odd_pages(page, text):
    assert style_tree.main_text(page or "", "h", np.zeros(0, np.int64)) == text


@pytest.mark.parametrize("n", [10, 99_000, 120_000, 2_000_000])
def test_a_long_quoted_value_is_no_text(n):
    start = time.perf_counter()
    for value in ("x" * n + "> more", ">" * n, "> = ' >" * (n // 8), "=" * n):
        page = f'<article>a <p data-x="{value}">two words</p></article>'
        assert style_tree.main_text(page, "h", np.zeros(0, np.int64)) == "a\ntwo words"
    assert time.perf_counter() - start < 3


def test_quotes_that_are_left_open():
    none = np.zeros(0, np.int64)
    assert style_tree.main_text('<div>a<p title="x>b</p>c</div>', "h", none) == "a\nb\nc"
    assert style_tree.main_text("<p>it's <b title=x'y>5\" wide</b></p>", "h", none) == "it's 5\" wide"
    start = time.perf_counter()
    style_tree.main_text('<p a="x>y' * 20_000, "h", none)
    style_tree.main_text("<p a='x>y" * 20_001 + "</p>", "h", none)
    assert time.perf_counter() - start < 10


def test_references_end_where_markup_begins():
    page = "<p>&l<i>t;</i> &amp<b>;</b> &lt;i&gt;</p>"
    assert style_tree.main_text(page, "h", np.zeros(0, np.int64)) == "&lt; &; <i>"


def test_pages_with_nulls_and_clashing_columns(spark):
    rows = [(1, None, None, "t"), (None, "::bad[", "<p>x", None), (2, "http://a/", "", "t"), (2, "http://a/", "", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = style_tree.extract_pages(pages)
    assert sorted((r.page_id or 0, r.url, r.text, r.n_chars) for r in got.collect() if r.url) == [
        (0, "::bad[", "x", 1), (2, "http://a/", "", 0), (2, "http://a/", "", 0),
    ]
    assert got.count() == 4
    assert style_tree.extract_pages(pages.limit(0)).isEmpty()


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        if name != "packing":
            assert docs.columns == before.columns
    poisoned = {r.doc_id for r in QUERIES["op5_toxicity"](spark, SMALL).where("predicted = 1").collect()}
    everything = {r.doc_id for r in small(spark, "documents").collect()}
    assert {r.doc_id for r in kept["toxicity"]} == everything - poisoned
    rows = [(r.doc_id, r.text) for r in kept["toxicity"]]
    first = {rows[i][0] for i, (least, _) in plain_classes(rows).items() if least == rows[i][0]}
    assert {r.doc_id for r in kept["near_duplicates"]} == first
    hits = {r.doc_id for r in QUERIES["op9_decontaminate"](spark, SMALL).collect()}
    assert {r.doc_id for r in kept["decontamination"]} == first - hits
    texts = {r.doc_id: r for r in kept["personal_data"]}
    assert set(texts) == first - hits
    for r in kept["decontamination"]:
        new = texts[r.doc_id]
        if new.text != r.text:
            assert re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", new.text) and new.n_chars == len(new.text)
        else:
            assert new == r
    assert "@mail" not in " ".join(r.text or "" for r in kept["personal_data"])
    assert {r.doc_id for r in kept["packing"]} == set(texts)
    run = corpus_pipeline.run(spark, SMALL)
    assert run.agg(F.sum("length")).first()[0] == sum(r.length for r in kept["packing"])


def test_all_dealt_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert any(re.match(rf"op{n}_", x) for x in names)


def test_a_worker_encodes_in_little_memory(monkeypatch):
    class Task:
        get = classmethod(lambda cls: cls())
        partitionId = lambda self: 0

    monkeypatch.setattr(token_files, "TaskContext", Task)
    path = tokens.default_tokenizer()
    texts = pa.array([" ".join(f"w{i * j % 997} of" for j in range(400)) for i in range(6000)])
    batches = pa.table({"doc_id": pa.array(range(6000)), "text": texts}).to_batches(500)
    tokens.encode(texts[:1], path, 0)
    tracemalloc.start(1)
    try:
        # 18 MB of text; work arrays of about 110 MB in slices of 8 MB
        found = [len(b) for b in released(token_files._encode_rows(path, 0))(iter(batches))]
        assert sum(found) == 6000 and tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()


def test_a_worker_gives_memory_back_after_each_batch(monkeypatch):
    class Pool:
        calls = 0

        def release_unused(self):
            Pool.calls += 1

    monkeypatch.setattr(session.pa, "default_memory_pool", Pool)
    made = pa.table({"n": [1, 2, 3]}).to_batches(1)
    assert list(released(lambda batches: batches)(iter(made))) == made and Pool.calls == 4
