"""Target resampling, Merkle manifest, chat formatting."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from llm_cases import EXTRA, SMALL, awkward_docs, small
from pyspark.sql import functions as F

from rankflow.llm import chat, merkle
from rankflow.llm import target_resampling as tr
from rankflow.llm.queries import CONTROL_TURNS, QUERIES


def lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_resampling(docs, target, buckets=10_000, percent=25, least=20):
    """(doc_id, n_features, weight, score, rank) of (doc_id, text) rows, ranks by sorting."""

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    raw = Counter(bucket(f) for _, text in docs for f in features(text)[1])
    aim = Counter(bucket(f) for text in target for f in features(text)[1])
    s, t = sum(raw.values()), sum(aim.values())
    gain = [math.floor(1000 * math.log((aim[b] + 1) * (s + buckets) / ((raw[b] + 1) * (t + buckets)))) for b in range(buckets)]
    rows, able = [], []
    for ident, text in docs:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([ident, len(found), weight, score, None])
        if len(words) >= least:
            able.append(len(rows) - 1)
    able.sort(key=lambda i: (-rows[i][3], -(2**63) if rows[i][0] is None else rows[i][0], rows[i][1]))
    for rank, i in enumerate(able[: len(able) * percent // 100], 1):
        rows[i][4] = rank
    return Counter(map(tuple, rows))


def given(spark, name):
    return [tuple(r) for r in small(spark, name).select("doc_id", "text").collect()]


def test_resampling_equals_sorting_all_scores(spark):
    target = [r.text for r in small(spark, "benchmark").collect()]
    got = Counter(map(tuple, QUERIES["op11_target_resampling"](spark, SMALL).collect()))
    assert got == plain_resampling(given(spark, "documents"), target)


@pytest.mark.parametrize("percent", [0, 1, 30, 50, 100])
def test_resampling_of_awkward_rows(spark, percent):
    docs = awkward_docs(spark)
    target = spark.createDataFrame([("seven wizards Ünï 漢字", "x"), (None, None)], "text string, score string")
    got = tr.resample_to_target(docs, target, percent)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, got.collect())) == plain_resampling(rows, ["seven wizards Ünï 漢字"], percent=percent)


def test_resampling_cuts_between_repeated_rows(spark):
    """A third of the rows are one row, and the cut lies among them."""
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text)] * 40 + [(5, text + " more")] * 5 + [(i, f"{text} x{i}") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for percent in (5, 25, 50, 75, 90):
        got = tr.resample_to_target(docs, docs.select("text").limit(0), percent)
        assert Counter(map(tuple, got.collect())) == plain_resampling(rows, [], percent=percent)


def test_bisection_finds_every_cut(spark):
    rng = random.Random(3)
    values = [(rng.choice([-(2**62), -5, 0, 1, 2, 10**15 + rng.randint(0, 9)]), i) for i in range(60)]
    rows = spark.createDataFrame(values, "v long, n long")
    order = sorted(values)
    for k in (0, 1, 17, 40, 59, 60):
        got = rows.where(tr.first_rows(rows, ("v", "n"), k)).collect()
        assert sorted(map(tuple, got)) == order[:k]


def test_empty_tables_draw_nothing(spark):
    docs, benchmark = awkward_docs(spark, empty=True), small(spark, "benchmark")
    assert tr.resample_to_target(docs, benchmark).collect() == []
    some = tr.resample_to_target(awkward_docs(spark), benchmark.limit(0))
    assert some.where("rank is not null").count() == 1  # of seven rows with 20 words


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        nodes = levels[-1]
        levels.append([digest("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)])
    return levels


def plain_siblings(levels, at):
    """(before, after) of the leaf at a place, from the leaves up."""
    path = []
    for nodes in levels[:-1]:
        run = at // 16
        path.append((nodes[run * 16 : at], nodes[at + 1 : run * 16 + 16]))
        at = run
    return path


def plain_manifest(rows):
    """The result of op12 for rows of doc_id, source, lang, n_chars, text."""
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, plain_leaf(row), row))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        by_source[name].sort(key=lambda x: x[:3])
    trees = {name: plain_tree([x[2] for x in by_source[name]]) for name in names}
    upper = plain_tree([trees[name][-1][0] for name in names])
    out = []
    for i, name in enumerate(names):
        for at, (_, _, leaf, row) in enumerate(by_source[name]):
            path = plain_siblings(trees[name], at) + plain_siblings(upper, i)
            node = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0:
                node = plain_leaf((*row[:4], None if row[4] is None else lower(row[4])))
            for before, after in path:
                node = digest("".join([*before, node, *after]))
            proof = digest("".join(h for before, after in path for h in [*before, *after]))
            root = upper[-1][0]
            out.append((row[0], leaf, trees[name][-1][0], root, proof, node, node == root))
    return Counter(out)


def tampered():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def test_manifest_of_the_given_documents(spark):
    rows = [tuple(r[c] for c in merkle.FIELDS) for r in small(spark, "documents").collect()]
    got = Counter(map(tuple, QUERIES["op12_merkle_manifest"](spark, SMALL).collect()))
    assert got == plain_manifest(rows)
    assert {r[-1] for r in got} == {True, False}


@pytest.mark.parametrize("sizes", [[1], [300, 1, 2, 16, 17, 33] + [1] * 14, [4100]])
def test_manifest_of_trees_of_many_shapes(spark, sizes):
    rows = [
        (i * 7 % n, f"s{s}" if s else None, None, n, f"Text {i}")
        for s, n in enumerate(sizes)
        for i in range(n)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    got = Counter(map(tuple, merkle.verify_tampered(docs.repartition(5), tampered()).collect()))
    assert got == plain_manifest(rows)


def test_manifest_of_awkward_rows(spark):
    docs = awkward_docs(spark).withColumns(
        {
            "source": F.when(F.length("text") > 10, F.lit("é")).when(F.col("doc_id") == 4, ""),
            "lang": F.lit(None).cast("string"),
            "n_chars": F.length("text").cast("long"),
            "digest": F.lit("clash"),
            "claimed": F.lit("clash"),
            "run": F.lit(1),
            "key": F.lit("k"),
            "p": F.lit(0),
        }
    )
    rows = [tuple(r[c] for c in merkle.FIELDS) for r in docs.collect()]
    got = merkle.verify_tampered(docs, tampered())
    assert Counter(map(tuple, got.collect())) == plain_manifest(rows)
    assert merkle.verify_tampered(docs.where("false"), tampered()).collect() == []


def test_windows_hold_one_run_and_texts_do_not_move(spark):
    docs = small(spark, "documents")
    plan = merkle.verify_tampered(docs, tampered())._jdf.queryExecution().toString()
    assert "Window" in plan and "lag(" in plan and "lead(" in plan
    windows = [line for line in plan.split("\n") if re.search(r"\bWindow \[", line) and "lag(" in line]
    assert windows and all(re.search(r"\[key#\d+, run#\d+L?\], \[p#", line) for line in windows)
    assert not re.search(r"Exchange.*\btext#", plan)


def texts_of(turn):
    return "".join(c for c in turn.content if isinstance(c, str))


def plain_digests(rows):
    """{conv_id: (turns, sha, loss chars, loss sha)} of rows of conv_id, turn, role, text."""
    out = {}
    for conv_id in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1]))
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        out[conv_id] = (len(turns), digest(whole), len(loss), digest(loss))
    return out


def test_chat_digests_of_the_given_conversations(spark):
    rows = [tuple(r) for r in small(spark, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:5] for r in QUERIES["op13_chat_format"](spark, SMALL).collect()}
    assert got == plain_digests(rows + CONTROL_TURNS)


SPECIAL = [
    "\\### Assistant: </turn> ok",
    "</turn>",
    "\n</turn>\n<turn user>\n",
    "\\",
    "\\\\</turn",
    "<image:1>\n",
    "\n<image:1>\n",
    "<audio:</turn><turn",
    "<",
    "",
    None,
    "漢字 😀\u2028\r\n",
    "<tur",
    "n x>",
]


@pytest.mark.parametrize("segment_chars", [1, 40, 1 << 20])
def test_chat_round_trip_of_control_strings(spark, tmp_path, segment_chars):
    rng = random.Random(segment_chars)
    roles = ["user", "assistant", "system", "", None, "a>b", "x\ny", "%3E", "</turn>", "\n</turn>\n"]
    rows = [
        (rng.choice([None, 1, 2, 3, 4, -7]), turn, rng.choice(roles), "".join(rng.choices([s or "" for s in SPECIAL], k=3)))
        for turn in range(300)
    ]
    rows += [(9, None, "assistant", None), (10, 5, "assistant", "x" * 200_000 + "</turn>")]
    extra = [(*r, *["c"] * len(EXTRA)) for r in rows]
    schema = "conv_id long, turn long, role string, text string, " + ", ".join(f"`{c}` string" for c in EXTRA)
    path = str(tmp_path / "chat")
    chat.write_conversations(spark.createDataFrame(extra, schema).repartition(5), path, segment_chars)
    segments = chat.read_conversations(spark, path)
    got = chat.conversation_digests(segments).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in got} == plain_digests(rows) and len(got) == 8
    chars = {r.conv_id: r.n for r in segments.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("n")).collect()}
    assert {r.conv_id: r.formatted_chars for r in got} == chars
    if segment_chars == 1:
        assert segments.count() == len(rows)


def test_one_conversation_is_formatted_by_many_tasks(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} </turn>") for i in range(400)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    off = {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        segments = chat.format_conversations(turns).cache()
        assert segments.select("segment_part").distinct().count() > 1
        got = chat.conversation_digests(segments).collect()
        segments.unpersist()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.conv_id: tuple(r)[1:5] for r in got} == plain_digests(rows)


def test_repeated_rows_of_one_turn_are_all_kept(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "same")] * 50, "conv_id long, turn long, role string, text string")
    got = chat.conversation_digests(chat.format_conversations(turns.repartition(4))).collect()
    assert [(r.n_turns, r.loss_chars) for r in got] == [(50, 200)]


def test_typed_parts_become_placeholders(spark):
    def part(kind, **more):
        names = ("text", "ref", "width", "height", "seconds", "pages")
        return (kind, *[more.get(n) for n in names])

    user = [part("text", text="look </tu"), part("text", text="rn> "), part("image", ref="a.png", width=57, height=28), None]
    user += [part("image", ref=None), part("audio", ref="b.wav", seconds=1.01), part("text", text="<image:1>")]
    reply = [part("document", ref="c.pdf", pages=2), part("text", text="it is <a> \\")]
    rows = [(1, 0, "user", user), (1, 1, "assistant", reply), (1, 2, "user", []), (1, 3, "assistant", None)]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    [row] = chat.format_conversations(turns).collect()
    assert row.formatted == (
        "<turn user>\nlook \\</turn> \n<image:1>\n\n<image:2>\n\n<audio:3>\n\\<image:1>\n</turn>\n"
        "<turn assistant>\n\n<document:4>\nit is <a> \\\n</turn>\n<turn user>\n\n</turn>\n<turn assistant>\n\n</turn>\n"
    )
    found = [tuple(a) for a in row.attachments]
    assert found == [(1, "image", "a.png", 3), (2, "image", None, 0), (3, "audio", "b.wav", 26), (4, "document", "c.pdf", 1024)]
    assert row.attachment_tokens == 1053
    assert [row.formatted[m.start : m.end] for m in row.mask] == ["it is <a> \\"]
    parsed = list(chat.parse_segment(row.formatted))
    assert [t.role for t in parsed] == ["user", "assistant", "user", "assistant"]
    assert parsed[0].content == ["look </turn> ", 1, 2, 3, "<image:1>"] and parsed[1].content == [4, "it is <a> \\"]
    bad = spark.createDataFrame([(1, 0, "user", [part("video")])], turns.schema)
    with pytest.raises(Exception, match="unknown kind"):
        chat.format_conversations(bad).collect()


def test_escapes_of_long_runs_are_linear():
    text = "\\" * 1_000_000 + "<" * 1_000_000 + "\\" * 1000 + "</turn"
    assert chat.unescape(chat.escape(text)) == text


def test_empty_conversations(spark):
    empty = small(spark, "conversations").limit(0)
    assert chat.conversation_digests(chat.format_conversations(empty)).collect() == []
