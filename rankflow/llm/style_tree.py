"""Main text of web pages with site style trees.

Pages of one host are merged into a style tree: pages share a node where the chain of tags and classes
from the root is the same. A node's importance comes from entropy over its pages: of its presentation
(which children follow each other) and of its contents (the texts in it). A text that stands on
many pages says little; a node whose texts differ from page to page carries content. Branches whose
importance is well below that of the best node of their site are removed from every page.

On top of that the page's own markup counts: scripts, styles, menus, forms and the like are never
content, and where a page marks its article, the rest of the page isn't either. A class or role that as a
whole is the name of a sidebar or the like isn't content; such a word as part of a longer name or in
an id only lowers the importance of what is inside.

Pages are parsed twice; they are not shuffled. The first pass returns counts per host, node and text, which
Spark adds up; their sums become one importance per node of a host. Nodes to remove go to the
second pass as a sorted array of hashes if they are few enough, else by a join.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankflow.llm.session import ready
from rankflow.session import land

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section select"
    " summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that end an open paragraph.
ENDS_P = BLOCK - frozenset("body html head option td th tr tbody tfoot thead".split())
#: An element that ends an open one of these kinds, up to the nearest of the containers.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}
#: Elements that never hold the text of an article.
NEVER = frozenset(
    "head script style textarea title noscript iframe template nav footer aside form button select option input"
    " label dialog menu svg canvas object audio video map".split()
)
MAIN = frozenset(("article", "main"))
#: Words of class, id and role names that mark what is not the article.
MARKS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments consent"
    " cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice notices"
    " notification pagination pager popup promo promoted promotion related share sharing sidebar signup social"
    " sponsor sponsored subscribe toolbar topbar widget complementary contentinfo reply replies respond".split()
)

GAMMA = 0.9
#: A node goes if its importance is below this part of the best importance on its host.
RELATIVE = 0.5
#: A host or node with fewer pages than this tells nothing.
MIN_PAGES = 5
#: What is left of the importance of a node within a doubtful name.
DOUBTFUL = 0.7
#: Removed nodes that are broadcast, 8 bytes each.
MAX_NODES = 1_000_000

_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_MARKS_IN = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_PART = re.compile(r"[a-z]+")


class Text(NamedTuple):
    """A run of text of one block: the node's chain hash, text, whether markup allows it or doubts it."""

    block: int
    node: int
    text: str
    never: bool
    main: bool
    doubtful: bool


def _hash(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value) & 0x7FFFFFFFFFFFFFFF


#: What moves a walk through a tag: the start of a quoted value, or the end of the tag.
_TAG_MARK = re.compile("=\\s*[\"']|>")


def _tag_end(page: str, at: int) -> int:
    """The closing bracket of a tag, past brackets in quoted values; the first one where a quote is left open.

    One walk from mark to mark: a quoted value of any length is one step.
    """
    place = at
    while (mark := _TAG_MARK.search(page, place)) is not None:
        if mark[0] == ">":
            return mark.start()
        place = page.find(mark[0][-1], mark.end()) + 1
        if not place:
            break
    return page.find(">", at)


def parse(page: str) -> tuple[list[Text], list[tuple[int, int, int]]]:
    """Texts in page order, and (chain hash, children hash, number of children) of every element."""
    texts: list[Text] = []
    nodes: list[tuple[int, int, int]] = []
    # open elements: name, chain, never, main, doubtful, children so far
    stack: list[tuple[str, int, bool, bool, bool, list[str]]] = [("", 0, False, False, False, [])]
    opened: Counter = Counter()  # saves looking through the stack for what isn't there
    block = 0
    at, n = 0, len(page)

    def close(depth: int) -> None:
        nonlocal block
        while len(stack) > depth:
            name, chain, _, _, _, children = stack.pop()
            opened[name] -= 1
            nodes.append((chain, _hash(" ".join(children)), len(children)))
            if name in BLOCK:
                block += 1

    def add(text: str) -> None:
        if text:
            _, chain, never, main, doubtful, _ = stack[-1]
            texts.append(Text(block, chain, text, never, main, doubtful))

    while at < n:
        i = page.find("<", at)
        if i < 0:
            add(page[at:])
            break
        if i > at:
            add(page[at:i])
        mark = page[i + 1 : i + 2]
        if mark == "!" or mark == "?":
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                at = end + 3 if end >= 0 else n
            else:
                end = page.find(">", i)
                at = end + 1 if end >= 0 else n
            continue
        if mark == "/":
            end = page.find(">", i)
            found = _NAME.match(page, i + 2)
            at = end + 1 if end >= 0 else n
            if found and end >= 0:
                name = found.group().lower()
                depth = len(stack) - 1 if opened[name] else 0
                while depth and stack[depth][0] != name:
                    depth -= 1
                if depth:
                    close(depth)
                elif name in ("br", "p"):
                    block += name == "p"
                    add(" ")
            continue
        if not (mark.isascii() and mark.isalpha()):
            add("<")
            at = i + 1
            continue
        end = _tag_end(page, i)
        if end < 0:  # cut off within a tag
            break
        name = _NAME.match(page, i + 1).group().lower()
        attributes = page[i + 1 + len(name) : end]
        at = end + 1
        if opened["p"] and name in ENDS_P:
            # an open paragraph ends here, unless a table cell or the like stands between
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        kinds, containers = ENDS.get(name, ((), ()))
        if any(opened[kind] for kind in kinds):
            lowest = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in kinds:
                    lowest = k
                    if name not in ("tr",):
                        break
                elif stack[k][0] in containers:
                    break
            if lowest:
                close(lowest)
        _, chain, never, main, doubtful, children = stack[-1]
        marks = [(m[1].lower(), m[2] or m[3] or m[4] or "") for m in _MARKS_IN.finditer(attributes)]
        label = name + "".join(f".{v}" for k, v in marks if k == "class")
        children.append(label)
        if name == "br":
            add(" ")
        if name in BLOCK:
            block += 1
        if name in VOID:
            continue
        is_main = main or name in MAIN
        dropped = name in NEVER or (name == "header" and not main)
        if marks and name not in ("html", "body", "article", "main"):
            dropped = dropped or any(not MARKS.isdisjoint(v.lower().split()) for k, v in marks if k != "id")
            doubtful = doubtful or any(not MARKS.isdisjoint(_PART.findall(v.lower())) for _, v in marks)
        here = (name, _hash(f"{chain}/{label}"), never or dropped, is_main, doubtful, [])
        if name in RAW:
            stop = re.compile(f"</{name}", re.IGNORECASE).search(page, at)
            end = page.find(">", stop.start()) if stop else -1
            at = end + 1 if end >= 0 else n
            continue
        if attributes.endswith("/") and name not in BLOCK and name in ("svg", "path", "use"):
            continue
        stack.append(here)
        opened[name] += 1
    close(1)
    return texts, nodes


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def node_key(host: str, chain: int) -> int:
    return _hash(f"{host}\n{chain}")


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, node, kind, value, n): pages per presentation (kind 0) and per text (kind 1) of a node.

    Kind 2 adds up the children of a node, for the weight of its presentation; kind 3 its pages with a
    doubtful name.
    """
    for batch in batches:
        counts: Counter = Counter()
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
            host = host_of(url)
            site = _hash(host)
            texts, nodes = parse(page or "")
            seen = {}
            for chain, children, n in nodes:
                first, total = seen.get(chain, (0, 0))
                seen[chain] = (_mix(first, children), total + n)
            for chain, (children, n) in seen.items():
                key = node_key(host, chain)
                counts[site, key, 0, children] += 1
                counts[site, key, 2, 0] += n
            for chain in {t.node for t in texts if t.doubtful}:
                counts[site, node_key(host, chain), 3, 0] += 1
            has_main = any(t.main for t in texts)
            own = {
                (t.node, _hash(_SPACE.sub(" ", t.text).strip()))
                for t in texts
                if not t.never and (t.main or not has_main) and t.text.strip()
            }
            for chain, value in own:
                counts[site, node_key(host, chain), 1, value] += 1
        keys = list(counts)
        columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([counts[k] for k in keys], pa.int64())], names=["host", "node", "kind", "value", "n"]
        )


def _mix(a: int, b: int) -> int:
    return (a * 1_000_003 + b) & 0x7FFFFFFFFFFFFFFF


def node_importance(pages: DataFrame) -> DataFrame:
    """(host, node, n_pages, importance) of every node that holds text, landed.

    A node's contents have importance 1 - mean(log(pages of a text) / log(pages of the node)); its
    presentation has the entropy of its child sequences over its pages. The presentation counts
    with weight 1 - gamma ** children, so that a node without children is judged by its texts. Doubtful
    names lower the importance by their share of the node's pages.
    """
    rows = pages.select("url", "html").mapInArrow(_count_rows, "host long, node long, kind long, value long, n long")
    counts = land(rows.groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n")))
    n_pages = F.sum(F.when(F.col("kind") == 0, F.col("n")))
    nodes = counts.where("kind != 1").groupBy("host", "node").agg(
        n_pages.alias("m"),
        F.sum(F.when(F.col("kind") == 0, F.col("n") * F.log(F.col("n")))).alias("nlogn"),
        F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("children"),
        F.sum(F.when(F.col("kind") == 3, F.col("n")).otherwise(0)).alias("doubtful"),
    )
    texts = counts.where("kind = 1").groupBy("host", "node").agg(F.avg(F.log("n")).alias("mean_log"))
    size = F.greatest(F.log("m"), F.lit(1e-9))
    content = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), 1 - F.col("mean_log") / size)).otherwise(F.lit(1.0))
    presentation = F.when(F.col("m") > 1, (F.log("m") - F.col("nlogn") / F.col("m")) / size).otherwise(F.lit(1.0))
    weight = 1 - F.pow(F.lit(GAMMA), F.col("children") / F.col("m"))
    importance = 1 - (1 - content) * (1 - weight * presentation)
    importance = importance * (1 - (1 - DOUBTFUL) * F.col("doubtful") / F.col("m"))
    return land(nodes.join(texts, ["host", "node"]).select("host", "node", F.col("m").alias("n_pages"), importance.alias("importance")))


def removed_nodes(importance: DataFrame, relative: float = RELATIVE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(node): nodes well below the best of their host, over hosts and nodes with enough pages."""
    enough = importance.where(F.col("n_pages") >= min_pages)
    best = enough.groupBy("host").agg(F.max("importance").alias("best"))
    low = enough.join(best, "host").where(F.col("importance") < F.col("best") * relative)
    return land(low.select("node"))


def main_text(page: str, host: str, removed: np.ndarray) -> str:
    """The blocks that are left, joined by line ends."""
    texts, _ = parse(page)
    has_main = any(t.main for t in texts)
    blocks: dict[int, list[str]] = {}
    gone: dict[int, bool] = {}
    for t in texts:
        if t.never or (has_main and not t.main):
            continue
        if t.node not in gone:
            key = node_key(host, t.node)
            i = int(np.searchsorted(removed, key))
            gone[t.node] = i < len(removed) and int(removed[i]) == key
        if not gone[t.node]:
            blocks.setdefault(t.block, []).append(t.text)
    # Each run by itself: markup ends a character reference.
    lines = (_SPACE.sub(" ", "".join(map(html.unescape, parts))).strip() for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _extract(removed: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls, pages = batch.column("url"), batch.column("html").to_pylist()
            texts = [
                main_text(page or "", host_of(url), removed.value)
                for url, page in zip(urls.to_pylist(), pages, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return run


def extract_pages(
    pages: DataFrame, relative: float = RELATIVE, min_pages: int = MIN_PAGES, max_nodes: int = MAX_NODES
) -> DataFrame:
    """(page_id, url, text, n_chars) of every row of ``pages`` (page_id, url, html).

    A null or empty page has an empty text. A null or broken url is the host without a name. Repeated
    rows and rows with a null page_id are extracted like any other. Other columns are ignored.
    Up to ``max_nodes`` removed nodes are broadcast; where there are more, only the nodes of a page are
    looked up for it, by a join on the node, and pages are parsed once more for that.
    """
    spark = pages.sparkSession
    ready(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    removed = removed_nodes(node_importance(pages), relative, min_pages)
    schema = "page_id long, url string, text string, n_chars long"
    if removed.limit(max_nodes + 1).count() <= max_nodes:
        keys = np.sort(np.array([r["node"] for r in removed.collect()], np.int64))
        return pages.mapInArrow(_extract(spark.sparkContext.broadcast(keys)), schema)
    key = F.xxhash64("page_id", "url", "html").alias("page_key")
    pages = pages.withColumn("page_key", key)
    own = pages.select("page_key", "url", "html").mapInArrow(_page_nodes, "page_key long, node long")
    own = own.join(removed.distinct(), "node", "left_semi").groupBy("page_key").agg(F.collect_set("node").alias("gone"))
    return pages.join(own, "page_key", "left").drop("page_key").mapInArrow(_extract_joined, schema)


def _page_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_key, node) of every node of a page that holds text."""
    for batch in batches:
        keys, nodes = [], []
        columns = (batch.column(c).to_pylist() for c in ("page_key", "url", "html"))
        for key, url, page in zip(*columns, strict=True):
            own = {node_key(host_of(url), t.node) for t in parse(page or "")[0]}
            keys += [key] * len(own)
            nodes += own
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.int64())], names=["page_key", "node"])


def _extract_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        columns = (batch.column(c).to_pylist() for c in ("url", "html", "gone"))
        for url, page, gone in zip(*columns, strict=True):
            texts.append(main_text(page or "", host_of(url), np.sort(np.array(gone or [], np.int64))))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("page_id"),
                batch.column("url"),
                pa.array(texts, pa.string()),
                pa.array([len(t) for t in texts], pa.int64()),
            ],
            names=["page_id", "url", "text", "n_chars"],
        )
