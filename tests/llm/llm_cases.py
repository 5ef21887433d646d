"""Tables with every awkward row, and plain Python versions of what operators do."""

import re

SMALL = "/root/testdata/sf0.001"

PROSE = (
    "the quick brown fox jumps over the lazy dog while seven wizards brew a strange potion in the old tower"
    " near the river and nobody in the village knows what it is for"
)
# Names that operators use inside; a table may bring its own.
EXTRA = ["score", "rep", "key", "row", "base", "spans", "part", "length", "block", "keys", "copies", "number", "kind"]


def awkward_docs(spark, empty=False):
    """doc_id, text and columns with clashing names: nulls, empty and long texts, ties, repeated rows."""
    texts = [
        (1, None),
        (2, ""),
        (3, " \n "),
        (4, "one two"),
        (5, PROSE),
        (6, PROSE),
        (6, PROSE),
        (7, PROSE.replace("potion", "lotion")),
        (8, (PROSE + " ") * 1500),
        (None, PROSE),
        (None, None),
        (9, "x" * 200_000),
        (10, "Ünï 漢字 😀 " + PROSE.upper()),
    ]
    rows = [] if empty else [(i, t, *([None] * len(EXTRA))) for i, t in texts]
    schema = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA)
    return spark.createDataFrame(rows, schema).repartition(3)


def small(spark, name):
    return spark.read.parquet(f"{SMALL}/{name}.parquet")


def plain_words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def plain_shingles(text, n=5):
    words = plain_words(text)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def plain_classes(rows, threshold=0.8):
    """{row number: (class, links)} by comparing all pairs of (id, text)."""
    sets = [plain_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and common / len(sets[i] | sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i, (ident, _) in enumerate(rows):
        least[find(i)] = min(ident, least.get(find(i), ident))
    return {i: (least[find(i)], links[i]) for i in range(len(rows))}
