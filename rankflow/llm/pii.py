"""Personal data: spans of e-mail and IP addresses, card and phone numbers.

Base spans follow strict patterns. Generators with looser patterns propose further spans, which may
overlap. Boosted trees judge each proposal by its format and context; a threshold per kind, set on
proposals that the fit did not see, selects those to add. The trees learn from the proposals
themselves: one that is valid by the strict rules of its kind is a positive example, any other a
negative one. The strict rules (check digits, ranges) are not features, so that a span in the same
format and context as valid ones can be added although it breaks a rule.

Only DataFrame functions touch the texts. A pattern's places follow from the lengths of the text
between its matches. Proposals are aggregated by their features before anything reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankflow.llm.boosted import Node, fit_trees, logit_column
from rankflow.session import land

KINDS = ("email", "ip", "card", "phone")

# The base patterns. Possessive repeats and the look-behind only save backtracking: a match can't start
# inside a run of its own characters, except where the last match ended.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: High-recall patterns; each also proposes what its base pattern finds.
GENERATORS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++ ?(?:@|\((?i:at)\)|\[(?i:at)\]) ?[\p{L}0-9-]++"
    r"(?: ?(?:\.|\((?i:dot)\)|\[(?i:dot)\]) ?[\p{L}0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f.:])(?:[0-9]++(?: ?\. ?[0-9]++){3}+|(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4})",
    "card": r"(?<![0-9])[0-9](?:[ ./-]{0,2}+[0-9]){11,18}+",
    "phone": r"(?<![0-9])(?:\+|00)?\(?[0-9]{1,4}\)?(?:[ ./()-]{0,2}+[0-9]{2,4}){2,4}+",
}
#: What a text must hold for a pattern to match at all.
_QUICK = {"email": r"@|\((?i:at)\)|\[(?i:at)\]", "ip": "[0-9]", "card": "[0-9]", "phone": "[0-9]"}

# Words that often stand before personal data, or before other numbers.
CUES = r"(?i)(?:e-?mail|mail|tel|phone|call|fax|mobil|contact|kontakt|card|visa|iban|konto|ip|host|addr|server)\W*+$"
OTHER_CUES = r"(?i)(?:token|key|sha|md5|isbn|issn|version|ver|no\.?|nr\.?|id|total|price|year|doi|rev|[$€£#])\W*+$"

CONTEXT = 24
_BLOCK = 512
FEATURES = 12
#: Distinct rows of features that the fit takes, those with the most examples first.
MAX_PATTERNS = 20_000
SCORE_STEPS = 1024
PRECISION = 0.95


def _prefix(values: Column) -> Column:
    """Running totals of a short array of longs."""
    none = F.array().cast("array<bigint>")
    return F.aggregate(
        values, none, lambda acc, x: F.array_append(acc, x + F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)))
    )


def with_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, str]], width: int = CONTEXT) -> DataFrame:
    """Add one column per pattern: array of (start, end, value, before, after), in code points.

    ``patterns`` maps a column to (what a text must contain, pattern). Totals are run over blocks and
    then over the blocks, so that a text with very many matches takes little more than linear time.
    """
    names = list(patterns)
    strings = F.array().cast("array<string>")
    df = df.withColumns(
        {
            f"_m_{n}": F.when(F.col(text).rlike(quick), F.regexp_extract_all(text, F.lit(p), 0)).otherwise(strings)
            for n, (quick, p) in patterns.items()
        }
    )
    df = df.withColumns(
        {
            f"_g_{n}": F.when(F.size(f"_m_{n}") > 0, F.split(text, patterns[n][1], -1)).otherwise(strings)
            for n in names
        }
    )

    def blocks(n: str) -> Column:
        matches, gaps = F.col(f"_m_{n}"), F.col(f"_g_{n}")
        last = F.size(matches) - 1
        sizes = lambda b: F.transform(
            F.sequence(b * _BLOCK, F.least(b * _BLOCK + _BLOCK - 1, last)),
            lambda i: (F.char_length(F.get(gaps, i)) + F.char_length(F.get(matches, i))).cast("bigint"),
        )
        several = F.transform(F.sequence(F.lit(0), F.floor(last / _BLOCK).cast("int")), lambda b: _prefix(sizes(b)))
        return F.when(last >= 0, several).otherwise(F.array().cast("array<array<bigint>>"))

    df = df.withColumns({f"_b_{n}": blocks(n) for n in names})
    df = df.withColumns(
        {f"_o_{n}": _prefix(F.transform(f"_b_{n}", lambda b: F.get(b, F.size(b) - 1))) for n in names}
    )

    def spans(n: str) -> Column:
        matches, gaps, offsets = F.col(f"_m_{n}"), F.col(f"_g_{n}"), F.col(f"_o_{n}")
        ends = F.flatten(
            F.transform(
                f"_b_{n}",
                lambda b, i: F.transform(b, lambda x: x + F.when(i > 0, F.get(offsets, i - 1)).otherwise(F.lit(0))),
            )
        )
        return F.transform(
            ends,
            lambda end, i: F.struct(
                (end - F.char_length(F.get(matches, i))).alias("start"),
                end.alias("end"),
                F.get(matches, i).alias("value"),
                F.right(F.get(gaps, i), F.lit(width)).alias("before"),
                F.left(F.get(gaps, i + 1), F.lit(1)).alias("after"),
            ),
        )

    df = df.withColumns({n: spans(n) for n in names})
    return df.drop(*[f"_{x}_{n}" for n in names for x in "mgbo"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _between(value: Column, low: int, high: int) -> Column:
    n = F.char_length(_digits(value))
    return (n >= low) & (n <= high)


def _small_part(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return F.when(F.char_length(bare) > 3, False).otherwise(F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255)


def is_valid(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), _small_part)
    if kind == "card":
        return _between(value, 13, 19) & F.call_function("luhn_check", _digits(value))
    return _between(value, 9, 15)


def _char_class(c: Column) -> Column:
    return (
        F.when(c == "", 0)
        .when(c.rlike(r"^\s"), 1)
        .when(c.rlike(r"^[0-9]"), 3)
        .when(c.rlike(r"^\p{L}"), 2)
        .when(c.rlike("^[\"'=:#/_]"), 4)
        .otherwise(5)
    )


def _features(kind: str, c: Column) -> list[Column]:
    value, number = c["value"], KINDS.index(kind)
    digits = F.char_length(_digits(value))
    marks = F.array_distinct(F.split(F.regexp_replace(value, r"[\p{L}0-9]", ""), ""))
    groups = F.regexp_replace(F.regexp_replace(value, "[0-9]{4}", "4"), "[0-9]{3}", "3")
    return [
        F.lit(number),
        F.least(digits, F.lit(20)),
        F.when(F.array_contains(marks, ""), F.size(marks) - 1).otherwise(F.size(marks)),
        F.when(groups.rlike(r"^4(?:[ -]?4){3}$"), 1).when(groups.rlike("3[^0-9]{1,2}3[^0-9]4$"), 2)
        .when(groups.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), 3).otherwise(0),
        _char_class(F.right(c["before"], F.lit(1))),
        _char_class(c["after"]),
        c["before"].rlike(CUES).cast("int"),
        c["before"].rlike(OTHER_CUES).cast("int"),
        F.least(F.char_length(value), F.lit(40)),
        F.when(value.contains("@"), 2).when(value.rlike(r"[\[(]"), 1).otherwise(0),
        value.startswith("+").cast("int"),
        value.rlike(r"\.\p{L}{2,10}$").cast("int"),
    ]


def _strict(kind: str, value: Column) -> Column:
    plain = BASE[kind].replace(r"(?:(?<![A-Za-z0-9._%+-])|\G)", "").replace(r"(?:(?<![0-9])|\G)", "")
    return value.rlike(f"^(?:{plain})$") & is_valid(kind, value)


def find_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (text, not null) with ``base`` and ``proposed`` spans of all kinds.

    base: array of (kind, start, end) with kind as a number; proposed: the same with features and valid.
    """
    patterns = {f"_base_{k}": (_QUICK[k], BASE[k]) for k in KINDS}
    patterns |= {f"_more_{k}": (_QUICK[k], GENERATORS[k]) for k in KINDS}
    df = with_spans(docs, "text", patterns)

    def valid_spans(i: int, kind: str) -> Column:
        return F.transform(
            F.filter(f"_base_{kind}", lambda c: is_valid(kind, c["value"])),
            lambda c: F.struct(F.lit(i).alias("kind"), c["start"].alias("start"), c["end"].alias("end")),
        )

    def proposals(i: int, kind: str) -> Column:
        return F.transform(
            f"_more_{kind}",
            lambda c: F.struct(
                F.lit(i).alias("kind"),
                c["start"].alias("start"),
                c["end"].alias("end"),
                F.array(*_features(kind, c)).alias("x"),
                _strict(kind, c["value"]).alias("valid"),
            ),
        )

    base = [valid_spans(i, k) for i, k in enumerate(KINDS)]
    proposed = [proposals(i, k) for i, k in enumerate(KINDS)]
    df = df.withColumns({"base": F.concat(*base), "proposed": F.concat(*proposed)})
    return df.drop(*patterns)


@dataclass
class Model:
    base: float
    trees: list[Node]
    thresholds: list[float]


def fit(found: DataFrame, max_patterns: int = MAX_PATTERNS, precision: float = PRECISION) -> Model:
    """Fit on the proposals of ``found``, three quarters of the documents, and set thresholds on the rest.

    The fit takes the ``max_patterns`` most frequent rows of features. The thresholds come from all proposals of
    the other documents, counted by kind and score (in steps of 1/``SCORE_STEPS``): a kind gets the lowest one
    at which the proposals above it are valid in ``precision`` of these cases; none is added where that is
    never so, or nothing was seen.
    """
    each = found.select((F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(4)) == 0).alias("held"), F.explode("proposed").alias("c"))
    counts = each.groupBy("held", F.col("c.x").alias("x")).agg(
        F.count_if("c.valid").alias("good"), F.count_if(~F.col("c.valid")).alias("bad")
    )
    counts = land(counts)
    seen = counts.where("not held").orderBy(F.desc(F.col("good") + F.col("bad")), "x").limit(max_patterns).collect()
    if not seen:
        return Model(0.0, [], [float("inf")] * len(KINDS))
    x = np.array([r["x"] for r in seen], np.int64)
    base, trees = fit_trees(x, *(np.array([r[c] for r in seen], float) for c in ("good", "bad")))
    score = logit_column(base, trees, [F.get("x", F.lit(i)) for i in range(FEATURES)])
    step = F.floor(score * SCORE_STEPS).alias("step")
    unseen = counts.where("held").groupBy(F.get("x", F.lit(0)).alias("kind"), step)
    steps = unseen.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")).collect()
    thresholds = []
    for kind in range(len(KINDS)):
        own = sorted((-r["step"], r["good"], r["bad"]) for r in steps if r["kind"] == kind)
        threshold, right, wrong = float("inf"), 0, 0
        for step, good, bad in own if trees else []:
            right, wrong = right + good, wrong + bad
            if right >= precision * (right + wrong):
                threshold = -step / SCORE_STEPS
        thresholds.append(threshold)
    return Model(base, trees, thresholds)


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def select_spans(found: DataFrame, model: Model) -> DataFrame:
    """``found`` with ``spans``: base spans and selected proposals, by kind and start.

    A proposal that overlaps a base span is not added. Of proposals that overlap each other, one is
    added unless a better one (higher score, then longer, then earlier kind and start) is in its way.
    """
    features = lambda c: [F.get(c["x"], i) for i in range(FEATURES)]
    limits = [min(t, 1e300) for t in model.thresholds]
    scored = F.transform(
        "proposed",
        lambda c: F.struct(
            logit_column(model.base, model.trees, features(c)).alias("score"),
            (c["end"] - c["start"]).alias("size"),
            (-c["kind"]).alias("order"),
            (-c["start"]).alias("place"),
            c["kind"].alias("kind"),
            c["start"].alias("start"),
            c["end"].alias("end"),
        ),
    )
    limit = lambda c: F.element_at(F.array(*[F.lit(x - 1e-9) for x in limits]), c["kind"] + 1)
    df = found.withColumn("_good", F.filter(scored, lambda c: c["score"] >= limit(c)))
    base = F.col("base")
    df = df.withColumn(
        "_free", F.filter("_good", lambda c: ~F.exists(base, lambda b: _overlap(b, c)))
    )
    free = F.col("_free")
    # Structs compare field by field.
    best = F.filter("_free", lambda c: ~F.exists(free, lambda d: _overlap(c, d) & (d > c)))
    added = F.transform(best, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return df.withColumn("spans", F.array_sort(F.concat("base", added))).drop("_good", "_free")


def span_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def find_pii(docs: DataFrame, **parameters) -> DataFrame:
    """Every row of ``docs`` with ``base`` and ``spans``, arrays of (kind, start, end) by kind and start.

    A null text is an empty one; neither has spans. Repeated rows and rows with a null doc_id are
    treated like any other. Only doc_id and text are read and returned, without the text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = land(find_candidates(rows).drop("text"))
    return select_spans(found, fit(found, **parameters)).drop("proposed")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    by_place = F.array_sort(
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:int>>")

    def merge(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        more = F.array_append(F.slice(acc, 1, F.size(acc) - 1), joined)
        return F.when((F.size(acc) > 0) & (s["start"] < last["end"]), more).otherwise(F.array_append(acc, s))

    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    merged = F.aggregate(by_place, none, merge)
    piece = lambda m: F.transform(
        m,
        lambda s, i: F.concat(
            F.substring(
                text,
                F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(F.lit(0)).cast("int") + 1,
                (s["start"] - F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(F.lit(0))).cast("int"),
            ),
            F.get(names, s["kind"]),
        ),
    )
    last_end = F.coalesce(F.get(merged, F.size(merged) - 1)["end"], F.lit(0)).cast("int")
    tail = F.substring(text, last_end + 1, F.char_length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(piece(merged), ""), tail))


def redact_documents(docs: DataFrame, **parameters) -> DataFrame:
    """``docs``, all rows and columns, with the spans in ``text`` replaced; ``n_chars`` follows the text.

    A null text stays null. Texts without a span are left as they are.
    """
    columns = docs.columns
    held = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    rows = docs.select(held, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = land(find_candidates(rows).drop("text"))
    found = select_spans(found, fit(found, **parameters))
    text = F.when(F.col("row.text").isNotNull(), redact(F.col("row.text"), F.col("spans")))
    changed = found.withColumn("new", text)
    values = {c: F.col(f"row.`{c}`") for c in columns} | {"text": F.col("new")}
    if "n_chars" in columns:
        size = F.char_length("new").cast(docs.schema["n_chars"].dataType)
        values["n_chars"] = F.when(F.size("spans") > 0, size).otherwise(F.col("row.n_chars"))
    return changed.select(*[values[c].alias(c) for c in columns])
