"""Column expressions on text: quads, entity keys, titles, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats of the knowledge-base dump, the grade files and the vector files.
QUAD_PATTERN = r'(?s)^<([^>]*)> <([^>]*)> (".*"@[A-Za-z-]+ )<([^<>]*)> \.\s*$'
QUAD_FIELDS = ("url_dbpedia", "predicate", "abstract", "url_wikipedia")
RESOURCE_MARK = "resource/"
ENTITY_PREFIX = "<dbpedia:"
ENTITY_SUFFIX = ">"
WIKIDATA_IRI_PREFIX = "<http://www.wikidata.org/entity/"
LITERAL_END = '"@en '
ARTICLE_MARK = "enwiki:"

_TO_END = 2147483647
_ESCAPES = (("\x00", "\x00\x01"), ("\ufffd", "\x00\x02"))

TOKEN_BREAK = r"[^\p{L}\p{N}]+"


def valid_utf8(value: Column) -> Column:
    """Drop the bytes that are not UTF-8; a replacement character that stands in the line stays.

    The repair marks bad bytes with the same character, so genuine ones are set aside meanwhile as
    two control characters, and the first of these as two others.
    """
    escaped = value
    for character, pair in _ESCAPES:
        escaped = F.replace(escaped, F.lit(character), F.lit(pair))
    repaired = F.replace(F.make_valid_utf8(escaped), F.lit("�"), F.lit(""))
    for character, pair in reversed(_ESCAPES):
        repaired = F.replace(repaired, F.lit(pair), F.lit(character))
    return F.when(F.is_valid_utf8(value), value).otherwise(repaired)


def is_quad(line: Column) -> Column:
    """The pattern is anchored at both ends, so '<' or '> ' inside the literal does no harm."""
    return line.rlike(QUAD_PATTERN)


def quad_fields(line: Column) -> list[Column]:
    """The four fields of a line for which ``is_quad`` holds, cut from both ends of the line."""

    def after(start) -> Column:
        return F.substring(line, start, F.lit(_TO_END))

    url = F.substring_index(after(F.lit(2)), ">", 1)
    predicate = F.substring_index(after(F.length(url) + 5), ">", 1)
    tail = F.substring_index(line, "<", -1)
    start = F.length(url) + F.length(predicate) + 7
    abstract = F.substring(line, start, F.length(line) - F.length(tail) - start)
    fields = (url, predicate, abstract, F.substring_index(tail, ">", 1))
    return [f.alias(n) for f, n in zip(fields, QUAD_FIELDS)]


def entity_key(url: Column) -> Column:
    return F.concat(
        F.lit(ENTITY_PREFIX),
        F.substring_index(url, RESOURCE_MARK, -1),
        F.lit(ENTITY_SUFFIX),
    )


def entity_title(entity: Column) -> Column:
    """Inverse of ``entity_key`` as a page title with underscores."""
    inner = F.substring(
        entity,
        F.lit(len(ENTITY_PREFIX) + 1),
        F.length(entity) - F.lit(len(ENTITY_PREFIX) + len(ENTITY_SUFFIX)),
    )
    return F.replace(inner, F.lit(" "), F.lit("_"))


def wikidata_iri(wikidata_id: Column) -> Column:
    """Null stays null, because concat does."""
    return F.concat(F.lit(WIKIDATA_IRI_PREFIX), wikidata_id, F.lit(">"))


def clean_literal(literal: Column) -> Column:
    """Text of a quoted English literal, without the opening quote and the language tag."""
    return F.substring_index(F.substring(literal, 2, _TO_END), LITERAL_END, 1)


def article_title(article: Column) -> Column:
    """Percent-decoded title after the site mark.

    '+' is a plain character here, and a '%' that starts no escape stays as it is.
    """
    raw = F.get(F.split(article, ARTICLE_MARK), F.lit(1))
    guarded = F.regexp_replace(
        F.replace(raw, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25"
    )
    return F.coalesce(F.try_url_decode(guarded), raw)


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), TOKEN_BREAK), "")


def score_name(encoder: str, graph: bool, weights: bool) -> str:
    return f"score_{encoder}_{graph}_{weights}"
