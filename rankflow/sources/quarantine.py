"""Readers that keep what they can't read.

One scan of the files gives good rows and rejects: each line is parsed once, together with the reason why it is no
row, if there is one, and landed with its place. A reject has its file, its line in the file (from 0, blank lines
included), the reason and the line itself; nothing is dropped unreported, and the counts go into the manifest of
the stage that is made from the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankflow.functions import text, vectors
from rankflow.session import land
from rankflow.sources.readers import ENTITY_LISTS, FOLD_MAP

REJECTS = "file string, line long, reason string, value string"


class Checked(NamedTuple):
    """Good rows, rejects, and how many there are: of rows, and of rejects by reason."""

    rows: DataFrame
    rejects: DataFrame
    counts: dict[str, int]


#: The fields of a line, and the reason why it is no row (null for a good one).
Parse = Callable[[Column], tuple[Mapping[str, Column], Column]]


def _first_of(*checks: tuple[Column, str]) -> Column:
    """The reason of the first check that fails."""
    reason = F.lit(None).cast("string")
    for good, why in reversed(checks):
        reason = F.when(F.coalesce(good, F.lit(False)), reason).otherwise(F.lit(why))
    return reason


def checked_lines(
    spark: SparkSession, path: str, parse: Parse, ordinal: str | None = None, blank: str = "skipped"
) -> Checked:
    """Parse every line of the files once.

    Blank lines are ``skipped``, or rows as others are (``kept``). ``ordinal`` names a column for the number of
    the line among all lines that aren't skipped, in the order of files, a broken line included: rows after
    it keep their numbers.
    """
    lines = spark.read.text(path)
    fields, reason = parse(F.col("value"))
    skipped = (F.col("value") == "") if blank == "skipped" else F.lit(False)
    parsed = lines.select(
        F.when(skipped | reason.isNull(), F.lit(None)).otherwise(F.col("value")).alias("_value"),
        F.when(~skipped, reason).alias("_reason"),
        skipped.alias("_skipped"),
        F.struct(*[c.alias(n) for n, c in fields.items()]).alias("_row"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_place"),
    )
    placed = land(parsed)
    in_file = Window.partitionBy("_file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = placed.groupBy("_file", "_start").agg(
        F.min("_place").alias("_first"), F.count(F.lit(1)).alias("_lines"), F.count_if(~F.col("_skipped")).alias("_numbered")
    )
    splits = splits.withColumn("_lines_before", F.coalesce(F.sum("_lines").over(in_file), F.lit(0)))
    line = F.col("_lines_before") + F.col("_place") - F.col("_first")
    # Bounded: one row per file split.
    bad = placed.where("_reason is not null").join(F.broadcast(splits), ["_file", "_start"])
    rejects = bad.select(F.col("_file").alias("file"), line.alias("line"), F.col("_reason").alias("reason"), F.col("_value").alias("value"))
    good = placed.where("not _skipped and _reason is null")
    if ordinal:
        good = _numbered(placed, splits, ordinal).where("_reason is null")
    names = [*([ordinal] if ordinal else []), "_row.*"]
    counts = {r["_reason"] or "rows": r["n"] for r in placed.where("not _skipped").groupBy("_reason").agg(F.count(F.lit(1)).alias("n")).collect()}
    return Checked(good.select(*names), rejects, {"rows": 0} | dict(sorted(counts.items())))


def _numbered(placed: DataFrame, splits: DataFrame, ordinal: str) -> DataFrame:
    """Lines that aren't skipped, numbered over all files in the order of path and place."""
    earlier = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    offsets = splits.withColumn("_offset", F.coalesce(F.sum("_numbered").over(earlier), F.lit(0)))
    kept = placed.where("not _skipped")
    if placed.where("_skipped").isEmpty():
        inside = F.col("_place") - F.col("_first")
    else:  # blank lines leave gaps in the places of a split
        inside = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_place")) - 1
    joined = kept.join(F.broadcast(offsets.select("_file", "_start", "_first", "_offset")), ["_file", "_start"])
    return joined.withColumn(ordinal, (F.col("_offset") + inside).cast("long"))


def _field(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i))


def _is(value: Column, kind: str) -> Column:
    return value.try_cast(kind).isNotNull()


def checked_run(spark: SparkSession, path: str, id_name: str = "url_dbpedia") -> Checked:
    def parse(line):
        p = F.split(line, r"\s")
        index, ident, hit, score = (_field(p, i) for i in (0, 2, 3, 4))
        fields = {
            "query_index": index.try_cast("long"),
            id_name: ident,
            "hit": hit.try_cast("int"),
            "score": score.try_cast("double"),
        }
        reason = _first_of(
            (F.size(p) == 6, "not six fields"),
            (_is(index, "long"), "the query is no number"),
            (_is(hit, "int"), "the rank is no number"),
            (_is(score, "double"), "the score is no number"),
        )
        return fields, reason

    return checked_lines(spark, path, parse)


def checked_grades(spark: SparkSession, path: str) -> Checked:
    def parse(line):
        p = F.split(line, "\t")
        fields = {"query_id": _field(p, 0), "dbpedia_entity": _field(p, 2), "qrel": _field(p, 3).try_cast("int")}
        return fields, _first_of((F.size(p) == 4, "not four fields"), (_is(_field(p, 3), "int"), "the grade is no number"))

    return checked_lines(spark, path, parse)


def checked_queries(spark: SparkSession, path: str) -> Checked:
    """``query_index`` is the number of the line, blank lines not counted; a broken line keeps its number."""

    def parse(line):
        p = F.split(line, "\t")
        fields = {"query_id": _field(p, 0), "query_text": _field(p, 1)}
        return fields, _first_of((F.size(p) >= 2, "no text"), (_field(p, 0) != "", "no query id"))

    return checked_lines(spark, path, parse, "query_index")


def checked_article_grades(spark: SparkSession, path: str) -> Checked:
    def parse(line):
        p = F.split(line, r"\s")
        grade = _field(p, 3)
        fields = {"query_id": _field(p, 0), "title": text.article_title(_field(p, 2)), "qrel": grade.try_cast("int")}
        return fields, _first_of((F.size(p) == 4, "not four fields"), (_is(grade, "int"), "the grade is no number"))

    return checked_lines(spark, path, parse)


def checked_token_weights(spark: SparkSession, path: str) -> Checked:
    """Line N, blank or not, belongs to candidate N; a broken line keeps its number."""

    def parse(line):
        p = F.when(line != "", F.split(line, r"\s"))
        odd = vectors.odd_items(p)
        fields = {"deepct_tokens": vectors.even_items(p), "deepct_weights": vectors.to_weights(odd)}
        numbers = F.forall(odd, lambda w: w.try_cast("double").isNotNull())
        paired = (line == "") | (F.size(p) % 2 == 0)
        return fields, _first_of((paired, "a token without a weight"), ((line == "") | numbers, "a weight is no number"))

    return checked_lines(spark, path, parse, "ordinal", blank="kept")


def checked_entity_lists(spark: SparkSession, path: str) -> Checked:
    def parse(line):
        read = F.from_json(line, ENTITY_LISTS + ", _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})
        reason = _first_of(
            (read["_corrupt"].isNull(), "not a JSON object with a list of names"),
            (read["entities"].isNotNull(), "no list of names"),
        )
        return {"entities": read["entities"]}, reason

    return checked_lines(spark, path, parse)


def checked_folds(spark: SparkSession, path: str) -> Checked:
    """``fold, split, query_id``; a fold without a number or without its lists is rejected as a whole.

    The document is one value by its format and one row of the scan; ``line`` is the place among its folds.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    folds = whole.select("file", "value", F.from_json("value", FOLD_MAP).alias("folds"))
    entries = land(
        folds.select(
            "file",
            F.when(F.col("folds").isNull(), F.col("value")).alias("value"),
            F.posexplode_outer(F.map_entries("folds")).alias("line", "entry"),
        )
    )
    lists = F.col("entry.value")
    reason = _first_of(
        (F.col("value").isNull(), "not a JSON object of folds"),
        (F.col("entry").isNull() | _is(F.col("entry.key"), "int"), "the fold is no number"),
        (F.col("entry").isNull() | (lists["training"].isNotNull() & lists["testing"].isNotNull()), "a list is missing"),
    )
    marked = entries.withColumn("reason", reason)
    good = marked.where("reason is null and entry is not null").select(
        F.col("entry.key").cast("int").alias("fold"),
        F.explode(
            F.create_map(F.lit("training"), lists["training"], F.lit("test"), lists["testing"])
        ).alias("split", "ids"),
    )
    rows = good.select("fold", "split", F.explode("ids").alias("query_id"))
    shown = F.coalesce("value", F.to_json("entry"))
    rejects = marked.where("reason is not null").select(
        "file", F.coalesce("line", F.lit(0)).cast("long").alias("line"), "reason", shown.alias("value")
    )
    counts = {r["reason"]: r["count"] for r in rejects.groupBy("reason").count().collect()}
    return Checked(rows, rejects, {"rows": rows.count()} | dict(sorted(counts.items())))
