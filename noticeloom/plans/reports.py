"""Text, Markdown and JSON reports.

A report is made of paragraphs: a head, the utilities by name with their numbered entries, and a
tail. The rows of paragraphs are range-sorted by ``(section, utility, idx)`` and only then made text, so
the sort moves the few values that an entry shows. Written as text, the part files in name order are the
document, however long it is.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from noticeloom.functions import vocab as V
from noticeloom.operators import summaries as S

LINE_ORDER = ("section", "utility", "idx")
JSON_ORDER = ("section", "entry", "seq")


def _lit(text: str) -> Column:
    return F.lit(text)


def _or(col: str | Column, default: str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(default))


def _lines(df: DataFrame, section: int, utility: Column, idx: Column,
           lines: Sequence[Column]) -> DataFrame:
    """One paragraph per row, as text: heads and tails. A NULL line will be left out."""
    return df.select(F.lit(section).alias("section"), utility.alias("utility"),
                     idx.cast("bigint").alias("idx"), F.array(*lines).alias("lines"))


def _in_order(edges: DataFrame, entries: DataFrame, order: Sequence[str], lines: Column) -> DataFrame:
    """The lines of the document, in order: ``order``, ``line_no``, ``line``.

    ``lines`` is the text of an entry, made of its columns after the sort, where it is written: a sort
    samples its input, and neither that nor the shuffle need the text. The outer form is not given
    a filter that would have it made before.
    """
    rows = edges.unionByName(entries, allowMissingColumns=True)
    return (
        rows.orderBy(*order)
        .select(*order, F.posexplode_outer(F.coalesce("lines", lines)).alias("line_no", "line"))
        .where(F.col("line").isNotNull())
    )


#: Column of the place of an entry in its utility, in tables that several reports are made of.
PLACE = "_idx"


def with_places(opps: DataFrame) -> DataFrame:
    """``opps`` with the place of each entry, for reports that share it: numbering moves whole rows."""
    return S.numbered(opps.withColumn("_named", F.col("utility"))).withColumn("utility", F.col("_named")) \
        .drop("_named").withColumnRenamed("idx", PLACE)


def _numbered(opps: DataFrame) -> DataFrame:
    return S.named(opps).withColumnRenamed(PLACE, "idx") if PLACE in opps.columns else S.numbered(opps)


def _edge(totals: DataFrame, section: int, lines: Sequence[Column]) -> DataFrame:
    return _lines(totals, section, _lit(""), F.lit(0), lines)


def _dates(limit: int | None = None) -> Column:
    """Date strings joined by commas, NULL when there are none."""
    dates = F.col("dates") if limit is None else F.slice("dates", 1, limit)
    joined = F.array_join(F.transform(dates, lambda d: d["date"]), ", ")
    return F.when(F.size("dates") > 0, joined)


def _when_any(*lines: Column) -> list[Column]:
    return [F.when(F.col("total") > 0, line) for line in lines]


def summary_lines(opps: DataFrame, generated: str) -> DataFrame:
    """Text summary: totals, utilities, entries with up to three dates. Write ``opps`` first."""
    totals = S.report_totals(opps)
    head = _edge(totals, 0, [
        F.when(F.col("total") == 0, "No RFP opportunities found."),
        *_when_any(
            _lit("=" * 80),
            _lit(f"RFP OPPORTUNITIES REPORT - {generated}"),
            _lit("=" * 80),
            _lit(""),
            F.concat(_lit("Total Opportunities Found: "), F.col("total")),
            _lit(""),
            F.concat(_lit("Utilities Scraped: "), F.col("utilities")),
            _lit(""),
            _lit("-" * 80),
        ),
    ])
    sections = _lines(S.utility_headers(opps), 1, F.col("utility"), F.lit(0), [
        _lit(""),
        F.concat(F.col("utility"), _lit(" ("), _or("region", "N/A"), _lit(")")),
        F.concat(_lit("  Type: "), _or("utility_type", "N/A")),
        F.concat(_lit("  Opportunities: "), F.col("n")),
        _lit(""),
    ])
    entries = _numbered(opps).select(
        F.lit(1).alias("section"), "utility", F.col("idx").cast("bigint").alias("idx"),
        F.left(F.col("title"), F.lit(V.LISTING_TITLE_CHARS)).alias("title"),
        _dates(V.LISTING_DATES).alias("shown"), "url")
    lines = F.array(
        F.concat(_lit("  ["), F.col("idx"), _lit("] "), _or("title", "Untitled")),
        F.concat(_lit("      Dates: "), F.col("shown")),
        F.concat(_lit("      Link: "), _or("url", "N/A")),
        _lit(""),
    )
    tail = _edge(totals, 2, _when_any(_lit("=" * 80)))
    return _in_order(head.unionByName(sections).unionByName(tail), entries, LINE_ORDER, lines)


def markdown_lines(opps: DataFrame, generated: str) -> DataFrame:
    """Markdown report: a heading per utility and per entry, all dates. Write ``opps`` first."""
    totals = S.report_totals(opps)
    head = _edge(totals, 0, [
        _lit("# RFP Opportunities Report"),
        _lit(""),
        F.when(F.col("total") == 0, "No opportunities found."),
        *_when_any(
            _lit(f"**Generated:** {generated}"),
            _lit(""),
            F.concat(_lit("**Total Opportunities:** "), F.col("total")),
            _lit(""),
            _lit("---"),
            _lit(""),
        ),
    ])
    sections = _lines(S.utility_headers(opps), 1, F.col("utility"), F.lit(0), [
        F.concat(_lit("## "), F.col("utility")),
        _lit(""),
        F.concat(_lit("**Region:** "), _or("region", "N/A")),
        F.concat(_lit("**Type:** "), _or("utility_type", "N/A")),
        F.concat(_lit("**Source:** "), _or("source_page", "N/A")),
        F.concat(_lit("**Opportunities Found:** "), F.col("n")),
        _lit(""),
    ])
    dates = F.col("shown")
    entries = _numbered(opps).select(
        F.lit(1).alias("section"), "utility", F.col("idx").cast("bigint").alias("idx"), "title",
        F.left(F.col("description"), F.lit(V.MARKDOWN_SUMMARY_CHARS)).alias("summary"),
        _dates().alias("shown"), "url")
    lines = F.array(
        F.concat(_lit("### "), F.col("idx"), _lit(". "), _or("title", "Untitled")),
        _lit(""),
        F.concat(_lit("**Summary:** "), _or("summary", "No description"), _lit("...")),
        F.when(dates.isNotNull(), _lit("")),
        F.concat(_lit("**Key Dates:** "), dates),
        _lit(""),
        F.concat(_lit("**More Information:** ["), _or("url", "N/A"), _lit("]("),
                 _or("url", "#"), _lit(")")),
        _lit(""),
        _lit("---"),
        _lit(""),
    )
    return _in_order(head.unionByName(sections), entries, LINE_ORDER, lines)


def _json_text(value: Column, kind: T.DataType, depth: int) -> Column:
    """``value`` as JSON text, indented by two spaces a level; NULL is ``null``."""
    inner, outer = "\n" + "  " * (depth + 1), "\n" + "  " * depth

    def wrapped(left: str, parts: Column, right: str) -> Column:
        body = F.concat(_lit(left + inner), F.array_join(parts, "," + inner), _lit(outer + right))
        return F.when(F.size(parts) == 0, left + right).otherwise(body)

    def quoted(text: Column) -> Column:
        whole = F.to_json(F.struct(text.alias("v")))
        return F.substring(whole, _lit(6), F.length(whole) - 6)

    if isinstance(kind, T.StructType):
        shown = wrapped("{", F.array(*[
            F.concat(_lit(f"{json.dumps(f.name)}: "), _json_text(value[f.name], f.dataType, depth + 1))
            for f in kind]), "}")
    elif isinstance(kind, T.ArrayType):
        shown = wrapped("[", F.transform(
            value, lambda x: _json_text(x, kind.elementType, depth + 1)), "]")
    elif isinstance(kind, T.MapType):
        shown = wrapped("{", F.transform(F.map_entries(value), lambda e: F.concat(
            quoted(e["key"].cast("string")), _lit(": "), _json_text(e["value"], kind.valueType, depth + 1))), "}")
    elif isinstance(kind, T.NumericType | T.BooleanType):
        shown = value.cast("string")
    elif isinstance(kind, T.TimestampType):
        shown = quoted(F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss"))
    else:
        shown = quoted(value.cast("string"))
    return F.when(value.isNull(), "null").otherwise(shown)


def json_lines(opps: DataFrame, generated: str) -> DataFrame:
    """The JSON report ``{generated_at, total_opportunities, opportunities: [...]}`` as lines, indented
    by two spaces.

    An opportunity is one paragraph, in ``(entry, seq)`` order, so no row ever holds them all.
    """
    totals = opps.agg(F.count(F.lit(1)).alias("total"))
    place = F.struct("entry", "seq")
    last = opps.agg(F.max(place)).scalar()

    def edge(section: int, lines: Sequence[Column]) -> DataFrame:
        nowhere = F.lit(0).cast("bigint")
        return totals.select(
            F.lit(section).alias("section"), nowhere.alias("entry"), nowhere.alias("seq"),
            F.array(*lines).alias("lines"))

    head = edge(0, [
        _lit("{"),
        _lit(f'  "generated_at": {json.dumps(generated)},'),
        F.concat(_lit('  "total_opportunities": '), F.col("total"), _lit(",")),
        _lit('  "opportunities": ['),
    ])
    fields = [c for c in opps.columns if c not in ("entry", "seq", PLACE)]
    record = F.struct(*fields)
    kind = opps.select(record.alias("r")).schema["r"].dataType
    text = F.concat(_lit("    "), _json_text(record, kind, 2), F.when(place == last, "").otherwise(","))
    body = opps.select(F.lit(1).alias("section"), "entry", "seq", *fields)
    return _in_order(head.unionByName(edge(2, [_lit("  ]"), _lit("}")])), body, JSON_ORDER, F.split(text, "\n"))
