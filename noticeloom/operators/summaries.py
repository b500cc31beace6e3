"""Counts and headers over opportunities."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from noticeloom.operators.choose import number_within

ORDER = ("entry", "seq")
PAGES_SHIFT = 10


def named(opps: DataFrame) -> DataFrame:
    """``utility`` with the default for a missing name."""
    return opps.withColumn("utility", F.coalesce("utility", F.lit("Unknown")))


def utility_counts(opps: DataFrame) -> DataFrame:
    """Opportunities per utility, most first; ties stay in order of first appearance."""
    return (
        named(opps).groupBy("utility")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*ORDER)).alias("first"))
        .orderBy(F.desc("n"), "first")
        .select("utility", "n", "first.*")
    )


def report_totals(opps: DataFrame) -> DataFrame:
    """One row: all opportunities and how many utilities have any."""
    return (
        named(opps).groupBy("utility").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
             F.count(F.lit(1)).alias("utilities"))
    )


def utility_headers(opps: DataFrame) -> DataFrame:
    """Per utility: count, and region, type and source page of its first opportunity."""
    first = F.min_by(
        F.struct(F.col("region"), F.col("utility_type"), F.col("source_page")), F.struct(*ORDER))
    return (
        named(opps).groupBy("utility")
        .agg(F.count(F.lit(1)).alias("n"), first.alias("f"))
        .select("utility", "n", "f.*")
    )


def numbered(opps: DataFrame) -> DataFrame:
    """Opportunities with ``idx`` 1..n per utility, in order.

    A registry entry is one page; a bucket is up to ``2**PAGES_SHIFT`` pages, so
    neither the rows of a bucket nor the buckets of a utility become too many.
    """
    return number_within(named(opps), ["utility"], ORDER, F.shiftright("entry", PAGES_SHIFT))


def extraction_metrics(arrays: DataFrame) -> DataFrame:
    """Blocks, document links and fallback parts found per page, and whether parsing failed.

    Before a join with ``entry``, counts move instead of the arrays.
    """
    def size(c: str):
        return F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("bigint").alias(f"n_{c}")

    return arrays.select(
        *[c for c in ("entry", "url") if c in arrays.columns],
        *[size(c) for c in ("blocks", "doc_links", "fallback") if c in arrays.columns],
        F.col("parse_error").isNotNull().alias("failed"))
