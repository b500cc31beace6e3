"""First-n, best-tier and numbering, safe when one group holds much of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def first_n(
    df: DataFrame,
    group: Sequence[str],
    n: int | Column,
    seq: str = "seq",
    at_most: int | None = None,
) -> DataFrame:
    """Keep the first ``n`` rows per group; ``n`` may differ per row.

    A constant prunes inside each task before the shuffle. For an ``n`` per row
    pass ``at_most``, a value no ``n`` exceeds, for the same effect.
    """
    w = Window.partitionBy(*group).orderBy(seq)
    kept = df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    if at_most is not None:
        kept = kept.where(F.col("_rn") <= at_most)
    return kept.drop("_rn")


def best_tier(df: DataFrame, group: Sequence[str], tier: str = "tier") -> DataFrame:
    """Rows of the lowest tier present in their group.

    The best tier is a pre-aggregated minimum joined back; no window ever holds a group.
    """
    best = df.groupBy(*group).agg(F.min(tier).alias(tier))
    return df.join(best, [*group, tier], "left_semi")


def number_within(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    name: str = "idx",
) -> DataFrame:
    """Number rows 1..n per group in ``order``.

    ``bucket`` must not decrease along ``order``. Rows are numbered per group and
    bucket, and each bucket starts after the rows of the buckets before it, so a
    group that fills the table is numbered by many tasks. Only the bucket counts
    meet in one window.
    """
    keys = [*group, "_bucket"]
    rows = df.withColumn("_bucket", bucket)
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    local = Window.partitionBy(*keys).orderBy(*order)
    return (
        rows.withColumn("_rn", F.row_number().over(local))
        .join(offsets, keys)
        .withColumn(name, F.col("_before") + F.col("_rn"))
        .drop("_rn", "_before", "_bucket")
    )
