"""Stretches of time: when notices were listed, and how many were open on a day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from noticeloom.functions.text import norm_title


def notice_periods(history: DataFrame, key: str = "utility_id", title: str = "title",
                   run: str = "run_date") -> DataFrame:
    """One row for each unbroken stretch of runs that list a notice, by issuer and normalised title.

    ``period`` counts a notice's stretches from 1, so above 1 it was opened again. ``first_seen`` and
    ``last_seen`` are its first and last run, ``n_runs`` how many, ``closed`` the first run without it
    (NULL if the last run has it). Runs are the dates in ``history``; one on which
    an issuer lists nothing counts if any issuer lists something. Rows without a title are
    one notice of their issuer.

    A notice is one row a run before anything moves, and windows are by notice, so an issuer
    that holds much of the history is dealt to all tasks. Runs are numbered by a join
    with their dates, of which there are as many as runs.
    """
    dates = history.select(F.col(run).alias("run")).distinct()
    numbered = dates.select(
        "run", F.row_number().over(Window.orderBy("run")).alias("no"),
        F.lead("run").over(Window.orderBy("run")).alias("next"))
    listed = history.select(
        F.col(key).alias("key"), norm_title(F.col(title)).alias("norm_title"), F.col(run).alias("run")
    ).distinct().join(numbered, "run")
    by_notice = Window.partitionBy("key", "norm_title")
    island = F.col("no") - F.row_number().over(by_notice.orderBy("no"))
    stretches = listed.withColumn("island", island).groupBy("key", "norm_title", "island").agg(
        F.min("run").alias("first_seen"), F.max("run").alias("last_seen"),
        F.max(F.struct("no", "next"))["next"].alias("closed"), F.count(F.lit(1)).alias("n_runs"))
    return stretches.select(
        F.col("key").alias(key), "norm_title",
        F.row_number().over(by_notice.orderBy("island")).cast("bigint").alias("period"),
        "first_seen", "last_seen", "closed", "n_runs")


def open_by_day(spans: DataFrame, by: Sequence[str] = (), start: str = "start",
                end: str = "end") -> DataFrame:
    """How many of ``spans`` (``start`` to ``end``, both days included) hold a day: a row for each
    day and group on which the number changes.

    A span is two events and never spread over its days. Events are summed by day within tasks before
    they move; a day's number is what was open at the end of the month before plus the events
    of the month so far, so no window is longer than the months or the days of one. Spans that end
    before they start, or lack a day, count nowhere.
    """
    good = spans.where(F.col(start) <= F.col(end))
    events = good.select(*by, F.inline(F.array(
        F.struct(F.col(start).alias("day"), F.lit(1).alias("delta")),
        F.struct(F.date_add(F.col(end), 1).alias("day"), F.lit(-1).alias("delta")))))
    daily = events.groupBy(*by, "day").agg(F.sum("delta").alias("delta")).withColumn(
        "month", F.trunc("day", "month"))
    before = Window.partitionBy(*by).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    months = daily.groupBy(*by, "month").agg(F.sum("delta").alias("total")).select(
        *[F.col(c).alias(f"_{c}") for c in by], F.col("month").alias("_month"),
        F.coalesce(F.sum("total").over(before), F.lit(0)).alias("carried"))
    same = F.col("month") == F.col("_month")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    so_far = Window.partitionBy(*by, "month").orderBy("day")
    return (
        daily.withColumn("n", F.sum("delta").over(so_far)).join(months, same)
        .where("delta <> 0").select(*by, "day", (F.col("carried") + F.col("n")).alias("n_open"))
    )
