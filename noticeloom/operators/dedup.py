"""Exact and contained duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from noticeloom.functions.text import norm_title
from noticeloom.session import write_out


def first_per_title(
    df: DataFrame, group: Sequence[str], title: str = "title", seq: str = "seq"
) -> DataFrame:
    """Keep the first row per group and normalised title.

    Every task keeps one row per title before the shuffle (``WindowGroupLimit``),
    so many copies of one title cost no more than a few.
    """
    w = Window.partitionBy(*group, "_norm").orderBy(seq)
    return (
        df.withColumn("_norm", norm_title(F.col(title)))
        .withColumn("_rn", F.row_number().over(w))
        .where("_rn = 1")
        .drop("_norm", "_rn")
    )


_GRAM = 8    # characters of a gram
_EVERY = 4   # one gram in so many, by hash, is a mark
_HEAD = 4    # characters a title without marks is looked up by


def _marks(t: Column, size: Column) -> Column:
    """Hash and place of the marked grams of ``t``: the same in every title that holds them."""
    grams = F.transform(
        F.sequence(F.lit(1), size - (_GRAM - 1)),
        lambda i: F.struct(F.xxhash64(F.substring(t, i, F.lit(_GRAM))).alias("h"), i.alias("i")),
    )
    marked = F.filter(grams, lambda g: g["h"] % _EVERY == 0)
    return F.when(size >= _GRAM, marked).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))


def drop_contained(
    df: DataFrame,
    group: Sequence[str],
    title: str = "title",
    seq: str = "seq",
    droppable: Column | None = None,
) -> DataFrame:
    """Drop rows whose title is a substring (ignoring case) of an earlier title of the group.

    ``droppable`` marks the rows that may go; the others only hold titles.
    Containment is transitive, so "an earlier kept title contains mine" and "an
    earlier title contains mine" are the same test and no loop is needed.

    No two titles of a group are paired. Each distinct title that may go says
    where to look for it, every title cuts out the substrings asked for, and
    those meet the titles in an equi-join:

    * a title with marks names one of them, with its place and its own length;
      whatever contains the title has that mark too. Marks with a digit go
      first: numbers tell notices apart, stock phrases do not;
    * a title without marks (most have fewer than 20 characters) names its first
      characters and its length.

    Copies are one title from the start, and the substrings cut from a title are
    bounded by the distinct places and lengths asked for, not by the size of the
    group. Where one group is hot, AQE splits its side of these joins.
    """
    low = F.lower(F.col(title))
    can_go = F.lit(True) if droppable is None else droppable
    size = F.col("size")

    titles = write_out(
        df.select(*group, low.alias("t"), F.col(seq).alias("s"), can_go.alias("can_go"))
        .groupBy(*group, "t").agg(F.min("s").alias("s"), F.max("can_go").alias("can_go"),
                                  (F.count(F.lit(1)) > 1).alias("copied"))
        .withColumn("size", F.length("t"))
        .withColumn("marks", _marks(F.col("t"), size)),
        "titles")
    sought = titles.where("can_go")
    # A title holds itself, which only tells where there are copies of it.
    tells = (F.col("want") < size) | F.col("copied")

    anchor = F.array_min(F.transform("marks", lambda m: F.struct(
        (~F.substring("t", m["i"], F.lit(_GRAM)).rlike("[0-9]")).alias("plain"),
        m["h"].alias("h"), m["i"].alias("i"))))
    by_mark = (
        sought.where(F.size("marks") > 0)
        .select(*group, anchor.alias("a"), size.alias("want"))
        .select(*group, "a.h", F.col("a.i").alias("place"), "want")
        .distinct()
    )
    start = F.col("i") - F.col("place") + 1
    mark_cuts = (
        titles.select(*group, "t", "s", "size", "copied", F.inline("marks"))
        .join(by_mark, [*group, "h"])
        .where((start >= 1) & (start + F.col("want") - 1 <= size) & tells)
        .select(*group, "s", F.substring("t", start, F.col("want")).alias("t"))
    )

    by_head = (
        sought.where(F.size("marks") == 0)
        .withColumn("q", F.least(size, F.lit(_HEAD)))
        .select(*group, "q", F.left("t", F.col("q")).alias("head"), size.alias("want"))
        .distinct()
    )
    head_sizes = by_head.select(*group, "q").distinct()  # at most _HEAD + 1 per group
    head_cuts = (
        titles.select(*group, "t", "s", "size", "copied").join(head_sizes, list(group))
        .where(F.col("q") <= size)
        .select("*", F.explode(F.sequence(F.lit(1), size - F.col("q") + 1)).alias("i"))
        .withColumn("head", F.substring("t", F.col("i"), F.col("q")))
        .join(by_head, [*group, "q", "head"])
        .where((F.col("i") + F.col("want") - 1 <= size) & tells)
        .select(*group, "s", F.substring("t", F.col("i"), F.col("want")).alias("t"))
    )

    earliest = mark_cuts.unionByName(head_cuts).groupBy(*group, "t").agg(F.min("s").alias("s"))
    left = df.withColumn("_low", low)
    hit = (left["_low"] == earliest["t"]) & (earliest["s"] < left[seq]) & can_go
    for g in group:
        hit = hit & (left[g] == earliest[g])
    return left.join(earliest, hit, "left_anti").drop("_low")


def similar_titles(
    df: DataFrame,
    group: Sequence[str],
    title: str = "title",
    seq: str = "seq",
    threshold: float = 0.8,
) -> DataFrame:
    """Pairs of titles of a group whose words have a Jaccard similarity of ``threshold`` or more.

    Titles with the same words are one, named by their first ``seq``; the result is
    ``group, first, second, similarity`` with ``first < second``. ``threshold`` is above one half.

    Two such titles share at least two words among the rarest few of each (as many as may
    differ, and two), so they meet at a pair of rare words in an equi-join; no group is ever
    paired with itself. Every step merges within tasks before rows move, and Spark splits
    the joins of a frequent word.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError("threshold is above 0.5, up to 1")
    words = F.array_sort(F.array_distinct(
        F.regexp_extract_all(F.lower(F.col(title)), F.lit(r"(?U)\w+"), F.lit(0))))
    sets = write_out(
        df.where(F.col(title).isNotNull()).select(*group, words.alias("words"), F.col(seq).alias("s"))
        .groupBy(*group, "words").agg(F.min("s").alias("s")).where(F.size("words") > 1), "word_sets")
    each = sets.select(*group, "s", F.explode("words").alias("word"))
    # Written, so that both sides of the join are plain exchanges, of which Spark splits a hot one.
    counts = write_out(each.groupBy(*group, "word").agg(F.count(F.lit(1)).alias("n")), "word_counts")
    rare_first = F.transform(
        F.array_sort(F.collect_list(F.struct("n", "word"))), lambda x: x["word"])
    size = F.size("words")
    rarest = F.slice("words", 1, (size - F.ceil(size * F.lit(threshold) - 1e-9) + 2).cast("int"))
    keys = F.flatten(F.transform(rarest, lambda a, i: F.transform(
        F.slice(rarest, i + 2, F.size(rarest)),
        lambda b: F.struct(F.least(a, b).alias("one"), F.greatest(a, b).alias("two")))))
    keyed = write_out(
        each.join(counts, [*group, "word"]).groupBy(*group, "s").agg(rare_first.alias("words"))
        .select(*group, "s", "words", F.explode(keys).alias("key")), "rare_words")
    a, b = keyed.alias("a"), keyed.select(
        *group, F.col("s").alias("t"), F.col("words").alias("others"), "key").alias("b")
    shared = F.size(F.array_intersect("words", "others"))
    similarity = shared / (F.size("words") + F.size("others") - shared)
    near = F.size("words") >= threshold * F.size("others") - 1e-9
    near &= F.size("others") >= threshold * F.size("words") - 1e-9
    return (
        a.join(b, [*group, "key"]).where((F.col("s") < F.col("t")) & near)
        .select(*group, F.col("s").alias("first"), F.col("t").alias("second"), similarity.alias("similarity"))
        .where(F.col("similarity") >= threshold - 1e-9).distinct()
    )
