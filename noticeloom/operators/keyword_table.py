"""Texts that hold the terms of a table, however long the table is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from noticeloom.session import write_out

#: Characters of a text by which it looks for terms. Shorter terms are looked up whole.
GRAM = 4
#: Runs whose hashes are broadcast, at some 20 bytes each; more are joined by a shuffle.
MOST_BROADCAST = 4_000_000
#: Terms of a run beyond which they are told apart by one more character.
HOT = 50
#: Buckets of texts for each task of a shuffle. The terms of a bucket move once for all its texts.
BUCKETS = 4
#: Has a join by bucket and run take both sides as they are, dealt by bucket.
DEALT_BY_ONE_KEY = ("spark.sql.requireAllClusterKeysForCoPartition", "false")


def _grams(text: Column, size: int, least: int | None = None) -> Column:
    """The different runs of ``size`` characters of a text, or shorter ones down to ``least`` at its end; one
    look ahead at each place, as counting characters from the start would take quadratic time."""
    return F.array_distinct(F.regexp_extract_all(
        text, F.lit(f"(?s)(?=(.{{{size if least is None else least},{size}}}))"), F.lit(1)))


def _runs(longest: Column, sizes: Sequence[int]) -> Column:
    """The different runs of each of ``sizes`` characters, from the longest at each place."""
    return F.concat(*[F.array_distinct(F.transform(
        F.filter(longest, lambda r: F.length(r) >= n), lambda r: F.left(r, F.lit(n)))) for n in sizes])


def find_terms(texts: DataFrame, terms: DataFrame, keys: Sequence[str], text: str = "text",
               term: str = "term", gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``texts`` without its text, a row for each term that occurs in it as a substring, ignoring case.

    ``terms`` is a table of any length; its terms are lower-cased and count once. NULL and empty terms
    occur nowhere. ``keys`` tell texts apart; rows with equal keys are looked at each for itself.

    A term is looked up by that ``gram``-character run of it that is rarest among the terms, so stock
    beginnings do not gather them; a shorter term is looked up whole. Where more than ``hot`` terms
    still share their run, it takes in the next character. Texts are dealt to buckets by key, and the different runs
    of a bucket, of which those that no term is looked up by are sorted out on the spot by their hashes, meet the
    terms in an equi-join of keys and runs. What they meet moves to the bucket and is held in a hash table by run;
    the texts stream past it, each cut into its runs, and are verified at once. So what moves is the texts and the
    terms of each bucket; a text and the terms in it, whose number grows with both tables, are never rows
    between tasks. A bucket's terms must fit the memory of a task. Nothing is dropped.
    """
    low = F.lower(F.col(term))
    known = write_out(terms.select(low.alias("term")).where(F.col("term") != "").distinct(), "terms")
    long = known.where(F.length("term") >= gram)
    runs = long.select("term", F.explode(_grams(F.col("term"), gram)).alias("run"))
    often = runs.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    rarest = write_out(runs.join(often, "run").groupBy("term").agg(
        F.min(F.struct("n", "run")).alias("best")).select("term", "best.run"), "rarest")
    crowded = rarest.groupBy("run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(
        "run", F.lit(True).alias("crowded"))
    place = F.instr(F.col("term"), F.col("run"))
    behind = F.substring("term", place + gram, F.lit(1))
    keyed = write_out(
        rarest.join(crowded, "run", "left").select("term", F.when(
            F.col("crowded") & (behind != ""), F.concat("run", behind)).when(
            F.col("crowded") & (place > 1), F.concat(F.substring("term", place - 1, F.lit(1)), "run"))
            .otherwise(F.col("run")).alias("run"))
        .unionByName(known.where(F.length("term") < gram).select("term", F.col("term").alias("run"))), "keyed")

    others = [c for c in texts.columns if c != text]
    sizes = sorted(r.n for r in keyed.select(F.length("run").alias("n")).distinct().collect())
    if not sizes:
        return texts.select(*others, F.lit("").alias("term")).limit(0)
    hashes = keyed.select(F.xxhash64("run").alias("_h")).distinct()
    few = hashes.count() <= MOST_BROADCAST

    def cut(rows: DataFrame) -> DataFrame:
        longest = rows.withColumn("_longest", _grams(F.col("_low"), sizes[-1], sizes[0]))
        every = longest.withColumn("_run", F.explode(_runs(F.col("_longest"), sizes))).drop("_longest")
        return every.withColumn("_h", F.xxhash64("_run")).join(
            F.broadcast(hashes), "_h", "left_semi").drop("_h") if few else every

    # Lower-cased once a text, not once for each term it meets. Dealt, as few tasks may read them.
    # As many tasks as are asked for, however small the texts are: a byte of them is much work.
    tasks = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lowered = texts.select(*others, F.pmod(F.xxhash64(*keys), F.lit(BUCKETS * tasks)).alias("_bucket"),
                           F.lower(F.col(text)).alias("_low")).repartition(tasks, "_bucket")
    asked = cut(lowered.select("_bucket", "_low")).select("_bucket", "_run").distinct()
    met = write_out(asked.join(keyed.withColumnRenamed("run", "_run"), "_run").select("_bucket", "_run", "term"), "met")
    # Both sides are dealt by bucket, so the join moves neither again; the texts are not sorted or stored.
    # The setting stays until the next query is configured, as the rows are only asked for later.
    texts.sparkSession.conf.set(*DEALT_BY_ONE_KEY)
    return cut(lowered).join(met.repartition(tasks, "_bucket").hint("shuffle_hash"), ["_bucket", "_run"]).where(
        (F.col("term") == F.col("_run")) | F.col("_low").contains(F.col("term"))).select(*others, "term")
