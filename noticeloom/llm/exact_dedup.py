"""Exact copies by deterministic block naming, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.rows import with_numbers
from noticeloom.session import write_out

#: Characters that do not count when texts are compared, as a regular expression.
SPACE = "[\\x20\\x09-\\x0D]+"
BLOCK_CHARS = 2048


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")


def _cut(block_chars: int) -> Column:
    """The blocks of ``norm``; an empty text is one empty block."""
    cut = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    return F.when(F.col("norm") == "", F.array(F.lit(""))).otherwise(cut)


def _named(items: DataFrame, keys: list[str], hashes: DataFrame) -> DataFrame:
    """Replace ``keys`` by ``name``: the number of the first item that holds these keys.

    The numbers of items are taken once, in the shuffle that finds the first of each, and no other
    scan refers to them. The grouping compares the keys themselves, so equal names mean equal keys.

    ``hashes`` has ``h``, the hash of the keys, for each item. Keys that more than an even share of
    all items hold (by hash, so there are at most as many as partitions) are dealt to all
    partitions by row: each partition finds its own first item, and the few finds of a hot key
    are joined to one name.
    """
    spark = items.sparkSession
    slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = hashes.groupBy("h").count()
    share = F.greatest(F.floor(F.sum("count") / slots), F.lit(1000))
    least = counts.agg(share.alias("least")).first()[0] or 0
    hot = counts.filter(F.col("count") > least).select("h", F.lit(1).alias("hot")).collect()
    own, dealt = keys, items
    if hot:
        own = [*keys, "deal"]
        lookup = spark.createDataFrame(hot, "h long, hot int")
        dealt = items.withColumn("h", F.xxhash64(*keys)).join(
            F.broadcast(lookup), "h", "left").withColumn(
            "deal", F.when(F.col("hot") == 1, F.pmod(F.xxhash64("rid"), F.lit(slots))).otherwise(-1)
        ).drop("h", "hot")
    names = (dealt.select(*own, F.monotonically_increasing_id().alias("at"))
             .groupBy(*own).agg(F.min("at").alias("name")))
    if hot:
        joint = names.filter("deal >= 0").groupBy(*keys).agg(F.min("name").alias("joint"))
        names = names.join(F.broadcast(joint), keys, "left").select(
            *own, F.coalesce("joint", "name").alias("name"))
    return dealt.join(names, own).drop(*own)


def text_identities(rows: DataFrame, hashes: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``rid`` with ``level`` and ``name``: equal for two rows exactly if their ``norm`` is equal.

    Level 0 names fixed-size blocks; each further level names adjacent pairs of names
    (an odd last one is paired with -1), until one name is left. Texts with equal
    numbers of blocks meet at the same level. ``hashes`` has the hash of every block. Each level
    is a table in the shared folder, so levels do not pile up in the lineage.
    """
    blocks = (rows.select("rid", _cut(block_chars).alias("cut"))
              .select("rid", F.size("cut").alias("m"), F.posexplode("cut").alias("pos", "block")))
    named = write_out(_named(blocks, ["block"], hashes), "names")
    done = named.filter("m = 1").select("rid", F.lit(0).alias("level"), "name")
    longest = named.agg(F.max("m")).first()[0] or 1
    level = 0
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        pairs = (named.filter("m > 1")
                 .groupBy("rid", "m", (F.col("pos") / 2).cast("int").alias("pos"))
                 .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left"),
                      F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))),
                                 F.lit(-1)).alias("right"))
                 .withColumn("m", ((F.col("m") + 1) / 2).cast("int")))
        pairs = write_out(pairs, "pairs")
        named = write_out(_named(pairs, ["left", "right"], pairs.select(
            F.xxhash64("left", "right").alias("h"))), "names")
        done = done.unionByName(
            named.filter("m = 1").select("rid", F.lit(level).alias("level"), "name"))
    return done


def exact_dedup(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                block_chars: int = BLOCK_CHARS, rid: str | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256`` (of the text without white space) and ``rid``, the number of the row.

    ``rid`` names a column of row numbers, if ``docs`` has one. Of equal
    texts the one with the most code points in the original stays, then the smallest
    id; a null id comes last, and among rows that are still equal the first one stays.
    A null text is empty; empty texts are copies of each other.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    numbered, number = with_numbers(docs, rid)
    rows = numbered.select(F.col(number).alias("rid"), F.col(id_col).alias("id"),
                       F.char_length(raw).alias("n"), normalised(F.col(text)).alias("norm"))
    facts = write_out(rows.select(
        "rid", "id", "n", F.sha2("norm", 256).alias("text_sha256"),
        F.transform(_cut(block_chars), lambda b: F.xxhash64(b)).alias("hashes")), "facts")
    members = text_identities(rows, facts.select(F.explode("hashes").alias("h")), block_chars).join(
        facts.drop("hashes"), "rid")
    best = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("none"), "id", "rid")
    # Written, so that both sides of the join are plain exchanges, of which Spark splits a hot one.
    members = write_out(members, "members")
    groups = write_out(members.groupBy("level", "name")
                       .agg(F.min(best).alias("best"), F.count("*").alias("group_size")), "groups")
    return members.join(groups, ["level", "name"]).select(
        F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"), "text_sha256", "rid")


def drop_exact_copies(docs: DataFrame, text: str = "text", id_col: str = "doc_id",
                      block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows, rid = with_numbers(docs, None)
    kept = exact_dedup(rows, text, id_col, block_chars, rid).filter("kept").select(
        F.col("rid").alias(rid))
    return rows.join(kept, rid, "left_semi").drop(rid)
