"""Placement of rows on shards by a lookup table that the shards fill in turns."""

from __future__ import annotations

import hashlib
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots of the table: a prime, about a hundred times the number of shards or more.
SLOTS = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n ** 0.5) + 1))


@lru_cache(maxsize=8)
def lookup_table(shards: tuple[str, ...], slots: int = SLOTS) -> tuple[int, ...]:
    """For each slot the index of its shard.

    A shard prefers the slots in the order offset, offset + skip, offset + 2 skip, ...
    modulo the prime, both numbers drawn from its name, so each order is a permutation
    of all slots. The shards take turns, each claiming the first free slot in its
    order, until no slot is free. Loads differ by one slot at most, and when a shard
    goes most slots stay where they are. The order of ``shards`` has no effect
    on which shard gets a slot: turns go by name.
    """
    if not _is_prime(slots):
        raise ValueError(f"{slots} is not a prime")
    if not 0 < len(set(shards)) == len(shards) <= slots:
        raise ValueError("shards need names of their own, and no more of them than slots")
    turns = sorted(range(len(shards)), key=lambda i: shards[i])
    at, skip = {}, {}
    for i in turns:
        digest = hashlib.md5(shards[i].encode()).digest()
        at[i] = int.from_bytes(digest[:8], "big") % slots
        skip[i] = int.from_bytes(digest[8:], "big") % (slots - 1) + 1 if slots > 2 else 1
    table, left = [-1] * slots, slots
    while True:
        for i in turns:
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % slots
            table[at[i]] = i
            left -= 1
            if not left:
                return tuple(table)


def place(df: DataFrame, keys: list[str], shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (name), by a hash of ``keys``.

    Placement is one lookup in a broadcast table of ``slots`` rows: its size is the
    parameter's and does not grow with ``df``, and no row of ``df`` moves. Equal keys go
    to one shard; null is a key like any other. ``slot`` and ``shard`` of ``df`` itself,
    if any, are replaced.
    """
    spark, table = df.sparkSession, lookup_table(tuple(shards), slots)
    lookup = spark.createDataFrame(
        [(slot, shards[i]) for slot, i in enumerate(table)], "slot int, shard string")
    placed = df.drop("slot", "shard").withColumn(
        "slot", F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(slots)).cast("int"))
    return placed.join(F.broadcast(lookup), "slot").select(*placed.columns, "shard")


def write_shards(df: DataFrame, keys: list[str], shards: list[str], path: str,
                 slots: int = SLOTS, files: int = 8) -> None:
    """Write one folder per shard, each of about ``files`` files.

    A shard's rows are dealt to several tasks by row hash, so a shard that holds a hot
    key is still written by many tasks.
    """
    placed = place(df, keys, shards, slots)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(files))
    (placed.repartition(len(shards) * files, "shard", salt)
     .write.partitionBy("shard").parquet(path))
