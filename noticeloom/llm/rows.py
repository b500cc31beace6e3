"""Row numbers that stay the same however a table's files are split among the cores of the moment."""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.session import write_out

#: Files whose numbers are broadcast, at 16 bytes each; a table of more is written once instead.
MOST_FILES = 4_000_000
#: Bits for the place of a row in its file.
PLACE = 40

#: Readers do not agree on how many slashes follow the scheme of an address.
_SCHEME = "^[A-Za-z][A-Za-z0-9+.-]*:/+"

_SAME_ROWS = ("Project", "Filter", "SubqueryAlias")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_numbers(docs: DataFrame, rid: str | None) -> tuple[DataFrame, str]:
    """``docs`` and the name of its column of row numbers: ``rid``, or else a new one."""
    if rid is not None:
        return docs, rid
    name = free_name(docs, "rid")
    return number_rows(docs, name), name


def _files(df: DataFrame) -> list[str] | None:
    """The files of ``df`` if its rows are rows of Parquet files, each at most once."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in _SAME_ROWS:
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or "parquet" not in plan.toString().split("\n")[0]:
        return None
    return sorted(set(df.inputFiles()))


def number_rows(docs: DataFrame, name: str = "rid") -> DataFrame:
    """``docs`` with one more column: a number from 0 up, different for every row.

    The rows of Parquet files get the number of their file and their place in it, which Parquet
    itself gives, so that every scan finds the same numbers, whatever cores there are when it
    is planned. What is not a plain table of files is numbered once and written.
    Numbers rise with the file names, and within a file with the place.
    """
    spark = docs.sparkSession
    files = _files(docs)
    hashes = {}
    if files is not None and len(files) <= MOST_FILES:
        hashes = {xxhash.xxh64_intdigest(re.sub(_SCHEME, "", f).encode(), 42): i for i, f in enumerate(files)}
    if files is None or len(hashes) != len(files):
        return write_out(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    signed = [(h - (1 << 64) if h >> 63 else h, i) for h, i in hashes.items()]
    file_hash, file_no = free_name(docs, "_file"), free_name(docs, "_no")
    place = free_name(docs, "_place")
    lookup = spark.createDataFrame(signed, f"{file_hash} long, {file_no} long")
    rows = docs.select("*", F.xxhash64(F.regexp_replace(
        "_metadata.file_path", _SCHEME, "")).alias(file_hash),
                       F.col("_metadata.row_index").alias(place))
    missing = F.raise_error(F.lit("a file of the table was not there when its rows were numbered"))
    number = F.shiftleft(F.col(file_no), PLACE).bitwiseOR(F.col(place))
    return rows.join(F.broadcast(lookup), file_hash, "left").select(
        *(F.col(f"`{c}`") for c in docs.columns),
        F.when(F.col(file_no).isNull(), missing.cast("long")).otherwise(number).alias(name))
