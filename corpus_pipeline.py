"""Corpus preparation: the stages from raw documents to text that a tokenizer carries over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.bpe import encode
from noticeloom.llm.decontamination import drop_contaminated
from noticeloom.llm.exact_dedup import drop_exact_copies
from noticeloom.llm.language_id import keep_identified
from noticeloom.llm.near_dedup import drop_near_copies
from noticeloom.llm.queries import TOKENIZER
from noticeloom.session import write_out


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that could be told."""
    return keep_identified(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the longest original, then the smallest id."""
    return drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id."""
    return drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, and the text decoded from them."""
    return encode(docs, TOKENIZER).select(
        "doc_id", "n_tokens", "ids", F.col("decoded").alias("text"))


#: In order; each works on all that the one before it kept.
STAGES = [
    ("language id", language),
    ("exact dedup", exact_copies),
    ("near dedup", near_copies),
    ("decontamination", benchmark),
    ("tokens", tokens),
]

#: SQL can neither fit the language model nor merge byte pairs; tests use brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_out(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
