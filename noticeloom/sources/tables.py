"""Collected pages and decoded documents as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table; only the columns a query uses are read."""
    return spark.read.parquet(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Collected pages ``(page_id, url, html)``; a failed fetch is a NULL ``html`` and is left out."""
    return read_table(spark, path).where(F.col("html").isNotNull())


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents with their text decoded; a failed one is a NULL ``text`` and is left out."""
    return read_table(spark, path).where(F.col("text").isNotNull())
