"""The list of issuers and where they publish."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from noticeloom.schemas import REGISTRY_FILE


def from_envelope(files: DataFrame, value: str = "value") -> DataFrame:
    """Registry rows out of JSON texts of the form ``{"utilities": [...]}``; missing keys are NULL."""
    return files.select(
        *[c for c in files.columns if c != value],
        F.inline(F.from_json(value, REGISTRY_FILE)["utilities"]))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry file, one JSON object, with ``entry`` as the place of a row in it."""
    return (
        spark.read.schema(REGISTRY_FILE).json(path, multiLine=True)
        .select(F.posexplode("utilities").alias("pos", "u"))
        .select(F.col("pos").cast("bigint").alias("entry"), "u.*")
    )


def is_on(active: Column) -> Column:
    """A missing flag means inactive."""
    return F.coalesce(active, F.lit(False))


def usable(registry: DataFrame, active_only: bool = True) -> DataFrame:
    """Entries to work on: active (unless told otherwise) and with a page address."""
    rows = registry.where(F.col("rfp_url") != "")
    return rows.where(is_on(F.col("active"))) if active_only else rows


def by_id(registry: DataFrame, utility_id: str) -> DataFrame:
    """The first entry with this id; empty when there is none."""
    return registry.where(F.col("id") == utility_id).orderBy("entry").limit(1)


def rollup(registry: DataFrame) -> DataFrame:
    """Entries per type, and per country and region with totals (region reads ``area, country``)."""
    country = F.element_at(F.split("region", ", "), -1)
    by_type = registry.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("type").alias("level"), F.col("type").alias("name"), "n")
    places = (
        registry.select(country.alias("country"), "region")
        .rollup("country", "region")
        .agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
        .select(
            F.when(F.col("g") == 0, "region").when(F.col("g") == 1, "country").otherwise("all")
            .alias("level"),
            F.coalesce("region", "country", F.lit("all")).alias("name"), "n")
    )
    return by_type.unionByName(places)
