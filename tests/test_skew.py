"""The same queries where two issuers hold a third of all orders each way they list them."""

import glob
import os
import shutil

import duckdb
import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    for path in glob.glob(f"{SF}/*.parquet"):
        if os.path.basename(path) != "orders.parquet":
            shutil.copy(path, folder)
    # Issuer 3 lists containers with documents, issuer 5 table rows.
    duckdb.sql(f"""COPY (
        SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 1 THEN 3 + 2 * (o_orderkey % 2)
            ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
        FROM '{SF}/orders.parquet') TO '{folder}/orders.parquet' (FORMAT parquet)""")
    return str(folder)


@pytest.mark.parametrize("name", [
    "table_rows", "page_blocks", "opportunities", "document_opportunities", "containment_dedup",
    "dedup_titles", "document_links_topn", "fallback_cascade", "numbered_listing", "report_summary"])
def test_skewed(spark, skewed, name):
    got = entry.queries()[name](spark, skewed)
    assert compare(got, connect(skewed), entry.oracle_sql()[name]) is None


def test_a_sieve_keeps_all_that_is_asked_for(spark, monkeypatch):
    from pyspark.sql import functions as F
    from noticeloom.plans import opportunities as O
    docs = spark.range(20_000).select(F.concat(F.lit("https://x/"), "id").alias("url"), F.col("id").alias("n"))
    wanted = docs.where("n % 50 = 0").select("url").unionByName(spark.sql("select cast(null as string) as url"))
    for words in (1 << 20, 64):
        monkeypatch.setattr(O, "SIEVE", words)
        got = {r.n for r in O.sieve(docs, wanted).collect()}
        assert got >= set(range(0, 20_000, 50)) and len(got) < (402 if words > 64 else 4_000)
    assert O.sieve(docs, wanted.limit(0)).count() == 0
