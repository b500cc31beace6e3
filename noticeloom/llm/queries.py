"""The registered query of each operator, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeloom.llm.bpe import encode
from noticeloom.llm.decontamination import contamination_digest, find_contamination
from noticeloom.llm.exact_dedup import exact_dedup
from noticeloom.llm.importance import importance_scores
from noticeloom.llm.language_id import identify_languages
from noticeloom.llm.near_dedup import near_copies
from noticeloom.llm.pii import find_personal_data, personal_data_digest
from noticeloom.llm.secrets import find_secrets, secrets_digest
from noticeloom.llm.sharding import place, write_shards
from noticeloom.llm.substring_dedup import substring_dedup
from noticeloom.llm.suffix_dedup import suffix_dedup
from noticeloom.llm.vector_codes import compress_vectors, vector_codes_digest
from noticeloom.llm.warc import page_captures, transactions, write_archives
from noticeloom.session import scratch_dir

#: The vocabulary that the encoding query uses.
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Shards of the placement query.
SHARDS = [f"shard-{i:03d}" for i in range(256)]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents")).drop("rid")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(_table(spark, sf_dir, "documents")).drop("rid", "root")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data_digest(find_personal_data(_table(spark, sf_dir, "documents")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).drop("rid")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode(_table(spark, sf_dir, "documents"), TOKENIZER, digest=True)
    return coded.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_digest(find_contamination(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup(_table(spark, sf_dir, "documents"), digest=True)
    return cut.withColumnRenamed("kept", "kept_sha256")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return page_captures(transactions(spark, path))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_dir(spark)}/shards-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    write_shards(docs, ["doc_id"], SHARDS, path, files=2)
    # With the schema, as a table without rows has no files.
    schema = place(docs, ["doc_id"], SHARDS).schema
    return spark.read.schema(schema).parquet(path).select(
        "doc_id", "slot", "shard", F.sha2("text", 256).alias("text_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes_digest(*compress_vectors(_table(spark, sf_dir, "embeddings")))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = importance_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return scored.select("doc_id", "n_features", "weight", "score", "rank")


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_digest(find_secrets(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_near_dedup": op2_near_dedup,
    "op3_pii": op3_pii,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_bpe": op5_bpe,
    "op6_decontamination": op6_decontamination,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_warc": op9_warc,
    "op10_sharding": op10_sharding,
    "op11_vector_codes": op11_vector_codes,
    "op12_importance": op12_importance,
    "op13_secrets": op13_secrets,
}

# Part distances to all entries, and the entries moved to the means of their parts.
_NEAREST = """SELECT vec_id, label, p, w, arg_min(k, d * 64 + k) AS k, min(d) AS d FROM (
            SELECT s.*, b.k, CAST(list_sum(list_transform(list_zip(w, e),
                lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
            FROM parts s JOIN {0} b ON s.p = b.p) GROUP BY vec_id, label, p, w"""
_MOVED = """SELECT b.p, b.k, coalesce(m.e, b.e) AS e FROM {0} b LEFT JOIN (
            SELECT p, k, list(x ORDER BY j) AS e FROM (
                SELECT p, k, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (
                    SELECT p, k, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM {1}) GROUP BY p, k, j)
            GROUP BY p, k) m ON m.p = b.p AND m.k = b.k"""

ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": f"""
        WITH kept AS (
            SELECT vec_id, label, list_transform(embedding,
                lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts AS MATERIALIZED (
            SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS w
            FROM (SELECT *, unnest(range(16)) AS p FROM kept)),
        b0 AS MATERIALIZED (
            SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, w AS e
            FROM parts QUALIFY k < 64),
        a0 AS MATERIALIZED ({_NEAREST.format("b0")}), b1 AS MATERIALIZED ({_MOVED.format("b0", "a0")}),
        a1 AS MATERIALIZED ({_NEAREST.format("b1")}), b2 AS MATERIALIZED ({_MOVED.format("b1", "a1")}),
        a2 AS MATERIALIZED ({_NEAREST.format("b2")}),
        coded AS (
            SELECT vec_id, label, string_agg(printf('%02x', k), '' ORDER BY p) AS code,
                   CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, k, j)) FROM (
                SELECT p, k, unnest(e) AS x, generate_subscripts(e, 1) AS j FROM b2)) AS codebooks_sha256
        FROM coded""",
    "op4_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents),
        w AS (
            SELECT doc_id, norm,
                   first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
                   count(*) OVER (PARTITION BY norm) AS group_size
            FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM w""",
}
