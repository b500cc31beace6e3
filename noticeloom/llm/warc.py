"""WARC archives: write captures as records, read them back and assemble transactions."""

from __future__ import annotations

import hashlib
import re
from base64 import b32encode
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm.rows import with_numbers
from noticeloom.session import write_out

END = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"

RECORD = ("record_id string, record_type string, concurrent_to array<string>, refers_to string, "
          "target_uri string, payload_digest string, digest_ok boolean, http_header string, "
          "payload_bytes long, payload string, fields map<string,string>")


def sha1_base32(text: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string in UTF-8: 40 bits at a time."""
    digest = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(kind: str, key: Column) -> Column:
    h = F.md5(F.concat(F.lit(kind + ":"), key.cast("string")))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.concat(F.lit(f"{name}: "), value) for name, value in headers]
    # A header without a value (a null address) is left out.
    return F.concat(
        F.lit("WARC/1.1\r\n"), F.array_join(F.array_compact(F.array(*lines)), "\r\n"),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit(END), block)


def roles(pages: DataFrame, id_col: str, url: str, body: str, min_bytes: int) -> DataFrame:
    """``rid, id, url, payload, digest, size`` and ``first`` (rid of the response it revisits).

    Rows of a payload are counted by its digests and length, merged within each task first. Only
    payloads with several rows are joined back, from a written table, so Spark broadcasts it where
    it is small and else splits a hot payload's rows.
    """
    numbered, number = with_numbers(pages, None)
    rows = numbered.select(F.col(number).alias("rid"), F.col(id_col).alias("id"), F.col(url).alias("url"),
                           F.coalesce(F.col(body), F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": sha1_base32(F.col("payload")),
                    "size": F.octet_length("payload").cast("long"),
                    "check": F.xxhash64("payload")})
    same = ["digest", "size", "check"]
    order = F.struct(F.col("id").isNotNull().alias("known"), "id", "rid")
    latest = write_out(rows.filter(F.col("size") >= min_bytes).groupBy(*same)
                       .agg(F.max(order).alias("last"), F.count("*").alias("n"))
                       .filter("n > 1").drop("n"), "payloads")
    return rows.join(latest, same, "left").withColumn(
        "first", F.when(F.col("last.rid") != F.col("rid"), F.col("last.rid")))


def to_records(pages: DataFrame, id_col: str = "page_id", url: str = "url", body: str = "html",
               min_bytes: int = 0) -> DataFrame:
    """``value``: three WARC records for each page: response or revisit, request and metadata.

    Of pages with equal payloads of at least ``min_bytes`` bytes the one with the largest
    id is the response (a null id is the smallest, of equal ids the last row) and the
    others are revisits that refer to it. A null body is an empty payload, a null
    address is left out. Request and metadata name their capture in WARC-Concurrent-To.
    """
    rows = roles(pages, id_col, url, body, min_bytes)
    own = _uuid("capture", F.col("rid"))
    uri = F.regexp_replace("url", "[\\r\\n]+", "%0D%0A")
    revisit = F.col("first").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("size").cast("string"), F.lit(END))
    capture = _record([
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", own), ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        ("WARC-Refers-To", _uuid("capture", F.col("first"))),
        ("WARC-Profile", F.when(revisit, F.lit(
            "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
    ], F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))))
    request = _record([
        ("WARC-Type", F.lit("request")), ("WARC-Record-ID", _uuid("request", F.col("rid"))),
        ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", own),
        ("Content-Type", F.lit("application/http;msgtype=request")),
    ], F.concat(F.lit("GET "), F.coalesce(F.replace(uri, F.lit(" "), F.lit("%20")), F.lit("/")),
                F.lit(" HTTP/1.1\r\nAccept: text/html"), F.lit(END)))
    metadata = _record([
        ("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _uuid("metadata", F.col("rid"))),
        ("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", own),
        ("Content-Type", F.lit("application/warc-fields")),
    ], F.concat(F.lit("row: "), F.col("rid").cast("string"), F.coalesce(
        F.concat(F.lit("\r\nid: "), F.col("id").cast("string")), F.lit("")), F.lit("\r\n")))
    return rows.select(F.explode(F.array(capture, request, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, **columns) -> None:
    """Gzipped archives in the folder ``path``, written by Spark's text writer.

    The separator of lines is the one that ends a record, so the files are
    plain WARC files, and a task that runs again leaves no half-written archive.
    """
    (to_records(pages, **columns).write.option("lineSep", END).option("compression", "gzip")
     .text(path))


def _fields(lines: list[str]) -> dict[str, str]:
    """Headers by lower-case name; the values of a repeated one are joined by a line feed."""
    out: dict[str, str] = {}
    for name, _, value in (x.partition(":") for x in lines):
        name, value = name.strip().lower(), value.strip()
        out[name] = f"{out[name]}\n{value}" if name in out else value
    return out


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record; one record is held at a time.

    Pieces between separators arrive in order. A block may hold separators itself,
    so its pieces are gathered until its Content-Length is reached.
    """
    headers, want, parts, have = None, 0, [], 0
    for batch in batches:
        for piece in batch.column(0).to_pylist():
            data = (piece or "").encode() + b"\r\n\r\n"
            while data:
                if headers is None:
                    # Ends of line between records, also those a block's end left over.
                    data = data.lstrip(b"\r\n")
                    if not data:
                        break
                    head, _, data = data.partition(b"\r\n\r\n")
                    lines = head.decode().split("\r\n")
                    if not lines[0].startswith("WARC/"):
                        raise ValueError(f"no WARC record: {lines[0][:80]!r}")
                    headers = _fields(lines[1:])
                    want, parts, have = int(headers["content-length"].split("\n")[0]), [], 0
                take = data[: want - have]
                parts.append(take)
                have += len(take)
                data = data[len(take):]
                if have < want:
                    break
                yield headers, b"".join(parts)
                headers = None
    if headers is not None:
        raise ValueError("an archive ends inside a record")


def _reader(types: frozenset, schema: pa.Schema, bodies: bool):
    def read(batches):
        rows, size = [], 0
        for headers, block in _stream(batches):
            kind = headers.get("warc-type")
            if kind not in types:
                continue
            head, body, fields, ok, length = None, None, {}, None, None
            digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
            if kind in ("response", "revisit"):
                head, _, payload = block.partition(b"\r\n\r\n")
                length = _fields(head.decode().split("\r\n")[1:]).get("content-length")
                length = int(length.split("\n")[0]) if length else len(payload)
                if kind == "response":
                    length, body = len(payload), payload.decode(errors="replace") if bodies else None
                    ok = b32encode(hashlib.sha1(payload).digest()).decode() == digest
                head = head.decode(errors="replace")
            elif kind == "request":
                head = block.decode(errors="replace")
            else:
                fields = _fields([x for x in re.split("[\r\n]+", block.decode(errors="replace")) if x])
            beside = headers.get("warc-concurrent-to")
            rows.append((headers.get("warc-record-id"), kind, beside.split("\n") if beside else [],
                         headers.get("warc-refers-to"), headers.get("warc-target-uri"), digest, ok,
                         head, length, body, list(fields.items())))
            size += len(block)
            if len(rows) >= 1000 or size > 8 << 20:
                yield _batch(rows, schema)
                rows, size = [], 0
        if rows:
            yield _batch(rows, schema)
    return read


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)],
        schema=schema)


_ARROW = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.list_(pa.string())),
    *((n, pa.string()) for n in ("refers_to", "target_uri", "payload_digest")),
    ("digest_ok", pa.bool_()), ("http_header", pa.string()), ("payload_bytes", pa.int64()),
    ("payload", pa.string()), ("fields", pa.map_(pa.string(), pa.string()))])


def read_records(spark: SparkSession, path: str, types: tuple[str, ...], bodies: bool = True) -> DataFrame:
    """The records of ``types`` in the archives below ``path``, without payloads unless ``bodies``."""
    pieces = spark.read.option("lineSep", END).text(path).select("value")
    return pieces.mapInArrow(_reader(frozenset(types), _ARROW, bodies), RECORD)


def beside_captures(spark: SparkSession, path: str) -> DataFrame:
    """Every request and metadata record of every capture: ``capture_id``, ``kind``, ``position`` (1, 2,
    ... by record id), ``record_id``, ``target_uri``, ``http_header``, ``fields``.

    A record belongs to each capture that one of its WARC-Concurrent-To headers names or that names
    it in one of its own, once. Records that no link ties to a capture are left out.
    """
    side = write_out(read_records(spark, path, ("request", "metadata")).select(
        "record_id", F.col("record_type").alias("kind"), "concurrent_to", "target_uri", "http_header",
        "fields"), "beside")
    captures = read_records(spark, path, ("response", "revisit"), bodies=False)
    named = write_out(captures.select(
        F.col("record_id").alias("capture_id"), F.explode("concurrent_to").alias("record_id")), "named")
    own = side.select("*", F.explode("concurrent_to").alias("capture_id"))
    if not named.isEmpty():
        # A record that both sides name is one.
        own = own.unionByName(side.join(named, "record_id")).dropDuplicates(
            ["capture_id", "kind", "record_id"])
    else:
        own = own.withColumn("concurrent_to", F.array_distinct("concurrent_to"))
    by_id = Window.partitionBy("capture_id", "kind").orderBy("record_id")
    return own.drop("concurrent_to").withColumn("position", F.row_number().over(by_id))


def transactions(spark: SparkSession, path: str, beside: DataFrame | None = None) -> DataFrame:
    """One nested row for each capture: ``capture_id``, ``response``, ``request``, ``metadata``.

    Of several requests or metadata records the first by record id is in the row, and ``n_requests`` and
    ``n_metadata`` tell how many there are; ``beside_captures``, which may be given, has all of them as rows of their
    own, so no capture gathers an unbounded list. A capture without a request or metadata has null there.
    """
    capture = (read_records(spark, path, ("response", "revisit")).drop("fields", "concurrent_to")
               .withColumnRenamed("record_id", "capture_id"))
    rows = beside_captures(spark, path) if beside is None else beside
    first = F.col("position") == 1

    def of(kind: str, last: str):
        return F.max(F.when(first & (F.col("kind") == kind), F.struct("record_id", "target_uri", last)))

    found = rows.withColumn("fields", F.map_entries("fields")).groupBy("capture_id").agg(
        of("request", "http_header").alias("request"), of("metadata", "fields").alias("metadata"),
        F.count_if(F.col("kind") == "request").alias("n_requests"),
        F.count_if(F.col("kind") == "metadata").alias("n_metadata"))
    found = found.withColumn("metadata", F.when(F.col("metadata").isNotNull(), F.struct(
        "metadata.record_id", "metadata.target_uri",
        F.map_from_entries("metadata.fields").alias("fields"))))
    inner = [c for c in capture.columns if c != "capture_id"]
    return (capture.select("capture_id", F.struct(*inner).alias("response"))
            .join(found, "capture_id", "left").fillna(0, ["n_requests", "n_metadata"]))


def page_captures(captures: DataFrame, id_type: str = "long") -> DataFrame:
    """One row per capture: page id, payload size and digest, kind, and the page it revisits."""
    facts = captures.select(
        "capture_id", F.element_at("metadata.fields", "id").cast(id_type).alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("response.refers_to").alias("refers_to_id"))
    facts = write_out(facts, "captures")
    target = facts.filter("record_type = 'response'").select(
        F.col("capture_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"))
    return facts.join(target, "refers_to_id", "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
