"""From page parts and documents to records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from noticeloom.functions import text as X, vocab as V
from noticeloom.functions.urls import resolve_url
from noticeloom.schemas import as_records

# Order of the sources within one registry entry: documents, then blocks, then fallback parts.
_RANK = {"document": 0, "block": 1, "fallback": 2}


def _seq(source: str, position: Column) -> Column:
    return F.lit(_RANK[source] << 32) + position.cast("bigint")


def _cut(text: Column, chars: int | None) -> Column:
    return text if chars is None else F.left(text, F.lit(chars))


def with_block_facts(parts: DataFrame, is_block: Column, words: V.Words = V.DEFAULT_WORDS) -> DataFrame:
    """Facts of each block: description, id, dates, contact, status.

    Blocks without a title go, and so does the full text of the others; rows that
    are no blocks pass with NULL facts.
    """
    text = F.when(is_block, F.col("text"))
    return (
        parts.where(~is_block | (F.col("title") != ""))
        .withColumn("block_text", text)
        .withColumn("dates", F.when(is_block, X.dates_with_context(
            F.col("block_text"), words.date_label, words.strict_dates)))
        .withColumn("description", _cut(F.col("block_text"), words.description_chars))
        .withColumn("rfp_id", X.notice_id(F.col("block_text"), words.id_prefix))
        .withColumn("contact", F.when(is_block, X.contact(F.col("block_text"))))
        .withColumn("is_active", F.when(
            is_block, X.is_active(F.col("block_text"), F.col("dates"), words.closed, words.open,
                                  words.whole_words)))
        .withColumn("text", F.when(~is_block, F.col("text")))
        .drop("block_text")
    )


def block_records(facts: DataFrame) -> DataFrame:
    """Block facts as records; the first link is the address, else the page itself."""
    page = F.col("url")
    links = F.transform(
        "links",
        lambda a: F.struct(a["text"].alias("text"), resolve_url(page, a["href"]).alias("url")))
    return as_records(
        facts.withColumn("additional_links", links)
        .withColumn("seq", _seq("block", F.col("seq")))
        .withColumn("source_page", page)
        .withColumn("url", F.coalesce(F.get("additional_links", 0)["url"], page))
    )


def with_document_facts(documents: DataFrame) -> DataFrame:
    """Length, word count, dates and id of document texts."""
    t = F.col("text")
    return documents.select(
        "*",
        F.length(t).cast("bigint").alias("text_length"),
        X.word_count(t).cast("bigint").alias("word_count"),
        X.document_dates(t).alias("dates"),
        X.document_id(t).alias("rfp_id"),
    )


def compact_documents(documents: DataFrame, words: V.Words = V.DEFAULT_WORDS,
                      keep: Sequence[str] = ()) -> DataFrame:
    """What a record keeps of a document: a few hundred characters instead of the text, and
    the columns ``keep``."""
    t = F.col("text")
    return documents.where(t.isNotNull()).select(
        F.col("url").alias("document_url"),
        "metadata",
        _cut(t, words.document_description_chars).alias("description"),
        _cut(X.first_line(t), words.document_title_chars).alias("opening"),
        X.document_dates(t, words.document_dates).alias("dates"),
        X.document_id(t, words.document_id_chars, words.document_id_prefix).alias("rfp_id"),
        *keep,
    )


def document_records(linked: DataFrame, strict: bool = False,
                     words: V.Words = V.DEFAULT_WORDS) -> DataFrame:
    """Linked documents as records.

    ``strict`` is the documents-only variant: its title is the metadata title or
    the link text, and contact and status stay empty.
    """
    meta_title = F.try_element_at("metadata", F.lit("title"))
    rows = linked.select(
        "entry",
        _seq("document", F.col("link_no")).alias("seq"),
        (F.coalesce(F.when(meta_title != "", meta_title), F.col("link_text")) if strict
         else X.document_title(meta_title, F.col("link_text"), F.col("opening"),
                               words.document_title_chars)).alias("title"),
        "description",
        "rfp_id",
        F.col("document_url").alias("url"),
        X.bare_dates(F.col("dates"), "extracted" if strict else "extracted_from_pdf").alias("dates"),
        F.col("url").alias("source_page"),
        F.lit("pdf").alias("source_type"),
        *([F.try_element_at("metadata", F.lit("num_pages")).cast("int").alias("pdf_pages")]
          if strict else
          [F.lit(True).alias("is_active"), F.col("metadata").alias("pdf_metadata")]),
    )
    return as_records(rows)


def fallback_records(parts: DataFrame, words: V.Words = V.DEFAULT_WORDS) -> DataFrame:
    """Rows, items or links as records; ``tier`` says which (1, 2, 3)."""
    is_link = F.col("tier") == 3
    rows = parts.select(
        "entry",
        _seq("fallback", F.col("pos")).alias("seq"),
        F.when(is_link, F.col("text")).otherwise(
            _cut(F.col("text"), words.title_chars)).alias("title"),
        F.col("text").alias("description"),
        F.when(F.col("href").isNull(), F.col("url"))
        .otherwise(resolve_url(F.col("url"), F.col("href"))).alias("url"),
        X.bare_dates(
            F.when(is_link, F.array().cast("array<string>")).otherwise(X.plain_dates(F.col("text"))),
            "unlabelled").alias("dates"),
        F.col("url").alias("source_page"),
    )
    return as_records(rows)
