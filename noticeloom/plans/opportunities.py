"""Whole pipelines: registry, pages and documents in, opportunities out."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F, types as T

from noticeloom.functions.text import let, still_open
from noticeloom.functions.urls import resolve_url
from noticeloom.functions.vocab import DEFAULT_WORDS, Words
from noticeloom.operators import enrich, page_parts as P, records as R
from noticeloom.operators.dedup import drop_contained, first_per_title
from noticeloom.operators.nodes import parse_pages
from noticeloom.session import write_out
from noticeloom.sources.registry import usable

_ENTRY = ("entry", "rfp_url", "max_pdfs_to_extract")


def latest(df: DataFrame, key: str = "url", order: Sequence[str] = ("fetched_at", "page_id", "doc_id"),
           body: str | None = None) -> DataFrame:
    """One row per ``key``: the last fetch, by those columns of ``order`` that there are.

    Rows equal in all of them are told apart by a hash of ``body``, so the choice is the same in
    every run; only copies in every respect stay together. The newest stamps are merged within
    tasks before they move, and a row meets them by key alone.
    """
    stamps = _stamps(df, key, order, body)
    newest = df.groupBy(key).agg(F.max(F.struct(*stamps)).alias("_stamp"))
    return df.withColumn("_stamp", F.struct(*stamps)).join(
        newest, [key, "_stamp"], "left_semi").drop("_stamp")


def _stamps(df: DataFrame, key: str, order: Sequence[str], body: str | None) -> list[Column]:
    stamps = [F.col(c) for c in order if c in df.columns]
    if body is not None:
        stamps.append(F.xxhash64(body).alias("body_hash"))
    if not stamps:
        raise ValueError(f"rows of one {key} need a column that orders them, one of {order}")
    return stamps


def one_fetch(df: DataFrame, key: str = "url", order: Sequence[str] = ("fetched_at", "page_id", "doc_id"),
              body: str | None = None) -> DataFrame:
    """The row that ``latest`` keeps, and of its copies one.

    Every task keeps one row of a key before rows move (``WindowGroupLimit``), so they move once, and a
    key with many fetches or copies costs no more than a few.
    """
    last = Window.partitionBy(key).orderBy(*[s.desc_nulls_last() for s in _stamps(df, key, order, body)])
    return df.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")


#: Words of 64 bits by which rows are sorted out before they move.
SIEVE = 1 << 20


def sieve(df: DataFrame, keys: DataFrame, key: str = "url") -> DataFrame:
    """``df`` without most of the rows whose ``key`` is not in ``keys``, and with all of the others.

    A bit for the hash of each key is set in words that are summed by the tasks and then broadcast: 8 MB however
    many keys there are. Those rows that pass by chance are for the join to come.
    """
    h = F.xxhash64(key)
    word, bit = F.pmod(h, F.lit(SIEVE)), F.shiftright(h, 40).bitwiseAND(F.lit(63)).cast("int")
    one = F.lit(1).cast("bigint")
    found = keys.groupBy(word.alias("_word")).agg(F.bit_or(F.call_function("shiftleft", one, bit)).alias("_bits"))
    words = df.sparkSession.range(SIEVE).withColumnRenamed("id", "_word").join(found, "_word", "left").agg(
        F.array_sort(F.collect_list(F.struct("_word", F.coalesce("_bits", F.lit(0)).alias("_bits"))))["_bits"].alias("_sieve"))
    held = F.get(F.col("_sieve"), word.cast("int"))
    return df.crossJoin(F.broadcast(words)).where(
        F.call_function("shiftright", held, bit).bitwiseAND(one) == 1).drop("_sieve")


def _fallback(words: Words) -> Column:
    """Table rows, else list items, else the first ten relevant links of the page.

    A later tier is only worked out where the one before it is empty.
    """
    def tier(n: int, parts: Column) -> Column:
        return F.transform(parts, lambda p: F.struct(
            F.lit(n).alias("tier"), p["text"].alias("text"), p["href"].alias("href")))

    links = F.filter("links", lambda a: P.is_relevant(
        a, F.col("url"), words.link, words.whole_words))
    relevant = links if words.fallback_links is None else F.slice(links, 1, words.fallback_links)
    return let(P.rows_array(words.row, words.whole_words), lambda rows: F.when(F.size(rows) > 0, tier(1, rows)).otherwise(
        let(P.items_array(words.row, words.whole_words), lambda items: F.when(F.size(items) > 0, tier(2, items))
            .otherwise(tier(3, relevant)))))


def page_arrays(
    pages: DataFrame,
    blocks: bool = True,
    documents: Sequence[str] = (),
    fallback: str | None = "needed",
    words: Words = DEFAULT_WORDS,
) -> DataFrame:
    """One row per page: arrays of blocks, document links, fallback parts.

    ``documents`` names the kinds of document links, "any" and "strict". ``fallback`` is None,
    "needed" (pages without a titled block) or "always". The html goes to the parser and no further.
    """
    found = parse_pages(pages.select("url", "html")).select(
        "url", "nodes", "segs",
        F.coalesce("parse_error", F.when(F.col("nodes").isNull(), "no html")).alias("parse_error"),
        *([P.blocks_array(words.indicator, words.container, words.table, whole=words.whole_words)
           .alias("blocks")] if blocks else []),
        P.anchors(F.col("nodes")).alias("links"),
    )
    tests = {"any": P.is_document, "strict": P.is_document_strict}
    bare = ~F.exists("blocks", lambda b: b["title"] != "") if blocks else F.lit(True)
    parts = _fallback(words)
    return found.select(
        "url", "parse_error", F.coalesce(bare, F.lit(True)).alias("bare"),
        *(["blocks"] if blocks else []),
        *[F.filter("links", lambda l: tests[k](l["href"])).alias(f"{k}_links") for k in documents],
        *([(F.when(bare, parts) if fallback == "needed" else parts).alias("fallback")]
          if fallback else []),
    )


_PART = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("pos", T.IntegerType()),   # place among the parts of its kind
    T.StructField("of", T.IntegerType()),    # and how many there are
    T.StructField("tier", T.IntegerType()),
    T.StructField("title", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("href", T.StringType()),
    T.StructField("links", T.ArrayType(T.StructType([
        T.StructField("text", T.StringType()), T.StructField("href", T.StringType())]))),
])


def _as_parts(kind: str, column: str, fields: tuple[str, ...]) -> Column:
    def part(x: Column, i: Column) -> Column:
        known = {"kind": F.lit(kind), "pos": i + 1, "of": F.size(column)}
        return F.struct(*[
            known.get(f.name, x[f.name] if f.name in fields else F.lit(None))
            .cast(f.dataType).alias(f.name) for f in _PART])

    none = F.array().cast(T.ArrayType(_PART))
    return F.coalesce(F.transform(column, part), none)  # one NULL would void the concat


_KINDS = {
    "page": ("page", ("text",)),
    "blocks": ("block", ("title", "text", "links")),
    "any_links": ("any", ("text", "href")),
    "strict_links": ("strict", ("text", "href")),
    "fallback": ("fallback", ("tier", "text", "href")),
}


def page_parts(registry: DataFrame, pages: DataFrame, active_only: bool = True,
               words: Words = DEFAULT_WORDS, observe: Observation | None = None, **options) -> DataFrame:
    """The parts of the registered pages as one written table, a folder per kind.

    The last fetch of each address that an entry names is parsed, once, however many entries share
    it and however often it was landed. Facts of blocks are worked out here, in the task that parsed the page, so a block's full text
    is neither written nor shuffled. Of kind "page" there is one part for each page, its text the
    parse error. ``observe`` gets the counters of the pass. Options as in ``page_arrays``.
    """
    wanted = usable(registry, active_only).select(F.col("rfp_url").alias("url")).distinct()
    # The last fetch first: the join then finds its rows dealt and sorted by address.
    fetched = one_fetch(pages, body="html").join(wanted, "url", "left_semi")
    arrays = page_arrays(fetched, words=words, **options).withColumn(
        "page", F.array(F.struct(F.col("parse_error").alias("text"))))
    parts = F.concat(*[_as_parts(kind, column, fields)
                       for column, (kind, fields) in _KINDS.items() if column in arrays.columns])
    # Outer, as a plain inline would have the arrays computed again for its filter.
    flat = (
        arrays.select("url", "bare", parts.alias("parts"))
        .select("url", "bare", F.inline_outer("parts"))
        .where(F.col("kind").isNotNull())
    )
    if options.get("blocks", True):
        flat = R.with_block_facts(flat, F.col("kind") == "block", words)
    if observe is not None:
        flat = flat.observe(observe, *pass_counters())
    return write_out(flat, "parts", by="kind")


def pass_counters() -> list[Column]:
    """Counters of the parse pass, for ``observe``: pages, failed ones, and parts by kind.

    They are taken while the parts are written. A task's numbers count when its output does, once,
    so tasks that run again or twice change nothing.
    """
    failed = (F.col("kind") == "page") & (F.coalesce("text", F.lit("")) != "")
    return [F.count_if(F.col("kind") == "page").alias("n_pages"), F.count_if(failed).alias("n_failed"),
            *[F.count_if(F.col("kind") == kind).alias(f"n_{kind}") for kind in ("block", "any", "strict", "fallback")]]


def _of_entries(parts: DataFrame, registry: DataFrame, kind: str, active_only: bool) -> DataFrame:
    """Parts of one kind for each entry that names their page."""
    entries = usable(registry, active_only).select(
        *[c if c in registry.columns else F.lit(None).cast("int").alias(c) for c in _ENTRY])
    return parts.where(F.col("kind") == kind).join(
        entries, F.col("url") == F.col("rfp_url")).drop("rfp_url")


def _blocks(parts: DataFrame, registry: DataFrame, active_only: bool) -> DataFrame:
    # The first of each title on its page, before entries that share the page multiply it. Dealt by page, the
    # blocks move once for this and for the entries.
    firsts = first_per_title(
        parts.where("kind = 'block'").withColumnRenamed("pos", "seq").repartition("url"), ["url"])
    # Links are resolved last, for the blocks that stay.
    return R.block_records(_of_entries(firsts, registry, "block", active_only))


def _fallback_of(parts: DataFrame, registry: DataFrame, active_only: bool, needed: bool,
                 words: Words) -> DataFrame:
    rows = _of_entries(parts, registry, "fallback", active_only)
    return R.fallback_records(rows.where("bare") if needed else rows, words)


def _documents(parts: DataFrame, registry: DataFrame, documents: DataFrame, active_only: bool,
               strict: bool, words: Words) -> DataFrame:
    default = words.max_documents_strict if strict else words.max_documents
    most = F.coalesce("max_pdfs_to_extract", F.lit(default))
    if strict:  # a limit below zero counts from the end; elsewhere it means none
        most = F.when(most < 0, F.col("of") + most).otherwise(most)
    links = write_out(
        _of_entries(parts, registry, "strict" if strict else "any", active_only)
        .where(F.col("pos") <= most)
        .select("entry", "url", F.col("pos").alias("link_no"), F.col("text").alias("link_text"),
                resolve_url(F.col("url"), F.col("href")).alias("document_url")), "links")
    wanted = links.select(F.col("document_url").alias("url")).distinct()
    # Most documents may be linked by no page; their texts do not move.
    fetched = one_fetch(sieve(documents, wanted), body="text").join(wanted, "url", "left_semi")
    # Written, so that both sides of the join are plain exchanges, of which Spark splits a hot one.
    one = write_out(R.compact_documents(fetched, words), "documents")
    return R.document_records(enrich.link_documents(links, one), strict, words)


def _finish(records: DataFrame, registry: DataFrame, run_ts: str | None) -> DataFrame:
    """With the issuer, the time of the run, and ``is_open``: whether the latest readable date is not
    before the day of the run (NULL without a date or a time)."""
    now = F.lit(run_ts).cast("timestamp")
    return enrich.with_metadata(records, registry).withColumns({
        "scraped_at": now, "is_open": still_open(F.col("dates"), now.cast("date"))})


def base_from(parts: DataFrame, registry: DataFrame, run_ts: str | None = None,
              active_only: bool = True, words: Words = DEFAULT_WORDS) -> DataFrame:
    """Rows, else items, else links of each entry's page; parts with fallback "always"."""
    return _finish(_fallback_of(parts, registry, active_only, False, words), registry, run_ts)


def enhanced_from(parts: DataFrame, registry: DataFrame, run_ts: str | None = None,
                  active_only: bool = True, words: Words = DEFAULT_WORDS) -> DataFrame:
    """Blocks of each entry's page; the base records where it has none."""
    found = _blocks(parts, registry, active_only).unionByName(
        _fallback_of(parts, registry, active_only, True, words))
    return _finish(found, registry, run_ts)


def documents_from(parts: DataFrame, registry: DataFrame, documents: DataFrame,
                   run_ts: str | None = None, active_only: bool = True,
                   words: Words = DEFAULT_WORDS) -> DataFrame:
    """Documents only; parts with the "strict" document links."""
    return _finish(_documents(parts, registry, documents, active_only, True, words), registry, run_ts)


def opportunities_from(parts: DataFrame, registry: DataFrame, documents: DataFrame,
                       run_ts: str | None = None, active_only: bool = True,
                       words: Words = DEFAULT_WORDS) -> DataFrame:
    """Documents, then blocks not already named by one, else the base records; parts with "any" links."""
    blocks = _blocks(parts, registry, active_only).withColumn("source_type", F.lit("html"))
    found = write_out(
        _documents(parts, registry, documents, active_only, False, words).unionByName(blocks), "found")
    kept = drop_contained(found, ["entry"], droppable=F.col("source_type") == "html")
    # An entry whose every title is contained still keeps its first, so "nothing
    # kept" is "nothing found".
    rest = _fallback_of(parts, registry, active_only, True, words).join(
        found.select("entry").distinct(), "entry", "left_anti")
    return _finish(kept.unionByName(rest), registry, run_ts)


def base_opportunities(
    registry: DataFrame, pages: DataFrame, run_ts: str | None = None, active_only: bool = True,
    words: Words = DEFAULT_WORDS,
) -> DataFrame:
    """Rows, else items, else links of each entry's page."""
    parts = page_parts(registry, pages, active_only, words, blocks=False)
    return base_from(parts, registry, run_ts, active_only, words)


def enhanced_opportunities(
    registry: DataFrame, pages: DataFrame, run_ts: str | None = None, active_only: bool = True,
    words: Words = DEFAULT_WORDS,
) -> DataFrame:
    """Blocks of each entry's page; the base records where it has none."""
    return enhanced_from(page_parts(registry, pages, active_only, words), registry, run_ts, active_only,
                         words)


def opportunities(
    registry: DataFrame,
    pages: DataFrame,
    documents: DataFrame,
    run_ts: str | None = None,
    active_only: bool = True,
    words: Words = DEFAULT_WORDS,
) -> DataFrame:
    """Documents, then blocks not already named by one, else the base records.

    ``documents`` is ``(url, text, metadata)``.
    """
    parts = page_parts(registry, pages, active_only, words, documents=("any",))
    return opportunities_from(parts, registry, documents, run_ts, active_only, words)


def document_opportunities(
    registry: DataFrame,
    pages: DataFrame,
    documents: DataFrame,
    run_ts: str | None = None,
    active_only: bool = True,
    words: Words = DEFAULT_WORDS,
) -> DataFrame:
    """Documents only, for issuers who publish that way."""
    parts = page_parts(registry, pages, active_only, words, blocks=False, documents=("strict",), fallback=None)
    return documents_from(parts, registry, documents, run_ts, active_only, words)


Extractor = Callable[[DataFrame, DataFrame], DataFrame]


def by_portal(
    registry: DataFrame,
    pages: DataFrame,
    extractors: Mapping[str, Extractor],
    default: Extractor,
    active_only: bool = True,
    words: Words = DEFAULT_WORDS,
) -> DataFrame:
    """Run the extractor registered for each entry's ``scraper_type``; the rest get the default.

    The pages of all entries are read and parsed once, and every kind of part is written; an
    extractor takes the parts and its registry rows (as the ``..._from`` functions do) and returns
    opportunities.
    """
    parts = page_parts(registry, pages, active_only, words, documents=("any", "strict"), fallback="always")
    kind = F.coalesce("scraper_type", F.lit(""))
    out = default(parts, registry.where(~kind.isin(*extractors)) if extractors else registry)
    for name, extract in extractors.items():
        out = out.unionByName(extract(parts, registry.where(kind == name)), allowMissingColumns=True)
    return out


def run_metrics(parts: DataFrame, registry: DataFrame, active_only: bool = True) -> DataFrame:
    """What each entry's page gave: ``status`` (ok, failed, uncollected) and counts of its parts.

    Read from the written parts, so nothing is parsed again. A page without html counts as failed.
    """
    counted = parts.groupBy("url").agg(
        F.max(F.when(F.col("kind") == "page", F.coalesce("text", F.lit("")))).alias("error"),
        *[F.count_if(F.col("kind") == kind).alias(name) for kind, name in (
            ("block", "n_blocks"), ("any", "n_doc_links"), ("fallback", "n_fallback"))])
    entries = usable(registry, active_only).select("entry", F.col("rfp_url").alias("url"))
    status = (F.when(F.col("error").isNull(), "uncollected").when(F.col("error") != "", "failed")
              .otherwise("ok"))
    return entries.join(counted, "url", "left").select(
        "entry", status.alias("status"), *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                                           for c in ("n_blocks", "n_doc_links", "n_fallback")])
