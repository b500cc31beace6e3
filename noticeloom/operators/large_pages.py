"""Candidate blocks of pages with so many elements that one row cannot hold them.

The elements and text strings of a page are rows, and what is inside what is found by joins over
stretches of the page, so a page is worked on by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from noticeloom.functions import vocab as V
from noticeloom.functions.text import contains_any
from noticeloom.operators.nodes import NODE, parse_tree
from noticeloom.operators.page_parts import HEADERS, TITLE_TAGS
from noticeloom.session import write_out

#: Rows that the parser hands on at a time.
BATCH_ROWS = 8192
#: Elements or strings of a stretch of a page.
STRETCH = 1024

_ROW = T.StructType([*NODE.fields, T.StructField("text", T.StringType()), T.StructField("after", T.IntegerType())])
_TYPES = [pa.int32()] * 4 + [pa.string()] * 4 + [pa.int32()] * 2 + [pa.string(), pa.int32()]
_PRE, _END, _PARENT, _TAG = (NODE.names.index(c) for c in ("pre", "end", "parent", "tag"))


def _after_headers(nodes: list[tuple]) -> list[int | None]:
    """For each element the header that it follows as the next sibling, by its ``pre``."""
    after: list[int | None] = [None] * len(nodes)
    for h in nodes:
        if h[_TAG] in HEADERS and h[_END] < len(nodes) and nodes[h[_END]][_PARENT] == h[_PARENT]:
            after[h[_END]] = h[_PRE]
    return after


def _rows(n_keys: int, names: list[str]):
    """The parser's rows, under the first of the columns ``names``."""
    n_columns = len(names) - n_keys - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Rows of a kind and the places of their pages in the batch. Small pages share a batch of rows.
            held = {kind: ([], []) for kind in ("node", "seg")}

            def full(last: bool = False) -> Iterator[pa.RecordBatch]:
                for kind, (of, rows) in held.items():
                    end = len(rows) if last else len(rows) - len(rows) % BATCH_ROWS
                    for at in range(0, end, BATCH_ROWS):
                        part = rows[at:min(at + BATCH_ROWS, end)]
                        take = pa.array(of[at:at + len(part)], pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(k).take(take) for k in range(n_keys)] + [pa.array([kind] * len(part))]
                            + [pa.array(c, t) for c, t in zip(zip(*part), _TYPES[:n_columns])], names)
                    del of[:end], rows[:end]

            for i in range(batch.num_rows):
                html = batch.column(n_keys)[i].as_py()
                if html is None:
                    continue
                nodes, segs = parse_tree(html)
                blank = (None,) * 8
                for kind, rows in (("node", [(*r, None, h) for r, h in zip(nodes, _after_headers(nodes))]),
                                   ("seg", [(*blank, k, None, s, None) for k, s in enumerate(segs, 1)])):
                    held[kind][0].extend([i] * len(rows))
                    held[kind][1].extend(rows)
                yield from full()
            yield from full(last=True)
    return run


def page_rows(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``html`` as rows: of kind "node" with the fields of ``NODE`` and ``after``, the ``pre`` of the header that an
    element follows as the next sibling, of kind "seg" a text string ``text`` with its place ``seg``. Written, a folder a kind; a page without html has none."""
    wide = pages.select(*keys, "html")
    schema = T.StructType([*wide.schema.fields[:-1], T.StructField("kind", T.StringType()), *_ROW.fields])
    return write_out(wide.mapInArrow(_rows(len(keys), schema.names), schema), "rows", by="kind")


def _inside(outer: DataFrame, inner: DataFrame, keys: Sequence[str], low: str, high: str, at: str,
            *more: str) -> DataFrame:
    """Pairs of rows of one page with ``low <= at <= high``: they meet in the stretches of the page that
    an outer row reaches into, so a page that is mostly one block is still many groups. ``more`` may ask for the
    column "stretch"."""
    outer = outer.where(F.col(low) <= F.col(high)).withColumn("stretch", F.explode(F.sequence(
        F.floor(F.col(low) / STRETCH), F.floor(F.col(high) / STRETCH))))
    inner = inner.withColumn("stretch", F.floor(F.col(at) / STRETCH))
    return outer.join(inner, [*keys, "stretch"]).where(
        (F.col(at) >= F.col(low)) & (F.col(at) <= F.col(high))).drop(*{"stretch"}.difference(more))


def _texts(nodes: DataFrame, segs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``nodes`` with ``texts``, the strings under each in order. Those of one stretch, most of them, are put
    together where they met their strings; only the others meet once more."""
    low, high = (F.floor(F.col(c) / STRETCH) for c in ("first", "last"))
    spans = nodes.withColumns({"first": F.col("seg"), "last": F.col("seg") + F.col("nseg") - 1})
    strings = segs.select(*keys, F.col("seg").alias("at"), "text")
    in_order = F.array_sort(F.collect_list(F.struct("at", "text")))["text"].alias("texts")
    others = [c for c in nodes.columns if c not in (*keys, "pre")]

    narrow = _inside(spans.where((F.col("nseg") > 0) & (low == high)), strings, keys, "first", "last", "at", "stretch") \
        .groupBy(*keys, "stretch", "pre").agg(in_order, *[F.first(c).alias(c) for c in others]).drop("stretch")
    wide = spans.where((F.col("nseg") > 0) & (low < high))
    held = _inside(wide.select(*keys, "pre", "first", "last"), strings, keys, "first", "last", "at").groupBy(
        *keys, "pre").agg(in_order)
    bare = nodes.where("nseg = 0").withColumn("texts", F.array().cast("array<string>"))
    return narrow.unionByName(wide.drop("first", "last").join(held, [*keys, "pre"])).unionByName(bare)


def large_page_blocks(
    pages: DataFrame,
    keys: Sequence[str] = ("page_id", "url"),
    indicators: Sequence[str] = V.NOTICE_INDICATORS,
    container_words: Sequence[str] = V.CONTAINER_WORDS,
    table_indicators: Sequence[str] = V.TABLE_INDICATORS,
) -> DataFrame:
    """One row per candidate block, the same as ``page_blocks`` of the parsed pages.

    ``keys`` name a page and are not NULL. What grows with a page are rows; arrays only hold what a block
    itself has, its text and links.
    """
    # A page is a number until the end, as its keys may be long and every row would carry them.
    named = keys
    rows = page_rows(pages.withColumn("_page", F.monotonically_increasing_id()), [*named, "_page"])
    keys = ["_page"]
    nodes = rows.where("kind = 'node'").select(*keys, *NODE.names, "after")
    segs = rows.where("kind = 'seg'").select(*keys, "seg", "text")
    tag = F.col("tag")

    def words(col: str, own: Sequence[str]) -> Column:
        return F.coalesce(contains_any(F.col(col), own), F.lit(False))

    contained = tag.isin("div", "section", "article") & F.col("cls").isNotNull() & (
        words("cls", container_words) | words("id", container_words))
    # Everything whose text counts, once.
    wanted = tag.isin(*HEADERS, *TITLE_TAGS, "table") | ((tag == "a") & F.col("href").isNotNull()) | contained \
        | F.col("after").isNotNull()
    kept = nodes.where(wanted).withColumn("contained", contained).select(
        *keys, "pre", "end", "tag", "href", "seg", "nseg", "after", "contained")
    # Joined without and with a space as they are read.
    texts = write_out(_texts(kept, segs, keys), "texts").withColumns({
        "glued": F.array_join("texts", ""), "spaced": F.array_join("texts", " ")})

    level = F.substring(tag, 2, 1)
    hits = texts.where(tag.isin(*HEADERS) & contains_any(F.col("glued"), indicators)).select(
        *keys, F.col("pre").alias("after"), level.alias("level"))
    after = texts.where("after IS NOT NULL").join(hits, [*keys, "after"]).where(
        ~(tag.isin(*HEADERS) & (level <= F.col("level"))))
    own = [*keys, "pre", "end", "tag", "seg", "nseg"]
    kinds = [after, texts.where("contained"), texts.where((tag == "table") & contains_any(
        F.col("glued"), table_indicators))]
    found = None
    for strategy, part in enumerate(kinds, 1):
        part = part.select(*own, "texts", F.lit(strategy).alias("strategy"))
        found = part if found is None else found.unionByName(part)
    blocks = write_out(found, "blocks").withColumns({
        "glued": F.array_join("texts", ""), "spaced": F.array_join("texts", " ")})

    spans = blocks.select(*keys, "strategy", "pre", (F.col("pre") + 1).alias("low"), "end")
    block = [*keys, "strategy", "pre"]

    def under(kind: Column) -> DataFrame:
        inner = texts.where(kind).select(*keys, F.col("pre").alias("at"), "glued", "href")
        return _inside(spans, inner, keys, "low", "end", "at").groupBy(*block)

    size = F.length("glued")
    heads = under(tag.isin(*TITLE_TAGS) & (size > 10) & (size < V.TITLE_CHARS)).agg(
        F.min_by("glued", "at").alias("head"))
    links = under((tag == "a") & F.col("href").isNotNull()).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("at", "glued", "href"))),
        lambda a: F.struct(a["glued"].alias("text"), a["href"].alias("href"))).alias("links"))
    opening = F.when(F.col("glued").contains("\n"), F.substring_index("glued", "\n", 1)).otherwise(
        F.left("glued", F.lit(V.TITLE_CHARS)))
    none = F.array().cast("array<struct<text:string,href:string>>")
    in_order = Window.partitionBy(*keys).orderBy("strategy", "pre")
    pages_of = rows.where("kind = 'node' AND pre = 1").select(*keys, *named)
    return blocks.join(heads, block, "left").join(links, block, "left").join(pages_of, keys).select(
        *named, F.row_number().over(in_order).cast("bigint").alias("seq"), "strategy", "pre", "end", "tag",
        F.coalesce("head", opening).alias("title"), F.col("spaced").alias("text"),
        F.coalesce("links", none).alias("links"))
