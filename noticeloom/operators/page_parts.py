"""What a parsed page holds: links, table rows, list items, candidate blocks.

All of it reads the page's own arrays, so no row leaves its partition. Functions
named ``*_array`` give one array per page; the others give one row per part, with
``seq`` as the position on the page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from noticeloom.functions import vocab as V
from noticeloom.functions.text import contains_any, holds_any, let
from noticeloom.functions.urls import resolve_url
from noticeloom.operators.nodes import below, glued, spaced

HEADERS = ("h1", "h2", "h3", "h4", "h5", "h6")
TITLE_TAGS = ("h1", "h2", "h3", "h4", "strong", "b")
KEYS = ("page_id", "url")


def tagged(nodes: Column, *tags: str) -> Column:
    return F.filter(nodes, lambda n: n["tag"].isin(*tags))


def anchors(nodes: Column) -> Column:
    """Links with an address, as ``array<struct<text, href>>`` in document order."""
    return F.transform(
        F.filter(nodes, lambda n: (n["tag"] == "a") & n["href"].isNotNull()),
        lambda n: F.struct(glued(n).alias("text"), n["href"].alias("href")),
    )


def _first_href(nodes: Column) -> Column:
    hit = F.filter(nodes, lambda n: (n["tag"] == "a") & n["href"].isNotNull())
    return F.get(hit, 0)["href"]


def rows_array(words: Sequence[str] = V.ROW_WORDS, whole: bool = False) -> Column:
    """Rows with two or more cells and a listing word; a nested table's rows come once per table."""
    def row(tr: Column) -> Column:
        return let(
            below(tr),
            lambda inner: let(tagged(inner, "td", "th"), lambda cells: F.struct(
                F.array_join(F.transform(cells, glued), " ").alias("text"),
                F.size(cells).alias("n_cells"),
                _first_href(inner).alias("href"),
            )),
        )

    found = F.flatten(F.transform(
        tagged(F.col("nodes"), "table"),
        lambda table: F.transform(tagged(below(table), "tr"), row)))
    return F.filter(found, lambda r: (r["n_cells"] >= 2) & holds_any(r["text"], words, whole))


def items_array(words: Sequence[str] = V.ROW_WORDS, whole: bool = False) -> Column:
    """List items with a listing word; a nested list's items come once per list."""
    found = F.flatten(F.transform(
        tagged(F.col("nodes"), "ul", "ol"),
        lambda lst: F.transform(
            tagged(below(lst), "li"),
            lambda li: F.struct(glued(li).alias("text"), _first_href(below(li)).alias("href")))))
    return F.filter(found, lambda r: holds_any(r["text"], words, whole))


def is_relevant(link: Column, base: Column, words: Sequence[str] = V.LINK_WORDS,
                whole: bool = False) -> Column:
    """A word in the text or the resolved address; the address is resolved only when it decides."""
    return F.when(holds_any(link["text"], words, whole), F.lit(True)) \
        .otherwise(holds_any(resolve_url(base, link["href"]), words, whole))


def is_document(href: Column) -> Column:
    """Ends in ``.pdf`` or mentions ``pdf``; the second covers the first."""
    return F.lower(href).contains("pdf")


def is_document_strict(href: Column) -> Column:
    return F.lower(href).endswith(".pdf")


# Blocks

def _after_header(words: Sequence[str], whole: bool) -> Column:
    """The element after each matching header, unless it is a header of the same or a higher level."""
    def sibling(h: Column) -> Column:
        return F.get(F.col("nodes"), h["end"])

    def level(n: Column) -> Column:
        return F.substring(n["tag"], 2, 1)

    hits = F.filter(tagged(F.col("nodes"), *HEADERS), lambda h: holds_any(glued(h), words, whole))
    kept = F.filter(
        hits,
        lambda h: F.coalesce(
            (sibling(h)["parent"] == h["parent"])
            & ~(sibling(h)["tag"].isin(*HEADERS) & (level(sibling(h)) <= level(h))),
            F.lit(False)),
    )
    return F.transform(kept, lambda h: F.struct(F.lit(1).alias("strategy"), sibling(h).alias("node")))


def _by_class(words: Sequence[str], whole: bool) -> Column:
    """Containers with a class attribute whose class or id holds a word."""
    hits = F.filter(
        F.col("nodes"),
        lambda n: n["tag"].isin("div", "section", "article") & n["cls"].isNotNull()
        & (holds_any(n["cls"], words, whole)
           | F.coalesce(holds_any(n["id"], words, whole), F.lit(False))),
    )
    return F.transform(hits, lambda n: F.struct(F.lit(2).alias("strategy"), n.alias("node")))


def _by_table(words: Sequence[str], whole: bool) -> Column:
    hits = F.filter(tagged(F.col("nodes"), "table"), lambda t: holds_any(glued(t), words, whole))
    return F.transform(hits, lambda n: F.struct(F.lit(3).alias("strategy"), n.alias("node")))


def block_title(node: Column) -> Column:
    """First heading or bold text of 11 to 199 characters, else the first line of the glued text."""
    heads = F.filter(
        F.transform(tagged(below(node), *TITLE_TAGS), glued),
        lambda t: (F.length(t) > 10) & (F.length(t) < V.TITLE_CHARS),
    )
    opening = let(
        glued(node),
        lambda t: F.when(t.contains("\n"), F.substring_index(t, "\n", 1))
        .otherwise(F.left(t, F.lit(V.TITLE_CHARS))),
    )
    return F.coalesce(F.get(heads, 0), opening)


def blocks_array(
    indicators: Sequence[str] = V.NOTICE_INDICATORS,
    container_words: Sequence[str] = V.CONTAINER_WORDS,
    table_indicators: Sequence[str] = V.TABLE_INDICATORS,
    strategies: Sequence[int] = (1, 2, 3),
    whole: bool = False,
) -> Column:
    """Candidate blocks: after headers, then by class, then tables. A node may come twice."""
    found = {
        1: lambda: _after_header(indicators, whole),
        2: lambda: _by_class(container_words, whole),
        3: lambda: _by_table(table_indicators, whole),
    }
    blocks = F.concat(*[found[s]() for s in strategies])
    return F.transform(
        blocks,
        lambda b: F.struct(
            b["strategy"].alias("strategy"),
            b["node"]["pre"].alias("pre"),
            b["node"]["end"].alias("end"),
            b["node"]["tag"].alias("tag"),
            block_title(b["node"]).alias("title"),
            spaced(b["node"]).alias("text"),
            anchors(below(b["node"])).alias("links"),
        ),
    )


def _per_part(parsed: DataFrame, parts: Column, keys: Sequence[str]) -> DataFrame:
    """One row per array element.

    The outer form keeps Catalyst from inferring ``size(parts) > 0`` and pushing it
    down, which would compute the parts a second time; the NULL rows go right after.
    """
    return (
        parsed.select(*keys, parts.alias("parts"))
        .select(*keys, F.posexplode_outer("parts").alias("pos", "part"))
        .where(F.col("pos").isNotNull())
        .select(*keys, (F.col("pos") + 1).cast("bigint").alias("seq"), "part.*")
    )


def page_nodes(parsed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per element."""
    return parsed.select(*keys, F.inline("nodes"))


def page_links(parsed: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    # The links are unnested first: resolving them then runs on plain columns.
    flat = _per_part(parsed, anchors(F.col("nodes")), keys)
    return flat.withColumn("link_url", resolve_url(F.col("url"), F.col("href")))


def relevant_links(
    parsed: DataFrame, words: Sequence[str] = V.LINK_WORDS, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Links with a word in text or address, in page order (``seq`` counts all links)."""
    links = page_links(parsed, keys)
    return links.where(contains_any(F.col("text"), words) | contains_any(F.col("link_url"), words))


def document_links(
    parsed: DataFrame, strict: bool = False, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Links to documents; ``link_no`` counts them per page."""
    test = is_document_strict if strict else is_document
    flat = _per_part(parsed, F.filter(anchors(F.col("nodes")), lambda a: test(a["href"])), keys)
    return flat.withColumn("link_url", resolve_url(F.col("url"), F.col("href"))) \
        .withColumnRenamed("seq", "link_no")


def table_rows(
    parsed: DataFrame, words: Sequence[str] = V.ROW_WORDS, keys: Sequence[str] = KEYS
) -> DataFrame:
    return _per_part(parsed, rows_array(words), keys)


def list_items(
    parsed: DataFrame, words: Sequence[str] = V.ROW_WORDS, keys: Sequence[str] = KEYS
) -> DataFrame:
    return _per_part(parsed, items_array(words), keys)


def page_blocks(
    parsed: DataFrame,
    strategies: Sequence[int] = (1, 2, 3),
    indicators: Sequence[str] = V.NOTICE_INDICATORS,
    container_words: Sequence[str] = V.CONTAINER_WORDS,
    table_indicators: Sequence[str] = V.TABLE_INDICATORS,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """One row per candidate block, ``seq`` in strategy order and then page order."""
    return _per_part(
        parsed,
        blocks_array(indicators, container_words, table_indicators, strategies),
        keys)


def block_links(blocks: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row per link inside a block."""
    return blocks.select(*keys, "seq", "strategy", F.posexplode("links").alias("pos", "link")).select(
        *keys, "seq", "strategy", (F.col("pos") + 1).cast("bigint").alias("link_no"),
        F.col("link.text").alias("text"),
        resolve_url(F.col("url"), F.col("link.href")).alias("link_url"))
