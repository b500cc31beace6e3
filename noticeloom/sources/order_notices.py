"""Notices, listing pages, a registry and documents derived from order tables.

The benchmark tables hold no procurement text. These views turn every order into
a notice of its customer, so each operator runs on data that grows with the
tables and has an answer that SQL can work out from ``orders`` alone:

* a customer is an issuer; ``custkey % 5`` sets how it lists its notices:
  0 table rows, 1 list items, 2 headed sections, 3 classed containers with
  document links, 4 bare links;
* a listing page holds the notices of one customer and one range of
  ``PAGE_ORDERS`` order keys, so a page is bounded however large a customer is.

An order is a few bytes in the file and some kilobytes of a page or document, so for those the bare
orders are dealt to the tasks before any text is made of them: the work does not stay with the
few tasks that read the file, and a page is put together where its orders are. Notices alone are
little work and stay where they are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from noticeloom.sources.tables import read_table

PAGE_ORDERS = 50_000

_TITLE = """
  concat(
    case cust % 5 when 0 then 'Bid' when 1 then 'Proposal' when 2 then 'RFP'
                  when 3 then if(key % 2 = 0, 'RFQ', 'Solicitation') else 'Contract' end,
    '-', key % 7, if(key % 3 = 0, '', concat(' ', substring(priority, 3))))
"""
_PHRASE = """
  concat(
    case key % 4 when 0 then concat('due date ', date_format(day, 'M/d/yyyy'))
                 when 1 then concat('posted ', date_format(day, 'yyyy-MM-dd'))
                 when 2 then concat('deadline ', date_format(day, 'MMM d, yyyy'))
                 else 'no date' end,
    case status when 'F' then ' closed' when 'O' then ' open' else ' listed' end,
    case key % 6 when 0 then concat(' mail u', cust, '@example.com')
                 when 1 then concat(' call 555-123-', lpad(key % 10000, 4, '0')) else '' end,
    if(cust % 5 = 1, concat(' project ', key % 100), ''),
    if(key % 11 = 0, concat(' until 12/31/', year(day)), ''))
"""


def notices(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """One notice per order: cust, key, utility_id, title, phrase, text, day, status."""
    orders = _orders(spark, sf_dir)
    if dealt:
        orders = orders.repartition("cust", "chunk")
    return (
        orders.withColumns({"title": F.expr(_TITLE), "phrase": F.expr(_PHRASE)})
        .selectExpr("cust", "key", "concat('u', cust) as utility_id", "title", "phrase",
                    "concat(title, ' ', phrase) as text", "day", "status", "chunk")
    )


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/orders.parquet").selectExpr(
        "o_custkey as cust", "o_orderkey as key", "o_orderstatus as status",
        "o_orderpriority as priority", "cast(o_orderdate as date) as day",
        f"o_orderkey div {PAGE_ORDERS} as chunk")


_PAGE_URL = ("concat('https://u', cust, '.example.com/notices/index.html', "
             "if(chunk = 0, '', concat('?page=', chunk)))")
ENTRY = "shiftleft(cust, 32) + chunk"


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry entry per customer, for its first listing page."""
    region = read_table(spark, f"{sf_dir}/region.parquet")
    nation = read_table(spark, f"{sf_dir}/nation.parquet")
    customer = read_table(spark, f"{sf_dir}/customer.parquet")
    return (
        customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .selectExpr("c_custkey as cust", "0L as chunk", "c_name as name", "r_name as type",
                    "concat(n_name, ', ', r_name) as region", "c_acctbal > 0 as active")
        .selectExpr(
            f"{ENTRY} as entry", "cust", "concat('u', cust) as id", "name", "type", "region",
            f"{_PAGE_URL} as rfp_url", "active",
            "if(cust % 6 = 5, null, int(cust % 6)) as max_pdfs_to_extract")
    )


def paged_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry entry per listing page."""
    listed = _orders(spark, sf_dir).select("cust", "chunk").distinct()
    return (
        registry(spark, sf_dir).drop("rfp_url", "entry").join(listed, "cust")
        .selectExpr(f"{ENTRY} as entry", "id", "name", "type", "region",
                    f"{_PAGE_URL} as rfp_url", "active", "max_pdfs_to_extract", "cust")
    )


_ITEM = """
  case cust % 5
    when 0 then concat('<tr><td>', title, '</td><td>', phrase, '</td><td><a href="n/', key,
                       '.html">view</a></td></tr>')
    when 1 then concat('<li>', title, ' <a href="../p/', key, '">more</a> ', phrase, '</li>')
    when 2 then concat('<h2>', title, ' notice</h2><div><b>Notice ', title, '</b><p>', phrase,
                       '<p>See <a href="?id=', key, '">details</a></div>')
    when 3 then concat('<div class="notice rfp-item" id="n', key, '"><strong>', title,
                       ' details</strong><br>', phrase, ' <a href="/docs/', key,
                       '.pdf">Document ', key, '</a> <a href="//files.example.com/',
                       if(key % 2 = 1, 'pdf/', ''), key, '">apply</a></div>')
    else concat('<p><a href="tender-', key, '.html#', key, '">', title, '</a></p>') end
"""
_SHELL = """
  concat('<html><head><title>Notices</title><style>p{margin:0}</style>',
         '<script>var t="<li>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul>',
         '</nav><!-- list --><div id="main"><h1>Notices</h1>',
         case cust % 5 when 0 then '<table><tr><th>Item</th><th>Dates</th><th>Link</th></tr>'
                       when 1 then '<ul>' else '' end,
         body,
         case cust % 5 when 0 then '</table>' when 1 then '</ul>' else '' end,
         '</div></body></html>')
"""


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notices of each issuer as html pages: page_id, cust, url, html.

    At most ``PAGE_ORDERS`` notices meet in one page.
    """
    return (
        notices(spark, sf_dir, dealt=True)
        .select("cust", "chunk", "key", F.expr(_ITEM).alias("item"))
        .groupBy("cust", "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("key", "item"))).alias("items"))
        .withColumn("body", F.array_join(F.col("items")["item"], ""))
        .selectExpr(f"{ENTRY} as page_id", "cust", f"{_PAGE_URL} as url", f"{_SHELL} as html")
    )


def linked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per notice; layout 3 links to them. Every fifth failed to decode: NULL text."""
    return (
        notices(spark, sf_dir)
        .selectExpr(
            "concat('https://u', cust, '.example.com/docs/', key, '.pdf') as url",
            """if(key % 5 = 0, null,
                  concat('Terms for ', title, '\\n', phrase, '\\n', phrase)) as text""",
            """case key % 4
                 when 0 then map('title', concat(title, ' details specification'),
                                 'num_pages', string(key % 9))
                 when 1 then map('title', 'Untitled', 'num_pages', string(key % 9))
                 when 2 then map('num_pages', string(key % 9))
                 else cast(map() as map<string,string>) end as metadata""")
    )


_NESTED = """
  concat('<div><table><tr><td>bid ', key, '</td><td><table><tr><td>rfp ', key,
         '</td><td>x</td></tr><tr><td>bid alone</td></tr></table></td></tr></table>',
         '<ul><li>proposal ', key, '<ul><li>rfq ', key, ' <a href="s', key, '">s</a></li></ul></li></ul>',
         '<h2>rfp ', key, '</h2><hr><h2>tender ', key, '</h2><h3>deeper ', key, '</h3>',
         '<h2>itb ', key, '</h2><h1>higher</h1><div class="bid"><b>', repeat('T', 250), '</b>',
         repeat(concat('word', key % 7, ' '), 200), '</div></div>')
"""


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for every order: tables in tables, lists in lists, a row of one cell, headers
    followed by a rule, a deeper and a higher header, and a long block: page_id, url, html."""
    return notices(spark, sf_dir, dealt=True).select(
        F.col("key").alias("page_id"), F.concat(F.lit("https://n.example.com/"), "key").alias("url"),
        F.expr(_NESTED).alias("html"))


def long_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text for every order: over 2,000 characters, fourteen dates of one pattern, and an id
    at the start of every other one only: key, text."""
    return notices(spark, sf_dir, dealt=True).selectExpr(
        "key",
        """concat(if(key % 2 = 1, concat('RFQ-', key, ' '), ''), repeat('long text ', 210), 'RFP-', key,
             array_join(transform(sequence(1, 14), i -> concat(' ', i, '/', key % 28 + 1, '/2020')), ''))
           as text""")
