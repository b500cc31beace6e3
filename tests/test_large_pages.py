import pyarrow as pa

from noticeloom.operators import large_pages
from noticeloom.operators.large_pages import large_page_blocks
from noticeloom.operators.nodes import parse_pages
from noticeloom.operators.page_parts import page_blocks
from noticeloom.sources import order_notices as N

SCHEMA = "page_id long, url string, html string"


def plain(df):
    return sorted((r.page_id, r.seq, r.strategy, r.pre, r.end, r.tag, r.title, r.text,
                   tuple((a.text, a.href) for a in r.links)) for r in df.collect())


def test_same_blocks_as_from_arrays(spark):
    odd = [(1, "u", None), (2, "u", ""), (3, "u", "no tags"), (4, "u", "<div class=bid></div>"),
           (5, "u", "<h2>rfp</h2>"), (6, "u", "<h1>tender <h2>x</h2></h1><p>after"),
           (7, "u", "<div class='rfp'><div class=bid id=x><b>a title of some length</b><a href=1>l</a><a>no</a>"
                    "</div><table><tr><td>r<b>f</b>p<td>x</table></div>"),
           (8, "u", "<div id=bid>no class</div><section class=''><article class=tender>first\nline</article></section>")]
    pages = spark.createDataFrame(odd, SCHEMA).unionByName(
        N.nested_pages(spark, "/root/testdata/sf0.001").where("page_id % 20 = 0").select("page_id", "url", "html"))
    want = plain(page_blocks(parse_pages(pages)))
    assert plain(large_page_blocks(pages)) == want and len(want) > 100


def test_a_page_of_300000_elements(spark):
    """One container around 20,000 notices, each a container of its own."""
    one = "<div class='x rfp'><strong>RFP number {0} details</strong><p>due 1/2/2024 <a href='{0}.pdf'>d</a>" \
          "<i>a</i><i>b</i><i>c</i><i>d</i><i>e</i><i>f</i><i>g</i><i>h</i><i>j</i><i>k</i><i>l</i></p></div>"
    html = "<div id=all>" + "".join(map(one.format, range(20_000))) + "</div>"
    pages = spark.createDataFrame([(1, "u", html)], SCHEMA)
    blocks = large_page_blocks(pages, table_indicators=("nothing",)).select(
        "seq", "title", "text", "links", "pre").orderBy("seq").collect()
    assert len(blocks) == 20_000
    assert [b.title for b in blocks[:2] + blocks[-1:]] == [f"RFP number {k} details" for k in (0, 1, 19_999)]
    assert all(len(b.links) == 1 and b.links[0].href == f"{b.seq - 1}.pdf" for b in blocks)
    assert blocks[7].text == "RFP number 7 details due 1/2/2024 d a b c d e f g h j k l"


def test_small_pages_share_batches_and_large_ones_are_cut():
    html = ["<p>a<b>b</b></p>", None, "", *["<ul><li>x</ul>"] * 200, "<i>t</i>" * 10_000, "<p>last"]
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(len(html))), "html": html})
    names = ["page_id", "kind", *large_pages.NODE.names, "text"]
    out = list(large_pages._rows(1, names)(iter([batch])))
    assert len(out) == 4 and max(b.num_rows for b in out) == large_pages.BATCH_ROWS
    rows = pa.Table.from_batches(out).to_pylist()
    for kind, column in (("node", "pre"), ("seg", "seg")):
        got = [(r["page_id"], r[column]) for r in rows if r["kind"] == kind]
        want = [(page, k) for page, text in enumerate(html)
                for k in range(1, len(large_pages.parse_tree(text or "")[kind == "seg"]) + 1)]
        assert got == want


def test_same_blocks_where_texts_cross_stretches(spark, monkeypatch):
    monkeypatch.setattr(large_pages, "STRETCH", 3)
    pages = N.nested_pages(spark, "/root/testdata/sf0.001").where("page_id % 300 = 0").select("page_id", "url", "html")
    want = plain(page_blocks(parse_pages(pages)))
    assert plain(large_page_blocks(pages)) == want and len(want) > 10


def test_the_element_after_a_header_is_known_where_the_page_is_parsed(spark):
    html = "<div><h2>rfp<b>x</b></h2><p>a<h3>t</h3></div><h1>last</h1>"
    nodes, _ = large_pages.parse_tree(html)
    after = dict(zip(((n[0], n[4]) for n in nodes), large_pages._after_headers(nodes)))
    assert {tag: h for (_, tag), h in after.items()} == {"div": None, "h2": None, "b": None, "p": 2, "h3": None, "h1": None}
    pages = spark.createDataFrame([(1, "u", html)], SCHEMA)
    found = large_page_blocks(pages)
    assert [(b.page_id, b.url, b.tag) for b in found.collect()] == [(1, "u", "p")]
    # Neither all elements nor the keys of a page move with its rows: the pages meet their blocks last.
    moved = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in line]
    assert moved and not any("url#" in line for line in moved)
