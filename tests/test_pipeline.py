"""Whole pipelines on hand-made pages, with answers worked out by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from noticeloom.functions.vocab import Words
from noticeloom.plans import opportunities as O
from noticeloom.plans.run import run
from noticeloom.sources import registry as REG

BLOCKS = """<h2>Open RFPs</h2><div><h3>Supply of copper cable</h3>RFP-1 due date 1/2/2025
<a href="one.html">one</a></div>
<div class="rfp"><b>SUPPLY OF COPPER CABLE </b>again</div>
<div class="bid"><b>Copper cable works</b> closed <a href="/spec.pdf">Copper Cable Works, full specification</a>
<a href="/lost.pdf">lost</a><a href="/late.pdf">late</a></div>"""
ROWS = """<table><tr><th>What</th><th>When</th></tr><tr><td>Bid 7</td><td>3/4/2025 and 2025-03-05
<a href="b7">b</a></td></tr><tr><td>nothing</td><td>here</td></tr></table><ul><li>Bid 8</li></ul>"""
ITEMS = "<ul><li>Proposal 9 <a href='p9'>p</a></li><li>other</li></ul><a href='/tender'>t</a>"
LINKS = "".join(f"<a href='/award/{i}'>n{i}</a>" for i in range(12)) + "<a href='/x'>x</a>"
PAGES = [("https://a.org/", BLOCKS), ("https://b.org/", ROWS), ("https://c.org/", ITEMS),
         ("https://d.org/", LINKS), ("https://e.org/", "<p>nothing</p>"), ("https://f.org/", None),
         ("https://unlisted.org/", BLOCKS)]
REGISTRY = [(i, c, f"Utility {c}", "IOU", f"{c}land, USA", f"https://{c}.org/", 2 if c == "a" else None,
             True) for i, c in enumerate("abcdefg")] + [
    (7, "off", "Off", "IOU", "X, USA", "https://a.org/", None, False),
    (8, "unset", "Unset", "IOU", "X, USA", "https://a.org/", None, None),
    (9, "nourl", "No url", "IOU", "X, USA", None, None, True),
    (10, "blank", "Blank", "IOU", "X, USA", "", None, True)]
DOCUMENTS = [("https://a.org/spec.pdf", "Copper text RFP-77\n2025-06-07", {"num_pages": "3"}),
             ("https://a.org/late.pdf", "late", {})]


@pytest.fixture(scope="module")
def data(spark):
    return (
        spark.createDataFrame(REGISTRY, "entry long, id string, name string, type string, region string, "
                              "rfp_url string, max_pdfs_to_extract int, active boolean"),
        spark.createDataFrame(PAGES, "url string, html string"),
        spark.createDataFrame(DOCUMENTS, "url string, text string, metadata map<string,string>"),
    )


def titles(df):
    return [(r.utility_id, r.title) for r in df.orderBy("entry", "seq").collect()]


FALLBACK = [("b", "Bid 7 3/4/2025 and 2025-03-05\nb".replace("\nb", "b")), ("c", "Proposal 9p")] + [
    ("d", f"n{i}") for i in range(10)]


def test_base(spark, data):
    got = O.base_opportunities(*data[:2], run_ts="2026-01-02T03:04:05")
    links_of_a = [("a", "Copper Cable Works, full specification"), ]
    rows = got.orderBy("entry", "seq").collect()
    by = {r.utility_id for r in rows}
    assert by == {"b", "c", "d"}  # the links of a hold no link word
    assert titles(got) == FALLBACK and links_of_a
    b = rows[0]
    assert [d.date for d in b.dates] == ["3/4/2025", "2025-03-05"]
    assert (b.url, b.source_page, b.utility, b.region) == (
        "https://b.org/b7", "https://b.org/", "Utility b", "bland, USA")
    assert b.is_active is None and b.source_type is None
    assert str(b.scraped_at) == "2026-01-02 03:04:05"
    assert rows[-1].url == "https://d.org/award/9" and rows[-1].dates == []


def test_enhanced(spark, data):
    got = O.enhanced_opportunities(*data[:2])
    assert titles(got) == [("a", "Supply of copper cable"), ("a", "Copper cable works")] + FALLBACK
    first, second = got.where("utility_id = 'a'").orderBy("seq").collect()
    assert (first.rfp_id, first.url, first.is_active) == ("RFP-1", "https://a.org/one.html", True)
    assert first.additional_links[0].text == "one"
    assert [(d.date, d.type) for d in first.dates] == [("1/2/2025", "due date")]
    assert second.is_active is False and second.url == "https://a.org/spec.pdf"
    assert first.source_type is None


def test_documents_come_first_and_hide_contained_titles(spark, data):
    got = O.opportunities(*data)
    assert titles(got) == [("a", "Copper Cable Works, full specification"),
                           ("a", "Supply of copper cable")] + FALLBACK
    doc = got.where("source_type = 'pdf'").first()
    assert (doc.rfp_id, doc.url, doc.is_active) == ("RFP-77", "https://a.org/spec.pdf", True)
    assert [(d.date, d.type) for d in doc.dates] == [("2025-06-07", "extracted_from_pdf")]
    assert doc.pdf_metadata == {"num_pages": "3"} and doc.pdf_pages is None
    # Two links are looked at: the lost second one is not replaced by the third.


def test_documents_only(spark, data):
    got = O.document_opportunities(*data)
    [doc] = got.collect()
    assert (doc.utility_id, doc.pdf_pages, doc.is_active) == ("a", 3, None)
    assert doc.dates[0].type == "extracted"


def test_no_documents_when_the_limit_is_zero(spark, data):
    registry = data[0].withColumn("max_pdfs_to_extract", F.lit(0))
    assert O.opportunities(registry, *data[1:]).where("source_type = 'pdf'").count() == 0


def test_only_the_last_fetch_of_an_address_counts(spark, data):
    registry, pages, docs = data
    old = pages.select("url", F.lit("<div class=rfp><b>Long gone notice</b></div>").alias("html"), F.lit(1).alias("fetched_at"))
    both = old.union(pages.withColumn("fetched_at", F.lit(2)))
    old_docs = docs.withColumns({"text": F.lit("old"), "fetched_at": F.lit("a")})
    both_docs = old_docs.union(docs.withColumn("fetched_at", F.lit("b")))
    assert titles(O.opportunities(registry, both, both_docs)) == titles(O.opportunities(*data))
    with pytest.raises(ValueError, match="orders"):
        O.latest(pages.select("url"))


def test_latest_keeps_rows_without_stamp_when_there_is_no_other(spark):
    rows = spark.createDataFrame([("a", None, 1), ("a", "2", 0), ("b", None, 5), ("b", None, 7)],
                                 "url string, fetched_at string, page_id int")
    assert sorted(tuple(r) for r in O.latest(rows).collect()) == [("a", "2", 0), ("b", None, 7)]


def test_a_shared_page_is_parsed_once(spark, data):
    registry, pages, _ = data
    many = spark.range(300).selectExpr("id as entry", "concat('i', id) as id", "'N' as name", "'T' as type",
                                       "'R, X' as region", "'https://a.org/' as rfp_url", "true as active")
    parts = O.page_parts(many, pages)
    assert parts.where("kind = 'page'").count() == 1
    assert O.enhanced_from(parts, many).count() == 600


def test_no_exchange_carries_a_block_text(spark, data):
    """Once the page is parsed, only facts go through an exchange."""
    registry, pages, docs = data
    parts = O.page_parts(registry, pages, documents=("any",))
    assert not parts.where("kind = 'block' and text is not null").count()
    plan = O.opportunities(*data)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "block_text" not in plan


def test_own_words_and_limits(spark, data):
    registry, pages, _ = data
    words = Words(row=("nothing",), fallback_links=None)
    got = O.base_opportunities(registry, pages, words=words)
    assert ("b", "nothing here") in titles(got)
    assert len([t for t in titles(got) if t[0] == "d"]) == 12
    words = Words(open=("again",), closed=("copper",), description_chars=None, date_label=("due",))
    first = O.enhanced_opportunities(registry, pages, words=words).orderBy("entry", "seq").first()
    assert first.is_active is False or first.dates[0].type == "due"


def test_metrics_of_a_run(spark, data):
    registry, pages, _ = data
    got = {r.entry: tuple(r)[1:] for r in O.run_metrics(
        O.page_parts(registry, pages, documents=("any",)), registry).collect()}
    assert got[0] == ("ok", 3, 3, 0) and got[1] == ("ok", 0, 0, 1)
    assert got[5][0] == "failed" and got[6] == ("uncollected", 0, 0, 0)


def test_inactive_entries_on_request(spark, data):
    got = O.enhanced_opportunities(*data[:2], active_only=False)
    assert {r.utility_id for r in got.select("utility_id").collect()} == {
        "a", "b", "c", "d", "off", "unset"}


def test_portals(spark, data):
    registry, pages, docs = data
    registry = registry.withColumn("scraper_type", F.when(F.col("id") == "a", "pdf"))
    got = O.by_portal(registry, pages, {"pdf": lambda parts, r: O.documents_from(parts, r, docs)},
                      default=O.base_from)
    assert titles(got) == [("a", "Copper Cable Works, full specification")] + FALLBACK


def test_run(spark, data, tmp_path):
    now = datetime(2026, 1, 2, 3, 4, 5)
    found, paths, metrics = run(*data, now=now, folder=str(tmp_path))
    assert set(paths) == {"json", "markdown", "summary"}
    assert paths["json"].endswith("rfp_opportunities_20260102_030405.json")
    assert found.count() == 14
    assert metrics.where("status <> 'ok'").count() == 2
    one, none, _ = run(*data, now=now, utility_id="off")
    assert titles(one)[0][0] == "off" and none == {}
    with pytest.raises(LookupError):
        run(*data, now=now, utility_id="nope")


def test_registry_file(spark, tmp_path):
    path = tmp_path / "registry.json"
    path.write_text("""{"utilities": [
        {"id": "a", "name": "A", "rfp_url": "https://a", "active": true, "max_pdfs_to_extract": 3},
        {"id": "b", "name": "B", "rfp_url": "https://b"},
        {"id": "a", "name": "A2", "rfp_url": "", "active": true}]}""")
    reg = REG.read_registry(spark, str(path))
    assert [(r.entry, r.name, r.has_pdfs) for r in reg.orderBy("entry").collect()] == [
        (0, "A", None), (1, "B", None), (2, "A2", None)]
    assert [r.name for r in REG.usable(reg).collect()] == ["A"]
    assert [r.name for r in REG.usable(reg, active_only=False).orderBy("entry").collect()] == ["A", "B"]
    assert [r.name for r in REG.by_id(reg, "a").collect()] == ["A"]
    assert REG.by_id(reg, "z").count() == 0


def test_a_page_that_landed_twice_is_parsed_once(spark, data):
    from pyspark.sql import Observation
    registry, pages, docs = data
    seen, again = Observation("once"), Observation("twice")
    O.page_parts(registry, pages, observe=seen).count()
    parts = O.page_parts(registry, pages.union(pages).union(pages), observe=again)
    assert again.get == seen.get and seen.get["n_pages"] == parts.where("kind = 'page'").count() > 0
    assert titles(O.opportunities(registry, pages.union(pages), docs.union(docs))) == titles(O.opportunities(*data))


def test_one_fetch_is_what_latest_keeps(spark):
    rows = spark.createDataFrame(
        [("a", None, 1, "x"), ("a", "2", 0, "y"), ("a", "2", 0, "y"), ("b", None, 7, "p"), ("b", None, 7, "q"),
         (None, "1", 1, "n")], "url string, fetched_at string, page_id int, html string")
    want = {tuple(r) for r in O.latest(rows, body="html").collect()}
    got = [tuple(r) for r in O.one_fetch(rows, body="html").where("url is not null").collect()]
    assert sorted(got) == sorted(want) and len(got) == 2
    plan = O.one_fetch(rows, body="html")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in plan.split("Exchange")[1]
