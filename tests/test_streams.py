"""Streams over files as they land: late, repeated and missing ones."""

from datetime import datetime, timedelta

import pytest

from noticeloom.streaming.changes import compared_runs, follow_runs
from noticeloom.streaming.late_documents import DOCUMENT, PAGE, follow_documents

DAY = timedelta(days=1)
RUN = "run_ts timestamp, utility_id string, title string, seq long, url string"


def day(n, hours=0):
    return datetime(2026, 1, n, hours)


@pytest.fixture
def runs(spark, tmp_path):
    """``land`` writes a file, ``follow`` reads what has landed and returns all changes so far."""
    def land(n, *rows, hours=0):
        spark.createDataFrame([(day(n, hours), *r) for r in rows], RUN).coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))

    def follow():
        found = follow_runs(spark, str(tmp_path / "in"), RUN, str(tmp_path / "out"), str(tmp_path / "progress"),
                            every=DAY, late=1.5 * DAY, files_per_batch=1)
        return sorted(((r.utility_id, r.norm_title, r.run_ts.day, r.change) for r in found.collect()), key=repr)
    return land, follow


def test_changes_of_runs_in_any_order(runs):
    land, follow = runs
    land(1, ("u", "A", 1, "x"), ("u", "b", 2, "y"), (None, None, 3, "z"))
    land(2, ("u", " a ", 1, "x"))
    first = follow()
    assert first in ([], [(None, None, 1, "new"), ("u", "a", 1, "new"), ("u", "b", 1, "new")])
    land(3, ("u", "A", 1, "x"), ("u", "c", 9, "c"), ("u", "C", 8, "first counts"))
    land(2, ("u", "B", 2, "moved"))   # after a file of the next run
    land(3, ("u", "A", 1, "x"), ("u", "c", 9, "c"), ("u", "C", 8, "first counts"))   # again
    land(5, ("u", "a", 1, "x"), ("u", "C", 1, "first counts"))
    land(9, (None, "end", 1, None))
    got = follow()
    assert got == sorted([
        (None, None, 1, "new"), (None, None, 2, "gone"), ("u", "a", 1, "new"), ("u", "a", 4, "gone"),
        ("u", "a", 5, "new"), ("u", "a", 6, "gone"), ("u", "b", 1, "new"), ("u", "b", 2, "changed"),
        ("u", "b", 3, "gone"), ("u", "c", 3, "new"), ("u", "c", 4, "gone"), ("u", "c", 5, "new"),
        ("u", "c", 6, "gone")], key=repr)
    # What lands too late is dropped, and a call without new files changes nothing.
    land(1, ("u", "late", 1, "x"))
    assert follow() == got == follow()


def test_of_runs_close_to_each_other_the_last_counts(runs):
    land, follow = runs
    land(1, ("u", "a", 1, "x"), ("u", "b", 1, "x"), ("u", "c", 1, "x"))
    land(1, ("u", "a", 1, "y"), ("u", "b", 1, "y"), hours=6)
    land(1, ("u", "a", 1, "y"), ("u", "b", 1, "x"), ("u", "c", 1, "x"), hours=12)
    land(9, ("u", "end", 1, "x"))
    assert follow() == sorted([
        *(("u", t, 1, "new") for t in "abc"), ("u", "a", 1, "changed"), ("u", "b", 1, "changed"),
        ("u", "b", 1, "changed"), *(("u", t, 2, "gone") for t in "abc")], key=repr)


def test_a_run_just_complete_says_what_is_gone(runs):
    land, follow = runs
    land(1, ("u", "a", 1, "x"), ("u", "b", 1, "x"))
    land(2, ("u", "b", 1, "x"))
    land(3, ("u", "end", 1, "x"), hours=12)
    assert follow() == sorted([("u", "a", 1, "new"), ("u", "b", 1, "new"), ("u", "a", 2, "gone")], key=repr)


def test_runs_are_compared_without_python(spark, tmp_path):
    spark.createDataFrame([], RUN).write.parquet(str(tmp_path / "in"))
    found = spark.readStream.schema(RUN).parquet(str(tmp_path / "in"))
    text = compared_runs(found, DAY, DAY)._jdf.queryExecution().analyzed().toString()
    assert "Join FullOuter" in text and "InPandas" not in text


def test_a_number_of_a_content_moves_and_old_state_goes(runs, spark, tmp_path):
    land, follow = runs
    land(1, ("u", "a", 1, "x"))
    follow()
    assert spark.conf.get("spark.sql.streaming.minBatchesToRetain") == "2"
    found = spark.readStream.schema(RUN).parquet(str(tmp_path / "in"))
    assert {"now": "bigint", "was": "bigint"}.items() <= dict(compared_runs(found, DAY, DAY).dtypes).items()


REGISTRY = "entry long, rfp_url string, active boolean, max_pdfs_to_extract int"


def test_documents_that_land_late_twice_or_never(spark, tmp_path):
    pages, documents = str(tmp_path / "pages"), str(tmp_path / "documents")
    registry = spark.createDataFrame([(1, "https://x/a", True, None), (2, "https://x/a", True, 2),
                                      (3, "https://x/b", True, None), (4, "https://x/none", True, None)], REGISTRY)

    def land(path, schema, *rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    def follow():
        return follow_documents(spark, pages, documents, registry, str(tmp_path / "out"), str(tmp_path / "progress"),
                                wait=2 * DAY, late=2 * DAY)

    links = "".join(f"<a href='{n}.pdf'>{n}</a>" for n in ("before", "after", "never", "late"))
    land(documents, DOCUMENT, ("https://x/before.pdf", "before 1/2/2024", {"title": "Before"}, day(9)))
    land(pages, PAGE, ("https://x/a", links, day(10)), ("https://x/b", "<a href='after.pdf'>b</a>", day(10)),
         ("https://x/other", links, day(10)), ("https://x/none", None, day(10)))
    follow()
    land(pages, PAGE, ("https://x/a", links, day(10)))   # the same file again
    land(documents, DOCUMENT, ("https://x/after.pdf", "old text", {}, day(11)),
         ("https://x/after.pdf", "new text", {}, day(12)), ("https://x/never.pdf", None, {}, day(11)))
    follow()
    land(documents, DOCUMENT, ("https://x/late.pdf", "too late", {}, day(13)))
    land(pages, PAGE, ("https://x/end", "", day(28)))
    land(documents, DOCUMENT, ("https://x/end", "", {}, day(28)))
    records, missing = follow()
    got = sorted((r.entry, r.seq & 0xFFFFFFFF, r.title, r.description) for r in records.collect())
    assert got == [(1, 1, "Before", "before 1/2/2024"), (1, 2, "after", "new text"),
                   (2, 1, "Before", "before 1/2/2024"), (2, 2, "after", "new text"), (3, 1, "b", "new text")]
    assert sorted((r.entry, r.document_url) for r in missing.collect()) == [
        (1, "https://x/late.pdf"), (1, "https://x/never.pdf")]


def test_a_document_and_a_link_of_a_shared_page_are_kept_once_and_on_disk(spark, tmp_path):
    pages, documents, progress = (str(tmp_path / d) for d in ("pages", "documents", "progress"))
    registry = spark.createDataFrame([(e, "https://x/a", True, e % 3) for e in range(6)], REGISTRY)
    spark.createDataFrame([("https://x/a", "<a href=1.pdf>1</a><a href=2.pdf>2</a><a href=3.pdf>3</a>", day(10))],
                          PAGE).coalesce(1).write.parquet(pages)
    spark.createDataFrame([(f"https://x/{n}.pdf", f"text {n}", {}, day(10)) for n in range(2, 7)],
                          DOCUMENT).coalesce(1).write.parquet(documents)
    records, missing = follow_documents(spark, pages, documents, registry, str(tmp_path / "out"), progress,
                                        wait=DAY, late=DAY)
    assert sorted((r.entry, r.url) for r in records.collect()) == [(e, "https://x/2.pdf") for e in (2, 5)]
    assert missing.count() == 0   # the first document may still come
    join = spark.read.format("state-metadata").load(progress).where("operatorName = 'symmetricHashJoin'") \
        .select("operatorId").distinct().collect()
    state = {side: spark.read.format("statestore").option("operatorId", join[0].operatorId)
             .option("joinSide", side).load(progress).count() for side in ("left", "right")}
    assert state == {"left": 2, "right": 5}
    assert list((tmp_path / "progress" / "state").rglob("*.zip"))


def test_html_moves_once_and_pages_without_links_leave_no_state(spark, tmp_path):
    from noticeloom.streaming.late_documents import linked_documents
    registry = spark.createDataFrame([(1, "https://x/a", True, 5), (2, "https://x/b", True, 5)], REGISTRY)
    pages, documents, progress = (str(tmp_path / d) for d in ("pages", "documents", "progress"))
    spark.createDataFrame([("https://x/a", "<a href=1.pdf>1</a><a href=2.pdf>2</a>", day(10)),
                           ("https://x/b", "<p>no link", day(10))], PAGE).coalesce(1).write.parquet(pages)
    spark.createDataFrame([("https://x/1.pdf", "text", {}, day(10))], DOCUMENT).coalesce(1).write.parquet(documents)
    streams = [spark.readStream.schema(s).parquet(p) for s, p in ((PAGE, pages), (DOCUMENT, documents))]
    text = linked_documents(*streams, registry, DAY, DAY)._jdf.queryExecution().analyzed().toString()
    below = [text.splitlines()[i:] for i, line in enumerate(text.splitlines()) if "DeduplicateWithinWatermark" in line]
    assert any("MapInArrow" in line for line in below[0]) and "link_no" in below[0][0]
    follow_documents(spark, pages, documents, registry, str(tmp_path / "out"), progress, wait=DAY, late=DAY)
    kept = [spark.read.format("statestore").option("operatorId", r.operatorId).load(progress).count()
            for r in spark.read.format("state-metadata").load(progress).where(
                "operatorName = 'dedupeWithinWatermark'").select("operatorId").distinct().collect()]
    assert sorted(kept) == [1, 2]   # a document, two links
