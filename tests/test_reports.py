import glob
import json
from datetime import datetime

import pytest

from noticeloom.plans import reports
from noticeloom.sources import sinks

NOW = datetime(2026, 1, 2, 3, 4, 5)
SCHEMA = ("entry long, seq long, utility string, utility_type string, region string, title string, "
          "description string, url string, source_page string, "
          "dates array<struct<date:string,type:string,context:string>>")
ROWS = [
    (2, 1, "Zeta", "IOU", "Z, USA", "T" * 120, "D" * 400, "https://z/1", "https://z",
     [(d, "x", None) for d in ("1/1/25", "2/2/25", "3/3/25", "4/4/25")]),
    (1, 5, "Alpha", "Crown", "A, Canada", "Second", "d2", None, "https://a", []),
    (1, 2, "Alpha", "Crown", "A, Canada", "First", None, "https://a/1", "https://a", None),
    (3, 1, None, None, None, None, "d", "https://n", None, []),
]

SUMMARY = f"""{'=' * 80}
RFP OPPORTUNITIES REPORT - 2026-01-02 03:04
{'=' * 80}

Total Opportunities Found: 4

Utilities Scraped: 3

{'-' * 80}

Alpha (A, Canada)
  Type: Crown
  Opportunities: 2

  [1] First
      Link: https://a/1

  [2] Second
      Link: N/A


Unknown (N/A)
  Type: N/A
  Opportunities: 1

  [1] Untitled
      Link: https://n


Zeta (Z, USA)
  Type: IOU
  Opportunities: 1

  [1] {'T' * 100}
      Dates: 1/1/25, 2/2/25, 3/3/25
      Link: https://z/1

{'=' * 80}
"""

MARKDOWN_END = f"""## Zeta

**Region:** Z, USA
**Type:** IOU
**Source:** https://z
**Opportunities Found:** 1

### 1. {'T' * 120}

**Summary:** {'D' * 300}...

**Key Dates:** 1/1/25, 2/2/25, 3/3/25, 4/4/25

**More Information:** [https://z/1](https://z/1)

---

"""


@pytest.fixture(scope="module")
def opps(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def read(path):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/part-*")))


def test_all_reports(spark, opps, tmp_path):
    paths = sinks.save_all(opps, str(tmp_path), NOW)
    assert read(paths["summary"]) == SUMMARY
    markdown = read(paths["markdown"])
    assert markdown.startswith("# RFP Opportunities Report\n\n**Generated:** 2026-01-02 03:04\n\n"
                               "**Total Opportunities:** 4\n\n---\n\n## Alpha\n")
    assert markdown.endswith(MARKDOWN_END)
    assert "**Summary:** No description...\n\n**More" in markdown
    assert "[N/A](#)" in markdown
    report = json.loads(read(paths["json"]))
    assert report["generated_at"] == "2026-01-02T03:04:05"
    assert report["total_opportunities"] == 4
    assert [o["title"] for o in report["opportunities"]] == ["First", "Second", "T" * 120, None]


def test_empty_reports(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    paths = sinks.save_all(none, str(tmp_path), NOW)
    assert read(paths["summary"]) == "No RFP opportunities found.\n"
    assert read(paths["markdown"]) == "# RFP Opportunities Report\n\nNo opportunities found.\n"
    assert json.loads(read(paths["json"])) == {
        "generated_at": "2026-01-02T03:04:05", "total_opportunities": 0, "opportunities": []}


def test_records_by_region(spark, opps, tmp_path):
    sinks.save_records(opps, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 4


def test_line_numbers_do_not_depend_on_partitions(spark, opps):
    def lines(df):
        return [tuple(r) for r in reports.summary_lines(df, "g").orderBy(*reports.LINE_ORDER).collect()]
    assert lines(opps) == lines(opps.coalesce(1))


def test_text_is_made_after_the_sort_and_entries_are_numbered_once(spark, opps, tmp_path):
    placed = reports.with_places(opps).localCheckpoint()
    assert {(r.utility, r[reports.PLACE]) for r in placed.collect()} == {
        ("Zeta", 1), ("Alpha", 1), ("Alpha", 2), (None, 1)}
    for made in (reports.summary_lines(placed, "g"), reports.markdown_lines(placed, "g"), reports.json_lines(placed, "g")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        above, below = plan.split("Exchange rangepartitioning")
        assert "lines" in above and "Link: ,\n" not in below
        assert not any(text in below.split("Union")[1] for text in ("      Link: ", "More Information", "to_json"))
        assert "_bucket" not in plan


def test_compressed_reports_are_the_same_documents(spark, opps, tmp_path):
    import gzip
    plain = sinks.save_all(opps, str(tmp_path / "a"), NOW)
    small = sinks.save_all(opps, str(tmp_path / "b"), NOW, compression="gzip")
    for kind, path in small.items():
        files = sorted(glob.glob(f"{path}/part-*"))
        assert all(f.endswith(".gz") for f in files)
        assert gzip.decompress(b"".join(open(f, "rb").read() for f in files)).decode() == read(plain[kind])
