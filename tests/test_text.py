import random
import re

import pytest
from pyspark.sql import functions as F

from noticeloom.functions import text as X, vocab as V


def run(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[1] for r in df.select("i", fn(F.col("t")).alias("r")).orderBy("i").collect()]


def test_plain_dates_by_pattern_then_place(spark):
    got = run(spark, ["Jan 5, 2025 2025-11-15 1/2/25 and 10/30/2025", "none", "",
                      "SEPTEMBER 3 2024, xJan 1 2024"], X.plain_dates)
    assert got == [["1/2/25", "10/30/2025", "2025-11-15", "Jan 5, 2025"], [], [],
                   ["SEPTEMBER 3 2024"]]


def test_iso_date_is_seen_twice_with_context(spark):
    [dates] = run(spark, ["posted 2025-11-15"], X.dates_with_context)
    assert [(d.date, d.type) for d in dates] == [("25-11-15", "posted"), ("2025-11-15", "posted")]


def test_label_is_first_in_list_order_not_in_text(spark):
    [dates] = run(spark, ["posted by the deadline 1/2/2025"], X.dates_with_context)
    assert dates[0].type == "deadline"
    [dates] = run(spark, ["on 1/2/2025"], X.dates_with_context)
    assert dates[0].type == "unknown"


def test_contexts_equal_a_plain_scan(spark):
    rnd = random.Random(7)
    bits = ["1/2/20", "2024-01-02", "May 5, 2020", " ", "until ", "é", "\n", " ", "7"]
    texts = ["".join(rnd.choice(bits + ["x" * rnd.randint(1, 60)]) for _ in range(rnd.randint(1, 40)))
             for _ in range(150)]
    patterns = [re.compile(p.removeprefix("(?iU)"), re.I) for p in V.CONTEXT_DATES]
    for text, got in zip(texts, run(spark, texts, X.dates_with_context)):
        want = []
        for p in patterns:
            for m in p.finditer(text):
                around = text[max(0, m.start() - 50):m.end() + 50].strip()
                label = [k for k in V.DATE_LABELS if k in around.lower()]
                want.append((m.group(), label[0] if label else "unknown", around))
        assert [tuple(d) for d in got] == want


def test_document_dates_capped_per_pattern_distinct_sorted(spark):
    many = " ".join(f"{i}/1/2020" for i in range(1, 13)) + " 2020-01-01 2020-01-01"
    [got] = run(spark, [many], X.document_dates)
    assert got == sorted([f"{i}/1/2020" for i in range(1, 11)] + ["2020-01-01"])


@pytest.mark.parametrize("text, want", [
    ("see RFQ 12 then RFP-7", "RFP-7"),
    ("RFPs are open", "RFPs"),
    ("RFP", None),
    ("the project manager", "project manager"),
    ("forbidden", "bidden"),
    ("Solicitation #: 44-A", "Solicitation #: 44-A"),
    ("Bid: 9", "Bid: 9"),
    ("", None),
])
def test_notice_id(spark, text, want):
    assert run(spark, [text], X.notice_id) == [want]


def test_document_id_has_no_bid_and_looks_at_the_opening(spark):
    assert run(spark, ["Bid: 9", "x" * 1990 + " RFP-12", "x" * 2000 + " RFP-12"],
               X.document_id) == [None, "RFP-12", None]


def test_contact(spark):
    got = run(spark, ["a.b+c@x-y.co.uk or (555) 123-4567", "12345678901", "a@b.c|", "none"],
              X.contact)
    # A blank after the area code is one separator; a TLD may hold a bar.
    assert [tuple(c) for c in got] == [
        ("a.b+c@x-y.co.uk", "(555) 123-4567", None), (None, "1234567890", None),
        (None, None, None), (None, None, None)]


@pytest.mark.parametrize("text, dated, want", [
    ("closed but open", 0, False),
    ("inactive", 0, True),
    ("disclosed", 1, False),
    ("nothing", 1, True),
    ("nothing", 0, False),
    ("Now Accepting", 0, True),
    ("CANCELED", 1, False),
])
def test_status(spark, text, dated, want):
    dates = F.array(*[F.lit("d")] * dated)
    assert run(spark, [text], lambda t: X.is_active(t, dates)) == [want]


def test_keyword_is_a_substring_ignoring_case(spark):
    assert run(spark, ["FORBIDDEN", "x", "PerfoRmance"], lambda t: X.contains_any(t, ("bid", "rfo"))) == [
        True, False, True]


@pytest.mark.parametrize("meta, link, text, want", [
    ("M", "L", "T", "M"),
    ("", "L", "T", "L"),
    (None, "L", "T", "L"),
    ("Untitled", "L", "T\nU", "T"),
    (None, "", "T\nU", "T"),
    (None, "Untitled", "T", "T"),
    (None, None, "\nU", "PDF RFP Document"),
    (None, "", "", "PDF RFP Document"),
    (None, "", "x" * 300, "x" * 200),
])
def test_document_title(spark, meta, link, text, want):
    df = spark.createDataFrame([(meta, link, text)], "m string, l string, t string")
    got = df.select(X.document_title(F.col("m"), F.col("l"), F.col("t"))).first()[0]
    assert got == want


def test_strip_and_word_count(spark):
    assert run(spark, ["  A b\t\n", "", "  "], X.strip) == ["A b", "", ""]
    assert run(spark, ["a  b\nc", "", " \t", "a b"], X.word_count) == [3, 0, 0, 2]
    assert run(spark, [" RFP "], X.norm_title) == ["rfp"]


def test_date_value(spark):
    got = run(spark, ["10/3/1998", "13/45/2025", "2025-11-15", "December 1 2024", "JAN 3, 2020",
                      "5-5-25", "Sept 5 2021", "25-11-15"], lambda t: X.date_value(t).cast("string"))
    assert got == ["1998-10-03", None, "2025-11-15", "2024-12-01", "2020-01-03", "2025-05-05",
                   "2021-09-05", None]


def test_months_are_found_as_without_the_look_ahead(spark):
    odd = ["on may 3, 2020", "MAY 3 2020 mayor 4 2021", "xMay 3 2020", "ſep 1, 2020", "9Jun 1 2020 Jun 2 2020",
           "éOct 3 2020", "decade 1 2020", "Jan 1, 2020", "OKt 3 2020", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    for now, before in ((V.PLAIN_DATES[2], r"(?iU)\b" + V.MONTH_DATE), (V.CONTEXT_DATES[2], r"(?iU)" + V.MONTH_DATE)):
        assert now != before
        assert rows.where(~X.all_matches(F.col("t"), now).eqNullSafe(X.all_matches(F.col("t"), before))).count() == 0
    assert rows.where(F.size(X.all_matches(F.col("t"), V.PLAIN_DATES[2])) > 0).count() == 6


def test_dates_of_a_document_are_compiled_so_that_columns_share_them(spark):
    t = F.col("id").cast("string")
    both = spark.range(1).select(X.document_dates(t), X.document_dates(t, per_pattern=None))
    assert "*(1) Project" in both._jdf.queryExecution().executedPlan().toString()
