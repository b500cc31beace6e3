import random
from collections import defaultdict
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from noticeloom.functions.text import date_ranges
from noticeloom.operators.misspelt import _same_remainder, misspelt_titles
from noticeloom.operators.periods import notice_periods, open_by_day


def test_periods_of_a_notice(spark):
    runs = [date(2026, 1, d) for d in (1, 8, 15, 22, 29)]
    seen = {("u", "a"): [0, 1, 3, 4], ("u", "b"): [2], ("v", None): [0, 1, 2, 3, 4], ("u", "c"): [0, 2, 4]}
    rows = [(u, f" {t.upper()} " if t else None, runs[i]) for (u, t), at in seen.items() for i in at for _ in (0, 1)]
    got = notice_periods(spark.createDataFrame(rows, "utility_id string, title string, run_date date")).collect()
    assert sorted(map(tuple, got), key=repr) == sorted([
        ("u", "a", 1, runs[0], runs[1], runs[2], 2), ("u", "a", 2, runs[3], runs[4], None, 2),
        ("u", "b", 1, runs[2], runs[2], runs[3], 1), ("v", None, 1, runs[0], runs[4], None, 5),
        *[("u", "c", k + 1, runs[2 * k], runs[2 * k], runs[2 * k + 1] if k < 2 else None, 1) for k in range(3)],
    ], key=repr)


def test_ranges_in_a_text(spark):
    texts = ["from 1/2/2024 to 1/5/2024 and 2024-02-01 - 2024-02-01", "Jan 5, 2024 through March 7 2024",
             "13/40/2020 to 1/1/2021", "1/5/2024 to 1/2/2024", "11/5/2024 or 1/2/2024", "", None,
             "2024-01-01 – 2024-01-03 until 2024-01-09"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(date_ranges(F.col("t")).alias("r"))
    got = [None if r.r is None else [(x.start, x.end) for x in r.r] for r in df.collect()]
    assert got == [
        [(date(2024, 1, 2), date(2024, 1, 5)), (date(2024, 2, 1), date(2024, 2, 1))],
        [(date(2024, 1, 5), date(2024, 3, 7))], [], [], [], [], None, [(date(2024, 1, 1), date(2024, 1, 3))]]


def test_open_days_against_counting(spark):
    draw = random.Random(4)
    first = date(2023, 12, 20)
    rows = [(draw.choice("ab") if draw.random() < 0.9 else None, first + timedelta(draw.randrange(90)),
             draw.randrange(-3, 200)) for _ in range(400)]
    rows = [(g, a, a + timedelta(n)) for g, a, n in rows] + [("a", None, first), ("a", first, None)]
    want, last = {}, defaultdict(int)
    for day in (first + timedelta(i) for i in range(-1, 400)):
        for g in ("a", "b", None):
            n = sum(x == g and a is not None and b is not None and a <= day <= b for x, a, b in rows)
            if n != last[g]:
                want[g, day] = last[g] = n
    got = open_by_day(spark.createDataFrame(rows, "g string, start date, end date"), ["g"]).collect()
    assert {(r.g, r.day): r.n_open for r in got} == want and len(got) == len(want)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_misspelt_titles_against_all_pairs(spark):
    draw = random.Random(8)
    rows = []
    for k in range(260):
        t = draw.choice(["request for proposal lot ", "tender ", "", "ab", "é"]) + str(draw.randrange(60)) * draw.randrange(3)
        for _ in range(draw.randrange(4)):
            at = draw.randrange(len(t) + 1)
            t = t[:at] + draw.choice(["", "x", "é"]) + t[at + draw.randrange(2):]
        rows.append((draw.choice("uv"), k, draw.choice([t, t.upper(), f" {t} "])))
    rows += [("u", 900, None), ("u", 901, "  "), ("w", 902, "alone")]
    first = {}
    for g, k, t in rows:
        if t and t.strip():
            first.setdefault((g, t.strip().lower()), k)
    names = list(first.items())
    for edits, hot in ((1, 100), (2, 100), (2, 1), (3, 2)):
        want = set()
        for i, ((g, a), s) in enumerate(names):
            for (h, b), t in names[i + 1:]:
                if g == h and abs(len(a) - len(b)) <= edits and distance(a, b) <= edits:
                    want.add((g, min(s, t), max(s, t), distance(a, b)))
        got = misspelt_titles(spark.createDataFrame(rows, "g string, seq long, title string"), ["g"],
                              edits=edits, hot=hot).collect()
        assert len(got) == len(want) and set(map(tuple, got)) == want


def test_a_stock_phrase_does_not_pair_all_titles(spark):
    """3,000 titles with one beginning: candidates after the second segment are few."""
    rows = spark.range(3000).selectExpr(
        "'u' as g", "id as seq", "concat('request for proposal ', md5(string(id div 2)), if(id % 2 = 0, '', 'x')) as title")
    got = misspelt_titles(rows, ["g"]).collect()
    assert sorted((r.first, r.second, r.distance) for r in got) == [(2 * i, 2 * i + 1, 1) for i in range(1500)]


@pytest.mark.parametrize("edits", [1, 2])
def test_titles_that_differ_in_a_number_between_stock_phrases_are_few_pairs(spark, edits):
    numbers = [100_000 + k * 7_919_333 % 900_000 for k in range(120)] + [100_000 + k for k in range(1, 13)]
    titles = [f"Renewal of lot {k} for the town" for k in numbers] + ["renewal of lot 100000 for the towns"]
    rows = spark.createDataFrame([(1, t, k) for k, t in enumerate(titles)], "g int, title string, seq long")
    names = rows.selectExpr("g", "seq as n", "lower(title) as t", "seq as s")
    met = _same_remainder(names, ["g"], edits)
    plain = [t.lower() for t in titles]
    want = {(i, k, d) for i, a in enumerate(plain) for k, b in enumerate(plain[:i]) if 1 <= (d := distance(a, b)) <= edits}
    got = misspelt_titles(rows, ["g"], edits=edits, hot=5)
    assert {(r.second, r.first, r.distance) for r in got.collect()} == want
    assert 10 < len(want) <= met.count() < len(titles) ** 2 / 20


def test_remainders_are_not_rows(spark):
    names = spark.range(50).selectExpr("1 as g", "id as n", "concat('renewal of lot ', id * 7) as t", "id as s")
    plan = _same_remainder(names, ["g"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and plan.count("Exchange") == 1


def test_pairs_are_the_same_in_several_turns(monkeypatch):
    import pyarrow as pa
    from noticeloom.operators import misspelt
    draw = random.Random(5)
    titles = sorted({"lot " + "".join(draw.choice("abé😀") for _ in range(draw.randrange(9))) for _ in range(150)})
    batch = pa.RecordBatch.from_pydict({
        "g": [1] * len(titles), "n": list(range(len(titles))), "t": titles, "s": list(range(len(titles))),
        "gone": pa.array([[]] * len(titles), pa.list_(pa.int32())), "salt": [-7] * len(titles)})
    schema = pa.schema([("g_1", pa.int64()), ("g_2", pa.int64()), ("t1", pa.string()), ("s1", pa.int64()),
                        ("t2", pa.string()), ("s2", pa.int64())])
    found = []
    for held in (8_000_000, 500, 64):
        monkeypatch.setattr(misspelt, "HELD", held)
        out = pa.Table.from_batches(misspelt._pairs(1, 2, "", schema)(iter([batch]))).to_pylist()
        found.append({(min(r["t1"], r["t2"]), max(r["t1"], r["t2"])) for r in out})
    assert found[0] == found[1] == found[2]
    assert {(a, b) for i, a in enumerate(titles) for b in titles[i + 1:] if distance(a, b) <= 2} <= found[0]
