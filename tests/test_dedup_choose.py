import random

import pytest
from pyspark.sql import functions as F

from noticeloom.operators import choose, dedup


def keep_by_loop(rows):
    """Rows (group, seq, title, droppable) in order; drop what an earlier kept title contains."""
    kept = []
    for g, s, t, d in sorted(rows):
        if d and any(t.lower() in u.lower() for h, _, u, _ in kept if h == g):
            continue
        kept.append((g, s, t, d))
    return kept


def random_titles(rnd, n, words):
    rows = []
    for s in range(n):
        title = " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 9)))
        a = rnd.randint(0, 3)
        rows.append((rnd.choice("ab"), s, title[a:a + rnd.randint(1, 60)], rnd.random() < 0.8))
    return [r for r in rows if r[2]]


@pytest.mark.parametrize("seed", range(4))
def test_contained_titles_equal_the_loop(spark, seed):
    rnd = random.Random(seed)
    words = ["RFP", "rfp", "supply", "of", "x", "aaaa", "Électricité", "bid", "notice 12"][:3 + 2 * seed]
    rows = random_titles(rnd, 300, words)
    df = spark.createDataFrame(rows, "g string, seq long, title string, d boolean").repartition(3)
    got = dedup.drop_contained(df, ["g"], droppable=F.col("d"))
    assert sorted(map(tuple, got.collect())) == keep_by_loop(rows)


def test_contained_edges(spark):
    rows = [
        ("a", 1, "Exactly fifteen", True), ("a", 2, "exactly FIFTEEN", True),
        ("a", 3, "sixteen letters!", True), ("a", 4, "xx sixteen letters! yy", True),
        ("a", 5, "sixteen letters!", True), ("a", 6, "", True),
        ("b", 1, "", True), ("b", 2, "kept although contained: b", False), ("b", 3, "b", True),
        ("c", 1, "a" * 40, True), ("c", 2, "a" * 17, True), ("c", 3, "a" * 41, True),
        ("d", 1, "b", True), ("d", 2, "b", False),
    ]
    df = spark.createDataFrame(rows, "g string, seq long, title string, d boolean")
    got = dedup.drop_contained(df, ["g"], droppable=F.col("d"))
    assert sorted(map(tuple, got.collect())) == keep_by_loop(rows)


def test_one_group_of_copies_stays_linear(spark):
    """A third of the rows share one title; joined rows grow with the table, not its square."""
    n = 6000
    df = spark.range(n).selectExpr(
        "if(id % 50 = 49, 'b', 'a') as g", "id as seq",
        "if(id % 3 = 0, 'Request for proposal number 7 copies', "
        "concat('Request for proposal number ', id, ' of many')) as title")
    copies = df.where("seq % 3 = 0")
    groups = copies.select("g").distinct().count()
    assert dedup.drop_contained(df, ["g"]).count() == n - n // 3 + groups
    plan = dedup.drop_contained(df, ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan


def test_first_per_title(spark):
    rows = [("a", 3, " RFP "), ("a", 1, "rfp "), ("a", 2, "other"), ("b", 9, "RFP")]
    df = spark.createDataFrame(rows, "g string, seq long, title string")
    once = dedup.first_per_title(df, ["g"])
    assert sorted((r.g, r.seq) for r in once.collect()) == [("a", 1), ("a", 2), ("b", 9)]
    assert sorted(map(tuple, dedup.first_per_title(once, ["g"]).collect())) == sorted(
        map(tuple, once.collect()))


def test_first_n(spark):
    df = spark.range(60).selectExpr("id % 3 as g", "id as seq", "int(id % 3 * 2) as n")
    assert choose.first_n(df, ["g"], 2).count() == 6
    got = choose.first_n(df, ["g"], F.col("n"), at_most=4).groupBy("g").count().collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 4)]


def test_limits_prune_before_the_shuffle(spark):
    df = spark.range(60).selectExpr("id % 3 as g", "id as seq", "int(id % 3 * 2) as n",
                                    "'t' as title")
    for limited in (choose.first_n(df, ["g"], 2), choose.first_n(df, ["g"], F.col("n"), at_most=4),
                    dedup.first_per_title(df, ["g"])):
        assert "WindowGroupLimit" in limited._jdf.queryExecution().executedPlan().toString()


def test_best_tier(spark):
    df = spark.createDataFrame([("a", 2), ("a", 3), ("a", 2), ("b", 3)], "g string, tier int")
    assert sorted(map(tuple, choose.best_tier(df, ["g"]).collect())) == [
        ("a", 2), ("a", 2), ("b", 3)]


def test_numbering_across_buckets(spark):
    rnd = random.Random(3)
    rows = sorted({(rnd.choice("aaab"), rnd.randint(0, 5000)) for _ in range(900)})
    df = spark.createDataFrame(rows, "g string, seq long").repartition(5)
    got = choose.number_within(df, ["g"], ["seq"], F.shiftright("seq", 7))
    seen = {}
    want = []
    for g, s in rows:
        seen[g] = seen.get(g, 0) + 1
        want.append((g, s, seen[g]))
    assert sorted((r.g, r.seq, r.idx) for r in got.collect()) == want


def test_similar_titles_against_all_pairs(spark):
    import random
    rng = random.Random(3)
    vocab = ["supply", "of", "cable", "poles", "meters", "rfp", "2024", "lot", "a", "b", "grid"]
    rows = [(g, i, " ".join(rng.choices(vocab, k=rng.randint(0, 6)))) for g in "xy" for i in range(120)]
    rows += [("x", 500, None), ("x", 501, "")]
    df = spark.createDataFrame(rows, "g string, seq long, title string")
    for threshold in (0.6, 0.8, 1.0):
        got = {(r.g, r.first, r.second) for r in
               dedup.similar_titles(df, ["g"], threshold=threshold).collect()}
        sets = {}
        for g, i, t in rows:
            words = frozenset((t or "").split())
            if len(words) > 1:
                sets.setdefault((g, words), i)
        want = {(g, min(i, j), max(i, j)) for (g, a), i in sets.items() for (h, b), j in sets.items()
                if g == h and i < j and len(a & b) >= threshold * len(a | b) - 1e-9}
        assert got == want
    with pytest.raises(ValueError):
        dedup.similar_titles(df, ["g"], threshold=0.5)


def test_similar_titles_of_a_hot_group_are_not_paired(spark):
    """Titles that share their frequent words only never meet."""
    from pyspark.sql import functions as F
    df = spark.range(30_000).select(F.lit("hot").alias("g"), F.col("id").alias("seq"), F.concat(
        F.lit("request for proposal number "), F.col("id").cast("string"), F.lit(" lot "),
        (F.col("id") * 7).cast("string"), F.lit(" of "), (F.col("id") * 13 + 1).cast("string")).alias("title"))
    assert dedup.similar_titles(df, ["g"]).count() < 50


def test_a_title_does_not_move_to_meet_itself(spark):
    """Without copies and contained titles nothing is grouped by the titles cut out."""
    rows = [("a", i, f"Request for proposal number {i:04d} lot") for i in range(40)] + [("a", 90, "short"), ("b", 91, "short")]
    df = spark.createDataFrame(rows, "g string, seq long, title string")
    kept = dedup.drop_contained(df, ["g"])
    assert sorted(map(tuple, kept.collect())) == sorted(rows)
    assert "copied#" in kept._jdf.queryExecution().executedPlan().toString()
    twice = spark.createDataFrame([*rows, ("a", 99, "SHORT"), ("b", 98, "lot")], "g string, seq long, title string")
    assert sorted(r.seq for r in dedup.drop_contained(twice, ["g"]).collect()) == [*range(40), 90, 91, 98]
