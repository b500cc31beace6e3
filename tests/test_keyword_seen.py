import pytest

from noticeloom.operators import keyword_table
from noticeloom.operators.keyword_table import find_terms
from noticeloom.streaming.seen import SeenStore

TEXTS = [(1, "Request for PROPOSAL 17", "x"), (2, "", "x"), (3, None, "x"), (None, "proposal", "y"), (None, "propos", "y"),
         (4, "straße ß q", "x"), (5, "q" * 5000 + "lot77", "x"), (5, "lot78", "x")]
TERMS = ["proposal", "PROPOSAL", "q", "", None, "ß", "posal 17", "lot77", "lot78", "for", "reques", "nothing here"]


def want(texts, terms):
    known = {t.lower() for t in terms if t}
    return sorted(((k, o, t) for k, x, o in texts for t in known if x and t in x.lower()), key=repr)


@pytest.mark.parametrize("hot", [1, 50])
def test_terms_against_contains(spark, hot):
    texts = spark.createDataFrame(TEXTS, "doc long, text string, run string")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    # The column named like the operator's own stays.
    got = find_terms(texts, terms, ["doc"], hot=hot)
    assert got.columns == ["doc", "run", "term"]
    assert sorted(map(tuple, got.collect()), key=repr) == want(TEXTS, TERMS)


def test_many_terms_are_joined_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(keyword_table, "MOST_BROADCAST", 0)
    texts = spark.createDataFrame(TEXTS, "doc long, text string, run string")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    assert sorted(map(tuple, find_terms(texts, terms, ["doc"]).collect()), key=repr) == want(TEXTS, TERMS)


def test_a_text_is_lower_cased_once(spark):
    texts = spark.createDataFrame(TEXTS, "doc long, text string, run string")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    plan = find_terms(texts, terms, ["doc"])._jdf.queryExecution().optimizedPlan().toString()
    [join] = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "Contains(_low" in join and "lower(" not in join


def test_no_terms(spark):
    texts = spark.createDataFrame(TEXTS, "doc long, text string, run string")
    none = spark.createDataFrame([(None,), ("",)], "term string")
    assert find_terms(texts, none, ["doc"]).collect() == []


def test_seen_store_reads_only_the_buckets_it_needs(spark, tmp_path):
    store = SeenStore(spark, str(tmp_path / "seen"), buckets=32)
    pages = spark.range(400).selectExpr("id", "concat('https://x/', id) as url")
    assert store.unseen(pages).count() == 400
    store.add(pages.where("id < 200"), "first")
    some = pages.where("id in (5, 350, 351)")
    assert sorted(r.id for r in store.unseen(some).collect()) == [350, 351]
    few = store.known([3, 4])
    assert "PartitionFilters: [bucket" in few._jdf.queryExecution().executedPlan().toString()
    files = few.select("_metadata.file_path").distinct().count()
    assert 0 < files < store.known().select("_metadata.file_path").distinct().count()
    assert {r.bucket for r in few.select("bucket").distinct().collect()} <= {3, 4}
    # A run that is repeated replaces its own.
    store.add(pages.where("id < 200"), "first")
    assert store.known().count() == 200


def test_seen_store_is_exact_when_its_filters_are_full(spark, tmp_path):
    store = SeenStore(spark, str(tmp_path / "full"), buckets=2, bits=8)
    pages = spark.range(300).selectExpr("id", "concat('https://x/', id) as url").unionByName(
        spark.sql("select -1L as id, cast(null as string) as url"))
    store.add(pages.where("id % 2 = 0"), "a")
    assert sorted(r.id for r in store.unseen(pages).collect()) == [-1, *range(1, 300, 2)]


def test_runs_of_texts_and_what_they_meet_do_not_move(spark):
    texts = spark.createDataFrame(TEXTS, "doc long, text string, run string")
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    plan = find_terms(texts, terms, ["doc"])._jdf.queryExecution().executedPlan().toString()
    # Above the exchanges of texts and terms, both by bucket alone, there is no other.
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line and "_h#" not in line]
    assert len(dealt) == 2 and all("REPARTITION_BY_NUM" in line for line in dealt)


def test_many_texts_against_contains(spark):
    rows = [(i, "".join(chr(97 + (i * k * k + k) % 23) for k in range(i % 60)), "x") for i in range(400)]
    terms = [r[1][i % 7:i % 7 + 1 + i % 9] for i, r in enumerate(rows)] + ["ab", "zz"]
    got = find_terms(spark.createDataFrame(rows, "doc long, text string, run string").repartition(3),
                     spark.createDataFrame([(t,) for t in terms], "term string"), ["doc"], hot=3)
    assert sorted(map(tuple, got.collect()), key=repr) == want(rows, terms)
