import hashlib
import re
from collections import defaultdict

from noticeloom.llm.exact_dedup import drop_exact_copies, exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for place, (i, text) in enumerate(rows):
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[norm].append((-len(text or ""), i is None, i or 0, place, i))
    out = []
    for norm, members in groups.items():
        keep = min(members)
        for m in members:
            out.append((m[4], keep[4], len(members), m[3] == keep[3],
                        hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.drop("rid").collect()), key=repr)


def test_against_brute_force(make_docs, odd_rows):
    for block in (7, 2048):
        assert result(exact_dedup(make_docs(odd_rows), block_chars=block)) == brute(odd_rows)


def test_pairs_of_blocks_that_differ_in_order(make_docs):
    rows = [(1, "aabb"), (2, "bbaa"), (3, "aa bb"), (4, "aabbaa"), (5, "aabbaabb"), (6, "")]
    assert result(exact_dedup(make_docs(rows), block_chars=2)) == brute(rows)


def test_a_hot_text_is_dealt(make_docs):
    rows = [(i, "the same text of two blocks" if i % 3 else f"text {i}") for i in range(3600)]
    got = exact_dedup(make_docs(rows), block_chars=16)
    assert result(got) == brute(rows)


def test_empty_table(make_docs):
    assert exact_dedup(make_docs([])).collect() == []
    assert drop_exact_copies(make_docs([])).collect() == []


def test_drop_keeps_columns_and_one_row_of_each_group(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = drop_exact_copies(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r[3] for r in brute(odd_rows))


def test_names_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6), (2, "ab", 7, 8)],
                                 "doc_id long, text string, rid int, norm int")
    assert sorted(r.keep_id for r in exact_dedup(docs).collect()) == [1, 1]


def test_main_path_has_no_python(make_docs):
    plan = exact_dedup(make_docs([(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
