import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from noticeloom.llm import suffix_dedup as sd
from noticeloom.llm.suffix_array import suffix_array
from noticeloom.llm.suffix_dedup import suffix_dedup


def brute(rows, k):
    seen = defaultdict(list)
    data = [(t or "").encode() for _, t in rows]
    for p, d in enumerate(data):
        for s in range(len(d) - k + 1):
            seen[d[s:s + k]].append((p, s))
    gone = [np.zeros(len(d), bool) for d in data]
    for places in seen.values():
        if len(places) > 1:
            for p, s in places:
                gone[p][s:s + k] = True
    return sorted([(i, len(d), int(g.sum()), int((np.diff(np.append(0, g.astype(int))) == 1).sum()),
                    hashlib.sha256(bytes(b for b, x in zip(d, g, strict=True) if not x)).hexdigest())
                   for (i, _), d, g in zip(rows, data, gone, strict=True)], key=repr)


def result(df):
    return sorted(map(tuple, df.drop("kept").collect()), key=repr)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=40))
def test_suffix_array(symbols):
    text = [*symbols, 0]
    assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_repeats_is_fast():
    rng = random.Random(2)
    block = [rng.randint(1, 2000) for _ in range(20_000)]
    for text in ([*block, 2001, *block, *block, 0], [1] * 60_000 + [0], [1, 2] * 30_000 + [0]):
        array = suffix_array(text)
        assert sorted(array) == list(range(len(text)))
        pairs = [(text[i:i + 50], text[j:j + 50]) for i, j in zip(array[:500], array[1:501])]
        assert all(a <= b for a, b in pairs)


def test_whole_table(make_docs, odd_rows):
    docs = make_docs(odd_rows).repartition(3).cache()
    order = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(suffix_dedup(docs)) == brute(order, 400)


def mixed(seed, n):
    rng = random.Random(seed)
    shared = ["".join(rng.choices("abcdé ", k=rng.randint(10, 200))) for _ in range(4)]
    return [(rng.randint(0, 50), "".join(
        rng.choice([*shared, "".join(rng.choices("abcd", k=rng.randint(0, 60)))])
        for _ in range(rng.randint(0, 5)))) for _ in range(n)]


@pytest.mark.parametrize("length, gram", [(40, 8), (12, 3), (8, 8)])
def test_shared_strings(make_docs, length, gram, monkeypatch):
    rows = [*mixed(length, 120), (1, "ab" * 200), (2, "a" * 300), (3, None), (None, "a" * 39)]
    assert result(suffix_dedup(make_docs(rows), length=length, gram=gram)) == brute(rows, length)


def test_one_bucket_against_brute_force(monkeypatch):
    """All runs of one text meet, with every trigger density and with equal hashes of rests."""
    for every in (1, 4, 1000):
        monkeypatch.setattr(sd, "EVERY", every)
        for seed in range(6):
            rows = mixed(seed, 25)
            strings = sorted({t.encode() for _, t in rows if len(t.encode()) >= 24})
            meta = np.array([[0, i, 0, len(s) - 23, 7, 0] for i, s in enumerate(strings)])
            rid, start, end = sd.repeated_strings(
                meta, np.array(list(map(len, strings))), b"".join(strings), 24)
            got = {(int(r), i) for r, a, b in zip(rid, start, end, strict=True) for i in range(a, b)}
            seen = defaultdict(list)
            for i, s in enumerate(strings):
                for a in range(len(s) - 23):
                    seen[s[a:a + 24]].append((i, a))
            want = {(i, a + x) for p in seen.values() if len(p) > 1 for i, a in p for x in range(24)}
            assert got == want


def test_rests_that_share_a_hash(monkeypatch):
    monkeypatch.setattr(sd, "mix", lambda x: np.zeros(len(x), np.uint64))
    test_one_bucket_against_brute_force(monkeypatch)


def test_empty_and_clashing_columns(spark, make_docs):
    assert suffix_dedup(make_docs([])).collect() == []
    docs = spark.createDataFrame([(1, "ab", 1, 2)], "doc_id long, text string, rid int, kept int")
    assert [bytes(r.kept) for r in suffix_dedup(docs).collect()] == [b"ab"]
