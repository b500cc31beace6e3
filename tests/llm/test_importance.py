import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from noticeloom.llm import importance
from noticeloom.llm.importance import features, importance_scores, joined_crc, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_features(text):
    words = WORD.findall(low(text))
    runs = [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def brute(docs, target, share=(5, 100)):
    found = [(i, *brute_features(t)) for i, t in docs]
    s = Counter(b for _, _, f in found for b in f)
    t = Counter(b for x in target for b in brute_features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (big_s + 10000)) / ((s[b] + 1) * (big_t + 10000))))
            for b in range(10000)]
    rows = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), weight,
                     weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20),
                  key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[1], -r[3]))
    drawn = able[:len(able) * share[0] // share[1]]
    out = [(*r, k + 1) for k, r in enumerate(drawn)]
    out += [(*r, None) for r in able[len(drawn):]] + [(*r, None) for r in rows if r[1] < 20]
    return sorted(out, key=repr)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text("aZ9é ß-\n\x7fİ👍", max_size=60), max_size=4))
def test_features_against_the_definition(texts):
    got = [(n, sorted(f.tolist())) for n, f in features(texts)] if texts else []
    assert got == [(n, sorted(f)) for n, f in map(brute_features, texts)]


@given(st.binary(max_size=20), st.binary(max_size=700))
def test_checksums_of_joined_strings(a, b):
    got = joined_crc(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32),
                     np.array([len(b)]))
    assert int(got[0]) == zlib.crc32(a + b)


def test_long_texts_go_in_pieces(monkeypatch):
    text = "Alpha beta, " * 300 + "x" * 5000 + " gamma"
    whole = features([text])[0]
    monkeypatch.setattr(importance, "PIECE", 37)
    cut = features([text])[0]
    assert whole[0] == cut[0] and sorted(whole[1].tolist()) == sorted(cut[1].tolist())
    assert list(importance.words_with_offsets("ab cd" * 20))[-1][-1][1][1] == 100


def test_documents(make_docs, odd_rows, spark):
    target = ["the and attion", None, "", "The THE the hahand"]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    got = importance_scores(make_docs(odd_rows), items).collect()
    assert sorted(map(tuple, got), key=repr) == brute(odd_rows, target)


def test_draw_of_a_larger_share(make_docs, small_texts, spark):
    items = spark.createDataFrame([("the and",)], "text string")
    got = importance_scores(make_docs(small_texts), items, share=(1, 2)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(small_texts, ["the and"], (1, 2))
    drawn = [r.rank for r in got if r.rank]
    assert sorted(drawn) == list(range(1, len(drawn) + 1)) and len(drawn) > 60


def test_empty_tables(make_docs, spark):
    none = spark.createDataFrame([], "text string")
    assert importance_scores(make_docs([]), none).collect() == []
    got = importance_scores(make_docs([(1, None), (2, "a b c")]), none).collect()
    assert [(r.doc_id, r.n_features, r["rank"]) for r in sorted(got)] == [(1, 0, None), (2, 6, None)]


def test_rows_that_are_drawn(spark, small_texts):
    rows = [(i % 50, t, "x", 1) for i, (_, t) in enumerate(small_texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _rid string, draw_rank int")
    items = spark.createDataFrame([("the and",)], "text string")
    out = resample(docs, items, share=(1, 4))
    assert out.columns == ["doc_id", "text", "_rid", "draw_rank", "draw_rank_"]
    want = [r for r in brute([(i, t) for i, t, *_ in rows], ["the and"], (1, 4)) if r[-1]]
    assert sorted((r.draw_rank_, r.doc_id) for r in out.collect()) == sorted((r[-1], r[0]) for r in want)
