import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from noticeloom.llm import substring_dedup as sd
from noticeloom.llm import superkmers as sk
from noticeloom.llm.substring_dedup import substring_dedup


def brute(rows, k):
    seen = defaultdict(list)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for p, (i, _) in enumerate(rows):
        for s in range(len(words[p]) - k + 1):
            seen[tuple(words[p][s:s + k])].append((i is None, i or 0, p, s))
    gone = [set() for _ in rows]
    for places in seen.values():
        for *_, p, s in sorted(places)[1:]:
            gone[p].update(range(s, s + k))
    return sorted([(i, len(w), len(g), hashlib.sha256(
        " ".join(x for j, x in enumerate(w) if j not in g).encode()).hexdigest())
        for (i, _), w, g in zip(rows, words, gone, strict=True)], key=repr)


def result(df):
    return sorted(map(tuple, df.collect()), key=repr)


def passages(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    shared = [" ".join(rng.choices(vocab, k=rng.randint(5, 60))) for _ in range(4)]
    out = []
    for i in range(n):
        parts = [rng.choice([*shared, " ".join(rng.choices(vocab, k=rng.randint(0, 30)))])
                 for _ in range(rng.randint(0, 4))]
        out.append((rng.randint(0, 30), rng.choice([" ", "\n", "\x0b \t"]).join(parts)))
    return out


def test_whole_tables(make_docs, odd_rows):
    docs = make_docs(odd_rows).repartition(3).cache()
    order = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(substring_dedup(docs, digest=True)) == brute(order, 20)


@pytest.mark.parametrize("window, gram", [(20, 4), (5, 2), (3, 3), (1, 1)])
def test_shared_passages(make_docs, window, gram):
    rows = [*passages(window, 150), (None, "a b c d e f"), (None, "a b c d e f"), (7, "x " * 80),
            (8, "x y " * 50)]
    assert result(substring_dedup(make_docs(rows), window=window, gram=gram, digest=True)) == brute(
        rows, window)


def test_hot_grams(make_docs, monkeypatch):
    rows = passages(3, 150)
    seen = []

    def some_hot(df, cut, window, gram, share):
        units = cut([t for _, t in rows])
        hot, n = np.unique(sk.window_hashes(units.code, gram) >> np.uint64(1), return_counts=True)
        seen.append(int((n > 3).sum()))
        return sk.Plan(window, gram, 5, hot[n > 3])

    monkeypatch.setattr(sd, "plan_buckets", some_hot)
    assert result(substring_dedup(make_docs(rows), window=6, gram=2, digest=True)) == brute(rows, 6)
    assert seen[0] > 5


def test_long_texts_are_ranked_in_pieces(make_docs, monkeypatch):
    rows = passages(9, 80)
    whole = sk.Plan(6, 2, 5, np.zeros(0, np.uint64))
    units = sd.cut_words([t for _, t in rows])
    n = whole.find_runs(units)[1].sum()
    monkeypatch.setattr(sk, "PIECE", 7)
    first, windows, _ = whole.find_runs(units)
    assert windows.sum() == n and len(set(first.tolist())) == len(first)
    # Pieces are set in this process only; Spark's workers rank whole chunks.
    monkeypatch.undo()
    assert result(substring_dedup(make_docs(rows), window=6, gram=2, digest=True)) == brute(rows, 6)


def test_frequent_grams_are_found(make_docs):
    rows = [(i, f"{i} this passage is in every single text {i}") for i in range(3000)]
    from pyspark.sql import functions as F
    docs = make_docs(rows).select(F.monotonically_increasing_id().alias("rid"),
                                  F.col("doc_id").alias("id"), "text")
    plan = sk.plan_buckets(docs, sd.cut_words, 6, 3, share=1)
    assert len(plan.hot) == 5


def test_equal_hashes_of_different_windows(monkeypatch):
    rng = random.Random(1)
    words = [rng.choice("abc") for _ in range(300)]
    meta = np.array([[1, 1, 0, 297]], np.int64)
    data = "".join(w + " " for w in words).encode()
    monkeypatch.setattr(sd, "window_hashes", lambda codes, k: np.zeros(len(codes) - k + 1, np.uint64))
    rid, start, end = sd.repeated_windows(meta, None, data, 4)
    gone = {i for a, b in zip(start, end, strict=True) for i in range(a, b)}
    first, want = {}, set()
    for s in range(297):
        if first.setdefault(tuple(words[s:s + 4]), s) != s:
            want.update(range(s, s + 4))
    assert gone == want


def test_empty_and_clashing_columns(spark, make_docs):
    assert substring_dedup(make_docs([])).collect() == []
    docs = spark.createDataFrame([(1, "a b", 1, 2)], "doc_id long, text string, rid int, id int")
    assert [r.kept for r in substring_dedup(docs).collect()] == ["a b"]
