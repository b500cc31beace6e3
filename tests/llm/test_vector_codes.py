import hashlib
import math

import numpy as np
import pyarrow.parquet as pq
import pytest

from noticeloom.llm.vector_codes import Codebooks, compress_vectors, vector_codes_digest

SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(x, scale=256):
    return math.floor(x * scale)


def nearest(part, book):
    return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))


def brute(rows, parts=16, entries=64, rounds=2):
    """(vec_id, code, error, label_error, sha) by the plain definition; rows of one length."""
    kept = [(i, [whole(x) for x in v], label) for i, v, label in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    d = len(kept[0][1]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[r[1][p * d:p * d + d] for r in first] for p in range(parts)]

    def assigned():
        return [[nearest(v[p * d:p * d + d], books[p]) for p in range(parts)] for _, v, _ in kept]

    for _ in range(rounds):
        codes = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                own = [v[p * d:p * d + d] for (_, v, _), c in zip(kept, codes) if c[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    sums = {}
    out = []
    for (i, _, label), c in zip(kept, assigned()):
        error = sum(e for e, _ in c)
        sums[label] = sums.get(label, 0) + error
        out.append((i, "".join(f"{k:02x}" for _, k in c), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, c, e, sums[label], sha) for i, c, e, label in out], key=repr)


def run(spark, rows, schema=SCHEMA, **options):
    df = spark.createDataFrame(rows, schema)
    got = vector_codes_digest(*compress_vectors(df, **options)).collect()
    return sorted(map(tuple, got), key=repr)


def test_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in
            pq.read_table("/root/testdata/sf0.001/embeddings.parquet").to_pylist()]
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(0, 1, 32).astype(np.float32).tolist(), int(i) % 3 or None)
            for i in rng.permutation(150)]
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None, 1), (1001, [None] * 32, 1), (1002, [nan] + [0.0] * 31, 1),
             (1003, [0.0] * 31 + [-inf], 1), (None, [0.25] * 32, 2), (None, [0.25] * 32, 2),
             (7, [1e4] * 32, None), (7, [1e4] * 32, None), (1004, [-0.001] * 32, 0)]
    assert run(spark, rows) == brute(rows)


def test_few_and_no_vectors(spark):
    rows = [(3, [0.5] * 16, None), (1, [-0.5] * 16, 1), (1, [-0.5] * 16, 1)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1), (2, [], 1), (3, [None], 1)]) == []


def test_other_lengths_are_dropped(spark):
    rows = [(i, [float(i)] * 16, 1) for i in range(5)]
    odd = [(10, [1.0] * 15, 1), (11, [1.0] * 32, 1), (12, [1.0], 1)]
    assert run(spark, rows + odd) == brute(rows)


def test_ties_take_the_lower_entry():
    books = Codebooks(np.array([[[0], [2], [2], [0]]]))
    values = np.array([0, 1, 2])
    found, least = books.assign(np.array([3], np.int32).tobytes(), values.tobytes(),
                                np.array([0, 1, 2], np.uint16).tobytes())
    assert found[:, 0].tolist() == [0, 0, 1] and least[:, 0].tolist() == [0, 1, 0]


def test_huge_components_are_limited(spark):
    rows = [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [0.0] * 16, 1)]
    got = run(spark, rows)
    assert [r[0] for r in got] == [1, 2, 3] and all(r[2] == 0 for r in got)


def test_extra_columns_and_own_names(spark):
    df = spark.createDataFrame([("a", [0.0] * 4, "x", 1, "y"), ("b", [1.0] * 4, "x", 2, "z")],
                               "key string, v array<double>, tag string, id int, code string")
    coded, books = compress_vectors(df, "key", "v", "tag", parts=2, entries=2)
    assert sorted(map(tuple, coded.collect())) == [("a", "x", "0000", 0, 0), ("b", "x", "0101", 0, 0)]
    assert books.shape == (2, 2, 2)
    with pytest.raises(ValueError):
        compress_vectors(df, "key", "v", "tag", entries=300)
