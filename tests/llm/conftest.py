import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) or (id, text, lang, source) tuples."""
    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None,
                 len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture(scope="session")
def small_texts():
    """Whole texts of the smallest table."""
    import pyarrow.parquet as pq
    return [(r["doc_id"], r["text"]) for r in
            pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]


@pytest.fixture(scope="session")
def odd_rows(small_texts):
    """Nulls, empty and very long texts, repeated rows and ids on top of the smallest table."""
    long = " ".join(t for _, t in small_texts[:60])
    return [*small_texts, (900, None), (901, ""), (902, " \n\t "), (903, long), (904, long + " x"),
            (905, long), (None, "no id here"), (None, "no id here"), (906, "twice"), (906, "twice"),
            (907, "é👍 a\x85b"), (908, "a" * 5000), (909, "ab " * 3000)]
