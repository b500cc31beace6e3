"""The registered queries over the whole smallest table, against brute force, and the pipeline."""

import hashlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import test_decontamination
import test_exact_dedup
import test_importance
import test_near_dedup
import test_pii
import test_secrets
import test_sharding
import test_substring_dedup
import test_suffix_dedup
import test_vector_codes
import test_warc
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


@pytest.fixture(scope="module")
def run(spark):
    def get(name, *columns):
        df = entry.queries()[name](spark, SF)
        return sorted(map(tuple, df.select(*columns).collect()), key=repr)
    return get


def test_one_query_for_each_operator():
    names = [q for q in entry.queries() if q.startswith("op") and q[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_op1(run, rows):
    got = run("op1_language_id", "doc_id", "language", "accepted")
    langs = {r["doc_id"]: r["lang"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    assert len(got) == len(rows)
    assert sum(langs[d] == lang for d, lang, _ in got) >= 0.98 * len(rows)


def test_op2(run, rows):
    assert run("op2_near_dedup", "doc_id", "class_id", "n_links") == test_near_dedup.brute(rows)


def test_op3(run, rows):
    got = run("op3_pii", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")

    def line(spans):
        return ",".join(f"{test_pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)

    want = []
    for i, text in rows:
        spans = test_pii.brute(text)
        want.append((i, *[sum(s[0] == k for s in spans) for k in range(4)],
                     hashlib.sha256(line(spans).encode()).hexdigest()))
    assert got == sorted(want, key=repr)


def test_op4(run, rows):
    assert run("op4_exact_dedup", "doc_id", "keep_id", "group_size", "kept", "text_sha256") == (
        test_exact_dedup.brute(rows))


def test_op5(run, rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert run("op5_bpe", "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_op6(run, rows):
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    want = test_decontamination.brute(rows, [(str(i), t) for i, t in items])
    assert run("op6_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256",
               "contaminated") == want
    assert any(r[-1] for r in want)


def test_op7(run, rows):
    assert run("op7_substring_dedup", "doc_id", "n_words", "n_removed", "kept_sha256") == (
        test_substring_dedup.brute(rows, 20))


def test_op8(run, rows):
    assert run("op8_suffix_dedup", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == (
        test_suffix_dedup.brute(rows, 400))


def test_op9(run):
    pages = [(r["page_id"], r["url"], r["html"]) for r in pq.read_table(f"{SF}/pages.parquet").to_pylist()]
    assert run("op9_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == (
        test_warc.brute(pages))


def test_op10(run, rows):
    want = test_sharding.brute([d for d, _ in rows], [f"shard-{i:03d}" for i in range(256)])
    assert run("op10_sharding", "doc_id", "slot", "shard") == want
    assert len({s for _, _, s in want}) > 100


def test_op11(run):
    vectors = [(r["vec_id"], r["embedding"], r["label"]) for r in
               pq.read_table(f"{SF}/embeddings.parquet").to_pylist()]
    assert run("op11_vector_codes", "vec_id", "code", "error", "label_error", "codebooks_sha256") == (
        test_vector_codes.brute(vectors))


def test_op12(run, rows):
    items = [r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    want = [(i, n, w, s, k) for i, _, n, w, s, k in test_importance.brute(rows, items)]
    assert run("op12_importance", "doc_id", "n_features", "weight", "score", "rank") == sorted(want, key=repr)


def test_op13(run, rows):
    want = []
    for i, text in rows:
        base = test_secrets.brute(text)
        want.append((i, *(sum(s[0] == k for s in base) for k in range(3)),
                     hashlib.sha256(test_secrets.line(base).encode()).hexdigest()))
    assert run("op13_secrets", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == sorted(want, key=repr)
    assert run("op13_secrets", "doc_id", "spans") == test_secrets.brute_spans(rows)


def by_hand(spark, docs, items):
    """The stages on rows, by brute force but for the language."""
    from noticeloom.llm.language_id import identify_languages

    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    accepted = {r.rid_: r.accepted for r in identify_languages(df).withColumnRenamed("rid", "rid_").collect()}
    kept = [d for d, (_, ok) in zip(docs, sorted(accepted.items()), strict=True) if ok]
    keep_ids = {r[0] for r in test_exact_dedup.brute([(d[0], d[1]) for d in kept]) if r[3]}
    kept = [d for d in kept if d[0] in keep_ids]
    classes = test_near_dedup.brute([(d[0], d[1]) for d in kept])
    keep_ids = {cls for _, cls, _ in classes}
    kept = [d for d in kept if d[0] in keep_ids]
    clean = {r[0] for r in test_decontamination.brute([(d[0], d[1]) for d in kept], items) if not r[5]}
    return [d for d in kept if d[0] in clean]


def test_pipeline_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"])
            for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    items = [(str(r["item_id"]), r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    want = by_hand(spark.newSession(), docs, items)
    got = corpus_pipeline.run(spark, SF).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert 0 < len(want) < len(docs)
    assert sorted((r.doc_id, r.text, list(r.ids)) for r in got) == sorted(
        (d[0], d[1], library.encode(d[1], add_special_tokens=False).ids) for d in want)


def test_stages_keep_the_columns_of_documents(spark, make_docs):
    docs = make_docs([(1, "The and attion to thanedble the anea one two three", "en", "s"),
                      (2, None, None, None), (None, "", "en", "s")])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
    empty = make_docs([])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == [], name
