import hashlib
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from noticeloom.llm.bpe import Bpe, decode, encode

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(text):
    own = ",".join(p[1] for p in Bpe.load(PATH).encode([text])[0])
    return [int(i) for i in own.split(",")] if own else []


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aeinst 's\n")), max_size=40))
def test_any_text(text):
    library = Tokenizer.from_file(PATH) if not hasattr(test_any_text, "lib") else test_any_text.lib
    test_any_text.lib = library
    assert ids_of(text) == library.encode(text, add_special_tokens=False).ids


def test_check_of_pairs_is_exact(library):
    bpe = Bpe.load(PATH)
    rng = np.random.default_rng(5)
    a, b = rng.integers(0, 50256, (2, 3000))
    short = rng.integers(0, 1500, (2, 3000))
    a, b = np.concatenate([a, short[0]]), np.concatenate([b, short[1]])
    want = [bpe.merge(bpe.bytes_of[x] + bpe.bytes_of[y]) == [x, y] for x, y in zip(a, b, strict=True)]
    assert bpe.compatible(a, b).tolist() == want
    assert 0 < sum(want) < len(want)


def test_only_failing_words_are_merged():
    bpe = Bpe(PATH)
    bpe.encode(["the of and thoughtful unbelievable hjkqz erthness ledged misshapen"])
    assert 0 < bpe.checked and bpe.failed < bpe.checked


def test_documents(spark, make_docs, odd_rows, library):
    rows = [*odd_rows, (950, "x<|endoftext|> y<|endoftext|>"), (951, "<|endoftext")]
    got = encode(make_docs(rows), PATH, digest=True).collect()

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(",".join(map(str, ids))),
                     sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_round_trip(spark, make_docs, odd_rows):
    coded = encode(make_docs(odd_rows), PATH)
    back = decode(coded.select("doc_id", "ids"), PATH).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id is not None) == sorted(
        (i, t or "") for i, t in odd_rows if i is not None)
    assert encode(make_docs([]), PATH).collect() == []


def test_long_words_take_no_quadratic_time(library):
    rng = np.random.default_rng(3)
    for word in ("a" * 200_000, "漢字仮名交じり文" * 25_000, "".join(rng.choice(list("abcdefgh"), 200_000))):
        start = time.process_time()
        got = ids_of(word)
        assert time.process_time() - start < 10
        assert got == library.encode(word, add_special_tokens=False).ids


def test_short_words_are_merged_by_ranks_and_guesses_reach_no_further_than_a_token(monkeypatch):
    from noticeloom.llm import bpe as module
    bpe = Bpe(PATH)
    words = [w.encode() for w in (" erthness", "aaaaaaaaa", " zzqqzz", "ß", "日本", " 1234567", "xX-_", "a")]
    short = [bpe.merge(w) for w in words]
    assert all(bpe.made[rank] == made and bpe.follow[a][b] == rank for (a, b), (rank, made) in bpe.merges.items())
    longest = [max([k for k in range(1, len(w) + 1) if w[:k] in bpe.whole]) for w in words]
    assert [len(bpe.bytes_of[bpe.guess(w)[0]]) for w in words] == longest
    monkeypatch.setattr(module, "SHORT_WORD", 0)
    assert [bpe.merge(w) for w in words] == short
    assert all(isinstance(ids, str) for ids in bpe.words.values())
