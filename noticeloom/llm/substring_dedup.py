"""Repeated windows of words by super-k-mer partitioning."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.rows import with_numbers
from noticeloom.llm.superkmers import (Units, covered, find_ranges, merge_ranges, mix,
                                       plan_buckets, window_hashes, with_ranges)

WINDOW = 20
#: Words of a gram; a window's minimiser is one of its grams.
GRAM = 4


def cut_words(texts: list[str | None]) -> Units:
    """Texts in one buffer, each word followed by one space."""
    cut = [(t or "").encode(errors="replace").split() for t in texts]
    data = b"".join(b" ".join(w) + b" " for w in cut if w)
    at, number, words = encode_words(data)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))
    return Units(data, at, hashes[number], np.fromiter(map(len, cut), np.int64, len(cut)))


def encode_words(data: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Where each word starts (and the end), its number, and the different words by number."""
    spaces = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    at = np.concatenate([np.zeros(1, np.int64), spaces + 1])
    if not len(spaces):
        return at, np.zeros(0, np.int64), []
    array = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(spaces), [None, pa.py_buffer(at), pa.py_buffer(data)])
    coded = pc.dictionary_encode(array)
    return at, coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def _earliest(data: list[bytes], meta: np.ndarray):
    """Of runs with equal strings the earliest travels, the others surely repeat."""
    first: dict[bytes, int] = {}
    place = list(map(tuple, meta[:, :3].tolist()))
    for i, d in enumerate(data):
        have = first.setdefault(d, i)
        if have != i and place[i] < place[have]:
            first[d] = i
    travels = np.zeros(len(data), bool)
    travels[list(first.values())] = True
    return travels, np.zeros(len(data), np.int64), ~travels


def repeated_windows(meta: np.ndarray, _, data: bytes, window: int) -> tuple[np.ndarray, ...]:
    """(rid, start, end) of windows that also start earlier among the runs of a bucket."""
    runs = meta[:, 3] + window - 1
    _, codes, _ = encode_words(data)
    scrambled = mix(codes.astype(np.uint64) + np.uint64(1))
    hashes = window_hashes(scrambled, window)
    base = np.cumsum(runs) - runs
    # Start of each window in the bucket's words, its run and its place in the run.
    n = meta[:, 3]
    run = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    at = base[run] + inside
    own = hashes[at]
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    member = np.zeros(len(order), bool)
    member[1:] |= same
    member[:-1] |= same
    some = order[member]
    if not len(some):
        none = np.zeros(0, np.int64)
        return none, none, none
    group = np.cumsum(np.append(True, own[some][1:] != own[some][:-1]))
    place = meta[run[some]]
    start = place[:, 2] + inside[some]
    sort = np.lexsort((start, place[:, 1], place[:, 0], group))
    some, group, place, start = some[sort], group[sort], place[sort], start[sort]
    # Equal hashes are checked word by word.
    fits = np.ones(len(some) - 1, bool)
    for j in range(window):
        fits &= codes[at[some[1:]] + j] == codes[at[some[:-1]] + j]
    inner = group[1:] == group[:-1]
    if (inner & ~fits).any():
        group = _by_words(codes, at[some], group, window)
        sort = np.lexsort((start, place[:, 1], place[:, 0], group))
        group, place, start = group[sort], place[sort], start[sort]
        inner = group[1:] == group[:-1]
    later = np.append(False, inner)
    return merge_ranges(place[later, 1], start[later], start[later] + window)


def _by_words(codes, at, group, window):
    """Groups by the words themselves, for the rare case that two windows share a hash."""
    for j in range(window):
        _, group = np.unique(np.stack([group, codes[at + j]], 1), axis=0, return_inverse=True)
        group = group.ravel()
    return group


def find_repeats(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(rid, start, end)``: ranges of words of windows that also start earlier.

    ``rows`` has ``rid, id, text``; earlier is a smaller id (null last), then a smaller rid,
    then an earlier word. A text moves once, as packed runs of about three times its words,
    compressed; of equal runs in a task only the first one travels. In its bucket every window
    is sorted with its equals and compared in full.
    """
    plan = plan_buckets(rows, cut_words, window, gram, share=2)
    return find_ranges(rows, plan, cut_words, _earliest, repeated_windows)


def _remove(digest: bool):
    def run(batches):
        for batch in batches:
            n_words, n_removed, kept = [], [], []
            for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                                    strict=True):
                words = (text or "").encode(errors="replace").split()
                gone = covered(len(words), ranges)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                rest = b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)
                kept.append(hashlib.sha256(rest).hexdigest() if digest else rest.decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept"])
    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                    window: int = WINDOW, gram: int = GRAM, digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_removed`` and ``kept``: the words that no
    window covers which also starts earlier, joined by one space (with ``digest`` its SHA-256).

    Words are runs without ASCII white space, taken as they are. A null text has no words,
    a text of fewer than ``window`` words loses none. Windows are judged on the input. Rows with
    a null id come last; rows with equal ids follow the order of the table. Ids are integers.
    """
    if not 1 <= gram <= window:
        raise ValueError("a gram has at least one word and at most a window's")
    numbered, number = with_numbers(docs, None)
    rows = numbered.select(F.col(number).alias("rid"),
                       F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    own = with_ranges(numbered, number, find_repeats(rows, window, gram), id_col, text)
    return (own.mapInArrow(_remove(digest), f"id {own.schema['id'].dataType.simpleString()}, "
                           "n_words long, n_removed long, kept string")
            .withColumnRenamed("id", id_col))
