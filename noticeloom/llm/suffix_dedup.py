"""Repeated strings of bytes by suffix arrays over the places where they can repeat."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.rows import with_numbers
from noticeloom.llm.suffix_array import suffix_array
from noticeloom.llm.superkmers import (Units, covered, find_ranges, merge_ranges, mix,
                                       plan_buckets, powers, window_hashes, with_ranges)

LENGTH = 400
#: Bytes of a gram; a window's minimiser is one of its grams.
GRAM = 16
#: A phrase ends after a trigger: one in so many places has one.
TRIGGER, EVERY = 8, 64
#: Bytes of runs that are sorted at a time; a single minimiser's runs stay together.
SORT_BYTES = 2 << 20

_CODES = mix(np.arange(1, 257, dtype=np.uint64))


def cut_bytes(texts: list[str | None]) -> Units:
    own = [(t or "").encode(errors="replace") for t in texts]
    data = b"".join(own)
    return Units(data, np.arange(len(data) + 1), _CODES[np.frombuffer(data, np.uint8)],
                 np.fromiter(map(len, own), np.int64, len(own)))


def _collapse(data: list[bytes], meta: np.ndarray):
    """Of equal strings one travels, with the note 1: all of them surely repeat."""
    first: dict[bytes, int] = {}
    again = np.zeros(len(data), bool)
    for i, d in enumerate(data):
        have = first.setdefault(d, i)
        if have != i:
            again[have] = again[i] = True
    travels = np.zeros(len(data), bool)
    travels[list(first.values())] = True
    return travels, again.astype(np.int64), again


def repeated_strings(meta: np.ndarray, lengths: np.ndarray, data: bytes, length: int):
    """(rid, start, end) of ``length``-byte strings that start twice among a bucket's runs.

    Runs of a minimiser that no other run has hold nothing that repeats. Equal runs are
    settled by being equal; the different runs of a minimiser are sorted.
    """
    ends = np.cumsum(lengths)
    order = np.argsort(meta[:, 4], kind="stable")
    key = meta[order, 4]
    cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key)).tolist()
    found, held, size = [], [], 0
    repeats: list[int] = []
    at = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
    note = meta[:, 5].tolist()
    order = order.tolist()
    for a, b in zip(cuts, cuts[1:]):
        if b - a < 2:
            continue
        same: dict[bytes, list[int]] = {}
        for i in order[a:b]:
            same.setdefault(data[at[i][0]:at[i][1]], []).append(i)
        for own in same.values():
            if len(own) > 1 or note[own[0]]:
                # What has a note was reported where it came from.
                repeats += [i for i in own if not note[i]]
        if len(same) < 2:
            continue
        for string, own in same.items():
            held.append((string, own[0] if len(own) == 1 and not note[own[0]] else -1))
            size += len(string)
        if size > SORT_BYTES:
            found.append(_sorted_runs(held, meta, length))
            held, size = [], 0
    if held:
        found.append(_sorted_runs(held, meta, length))
    whole = meta[repeats]
    found.append((whole[:, 1], whole[:, 2], whole[:, 2] + whole[:, 3] + length - 1))
    return merge_ranges(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _equal_bytes(text: np.ndarray, x: np.ndarray, y: np.ndarray, cap: np.ndarray) -> np.ndarray:
    """How many bytes from ``x`` and ``y`` on are equal, up to ``cap``; eight at a time."""
    words = np.ndarray((len(text) + 8,), np.uint64, text.tobytes() + bytes(16), strides=(1,))
    out = np.zeros(len(x), np.int64)
    live = np.flatnonzero(cap > 0)
    while len(live):
        differ = words[x[live] + out[live]] ^ words[y[live] + out[live]]
        # The lowest byte that differs comes first.
        low = np.where(differ == 0, 8, 0)
        some = differ != 0
        bit = differ[some] & (~differ[some] + np.uint64(1))
        low[some] = np.log2(bit.astype(np.float64)).astype(np.int64) // 8
        out[live] += low
        live = live[(low == 8) & (out[live] < cap[live])]
    return np.minimum(out, cap)


class _Least:
    """The least value between two places of an array, from tables of doubling spans."""

    def __init__(self, values: np.ndarray):
        self.tables = [values]
        span = 1
        while span * 2 <= len(values):
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-span], last[span:]))
            span *= 2

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        level = np.log2((b - a).astype(np.float64)).astype(np.int64)
        out = np.empty(len(a), np.int64)
        for k in np.unique(level).tolist():
            own = level == k
            table = self.tables[k]
            out[own] = np.minimum(table[a[own]], table[b[own] - (1 << k)])
        return out


def _sorted_runs(held: list[tuple[bytes, int]], meta: np.ndarray, length: int):
    """The same for different runs; a run that is settled already (-1) is only compared with.

    The runs are cut into phrases after triggers, which depend on the bytes of the trigger
    alone, and the suffix array is that of the numbers of phrases: since none but a run's last
    phrase is the start of another, it puts the suffixes at phrase ends in byte order. A string
    is then what is left of its phrase and the suffix at the phrase's end, so strings with
    equal rests are equal as far as the suffixes agree. A trigger that reaches
    in from before the string does not count.
    """
    sizes = np.fromiter((len(s) for s, _ in held), np.int64, len(held))
    data = b"".join(s for s, _ in held)
    text = np.frombuffer(data, np.uint8)
    stop = np.cumsum(sizes)
    base = stop - sizes
    code = _CODES[text]
    cut = np.flatnonzero(window_hashes(code, TRIGGER) % np.uint64(EVERY) == 0) + TRIGGER
    run = np.searchsorted(stop, cut - 1, side="right")
    inside = cut - TRIGGER >= base[run]
    cut, run = cut[inside], run[inside]

    # Phrases with the trigger before them, in order; after each run a separator of its own.
    begin = np.sort(np.concatenate([base, cut[cut < stop[run]]]))
    end = np.append(begin[1:], len(data))
    of = np.searchsorted(stop, begin, side="right")
    start = np.where(begin > base[of], begin - TRIGGER, begin)
    phrases = [data[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]
    number = {p: len(held) + 1 + k for k, p in enumerate(sorted(set(phrases)))}
    place = np.arange(len(begin)) + of
    symbols = np.zeros(len(begin) + len(held) + 1, np.int64)
    symbols[place] = [number[p] for p in phrases]
    symbols[np.append(place[1:][of[1:] != of[:-1]] - 1, len(symbols) - 2)] = np.arange(
        1, len(held) + 1)
    array = np.array(suffix_array(symbols.tolist()))

    # Suffixes at phrase ends that triggers made, a run's end included, in sorted order.
    rank_of = np.empty(len(array), np.int64)
    rank_of[array] = np.arange(len(array))
    follows = np.searchsorted(begin, cut)
    at_end = cut == stop[run]
    symbol = np.where(at_end, place[np.maximum(follows - 1, 0)] + 1,
                      place[np.minimum(follows, len(begin) - 1)])
    by_rank = np.argsort(rank_of[symbol])
    rank = np.empty(len(cut), np.int64)
    rank[by_rank] = np.arange(len(cut))
    x, y = cut[by_rank][:-1], cut[by_rank][1:]
    left = stop[run][by_rank] - cut[by_rank]
    agree = _Least(_equal_bytes(text, x, y, np.minimum(np.minimum(left[:-1], left[1:]), length)))

    # Every string: the rest of its phrase by hash, then the suffix after it.
    n = sizes - length + 1
    owner = np.repeat(np.arange(len(held)), n)
    s = base[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    j = np.searchsorted(cut, s + TRIGGER)
    here = j < len(cut)
    here[here] = cut[j[here]] <= s[here] + length
    rest = np.full(len(s), length)
    rest[here] = cut[j[here]] - s[here]
    after = np.zeros(len(s), np.int64)
    after[here] = rank[j[here]]
    total = np.concatenate([np.zeros(1, np.uint64),
                            np.cumsum(code * powers(len(code)), dtype=np.uint64)])
    tail = mix((total[s + rest] - total[s]) * powers(len(code), back=True)[s]
               + rest.astype(np.uint64))
    pairs = _equal_neighbours(text, s, rest, tail, after, agree, length)
    if pairs is None:
        known: dict[bytes, int] = {}
        tail = np.array([known.setdefault(data[a:a + b], len(known)) for a, b in
                         zip(s.tolist(), rest.tolist(), strict=True)], np.uint64)
        pairs = _equal_neighbours(text, s, rest, tail, after, agree, length)
    own = np.fromiter((i for _, i in held), np.int64, len(held))
    hit = np.unique(pairs)
    hit = hit[own[owner[hit]] >= 0]
    row = meta[own[owner[hit]]]
    first = row[:, 2] + s[hit] - base[owner[hit]]
    return row[:, 1], first, first + length


def _equal_neighbours(text, s, rest, tail, after, agree, length):
    """Strings that equal a neighbour in sorted order; None if different rests share a hash."""
    order = np.lexsort((after, tail))
    a, b = order[:-1], order[1:]
    same = tail[a] == tail[b]
    a, b = a[same], b[same]
    if ((rest[a] != rest[b]) | (_equal_bytes(text, s[a], s[b], rest[a]) < rest[a])).any():
        return None
    need = length - rest[a]
    enough = need <= 0
    check = ~enough & (after[a] < after[b])
    enough[check] = agree.between(after[a[check]], after[b[check]]) >= need[check]
    return np.concatenate([a[enough], b[enough]])


def find_repeats(rows: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``(rid, start, end)``: ranges of bytes of ``length``-byte strings that start twice or more.

    ``rows`` has ``rid, id, text``. Consecutive strings that share a minimiser travel as one run
    to the bucket of the minimiser, so equal strings meet; a text moves about three times,
    compressed. Buckets are sorted a few megabytes at a time.
    """
    plan = plan_buckets(rows, cut_bytes, length, gram, share=8)
    return find_ranges(rows, plan, cut_bytes, _collapse, repeated_strings)


def _remove(batches):
    for batch in batches:
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for text, ranges in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(),
                                strict=True):
            data = np.frombuffer((text or "").encode(errors="replace"), np.uint8)
            gone = covered(len(data), ranges)
            n_bytes.append(len(data))
            n_removed.append(int(gone.sum()))
            n_spans.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
            kept.append(data[~gone].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()),
             pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary()),
             pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
            ["id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                 length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs``: id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed
    runs), ``kept`` (the remaining bytes) and ``kept_sha256``.

    Every byte goes that a string of ``length`` bytes covers which also starts anywhere else,
    in another row or the same; all of its places go. Strings are judged on the input and stay
    within a text. A null text is empty; ids may be null or repeated, every row is a text
    of its own.
    """
    if not TRIGGER <= length or not 1 <= gram <= length:
        raise ValueError(f"a string has at least {TRIGGER} bytes and a gram's")
    numbered, number = with_numbers(docs, None)
    rows = numbered.select(F.col(number).alias("rid"), F.lit(0).cast("long").alias("id"),
                       F.col(text).alias("text"))
    own = with_ranges(numbered, number, find_repeats(rows, length, gram), id_col, text)
    return (own.mapInArrow(_remove, f"id {own.schema['id'].dataType.simpleString()}, n_bytes long, "
                           "n_removed long, n_spans long, kept binary, kept_sha256 string")
            .withColumnRenamed("id", id_col))
