"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.rows import with_numbers
from noticeloom.session import write_out

WINDOW = 10
#: Bytes that an automaton takes for a byte of its windows, at most: a node of its own.
NODE_BYTES = 64
#: Bytes of distinct windows that one automaton holds, so that it takes half a gigabyte of a worker
#: at most; a larger benchmark is split.
AUTOMATON_BYTES = (512 << 20) // NODE_BYTES

#: A-Z to a-z; what is neither a letter, a digit nor above 0x7F becomes a space.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32
    for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased in A-Z only; in UTF-8, where no other character has
    a byte below 0x80."""
    return (text or "").encode(errors="replace").translate(_FOLD).split()


def item_windows(items: DataFrame, id_col: str, text: str, window: int) -> DataFrame:
    """Distinct ``(item, words, n)``: each window of each item as one string of ``n`` words."""
    def cut(batches):
        for batch in batches:
            ids, ks, ns = [], [], []
            for item, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = words_of(value)
                n = min(window, len(words))
                for i in range(len(words) - n + 1 if n else 0):
                    ids.append(item or "")
                    ks.append(b" ".join(words[i:i + n]).decode())
                    ns.append(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.string()), pa.array(ks, pa.string()), pa.array(ns, pa.int32())],
                ["item", "words", "n"])

    return (items.select(F.col(id_col).cast("string"), text)
            .mapInArrow(cut, "item string, words string, n int").distinct())


class _Automaton:
    """Finds the windows in normalised text; kept by a worker for its later tasks."""

    kept: dict[str, _Automaton] = {}

    def __init__(self, rows: list[tuple[str, str, int]]):
        found = defaultdict(list)
        for item, words, n in rows:
            found[words, n].append(item)
        self.machine = ahocorasick.Automaton()
        for (words, n), items in found.items():
            # One character for each byte, words set off by a space on both sides.
            key = f" {words.encode().decode('latin-1')} "
            self.machine.add_word(key, (len(key), n, items))
        if found:
            self.machine.make_automaton()

    @classmethod
    def get(cls, token: str, shared) -> _Automaton:
        if token not in cls.kept:
            cls.kept.clear()
            cls.kept[token] = cls(shared.value)
        return cls.kept[token]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words as (first, end) in word numbers, and the items found."""
        if not words or not len(self.machine):
            return [], set()
        text = f" {b' '.join(words).decode('latin-1')} "
        hits, items, at = [], set(), None
        for end, (length, n, of) in self.machine.iter(text):
            if at is None:
                # Place of each word in the normalised text, only where something is found.
                at = np.cumsum([1] + [len(w) + 1 for w in words])
            first = int(np.searchsorted(at, end - length + 2))
            hits.append((first, first + n))
            items.update(of)
        runs = []
        for a, b in sorted(hits):
            if runs and a <= runs[-1][1]:
                runs[-1] = (runs[-1][0], max(b, runs[-1][1]))
            else:
                runs.append((a, b))
        return runs, items


_SPANS = "array<struct<first_word:int,end_word:int,start:long,end:long>>"
_FOUND = f"n_words long, n_hit long, items array<string>, spans {_SPANS}"
_SPAN_TYPE = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()),
                                 ("start", pa.int64()), ("end", pa.int64())]))


def _scanner(token: str, shared):
    def scan(batches):
        machine = _Automaton.get(token, shared)
        for batch in batches:
            n_words, n_hit, items, spans = [], [], [], []
            for value in batch.column(1).to_pylist():
                words = words_of(value)
                runs, found = machine.scan(words)
                at = [m.span() for m in _WORD.finditer(value)] if runs else []
                n_words.append(len(words))
                n_hit.append(sum(b - a for a, b in runs))
                items.append(sorted(found))
                spans.append([{"first_word": a, "end_word": b, "start": at[a][0],
                               "end": at[b - 1][1]} for a, b in runs])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()),
                 pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPAN_TYPE)],
                ["id", "n_words", "n_hit", "items", "spans"])
    return scan


def find_contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id",
                       text: str = "text", item_id: str = "item_id", item_text: str = "text",
                       window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_hit``, ``items`` (ids of the items
    with a window in it, sorted as strings) and ``spans``: the runs of hit words, as word
    numbers and as code points of the original text, ends exclusive.

    A window is ``window`` consecutive words of an item; an item of fewer words is one
    window. A null text has no words; a null item id counts as an empty one. Items with
    equal ids are one item. The documents are read once and do not move; only the windows
    are sent to every worker, after their size is checked. Windows beyond ``automaton_bytes``
    are dealt to several automata by hash, one scan for each, and the finds of a document
    are joined.
    """
    spark = docs.sparkSession
    windows = write_out(item_windows(items, item_id, item_text, window), "windows")
    size = windows.agg(F.sum(F.octet_length("words") + F.octet_length("item"))).first()[0] or 0
    parts = -(-size // automaton_bytes) or 1
    rows = docs.select(F.col(id_col).alias("id"), text)
    kind = rows.schema["id"].dataType.simpleString()

    def scan(df: DataFrame, key: str, part: int) -> DataFrame:
        own = windows.filter(F.pmod(F.xxhash64("words"), F.lit(parts)) == part)
        shared = [tuple(r) for r in own.collect()]
        token = hashlib.sha256(repr(sorted(shared)).encode()).hexdigest()
        return df.mapInArrow(_scanner(token, spark.sparkContext.broadcast(shared)),
                             f"id {key}, {_FOUND}")

    if parts == 1:
        return scan(rows, kind, 0).withColumnRenamed("id", id_col)
    rows, number = with_numbers(docs, None)
    numbered = rows.select(F.col(number).alias("rid"), F.col(id_col).alias("id"), text)
    found = [scan(numbered.select(F.col("rid").alias("id"), text), "long", p)
             for p in range(parts)]
    merged = found[0]
    for more in found[1:]:
        merged = merged.unionByName(more)
    merged = (merged.filter("n_hit > 0").groupBy("id")
              .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
                   F.array_sort(F.flatten(F.collect_list("spans"))).alias("all")))
    merged = merged.withColumn("spans", F.expr("""
        aggregate(all, cast(array() AS %s), (runs, s) ->
            CASE WHEN size(runs) > 0 AND element_at(runs, -1).end_word >= s.first_word THEN
                concat(slice(runs, 1, size(runs) - 1), array(named_struct(
                    'first_word', element_at(runs, -1).first_word,
                    'end_word', greatest(element_at(runs, -1).end_word, s.end_word),
                    'start', element_at(runs, -1).start,
                    'end', greatest(element_at(runs, -1).end, s.end))))
            ELSE concat(runs, array(s)) END)""" % _SPANS))
    counts = found[0].select(F.col("id").alias("rid"), "n_words")
    empty = F.expr("cast(array() AS array<string>)")
    return (numbered.drop(text).join(counts, "rid")
            .join(merged.withColumnRenamed("id", "rid"), "rid", "left")
            .select(F.col("id").alias(id_col), "n_words", F.expr(
                "coalesce(aggregate(spans, 0L, (n, s) -> n + s.end_word - s.first_word), 0L)")
                .alias("n_hit"), F.coalesce("items", empty).alias("items"),
                F.coalesce("spans", F.expr(f"cast(array() AS {_SPANS})")).alias("spans")))


def contamination_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text",
                      max_share: float = 0.0, **options) -> DataFrame:
    """The rows of ``docs`` whose share of hit words is at most ``max_share``, all columns."""
    rows, rid = with_numbers(docs, None)
    found = find_contamination(rows, items, rid, text, **options)
    bad = found.filter(F.col("n_hit") > max_share * F.col("n_words")).select(rid)
    return rows.join(bad, rid, "left_anti").drop(rid)
