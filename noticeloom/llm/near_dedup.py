"""Near copies: groups of signature labels propose pairs, word shingles verify them."""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.llm.components import components
from noticeloom.llm.decontamination import words_of
from noticeloom.llm.rows import with_numbers
from noticeloom.llm.substring_dedup import encode_words
from noticeloom.llm.superkmers import chunks, mix, window_hashes
from noticeloom.session import write_out

SHINGLE = 5
SIMILARITY = 0.8
TREES = 20
#: Labels by which the order of a tree moves on from the order of the tree before it.
STEP = 4
LABELS = TREES * STEP
#: Longest prefix, at most seven labels of one byte, so that a node fits a whole number.
LONGEST = 7
#: Chance to meet that a pair of exactly the asked similarity has.
RECALL = 0.9999
#: Rows of a node that are compared at a time; a larger node is dealt in pairs of such blocks.
BLOCK = 1024

_FACTOR = mix(np.arange(1, LABELS + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFT = mix(np.arange(1, LABELS + 1, dtype=np.uint64) << np.uint64(32))


def prefix_length(similarity: float, recall: float) -> int:
    """The longest prefix at which a pair of this similarity still meets in some tree with the
    asked chance: from the longest one on, prefixes are shortened until it is reached."""
    label = similarity + (1 - similarity) / 256
    for length in range(LONGEST, 0, -1):
        if 1 - (1 - label ** length) ** TREES >= recall:
            return length
    raise ValueError("no prefix reaches this recall; use more trees")


def least_agreement(similarity: float) -> int:
    """Labels that a pair of this similarity shares but for six standard deviations."""
    label = similarity + (1 - similarity) / 256
    return max(0, int(LABELS * label - 6 * (LABELS * label * (1 - label)) ** 0.5))


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """For each text the sorted codes of its different runs of ``size`` words; a text of
    fewer words has one of all its words, one without words has none."""
    cut = [words_of(t) for t in texts]
    data = b"".join(b" ".join(w) + b" " for w in cut if w)
    _, number, words = encode_words(data)
    code = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))[number]
    runs, out, at = window_hashes(code, size), [], 0
    for w in cut:
        n = len(w)
        own = runs[at:at + n - size + 1] if n >= size else window_hashes(code[at:at + n], n) if n else runs[:0]
        out.append(np.unique(own))
        at += n
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One byte of the least value of each of ``LABELS`` random orders, a row for each set."""
    if not sets:
        return np.zeros((0, LABELS), np.uint8)
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), LABELS), np.uint8)
    for k in range(LABELS):
        least = np.minimum.reduceat(flat * _FACTOR[k] + _SHIFT[k], starts)
        out[:, k] = mix(least) & np.uint64(255)
    return out


def nodes(sig: np.ndarray, length: int) -> np.ndarray:
    """For each row and tree the number of the node at this depth: the tree, then its labels."""
    out = np.empty((len(sig), TREES), np.int64)
    for tree in range(TREES):
        node = np.full(len(sig), tree, np.int64)
        for j in range(length):
            node = node << 8 | sig[:, (tree * STEP + j) % LABELS]
        out[:, tree] = node
    return out


def _describe(batches):
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for part in chunks(batch):
            texts = part.column(2).to_pylist()
            sets = shingle_sets(texts)
            some = [i for i, s in enumerate(sets) if len(s)]
            sig = signatures([sets[i] for i in some])
            rows = dict(zip(some, sig, strict=True))
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1),
                pa.array([len(s) for s in sets], pa.int32()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([rows[i].tobytes() if i in rows else None for i in range(len(sets))], pa.binary()),
                pa.array([press.compress((t or "").encode(errors="replace")) for t in texts], pa.binary()),
            ], ["rid", "id", "n", "print", "sig", "packed"])


def _grow(length: int):
    def grow(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, LABELS)
            node = nodes(sig, length)
            for tree in range(TREES):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[:, tree]), *batch.columns], ["node", "cid", "n", "size", "sig"])
    return grow


def _candidates(sig, n, tree, length, cross, least, similarity):
    """Pairs of rows of a node: (row, rows after it), each pair at the first tree where it meets.

    ``cross``: which block a row belongs to; pairs of two blocks, or of one if there is only one.
    """
    node = nodes(sig, length)[:, :tree]
    two = cross.min() != cross.max()
    for a in range(len(sig)):
        later = cross[a + 1:] != cross[a] if two else np.ones(len(sig) - a - 1, bool)
        later &= (np.minimum(n[a], n[a + 1:]) >= similarity * np.maximum(n[a], n[a + 1:]))
        own = np.flatnonzero(later) + a + 1
        if tree and len(own):
            own = own[~(node[own] == node[a]).any(1)]
        if len(own):
            own = own[(sig[own] == sig[a]).sum(1) >= least]
        if len(own):
            yield a, own


def _units(batches):
    """Rows of each unit (node, i, j), from sorted batches."""
    def rows():
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            yield from zip(*cols, strict=True)

    for unit, own in groupby(rows(), key=lambda r: r[:3]):
        yield unit, list(own)


def _arrays(own):
    sig = np.frombuffer(b"".join(r[7] for r in own), np.uint8).reshape(-1, LABELS)
    return (np.array([r[4] for r in own], np.int64), np.array([r[5] for r in own], np.int64),
            np.array([r[6] for r in own], np.int64), sig, np.array([r[3] for r in own], np.int64))


def _propose(length, least, similarity):
    def run(batches):
        for (node, i, j), own in _units(batches):
            if len(own) < 2:
                continue
            cid, n, _, sig, block = _arrays(own)
            useful = np.zeros(len(own), bool)
            for a, more in _candidates(sig, n, node >> 8 * length, length, block, least, similarity):
                useful[a] = True
                useful[more] = True
            if useful.any():
                k = int(useful.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node] * k, pa.int64()), pa.array([i] * k, pa.int32()),
                     pa.array([j] * k, pa.int32()), pa.array(block[useful], pa.int32()),
                     pa.array(cid[useful])], ["node", "i", "j", "block", "cid"])
    return run


def _verify(length, least, similarity):
    """Counts of links of each row of a unit, and links that connect what is connected in it."""
    def run(batches):
        press = zstandard.ZstdDecompressor()
        for (node, _, _), own in _units(batches):
            cid, n, size, sig, block = _arrays(own)
            sets = shingle_sets([press.decompress(r[8]).decode() for r in own])
            codes, flat = np.unique(np.concatenate(sets), return_inverse=True)
            ends = np.cumsum([len(s) for s in sets])
            begins = ends - n
            held = np.zeros(len(codes), np.int64)
            docs, texts = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
            label, tied = np.arange(len(own)), []
            for a, more in _candidates(sig, n, node >> 8 * length, length, block, least, similarity):
                held[flat[begins[a]:ends[a]]] = 1
                at = np.cumsum(n[more]) - n[more]
                place = np.repeat(begins[more] - at, n[more]) + np.arange(int(n[more].sum()))
                shared = np.add.reduceat(held[flat[place]], at)
                held[flat[begins[a]:ends[a]]] = 0
                linked = more[shared >= similarity * (n[a] + n[more] - shared) - 1e-9]
                if not len(linked):
                    continue
                docs[a] += size[linked].sum()
                texts[a] += len(linked)
                docs[linked] += size[a]
                texts[linked] += 1
                roots, first = np.unique(label[linked], return_index=True)
                tied += [(int(cid[a]), int(cid[linked[f]])) for r, f in zip(roots, first, strict=True)
                         if r != label[a]]
                label[np.isin(label, roots) | (label == label[a])] = min(int(roots[0]), int(label[a]))
            hit = texts > 0
            k = int(hit.sum())
            if k:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid[hit]), pa.array([None] * k, pa.int64()), pa.array(docs[hit]),
                     pa.array(texts[hit])], ["cid", "other", "docs", "texts"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in tied], pa.int64()), pa.array([b for _, b in tied], pa.int64()),
                     pa.array([0] * len(tied), pa.int64()), pa.array([0] * len(tied), pa.int64())],
                    ["cid", "other", "docs", "texts"])
    return run


_UNIT = ("node", "i", "j")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                similarity: float = SIMILARITY, recall: float = RECALL, block: int = BLOCK,
                rid: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, ``class_id``, ``copy_id``, ``n_links``, ``n_link_texts``, ``rid``.

    Rows are linked if the Jaccard similarity of their five-word shingles (words of letters and
    digits, A-Z lower-cased) is ``similarity`` or more. ``copy_id`` is the smallest id among the rows with
    the same shingles, ``class_id`` that among all rows that links connect, ``n_links`` the number of
    other rows linked to this one and ``n_link_texts`` that of different shingle sets. A text without
    words has no links. A null id is named only if its group has no other.

    Rows with the same shingles are one set. A set's signature is a row of labels; each tree sorts
    the sets by the labels from its own place on, and sets that share a prefix there are
    compared: by length and signature, then in the task that gets their texts by all their
    shingles. The prefix is the longest one with which a pair at the threshold meets with the chance
    ``recall``. A unit counts links and names only those that connect it, so no pairs of a large
    group are listed; a node of more than ``block`` sets is dealt in pairs of blocks. ``rid`` names a
    column of row numbers, if ``docs`` has one; else rows are numbered as their sets are written.
    """
    length, least = prefix_length(similarity, recall), least_agreement(similarity)
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = F.monotonically_increasing_id() if rid is None else F.col(rid)
    rows = docs.select(number.alias("rid"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    described = write_out(rows.mapInArrow(
        _describe, f"rid long, id {kind}, n int, print binary, sig binary, packed binary"), "sets")
    sets = write_out(described.filter("n > 0").groupBy("print", "n")
                     .agg(F.min("rid").alias("cid"), F.min("id").alias("copy_id"),
                          F.count("*").alias("size")), "copies")

    # Sets with neighbours in some tree.
    leads = described.select(F.col("rid").alias("cid"), F.col("n").cast("long").alias("n"), "sig").join(
        sets.select("cid", "size"), "cid").select("cid", "n", "size", "sig")
    trees = leads.mapInArrow(_grow(length), "node long, cid long, n long, size long, sig binary")
    large = (leads.select("cid", "n", "size", "sig").mapInArrow(
        _grow(length), "node long, cid long, n long, size long, sig binary")
        .groupBy("node").count().filter(F.col("count") > block)
        .select("node", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    dealt = trees.join(large, "node", "left").withColumn(
        "block", F.when(F.col("blocks").isNull(), 0).otherwise(
            F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    dealt = dealt.withColumn("other", other).select(
        "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        "block", "cid", "n", "size", "sig")
    proposed = (dealt.repartition(slots, *_UNIT).sortWithinPartitions(*_UNIT)
                .mapInArrow(_propose(length, least, similarity),
                            "node long, i int, j int, block int, cid long"))

    texts = described.select(F.col("rid").alias("cid"), F.col("n").cast("long").alias("n"), "sig", "packed")
    found = write_out(
        write_out(proposed, "proposed").join(sets.select("cid", "size"), "cid").join(texts, "cid")
        .select(*_UNIT, "block", "cid", "n", "size", "sig", "packed")
        .repartition(slots, *_UNIT).sortWithinPartitions(*_UNIT)
        .mapInArrow(_verify(length, least, similarity), "cid long, other long, docs long, texts long"),
        "links")
    links = found.filter("other IS NULL").groupBy("cid").agg(
        F.sum("docs").alias("docs"), F.sum("texts").alias("texts"))
    groups = components(found.filter("other IS NOT NULL").select(
        F.col("cid").alias("a"), F.col("other").alias("b")))
    facts = write_out(
        sets.join(links, "cid", "left").join(groups.withColumnRenamed("node", "cid"), "cid", "left")
        .select("print", "n", "cid", "copy_id", F.coalesce("root", "cid").alias("root"),
                (F.col("size") - 1 + F.coalesce("docs", F.lit(0))).alias("n_links"),
                F.coalesce("texts", F.lit(0)).alias("n_link_texts")), "facts")
    # Written, so that both sides of the join are plain exchanges, of which Spark splits a hot one.
    classes = write_out(facts.groupBy("root").agg(F.min("copy_id").alias("class_id")), "classes")
    facts = facts.join(classes, "root")
    return (described.select("rid", "id", "n", "print").join(facts, ["print", "n"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("cid").isNull(), F.col("id")).otherwise(F.col("copy_id")).alias("copy_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("n_link_texts", F.lit(0)).alias("n_link_texts"), "rid",
        F.coalesce("root", -1 - F.col("rid")).alias("root")))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group that links connect, the one with the smallest id (null last, then the
    first row), with all columns of ``docs``; rows without words all stay."""
    rows, rid = with_numbers(docs, None)
    found = write_out(near_copies(rows, id_col, text, **options, rid=rid), "near")
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "rid")
    kept = found.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.rid").alias(rid))
    return rows.join(kept, rid, "left_semi").drop(rid)
