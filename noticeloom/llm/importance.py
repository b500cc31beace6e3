"""Importance resampling of documents towards a target text, on hashed runs of words."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

from noticeloom.llm.rows import free_name, number_rows
from noticeloom.session import write_out

BUCKETS = 10_000
LONGEST = 3
MIN_WORDS = 20
SHARE = (5, 100)
SEED = 42

#: What separates words; A-Z are lower-cased before.
_OTHER = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
_WORDS = pre_tokenizers.Split(Regex(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "removed", invert=True)
_SEPARATOR = re.compile(_OTHER)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Characters that are split at a time; a piece ends at the next separator.
PIECE = 1 << 16
#: Bytes of text whose windows are hashed at a time, but for one longer text.
CHUNK_BYTES = 1 << 20


def _crc_shift() -> np.ndarray:
    """Tables ``[length, byte, value]``: what a checksum turns into behind that many more bytes.

    A checksum of joined strings is that of the first, shifted by the length of the second, with
    that of the second added bit by bit. Shifting is linear, so a shift by a length is
    read off four tables, one a byte of the checksum.
    """
    step = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(bytes([0])) for i in range(256)], np.uint32)
    one = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        value = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
        one[byte] = (value >> np.uint32(8)) ^ step[value & np.uint32(255)]
    tables = np.empty((64, 4, 256), np.uint32)
    for byte in range(4):
        tables[0, byte] = np.arange(256, dtype=np.uint32) << np.uint32(8 * byte)
    for n in range(1, 64):
        tables[n] = _read(one[None], np.zeros(1, np.int64), tables[n - 1])
    return tables


def _read(tables: np.ndarray, which: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[which, 0, crc & np.uint32(255)]
    for byte in (1, 2, 3):
        out = out ^ tables[which, byte, (crc >> np.uint32(8 * byte)) & np.uint32(255)]
    return out


_SHIFT = _crc_shift()


def joined_crc(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of joined strings, from those of both and the length of the second in bytes."""
    out, left = first, length
    while len(left) and left.max() > 63:
        now = np.minimum(left, 63)
        out, left = _read(_SHIFT, now, out), left - now
    return _read(_SHIFT, left, out) ^ second


def words_with_offsets(text: str):
    """Pieces of the words of a text: lists of (word, (start, end)), places in code points."""
    lowered = text.encode(errors="replace").translate(_LOWER).decode()
    at = 0
    while at < len(lowered):
        cut = _SEPARATOR.search(lowered, at + PIECE)
        end = cut.start() if cut else len(lowered)
        found = _WORDS.pre_tokenize_str(lowered[at:end])
        yield [(w, (a + at, b + at)) for w, (a, b) in found] if at else found
        at = end


_SPACE = np.array([zlib.crc32(b" ")], np.uint32)


def window_crcs(crcs: np.ndarray, sizes: np.ndarray, longest: int):
    """For each run length up to ``longest`` the checksum of the run that starts at each word."""
    out, run = [crcs], crcs
    for n in range(1, longest):
        if len(run) < 2:
            break
        spaced = joined_crc(run[:-1], _SPACE, np.ones(len(run) - 1, np.int64))
        run = joined_crc(spaced, crcs[n:], sizes[n:])
        out.append(run)
    return out


def _described(text: str) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 and bytes of every word of a text."""
    crcs, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    for piece in words_with_offsets(text):
        if not piece:
            continue
        own = " ".join([w for w, _ in piece]).encode().split(b" ")
        crcs.append(np.fromiter(map(zlib.crc32, own), np.uint32, len(own)))
        sizes.append(np.fromiter(map(len, own), np.int64, len(own)))
    return np.concatenate(crcs), np.concatenate(sizes)


def features(texts: list[str | None], buckets: int = BUCKETS, longest: int = LONGEST):
    """For each text its number of words and the bucket of every run of 1 to ``longest`` words."""
    described = [_described(t or "") for t in texts]
    ends = np.cumsum([len(c) for c, _ in described])
    crcs = np.concatenate([c for c, _ in described])
    sizes = np.concatenate([s for _, s in described])
    runs = [(r % np.uint32(buckets)).astype(np.uint16) for r in window_crcs(crcs, sizes, longest)]
    out = []
    for (own, _), end in zip(described, ends.tolist(), strict=True):
        # A run that starts in a text also ends in it.
        out.append((len(own), np.concatenate(
            [r[end - len(own):max(end - n, end - len(own))] for n, r in enumerate(runs)])))
    return out


def _chunks(texts: list[str | None]):
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > CHUNK_BYTES:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


def hashed_features(rows: DataFrame, buckets: int, longest: int) -> DataFrame:
    """``id, n_words, n_features, buckets`` of each row of ``id, text``; two bytes a feature."""
    def run(batches):
        for batch in batches:
            at = 0
            for part in _chunks(batch.column(1).to_pylist()):
                found = features(part, buckets, longest)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), pa.array([n for n, _ in found], pa.int64()),
                     pa.array([len(f) for _, f in found], pa.int64()),
                     pa.array([f.tobytes() for _, f in found], pa.binary())],
                    ["id", "n_words", "n_features", "buckets"])
                at += len(part)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, buckets binary")


def histogram(coded: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all rows are in each bucket; tasks count, and only counts move."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for own in batch.column(0).to_pylist():
                total += np.bincount(np.frombuffer(own, np.uint16), minlength=buckets)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], ["bucket", "n"])

    counts = (coded.select("buckets").mapInArrow(run, "bucket long, n long")
              .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, np.int64)
    for r in counts:
        out[r.bucket] = r.n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the rounded-down thousandfold logarithm of target over source share, each with
    one added to every bucket."""
    n, all_s, all_t = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1) * (all_s + n)) / ((s + 1) * (all_t + n))))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(key: Column, seed: int) -> Column:
    """A standard Gumbel draw, in thousandths rounded down, fixed by the seed and the key; a null
    key draws as an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(rows: DataFrame, order: list[Column], draw: int) -> DataFrame:
    """``rows`` with ``rank`` 1, 2, 3... of the first ``draw`` rows in this order, null for others.

    Rows are dealt to partitions by range and sorted there; a rank is the place in the partition behind
    the sizes of those before. Written between, so that places do not change.
    """
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = write_out(
        rows.repartitionByRange(slots, *order).sortWithinPartitions(*order)
        .withColumn("place", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("place", 33)
    before, ahead = 0, {}
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):
        ahead[r.part] = before
        before += r["count"]
    if not ahead:
        return placed.withColumn("rank", F.lit(None).cast("long")).drop("place")
    lookup = F.create_map(*(F.lit(x).cast("long") for item in ahead.items() for x in item))
    place = F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    rank = place + F.element_at(lookup, part)
    return placed.withColumn("rank", F.when(rank <= draw, rank)).drop("place")


def importance_scores(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text: str = "text",
                      target_text: str = "text", share: tuple[int, int] = SHARE, seed: int = SEED,
                      min_words: int = MIN_WORDS, buckets: int = BUCKETS,
                      longest: int = LONGEST) -> DataFrame:
    """One row per row of ``docs``: id, ``n_words``, ``n_features``, ``weight``, ``score``, ``rank``.

    Features are all runs of 1 to ``longest`` words, hashed to buckets by CRC-32. A bucket's gain compares its
    share of the target's features with its share of the documents'; a document's weight is the sum
    of its features' gains. With Gumbel noise on top, the highest scores are a draw
    without replacement in proportion to the weights' exponentials: of N documents with at
    least ``min_words`` words, the share of N, rounded down, gets ranks 1, 2, 3... by score, then id
    (null last; equal ids by words and weight). A null text has no words and the weight 0. Repeated rows are documents of their
    own, with the same score.

    A text is split once; its buckets, two bytes a feature, are written and read again for the sums.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return _scores(rows, "id", target.select(F.col(target_text).alias("text")), share, seed,
                   min_words, buckets, longest).withColumnRenamed("id", id_col)


def _scores(rows: DataFrame, key: str, target: DataFrame, share=SHARE, seed=SEED,
            min_words=MIN_WORDS, buckets=BUCKETS, longest=LONGEST) -> DataFrame:
    """The scores of ``rows (id, text)``, with noise by ``key``, which is ``id`` or a field of it."""
    if not 1 <= buckets <= 1 << 16:
        raise ValueError("buckets are two bytes")
    coded = write_out(hashed_features(rows, buckets, longest), "features")
    wanted = hashed_features(target.select(F.lit(0).alias("id"), "text"), buckets, longest)
    gains = bucket_gains(histogram(coded, buckets), histogram(wanted, buckets))

    def weigh(batches):
        for batch in batches:
            weights = [int(gains[np.frombuffer(b, np.uint16)].sum()) for b in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(weights, pa.int64())],
                ["id", "n_words", "n_features", "weight"])

    kind = coded.schema["id"].dataType.simpleString()
    scored = write_out(coded.mapInArrow(
        weigh, f"id {kind}, n_words long, n_features long, weight long").withColumn(
        "score", F.col("weight") + noise(F.col(key), seed)), "scores")
    able = F.col("n_words") >= min_words
    draw = scored.filter(able).count() * share[0] // share[1]
    order = [F.desc("score"), F.asc_nulls_last(key), F.desc("n_words"), F.desc("weight"), F.col("id")]
    drawn = ranked(scored.filter(able), order, draw)
    rest = scored.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, text: str = "text", id_col: str = "doc_id",
             target_text: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns, and ``draw_rank``."""
    rid, rank = free_name(docs, "_rid"), free_name(docs, "draw_rank")
    rows = number_rows(docs, rid)
    # The number tells rows with equal ids apart; noise is drawn by the id.
    keyed = rows.select(F.struct(F.col(id_col).alias("key"), F.col(rid).alias("rid")).alias("id"),
                        F.col(text).alias("text"))
    drawn = _scores(keyed, "id.key", target.select(F.col(target_text).alias("text")), **options)
    return rows.join(drawn.filter("rank IS NOT NULL").select(
        F.col("id.rid").alias(rid), F.col("rank").alias(rank)), rid).drop(rid)
