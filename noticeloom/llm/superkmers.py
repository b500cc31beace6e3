"""Packing of consecutive windows that share a minimiser, and the way to their bucket and back.

A unit (word or byte) has a 64-bit code. The minimiser of a window is the least mixed
code of the grams in it, so equal windows have equal minimisers wherever they
stand. Consecutive windows with the same minimiser are one run, which travels as one
packed string: about twice the window long instead of once the window for each.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.session import write_out

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

#: Bytes of packed runs that a task gathers before it hands them on.
FLUSH_BYTES = 48 << 20
#: Texts that a task cuts into units at a time, in bytes.
CHUNK_BYTES = 1 << 20
#: Grams that a task counts at a time; one is frequent if it is so among these.
COUNT_GRAMS = 2 << 20
#: Runs that a bucket is meant for.
BUCKET_RUNS = 50_000
#: Windows that are ranked at a time; a long text is ranked in pieces.
PIECE = 1 << 20
#: Bits of a place in a piece and the rest of its last window.
PLACE_BITS, PLACE_MASK = np.uint64(24), np.uint64((1 << 24) - 1)
#: Null ids come after all others.
LAST = np.iinfo(np.int64).max


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int, back: bool = False) -> np.ndarray:
    """The first powers of the base, or of its inverse, modulo 2 to the 64th."""
    out = np.full(n, _INVERSE if back else _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def window_hashes(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` consecutive codes, by differences of one running sum."""
    n = len(codes)
    if n < width:
        return np.zeros(0, np.uint64)
    power, back = powers(n), powers(n - width + 1, back=True)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power, dtype=np.uint64)])
    part = total[width:] - total[:-width]
    # Undo the power of the window's place.
    return mix(part * back)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(values) - width + 1], out[width - have:][: len(values) - width + 1])
    return out


@dataclass
class Units:
    """A buffer of texts cut into units (words or bytes).

    ``at``: where each unit starts in ``data``, and the end; ``code``: what it is;
    ``owner``: its text; ``first``: the first unit of each text; ``owner_end``: for each unit
    the end of its text.
    """

    data: bytes
    at: np.ndarray
    code: np.ndarray
    counts: np.ndarray

    def __post_init__(self):
        ends = np.cumsum(self.counts)
        self.owner = np.repeat(np.arange(len(ends)), self.counts)
        self.first = ends - self.counts
        self.owner_end = np.repeat(ends, self.counts)


@dataclass
class Plan:
    """Units of a window and of a gram, number of buckets, sorted codes of hot grams."""

    window: int
    gram: int
    buckets: int
    hot: np.ndarray

    def find_runs(self, units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First unit, number of windows and minimiser of each run.

        The first of the least gram codes of a window is its minimiser; the windows of a run
        have it at one place, so no two of them are equal. Hot grams come after all others, so
        a window with anything rare in it meets its equals at the rare part, and only
        windows within a frequent passage, which are alike, meet at a hot gram.
        """
        n = len(units.code) - self.window + 1
        parts = [self._runs_of(units.code[i:i + PIECE + self.window - 1],
                               units.owner_end[i:i + PIECE + self.window - 1] - i, i)
                 for i in range(0, n, PIECE)]
        if not parts:
            none = np.zeros(0, np.int64)
            return none, none, none.view(np.uint64)
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

    def _runs_of(self, code: np.ndarray, end: np.ndarray, at_unit: int):
        n = len(code) - self.window + 1
        order = window_hashes(code, self.gram) >> np.uint64(1)
        if len(self.hot):
            place = np.minimum(np.searchsorted(self.hot, order), len(self.hot) - 1)
            order |= (self.hot[place] == order).astype(np.uint64) << np.uint64(63)
        # The upper bits of the code, then the place, so of equal ones the first counts.
        ranked = (order >> PLACE_BITS << PLACE_BITS) | np.arange(len(order), dtype=np.uint64)
        at = sliding_min(ranked, self.window - self.gram + 1) & PLACE_MASK
        valid = np.arange(n) + self.window <= end[:n]
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = (at[1:] != at[:-1]) | (end[1:n] != end[: n - 1])
        first = np.flatnonzero(new & valid)
        # A run ends where the next one starts or windows leave the text.
        stop = np.flatnonzero(np.append(new | ~valid, True))
        return (first + at_unit, stop[np.searchsorted(stop, first, side="right")] - first,
                order[at[first].astype(np.int64)])

    def bucket(self, key: np.ndarray) -> np.ndarray:
        return (mix(key ^ _BASE) % np.uint64(self.buckets)).astype(np.int64)


class Packer:
    """Gathers runs by bucket; ``blobs`` hands them out compressed."""

    def __init__(self):
        self.meta: list[np.ndarray] = []
        self.data: list[bytes] = []
        self.bucket: list[np.ndarray] = []
        self.size = 0

    def add(self, bucket: np.ndarray, meta: np.ndarray, data: list[bytes]) -> None:
        """``meta``: a row of whole numbers for each run."""
        self.bucket.append(bucket)
        self.meta.append(meta)
        self.data += data
        self.size += sum(map(len, data))

    def blobs(self):
        if not self.data:
            return
        bucket, meta = np.concatenate(self.bucket), np.concatenate(self.meta)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        press = zstandard.ZstdCompressor(level=3)
        for part in np.split(order, cuts):
            own = [self.data[i] for i in part.tolist()]
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            rows = meta[part]
            head = struct.pack("<qq", *rows.shape)
            yield int(bucket[part[0]]), press.compress(
                head + rows.T.tobytes() + lengths.tobytes() + b"".join(own))
        self.__init__()


def unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Meta rows, lengths and joined data of the runs in ``blobs``."""
    metas, lengths, data = [], [], []
    press = zstandard.ZstdDecompressor()
    for blob in blobs:
        raw = press.decompress(blob)
        n, width = struct.unpack_from("<qq", raw)
        end = 16 + 8 * n * width
        metas.append(np.frombuffer(raw, np.int64, n * width, 16).reshape(width, n).T)
        lengths.append(np.frombuffer(raw, np.int64, n, end))
        data.append(raw[end + 8 * n:])
    return np.concatenate(metas), np.concatenate(lengths), b"".join(data)


def merge_ranges(key: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Union of ranges that touch or overlap, for each key; sorted."""
    if not len(key):
        return key, start, end
    order = np.lexsort((start, key))
    key, start, end = key[order], start[order], end[order]
    # The furthest end so far within the key: ends are raised above those of smaller keys.
    group = np.cumsum(np.append(0, np.diff(key) != 0)) if len(key) > 1 else np.zeros(1, np.int64)
    span = int(end.max()) + 1
    far = np.maximum.accumulate(end + group * span)
    new = np.append(True, start[1:] + group[1:] * span > far[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(key)) - 1
    return key[first], start[first], far[last] - group[last] * span


def chunks(batch: pa.RecordBatch):
    """Slices of a batch (rid, id, text) whose texts are of a bounded size, or one text."""
    sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(sizes):
        if i > start and size + n > CHUNK_BYTES:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def plan_buckets(rows: DataFrame, cut: Callable, window: int, gram: int,
                 share: int, least: int = 16) -> Plan:
    """The number of buckets, and the grams that are too frequent to be minimisers.

    Every text is read. Of all gram codes only one in ``share`` is low enough to become a
    minimiser in practice, and only these are counted. A gram is hot beyond an even
    share of all runs; the number of hot grams is bounded by the number of partitions.
    Hot grams decide where windows meet, not what is found.
    """
    limit = np.array([(1 << 63) // share], np.uint64)

    def counts(parts, windows):
        key, n = np.unique(np.concatenate([*parts, limit[:0]]), return_counts=True)
        often = n >= least
        return pa.RecordBatch.from_arrays(
            [pa.array(np.append(key[often].view(np.int64), -1)), pa.array(np.append(n[often], 0)),
             pa.array(np.append(np.zeros(int(often.sum()), np.int64), windows))],
            ["key", "n", "windows"])

    def count(batches):
        parts, held, windows = [], 0, 0
        for batch in batches:
            for part in chunks(batch):
                units = cut(part.column(2).to_pylist())
                windows += int(np.maximum(units.counts - window + 1, 0).sum())
                for i in range(0, len(units.code) - gram + 1, PIECE):
                    code = window_hashes(units.code[i:i + PIECE + gram - 1], gram) >> np.uint64(1)
                    parts.append(code[code < limit])
                    held += len(parts[-1])
                if held > COUNT_GRAMS:
                    yield counts(parts, windows)
                    parts, held, windows = [], 0, 0
        yield counts(parts, windows)

    sums = (rows.mapInArrow(count, "key long, n long, windows long").groupBy("key")
            .agg(F.sum("n").alias("n"), F.sum("windows").alias("windows")))
    counted = write_out(sums, "grams")
    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = (counted.agg(F.sum("windows")).first()[0] or 0) * 2 // (window - gram + 2)
    hot = counted.filter(F.col("n") > max(runs // slots, 1000)).select("key").collect()
    return Plan(window, gram, max(slots, runs // BUCKET_RUNS),
                np.sort(np.array([r.key for r in hot], np.int64)).view(np.uint64))


_PACKED = "bucket long, blob binary, rids binary, starts binary, ends binary"
_NO_FLAGS = {c: pa.array([None], pa.binary()) for c in ("rids", "starts", "ends")}


def _flags(bucket: int, rid, start, end) -> pa.RecordBatch:
    rid, start, end = merge_ranges(rid, start, end)
    return pa.RecordBatch.from_pydict({
        "bucket": [bucket], "blob": pa.array([None], pa.binary()), "rids": [rid.tobytes()],
        "starts": [start.tobytes()], "ends": [end.tobytes()]})


def pack(plan: Plan, cut: Callable, collapse: Callable) -> Callable:
    """Cut texts into runs, and hand them on by bucket, with what is already known to repeat.

    ``collapse`` gets the strings of a task's runs and their rows (id, rid, first unit, windows,
    minimiser), and returns which travel, with what note, and which surely repeat.
    """
    def flush(held):
        data = [d for _, own in held for d in own]
        meta = np.concatenate([m for m, _ in held])
        travels, note, repeats = collapse(data, meta)
        rows = np.concatenate([meta, note[:, None]], 1)[travels]
        packer = Packer()
        packer.add(plan.bucket(rows[:, 4].view(np.uint64)), rows,
                   [d for d, t in zip(data, travels.tolist(), strict=True) if t])
        for bucket, blob in packer.blobs():
            yield pa.RecordBatch.from_pydict({"bucket": [bucket], "blob": [blob], **_NO_FLAGS})
        gone = meta[repeats]
        if len(gone):
            yield _flags(int(gone[0, 1]) % plan.buckets, gone[:, 1], gone[:, 2],
                         gone[:, 2] + gone[:, 3] + plan.window - 1)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in chunks(batch):
                units = cut(part.column(2).to_pylist())
                first, windows, key = plan.find_runs(units)
                if not len(first):
                    continue
                doc = units.owner[first]
                ids = pc.fill_null(part.column(1), LAST).to_numpy(zero_copy_only=False)
                rids = part.column(0).to_numpy(zero_copy_only=False)
                meta = np.stack([ids[doc], rids[doc], first - units.first[doc], windows,
                                 key.view(np.int64)], 1)
                a, b = units.at[first], units.at[first + windows + plan.window - 1]
                # A text that repeats itself all along has a run for each window.
                piece = np.cumsum(b - a) // FLUSH_BYTES
                for own in np.split(np.arange(len(first)), np.flatnonzero(np.diff(piece)) + 1):
                    held.append((meta[own], [units.data[i:j] for i, j in zip(
                        a[own].tolist(), b[own].tolist(), strict=True)]))
                    size += int((b - a)[own].sum())
                    if size > FLUSH_BYTES:
                        yield from flush(held)
                        held, size = [], 0
        if held:
            yield from flush(held)
    return run


def find_ranges(rows: DataFrame, plan: Plan, cut: Callable, collapse: Callable,
                judge: Callable) -> DataFrame:
    """``(rid, start, end)``: ranges of units that repeat.

    ``judge`` gets the rows and strings of a bucket's runs (id, rid, first unit, windows,
    minimiser, note) and returns the ranges it finds.
    """
    def sort(batches):
        rows = ((r["bucket"], r) for b in batches for r in b.to_pylist())
        for _, own in groupby(rows, key=lambda x: x[0]):
            blobs, found = [], []
            for _, r in own:
                if r["blob"] is None:
                    found.append([np.frombuffer(r[c], np.int64) for c in ("rids", "starts", "ends")])
                else:
                    blobs.append(r["blob"])
            if blobs:
                found.append(judge(*unpack(blobs), plan.window))
            for rid, start, end in found:
                if len(rid):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rid), pa.array(start), pa.array(end)], ["rid", "start", "end"])

    slots = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = rows.mapInArrow(pack(plan, cut, collapse), _PACKED)
    return (packed.repartition(slots, "bucket").sortWithinPartitions("bucket")
            .mapInArrow(sort, "rid long, start long, end long"))


def with_ranges(docs: DataFrame, number: str, ranges: DataFrame, id_col: str, text: str) -> DataFrame:
    """``id, text, ranges`` of every row; a text meets its ranges by the ``number`` of its row."""
    own = docs.select(F.col(number).alias("rid"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    gathered = ranges.groupBy("rid").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    return own.join(gathered, "rid", "left").select("id", "text", "ranges")


def covered(n: int, ranges: list[dict] | None) -> np.ndarray:
    """Which of ``n`` units lie in one of the ranges."""
    step = np.zeros(n + 1, np.int64)
    for r in ranges or ():
        step[r["start"]] += 1
        step[r["end"]] -= 1
    return np.cumsum(step[:-1]) > 0
