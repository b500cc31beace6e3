"""Vector codes by product quantisation on whole numbers, with a dictionary of values per dimension."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.session import write_out

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that share their dictionaries; distances to all entries are held for so many at a time.
CHUNK = 4096
#: Components beyond this size count as this size, so that sums of squares fit 64 bits.
MOST = 1 << 26


def _whole(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and joined components of list rows, as rounded-down whole numbers."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    lengths = np.diff(column.offsets.to_numpy())
    return lengths, np.clip(np.floor(flat * scale), -MOST, MOST).astype(np.int64)


def _dictionaries(vectors: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Sizes, sorted different values of every dimension, and the vectors as places in them."""
    values, codes = zip(*(np.unique(v, return_inverse=True) for v in vectors.T), strict=True)
    sizes = np.array([len(v) for v in values], np.int32)
    return sizes.tobytes(), np.concatenate(values).tobytes(), np.stack(codes).astype(np.uint16).tobytes()


def _encode(width: int, scale: int, kinds: tuple[pa.DataType, pa.DataType]):
    """Chunks of vectors of ``width`` components: ids, labels, dictionaries and codes."""
    names = ["ids", "labels", "sizes", "vocabulary", "codes"]

    def chunk(ids, labels, vectors):
        return pa.RecordBatch.from_arrays(
            [pa.array([x], pa.list_(k)) for x, k in zip((ids, labels), kinds, strict=True)]
            + [pa.array([b], pa.binary()) for b in _dictionaries(vectors)], names)

    def run(batches):
        ids, labels, held, n = [], [], [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(2).combine_chunks() if isinstance(
                batch.column(2), pa.ChunkedArray) else batch.column(2)
            held.append(_whole(column, scale)[1].reshape(-1, width))
            ids += batch.column(0).to_pylist()
            labels += batch.column(1).to_pylist()
            n += batch.num_rows
            while n >= CHUNK:
                vectors = np.concatenate(held)
                yield chunk(ids[:CHUNK], labels[:CHUNK], vectors[:CHUNK])
                ids, labels, held, n = ids[CHUNK:], labels[CHUNK:], [vectors[CHUNK:]], n - CHUNK
        if n:
            yield chunk(ids, labels, np.concatenate(held))
    return run


class Codebooks:
    """``entries``: whole numbers by part, entry and place within the part."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries

    def assign(self, sizes: bytes, vocabulary: bytes, codes: bytes):
        """For every vector and part the nearest entry (the lowest of equal ones) and its
        squared distance: tables hold the squared difference of each value of a dimension to
        all entries, and a distance is the sum of what the vector's codes pick from them."""
        parts, _, depth = self.entries.shape
        ends = np.cumsum(np.frombuffer(sizes, np.int32))
        values = np.frombuffer(vocabulary, np.int64)
        code = np.frombuffer(codes, np.uint16).reshape(parts * depth, -1)
        nearest = np.empty((code.shape[1], parts), np.int64)
        least = np.empty_like(nearest)
        for part in range(parts):
            distance = 0
            for j in range(depth):
                d = part * depth + j
                own = values[ends[d - 1] if d else 0:ends[d]]
                table = (own[:, None] - self.entries[part, :, j]) ** 2
                if table.max() * depth < 1 << 31:
                    table = table.astype(np.int32)
                distance = distance + table[code[d]]
            nearest[:, part] = distance.argmin(1)
            least[:, part] = np.take_along_axis(distance, nearest[:, part:part + 1], 1)[:, 0]
        return nearest, least

    def vectors(self, sizes: bytes, vocabulary: bytes, codes: bytes) -> np.ndarray:
        parts, _, depth = self.entries.shape
        values = np.frombuffer(vocabulary, np.int64)
        code = np.frombuffer(codes, np.uint16).reshape(parts * depth, -1)
        begins = np.cumsum(np.append(0, np.frombuffer(sizes, np.int32)[:-1]))
        return np.stack([values[b + c] for b, c in zip(begins, code, strict=True)], 1)

    def sums(self, batches):
        """Sum and count of the parts that each entry is nearest to: one table a task."""
        parts, n, depth = self.entries.shape
        total = np.zeros((parts, n, depth + 1), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                nearest, _ = self.assign(**row)
                vectors = self.vectors(**row)
                for part in range(parts):
                    for j in range(depth):
                        # Sums of 64-bit whole numbers, in order of the entry.
                        np.add.at(total[part, :, j], nearest[:, part], vectors[:, part * depth + j])
                    total[part, :, depth] += np.bincount(nearest[:, part], minlength=n)
        slot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(slot), pa.array(total.ravel()[slot])], ["slot", "total"])

    def moved(self, chunks: DataFrame) -> Codebooks:
        """The entries replaced by the rounded-down means of their parts; unused ones stay.
        What comes to the driver has the size of the codebooks."""
        parts, n, depth = self.entries.shape
        total = np.zeros(parts * n * (depth + 1), np.int64)
        for r in (chunks.select("sizes", "vocabulary", "codes")
                  .mapInArrow(self.sums, "slot long, total long")
                  .groupBy("slot").agg(F.sum("total").alias("total")).collect()):
            total[r.slot] = r.total
        total = total.reshape(parts, n, depth + 1)
        count = total[:, :, depth:]
        return Codebooks(np.where(count > 0, total[:, :, :depth] // np.maximum(count, 1), self.entries))

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _coded(books: Codebooks, kinds: tuple[pa.DataType, pa.DataType]):
    hexes = np.array([f"{i:02x}" for i in range(books.entries.shape[1])])

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = row.pop("ids"), row.pop("labels")
                nearest, least = books.assign(**row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, kinds[0]), pa.array(labels, kinds[1]),
                     pa.array(["".join(c) for c in hexes[nearest].tolist()]),
                     pa.array(least.sum(1))], ["id", "label", "code", "error"])
    return run


def compress_vectors(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding",
                     label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
                     rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``(coded, codebooks)``: a row for each kept row of ``table`` with its id, label, ``code`` (two
    hex digits a part), ``error`` (squared distances to the entries, in whole numbers) and
    ``label_error`` (its sum over equal labels, nulls together); and the codebooks by part, entry and place.

    Vectors that are null, empty or hold a null or non-finite component are dropped. Components are
    multiplied by ``scale`` and rounded down, and limited to 2 to the 26th. All vectors are
    meant to have one length, a multiple of ``parts``; if they do not, those of the most frequent
    such length are kept (the longest of equally frequent ones). The first codebooks are the parts of the vectors with the smallest ids
    (nulls last, equal ids in the order of their components); with fewer vectors than
    ``entries`` there are fewer entries. Repeated rows all count. A table without a
    vector to keep gives no rows.

    The vectors are read once and written as chunks of places in the chunk's dictionaries, about two
    bytes a component; each round reads these, and only sums of the codebooks' size move.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits")
    spark = table.sparkSession
    rows = table.select(F.col(id_col).alias("id"), F.col(label).alias("label"),
                        F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.filter(F.coalesce((F.size("v") > 0) & fine, F.lit(False)))
    lengths = rows.filter(F.size("v") % parts == 0).groupBy(F.size("v").alias("n")).count()
    usual = lengths.orderBy(F.desc("count"), F.desc("n")).first()
    empty = spark.createDataFrame([], rows.select("id", "label").schema).select(
        F.col("id").alias(id_col), F.col("label").alias(label), F.lit("").alias("code"),
        F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"))
    if usual is None:
        return empty, np.zeros((parts, 0, 0), np.int64)
    width = usual.n
    rows = rows.filter(F.size("v") == width)
    first = rows.orderBy(F.asc_nulls_last("id"), "v").limit(entries).select("v").collect()
    start = np.clip(np.floor(np.array([r.v for r in first]) * scale), -MOST, MOST).astype(np.int64)
    books = Codebooks(start.reshape(len(first), parts, width // parts).swapaxes(0, 1))
    kinds = tuple(pa.field(f.name, _arrow(f.dataType)).type for f in rows.select("id", "label").schema)
    names = [rows.schema[c].dataType.simpleString() for c in ("id", "label")]
    chunks = write_out(rows.mapInArrow(
        _encode(width, scale, kinds), f"ids array<{names[0]}>, labels array<{names[1]}>, "
        "sizes binary, vocabulary binary, codes binary"), "vectors")
    for _ in range(rounds):
        books = books.moved(chunks)
    coded = write_out(chunks.mapInArrow(
        _coded(books, kinds), f"id {names[0]}, label {names[1]}, code string, error long"), "codes")
    # One sum a label, merged within tasks; a hot label is split by the join of two written sides.
    sums = write_out(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    joined = coded.join(sums.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("id").alias(id_col), F.col("label").alias(label), "code", "error",
                         "label_error"), books.entries


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(kind)


def vector_codes_digest(coded: DataFrame, codebooks: np.ndarray, id_col: str = "vec_id") -> DataFrame:
    return coded.select(id_col, "code", "error", "label_error",
                        F.lit(Codebooks(codebooks).sha256()).alias("codebooks_sha256"))
