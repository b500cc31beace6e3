"""Secrets: fixed patterns, and strings that a battery of randomness tests tells from words."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeloom.session import write_out

#: Kinds of spans; the last is that of the tests.
KINDS = ("assign", "access", "hex", "random")

# Letters of the names in either case, in ASCII only.
_ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
                     r"([A-Za-z0-9+/_.=-]+)")
# A run of these letters is one match, so shorter ones may be skipped at once.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns by start, then kind; code points, end exclusive."""
    out = [(0, *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    out += [(1, *m.span()) for m in _ACCESS.finditer(text)]
    out += [(2, *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


#: Shortest string that the tests look at.
LEAST = 16
# A string of the letters of some encoding. Signs at its ends belong to what is around it.
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}")
_ENDS = "+/_-"

_DIGITS = "0123456789"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Encodings from the smallest alphabet up, letters in order of their value.
ENCODINGS = (
    ("decimal", _DIGITS),
    ("hex", _DIGITS + "abcdef"),
    ("HEX", _DIGITS + "ABCDEF"),
    ("base32", _UPPER + "234567"),
    ("base36", _DIGITS + _LOWER),
    ("BASE36", _DIGITS + _UPPER),
    ("base62", _UPPER + _LOWER + _DIGITS),
    ("base64", _UPPER + _LOWER + _DIGITS + "+/"),
    ("base64url", _UPPER + _LOWER + _DIGITS + "-_"),
    ("mixed", _UPPER + _LOWER + _DIGITS + "+/-_"),
)


def _values(alphabet: str) -> np.ndarray:
    out = np.full(128, -1, np.int64)
    out[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    return out


_TABLES = [(name, len(letters), _values(letters)) for name, letters in ENCODINGS]


def infer_encoding(token: str) -> tuple[str, int, np.ndarray]:
    """The smallest encoding with all letters of the token, its size, and the token's values."""
    codes = np.frombuffer(token.encode("ascii"), np.uint8)
    for name, size, table in _TABLES:
        values = table[codes]
        if values.min() >= 0:
            return name, size, values
    raise ValueError("a token has letters of some encoding")


def chi_squared_tail(x: float, k: int) -> float:
    """How likely a chi-squared value with ``k`` degrees of freedom is above ``x`` (cube-root rule)."""
    z = ((x / k) ** (1 / 3) - (1 - 2 / (9 * k))) / math.sqrt(2 / (9 * k))
    return 0.5 * math.erfc(z / math.sqrt(2))


@dataclass
class Battery:
    """Likelihoods of three statistics if every letter were drawn evenly from the alphabet."""

    uniform: float
    runs: float
    serial: float

    @property
    def combined(self) -> float:
        """Fisher's sum of logarithms: even in 0..1 for random strings, near 0 for others."""
        half = -sum(math.log(max(p, 1e-300)) for p in (self.uniform, self.runs, self.serial))
        return math.exp(-half) * (1 + half + half * half / 2)


def battery(size: int, values: np.ndarray) -> Battery:
    """The tests of a string with these values from an alphabet of ``size`` letters.

    Evenness: chi-squared over the letters of the alphabet; of a short string it mostly counts
    repeated letters, which words have. Runs: how often the string crosses the middle of the alphabet.
    Serial correlation: of neighbours, with the mean and variance of the alphabet.
    """
    n = len(values)
    seen = np.bincount(values, minlength=size)
    uniform = chi_squared_tail(float(((seen - n / size) ** 2).sum() * size / n), size - 1)
    high = values * 2 >= size
    above = int(high.sum())
    below = n - above
    if above and below:
        mean = 2 * above * below / n + 1
        spread = math.sqrt((mean - 1) * (mean - 2) / (n - 1))
        crossings = 1 + int((high[1:] != high[:-1]).sum())
        # Half a run of slack, as runs are whole numbers.
        z = max(0.0, abs(crossings - mean) - 0.5) / spread if spread else 0.0
        runs = math.erfc(z / math.sqrt(2))
    else:
        runs = 0.5 ** min(n - 1, 1000)
    off = values - (size - 1) / 2
    z = float((off[1:] * off[:-1]).sum()) / ((size * size - 1) / 12 * math.sqrt(n - 1))
    return Battery(uniform, runs, math.erfc(abs(z) / math.sqrt(2)))


def band_of(length: int) -> int:
    """Lengths in bands, four to each doubling: longer strings give the tests more power."""
    return int(4 * math.log2(length / LEAST))


#: Steps of the combined likelihood in which strings are counted.
STEPS = 200


def tokens(text: str, base: list[tuple[int, int, int]]):
    """(start, end) of strings that no base span touches."""
    taken = sorted((a, b) for _, a, b in base)
    i = far = 0
    for m in _TOKEN.finditer(text):
        token = m.group()
        start = m.start() + len(token) - len(token.lstrip(_ENDS))
        end = m.start() + len(token.rstrip(_ENDS))
        while i < len(taken) and taken[i][0] < end:
            far = max(far, taken[i][1])
            i += 1
        if end - start >= LEAST and far <= start:
            yield start, end


class _Tested:
    """Test results of strings, kept by a task until there are too many."""

    MOST = 200_000

    def __init__(self):
        self.kept: dict[str, tuple] = {}

    def get(self, token: str) -> tuple:
        have = self.kept.get(token)
        if have is None:
            encoding, size, values = infer_encoding(token)
            figures = [c.isdigit() for c in token]
            # A word has no digits. Numbers have nothing else; what digits encode, words cannot tell.
            kind = "number" if all(figures) else "mixed" if any(figures) else "word"
            found = battery(size, values)
            step = min(int(found.combined * STEPS), STEPS - 1)
            have = (kind, encoding, band_of(len(token)), step, xxhash.xxh3_64_intdigest(token) >> 1)
            if len(self.kept) >= self.MOST or len(token) > 1000:
                self.kept.clear()
            self.kept[token] = have
        return have


_SPAN = "struct<kind:tinyint,start:long,end:long>"
_STRING = "struct<start:long,end:long,what:string,encoding:string,band:int,step:int,token:long>"
_SPAN_TYPE = pa.struct([("kind", pa.int8()), ("start", pa.int64()), ("end", pa.int64())])
_STRING_TYPE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("what", pa.string()),
                          ("encoding", pa.string()), ("band", pa.int32()), ("step", pa.int32()),
                          ("token", pa.int64())])


def _extract(batches):
    tested = _Tested()
    for batch in batches:
        spans, strings = [], []
        for value in batch.column(1).to_pylist():
            text = value or ""
            base = base_spans(text)
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in base])
            own = []
            for a, b in tokens(text, base):
                what, encoding, band, step, token = tested.get(text[a:b])
                if what != "number":
                    own.append({"start": a, "end": b, "what": what, "encoding": encoding,
                                "band": band, "step": step, "token": token})
            strings.append(own)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(spans, pa.list_(_SPAN_TYPE)),
             pa.array(strings, pa.list_(_STRING_TYPE))], ["id", "base", "strings"])


def least_steps(counts: list[tuple[str, int, int, int]], discovery_rate: float) -> dict[int, int]:
    """For each length band the lowest step from which on mixed strings count as secrets.

    ``counts``: (what, band, step, n) of the different strings. Words of a band show how often what is
    not random passes a step. The tests only get sharper with length, so the rate of any
    shorter band holds for a longer one too, and the least of them is taken. What does
    not pass among the mixed strings, over the share that words fail, estimates how many of them are
    ordinary; times the rate, how many of those pass. The lowest step is the first at which these are at most
    ``discovery_rate`` of all that pass; a band without such a step finds nothing.
    """
    most = max((band for _, band, _, _ in counts), default=-1)
    words, mixed = np.zeros((most + 1, STEPS)), np.zeros((most + 1, STEPS))
    for what, band, step, n in counts:
        (words if what == "word" else mixed)[band, step] += n
    passing = words[:, ::-1].cumsum(1)[:, ::-1]
    # One more word that passes: a few words prove little.
    rate = np.minimum.accumulate((passing + 1) / (words.sum(1, keepdims=True) + 1), axis=0)
    out = {}
    for band in range(most + 1):
        above = mixed[band, ::-1].cumsum()[::-1]
        below = mixed[band].sum() - above
        false = below / np.maximum(1 - rate[band], 1e-9) * rate[band]
        # Of none that fail there may still be one.
        false = np.maximum(false, rate[band])
        good = np.flatnonzero((above > 0) & (rate[band] < 1) & (false <= discovery_rate * above))
        # From where random strings are expected in earnest; the lowest steps are those of words.
        good = good[good >= 1]
        if len(good):
            out[band] = int(good[0])
    return out


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                 discovery_rate: float = 0.05) -> DataFrame:
    """One row per row of ``docs``: id and ``spans``, an array of (kind, start, end) by start, then kind.

    Kinds are numbers in the order of ``KINDS``, places are code points, ends exclusive. The first three are
    the fixed patterns. ``random`` are strings of 16 or more letters of an encoding, with digits
    and letters, that touch no other span and pass three tests of randomness under the smallest
    encoding that has their letters. How well they must pass depends on the length: so that of
    the different strings found in a length band at most the share ``discovery_rate`` is
    expected to be ordinary, as the corpus's own words tell. A null text is empty; repeated rows
    all get their spans, but a string counts once however often it occurs.

    Texts are read once and do not move. Written are places and test results; the
    counts that come to the driver are at most 200 steps a length band.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = write_out(rows.mapInArrow(
        _extract, f"id {kind}, base array<{_SPAN}>, strings array<{_STRING}>"), "strings")
    different = found.select(F.inline("strings")).groupBy("what", "band", "step", "token").agg(
        F.lit(1).alias("one"))
    counts = [tuple(r) for r in different.groupBy("what", "band", "step").count().collect()]
    least = least_steps(counts, discovery_rate)
    passing = F.lit(False)
    lookup = F.create_map(*(F.lit(x) for item in sorted(least.items()) for x in item)) if least else None

    def passes(s: Column) -> Column:
        if lookup is None:
            return passing
        return (s["what"] == "mixed") & F.coalesce(s["step"] >= F.element_at(lookup, s["band"]), passing)

    more = F.transform(F.filter("strings", passes), lambda s: F.struct(
        F.lit(3).cast("tinyint").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    by_place = F.array_sort(F.transform(F.concat("base", more), lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return found.select(F.col("id").alias(id_col), F.transform(by_place, lambda s: F.struct(
        s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def secrets_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The number of base spans of each kind, the digest of all base spans, and all spans."""
    names = F.array(*map(F.lit, KINDS))

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{name}")
              for k, name in enumerate(KINDS[:3])]
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return found.select(id_col, *counts, F.sha2(line(base), 256).alias("base_sha256"),
                        line(F.col("spans")).alias("spans"))
