"""Personal data: fixed patterns, and identifiers learned from the words around them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeloom.session import write_out

KINDS = ("email", "ip", "card", "phone")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A match that is not right after a digit starts where one without the look-behind would:
# digits are taken greedily, so the first digit of a run decides, and a match ends with its run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# Shapes of identifiers that the fixed patterns leave, by kind. A token is a run without space.
_TOKEN = re.compile(r"[^\s\"'<>()\[\]{}=,;|]+")
_SHAPES = (
    (0, re.compile(r"[^@]{1,64}@[^@]{1,253}")),
    (1, re.compile(r"(?=[^.:]*[.:][^.:]*[.:])[0-9A-Fa-f.:]{5,45}")),
    (2, re.compile(r"[0-9](?:[-./_]?[0-9]){11,24}")),
    (3, re.compile(r"\+?[0-9](?:[-./_]?[0-9]){6,14}")),
)
# Digits written with spaces, brackets and signs between them. A bracket before the first digit is
# part of the number if it closes behind a few digits. Kinds with the fewest and most digits.
_NUMBER = re.compile(r"(?<![^\W_])(?<!@)(?:\+?\((?=[0-9 ]{1,8}\))|\+)?[0-9](?:(?:\)?[./_]|[ ()-]*+)[0-9])*+")
_DIGITS = re.compile(r"[0-9]+")
_BRACKET = re.compile(r"\([0-9 ]{1,8}\)")
_SIZES = ((2, 12, 25), (3, 7, 15))
_WORD = re.compile(r"\w+|[^\w\s]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (host := _HOST.match(text, at + 1)):
            last = host.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points, sorted."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255
               for part in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, *m.span()))
    return out


_MAYBE = re.compile(r"[0-9@]")


def _numbers(text: str, base: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """Numbers of one or more groups between the base spans: from each start behind a space or
    bracket and of each kind, the longest that fits."""
    at = 0
    for low, high in [*base, (len(text), len(text))]:
        for m in _NUMBER.finditer(text, at, low) if low > at else ():
            groups = [g.span() for g in _DIGITS.finditer(text, m.start(), m.end())]
            bracket = "(" in m.group()
            # Within the number, a sign follows each group.
            after = text[m.end():m.end() + 1]
            torn = m.end() if after.isalnum() or after == "@" else -1
            for i, (first, _) in enumerate(groups):
                start = m.start() if i == 0 else first - bool(_BRACKET.match(text, first - 1))
                if i and text[first - 1] not in " (":
                    continue
                digits, opened, last, ends = 0, 0, start, {}
                for a, b in groups[i:i + 25]:
                    if bracket:
                        opened += text.count("(", last, a) - text.count(")", last, a)
                    last = b
                    digits += b - a
                    if digits > 25:
                        break
                    if digits >= 7 and opened == 0 and b != torn:
                        for k, least, most in _SIZES:
                            if least <= digits <= most:
                                ends[k] = b
                yield from ((k, start, end) for k, end in ends.items())
        at = max(at, high)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What has the shape of an identifier and no base span touches, once for each kind that fits:
    tokens, and numbers over spaces and brackets. Of one start and kind, the longest."""
    taken = sorted((a, b) for _, a, b in base)
    found = {(k, a): b for k, a, b in _numbers(text, taken)}
    at = i = 0
    while (m := _MAYBE.search(text, at)) is not None:
        # The token around this digit or @; it starts after the last break before it.
        start = m.start()
        while start > at and _TOKEN.match(text, start - 1):
            start -= 1
        at = end = _TOKEN.match(text, start).end()
        token = text[start:end].rstrip(".:!?-")
        end = start + len(token)
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if i < len(taken) and taken[i][0] < end:
            continue
        for kind, shape in _SHAPES:
            if shape.fullmatch(token):
                found[kind, start] = max(end, found.get((kind, start), 0))
    return sorted((k, a, b) for (k, a), b in found.items())


#: Characters before an identifier in which its lexical pattern is looked for.
CONTEXT_CHARS = 80


def pattern(text: str, start: int) -> str:
    """The last two words or signs before ``start``, lower-cased; ``^`` for the start of the text."""
    before = ["^", "^", *_WORD.findall(text[max(0, start - CONTEXT_CHARS):start].lower())]
    return " ".join(before[-2:])


_MARK = pa.struct([("kind", pa.int8()), ("start", pa.int64()), ("end", pa.int64()),
                   ("pattern", pa.string()), ("instance", pa.string()), ("base", pa.bool_())])
_MARKS = ("array<struct<kind:tinyint,start:long,end:long,pattern:string,instance:string,"
          "base:boolean>>")


def _extract(batches):
    for batch in batches:
        marks = []
        for value in batch.column(1).to_pylist():
            text = value or ""
            base = base_spans(text)
            found = [(*s, True) for s in base] + [(*s, False) for s in candidates(text, base)]
            marks.append([{"kind": k, "start": a, "end": b, "pattern": pattern(text, a),
                           "instance": text[a:b].lower(), "base": own} for k, a, b, own in found])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(marks, pa.list_(_MARK))], ["id", "marks"])


def score_patterns(marks: DataFrame, rounds: int, min_support: int, prior: float) -> DataFrame:
    """``(kind, pattern, score)`` after ``rounds`` of scoring the pattern-instance graph.

    An instance of a base span is certain. A pattern's score is the mean certainty
    of the different instances it holds, weighted down by ``prior`` uncertain ones; an
    instance's is that of a noisy-or over its patterns of at least ``min_support``
    instances. Edges are counted once each and merged within tasks before they move,
    so a frequent pattern or instance is no hot spot; each round is a table in the shared folder.
    """
    edges = write_out(marks.groupBy("kind", "pattern", "instance")
                      .agg(F.max("base").alias("base")), "edges")
    known = write_out(edges.groupBy("kind", "instance").agg(
        F.max(F.col("base").cast("double")).alias("sure")), "instances")
    for _ in range(rounds):
        held = edges.join(known, ["kind", "instance"])
        scores = held.groupBy("kind", "pattern").agg(
            F.count("*").alias("n"), F.sum("sure").alias("support"),
            (F.sum("sure") / (F.count("*") + prior)).alias("score"))
        scores = write_out(scores, "patterns")
        strong = scores.filter(F.col("n") >= min_support).select("kind", "pattern", "score")
        miss = F.sum(F.log1p(-F.least(F.col("score"), F.lit(0.999))))
        known = write_out(
            edges.join(strong, ["kind", "pattern"], "left").groupBy("kind", "instance")
            .agg(F.when(F.max("base"), 1.0).otherwise(
                1 - F.exp(F.coalesce(miss, F.lit(0.0)))).alias("sure")), "instances")
    return scores


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text",
                       rounds: int = 3, min_support: int = 5, min_score: float = 0.6,
                       prior: float = 2.0) -> DataFrame:
    """One row per row of ``docs``: id and ``spans``, an array of (kind, start, end, base).

    Kinds are numbers in the order of ``KINDS``, places are code points, ends exclusive. Base
    spans are those of the fixed patterns. Their contexts become patterns, and where a
    pattern scores ``min_score`` or more and the certainties of its different instances, base or
    discovered, sum up to ``min_support``,
    tokens and numbers of the same kind's shape behind it are spans too; where several kinds fit, that
    whose pattern scores best. A null text is empty.

    Texts are read once and do not move; what is written and shuffled are the marks: base
    spans and identifier-shaped tokens, each with its pattern.
    """
    rows = docs.select(F.col(id_col).alias("id"), text)
    # Numbered as they are written, so every reading finds the same numbers.
    numbered = write_out(rows.mapInArrow(
        _extract, f"id {rows.schema['id'].dataType.simpleString()}, marks {_MARKS}").withColumn(
        "rid", F.monotonically_increasing_id()), "marks")
    marks = numbered.select("rid", F.inline("marks"))
    patterns = score_patterns(marks, rounds, min_support, prior)
    good = patterns.filter((F.col("score") >= min_score) & (F.col("support") >= min_support))
    # Of the kinds that fit at one place, that with the best pattern.
    best = F.struct("score", "end", (-F.col("kind")).alias("turn"), "kind")
    more = (marks.filter("NOT base").join(good.select("kind", "pattern", "score"), ["kind", "pattern"])
            .groupBy("rid", "start").agg(F.max(best).alias("best"))
            .groupBy("rid").agg(F.collect_list(F.struct(
                "best.kind", "start", "best.end", F.lit(False).alias("base"))).alias("more")))
    base = F.transform(F.filter("marks", lambda m: m["base"]), lambda m: F.struct(
        m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"),
        m["base"].alias("base")))
    return numbered.join(more, "rid", "left").select(
        F.col("id").alias(id_col),
        F.array_sort(F.when(F.col("more").isNull(), base).otherwise(
            F.concat(base, "more"))).alias("spans"))


def personal_data_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The number of base spans of each kind, the digest of all base spans, and all spans."""
    names = F.array(*map(F.lit, KINDS))

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(k: int):
        return F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select(id_col, *counts, F.sha2(line(base), 256).alias("base_sha256"),
                        line(F.col("spans")).alias("spans"))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; overlaps become one."""
    merged: list[list] = []
    for start, end, kind in sorted((a, b, k) for k, a, b in spans):
        if merged and start < merged[-1][1]:
            merged[-1][1] = max(end, merged[-1][1])
        else:
            merged.append([start, end, kind])
    cuts = [0, *(x for a, b, _ in merged for x in (a, b)), len(text)]
    keep = [text[a:b] for a, b in list(pairwise(cuts))[::2]]
    return "".join(x for pair in zip(keep, [f"<{KINDS[k]}>" for *_, k in merged] + [""],
                                     strict=True) for x in pair)
