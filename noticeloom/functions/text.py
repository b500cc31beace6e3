"""Column functions over notice text. All native: no Python in the hot path."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from noticeloom.functions import vocab as V


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body reads it.

    Needed around lambdas: an expression named inside one is evaluated per element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(col: Column) -> Column:
    """Remove white space at both ends, including no-break spaces (``trim`` keeps those)."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+\z", "")


def contains_any(col: Column, words: Sequence[str], whole: bool = False) -> Column:
    """True when any word occurs in ``col`` as a substring, ignoring case; ``whole``: as a whole word,
    so ``forbidden`` does not hold ``bid``."""
    if whole:
        return col.rlike(r"(?iU)\b(?:" + "|".join(map(re.escape, words)) + r")\b")
    low = F.lower(col)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def holds_any(value: Column, words: Sequence[str], whole: bool = False) -> Column:
    """``contains_any`` for a computed value inside a lambda: computed once, not once per word."""
    if whole:
        return contains_any(value, words, whole)
    return let(F.lower(value), lambda low: reduce(lambda a, b: a | b, [low.contains(w) for w in words]))


def all_matches(col: Column, pattern: str) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


def first_match(col: Column, patterns: Sequence[str]) -> Column:
    """Whole first match of the first pattern that occurs, else NULL."""
    picked = F.when(col.rlike(patterns[0]), F.regexp_extract(col, patterns[0], 0))
    for p in patterns[1:]:
        picked = picked.when(col.rlike(p), F.regexp_extract(col, p, 0))
    return picked


# Dates

def plain_dates(col: Column) -> Column:
    """Date strings, by pattern and then by position; repeats stay."""
    return F.concat(*[all_matches(col, p) for p in V.PLAIN_DATES])


def document_dates(col: Column, per_pattern: int | None = V.DOCUMENT_DATES_PER_PATTERN) -> Column:
    """Distinct date strings, at most ``per_pattern`` matches of each pattern (None: all), sorted."""
    found = [all_matches(col, p) for p in V.PLAIN_DATES]
    capped = found if per_pattern is None else [F.slice(f, 1, per_pattern) for f in found]
    # Not array_sort: that one has what is below it computed anew for each column it is in.
    return F.sort_array(F.array_distinct(F.concat(*capped)))


def date_label(context: Column, labels: Sequence[str] = V.DATE_LABELS) -> Column:
    """First label, in list order, that occurs in the text around a date."""
    def pick(low: Column) -> Column:
        label = F.when(low.contains(labels[0]), labels[0])
        for k in labels[1:]:
            label = label.when(low.contains(k), k)
        return label.otherwise("unknown")

    return let(F.lower(context), pick)


_DATES = "array<struct<date:string,type:string,context:string>>"
# A match has at least six characters, so nine neighbours more than fill a context.
_NEIGHBOURS = V.CONTEXT_CHARS // 6 + 1


def _with_context(col: Column, pattern: str, labels: Sequence[str]) -> Column:
    """Matches of one pattern with the text around them.

    The text is cut into gaps and matches, so a context is built from the few
    pieces next to a match: the cost is linear in the text, with no offsets to
    count. ``left[j]`` is gap j and match j, ``right[j]`` match j and gap j+1,
    each gap trimmed to the side that can be seen.
    """
    n = V.CONTEXT_CHARS

    def contexts(v: Column) -> Column:
        def one(match: Column, i: Column) -> Column:
            before = F.concat(
                F.array_join(
                    F.slice(v["left"], F.greatest(i - (_NEIGHBOURS - 1), F.lit(1)),
                            F.least(i, F.lit(_NEIGHBOURS))), ""),
                F.get(v["tails"], i),
            )
            after = F.concat(
                F.get(v["heads"], i + 1),
                F.array_join(F.slice(v["right"], i + 2, F.lit(_NEIGHBOURS)), ""),
            )
            return F.struct(
                match.alias("date"),
                strip(F.concat(F.right(before, F.lit(n)), match, F.left(after, F.lit(n))))
                .alias("context"),
            )

        return F.transform(v["found"], one)

    def units(v: Column) -> Column:
        return F.struct(
            v["found"].alias("found"),
            v["heads"].alias("heads"),
            v["tails"].alias("tails"),
            F.zip_with(v["tails"], v["found"], lambda g, m: F.concat(g, m)).alias("left"),
            F.transform(v["found"], lambda m, j: F.concat(m, F.get(v["heads"], j + 1)))
            .alias("right"),
        )

    def trimmed(v: Column) -> Column:
        return F.struct(
            v["found"].alias("found"),
            F.transform(v["gaps"], lambda g: F.left(g, F.lit(n))).alias("heads"),
            F.transform(v["gaps"], lambda g: F.right(g, F.lit(n))).alias("tails"),
        )

    def labelled(found: Column) -> Column:
        pieces = F.struct(found.alias("found"), F.split(col, pattern, -1).alias("gaps"))
        return F.transform(
            let(pieces, lambda p: let(trimmed(p), lambda t: let(units(t), contexts))),
            lambda d: F.struct(d["date"].alias("date"), date_label(d["context"], labels).alias("type"),
                               d["context"].alias("context")),
        )

    # Most texts lack most patterns: stop at the empty match list.
    return let(all_matches(col, pattern),
               lambda f: F.when(F.size(f) > 0, labelled(f)).otherwise(F.array().cast(_DATES)))


def dates_with_context(col: Column, labels: Sequence[str] = V.DATE_LABELS, strict: bool = False) -> Column:
    """``array<struct<date, type, context>>``, by pattern and then by position.

    An ISO date is reported twice (its tail also fits the first pattern); status
    and labels depend on that, so it stays, unless ``strict`` asks for whole dates only.
    """
    first, *rest = V.CONTEXT_DATES
    if strict:
        first = first.replace("(?iU)", r"(?iU)(?<!\d)")
    return F.concat(*[_with_context(col, p, labels) for p in (first, *rest)])


def bare_dates(dates: Column, label: str) -> Column:
    """Plain date strings in the shape of ``dates_with_context``."""
    return F.transform(
        dates,
        lambda d: F.struct(d.alias("date"), F.lit(label).alias("type"),
                           F.lit(None).cast("string").alias("context")),
    )


_DATE_FORMATS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "M-d-yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "M/d/yy"),
    (r"^\d{1,2}-\d{1,2}-\d{2}$", "M-d-yy"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
)


def date_value(date: Column) -> Column:
    """The calendar date a date string stands for, NULL when it is none.

    Month names are cut to three letters and spelled ``Mmm`` first.
    """
    words = F.regexp_replace(
        F.initcap(date), r"^([A-Za-z]{3})[a-z]*\s+(\d{1,2}),?\s+(\d{4})$", "$1 $2 $3")
    tries = [
        F.when(words.rlike(shape), F.try_to_timestamp(words, F.lit(fmt)).cast("date"))
        for shape, fmt in _DATE_FORMATS
    ]
    return F.coalesce(*tries)


_ANY_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|" + V.MONTH_DATE + ")"
_RANGE = rf"(?iU)(?<!\d)({_ANY_DATE})\s*(?:-|\x{{2013}}|\b(?:to|and|until|till|through|thru)\b)\s*({_ANY_DATE})(?!\d)"


def date_ranges(col: Column) -> Column:
    """``array<struct<start, end, raw>>``: two dates joined by a dash or a word like ``to``, as days, in
    the order of the text. A range whose days cannot be read, or that ends before it starts, is left out."""
    starts, ends, raws = (F.regexp_extract_all(col, F.lit(_RANGE), F.lit(g)) for g in (1, 2, 0))
    found = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b"), raws.alias("raw")), lambda r: F.struct(
        date_value(r["a"]).alias("start"), date_value(r["b"]).alias("end"), r["raw"].alias("raw")))
    return F.filter(found, lambda r: F.coalesce(r["start"] <= r["end"], F.lit(False)))


def still_open(dates: Column, day: Column) -> Column:
    """Whether the latest readable date is not before the day; NULL without one."""
    return F.array_max(F.transform(dates, lambda d: date_value(d["date"]))) >= day


# Ids, contacts, status

def _id_patterns(prefixes: Sequence[str]) -> list[str]:
    return [rf"(?iU){p}{V.ID_TAIL}" for p in prefixes]


def notice_id(col: Column, prefixes: Sequence[str] = V.ID_PREFIXES) -> Column:
    return first_match(col, _id_patterns(prefixes))


def document_id(col: Column, chars: int | None = V.DOCUMENT_ID_CHARS,
                prefixes: Sequence[str] = V.DOCUMENT_ID_PREFIXES) -> Column:
    """As ``notice_id`` without ``Bid``, and only in the first ``chars`` of the document (None: all)."""
    opening = col if chars is None else F.substring(col, 1, chars)
    return first_match(opening, _id_patterns(prefixes))


def email(col: Column) -> Column:
    return F.when(col.contains("@"), first_match(col, [V.EMAIL]))


def phone(col: Column) -> Column:
    return first_match(col, [V.PHONE])


def contact(col: Column) -> Column:
    """Email and phone; a name is part of the shape but never filled."""
    return F.struct(email(col).alias("email"), phone(col).alias("phone"),
                    F.lit(None).cast("string").alias("name"))


def is_active(col: Column, dates: Column, closed: Sequence[str] = V.CLOSED_WORDS,
              opened: Sequence[str] = V.OPEN_WORDS, whole: bool = False) -> Column:
    """Closing words win over opening words; without either, a dated notice is active."""
    return (
        F.when(contains_any(col, closed, whole), F.lit(False))
        .when(contains_any(col, opened, whole), F.lit(True))
        .otherwise(F.size(dates) > 0)
    )


# Titles and counts

def norm_title(title: Column) -> Column:
    return strip(F.lower(title))


def first_line(col: Column) -> Column:
    return F.substring_index(col, "\n", 1)


def document_title(meta_title: Column, link_text: Column, text: Column,
                   chars: int | None = V.TITLE_CHARS) -> Column:
    """Metadata title, else link text, else the first line, else a fixed title.

    The literal ``Untitled`` counts as no title and goes straight to the first line.
    """
    named = F.coalesce(F.when(meta_title != "", meta_title), link_text)
    opening = first_line(text) if chars is None else F.left(first_line(text), F.lit(chars))
    return F.coalesce(
        F.when((named != "") & (named != "Untitled"), named),
        F.when(opening != "", opening),
        F.lit(V.DEFAULT_DOCUMENT_TITLE),
    )


def word_count(col: Column) -> Column:
    return F.regexp_count(col, F.lit(r"(?U)\S+"))
