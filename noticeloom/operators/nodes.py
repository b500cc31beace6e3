"""HTML to node arrays: the one step that needs Python.

``parse_pages`` turns the ``html`` column into two arrays per page:

* ``nodes`` - elements in document order. ``pre`` is the 1-based position in the
  array and ``end`` the position of the last descendant, so the descendants of
  ``n`` are ``slice(nodes, n.pre + 1, n.end - n.pre)`` and its next sibling, if
  it has one, sits at ``n.end + 1``.
* ``segs`` - the stripped, non-empty text strings of the page. The strings under
  ``n`` are ``slice(segs, n.seg, n.nseg)``.

Rows stay where they are (no shuffle) and everything after this step is native.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

NODE = T.StructType([
    T.StructField("pre", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("parent", T.IntegerType()),
    T.StructField("tag", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("cls", T.StringType()),
    T.StructField("href", T.StringType()),
    T.StructField("seg", T.IntegerType()),
    T.StructField("nseg", T.IntegerType()),
])

# Comment or declaration | end tag | element of raw text, whole | start tag.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    r"|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<((?i:script|style|textarea|title))(?=[\s/>])([^>]*)>(.*?)(?:(</(?i:\2)(?=[\s/>])[^>]*>)|\Z)"
    r"|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_WANTED = re.compile(r"class|id|href", re.I)
_VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
_NO_TEXT = frozenset(("script", "style", "template", "rt", "rp"))

# Start tags that imply the end of an open element: tag -> (elements ended, elements not crossed).
_ENDS_P = (frozenset("p"), frozenset(("table", "td", "th", "button", "object")))
_IMPLIED = {
    t: _ENDS_P
    for t in (
        "address article aside blockquote center details div dl fieldset figure footer form "
        "h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul"
    ).split()
}
_IMPLIED |= {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "table"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl", "table"))),
    "tr": (frozenset(("tr", "caption", "colgroup")), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
    "a": (frozenset("a"), frozenset(("td", "th", "table", "li", "div"))),
}
_IMPLIED |= {
    t: (frozenset(("thead", "tbody", "tfoot", "caption", "colgroup")), frozenset(("table",)))
    for t in ("thead", "tbody", "tfoot")
}
# An end tag does not reach past an open element of a higher rank.
_RANK = {"div": 1, "td": 2, "th": 2, "tr": 3, "thead": 4, "tbody": 4, "tfoot": 4,
         "table": 5, "head": 6, "body": 6, "html": 7}


def _attributes(attrs: str) -> tuple[str | None, str | None, str | None]:
    """id, class and href of a start tag; the first of each counts."""
    found: dict[str, str] = {}
    for key, value in _ATTR.findall(attrs):
        key = key.lower()
        if key in ("id", "class", "href"):
            if value[:1] in ("'", '"'):
                value = value[1:-1]
            found.setdefault(key, _html.unescape(value) if "&" in value else value)
    cls = found.get("class")
    return found.get("id"), None if cls is None else " ".join(cls.split()), found.get("href")


# Most start tags that have attributes have one, without a character reference.
_ONE_ATTR = re.compile(r"([a-zA-Z][a-zA-Z0-9]*)\s+(class|id|href)=\"([^\"'&]*)\"\s*")
_BARE = re.compile(r"/?[a-zA-Z][a-zA-Z0-9]*")
_RAW = frozenset(("script", "style", "textarea", "title"))
# The letters that a reference to the start tag takes for equal: those with the same lower case.
_RAW_ENDS = {
    t: re.compile("</" + "".join(f"[{c}{c.upper()}]" for c in t).replace("I", "I\u0130") + r"(?=[\s/>])[^>]*>")
    for t in _RAW}
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")


class _Tag(NamedTuple):
    """What is known of a tag by its name."""

    end: bool
    name: str
    rule: tuple[frozenset[str], frozenset[str]] | None
    kept_open: bool
    counted: bool  # open elements of its kind are counted


def _tag(name: str, end: bool = False) -> _Tag:
    return _Tag(end, name, _IMPLIED.get(name), name not in _VOID, name == "p" or name in _NO_TEXT)


# Tags without attributes by what is between their brackets, a start tag that has some by its name
# alone; names that HTML does not know do not fill it.
_BARE_TAGS: dict[str, _Tag] = {}
_RAW_TAGS = {t: _tag(t) for t in _RAW}
_MOST_BARE_TAGS = 4096


def _columns() -> tuple[list, ...]:
    return tuple([] for _ in NODE.names)


def _parse(text: str, columns: tuple[list, ...], segs: list[str]) -> None:
    """Append the elements of one page to ``columns`` (those of ``NODE``) and its text strings to ``segs``.

    A tag ends at the first ``>`` behind it unless that is inside quotes, so most are found by two
    searches, as are comments and raw text that end; what may be otherwise (raw text with attributes or
    without an end, single or unpaired quotes) is matched by ``_TOKEN``.
    """
    pres, ends, depths, parents, tags, ids, classes, hrefs, firsts, counts = columns
    base = len(tags)
    n = 0  # elements of the page
    s = 1  # place of the next text string
    opened: list[int] = []  # places of open elements in the columns
    names: list[str] = []   # and their tags
    found: list[tuple[int, str | None, str | None, str | None]] = []  # places with id, class or href
    buf = ""
    silent = 0  # open elements whose text does not count
    paragraphs = 0  # open p elements

    find, bare, one_attr = text.find, _BARE_TAGS.get, _ONE_ATTR.fullmatch
    pos = 0  # end of the last token
    last = text.rfind(">") + 1  # no tag can end after this
    start = find("<", 0, last)
    while start >= 0:
        stop = find(">", start, last)
        body = text[start + 1:stop]
        known = bare(body)
        attrs = ""
        key = inner = None
        if known is None and (one := one_attr(body)) is not None:
            name, key, value = one.groups()
            known = bare(name)
            if known is None and name.lower() not in _RAW:
                known = _tag(name.lower())
                if len(_BARE_TAGS) < _MOST_BARE_TAGS:
                    _BARE_TAGS[name] = known
        if known is not None:
            pass
        elif body[:3] == "!--" and (end := find("-->", start + 4, last)) >= 0:
            stop = end + 2
        elif body in _RAW and (m := _RAW_ENDS[body].search(text, stop + 1, last)) is not None:
            known, inner, closed = _RAW_TAGS[body], text[stop + 1:m.start()], True
            stop = m.end() - 1
        else:
            key = None
            if _BARE.fullmatch(body):
                name = body.lower()
                if name[0] != "/" and name not in _RAW:
                    known = _tag(name)
                elif name[0] == "/":
                    known = _tag(name[1:], True)
                if known is not None and len(_BARE_TAGS) < _MOST_BARE_TAGS:
                    _BARE_TAGS[body] = known
            elif "'" not in body and not body.count('"') & 1:
                m = _NAME.match(body)
                # The long s is the one other letter that ignoring case makes one of "script" or "style".
                if m is not None and '"' not in m[0] and (name := m[0].lower()).isascii() and name not in _RAW:
                    known, attrs = _tag(name), body[m.end():]
            if known is None:
                m = _TOKEN.match(text, start, last)
                if m is None:  # no tag: part of the text
                    start = find("<", start + 1, last)
                    continue
                stop = m.end() - 1
                kind = m.lastindex
                if kind == 1:
                    known = _tag(m[1].lower(), True)
                elif kind is not None:
                    raw = kind < 6
                    known, attrs = _tag((m[2] if raw else m[6]).lower()), m[3] if raw else m[7]
                    if raw:
                        inner, closed = m[4], kind != 4
        if start > pos:
            buf = buf + text[pos:start] if buf else text[pos:start]
        pos = stop + 1

        if known is not None:
            is_end, tag, rule, kept_open, counted = known
        if known is not None and is_end:
            level = len(names) - 1
            if level < 0 or names[level] != tag:
                rank = _RANK.get(tag, 0)
                while level >= 0 and names[level] != tag:
                    level = -1 if _RANK.get(names[level], 0) > rank else level - 1
            if level >= 0:
                if buf:
                    if not silent:
                        string = (_html.unescape(buf) if "&" in buf else buf).strip()
                        if string:
                            segs.append(string)
                            s += 1
                    buf = ""
                if not counted and level == len(names) - 1:  # most end tags end one element
                    del names[level]
                    i = opened.pop()
                    ends[i] = n
                    counts[i] = s - firsts[i]
                while len(names) > level:
                    i = opened.pop()
                    tag = names.pop()
                    ends[i] = n
                    counts[i] = s - firsts[i]
                    if tag == "p":
                        paragraphs -= 1
                    elif tag in _NO_TEXT:
                        silent -= 1
            start = find("<", pos, last)
            continue

        if buf:  # a comment separates two strings as a start tag does
            if not silent:
                string = (_html.unescape(buf) if "&" in buf else buf).strip()
                if string:
                    segs.append(string)
                    s += 1
            buf = ""
        if known is None:
            start = find("<", pos, last)
            continue
        if rule is not None and (paragraphs or rule is not _ENDS_P):
            ended, walls = rule
            for level in range(len(names) - 1, -1, -1):
                open_tag = names[level]
                if open_tag in ended:
                    while len(names) > level:
                        i = opened.pop()
                        open_tag = names.pop()
                        ends[i] = n
                        counts[i] = s - firsts[i]
                        if open_tag == "p":
                            paragraphs -= 1
                        elif open_tag in _NO_TEXT:
                            silent -= 1
                    break
                if open_tag in walls:
                    break
        at = base + n
        n += 1
        if key is not None:
            if key == "href":
                found.append((at, None, None, value))
            elif key == "id":
                found.append((at, value, None, None))
            else:
                found.append((at, None, " ".join(value.split()), None))
        elif attrs and _WANTED.search(attrs):
            found.append((at, *_attributes(attrs)))
        ends.append(n)
        depths.append(len(opened))
        parents.append(opened[-1] - base + 1 if opened else 0)
        tags.append(tag)
        firsts.append(s)
        counts.append(0)
        if inner is not None:
            if not closed:  # it takes the rest of the page
                inner += text[pos:]
                pos = len(text)
            if tag not in _NO_TEXT and not silent:
                string = (_html.unescape(inner) if "&" in inner else inner).strip()
                if string:
                    segs.append(string)
                    s += 1
                counts[at] = s - firsts[at]
            if not closed:
                break
        elif kept_open and not attrs.endswith("/"):
            opened.append(at)
            names.append(tag)
            if counted:
                if tag == "p":
                    paragraphs += 1
                else:
                    silent += 1
        start = find("<", pos, last)
    buf += text[pos:]
    if buf and not silent:
        string = (_html.unescape(buf) if "&" in buf else buf).strip()
        if string:
            segs.append(string)
            s += 1
    for i in opened:
        ends[i] = n
        counts[i] = s - firsts[i]
    pres.extend(range(1, n + 1))
    none = [None] * n
    ids += none
    classes += none
    hrefs += none
    for at, ids[at], classes[at], hrefs[at] in found:
        pass


def parse_tree(text: str) -> tuple[list[list], list[str]]:
    """Rows of the node array (fields as in ``NODE``) and the text strings of one page."""
    columns, segs = _columns(), []
    _parse(text, columns, segs)
    return [list(row) for row in zip(*columns)], segs


_ARROW_NODE = [pa.int32()] * 4 + [pa.string()] * 4 + [pa.int32()] * 2


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("html")
        columns = _columns()
        strings: list[str] = []
        node_offsets: list[int | None] = []
        seg_offsets: list[int | None] = []
        errors: list[str | None] = []
        for text in batch.column(at).to_pylist():
            error = None
            n, s = len(columns[0]), len(strings)
            if text is not None:
                try:
                    _parse(text, columns, strings)
                except Exception as exc:  # one bad page must not stop the job
                    error = f"{type(exc).__name__}: {exc}"
                    for column in columns:
                        del column[n:]
                    del strings[s:]
            errors.append(error)
            # A null offset makes the list itself null.
            missing = text is None or error is not None
            node_offsets.append(None if missing else n)
            seg_offsets.append(None if missing else s)
        node_offsets.append(len(columns[0]))
        seg_offsets.append(len(strings))
        structs = pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, _ARROW_NODE)], names=NODE.names
        )
        nodes = pa.ListArray.from_arrays(pa.array(node_offsets, pa.int32()), structs)
        segs = pa.ListArray.from_arrays(
            pa.array(seg_offsets, pa.int32()), pa.array(strings, pa.string())
        )
        kept = [i for i in range(batch.num_columns) if i != at]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in kept] + [nodes, segs, pa.array(errors, pa.string())],
            names=[batch.schema.names[i] for i in kept] + ["nodes", "segs", "parse_error"],
        )


def parse_pages(pages: DataFrame) -> DataFrame:
    """Replace ``html`` by ``nodes``, ``segs`` and ``parse_error``; other columns pass through.

    Select only what is needed later: the passed columns travel to Python and back.
    A page without html keeps its row, with NULL arrays.
    """
    schema = T.StructType(
        [f for f in pages.schema.fields if f.name != "html"]
        + [
            T.StructField("nodes", T.ArrayType(NODE)),
            T.StructField("segs", T.ArrayType(T.StringType())),
            T.StructField("parse_error", T.StringType()),
        ]
    )
    return pages.mapInArrow(_parse_batches, schema)


# Helpers over the arrays, usable inside lambdas.

def below(node):
    """Descendant elements of ``node``, in document order."""
    return F.slice(F.col("nodes"), node["pre"] + 1, node["end"] - node["pre"])


def _strings(node, between: str):
    """Strings under ``node`` joined; most elements have one, which is taken as it is, as a slice copies."""
    return F.when(node["nseg"] == 1, F.get(F.col("segs"), node["seg"] - 1)).otherwise(
        F.array_join(F.slice(F.col("segs"), node["seg"], node["nseg"]), between))


def glued(node):
    """Strings under ``node`` joined without a separator."""
    return _strings(node, "")


def spaced(node):
    """Strings under ``node`` joined by one space."""
    return _strings(node, " ")
