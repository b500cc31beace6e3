import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from noticeloom.llm.pii import (KINDS, base_spans, candidates, find_personal_data, pattern,
                                personal_data_digest, redact)

PLAIN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute(text):
    out = []
    for kind, p in enumerate(PLAIN):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2:
                alt = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
                if not 13 <= len(digits) <= 19 or sum(x // 10 + x % 10 for x in alt) % 10:
                    continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=3000, deadline=None)
@given(st.text("a1.@-+ (%9é4", max_size=30) | st.text("0123456789 -", max_size=40)
       | st.text("12.", max_size=20) | st.text("a@.b", max_size=14))
def test_base_against_the_plain_patterns(text):
    assert base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 400_000, "a" * 400_000 + "@", "1." * 200_000, "a@" * 200_000,
                 "+1" + " " * 400_000, "a.b@" + "c-" * 200_000):
        base_spans(text)


def rows():
    out = [(1000 + i, f"word{'s' * (i % 7)} reach me at: user{i}@mail{i}.example.org now") for i in range(20)]
    return [*out, (1100, "please reach me at: someone@localhost today"), (1101, "order 1234567 arrived"),
            (1102, None), (1103, ""), (1104, "see host@cluster x"), (1105, "4111 1111 1111 1111"),
            (1105, "4111 1111 1111 1111"), (None, "+44 20 7946 0958 and 10.0.0.1"), (1106, "9.9.9.999")]


def test_documents(make_docs, odd_rows):
    data = rows() + odd_rows
    got = personal_data_digest(find_personal_data(make_docs(data))).collect()

    def line(spans):
        return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)

    want = []
    for i, text in data:
        spans = brute(text)
        want.append((i, *[sum(s[0] == k for s in spans) for k in range(4)],
                     hashlib.sha256(line(spans).encode()).hexdigest()))
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted(want, key=repr)
    spans = {r.doc_id: r.spans for r in got}
    text = dict(data)[1100]
    at = text.index("someone")
    assert spans[1100] == f"email:{at}:{at + len('someone@localhost')}"
    assert spans[1101] == spans[1104] == spans[1106] == ""
    assert set(line(brute(text_of[1])) for text_of in data if text_of[0] == 1105) == {spans[1105]}


def test_empty_and_extra_columns(spark, make_docs):
    assert find_personal_data(make_docs([])).collect() == []
    docs = spark.createDataFrame([(1, "a@b.c", 3, "x")],
                                 "doc_id long, text string, rid int, pattern string")
    assert [len(r.spans) for r in find_personal_data(docs).collect()] == [1]


def test_pattern_and_redaction():
    assert pattern("Call me at: 12", 12) == "at :"
    assert pattern("12", 0) == "^ ^"
    assert redact("a x@y.z b", [(0, 2, 7)]) == "a <email> b"
    assert redact("1234", [(2, 0, 3), (3, 1, 4)]) == "<card>"
    assert redact("none", []) == "none"


def seen(text):
    return {(KINDS[k], text[a:b]) for k, a, b in candidates(text, base_spans(text))}


def test_candidates_run_over_spaces_and_brackets():
    assert ("phone", "(555) 123-4567") in seen("Call me at: (555) 123-4567 now")
    assert ("phone", "555 123 4567") in seen("at: 555 123 4567. 20 came")
    assert ("phone", "555 123 4567") in seen("at: (555 123 4567), 10.0.0.1")
    assert ("phone", "555 123 4567") in seen("10.0.0.1 555 123 4567 (x)")
    assert ("card", "4111 1111 1111 1112") in seen("card 4111 1111 1111 1112")
    assert {("card", "442079460958"), ("phone", "442079460958")} <= seen("tel 442079460958")
    assert ("phone", "5551234567") in seen("item 5 5551234567")
    assert ("phone", "(555) 123-4567") in seen("room B5 (555) 123-4567")
    assert ("phone", "(555) 123-4567") in seen("1 2 3 4 5 6 7 8 9 " * 9 + "(555) 123-4567")
    assert ("phone", "555 123 4567") not in seen("abc555 123 4567")
    for text in ("1 " * 200_000, "(" * 400_000, "1(" * 200_000, "1" + " " * 400_000 + "a"):
        candidates(text, [])


def test_numbers_with_spaces_and_brackets_are_discovered(make_docs):
    data = [(i, f"note {i} reach me at: +1 ({200 + i}) 555-0{100 + i} now") for i in range(20)]
    data += [(100 + i, f"charged to card no. {c}") for i, c in enumerate(
        ["4111 1111 1111 1111", "5500 0000 0000 0004", "4012 8888 8888 1881", "4222 2222 2222 2",
         "3782 822463 10005", "3714 496353 98431", "6011 1111 1111 1117", "5105 1051 0510 5100"])]
    more = {200: "(555) 123-4567", 201: "555 123 4567", 202: "442079460958"}
    data += [(i, f"please reach me at: {x} today") for i, x in more.items()]
    data += [(300, "charged to card no. 4111 1111 1111 1112"), (301, "ordered 555 123 4567 pieces")]
    got = {r.doc_id: r.spans for r in personal_data_digest(find_personal_data(make_docs(data))).collect()}
    text = dict(data)
    for i, x in more.items():
        at = text[i].index(x)
        assert got[i] == f"phone:{at}:{at + len(x)}"
    at = text[300].index("4111")
    assert got[300] == f"card:{at}:{at + 19}"
    assert got[301] == ""


def test_patterns_of_discovered_instances_extract_too(make_docs):
    data = [(i, f"note {i} reach me at: user{i}@mail{i}.example.org now") for i in range(30)]
    # Known from behind "at:" only; they are all that is ever behind "mailbox is".
    data += [(100 + i, f"reach me at: user{i}@host{i} today") for i in range(12)]
    data += [(200 + i, f"his mailbox is user{i}@host{i} today") for i in range(12)]
    data += [(300, "her mailbox is other@elsewhere today"), (301, "the cluster is other2@elsewhere")]
    got = {r.doc_id: r.spans for r in personal_data_digest(find_personal_data(make_docs(data))).collect()}
    assert got[300] == "email:15:30"
    assert got[200] == "email:15:26"
    assert got[301] == ""
