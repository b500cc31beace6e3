import hashlib
import random
import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from noticeloom.llm.secrets import (KINDS, STEPS, band_of, base_spans, battery, chi_squared_tail,
                                    find_secrets, infer_encoding, least_steps, secrets_digest, tokens)


def names():
    out = []
    for word in ("password", "passwd", "secret", "token", "api_?key"):
        out.append("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word))
    return "|".join(out)


ASSIGN = f"({names()})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


def brute(text):
    out = [(0, *m.span()) for m in re.finditer(ASSIGN, text or "") if len(m.group(2)) >= 6]
    out += [(1, *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text or "") if len(m.group()) >= 20]
    out += [(2, *m.span()) for m in re.finditer("[0-9a-f]+", text or "") if len(m.group()) >= 24]
    return sorted(out, key=lambda s: (s[1], s[0]))


def line(spans):
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


PART = st.sampled_from(["password", "PassWD", "ſecret", "toKen", "token", "api_key", "APIKEY", "=", ":",
                        " ", "'", '"', "abc.de", "é", "AKIA", "AKIA" + "Z9" * 8, "0a1f" * 6, "f", "G"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PART, max_size=14).map("".join))
def test_base_against_the_plain_patterns(text):
    assert base_spans(text) == brute(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "token" * 80_000, "token" + " " * 400_000, "AKIA" * 100_000,
                 "0123456789abcdeg" * 30_000, "Zz9/" * 100_000):
        base = base_spans(text)
        list(tokens(text, base))


def test_battery_tells_random_strings_from_others():
    draw = random.Random(3)
    for letters, size in ((string.digits + "abcdef", 40), (string.ascii_letters + string.digits, 24),
                          (string.ascii_letters + string.digits + "+/", 64)):
        found = []
        for _ in range(300):
            token = "".join(draw.choice(letters) for _ in range(size))
            _, n, values = infer_encoding(token)
            found.append(battery(n, values).combined)
        # Even in 0..1 but for the grain of short strings.
        assert 0.3 < sum(f > 0.5 for f in found) / 300 < 0.75
        assert sum(f < 0.01 for f in found) <= 15
    for token in ("abcdefghijklmnop0123456789", "0000000000000000000a", "aaaaaaaabbbbbbbb11111111",
                  "internationalisation1", "AbAbAbAbAbAbAbAbAb12"):
        _, n, values = infer_encoding(token)
        assert battery(n, values).combined < 0.05, token


def test_tail_of_chi_squared():
    # Known values of the distribution.
    assert abs(chi_squared_tail(3.841, 1) - 0.05) < 0.01
    assert abs(chi_squared_tail(24.996, 15) - 0.05) < 0.001


def test_strings_touch_no_base_span():
    text = "token=abc123 zz9Ygh77ABCdef0123 deadbeefdeadbeefdeadbeefX1 +/Ab1Cd2Ef3Gh4Ij5Kl6__"
    base = base_spans(text)
    assert [text[a:b] for a, b in tokens(text, base)] == ["zz9Ygh77ABCdef0123", "Ab1Cd2Ef3Gh4Ij5Kl6"]


def test_least_steps():
    words = [("word", 0, 0, 900), ("word", 0, 1, 90), ("word", 0, 150, 9), ("word", 3, 0, 10)]
    assert least_steps([], 0.05) == {}
    assert least_steps(words, 0.05) == {}
    # Fifty of a hundred fail; about one in a hundred ordinary ones passes.
    found = least_steps([*words, ("mixed", 0, 0, 50), ("mixed", 0, 120, 50), ("mixed", 3, 130, 4)], 0.05)
    assert 1 < found[0] <= 120 and found[3] <= 130
    # Without words there is nothing to judge by.
    assert least_steps([("mixed", 0, 150, 100)], 0.05) == {}


def planted():
    draw = random.Random(11)
    letters = string.ascii_letters + string.digits
    rows, secrets = [], {}
    for i in range(400):
        text = " ".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 24)))
                        for _ in range(60))
        if i % 8 == 0:
            token = "".join(draw.choice(letters) for _ in range(draw.choice((32, 40, 48))))
            text = f"{text} {token} end"
            secrets[i] = (len(text) - 4 - len(token), len(text) - 4)
        if i % 8 == 1:
            text += f" chapter-{i}-of-the-handbook section{i}continued{i} aaaaaaaaaaaaaaaaaaaa{i}"
        rows.append((i, text))
    return rows, secrets


def test_unseen_secrets_are_found(make_docs):
    rows, secrets = planted()
    got = {r.doc_id: [(s.start, s.end) for s in r.spans if s.kind == 3]
           for r in find_secrets(make_docs(rows)).collect()}
    caught = sum(span in got[i] for i, span in secrets.items())
    false = sum(len(set(own) - {secrets.get(i)}) for i, own in got.items())
    assert caught >= 0.9 * len(secrets) and false <= 0.1 * caught


def brute_spans(rows, rate=0.05):
    """All spans by plain loops over the whole corpus."""
    held, different = [], {}
    for i, text in rows:
        base = brute(text)
        own = []
        for m in re.finditer("[A-Za-z0-9+/_-]{16,}", text or ""):
            t = m.group().strip("+/_-")
            a = m.start() + m.group().index(t) if t else m.start()
            b = a + len(t)
            if len(t) < 16 or t.isdigit() or any(x < b and a < y for _, x, y in base):
                continue
            _, n, values = infer_encoding(t)
            step = min(int(battery(n, values).combined * STEPS), STEPS - 1)
            what = "mixed" if any(c.isdigit() for c in t) else "word"
            different[t] = (what, band_of(len(t)), step)
            own.append((a, b, what, band_of(len(t)), step))
        held.append((i, base, own))
    counts = {}
    for cell in different.values():
        counts[cell] = counts.get(cell, 0) + 1
    least = least_steps([(*c, n) for c, n in counts.items()], rate)
    out = []
    for i, base, own in held:
        spans = base + [(3, a, b) for a, b, what, band, step in own
                        if what == "mixed" and band in least and step >= least[band]]
        out.append((i, line(sorted(spans, key=lambda s: (s[1], s[0])))))
    return sorted(out, key=repr)


def test_documents(make_docs, odd_rows):
    rows = planted()[0] + odd_rows + [
        (5000, 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"'), (5000, "AKIA" + "Q7" * 9),
        (5001, "PASSWORD: hunter2hunter2"), (None, "api-key=no api_key=yes123"), (5002, "x" * 3000)]
    got = secrets_digest(find_secrets(make_docs(rows))).collect()
    want = []
    for i, text in rows:
        base = brute(text)
        want.append((i, *(sum(s[0] == k for s in base) for k in range(3)),
                     hashlib.sha256(line(base).encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert sorted(((r.doc_id, r.spans) for r in got), key=repr) == brute_spans(rows)
    assert any("random" in r.spans for r in got)


def test_empty_table(make_docs):
    assert secrets_digest(find_secrets(make_docs([]))).collect() == []


def test_extra_columns(spark):
    docs = spark.createDataFrame([("x", "token=abcdefg", 1, 2)], "id string, text string, base int, strings int")
    assert [tuple(r) for r in secrets_digest(find_secrets(docs, "id"), "id").select("id", "spans").collect()] == [
        ("x", "assign:0:13")]
