"""Byte-pair encoding by guess and check: longest match first, then a test of every adjacent pair."""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Words that a worker keeps, half of them from the last texts, half from the texts before.
KEPT_WORDS = 200_000
#: Bytes up to which a word is merged by looking at all its pairs again, which is faster than a heap.
SHORT_WORD = 48

# Fixed value: the pattern that splits text into words before merging.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary.

    Bytes that are printable in Latin-1 stand for themselves, the others take the
    characters from 256 on, in order.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Bpe:
    """A byte-level vocabulary with merges, as loaded from a tokenizer file."""

    loaded: dict[str, Bpe] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or model.get("ignore_merges"):
            raise ValueError("not a byte-level BPE without normalizer")
        byte_of = {c: b for b, c in enumerate(byte_letters())}
        vocab = model["vocab"]
        self.bytes_of = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()
                         if all(c in byte_of for c in t)}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.single = [self.id_of[bytes([b])] for b in range(256)]
        size = max(vocab.values()) + 1
        # For a token that a merge makes: when (rank; -1 for single bytes) and of what.
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.zeros(size, np.int64), np.zeros(size, np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            if self.rank[made] < 0:
                self.rank[made], self.left[made], self.right[made] = rank, left, right
            self.merges[left, right] = (rank, made)
        # By left token: the ranks of its merges, and what a rank makes. Whole numbers compare faster than pairs.
        self.follow: list[dict[int, int]] = [{} for _ in range(size)]
        self.made: dict[int, int] = {}
        for (left, right), (rank, made) in self.merges.items():
            self.follow[left][right], self.made[rank] = rank, made
        codes = np.array([a << 32 | b for a, b in self.merges], np.int64)
        order = np.argsort(codes)
        self.codes = codes[order]
        self.code_rank = np.array([r for r, _ in self.merges.values()], np.int64)[order]
        # Tokens that merging leads to; only these may be guessed.
        self.whole = {self.bytes_of[i]: i for i in self.bytes_of
                      if self.merge(self.bytes_of[i]) == [i]}
        # The longest token that starts with these four bytes; where there is none, it has up to three.
        self.reach: dict[bytes, int] = {}
        for token in self.whole:
            if len(token) > 3:
                self.reach[token[:4]] = max(len(token), self.reach.get(token[:4], 0))
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = special
        self.bytes_of |= {i: t.encode() for t, i in special.items()}
        self.split = regex.compile("|".join(map(regex.escape, sorted(
            special, key=len, reverse=True)))) if special else None
        self.word = regex.compile(WORDS)
        # The ids of words with commas between them, and the decoded text of those that it differs for.
        self.words: dict[str, str] = {}
        self.older: dict[str, str] = {}
        self.odd: dict[str, str] = {}
        self.checked = self.failed = 0

    @classmethod
    def load(cls, path: str) -> Bpe:
        if path not in cls.loaded:
            cls.loaded[path] = cls(path)
        return cls.loaded[path]

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: again and again the pair of the lowest rank, of equal ones the leftmost.

        In a long word tokens are linked at the place of their first byte, and pairs wait in a heap, so
        it takes time in proportion to its length and the logarithm of it.
        """
        ids = [self.single[b] for b in word]
        merges, n = self.merges, len(ids)
        if n <= SHORT_WORD:
            none, follow, made = 1 << 60, self.follow, self.made
            found = [follow[a].get(b, none) for a, b in zip(ids, ids[1:])]
            while found:
                best = min(found)
                if best == none:
                    break
                i = found.index(best)
                ids[i] = made[best]
                del ids[i + 1], found[i]
                if i < len(found):
                    found[i] = follow[ids[i]].get(ids[i + 1], none)
                if i:
                    found[i - 1] = follow[ids[i - 1]].get(ids[i], none)
            return ids
        heap = [(merges[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in merges]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            have = merges.get((ids[i], ids[j]))
            if have is None or have[0] != rank:
                continue
            # The right token goes into the left one.
            ids[i], ids[j] = have[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (found := merges.get((ids[i], ids[k]))) is not None:
                    heapq.heappush(heap, (found[0], i))
            if (h := before[i]) >= 0 and (found := merges.get((ids[h], ids[i]))) is not None:
                heapq.heappush(heap, (found[0], h))
        return [t for t in ids if t >= 0]

    def guess(self, word: bytes) -> list[int]:
        """The longest known token at each place."""
        ids, at, whole, reach, n = [], 0, self.whole, self.reach, len(word)
        while at < n:
            for end in range(min(n, at + reach.get(word[at:at + 4], 3)), at, -1):
                if (token := whole.get(word[at:end])) is not None:
                    ids.append(token)
                    at = end
                    break
        return ids

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the joined bytes of each pair of tokens gives these two tokens.

        Goes back in time on both sides of the boundary: the later of the two merges next to it
        is undone, and if the pieces then touching have a merge that comes before the one
        undone, it would have crossed the boundary. Of equal ranks the left one comes first.
        """
        good = np.ones(len(a), bool)
        live, a, b = np.arange(len(a)), a.copy(), b.copy()
        until = np.full(len(a), 1 << 60, np.int64)
        while len(live):
            code = a << 32 | b
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            crosses = (self.codes[at] == code) & (self.code_rank[at] < until)
            good[live[crosses]] = False
            ra, rb = self.rank[a], self.rank[b]
            left = ra > rb
            more = ~crosses & ((ra >= 0) | (rb >= 0))
            until = np.where(left, ra, rb + 1)[more]
            a, b, live = (np.where(left, self.right[a], a)[more],
                          np.where(left, b, self.left[b])[more], live[more])
        return good

    def learn(self, words: list[str]) -> None:
        """Add the tokens of new words: guess all, test all adjacent pairs at once, merge the rest."""
        data = [w.encode() for w in words]
        guesses = [self.guess(w) for w in data]
        lengths = np.fromiter(map(len, guesses), np.int64, len(guesses))
        flat = np.fromiter((i for g in guesses for i in g), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(guesses)), lengths)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(flat[inside] << 32 | flat[inside + 1], return_inverse=True)
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        bad = set(owner[inside[~good]].tolist())
        self.checked += len(words)
        self.failed += len(bad)
        for k, (word, ids) in enumerate(zip(words, guesses, strict=True)):
            if k in bad:
                ids = self.merge(data[k])
            self.words[word] = ",".join(map(str, ids))
            if (text := self.decode(ids)) != word:
                self.odd[word] = text

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode(errors="replace")

    def pieces(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        if self.split is None or not self.split.search(text):
            return self.word.findall(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += self.word.findall(text[at:m.start()])
            out.append(m.group())
            at = m.end()
        return out + self.word.findall(text[at:])

    def known(self, texts: list[str | None]) -> list[list[str]]:
        """The pieces of each text; ``words`` and ``odd`` have all of them until the next call."""
        cut = [self.pieces(t or "") for t in texts]
        if len(self.words) > KEPT_WORDS // 2:
            self.words, self.older = {}, self.words
            self.odd = {w: t for w, t in self.odd.items() if w in self.older}
        for token, i in self.special.items():
            self.words[token] = str(i)
        known = self.words
        new = set().union(*cut).difference(known)
        again = {w: self.older[w] for w in new if w in self.older}
        known.update(again)
        new -= again.keys()
        if new:
            self.learn(sorted(new))
        return cut

    def encode(self, texts: list[str | None]) -> list[list[tuple[int, str, str]]]:
        """For each text its pieces as (number of ids, ids with commas, decoded)."""
        return [[(self.words[w].count(",") + 1, self.words[w], self.odd.get(w, w)) for w in pieces]
                for pieces in self.known(texts)]


def _coder(path: str, digest: bool):
    def code(batches):
        bpe = Bpe.load(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                n, ids, texts = [], [], []
                for pieces in bpe.known(part.column(1).to_pylist()):
                    own = ",".join(map(bpe.words.__getitem__, pieces))
                    n.append(own.count(",") + 1 if own else 0)
                    text = "".join([bpe.odd.get(p, p) for p in pieces] if bpe.odd else pieces)
                    if digest:
                        own = hashlib.sha256(own.encode()).hexdigest()
                        text = hashlib.sha256(text.encode()).hexdigest()
                    else:
                        own = [int(i) for i in own.split(",")] if own else []
                    ids.append(own)
                    texts.append(text)
                kind = pa.string() if digest else pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(ids, kind),
                     pa.array(texts, pa.string())], ["id", "n_tokens", "ids", "decoded"])
    return code


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text",
           digest: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``n_tokens``, ``ids`` and the text ``decoded`` from them;
    with ``digest`` the SHA-256 of the ids joined by commas and of the decoded text.

    ``path`` is the tokenizer file, which every worker can read. A null text is empty and
    has no tokens. The strings of special tokens in a text become those tokens. Rows do not
    move, and a worker keeps at most about ``KEPT_WORDS`` encoded words.
    """
    rows = docs.select(docs[id_col].alias("id"), text)
    kind = "string" if digest else "array<int>"
    return rows.mapInArrow(
        _coder(path, digest),
        f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, ids {kind}, "
        "decoded string").withColumnRenamed("id", id_col)


def decode(tokens: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """``tokens`` with the text of each list of ids in the column ``out``; null for null."""
    schema = tokens.drop(out).schema.add(out, "string")
    kept = [c for c in tokens.columns if c != out]

    def run(batches):
        bpe = Bpe.load(path)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            texts = [None if x is None else bpe.decode(x) for x in table.column(ids).to_pylist()]
            yield from table.select(kept).append_column(
                out, pa.array(texts, pa.string())).to_batches()

    return tokens.mapInArrow(run, schema)
