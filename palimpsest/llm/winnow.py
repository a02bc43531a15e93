"""Benchmark decontamination by winnowing: which words of a document lie in passages of a benchmark, and of which items.

A passage is a window of 10 consecutive words of an item; an item of fewer words is one window. Of a text's hashed k-grams winnowing keeps the least in each sliding window of w of them, the last if several are. Both sides keep the same k-gram of any w + k - 1 words that they share, so with w + k - 1 = 10 every shared window shares a fingerprint. Fingerprints of documents are looked up among those of the items; a hit is extended over the windows around it, and each counts only if its words are those of a window of an item, compared as bytes. Items of fewer words have their own w, and k where they are shorter than that.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z became a-z. Null and empty texts have no words, and items without words hit nothing. Rows with one item_id are one item; an item without an id counts as the item "". Repeated documents get equal results, other columns play no part, and an empty table, of documents or of items, gives a result without hits. Items that share a passage all count for a document that has it. Each document is on its own and handled whole, so nothing is shuffled.

Items are sent to all executors: at most PART bytes of them at once (or a single longer item). A larger benchmark is dealt into parts by hashes, and the documents, with what was found so far, are written between them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import written

WINDOW = 10
K = 5
#: Bytes of items that are sent to executors at once.
PART = 16 << 20
#: Bytes of text that are hashed at once; a longer text is one piece.
CHUNK = 1 << 20

_bytes = np.arange(256, dtype=np.uint8)
IS_WORD = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)
LOWER = np.where((_bytes >= 0x41) & (_bytes <= 0x5A), _bytes + 32, _bytes).astype(np.uint8)

#: An odd base has an inverse modulo 2^64, by which a word's hash doesn't depend on its place.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
STEP = np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and its inverse, kept for pieces of the usual length."""

    held: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > 2 * CHUNK:
            return _powers(BASE, n), _powers(INVERSE, n)
        if cls.held is None:
            cls.held = _powers(BASE, 2 * CHUNK), _powers(INVERSE, 2 * CHUNK)
        return cls.held


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of several texts: their letters in one array, where each starts and ends, its hash, and the number of its text."""

    letters: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    text: np.ndarray

    def span(self, first: int, n: int) -> bytes:
        """n words, joined by blanks."""
        return b" ".join(self.letters[a:b].tobytes() for a, b in zip(self.start[first : first + n].tolist(), self.end[first : first + n].tolist(), strict=True))


def words_of(texts: list[bytes]) -> Words:
    letters = LOWER[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
    inside = IS_WORD[letters]
    turns = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = turns[::2], turns[1::2]
    power, inverse = _Powers.upto(len(letters))
    sums = np.zeros(len(letters) + 1, np.uint64)
    np.cumsum((letters.astype(np.uint64) + np.uint64(1)) * power[: len(letters)], out=sums[1:])
    hashes = mixed((sums[end] - sums[start]) * inverse[start])
    begins = np.cumsum([0, *[len(t) + 1 for t in texts[:-1]]])
    return Words(letters, start, end, hashes, np.searchsorted(begins, start, "right") - 1)


def grams(words: Words, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each of these on."""
    out = np.zeros(len(at), np.uint64)
    for j in range(n):
        out = out * STEP + words.hash[at + j]
    return mixed(out)


def shape(length: int, k: int = K) -> tuple[int, int]:
    """k and w for passages of so many words: w + k - 1 = length."""
    return min(k, length), length - min(k, length) + 1


def winnowed(words: Words, length: int, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Where the kept k-grams of texts begin, and their hashes. Only runs of `length` words of one text count."""
    k, w = shape(length, k)
    n = len(words.start) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = grams(words, np.arange(len(words.start) - k + 1), k)
    least, where = g[:n], np.zeros(n, np.int64)
    for j in range(1, w):
        other = g[j : j + n]
        later = other <= least
        least, where = np.where(later, other, least), np.where(later, j, where)
    whole = np.flatnonzero(words.text[:n] == words.text[length - 1 :])
    at = np.unique(whole + where[whole])
    return at, g[at]


@dataclass
class Passages:
    """Windows of one length: the items' fingerprints, and, in the order of their hashes, the windows' words and items."""

    length: int
    fingerprints: np.ndarray
    hashes: np.ndarray
    spans: list[bytes]
    items: list[list[int]]


def passages(items: list[tuple[str, str]], window: int = WINDOW, k: int = K) -> tuple[list[str], list[Passages]]:
    """The names of items, and their windows by length. items: id and text."""
    names = sorted({i for i, _ in items})
    number = {name: n for n, name in enumerate(names)}
    by_length: dict[int, list[tuple[int, bytes]]] = {}
    for name, text in items:
        data = text.encode("utf-8", "surrogatepass")
        n = len(words_of([data]).start)
        if n:
            by_length.setdefault(min(n, window), []).append((number[name], data))
    out = []
    for length, texts in sorted(by_length.items()):
        words = words_of([t for _, t in texts])
        at = np.arange(len(words.start) - length + 1)
        at = at[words.text[at] == words.text[at + length - 1]]
        seen: dict[bytes, tuple[int, set[int]]] = {}
        for first, h in zip(at.tolist(), grams(words, at, length).tolist(), strict=True):
            seen.setdefault(words.span(first, length), (h, set()))[1].add(texts[words.text[first]][0])
        order = sorted(seen.items(), key=lambda e: e[1][0])
        out.append(Passages(length, np.unique(winnowed(words, length, k)[1]), np.array([h for _, (h, _) in order], np.uint64), [s for s, _ in order], [sorted(i) for _, (_, i) in order]))
    return names, out


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of x are in an ascending array."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def marked(words: Words, n_texts: int, known: list[Passages], k: int = K) -> tuple[np.ndarray, list[set[int]]]:
    """Which words are hit, and the numbers of the items that occur in each text."""
    hit, items = np.zeros(len(words.start), bool), [set() for _ in range(n_texts)]
    for p in known:
        at, g = winnowed(words, p.length, k)
        at = at[among(g, p.fingerprints)]
        if not len(at):
            continue
        # A window that holds the kept k-gram begins up to w - 1 words before it.
        first = np.unique((at[:, None] - np.arange(shape(p.length, k)[1])).ravel())
        first = first[(first >= 0) & (first + p.length <= len(words.start))]
        first = first[words.text[first] == words.text[first + p.length - 1]]
        h = grams(words, first, p.length)
        ok = among(h, p.hashes)
        first, h = first[ok], h[ok]
        for a, low, high in zip(first.tolist(), np.searchsorted(p.hashes, h).tolist(), np.searchsorted(p.hashes, h, "right").tolist(), strict=True):
            span = words.span(a, p.length)
            for x in range(low, high):
                if p.spans[x] == span:
                    hit[a : a + p.length] = True
                    items[words.text[a]].update(p.items[x])
    return hit, items


FOUND = "struct<n_words: long, n_hit: long, spans: array<struct<start: long, end: long>>, items: array<string>>"


def _pieces(sizes: list[int]) -> list[slice]:
    """Neighbouring texts of about CHUNK bytes together."""
    out, first, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > CHUNK:
            out.append(slice(first, i))
            first, total = i, 0
        total += n + 1
    return [*out, slice(first, len(sizes))] if sizes else out


def found(text: Column, items: list[tuple[str, str]], spark, before: Column | None = None, window: int = WINDOW, k: int = K) -> Column:
    """n_words, n_hit, the ranges of words that are hit (end exclusive, apart from each other) and the ids of the items that occur, in the order of their bytes. before: what was found with other items, to be counted in."""
    held = spark.sparkContext.broadcast(passages(items, window, k))

    def scan(texts: pd.Series, olds: list) -> pd.DataFrame:
        names, known = held.value
        data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        rows = []
        for piece in _pieces([len(d) for d in data]):
            words = words_of(data[piece])
            hit, got = marked(words, len(data[piece]), known, k)
            ends = np.searchsorted(words.text, np.arange(len(got) + 1))
            for n, (numbers, old) in enumerate(zip(got, olds[piece], strict=True)):
                mine, ids = hit[ends[n] : ends[n + 1]], {names[i] for i in numbers}
                if old is not None:
                    mine, ids = mine.copy(), ids | set(old["items"])
                    for s in old["spans"]:
                        mine[s["start"] : s["end"]] = True
                turns = np.flatnonzero(np.diff(mine, prepend=False, append=False)).tolist() if mine.any() else []
                spans = [{"start": a, "end": b} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                rows.append((len(mine), int(mine.sum()), spans, sorted(ids, key=lambda i: i.encode("utf-8", "surrogatepass"))))
        return pd.DataFrame(rows, columns=["n_words", "n_hit", "spans", "items"])

    if before is None:

        @F.pandas_udf(FOUND)
        def of(texts: pd.Series) -> pd.DataFrame:
            return scan(texts, [None] * len(texts))

        return of(text)

    @F.pandas_udf(FOUND)
    def more(texts: pd.Series, olds: pd.DataFrame) -> pd.DataFrame:
        return scan(texts, olds.to_dict("records"))

    return more(text, before)


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", carry: list[str] | None = None, window: int = WINDOW, k: int = K, part: int = PART) -> DataFrame:
    """The columns in carry (all, if None) as a struct `row`, and `found`, for each document."""
    spark = docs.sparkSession
    named = benchmark.select(F.coalesce(benchmark[item].cast("string"), F.lit("")).alias("id"), F.coalesce(benchmark[item_text], F.lit("")).alias("text"))
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Hashes deal items unevenly: twice as many parts as would do on average.
    parts = 1 if total <= part else 2 * math.ceil(total / part)
    rows = docs.select(F.struct(*[docs[c] for c in (carry or docs.columns)]).alias("row"), docs[text].alias("text"))
    for n in range(parts):
        mine = named if parts == 1 else named.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == n)
        items = [tuple(r) for r in mine.collect()]  # at most PART bytes or so
        rows = rows.select("row", "text", found(F.col("text"), items, spark, F.col("found") if n else None, window, k).alias("found"))
        rows = written(rows) if n < parts - 1 else rows
    return rows.select("row", "found")


def listed_sha256(items: Column) -> Column:
    """A hash of ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)

