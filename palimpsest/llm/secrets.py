"""Secret scans. Three patterns find what looks like a secret anywhere; values in the context of credentials are also weighed by how many guesses an attacker would need.

The guess cost of a value, in bits, is the least cost of cutting it into known words, dates, repeats, keyboard walks and brute-force spans, found by dynamic programming over its positions. Two kinds of spans are cheap as anyone knows them: separators between words, and what stands in place of a secret: addresses without credentials, references to variables, and blanks to fill in. A value of at least MIN_BITS is a secret. Words are ranked: parts of common passwords first, then the words of a public tokenizer's vocabulary, whose order is that of their frequency; and those, and pieces of words, of a vocabulary for many languages, at the same rank of its own. The paths are parameters.

Every cut is considered, at whatever length. A walk or a repeat is only begun where none that began before in the same stretch is as good for all that follow, so that few places of a long stretch begin one; their ends are filled in by array operations. Positions that cost as much as a secret already are not followed further.

Null and empty texts have no spans. Whole texts and whole values are scanned, however long. Spans that start at one place are in the order of their kinds; a value of exactly MIN_BITS is a secret. Repeated rows get equal results, other columns play no part, and an empty table gives an empty result. Each row is scanned on its own, so nothing is shuffled.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from array import array
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs are taken whole, so shorter ones need not be matched and dropped
#: Where a value is a credential: more names than the first pattern has, more punctuation in the value, and bearer headers.
CONTEXT = re.compile(
    r"(?<![A-Za-z0-9])(?:password|passwd|passphrase|passcode|pwd|secret|token|credentials?|(?:api|access|private|client|auth|encryption)[_-]?key|authorization)"
    r"[\"']?\x20*(?::=|=>|[:=])\x20*(?:bearer\x20+|basic\x20+)?[\"']?([A-Za-z0-9!#$%&()*+,./:;<=>?@^_`{|}~-]{6,})",
    re.ASCII | re.IGNORECASE,
)
MIN_BITS = 45.0

#: Common parts of guessable passwords, the most common first.
COMMON = (
    "password pass admin root user login test guest welcome secret letmein master monkey dragon qwerty hello love "
    "iloveyou sunshine princess football baseball shadow superman batman trustno summer winter spring autumn "
    "money freedom whatever starwars computer internet server system default changeme example sample dummy "
    "token apikey key value none null true false your here xxxx todo placeholder"
).split()
LEET = str.maketrans("013457@$!", "oieastasi")
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./", "abcdefghijklmnopqrstuvwxyz", "01234567890")
NEXT = {a + b for row in ROWS for a, b in zip(row, row[1:], strict=False)} | {b + a for row in ROWS for a, b in zip(row, row[1:], strict=False)}
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?\d\d")
DATES = math.log2(150 * 12 * 31)
#: Bits of a character between words.
SEPARATORS, SEPARATOR = "-_./:", math.log2(5)
#: What stands in place of a secret, and the bits that it takes to guess which: an address without credentials, query or long numbers; a reference to a variable; a blank to fill in.
SHAPES = [
    (re.compile(r"[a-z][a-z0-9+]{1,9}://[A-Za-z][A-Za-z.-]*(?::\d{2,5})?(?:/[A-Za-z._-]*)*(?![A-Za-z0-9@?#&=%+:/])"), 24.0),
    (re.compile(r"(?:process\.env|os\.environ|os\.getenv|env|config|settings|secrets|vars|self|this)(?:[.\[(]+[\"']?[A-Za-z_]+[\"']?[\])]*)+(?![A-Za-z0-9])"), 20.0),
    (re.compile(r"\$(?:[A-Za-z_]+|\{[A-Za-z_.]+\}|\([A-Za-z_. -]+\))(?![A-Za-z0-9])"), 16.0),
    (re.compile(r"<[A-Za-z_. -]+>|\{\{?[A-Za-z_. -]+\}?\}|%[A-Za-z_]+%"), 16.0),
]
#: adjacent[a, b]: whether two characters, as code points below 128, are neighbours on a keyboard or in order.
ADJACENT = np.zeros((128, 128), bool)
for _a, _b in NEXT:
    ADJACENT[ord(_a), ord(_b)] = True


def _words_of(path: str) -> list[str]:
    """Words of a vocabulary in its order: of a JSON file of the tokenizers library those whose end is marked, of a file of ranks all of letters, without the blank before them."""
    if path.endswith(".json"):
        with open(path, encoding="utf-8") as f:
            ids = json.load(f)["model"]["vocab"]
        found = [t.removesuffix("</w>") for t in sorted(ids, key=ids.get) if t.endswith("</w>")]
    else:
        with open(path, "rb") as f:
            tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
        found = [t.decode("utf-8", "replace").removeprefix(" ").lower() for t in tokens]
    return [w for w in found if len(w) >= 3 and w.isascii() and w.isalpha()]


@cache
def dictionary(*vocabularies: str) -> dict[str, int]:
    """The rank of each known word, from 1, the least of those it has. vocabularies: files of the tokenizers library, or of ranks; by default the public word vocabulary and that for many languages. A word of a second vocabulary takes as many more guesses as it comes later, and one bit, as an attacker tries both."""
    if not vocabularies:
        import public_tokenizers

        vocabularies = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    out: dict[str, int] = {}
    for n, path in enumerate(vocabularies):
        for i, w in enumerate([*(COMMON if n == 0 else []), *_words_of(path)], 1):
            out[w] = min(out.get(w, i << n), i << n)
    return out


class Lexicon:
    """All beginnings, from three letters on, of the words of a dictionary."""

    held: tuple[dict[str, int], set[str]] | None = None

    @classmethod
    def of(cls, words: dict[str, int]) -> set[str]:
        if cls.held is None or cls.held[0] is not words:
            cls.held = words, {w[:k] for w in words for k in range(3, len(w) + 1)}
        return cls.held[1]


def alphabet(value: str) -> float:
    """Bits a character of brute force: the classes of characters that occur."""
    return math.log2(sum(n for pattern, n in (("[a-z]", 26), ("[A-Z]", 26), ("[0-9]", 10), ("[^A-Za-z0-9]", 33)) if re.search(pattern, value)) or 1)


def ends(holds: np.ndarray) -> list[int]:
    """For each place, and the one behind the last, the first at or behind it whose pair is broken."""
    breaks = np.append(np.flatnonzero(~holds), len(holds))
    return breaks[np.searchsorted(breaks, np.arange(len(holds) + 1))].tolist()


def guess_bits(value: str, words: dict[str, int] | None = None, enough: float = math.inf) -> float:
    """The least cost, in bits, of the cuts of value; where that is not below `enough`, something not below it. words: rank of each known word, from 1."""
    if not value:
        return 0.0
    words = dictionary() if words is None else words
    begins = Lexicon.of(words)
    lower, plain, each, n = value.lower(), value.lower().translate(LEET), alphabet(value), len(value)
    if len(lower) != n:  # so that places hold
        lower = plain = value
    codes = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), "<u4")
    low = np.minimum(np.frombuffer(lower.encode("utf-32-le", "surrogatepass"), "<u4"), 127)
    walks = ends(ADJACENT[low[:-1], low[1:]])
    repeats = [(size, ends(codes[size:] == codes[:-size]), 3 if size == 1 else 2) for size in range(1, 5) if size < n]
    best = array("d", [math.inf]) * (n + 1)
    filled = np.frombuffer(best)  # the same numbers, for operations on many
    best[0], last = 0.0, 0
    begun: dict[tuple, list[tuple[int, float]]] = {}

    def step(j: int, bits: float) -> None:
        nonlocal last
        if bits < best[j]:
            best[j] = bits
            if bits < enough and j > last:
                last = j

    def fill(places: slice, bits: np.ndarray) -> None:
        """bits: ascending, so that those below `enough` come first."""
        nonlocal last
        np.minimum(filled[places], bits, out=filled[places])
        live = int(np.searchsorted(bits, enough))
        if live:
            last = max(last, places.start + (live - 1) * (places.step or 1))

    def worth(stretch: tuple, i: int, here: float, shortest: int) -> bool:
        """Whether no step that began before in a stretch is as good at all its places: it costs more by a part that is the largest for the shortest step."""
        held = begun.setdefault(stretch, [])
        for a, bits in held:
            if here >= bits + math.log2((i - a + shortest) / shortest):
                return False
        held.append((i, here))
        return True

    i = -1
    while i < min(last, n - 1):
        i += 1
        here = best[i]
        if here >= enough:
            continue
        if here + each < best[i + 1]:
            step(i + 1, here + each)
        j = i + 3
        while j <= n and ((x := lower[i:j]) in begins or plain[i:j] in begins):
            if rank := words.get(x) or words.get(plain[i:j]):
                changed = (x != value[i:j]) + (plain[i:j] != x)
                step(j, here + math.log2(rank) + 1 + 2 * changed)
            j += 1
        c = value[i]
        if c in SEPARATORS and i:
            step(i + 1, here + SEPARATOR)
        if c in "0123456789" and (date := DATE.match(value, i)):
            step(date.end(), here + DATES)
        if c in "$<{%" or not i or not value[i - 1].isalnum():
            for shape, bits in SHAPES:
                if found := shape.match(value, i):
                    step(found.end(), here + bits)
        end = walks[i] + 1
        if end >= i + 3 and i < n - 1 and worth(("walk", end), i, here, 3):
            fill(slice(i + 3, end + 1), here + math.log2(len(NEXT)) + np.log2(np.arange(3, end - i + 1)))
        for size, run, least in repeats:  # the unit by brute force, then how often
            if i + size < n and run[i] - i >= size * (least - 1):
                most = (run[i] + size - i) // size
                if worth((size, run[i], i % size), i, here, size * least):
                    fill(slice(i + size * least, i + size * most + 1, size), here + size * each + np.log2(np.arange(least, most + 1)))
    if best[n] < math.inf:
        return best[n]
    return float(filled[(filled >= enough) & (filled < math.inf)].min())  # so much at least, as all ways lead past such places


def spans(text: str | None, min_bits: float = MIN_BITS) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind; code points, end exclusive."""
    text = text or ""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    found += [("guess", m.start(1), m.end(1)) for m in CONTEXT.finditer(text) if guess_bits(m[1], enough=min_bits) >= min_bits]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def listed(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def redact(text: str | None, mark: str = "[SECRET]", min_bits: float = MIN_BITS) -> str | None:
    """The text with every span, or run of spans that overlap, replaced by the mark."""
    if not text:
        return text
    out, at = [], 0
    for _, a, b in spans(text, min_bits):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(text: Column, min_bits: float = MIN_BITS) -> Column:
    """A struct of n_assign, n_access, n_hex, base_sha256 and spans for each text."""

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            found = spans(t, min_bits)
            base = [s for s in found if s[0] != "guess"]
            counts = [sum(s[0] == k for s in base) for k in KINDS[:3]]
            rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(found)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return of(text)


def redacted(text: Column, mark: str = "[SECRET]", min_bits: float = MIN_BITS) -> Column:
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([redact(t, mark, min_bits) for t in texts], dtype=object)

    return of(text)
