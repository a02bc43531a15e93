"""Periodic runs of words: stretches that repeat themselves every q words, at least four times.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words, which no neighbouring word extends. They are found by a harmonic grid: for each period p, words at the grid points 0, p, 2p, ... are compared with the next one. A run has 3 p words in a row that equal the word p further on, so three grid points in a row agree. From such points the stretch is extended to both sides, by comparing pieces of growing length, and grid points inside of what was found already are skipped. There are n / p grid points for each p, so a text of n words needs about n ln n comparisons.

A stretch with period p whose smallest period is q < p has q as a divisor of p, as it is longer than p + q, and it is the run of q itself, found before: periods go upwards. So a grid point of p within a run of a divisor of p is skipped too.

Words are compared as such, not by hashes. Null and empty texts have no words and no runs. Texts of any length are handled whole; memory is a few numbers for each word, and the comparisons of large texts go through in blocks. Each row is on its own: nothing is shuffled, repeated rows get equal results, other columns play no part, and an empty table gives an empty result. Runs of equal exponent are told apart by the smaller start, then the smaller period.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

REPEATS = 4
LEAST = 6
#: Comparisons made at once.
BLOCK = 1 << 20

Run = tuple[int, int, int]


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()  # of bytes: at ASCII white space only


def coded(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def probes(codes: np.ndarray, repeats: int = REPEATS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid points and their periods, periods upwards, at which the grid says that a run may be: as many points in a row as any run has agree with the next."""
    n, row = len(codes), repeats - 1
    p = 1
    while p <= n // repeats:
        if (n - 1) // p > BLOCK // 8:
            # Few periods with many points: a view of every p-th word.
            grid = codes[::p]
            same = grid[:-1] == grid[1:]
            hit = same[: len(same) - row + 1].copy()
            for k in range(1, row):
                hit &= same[k : len(same) - row + 1 + k]
            at = np.flatnonzero(hit) * p
            yield at, np.full(len(at), p)
            p += 1
            continue
        last = min(n // repeats, p + max(BLOCK // ((n - 1) // p + 1), 1) - 1)
        periods = np.arange(p, last + 1)
        count = (n - 1) // periods
        period = np.repeat(periods, count)
        at = (np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)) * period
        same = codes[at] == codes[at + period]
        hit = same[: len(same) - row + 1] & (period[: len(same) - row + 1] == period[row - 1 :])
        for k in range(1, row):
            hit &= same[k : len(same) - row + 1 + k]
        found = np.flatnonzero(hit)
        yield at[found], period[found]
        p = last + 1


def extended(codes: np.ndarray, at: int, p: int) -> tuple[int, int]:
    """The first word of the stretch around a word that equals the word p further on, and the first word behind it."""
    low, step = at, 64
    while low > 0:
        first = max(low - step, 0)
        apart = np.flatnonzero(codes[first:low] != codes[first + p : low + p])
        if len(apart):
            low = first + int(apart[-1]) + 1
            break
        low, step = first, 2 * step
    high, step = at + p, 64
    while high < len(codes):
        last = min(high + step, len(codes))
        apart = np.flatnonzero(codes[high:last] != codes[high - p : last - p])
        if len(apart):
            high += int(apart[0])
            break
        high, step = last, 2 * step
    return low, high


def runs_of(codes: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> list[Run]:
    """start, length and period of each run, by start, then period."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    seen: set[tuple[int, int]] = set()
    for at, period in probes(codes, repeats):
        for points in np.split(at, np.flatnonzero(np.diff(period)) + 1) if len(at) else ():
            p, period = int(period[0]), period[len(points) :]
            for q, (lows, highs) in held.items():
                if p % q == 0:
                    # Runs of one period go upwards at both ends, so the last that begins before a point reaches furthest.
                    last = np.searchsorted(lows, points, "right") - 1
                    points = points[(last < 0) | (points + (repeats - 1) * p > highs[last])]
            runs, k = [], 0
            while k < len(points):
                low, high = extended(codes, int(points[k]), p)
                # Grid points may agree across a gap in a stretch, and lead back to it.
                if high - low >= max(least, repeats * p) and (low, high) not in seen:
                    seen.add((low, high))
                    runs.append((low, high))
                k = max(k + 1, int(np.searchsorted(points, high - (repeats - 1) * p, "right")))
            if runs:
                held[p] = tuple(np.array(x) for x in zip(*runs, strict=True))
    return sorted((low, high - low, p) for p, ends in held.items() for low, high in zip(*(e.tolist() for e in ends), strict=True))


def strongest(runs: list[Run]) -> Run | None:
    """The run that repeats most often, by the exact quotient."""
    best = None
    for s, length, p in runs:
        if best is None or (length * best[2], -s, -p) > (best[1] * p, -best[0], -best[2]):
            best = s, length, p
    return best


def kept(n: int, runs: list[Run]) -> np.ndarray:
    """Which of n words stay: all but those that a run holds behind its first period."""
    stay = np.ones(n, bool)
    for start, length, p in runs:
        stay[start + p : start + length] = False
    return stay


FOUND = "struct<n_words: long, runs: array<struct<start: long, length: long, period: long>>, strongest: struct<start: long, length: long, period: long>, runs_sha256: string, collapsed: string>"


def found(text: Column, repeats: int = REPEATS, least: int = LEAST, collapse: bool = True) -> Column:
    """n_words; runs, by start, then period; the strongest run, or null; a hash of the runs as lines `start,length,period`; and collapsed, the words without the repeats of runs, joined by blanks (null if collapse is False)."""

    @F.pandas_udf(FOUND)
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = split(t)
            runs = runs_of(coded(words), repeats, least) if len(words) >= max(least, repeats) else []
            best = strongest(runs)
            lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
            rest = [w for w, stays in zip(words, kept(len(words), runs), strict=True) if stays] if runs else words
            rows.append((len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], best and dict(zip(("start", "length", "period"), best, strict=True)), hashlib.sha256(lines.encode()).hexdigest(), b" ".join(rest).decode("utf-8", "surrogatepass") if collapse else None))
        return pd.DataFrame(rows, columns=["n_words", "runs", "strongest", "runs_sha256", "collapsed"])

    return of(text)
