"""Toxicity by multiple-instance learning: a document is a bag of sentences, a sentence has a logistic score, and noisy-or combines the scores: a document is toxic unless all of its sentences are clean. The model is trained from labels of documents alone, and then tells which sentences offend.

Features of a sentence are its lower-case words and their first letters. The classifier is fitted on a bounded sample of labelled documents (at most MAX_TOXIC and MAX_CLEAN, chosen by a hash, either kind weighted back to its share); everything is scored.

Null and empty texts have no sentence and score 0, so predicted is 0. Whole texts are scored, however long. Other columns play no part, and a score of exactly one half counts as toxic. Rows that share a key share a label, toxic if any of them is; one of their texts is learnt from, the first by a hash. Without toxic labels all scores are 0. Repeated rows get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_TOXIC = 4000
MAX_CLEAN = 8000
FEATURES = 4000
ROUNDS = 400
PREFIXES = (5, 6, 7, 8)
WORD = re.compile(r"[^\W\d_]+")
END = re.compile(r"[.!?\n]+")
REMEMBERED = 300_000


def features(word: str) -> list[str]:
    return [word, *[word[:k] + "*" for k in PREFIXES if len(word) > k]]


class Hits(dict):
    """The features of the model that a word has, by number."""

    def __init__(self, numbers: dict[str, int]) -> None:
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = tuple(self.numbers[f] for f in features(word) if f in self.numbers)
        return found


@dataclass
class Model:
    weights: dict[str, float]
    bias: float
    _hits: Hits | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.weights, self.bias

    def __setstate__(self, state):
        self.weights, self.bias = state
        self._hits = None

    def sentences(self, text: str) -> tuple[int, list[tuple[int, int, float]]]:
        """Number of sentences that have no feature, and start, end and score in log odds of the others."""
        if self._hits is None:
            self._hits, self._w = Hits({f: i for i, f in enumerate(self.weights)}), list(self.weights.values())
        lower = text.lower()
        if len(lower) != len(text):  # so that places hold
            lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        at, plain, out = 0, 0, []
        for part in END.split(lower):
            words = WORD.findall(part)
            if words:
                found = {f for hits in map(self._hits.__getitem__, words) if hits for f in hits}
                if found:
                    out.append((at, at + len(part), self.bias + sum(self._w[f] for f in sorted(found))))
                else:
                    plain += 1
            at += len(part)
            while at < len(lower) and lower[at] in ".!?\n":
                at += 1
        return plain, out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Probability that the text is toxic, and start, end and probability of the sentences that are likelier toxic than not."""
        if not text or not self.weights:
            return 0.0, []
        plain, found = self.sentences(text)
        clean = -plain * np.logaddexp(0.0, self.bias) - sum(float(np.logaddexp(0.0, z)) for _, _, z in found)
        return float(-np.expm1(clean)), [(a, b, float(1 / (1 + np.exp(-z)))) for a, b, z in found if z >= 0]


def fit(texts: list[str], toxic: list[int], clean_weight: float = 1.0, n_features: int = FEATURES, rounds: int = ROUNDS, toxic_weight: float = 1.0) -> Model:
    """Noisy-or training by gradient ascent (Adam) on the likelihood of the documents' labels, with a ridge. Only the ratio of the weights counts: the gradient is a weighted mean."""
    bags = [[set(WORD.findall(s)) for s in END.split((t or "").lower())] for t in texts]
    bags = [[s for s in bag if s] for bag in bags]
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    if not n1:
        return Model({}, -20.0)
    df1 = Counter(f for bag, y in zip(bags, toxic, strict=True) if y for f in {f for s in bag for w in s for f in features(w)})
    least = max(2, n1 // 500)
    df1 = {f: n for f, n in df1.items() if n >= least}
    df0 = Counter(f for bag, y in zip(bags, toxic, strict=True) if not y for f in {f for s in bag for w in s for f in features(w) if f in df1})
    gain = {f: n / n1 - df0[f] / max(n0, 1) for f, n in df1.items()}
    spread = {f: np.sqrt((n + 1) / n1 / n1 + (df0[f] + 1) / max(n0, 1) / max(n0, 1)) for f, n in df1.items()}
    chosen = sorted((f for f in df1 if gain[f] > 2 * spread[f]), key=lambda f: (-gain[f] / spread[f], f))[:n_features]
    hits = Hits({f: i for i, f in enumerate(chosen)})
    docs, plain, rows, columns, n = [], np.zeros(len(bags)), [], [], 0
    for d, bag in enumerate(bags):
        for s in bag:
            found = {f for w in s for f in hits[w]}
            if found:
                docs.append(d)
                rows += [n] * len(found)
                columns += found
                n += 1
            else:
                plain[d] += 1
    docs, rows, columns = np.array(docs, int), np.array(rows, int), np.array(columns, int)
    y, weight = np.array(toxic, float), np.where(np.array(toxic) == 1, toxic_weight, clean_weight)
    w, bias = np.zeros(len(chosen)), -6.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, rounds + 1):
        z = bias + np.bincount(rows, w[columns], n)
        clean = -plain * np.logaddexp(0, bias) - np.bincount(docs, np.logaddexp(0, z), len(bags))
        p = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-9)
        # d log-likelihood / d z of a sentence: sigmoid(z) times (y / p - 1).
        by_doc = weight * (y / p - 1)
        dz = by_doc[docs] / (1 + np.exp(-z))
        grad = np.append(np.bincount(columns, dz[rows], len(chosen)), dz.sum() + (by_doc * plain).sum() / (1 + np.exp(-bias))) / weight.sum()
        grad[:-1] -= 1e-4 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w + step[:-1], bias + step[-1]
    return Model({f: float(x) for f, x in zip(chosen, w, strict=True)}, float(bias))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """A model of the labelled documents. labels: key and label, one of 0 and 1; null labels don't count."""
    by_key = labels.select(labels[key].alias("key"), labels[label].cast("int").alias("y")).where("key IS NOT NULL AND y IN (0, 1)").groupBy("key").agg(F.max("y").alias("y"))
    counts = {r["y"]: r["n"] for r in by_key.groupBy("y").agg(F.count("*").alias("n")).collect()}
    some = lambda y, n: by_key.where(F.col("y") == y).orderBy(F.xxhash64("key"), "key").limit(n)
    sample = some(1, max_toxic).unionByName(some(0, max_clean))
    sample = docs.select(docs[key].alias("key"), docs[text].alias("text")).join(F.broadcast(sample), "key")
    # Of the texts of one key the first by a hash, so that training again gives the same model.
    sample = sample.groupBy("key", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    clean_weight, toxic_weight = max(1.0, counts.get(0, 0) / max_clean), max(1.0, counts.get(1, 0) / max_toxic)

    def learn(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(parts)).sort_values("key")
        model = fit(pdf["text"].tolist(), pdf["y"].tolist(), clean_weight, toxic_weight=toxic_weight)
        yield pd.DataFrame({"feature": ["", *model.weights], "weight": [model.bias, *model.weights.values()]})

    if not counts.get(1):
        return Model({}, -20.0)
    # At most max_toxic + max_clean rows in one task, at most FEATURES + 1 rows to the driver.
    learnt = {r["feature"]: r["weight"] for r in sample.repartition(1).mapInPandas(learn, "feature string, weight double").collect()}
    return Model(dict(sorted((f, w) for f, w in learnt.items() if f)), learnt.get("", -20.0))


def scores(text: Column, model: Model) -> Column:
    """A struct of score and offending, an array of structs of start, end (code points) and score of a sentence."""

    @F.pandas_udf("score double, offending array<struct<start: int, end: int, score: double>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = [model.score(t) for t in texts]
        return pd.DataFrame({"score": [s for s, _ in rows], "offending": [[{"start": a, "end": b, "score": p} for a, b, p in o] for _, o in rows]})

    return of(text)


def listed(offending: Column) -> Column:
    """The places of offending sentences as text: start:end (code points, end exclusive), joined by commas."""
    return F.array_join(F.transform(offending, lambda x: F.concat(x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")
