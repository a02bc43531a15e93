"""Hard negatives, decontamination and periodic runs, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import connect, rows_in, rows_of
from pyspark.sql import functions as F

from palimpsest.llm import hard_negatives as hn
from palimpsest.llm import periodic, winnow
from palimpsest.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_decontamination", "op13_periodic"])
def test_same_as_sql(spark, name):
    assert rows_of(QUERIES[name](spark, FOLDER)) == rows_in(connect(FOLDER), SQL[name])


# Hard negatives

SCHEMA = "vec_id long, label int, embedding array<double>, slice string, anchor int, positives string"


def mined(rows, every, positives=2, negatives=2):
    """rows: (key, label, vector); the contract, pair by pair."""
    used = [(k, y, [int(np.floor(256 * x)) for x in v]) for k, y, v in rows if None not in (k, y, v) and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for i, (k, y, v) in enumerate(used):
        if k % every:
            continue
        others = sorted((-dot(v, w), o, z) for j, (o, z, w) in enumerate(used) if j != i)
        for s, o, _ in [x for x in others if x[2] == y][:positives]:
            found = [x for x in others if x[2] != y and 50 * -s <= 100 * -x[0] <= 95 * -s]
            out += [(k, o, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(found[:negatives])]
    return sorted(out)


def mine(spark, data, every, **more):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in data], SCHEMA)
    found = hn.hard_negatives(df, F.col("vec_id"), F.col("label"), F.col("embedding"), F.col("vec_id") % every == 0, positives=2, negatives=2, **more)
    return sorted(tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_hard_negatives_against_brute_force(spark):
    r = random.Random(5)
    rows = [(i, r.randrange(3), [r.choice([-1.0, -0.25, 0.0, 0.5, 0.75]) for _ in range(4)]) for i in range(150)]  # many ties
    rows += [(None, 1, [1.0] * 4), (300, None, [1.0] * 4), (301, 1, None), (302, 1, [1.0, None, 0.0, 0.0]), (303, 1, [float("nan")] * 4), (304, 1, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(10, 0, [0.5] * 4), (10, 0, [0.5] * 4), (5, 1, [0.75, 0.5]), (7, 2, [])]  # repeated rows, shorter vectors
    want = mined(rows, 5)
    assert len(want) > 40
    assert mine(spark, rows, 5, rows=16, anchors=4, sample=20, pivots=3) == want
    assert mine(spark, rows, 5) == want


def test_hard_negatives_in_clusters(spark):
    """Where vectors gather, pivots rule blocks out, and nothing is lost."""
    r = np.random.default_rng(2)
    centres = r.normal(size=(6, 8))
    rows = [(i, int(i % 3), (centres[i % 6] + 0.02 * r.normal(size=8)).tolist()) for i in range(300)]
    assert mine(spark, rows, 10, rows=32, anchors=8) == mined(rows, 10)
    x = np.floor(256 * np.array([v for _, _, v in rows])).astype(np.int64)
    table = hn.PivotTable(x, float((x * x).sum(axis=1).max()))
    dq, dx = table.of_anchors(x[:40]), table.of_rows(x)
    least, most = table.brackets((x[:40].astype(float) ** 2).sum(axis=1), dq, dx, dx)
    exact = x[:40] @ x.T
    assert (least <= exact).all() and (exact <= most).all()
    third = np.sort(exact, axis=1)[:, -10][:, None]
    assert (most >= third).mean() < 0.5  # brackets alone drop most pairs


def test_hard_negatives_edges(spark):
    assert mine(spark, [], 5) == []
    assert mine(spark, [(1, 0, [1.0]), (2, 1, [1.0])], 50) == []  # no anchors
    assert mine(spark, [(0, 1, [1.0]), (1, 1, [1.0])], 50) == []  # a single label
    assert mine(spark, [(0, 1, [0.0]), (1, 1, [0.0]), (2, 2, [0.0])], 50) == [(0, 1, 1, 2, 0, 0)]
    with pytest.raises(Exception, match="too large"):
        mine(spark, [(0, 1, [1e9]), (1, 2, [1e9]), (2, 1, [1e9])], 50)


def test_hard_negatives_meet_in_places_of_a_grid(spark):
    """A task gets each block once, where pairs of blocks were rows of a join (and blocks were broadcast, as Spark takes exploded arrays for small)."""
    r = np.random.default_rng(3)
    rows = [(i, int(i % 3), r.normal(size=8).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    found = hn.hard_negatives(df, F.col("vec_id"), F.col("label"), F.col("embedding"), F.col("vec_id") % 10 == 0, positives=2, negatives=2, rows=32, anchors=8)
    assert sorted(tuple(x) for x in found.collect()) == mined(rows, 10)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CoGroupsInArrow" in plan and "Join" not in plan


def test_best_of_lists():
    """With many ties, in portions of any size, the same as a sort of all."""
    r = np.random.default_rng(4)
    at, keys, scores = r.integers(0, 5, 3000), r.permutation(3000), r.integers(-3, 4, 3000)
    best = hn.Best(6, 4)
    for part in np.array_split(np.arange(3000), 40):
        best.add(at[part], keys[part], scores[part])
    want = [(i, k, -s) for i in range(6) for s, k in sorted((-s, k) for a, k, s in zip(at, keys, scores, strict=True) if a == i)[:4]]
    assert list(zip(*(x.tolist() for x in best.settle()), strict=True)) == want


@pytest.mark.parametrize("size, kind", [(1.0, "f4"), (300.0, "f8"), (600_000.0, "i8")])
def test_hard_negatives_of_large_vectors(spark, size, kind):
    r = np.random.default_rng(5)
    rows = [(i, int(i % 3), (size * r.uniform(-1, 1, 3)).tolist()) for i in range(60)] + [(60, 1, [size] * 3)]
    assert hn.kind_of(max(sum(np.floor(256 * x) ** 2 for x in v) for _, _, v in rows)) == f"<{kind}"
    assert mine(spark, rows, 5, rows=16, anchors=4) == mined(rows, 5)


# Decontamination


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def contaminated(text, items):
    words, hit, found = tokens(text), set(), set()
    for name, item in items:
        w = tokens(item)
        m = min(10, len(w))
        windows = {tuple(w[i : i + m]) for i in range(len(w) - m + 1)} if m else set()
        for i in range(len(words) - m + 1):
            if tuple(words[i : i + m]) in windows:
                hit |= set(range(i, i + m))
                found.add("" if name is None else str(name))
    return len(words), len(hit), sorted(found, key=lambda x: x.encode())


def marks(docs, benchmark, **more):
    found = winnow.contamination(docs, benchmark, carry=["doc_id"], **more).select("row.doc_id", "found.*").collect()
    return sorted((r["doc_id"], r["n_words"], r["n_hit"], r["items"], [tuple(s) for s in r["spans"]]) for r in found)


def test_decontamination_against_brute_force(spark):
    r = random.Random(3)
    voc = ["Alpha", "beta", "GAMMA", "7", "ß", "Éa", "x_y", "zz"]
    text = lambda n: "".join(r.choice(voc) + r.choice([" ", ", ", "\n", "\x7f"]) for _ in range(n))
    items = [(r.choice([None, *range(12)]), text(r.choice([0, 1, 4, 6, 9, 10, 14, 40]))) for _ in range(25)]
    docs = [(i, text(r.randrange(30)) + r.choice(items)[1] + text(r.randrange(8))) for i in range(150)]
    docs += [(1000, None), (1001, ""), (1002, "--- !!"), (1003, text(60_000)), (0, docs[0][1]), (None, docs[1][1])]
    known = [(n, t) for n, t in items]
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], "doc_id long, text string, row string, found string")
    benchmark = spark.createDataFrame([(n, t, 1) for n, t in items], "item_id long, text string, id int")
    keyed = lambda rows: sorted(rows, key=lambda x: (x[0] is None, x[0] or 0))
    whole = keyed(r for r in map(tuple, winnow.contamination(df, benchmark, carry=["doc_id"]).select("row.doc_id", "found.n_words", "found.n_hit", "found.items").collect()))
    assert whole == keyed((d, *contaminated(t, known)) for d, t in docs)
    # In many parts the same, spans included.
    a, b = (keyed(map(tuple, winnow.contamination(df, benchmark, carry=["doc_id"], part=p).select("row.doc_id", "found.*").collect())) for p in (winnow.PART, 400))
    assert a == b


def test_decontamination_edges(spark):
    docs = spark.createDataFrame([(1, "some words that nobody has ever written in this order here")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert marks(docs, none) == [(1, 11, 0, [], [])]
    assert marks(docs.limit(0), none) == []
    empty = spark.createDataFrame([(1, None), (2, " - ")], "item_id long, text string")
    assert marks(docs, empty) == [(1, 11, 0, [], [])]
    one = spark.createDataFrame([(5, "Nobody"), (5, "this order"), (40, "x")], "item_id long, text string")
    assert marks(docs, one) == [(1, 11, 3, ["5"], [(3, 4), (8, 10)])]


@settings(max_examples=40)
@given(st.lists(st.integers(0, 3), max_size=80), st.integers(5, 10))
def test_winnowing_guarantee(numbers, length):
    """Any span of so many words that two texts share has a kept k-gram in common, at the same place in it."""
    word = ["a", "b", "c", "d"]
    left = winnow.words_of([" ".join(word[n] for n in numbers).encode()])
    at, hashes = winnow.winnowed(left, length)
    kept = dict(zip(at.tolist(), hashes.tolist(), strict=True))
    k, w = winnow.shape(length)
    for first in range(len(numbers) - length + 1):
        alone = winnow.words_of([left.span(first, length)])
        own, g = winnow.winnowed(alone, length)
        assert len(own) == 1 and kept.get(first + int(own[0])) == int(g[0])


# Periodic runs


def all_runs(codes, repeats=4, least=6):
    found = {}
    for p in range(1, len(codes) // repeats + 1):
        i = 0
        while i + p < len(codes):
            j = i
            while j + p < len(codes) and codes[j] == codes[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, repeats * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


@settings(max_examples=300)
@given(st.lists(st.integers(0, 2), max_size=70), st.integers(1, 9), st.integers(3, 9), st.sampled_from([16, 1 << 20]))
def test_runs_against_brute_force(numbers, period, times, block):
    codes = np.array([*numbers[:20], *(numbers[20:] or [7])[:period] * times, *numbers[:5]], np.int64)
    kept, periodic.BLOCK = periodic.BLOCK, block
    try:
        assert periodic.runs_of(codes) == all_runs(codes.tolist())
    finally:
        periodic.BLOCK = kept


def test_periodic_rows(spark):
    r = random.Random(9)
    noise = " ".join(str(r.random()) for _ in range(40_000))
    texts = {1: None, 2: "", 3: " \n\t ", 4: "a a a a a", 5: "a a a a a a", 6: "x " + "a b " * 4 + "y", 7: "a\x0bb\u00a0c " * 9, 8: noise + " w" * 30_000, 9: "a a a a a a b b b b b b"}
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, texts[6], "x"), (5, texts[5], "x")], "doc_id long, text string, runs string")
    rows = df.select("doc_id", periodic.found(F.col("text")).alias("r")).select("doc_id", "r.*").collect()
    got = {x["doc_id"]: x for x in rows}
    runs = {i: [tuple(y) for y in x["runs"]] for i, x in got.items()}
    assert [runs[i] for i in (1, 2, 3, 4)] == [[]] * 4 and runs[5] == [(0, 6, 1)] and runs[6] == runs[None] == [(1, 8, 2)]
    assert got[6]["collapsed"] == "x a b y" and got[4]["collapsed"] == "a a a a a" and got[1]["collapsed"] == ""
    assert runs[7] == [(0, 18, 2)] and got[7]["collapsed"] == "a b\u00a0c"
    assert runs[8] == [(40_000, 30_000, 1)] and got[8]["n_words"] == 70_000
    assert runs[9] == [(0, 6, 1), (6, 6, 1)] and tuple(got[9]["strongest"]) == (0, 6, 1)
    assert got[1]["strongest"] is None and got[1]["runs_sha256"] == hashlib.sha256().hexdigest() and got[6]["runs_sha256"] == hashlib.sha256(b"1,8,2\n").hexdigest()
    assert len(rows) == 11 and df.limit(0).select(periodic.found(F.col("text")).alias("r")).count() == 0
