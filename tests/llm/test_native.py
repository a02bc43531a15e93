"""Mixing, fingerprints, sharding and quality rules against brute force, and their edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import bottomk, mixing, quality, queries, sharding

D = "/root/testdata/sf0.001"
W = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(0, None, None), (1, "", "b"), (2, " \t\n", "b"), (3, "a b c", None), (3, "a b c", None), (4, "x " * 5000, "a"), (None, "null key words here", "a"), (6, "é ñ\x0b\x0c\r ü", "ö")]


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{D}/documents.parquet").collect()}


def odd(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns with names that operators use inside."""
    return spark.createDataFrame([(*r, i, "x", 1.5) for i, r in enumerate(ODD)], "doc_id long, text string, source string, size long, key string, hash double")


def shingles(t, n=5):
    w = W.findall(t)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def base_counts(t):
    w = W.findall(t)
    c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if W.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_quality_base(spark, docs):
    for r in queries.op10_quality(spark, D).collect():
        assert base_counts(docs[r["doc_id"]]["text"]) == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_finds_labelled_junk(spark):
    """On labels EM is right where counting the rules that blame is wrong: one blame of a good rule is enough, one of a poor rule is not."""
    d = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    judged = quality.judge(spark.read.parquet(f"{d}/documents.parquet"), carry=["doc_id"])
    rows = [(labels[r["doc_id"]], r["kept"], sum(v == quality.BAD for v in r["votes"])) for r in judged.select("row.doc_id", "kept", "votes", "base_failed").collect() if r["doc_id"] in labels and not r["base_failed"]]
    good, bad = [r for r in rows if r[0] == 1], [r for r in rows if r[0] == 0]
    assert sum(kept for _, kept, _ in good) > 0.995 * len(good) and sum(kept for _, kept, _ in bad) < 0.03 * len(bad)
    wrong = sum(kept != q for q, kept, _ in rows)
    assert [sum((n < least) != q for q, _, n in rows) > wrong for least in (1, 2)] == [True, True]
    differing = [(q, kept) for q, kept, n in rows for least in (1, 2) if kept != (n < least)]
    assert len(differing) > 20 and sum(q == kept for q, kept in differing) > 0.9 * len(differing)


def test_em_weighs_rules():
    """A rule that blames at random gets no say, and the blame of a rule that is never wrong is enough; counting blames can't tell them apart."""
    rng, patterns, truth = random.Random(3), collections.Counter(), collections.defaultdict(collections.Counter)
    for _ in range(20_000):
        good = rng.random() < 0.8
        sure = [-1 if not good and rng.random() < 0.6 else 1 for _ in range(3)]
        noise = [-1 if rng.random() < 0.3 else 1 for _ in range(2)]
        patterns[(*sure, *noise)] += 1
        truth[(*sure, *noise)][good] += 1
    model = quality.fit(sorted(patterns.items()), 5)
    assert all(b == pytest.approx(0.6, abs=0.05) for b in model.on_bad[:3]) and all(b == pytest.approx(0.3, abs=0.05) and a == pytest.approx(0.7, abs=0.05) for a, b in zip(model.on_good[3:], model.on_bad[3:], strict=True))
    odds = lambda v: sum(math.log(a / (1 - b)) if x == 1 else math.log((1 - a) / b) for x, a, b in zip(v, model.on_good, model.on_bad, strict=True))
    assert odds((1, 1, 1, -1, -1)) > 0 > odds((-1, 1, 1, 1, 1)) + 1.4
    # A table and its copies give one model.
    again = quality.fit(sorted((v, 50 * n) for v, n in patterns.items()), 5)
    assert again.on_bad == pytest.approx(model.on_bad) and again.prior == pytest.approx(model.prior)


def test_quality_of_long_texts(spark):
    """Words drawn from 50 are junk at every length; texts with as many distinct words as prose has are not."""
    rng = random.Random(1)
    drawn = lambda n, kinds: " ".join(f"word{rng.randrange(kinds)}" for _ in range(n))
    rows = [(1, drawn(2_900, 50)), (2, drawn(3_100, 50)), (3, drawn(20_000, 50)), (4, drawn(20_000, 8_000)), (5, drawn(2_900, 8_000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select((F.col("doc_id") + 10**9).alias("doc_id"), "text"))
    got = {r["doc_id"]: r for r in quality.judge(df).select("row.doc_id", "votes", "kept", "base_failed").where("doc_id < 10").collect()}
    at = [r.name for r in quality.RULES].index("variety")
    assert [got[k]["votes"][at] for k in range(1, 6)] == [-1, -1, -1, 1, 1]
    assert [got[k]["kept"] for k in range(1, 6)] == [got[1]["kept"]] * 3 + [True, True]


@settings(max_examples=30, deadline=None)
@given(words=st.lists(st.sampled_from(["aa", "b", "cc", "*", "\n", "ddd", "aa\n"]), max_size=60))
def test_repeated_words(spark, words):
    text = " ".join(words)
    r = quality.signals(spark.createDataFrame([(text,)], "text string")).first()
    assert base_counts(text)[:5] == (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])


def test_em_recovers_accuracies():
    rng, accuracy, patterns = random.Random(1), (0.95, 0.9, 0.92), collections.Counter()
    for _ in range(20_000):
        y = 1 if rng.random() < 0.8 else -1
        patterns[tuple(0 if rng.random() < 0.2 else y if rng.random() < a else -y for a in accuracy)] += 1
    model = quality.fit(sorted(patterns.items()), 3)
    assert model.prior == pytest.approx(0.8, abs=0.05)
    assert all(abs(g - a) < 0.04 for g, a in zip(model.on_good, accuracy, strict=True))
    assert all(abs(b - a) < 0.08 for b, a in zip(model.on_bad, accuracy, strict=True))


def test_quality_edges(spark):
    kept = quality.keep_good(odd(spark))
    assert kept.columns == odd(spark).columns and kept.count() == 0  # too few words, or one word again and again
    assert quality.keep_good(odd(spark).limit(0)).count() == 0


def test_mixing(spark, docs):
    size = {k: len(W.findall(r["text"] or "")) for k, r in docs.items()}
    total, by = collections.Counter(), {k: r["source"] for k, r in docs.items()}
    for k, n in size.items():
        total[by[k]] += n
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(total))}
    full, budget = set(), 1.5 * sum(size.values())
    while True:
        level = (budget - sum(2 * total[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in weight if s not in full and level * weight[s] > 2 * total[s]}
        if not more:
            break
        full |= more
    rows, taken = queries.op4_mixing(spark, D).collect(), collections.Counter()
    for r in rows:
        s = by[r["doc_id"]]
        assert (r["size"], r["source_size"]) == (size[r["doc_id"]], total[s]) and r["taken"] in (0, r["size"], 2 * r["size"])
        assert r["target"] == pytest.approx(2 * total[s] if s in full else level * weight[s])
        taken[s] += r["taken"]
    largest = max(size.values())
    assert len(rows) == len(docs) and all(abs(taken[r] - (2 * total[r] if r in full else level * weight[r])) <= largest for r in total)
    assert budget - largest <= sum(taken.values()) <= budget
    assert sorted(rows) == sorted(queries.op4_mixing(spark, D).collect())


def test_mixing_edges(spark):
    rows = mixing.mix(odd(spark)).collect()
    assert len(rows) == len(ODD) and all(r["epochs_taken"] == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(odd(spark).limit(0)).count() == 0
    clashing = odd(spark).withColumns({c: F.lit(c) for c in ("__key", "__source", "__n", "k_", "s_", "n_", "n", "row", "turn", "brim")})
    assert mixing.mixed_rows(clashing).columns == clashing.columns and mixing.mixed_rows(clashing).where("__n <> '__n' OR n <> 'n'").count() == 0
    assert mixing.mixed_rows(odd(spark)).count() == mixing.mixed_rows(clashing).count() and mixing.mixed_rows(odd(spark).limit(0)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, "", "s")], "doc_id long, text string, source string")).first()["target"] == 0


def test_fingerprints(spark, docs):
    ids = sorted(docs)
    rows = {r["doc_id"]: r for r in queries.op8_fingerprints(spark, D).collect()}
    assert sorted(rows) == ids
    for i, k in enumerate(ids):
        t, n, r = docs[k]["text"], docs[ids[(i + 1) % len(ids)]]["text"], rows[k]
        edited = t[: len(t) - len(t) // 4] + n[: len(t) // 4]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, got in ((edited, r["near_edited"]), (n, r["near_next"])):
            a, b = shingles(t), shingles(other)
            want = len(a & b) / len(a | b) if a | b else 1.0
            assert got == pytest.approx(want, abs=1e-9 if len(a | b) <= bottomk.K else 0.2)


def test_sketches_merge(spark):
    texts = [" ".join(f"w{i}" for i in range(a, b)) for a, b in ((0, 400), (200, 700), (0, 3), (0, 0))]
    df = bottomk.with_sketch(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), "text", "s")
    whole = bottomk.merge_groups(df.withColumn("g", F.lit(1)), ["g"], "s").first()["s"]
    parts = [r["s"] for r in df.orderBy("i").collect()]
    assert whole == sorted(set().union(*parts))[: bottomk.K] and len(parts[2]) == 1 and parts[3] == []
    r = df.where("i = 0").crossJoin(df.where("i = 1").select(F.col("s").alias("t"))).select(bottomk.distinct_shingles(F.col("s")), bottomk.containment(F.col("s"), F.col("t"))).first()
    assert r[0] == pytest.approx(396, rel=0.3) and r[1] == pytest.approx(196 / 396, abs=0.15)


def test_fingerprint_edges(spark):
    rows = bottomk.against_edits(odd(spark)).collect()
    assert len(rows) == len(ODD)
    one = bottomk.against_edits(spark.createDataFrame([(5, "abcdefgh")], "doc_id long, text string")).first()
    assert one["edited"] == "abcdefab"
    assert bottomk.against_edits(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_next_rows(spark, buckets):
    keys = [5, -3, 100, 7, 8, 9, 10**12, 11, 12]
    df = spark.createDataFrame([(k, str(k)) for k in keys], "k long, t string")
    got = {r["k"]: r["n"] for r in bottomk.with_next(df, "k", {"t": "n"}, "t", buckets).collect()}
    order = sorted(keys)
    assert got == {k: str(order[(i + 1) % len(order)]) for i, k in enumerate(order)}


def test_sharding(spark, docs):
    total, slots, where = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in queries.op9_sharding(spark, D).collect():
        t = docs[r["doc_id"]]["text"].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t) + 1, zlib.crc32(t), "bytes", None)
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[t].add(r["shard"])
    assert all(len(s) == 1 for s in where.values()) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sorted(total) == list(range(8)) and max(total.values()) - min(total.values()) < 0.02 * max(total.values())


@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 80))
def test_best_fit_decreasing(sizes, capacity):
    bins, rooms, want = sharding.best_fit_decreasing(sizes, capacity), [], []
    for s in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= s]
        if fits:
            rooms[min(fits)[1]] -= s
        else:
            rooms.append(capacity - s)
    filled = collections.Counter()
    for s, b in zip(sizes, bins, strict=True):
        filled[b] += s
    want = sorted(capacity - r for r in rooms)
    assert sorted(filled.values()) == want


def test_sharding_by_capacity(spark, docs):
    total = sum(len(r["text"].encode()) + 1 for r in docs.values())
    for capacity in (total // 5, total // 40):
        filled = collections.Counter()
        for r in sharding.shard(spark.read.parquet(f"{D}/documents.parquet"), capacity=capacity).collect():
            filled[r["shard"]] += r["size"]
        largest = max(len(r["text"].encode()) + 1 for r in docs.values())
        assert max(filled.values()) <= max(capacity, largest) and len(filled) <= 1.25 * total / capacity + 2


def test_sharding_by_capacity_in_tasks(spark, docs):
    """Units packed in one task or many, sent to all executors or joined: no shard above the capacity, equal texts together, few shards more, and the same however rows are dealt."""
    texts = {k: r["text"] for k, r in docs.items()}
    df = spark.read.parquet(f"{D}/documents.parquet")
    size = lambda t: len((t or "").encode()) + 1
    capacity = max(30_000, *[sum(size(t) for t in texts.values() if t == x) for x in set(texts.values())])
    total = sum(map(size, texts.values()))
    n = {}
    for units, most in ((10**6, 10**6), (40, 10**6), (40, 0)):
        got = sharding.shard(df, capacity=capacity, units_a_task=units, most_broadcast=most).collect()
        assert sorted(r["doc_id"] for r in got) == sorted(texts)
        filled, where, slots = collections.defaultdict(int), collections.defaultdict(set), collections.defaultdict(list)
        for r in got:
            filled[r["shard"]] += r["size"]
            where[texts[r["doc_id"]]].add(r["shard"])
            slots[r["shard"]].append(r["slot"])
        assert max(filled.values()) <= capacity and all(len(w) == 1 for w in where.values()) and all(sorted(x) == list(range(len(x))) for x in slots.values())
        assert sorted(filled) == list(range(len(filled)))
        n[units, most] = len(filled), sorted((r["doc_id"], r["shard"], r["slot"]) for r in got)
    assert n[40, 10**6] == n[40, 0]
    again = sharding.shard(df.orderBy(F.desc("text")).repartition(5), capacity=capacity, units_a_task=40, most_broadcast=0).collect()
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in again) == n[40, 0][1]
    assert total / capacity <= n[10**6, 10**6][0] <= n[40, 0][0] <= 1.1 * total / capacity + 12
    assert sharding.shard(odd(spark).limit(0), capacity=10).count() == 0 and sharding.shard(odd(spark), capacity=3, units_a_task=1).count() == len(ODD)


def test_sharding_edges(spark):
    rows = sharding.shard(odd(spark)).collect()
    assert len(rows) == len(ODD) and len({r["shard"] for r in rows if r["doc_id"] == 3}) == 1
    assert sharding.shard(odd(spark).limit(0)).count() == 0
