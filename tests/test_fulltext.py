"""The kept full-text index against scans of all texts."""

import random

from pyspark.sql import functions as F

from palimpsest.operators import fulltext, lexical, ranking, search
from palimpsest.sources.store import SnapshotStore, Stitch

WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa".split()


def some(seed, n, first=0):
    r = random.Random(seed)
    return [(first + i, None if r.random() < 0.05 else " ".join(r.choices(WORDS, weights=range(1, 11), k=r.randrange(25)))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "rowseq long, text string")


def pairs(df):
    return [(r["rowseq"], round(r["score"], 9)) for r in df.orderBy(F.desc(F.round("score", 9)), "rowseq").collect()]


def test_updates_and_searches(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    now = dict(some(1, 120))
    store.save(Stitch("", 0, ["*"]), fulltext.built(frame(spark, list(now.items())), part=16))

    def same():
        docs, kept = frame(spark, list(now.items())), fulltext.Kept(store.table)
        for query in ("kappa zeta alpha", "ÉPSILON beta-gamma kappa", "!", "alpha nothing"):
            want = lexical.bm25(docs, ["rowseq"], query)
            every = pairs(want)
            assert pairs(kept.scores(query)) == every and pairs(kept.top(query, 7)) == every[:7]
        allowed = docs.where("rowseq % 9 = 4").select("rowseq")
        want = lexical.bm25(docs, ["rowseq"], "alpha kappa").join(allowed, "rowseq", "left_semi")
        assert pairs(kept.top("alpha kappa", 5, allowed)) == pairs(ranking.top(want, 5, "rowseq"))

    same()
    for step in range(2):
        gone = [k for k in now if k % (7 + step) == 3]
        new = {**{k: v for k, v in some(5 + step, 120) if k % 11 == step}, **dict(some(20 + step, 15, first=200 * (step + 1)))}
        old = {k: v for k, v in now.items() if k in gone or k in new}
        fresh = {k: v for k, v in new.items() if k not in gone}
        store.save(Stitch("", 0, ["*"]), fulltext.renewed(store.table, frame(spark, list(old.items())), frame(spark, list(fresh.items())), part=16))
        now = {**{k: v for k, v in now.items() if k not in old}, **fresh}
        same()
    store.save(Stitch("", 0, ["*"]), fulltext.merged(store.table))
    assert store.table("fts_gone").count() == 0 and store.table("fts_sizes").first()["segs"] == 1
    same()


def test_bounds_leave_ranges_out(spark, tmp_path):
    """Ranges that can't hold a hit are not read, and hold none."""
    rows = [(i, "common " * (1 + i % 3) + "filler " * 30) for i in range(400)] + [(i, "common " * 20) for i in range(400, 410)]
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.save(Stitch("", 0, ["*"]), fulltext.built(frame(spark, rows), part=10))
    kept, read = fulltext.Kept(store.table), []
    blocks = kept._blocks
    kept._blocks = lambda terms, parts: read.extend(parts) or blocks(terms, parts)
    want = ranking.top(lexical.bm25(frame(spark, rows), ["rowseq"], "common"), 5, "rowseq")
    assert pairs(kept.top("common", 5)) == pairs(want) and len(read) < 10 and len(read) == len(set(read))
    top = {r["part"]: r["bound"] for r in kept.bounds(["common"], kept._idfs(["common"])).collect()}
    for r in kept.scores("common").collect():
        assert r["score"] <= top[r["rowseq"] // 10] + 1e-9
    kept._few = lambda: False  # the bounds stay a table
    fulltext.MOST_NAMED, most = 2, fulltext.MOST_NAMED
    try:
        assert pairs(kept.top("common filler", 300)) == pairs(ranking.top(lexical.bm25(frame(spark, rows), ["rowseq"], "common filler"), 300, "rowseq"))
    finally:
        fulltext.MOST_NAMED = most


def test_empty_index(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.save(Stitch("", 0, ["*"]), fulltext.built(frame(spark, [])))
    assert fulltext.Kept(store.table).top("alpha", 3).count() == 0
    store.save(Stitch("", 0, ["*"]), fulltext.renewed(store.table, frame(spark, []), frame(spark, [(0, "alpha"), (1, None)])))
    assert [r[0] for r in fulltext.Kept(store.table).top("alpha", 3).collect()] == [0]


def test_search_without_filters_joins_nothing(spark, tmp_path):
    """Neither vectors nor hits meet the records but for the k best."""
    records = spark.createDataFrame([(i, "p", "r", str(i), "c", "t", "{}", f"alpha {i}") for i in range(40)], "rowseq long, publisher string, repo string, id string, cid string, type string, payload string, text string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(40)], "rowseq long, vec array<double>")
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.save(Stitch("", 0, ["*"]), fulltext.built(records))
    found = search.search(records, vectors, "alpha", [0.0, 1.0], k=3, index=fulltext.Kept(store.table))
    assert found.count() == 3 and "LeftSemi" not in found._jdf.queryExecution().toString()
    gated = search.search(records, vectors, "alpha", [0.0, 1.0], k=3, allowed=records.where("rowseq < 2").select("rowseq"), index=fulltext.Kept(store.table))
    assert {r["id"] for r in gated.collect()} == {"0", "1"}
    # Vectors of what is no record take no places.
    gone = records.where("rowseq % 2 = 0")
    found = search.search(gone, vectors, "alpha", [0.0, 1.0], k=10, index=fulltext.Kept(store.table)).collect()
    assert len(found) == 10 and all(int(r["id"]) % 2 == 0 for r in found)


def test_blocks(spark):
    """Blocks of rows that lie apart are put together, and a shuffle carries no more than an array for each term and range."""
    from palimpsest.functions.text import tokens
    from palimpsest.operators import blocks

    texts = {7: "b a b", 0: "a", 5: "", 12: "a c a b", 3: None, 4: "c"}
    docs = frame(spark, list(texts.items())).repartition(3)
    found = blocks.in_order(blocks.inverted(docs.select("rowseq", tokens(docs["text"]).alias("tokens")), 4)).select("term", "part", "n", "most", "least", "packed").collect()
    assert [tuple(r)[:5] for r in found] == [("a", 0, 1, 1, 1), ("a", 1, 1, 1, 3), ("a", 3, 1, 2, 4), ("b", 1, 1, 2, 3), ("b", 3, 1, 1, 4), ("c", 1, 1, 1, 1), ("c", 3, 1, 1, 4)]
    big = blocks.in_order(blocks.inverted(docs.select("rowseq", tokens(docs["text"]).alias("tokens")), 16))
    rows = big.select("term", blocks.rows_of(16, places=True).alias("rows")).collect()
    assert {r["term"]: sorted((x["rowseq"], x["len"], x["f"], x["places"]) for x in r["rows"]) for r in rows} == {"a": [(0, 1, 1, [0]), (7, 3, 1, [1]), (12, 4, 2, [0, 2])], "b": [(7, 3, 2, [0, 2]), (12, 4, 1, [3])], "c": [(4, 1, 1, [0]), (12, 4, 1, [1])]}
