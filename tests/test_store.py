"""Snapshots as segments: what a save costs, who wins, what goes."""

import datetime
import threading

import pytest
from pyspark.sql import functions as F

from palimpsest import model
from palimpsest.operators import fulltext, lexical, log, upsert
from palimpsest.operators.numbering import numbered
from palimpsest.plans import service
from palimpsest.sources.store import Conflict, Delta, MemoryStore, SnapshotStore, Stitch, merged
from palimpsest.streaming import follow

D = "/root/testdata/sf0.001"


def rows(spark, pairs, *more):
    return spark.createDataFrame([(k, v, *more) for k, v in pairs], "k string, v int" + ", w string" * len(more))


def keys(spark, names):
    return spark.createDataFrame([(n,) for n in names], "k string")


def held(df):
    return sorted(((r["k"] or "", r["v"]) for r in df.collect()))


def size(store):
    return store.files.fs.getContentSummary(store.files.path("segments")).getLength()


def test_a_save_costs_what_changed(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    many = spark.range(200_000).select(F.col("id").cast("string").alias("k"), (F.xxhash64("id") % 1000000).cast("int").alias("v"))
    store.save(Stitch("r0", 0, ["*"]), {"t": many})
    whole = size(store)
    for n in range(3):
        before = size(store)
        store.save(Stitch(f"r{n + 1}", n + 1, ["*"]), {"t": Delta(["k"], rows(spark, [("5", n), (f"new{n}", n)]), keys(spark, [str(100 + n)]))})
        assert size(store) - before < whole / 100
    got = {r["k"]: r["v"] for r in store.table("t").where("length(k) < 4 OR k LIKE 'new%'").collect()}
    assert store.table("t").count() == 200_000 and got["5"] == 2 and got["new0"] == 0 and "101" not in got and "99" in got


def test_merging(spark):
    whole = rows(spark, [("a", 1), ("b", 1), (None, 1), ("c", 1)])
    first = Delta(["k"], rows(spark, [("a", 2), ("d", 2), (None, 2)], "x"), keys(spark, ["b", "nowhere"]))
    second = Delta(["k"], rows(spark, [("b", 3)]), keys(spark, ["a", None]))
    assert held(merged(whole, [], ["k"])) == held(whole)
    one = merged(whole, [first.rows()], ["k"])
    assert held(one) == [("", 2), ("a", 2), ("c", 1), ("d", 2)] and one.columns == ["k", "v", "w"]  # a column that came later
    assert held(merged(whole, [first.rows(), second.rows()], ["k"])) == [("b", 3), ("c", 1), ("d", 2)]
    assert held(merged(None, [first.rows()], ["k"])) == [("", 2), ("a", 2), ("d", 2)]
    both = Delta(["k"], rows(spark, [("a", 9)]), keys(spark, ["a", "c"]))  # put and deleted: the row counts
    assert held(merged(whole, [both.rows()], ["k"])) == [("", 1), ("a", 9), ("b", 1)]
    assert held(merged(whole, [Delta(["k"], gone=keys(spark, ["a"])).rows()], ["k"])) == [("", 1), ("b", 1), ("c", 1)]


def test_compaction(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.save(Stitch("r", 0, ["*"]), {"t": rows(spark, [(str(i), 0) for i in range(500)]), "other": rows(spark, [("x", 1)])})
    assert not store.compact("t") and not store.compact("none")
    for n in range(4):
        store.save(Stitch("r", n, ["*"]), {"t": Delta(["k"], rows(spark, [(str(n), n + 1)]), keys(spark, [str(400 + n)]))})
    want = held(store.table("t"))
    segments = lambda: [s["delta"] for s in store.head()[1]["tables"]["t"]["segments"]]
    assert segments() == [False, *[True] * 4] and not store.compact("t", share=99)
    assert store.compact("t", most=3, share=99) and segments() == [False, True] and held(store.table("t")) == want

    # What is saved while a compaction writes stays behind it.
    write = store._write

    def slow(df, delta):
        out = write(df, delta)
        store._write = write
        store.save(Stitch("r", 9, ["*"]), {"t": Delta(["k"], rows(spark, [("late", 9)]))})
        return out

    store._write = slow
    assert store.compact("t", share=0) and segments() == [False, True] and held(store.table("t")) == sorted([*want, ("late", 9)])
    store._write = slow_anew = lambda df, delta: (setattr(store, "_write", write), store.save(Stitch("r", 9, ["*"]), {"t": rows(spark, [("z", 1)])}), write(df, delta))[2]
    assert slow_anew and pytest.raises(Conflict, store.compact, "t", share=0) and held(store.table("t")) == [("z", 1)]
    with pytest.raises(ValueError, match="key"):
        store.save(Stitch("r", 9, ["*"]), {"t": Delta(["k"], rows(spark, [("a", 1)]))})
        store.save(Stitch("r", 9, ["*"]), {"t": Delta(["v"], rows(spark, [("a", 1)]))})


def test_vacuum(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    for n in range(3):
        store.save(Stitch("r", n, ["*"]), {"t": rows(spark, [("a", n)]), f"only{n}": rows(spark, [("b", n)])})
    old = store.table("t")
    store._write(old, False)  # of a save that never came to its end
    assert store.vacuum() == 0  # all is young
    assert store.vacuum(retain=-5) == 2 + 3 and store.vacuum(retain=-5) == 0
    assert held(store.table("t")) == [("a", 2)] and held(store.table("only0")) == [("b", 0)] and len(store.files.versions("CURRENT")) == 1


def test_two_writers(spark, tmp_path):
    a, b = (SnapshotStore(spark, str(tmp_path / "s")) for _ in range(2))
    a.save(Stitch("r0", 0, ["*"]), {"t": rows(spark, [("a", 0)])})
    seen = a.version
    b.save(Stitch("r1", 1, ["*"]), {"t": Delta(["k"], rows(spark, [("b", 1)]))}, expected=seen)
    with pytest.raises(Conflict):
        a.save(Stitch("r2", 2, ["*"]), {"t": rows(spark, [("c", 2)])}, expected=seen)
    assert a.load().root == "r1" and held(a.table("t")) == [("a", 0), ("b", 1)]
    # Many at once: each name is taken once, and no count is lost.
    def count(store):
        for _ in range(8):
            store.change_meta("n", lambda n: n + 1, 0)

    threads = [threading.Thread(target=count, args=(s,)) for s in (a, b, a, b)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert a.get_meta("n") == 32 and a.load().meta["n"] == 32
    taken, lock = [], threading.Lock()

    def put(n):
        try:
            a.files.put("once", str(n).encode())
        except FileExistsError:
            return
        with lock:
            taken.append(n)

    threads = [threading.Thread(target=put, args=(n,)) for n in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(taken) == 1 and a.files.read("once") == str(taken[0]).encode()


@pytest.mark.parametrize("kind", ["memory", "files"])
def test_meta_outlives_updates(spark, tmp_path, kind):
    """The day's quota holds although a publish moves the root and an update saves in between."""
    store = MemoryStore() if kind == "memory" else SnapshotStore(spark, str(tmp_path / "s"))
    config, day = service.Config(repos=["click"], publish_repos=["click"], publish_per_day=2), datetime.date(2024, 1, 2)
    index = service.Index(spark, records=None)
    body, grant = {"record": {"id": "x", "type": "item", "payload": {}}}, {"publisher": "0xa", "repos": ["click"]}
    put = lambda commit=None: service.publish(index, config, body, grant, service.Quota(store), commit=commit, today=day)
    entries = model.update_log(spark, D)
    put()  # before anything is saved
    for t in (3, 6):
        follow.update(entries.where(F.col("t") <= t), ["click"], store, lambda moved: None)
        assert store.get_meta("published:2024-01-02") == 1

    def fails(entry):
        raise RuntimeError("no commit")

    with pytest.raises(RuntimeError):
        put(fails)
    put()
    follow.update(entries, ["click"], store, lambda moved: None)
    with pytest.raises(service.Refused) as e:
        put()
    assert e.value.status == 429 and store.load().root == log.root(log.stitch(entries, ["click"])).first()["root"]
    store.save(Stitch("r", 1, ["other"]), {})
    assert store.get_meta("published:2024-01-02") == 2 and store.table("heads") is None


def test_update_against_another_writer(spark, tmp_path):
    """An update whose ground moved starts anew, and leaves nothing out."""
    entries, store = model.update_log(spark, D), SnapshotStore(spark, str(tmp_path / "s"))
    other, seen = SnapshotStore(spark, str(tmp_path / "s")), []

    def lens(moved):
        seen.append(moved.count())
        if len(seen) == 2:
            follow.update(entries.where("t <= 6"), ["*"], other, lambda moved: None)

    follow.update(entries.where("t <= 3"), ["*"], store, lens)
    last = follow.update(entries, ["*"], store, lens)
    assert len(seen) == 3 and last == store.load().root == log.root(log.stitch(entries, ["*"])).first()["root"]
    want = sorted(map(tuple, log.stitch(entries, ["*"]).collect()))
    assert sorted(map(tuple, store.table("heads").select(*model.REPO, "head", "pos").collect())) == want


def test_delta_is_apply_changes(spark):
    c = model.changes(spark, D)
    old = numbered(log.state_at(c, 400), model.KEY, "rowseq")
    moved = log.diff_since(c, 400, 900, old).join(log.state_at(c, 900).drop("cid"), model.KEY, "left")
    by_delta = merged(old, [upsert.delta(old, moved).rows()], model.KEY)
    want = upsert.apply_changes(old, moved)
    assert sorted(map(tuple, by_delta.select(old.columns).collect())) == sorted(map(tuple, want.select(old.columns).collect()))


def test_indexing(spark, tmp_path):
    """An update keeps records and their full text as they are in the log, and repos that are new bring their older history."""
    c, store = model.changes(spark, D), SnapshotStore(spark, str(tmp_path / "s"))
    entries = c.select("pos", F.floor(F.col("pos") / 100).cast("long").alias("t"), *model.REPO, F.sha2(F.col("pos").cast("string"), 256).alias("head"))
    early = entries.where("publisher <> 'u7'")
    follow.update(early.where("t <= 4"), ["*"], store, follow.indexing(c, store))
    assert store.table("records").where("publisher = 'u7'").count() == 0
    follow.update(entries, ["*"], store, follow.indexing(c, store))
    want = {tuple(r) for r in log.state_at(c, 10**9).select(*model.KEY, "cid").collect()}
    rows = store.table("records").collect()
    assert {(r["publisher"], r["repo"], r["id"], r["cid"]) for r in rows} == want and len({r["rowseq"] for r in rows}) == len(rows)
    kept, docs = fulltext.Kept(store.table), store.table("records").select("rowseq", "text")
    pairs = lambda df: sorted((r["rowseq"], round(r["score"], 9)) for r in df.collect())
    assert pairs(kept.scores("k 17")) == pairs(lexical.bm25(docs, ["rowseq"], "k 17")) != []


def test_diff_by_repo(spark):
    change = lambda pos, repo, id, op="put": (pos, "p", repo, id, op, None if op == "delete" else f"c{pos}", "t", "{}")
    c = spark.createDataFrame([change(1, "new", "a"), change(2, "old", "x"), change(3, "lost", "m"), change(5, "new", "b"), change(6, "old", "y"), change(7, "old", "x", "delete"), change(8, "lost", "n"), change(9, "old", "z")], "pos long, publisher string, repo string, id string, op string, cid string, type string, payload string")
    spans = spark.createDataFrame([("p", "new", None, 9), ("p", "old", 3, 8), ("p", "lost", None, 9)], "publisher string, repo string, after long, until long")
    known = spark.createDataFrame([("p", "old", "x", "c2"), ("p", "lost", "m", "c3"), ("p", "lost", "unknown", "c0"), ("p", "other", "q", "c0")], "publisher string, repo string, id string, cid string")
    got = sorted((r["repo"], r["id"], r["op"], r["cid"]) for r in log.diff_by_repo(c, spans, known).collect())
    assert got == [("lost", "n", "put", "c8"), ("lost", "unknown", "delete", None), ("new", "a", "put", "c1"), ("new", "b", "put", "c5"), ("old", "x", "delete", None), ("old", "y", "put", "c6")]
    assert log.diff_by_repo(c, spans.limit(0), known).count() == 0
