import json
import time

import pytest
from pyspark.sql import functions as F

from palimpsest import model
from palimpsest.functions import schemas
from palimpsest.operators import fold, gate, log, maintain, rules, upsert
from palimpsest.operators.numbering import numbered
from palimpsest.plans import queries
from palimpsest.sources.store import Blobs, Files, MemoryStore, RecordStore, SnapshotStore, Stitch, publish_view, read_manifest, seed, write_seed, write_view
from palimpsest.streaming import follow

D = "/root/testdata/sf0.001"


def test_gate_ids():
    rule = lambda d: gate.Rule("r", lambda x, c: True, {"p": 1}, d)
    base, types = gate.Checks({"type": "object"}), {"a": gate.Checks(rules=[rule("one")]), "b": gate.Checks()}
    ids = gate.gates_of(base, types)
    again = gate.gates_of(base, {"a": gate.Checks(rules=[rule("other words")]), "b": gate.Checks()})
    changed = gate.gates_of(base, {"a": gate.Checks(), "b": gate.Checks()})
    assert ids == again and ids.by_type["a"] != changed.by_type["a"] and ids.by_type["b"] == changed.by_type["b"]
    assert gate.gates_of(gate.Checks(), {"a": gate.Checks()}) is None


def test_check_order():
    seen = []
    rule = lambda name, says: gate.Rule(name, lambda r, c: seen.append(name) or says)
    base = gate.Checks({"type": "object", "required": ["n"]}, [rule("base", True)])
    types = {"t": gate.Checks({"properties": {"n": {"maximum": 3}}}, [rule("own", "too bad")])}
    why = lambda r: gate.reason_of(r, base, types)
    assert why({"type": "x", "payload": {}}) == "type x is not listed"
    assert why({"type": "t", "payload": {}}) == "# lacks n" and seen == []
    assert why({"type": "t", "payload": {"n": 5}}) == "#/n is too large" and seen == []
    assert why({"type": "t", "payload": {"n": 1}}) == "own: too bad" and seen == ["base", "own"]

    def fails(r, c):
        raise ValueError("boom")

    assert gate.reason_of({"type": "t", "payload": {}}, gate.Checks(rules=[gate.Rule("f", fails)]), {}) == "f: boom"


def test_recheck_of_changed_types_only(spark):
    records = spark.createDataFrame([("p", "r", "1", "c1", "game", "{}"), ("p", "r", "2", "c2", "asset", "{}")], "publisher string, repo string, id string, cid string, type string, payload string")
    verdicts = spark.createDataFrame([("p", "r", "1", "c1", "g1", None), ("p", "r", "2", "c2", "a1", None)], "publisher string, repo string, id string, cid string, checker string, reason string")
    left = gate.unchecked(records, verdicts, gate.checker_of(F.col("type"), {"game": "g1", "asset": "a2"}, "o"))
    assert [r["id"] for r in left.collect()] == ["2"]
    assert gate.allowed(records, None, F.lit("x")).count() == 2


def test_incremental_is_full_rebuild(spark):
    c = model.changes(spark, D)
    index = log.state_at(c, -1).withColumn("rowseq", F.lit(0).cast("long"))
    for a, b in ((-1, 200), (200, 450), (450, 900)):
        diff = log.diff_since(c, a, b, log.state_at(c, a)).join(log.state_at(c, b).select(*model.KEY, "type", "payload"), model.KEY, "left")
        index = upsert.apply_changes(index, diff)
    got = sorted(map(tuple, index.drop("rowseq").select(*model.KEY, "cid").collect()))
    assert got == sorted(map(tuple, log.state_at(c, 900).select(*model.KEY, "cid").collect()))
    again = upsert.apply_changes(index, diff)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, index.collect()))


def test_upsert_keeps_rowseq(spark):
    old = spark.createDataFrame([(0, "p", "r", "a", "1"), (1, "p", "r", "b", "1")], "rowseq long, publisher string, repo string, id string, cid string")
    new = spark.createDataFrame([("p", "r", "a", "2"), ("p", "r", "c", "1")], "publisher string, repo string, id string, cid string")
    assert sorted((r["rowseq"], r["id"], r["cid"]) for r in upsert.upsert(old, new).collect()) == [(0, "a", "2"), (1, "b", "1"), (2, "c", "1")]


def test_update_steps(spark, tmp_path):
    entries = model.update_log(spark, D)
    store, seen = SnapshotStore(spark, str(tmp_path / "index"), "e1"), []

    def lens(moved):
        seen.append(moved.count())

    early = entries.where("t <= 4")
    first = follow.update(early, ["click"], store, lens)
    assert follow.update(early, ["click"], store, lens) == first and len(seen) == 1  # nothing moved, so nothing was saved
    others = early.unionByName(early.limit(1).withColumn("repo", F.lit("elsewhere")).withColumn("t", F.lit(5).cast("long")))
    assert follow.update(others, ["click"], store, lens) == first and len(seen) == 1
    last = follow.update(entries, ["click"], store, lens)
    assert last != first and len(seen) == 2
    assert last == log.root(log.stitch(entries, ["click"])).first()["root"]  # a replica with the same log agrees
    assert store.load(["view"]) is None and store.load(["click"]).root == last
    with pytest.raises(ValueError, match="embedder"):
        SnapshotStore(spark, str(tmp_path / "index"), "e2")


def test_failed_save_leaves_the_old_state(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.save(Stitch("r1", 1, ["*"]), {"records": spark.range(3)})

    def boom(parts):
        raise RuntimeError("no embedding")

    with pytest.raises(Exception, match="no embedding"):
        store.save(Stitch("r2", 2, ["*"]), {"records": spark.range(5), "bad": spark.range(2).mapInPandas(boom, "id long")})
    assert store.load().root == "r1" and store.table("records").count() == 3


def test_memory_store_view_blobs(spark, tmp_path):
    memory = MemoryStore()
    assert memory.load() is None
    memory.save(Stitch("r", 1, ["a"]), {})
    assert memory.load(["a"]).root == "r" and memory.load(["b"]) is None
    records = model.records(spark, D)
    manifest = write_view(records, Stitch("r1", 1, ["*"]), str(tmp_path / "view"))
    assert manifest["records"] == records.count()
    assert seed(records).where("vec IS NOT NULL").count() == 0
    blobs = Blobs(spark, str(tmp_path / "blobs"))
    cid = blobs.put(b"\x00\xffabc")
    assert blobs.get(cid) == b"\x00\xffabc" and blobs.put(b"\x00\xffabc") == cid and blobs.get("0" * 64) is None


def test_pointer_survives_a_crash(spark, tmp_path, monkeypatch):
    """Whatever step of replacing the pointer fails, the state before is there, and the next save works."""
    store = SnapshotStore(spark, str(tmp_path / "s"))
    store.save(Stitch("r1", 1, ["*"]), {"records": spark.range(3), "verdicts": spark.range(7)})
    for whose, step in ((Files, "put"), (Files, "_write"), (SnapshotStore, "_write"), (SnapshotStore, "_commit")):
        def crash(*_):
            raise OSError("lost")

        with monkeypatch.context() as m:
            m.setattr(whose, step, crash)
            with pytest.raises(OSError):
                store.save(Stitch("r2", 2, ["*"]), {"records": spark.range(5)})
        assert store.load().root == "r1" and store.table("records").count() == 3
    store.save(Stitch("r2", 2, ["*"]), {"records": spark.range(5)})
    assert store.load().root == "r2" and store.table("records").count() == 5 and store.table("verdicts").count() == 7  # tables that aren't given stay
    store.set_meta("checked", 9)
    assert store.get_meta("checked") == 9 and store.get_meta("none", 0) == 0 and store.table("records").count() == 5
    store.save(Stitch("r3", 3, ["other"]), {"records": spark.range(1)})
    assert store.table("verdicts") is None  # other patterns: started over
    with pytest.raises(OSError):
        store.files.put("CURRENT.000000000000", b"x")
        store.files.put("CURRENT.000000000000", b"y")


def test_other_stores(spark, tmp_path):
    held = {}
    store = RecordStore(lambda: held.get("stitch"), lambda r: held.update({r["id"]: r["payload"]}))
    assert store.load() is None
    store.save(Stitch("r", 4, ["a"]), {})
    assert store.load(["a"]).t == 4 and store.load(["b"]) is None
    one = SnapshotStore(spark, str(tmp_path / "a"), "e1")
    one.save(Stitch("r", 1, ["*"]), {"records": model.records(spark, D).limit(5).withColumn("vec", F.array(F.lit(1.0))), "heads": spark.range(1)})
    two = write_seed(one, str(tmp_path / "b"))
    assert two.table("records").where("vec IS NULL").count() == 5 and two.load().embedder is None and two.load().root == "r"
    manifest = write_view(model.records(spark, D).limit(3), Stitch("r1", 1, ["*"]), str(tmp_path / "v"), refused=spark.range(2))
    landed = {}
    assert publish_view(manifest, lambda r: landed.update({r["id"]: r}), landed.get)["payload"]["records"] == 3 and read_manifest(spark, str(tmp_path / "v")) == manifest
    with pytest.raises(OSError):
        publish_view(manifest, lambda r: None, lambda i: None)
    blobs = Blobs(spark, str(tmp_path / "blobs"))
    cid = blobs.put(b"abc")
    assert [tuple(r) for r in blobs.table().collect()] == [(cid, 3, bytearray(b"abc"))]


def test_checks_of_bad_payloads_and_files(spark):
    seen = "publisher string, repo string, id string, cid string, type string, payload string"
    rows = [("p", "r", "1", "c", "t", None), ("p", "r", "2", "c", "t", "{no"), ("p", "r", "3", "c", "t", '{"src": "f1"}'), ("p", "r", "4", "c", "t", '{"src": "gone"}'), ("p", "r", "5", "c", "t", "{}"), ("p", "r", "6", "c", "t", '{"src": "big"}')]
    records = spark.createDataFrame(rows, seen)
    none = records.where("false").select("publisher", "repo", "id", "cid", F.lit("k").alias("checker"), F.lit("").alias("reason"))
    files = spark.createDataFrame([("f1", b"abc"), ("big", b"x" * (gate.MAX_FILE + 5))], "cid string, content binary")
    base = gate.Checks(rules=[gate.Rule("own", lambda r, c: True if c["publisher"] == "p" and c["repo"] == "r" and r["cid"] == "c" and r["id"] in "3456" and c["file"] in (None, b"abc") else f"bad {c['file']}")])
    got = {r["id"]: r["reason"] for r in gate.check_missing(records, none, F.lit("k"), base, {}, files=files).collect()}
    assert got == {"1": "its payload is not JSON", "2": "its payload is not JSON", "3": None, "5": None, "6": "its file is over 25 MB"}  # 4 waits for its file
    assert gate.check_missing(records, none, F.lit("k"), gate.Checks(), {}, most=2, seed=1).count() == 2
    late = gate.Checks({"required": ["x"]}, base.rules)
    assert {r["reason"] for r in gate.check_missing(records.where("id = '4'"), none, F.lit("k"), late, {}, files=files).collect()} == {"# lacks x"}  # files only behind schemas
    verdicts = gate.with_verdicts(none, gate.check_missing(records, none, F.lit("k"), base, {}, files=files))
    assert gate.allows(records, verdicts, F.lit("k"), "P", "r", "3", "c") and not gate.allows(records, verdicts, F.lit("k"), "p", "r", "1", "c") and gate.allows(records, None, None, "p", "r", "1", "c")
    assert [r["id"] for r in gate.refused(records, verdicts, F.lit("k")).collect()] == ["1", "2", "6"]
    assert upsert.delete_verdicts(verdicts, records.where("id = '1'")).count() == verdicts.count() - 1


def test_schemas_as_columns(spark):
    """Column expressions and the check of one value tell the same errors, in the same order."""
    schema = {
        "type": "object", "required": ["n", "s"], "additionalProperties": False,
        "properties": {"s": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^[a-zé]+$"}, "n": {"type": ["integer", "null"], "minimum": 1, "maximum": 9}, "e": {"enum": ["x", 1, None, True]}, "c": {"const": 2.5}, "a.b": {"type": "boolean"},
                       "l": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "object", "required": ["k"], "properties": {"k": {"type": "number"}}}}},
    }
    values = [{}, {"n": 1, "s": "ab"}, {"n": 0, "s": "a"}, {"n": 10, "s": "abcde"}, {"n": 2.5, "s": "AB"}, {"n": 2.0, "s": "éé"}, {"n": None, "s": 5}, {"n": True, "s": "ab", "z": 1, "y": 2}, {"n": 1, "s": "ab", "e": 1}, {"n": 1, "s": "ab", "e": 2}, {"n": 1, "s": "ab", "e": None},
              {"n": 1, "s": "ab", "e": False}, {"n": 1, "s": "ab", "c": 2.5}, {"n": 1, "s": "ab", "c": "2.5"}, {"n": 1, "s": "ab", "a.b": 0}, {"n": 1, "s": "ab", "l": []}, {"n": 1, "s": "ab", "l": [{"k": 1}, {}, {"k": "x"}]}, {"n": 1, "s": "ab", "l": {"k": 1}}, [1], "text", None, 3]
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, payload string")
    got = {r["i"]: r["e"] for r in df.select("i", schemas.errors_of(schema, schemas.parsed(F.col("payload"))).alias("e")).collect()}
    for i, v in enumerate(values):
        if v != {"n": 1, "s": "ab", "e": False}:  # in Python False is 0; here it is no number
            assert got[i] == gate.mismatches(schema, v), v
    assert not schemas.expressible({"properties": {"a": {"items": {"enum": [[1]]}}}}) and schemas.expressible(schema)
    assert spark.createDataFrame([("{no",)], "p string").where(schemas.parsed(F.col("p")).isNull()).count() == 1


def test_files_only_for_rules(spark, tmp_path):
    """No file of a refused record is read, nor of one without rules; where nothing needs Python, none runs."""
    rows = [("p", "r", str(i), "c", t, payload) for i, (t, payload) in enumerate([("a", '{"src": "f0"}'), ("a", '{"src": "f1", "n": 1}'), ("b", '{"src": "f2", "n": 1}'), ("z", '{"src": "f3", "n": 1}'), ("a", "no"), ("a", '{"n": 2}'), ("a", '{"src": "gone", "n": 1}')])]
    records = spark.createDataFrame(rows, "publisher string, repo string, id string, cid string, type string, payload string")
    none = records.where("false").select("publisher", "repo", "id", "cid", F.lit("k").alias("checker"), F.lit("").alias("reason"))

    def fetch(name):
        (tmp_path / name).write_text("read")
        return None if name == "gone" else name.encode()

    base, types = gate.Checks({"required": ["n"]}), {"a": gate.Checks(rules=[gate.Rule("own", lambda r, c: c["file"] in (None, b"f1") or "bad file")]), "b": gate.Checks({"properties": {"n": {"maximum": 5}}})}
    got = {r["id"]: r["reason"] for r in gate.check_missing(records, none, F.lit("k"), base, types, files=fetch).collect()}
    assert got == {"0": "# lacks n", "1": None, "2": None, "3": "type z is not listed", "4": "its payload is not JSON", "5": None}  # 6 waits for its file
    assert sorted(p.name for p in tmp_path.iterdir()) == ["f1", "gone"]
    plain = gate.check_missing(records, none, F.lit("k"), base, {"a": gate.Checks(), "b": types["b"]})
    assert "Python" not in plain._jdf.queryExecution().toString() and plain.count() == 7
    odd = gate.check_missing(records, none, F.lit("k"), gate.Checks({"properties": {"n": {"enum": [[1], 1]}}, "required": ["n"]}), {})  # has no expression
    assert {r["id"]: r["reason"] for r in odd.collect()} == {**dict.fromkeys("1236"), "0": "# lacks n", "4": "its payload is not JSON", "5": "#/n is not one of the listed values"}


def test_rule_forms(spark):
    cid = "a" * 64
    config = {"schema": "b" * 64, "rules": {"check": "0xp/checks/size", "with": {"most": 3}}, "types": {"t": {"description": "things", "rules": [cid, {"check": "0xp/checks/size", "with": {"most": 3}}]}, "u": "words"}}
    check = {"cid": "v1", "type": "check", "payload": {"src": "c" * 64, "params": {"type": "object", "required": ["most"]}}}
    content = {"b" * 64: {"type": "object"}, "c" * 64: "code", cid: "more"}
    asked = []
    records = spark.createDataFrame([("0xP", "checks", "size", "v1", "check", json.dumps(check["payload"])), ("0xp", "checks", "other", "v2", "check", "{}")], "publisher string, repo string, id string, cid string, type string, payload string")
    out, sources = rules.resolve(config, content.__getitem__, lambda names: asked.append(names) or rules.published(records, names))
    assert asked == [[("0xp", "checks", "size")]]  # all at once
    assert out["schema"] == {"type": "object"} and out["rules"] == [{"check": "0xp/checks/size", "record": "v1", "src": "c" * 64, "with": {"most": 3}}]
    assert rules.sources_in(out) == ["c" * 64, cid] and sources == {"c" * 64: "code", cid: "more"} and out["types"]["u"] == "words"
    assert [rules.description(t) for t in config["types"].values()] == ["things", "words"] and rules.sources_in(config) == [cid]
    base, types = rules.checks_of(out, {"c" * 64: lambda r, c: len(r["payload"]) <= c["params"]["most"] or "too many", cid: lambda r, c: True})
    assert gate.reason_of({"type": "t", "payload": {}}, base, types) is None and gate.reason_of({"type": "t", "payload": dict.fromkeys("abcd")}, base, types) == "0xp/checks/size: too many"
    for bad, error in (({"rules": "0xp/checks/none"}, LookupError), ({"rules": 7}, ValueError), ({"schema": "x"}, ValueError), ({"rules": {"check": "0xp/checks/size"}}, ValueError)):
        with pytest.raises(error):
            rules.resolve(bad, content.__getitem__, lambda names: {n: check for n in names if n[2] == "size"})
    with pytest.raises(ValueError, match="grants"):
        rules.resolve({"rules": "0xp/c/n"}, content.__getitem__, lambda names: {n: {**check, "payload": {"src": "s", "needs": "network"}} for n in names})
    for bad in (config, {"rules": [cid]}):
        with pytest.raises((ValueError, LookupError)):
            rules.checks_of(bad, {})


def test_numbers_without_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("n"))
    got = numbered(df.repartition(7), ["k"], "i", 5).collect()
    assert sorted((r["k"], r["i"]) for r in got) == [(k, k + 5) for k in range(1000)] and numbered(df.limit(0), ["k"], "i").count() == 0


def test_reducers():
    event = lambda pos, who, puts=(), deletes=(): {"pos": pos, "publisher": who, "puts": [{"id": i, "payload": json.dumps(p)} for i, p in puts], "deletes": list(deletes)}
    state = None
    for e in (event(0, "a"), event(1, "a", [("x", {"slot": "x"})]), event(2, "b", [("x", {"slot": "x"})]), event(3, "b", [("y", {"slot": "y"})]), event(4, "c", [("1", {"slot": "z"}), ("2", {"slot": "w"})])):
        state = fold.claims(state, e)
    assert state == {"owner": {"x": "a", "y": "b"}, "rejected": 3, "commits": 5}


def test_reducers_beside_each_other(spark):
    """Two rules over one pass: by the strict one a record can't be put again, by the other it can."""

    def strict(state, event):
        taken = state.get("ids", [])
        return {"ids": taken if event["op"] == "delete" or event["id"] in taken else sorted([*taken, event["id"]])}

    def loose(state, event):
        left = [i for i in state.get("ids", []) if i != event["id"]]
        return {"ids": left if event["op"] == "delete" else sorted([*left, event["id"]])}

    c = model.changes(spark, D).select("publisher", "pos", "id", "op")
    found = fold.fold_several(c, ["publisher"], {"strict": strict, "loose": loose}).collect()
    assert len(found) == c.select("publisher").distinct().count()
    for r in found:
        for name, reduce in (("strict", strict), ("loose", loose)):
            alone = {}
            for e in c.where(F.col("publisher") == r["publisher"]).orderBy("pos").collect() if r["publisher"] in ("u1", "u7") else ():
                alone = reduce(alone, e.asDict())
            assert not alone or json.loads(r[name]) == alone
    live = log.state_at(model.changes(spark, D), 10**9).groupBy("publisher").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    want = {r["publisher"]: r["ids"] for r in live.collect()}
    assert {r["publisher"]: json.loads(r["loose"])["ids"] for r in found if json.loads(r["loose"])["ids"]} == want
    assert fold.state_hash(found[0]["loose"]) == fold.state_hash(found[0]["loose"])


def test_live_reads_and_verified_stitches(spark):
    c, entries = model.changes(spark, D), model.update_log(spark, D)
    want = {(r["publisher"], r["id"]): r["cid"] for r in log.state_at(c, 10**9).collect()}
    who, id = next(iter(want))
    assert log.read_record(c, who.upper(), "events", id).first()["cid"] == want[(who, id)] and log.read_record(c, who, "events", "none").count() == 0
    assert log.list_repo(c, who, "events").count() == sum(p == who for p, _ in want)
    root = log.root(log.stitch(entries, ["click"], 5)).first()["root"]
    assert log.verify(entries, ["click"], root, 5) and not log.verify(entries, ["click"], root, 6) and not log.verify(entries.where("pos <> 10"), ["*"], root, 5)
    both = fold.commits(entries, c.limit(0))
    assert both.where("size(puts) = 0 AND size(deletes) = 0").count() == entries.count()


def test_fold_orders_and_resumes(spark):
    rows = spark.createDataFrame([(1, 1, "alice", "x"), (2, 2, "bob", "x"), (3, 3, "bob", "y")], "pos long, t long, publisher string, slot string").withColumn("repo", F.lit("r"))

    def claim(state, event):
        state = {**state, "n": state.get("n", 0) + 1}
        state.setdefault(event["slot"], event["publisher"])
        return state

    every = fold.fold_all(fold.events(rows, ["*"]), claim, {})
    assert every == {"n": 3, "x": "alice", "y": "bob"}
    part = fold.fold_all(fold.events(rows, ["*"], last=2), claim, {})
    assert fold.fold_all(fold.events(rows, ["*"], first=3), claim, part) == every


def test_streams(spark, tmp_path):
    entries = model.update_log(spark, D).select("pos", "t", "ts", "publisher", "repo", "head").withColumn("ts", F.col("ts").cast("timestamp"))
    entries.repartition(4).write.parquet(str(tmp_path / "log"))
    schema, got = entries.schema.simpleString()[7:-1].replace(":", " "), []
    q = follow.follow(spark, str(tmp_path / "log"), schema, ["click"], lambda df, i: got.append(df.count()), str(tmp_path / "c1"), 2)
    assert q.awaitTermination(120) and sum(got) == entries.where("repo = 'click'").count()

    # What comes while a batch runs waits for the next, together.
    (tmp_path / "grows").mkdir()
    batches = []
    q = follow.follow(spark, str(tmp_path / "grows"), schema, ["*"], lambda df, i: batches.append(df.count()), str(tmp_path / "c3"), every="1 second")
    try:
        for _ in range(4):
            entries.limit(10).write.mode("append").parquet(str(tmp_path / "grows"))
        q.processAllAvailable()
    finally:
        q.stop()
    assert sum(batches) == 40 and len(batches) <= 4


def test_streaming_fold(spark, tmp_path):
    """Events that come late are put in order as far as they are held back, and never dropped in silence."""
    order = lambda s, e: {"seen": [*s.get("seen", []), e["pos"]]}
    (tmp_path / "in").mkdir()

    def run(name, parts, **how):
        folder = tmp_path / name
        folder.mkdir()
        stream = spark.readStream.schema("k string, pos long").option("maxFilesPerTrigger", 1).json(str(folder))
        rows = []
        for i, part in enumerate(parts):
            (folder / f"{i}.json").write_text("\n".join(json.dumps({"k": "a", "pos": p}) for p in part))
            folded = follow.streaming_fold(stream, "k", order, **how)
            q = folded.writeStream.foreachBatch(lambda df, i: rows.extend(df.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / f"c-{name}")).trigger(availableNow=True).start()
            q.awaitTermination(120)
        return json.loads(rows[-1]["state"])["seen"]

    assert run("late", [[1, 2, 5], [3, 4, 9], [20]], hold=5) == [1, 2, 3, 4, 5, 9]
    assert run("again", [[1, 2], [2, 3]], repeats=True) == [1, 2, 3]
    with pytest.raises(Exception, match="came after"):
        run("lost", [[1, 5], [3]])


def test_streaming_fold_of_quiet_keys(spark, tmp_path):
    """Keys that go quiet are flushed, and a reducer sees timestamps as such whether their events waited or not."""
    (tmp_path / "in").mkdir()

    def kinds(state, event):
        return {"pos": [*state.get("pos", []), event["pos"]], "kinds": sorted({*state.get("kinds", []), type(event["ts"]).__name__, type(event["n"]).__name__}), "last": str(event["ts"])}

    said = [("a", 1, "2024-01-01T00:00:01", 1), ("b", 2, "2024-01-01T00:00:02", None), ("a", 9, "2024-01-01T00:00:09", 2), ("a", 4, "2024-01-01T00:00:04", 3), ("b", 3, None, 4)]
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps({"k": k, "pos": p, "ts": t, "n": n}) for k, p, t, n in said))
    stream = spark.readStream.schema("k string, pos long, ts timestamp, n int").json(str(tmp_path / "in"))
    folded = follow.streaming_fold(stream, "k", kinds, hold=5, quiet=500)
    last = {r["k"]: (r["pos"], json.loads(r["state"])) for r in follow.drained(folded, "k", str(tmp_path / "out"), str(tmp_path / "c")).collect()}
    assert last["a"][0] == 9 and last["a"][1]["pos"] == [1, 4, 9] and last["a"][1]["kinds"] == ["datetime", "int"] and last["a"][1]["last"] == "2024-01-01 00:00:09"
    assert last["b"][1]["pos"] == [2, 3] and set(last["b"][1]["kinds"]) == {"NoneType", "datetime", "int"}


def test_drained_waits_for_a_long_batch(spark, tmp_path):
    """A batch that takes longer than events may wait idle is waited for: nothing is given in part."""

    def slow(state, event):
        time.sleep(0.2)
        return {"n": state.get("n", 0) + 1}

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "0.json").write_text("\n".join(json.dumps({"k": "a", "pos": p}) for p in range(40)))
    folded = follow.streaming_fold(spark.readStream.schema("k string, pos long").json(str(tmp_path / "in")), "k", slow, hold=5, quiet=500)
    last = follow.drained(folded, "k", str(tmp_path / "out"), str(tmp_path / "c"), seconds=3).collect()
    assert [(r["k"], r["pos"], json.loads(r["state"])) for r in last] == [("a", 39, {"n": 40})]


def test_streaming_fold_of_a_folder(spark, tmp_path):
    """A table that is a folder of files is streamed whole."""
    events = spark.read.parquet(f"{D}/events.parquet").where("user_id < 5")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    got, want = (sorted(tuple(r) for r in queries.QUERIES[q](spark, str(tmp_path)).collect()) for q in ("fold_stream", "fold_state"))
    assert got == want and len(got) == events.select("user_id").distinct().count()


def test_cards_and_vectors(spark):
    repos = spark.createDataFrame([("0xab", "field-notes", "h1", None, None, "field notes", [1.0], True), ("0xab", "b", "h2", None, None, "b", [2.0], True)], "publisher string, repo string, head string, card_url string, card string, text string, vec array<float>, stale boolean").withColumn("updated", F.current_timestamp())
    fetched = spark.createDataFrame([("0xab", "field-notes", "h1", "u", None), ("0xab", "b", "old", "u", "{}")], "publisher string, repo string, head string, card_url string, card string")
    rows = {r["repo"]: r for r in maintain.cards_apply(repos, fetched, maintain.Network("u:x", "eip155:1", "0xR")).collect()}
    assert not rows["field-notes"]["stale"] and rows["field-notes"]["vec"] == [1.0]  # the same text keeps its vector
    assert rows["b"]["stale"]  # fetched for another head
    records = spark.createDataFrame([(i, f"text {i}") for i in range(5)], "rowseq long, text string")
    vectors = spark.createDataFrame([(1, [1.0])], "rowseq long, vec array<float>")
    assert sorted(r["rowseq"] for r in maintain.embed_missing(records, vectors, maintain.HashedWords(8), 2).collect()) == [0, 1, 2]


def test_cards_bind(spark):
    """A card speaks for a repo if the first extension of the network's uri names it, its publisher, the chain and the registry."""
    network = maintain.Network("u:x", "eip155:1", "0xR")
    card = lambda **o: json.dumps({"name": "n", "description": 5, "capabilities": {"extensions": [{"uri": "u:other", "params": {}}, {"uri": o.pop("uri", "u:x"), "params": {"publisher": "0xAB", "repo": "r", "chainId": "eip155:1", "dataRegistry": "0xr", **o}}]}})
    cards = [card(), card(publisher="0xac"), card(repo="R"), card(chainId="eip155:2"), card(dataRegistry="0x"), card(uri="u:y"), "{", None, card(more="x" * 70_000), "[]"]
    df = spark.createDataFrame([(i, c, "0xab", "r") for i, c in enumerate(cards)], "i int, card string, publisher string, repo string")
    assert [r["i"] for r in df.where(maintain.card_binds(F.col("card"), F.col("publisher"), F.col("repo"), network)).collect()] == [0]
    records = spark.createDataFrame([("p", "r", "@card", '{"url": "https://x"}'), ("p", "s", "@card", '{"url": "ftp://x"}'), ("p", "t", "x", '{"url": "https://x"}')], "publisher string, repo string, id string, payload string")
    assert [tuple(r) for r in maintain.card_urls(records).collect()] == [("p", "r", "https://x")]


def test_pattern_tables(spark):
    """A table of patterns names what a list of them does, and what says how it begins says it truly."""
    repos = [("0xAB", "click"), ("0xab", "view"), ("p", "click"), ("abc", "x"), ("abd", "x"), ("q", "ab/c")]
    log_ = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(repos * 2)], "pos long, publisher string, repo string")
    for patterns in (["0xAb/click"], ["click", "x"], ["*"], ["/^ab/"], ["/^abc*/"], ["/^abc?d/"], ["/^abc|^p/"], ["/^ab(c|d)/"], ["/^abc{0}d/"], ["/iew$/"], ["/^(abc|p)/", "q/ab/c"], [], ["/^0xab\\/v/", "P/click"]):
        table = spark.createDataFrame([(p,) for p in patterns], "pattern string")
        got = sorted(r["pos"] for r in log.by_patterns(log_, table).collect())
        assert got == sorted(r["pos"] for r in log_.where(log.matches(patterns)).collect()), patterns
        names = log.repo_names(patterns)
        if patterns:
            assert sorted(r["repo"] for r in log.names_in(table).collect()) == sorted(names or [])


def test_patterns():
    assert log.repo_names(["a/x", "y", "b/x"]) == ["x", "y"] and log.repo_names(["*"]) is None and log.repo_names(["/r/"]) is None
    assert log.patterns_of(["a/b"], ["p"], ["r"]) == ["a/b"] and log.patterns_of(None, ["p", "q"], ["r"]) == ["p/r", "q/r"] and log.patterns_of(repos=["r"]) == ["r"]


def test_delta_reads_changes_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def tick(parts):
        for part in parts:
            seen.add(len(part))
            yield part

    schema = "publisher string, repo string, id string, op string, cid string"
    changes = spark.createDataFrame([("p", "r", "a", "put", "2"), ("p", "r", "b", "delete", None), ("p", "r", "c", "put", "1")], schema).mapInPandas(tick, schema)
    records = spark.createDataFrame([(0, "p", "r", "a", "1"), (1, "p", "r", "b", "1")], "rowseq long, publisher string, repo string, id string, cid string")
    rows = {(r["id"], r["rowseq"], r["cid"], r["__gone"]) for r in upsert.delta(records, changes).rows().collect()}
    assert rows == {("a", 0, "2", False), ("c", 2, "1", False), ("b", None, None, True)} and seen.value == 3
