import dataclasses
import json

import pytest
from pyspark.sql import functions as F

from palimpsest import model
from palimpsest.operators import fulltext, gate, maintain
from palimpsest.operators.maintain import HashedWords
from palimpsest.plans import service as s
from palimpsest.sources.store import Blobs, MemoryStore, SnapshotStore, Stitch

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    blobs = Blobs(spark, str(tmp_path_factory.mktemp("blobs")))
    src = blobs.put(b'{"a": 1}')
    rows = [(0, "0xa", "shop", "t", "c0", "item", json.dumps({"name": "oak table", "src": src}), "name: oak table"), (1, "0xa", "shop", "l", "c1", "item", "{}", "name: lamp"), (2, "0xb", "shop", "t", "c2", "rug", "{}", "name: rug")]
    records = spark.createDataFrame(rows, "rowseq long, publisher string, repo string, id string, cid string, type string, payload string, text string")
    verdicts = spark.createDataFrame([("0xa", "shop", "t", "c0", "k", None), ("0xb", "shop", "t", "c2", "k", "bad")], "publisher string, repo string, id string, cid string, checker string, reason string")
    return s.Index(spark, records, None, verdicts, F.lit("k"), HashedWords(8), blobs)


def test_tools(index):
    tools = s.tools_of([s.Tool("get", "mine", lambda i, a: 7)], ["item"])
    ask = lambda method, **p: s.dispatch(index, {"id": 1, "method": method, "params": p}, tools)
    assert s.dispatch(index, {"method": "initialized"}, tools) is None and ask("ping")["result"] == {}
    assert ask("nope")["error"]["code"] == -32601
    assert [t["name"] for t in ask("tools/list")["result"]["tools"]] == ["search", "repos", "get"]
    assert list(s.tools_of(config=s.Config(publish_repos=["a"], types=["item"]))) == ["search", "repos", "get", "publish"] and list(s.tools_of(config=s.Config(index="repos"))) == ["find", "repo", "read"]
    assert s.tools_of(config=s.Config(types=["item"]))["search"].schema["properties"]["type"]["enum"] == ["item"]
    assert s.dispatch(index, {"id": 1, "method": "initialize"}, tools, "mine", "read me")["result"]["instructions"] == "read me"
    with pytest.raises(ValueError):
        s.LOCAL[0].run(index, {"query": "x", "k": 51})
    assert json.loads(ask("tools/call", name="get")["result"]["content"][0]["text"]) == 7
    assert ask("tools/call", name="none")["result"]["isError"]
    found = json.loads(ask("tools/call", name="search", arguments={"query": "table lamp", "mode": "lexical"})["result"]["content"][0]["text"])
    assert [r["id"] for r in found] == ["t"] and found[0]["payload"]["name"] == "oak table"  # the lamp is not let in yet
    assert s.tool_get(index, {"publisher": "0xA", "repo": "shop", "id": "t"})["file"] == {"a": 1}
    assert s.tool_get(index, {"publisher": "0xb", "repo": "shop", "id": "t"}) is None
    assert s.tool_repos(index, {}) == [{"publisher": "0xa", "repo": "shop", "records": 1}]


def test_publish_ladder(index, spark):
    config = s.Config(repos=["shop"], publishers=["0xA"], types=["item"], publish_repos=["shop", "other"], publish_per_day=2)
    def quota(n):
        store = MemoryStore()
        store.save(Stitch("r", 1, []), {})
        store.set_meta("published:2024-01-01", n)
        return s.Quota(store)

    none, full = quota(1), quota(2)
    good, grant, day = {"repo": "shop", "record": {"id": "x", "type": "item", "payload": {"ref": {"id": "l"}, "refs": [{"id": "t", "publisher": "0xB"}]}}, "pin": ["ref", "refs", "absent"]}, {"publisher": "0xA", "repos": ["shop"]}, __import__("datetime").date(2024, 1, 1)

    def status(body, grant=grant, published=none, config=config, **o):
        try:
            s.publish(index, config, body, grant, published, today=day, **o)
        except s.Refused as e:
            return e.status
        return 200

    assert status({"record": {"id": "x"}}) == 404  # two repos are open: which one?
    assert status(good, config=s.Config(repos=["shop"])) == 404 and status({**good, "repo": "none"}) == 404
    assert status({}) == status({"repo": "shop", "record": {"id": "x"}}) == status({**good, "record": {**good["record"], "type": "z"}}) == status({**good, "pin": "ref"}) == status({**good, "file": {}}) == 400
    assert status(good, None) == 401 and status({**good, "repo": "other"}) == 403 and status(good, {**grant, "publisher": "0xc"}) == 403
    assert status(good, published=full) == 429
    assert status({**good, "record": {**good["record"], "payload": {"ref": {"id": "gone"}}}}) == 400
    assert status(good, base=gate.Checks({"required": ["must"]})) == 422
    kept = []
    entry = s.publish(index, config, {**good, "file": {"json": [1]}}, grant, none, commit=kept.append, today=day)
    assert kept == [entry] and entry["payload"]["ref"] == {"publisher": "0xa", "repo": "shop", "id": "l", "cid": "c1", "type": "item"}
    assert entry["payload"]["refs"][0]["cid"] == "c2" and index.blobs.get(entry["payload"]["src"]) == b"[1]"


def test_quota_is_shared_and_counted(index, spark):
    config = s.Config(repos=["shop"], publish_repos=["shop"], publish_per_day=2)
    store, day = MemoryStore(), __import__("datetime").date(2024, 1, 2)
    store.save(Stitch("r", 1, []), {})
    quota, body = s.Quota(store), {"record": {"id": "x", "type": "item", "payload": {}}}
    send = lambda who, **o: s.publish(index, config, body, {"publisher": who, "repos": ["shop"]}, quota, today=day, **o)

    def fails(entry):
        raise OSError("did not land")

    with pytest.raises(OSError):
        send("0xa", commit=fails)
    assert quota.used("2024-01-02") == 0  # only what is committed counts
    send("0xa"), send("0xb")
    with pytest.raises(s.Refused) as e:
        send("0xc")
    assert e.value.status == 429 and quota.used("2024-01-02") == 2


def test_repo_tools_and_live_reads(index, spark):
    changes = spark.createDataFrame([(1, "0xa", "shop", "t", "put", "c0", "item", "{}"), (2, "0xa", "shop", "n", "put", "c9", "item", '{"a": 1}'), (3, "0xa", "shop", "t", "put", "c1", "item", "{}")], "pos long, publisher string, repo string, id string, op string, cid string, type string, payload string")
    repos = spark.createDataFrame([("0xa", "shop", "h1", "2024-01-02", "u", '{"name": "Shop", "x": 1}', [1.0, 0.0]), ("0xb", "blog", "h2", "2024-01-03", None, None, None)], "publisher string, repo string, head string, updated string, card_url string, card string, vec array<double>")
    live = dataclasses.replace(index, changes=changes, repos=repos, embedder=type("E", (), {"query": lambda self, q: [1.0, 0.1]})())
    assert s.tool_get(live, {"publisher": "0xa", "repo": "shop", "id": "t"}) is None  # the newest version has no verdict
    assert s.tool_read(live, {"publisher": "0xA", "repo": "shop", "id": "n"})["payload"] == {"a": 1} and s.tool_read(live, {"publisher": "0xa", "repo": "shop"})["total"] == 2
    with pytest.raises(LookupError):
        s.tool_read(live, {"publisher": "0xa", "repo": "shop", "id": "zzz"})
    assert [r["repo"] for r in s.tool_find(live, {})] == ["blog", "shop"] and [r["name"] for r in s.tool_find(live, {"query": "x"})] == ["Shop"] and len(s.tool_find(live, {"publisher": "0xB"})) == 1
    assert s.tool_repo(live, {"publisher": "0xA", "repo": "shop"})["card"] == {"name": "Shop", "x": 1}
    with pytest.raises(LookupError):
        s.tool_repo(live, {"publisher": "0xa", "repo": "none"})
    mine = s.pinned(live, {"ref": {"id": "t"}}, ["ref"], "0xA", "shop")
    assert mine["ref"]["cid"] == "c1"
    with pytest.raises(s.Refused):
        s.pinned(live, {"ref": {"id": "t"}}, ["ref"], "0xb", "shop")  # another's record of this name is not meant


def test_update_pipeline(spark):
    log = spark.createDataFrame([(1, 1, "0xa", "shop", "h1"), (2, 2, "0xa", "other", "h2")], "pos long, t long, publisher string, repo string, head string")
    store, done = MemoryStore(), []
    config = s.Config(repos=["shop"])

    def stitch():
        store.save(Stitch("root", 2, ["shop"]), {})
        return "root"

    store.save(Stitch("", 0, ["shop"]), {})
    steps = {n: (lambda n=n: done.append(n) or int(n == "checks" and len(done) < 4)) for n in ("vectors", "packing", "cards", "checks")}
    run = lambda now="v1": s.update_all(config, log, store, steps, stitch, lambda: done.append("view"), lambda: now)
    assert run()["moved"] and done == ["cards", "checks", "vectors", "packing", "view"]
    done.clear()
    assert not run("v2")["moved"] and done == ["cards", "checks", "vectors", "packing", "view"]  # verdicts changed: another version
    done.clear()
    steps["checks"] = lambda: done.append("checks") or 0
    run()
    assert "view" not in done

    def fails():
        raise OSError("did not land")

    store.set_meta("verdicts", "v3")
    with pytest.raises(OSError):
        s.update_all(config, log, store, {}, stitch, fails)
    assert s.update_all(config, log, store, {}, stitch, lambda: None)["view"] == "root:v3"  # tried again
    made = []
    cache = s.ViewCache(lambda: made.append(1) or len(made))
    assert [cache.get(v) for v in (None, "a", "a", "b")] == [None, 1, 1, 2] and s.view_version(store, "k") == "root:k:v3"


def test_config(spark):
    assert s.read_config('{"repos": ["a"], "publishers": ["p"]}').patterns == ["p/a"]
    for bad in ("{}", '{"repos": []}', '{"repos": ["v"], "publish_view": "v"}', '{"follow": ["/.*/"], "publish_view": "v"}', '{"follow": ["0xa/v"], "publish_view": "v"}', '{"repos": ["a"], "index": "x"}'):
        with pytest.raises(ValueError):
            s.read_config(bad)
    assert s.read_config('{"follow": ["0xa/v"], "publish_view": "v", "publisher": "0xb"}').publish_view == "v"  # another's repo of this name
    assert s.read_config('{"repos": ["a"]}', {"INDEX_PUBLISH_PER_DAY": "7", "INDEX_NAME": "mine"}).publish_per_day == 7
    assert "connect" in s.manifest(s.Config(publish_repos=["a"]), "u", {}) and "connect" not in s.manifest(s.Config(), "u", {})


def test_index_of_a_configuration(spark, tmp_path):
    """The configuration says which index is served; a gate shows nothing before it has been checked."""

    class Batches:
        """An embedder whose vectors say how many texts came together."""

        id, batch = "batches", 2

        def embed(self, texts):
            return [[float(len(texts)), 1.0] for _ in texts]

        def query(self, text):
            return [1.0, 1.0]

    store = SnapshotStore(spark, str(tmp_path / "s"))
    records = spark.createDataFrame([(i, "p", "r", str(i), f"c{i}", "note", json.dumps({"text": f"alpha {i}"}), f"alpha {i}") for i in range(6)], "rowseq long, publisher string, repo string, id string, cid string, type string, payload string, text string")
    with pytest.raises(LookupError):
        s.index_of(s.Config(), spark, store)
    none = records.limit(0).select("rowseq", F.lit(None).cast("array<float>").alias("vec"))
    embedder = Batches()
    store.save(Stitch("r", 1, ["*"]), {"records": records, "vectors": maintain.embed_missing(records, none, embedder, 100), **fulltext.built(records)})
    index, tools = s.index_of(s.Config(types=["note"]), spark, store, embedder)
    assert isinstance(index.postings, fulltext.Kept) and [r["id"] for r in tools["search"].run(index, {"query": "alpha 3", "mode": "lexical", "k": 1})] == ["3"]
    assert store.table("vectors").where("vec[0] <= 2").count() == 6  # the embedder never saw more than two at once
    checks = gate.Checks({"required": ["text"]}), {}
    gated, _ = s.index_of(s.Config(), spark, store, embedder, checks=checks)
    assert gated.served().count() == 0
    store.save(Stitch("r", 1, ["*"]), {"verdicts": gate.check_missing(records, gated.verdicts, gated.checker, *checks)})
    assert s.index_of(s.Config(), spark, store, embedder, checks=checks)[0].served().count() == 6
    with pytest.raises(LookupError):
        s.index_of(s.Config(index="repos"), spark, store)
    store.save(Stitch("r", 1, ["*"]), {"repos": model.repos(spark, D)})
    index, tools = s.index_of(s.Config(index="repos"), spark, store, embedder)
    assert list(tools) == ["find", "repo", "read"] and len(tools["find"].run(index, {"k": 3})) == 3
    said = s.manifest(s.Config(network="net", schema={"type": "object"}, rules="x"), "u", tools)
    assert said["network"] == "net" and said["schema"] == {"type": "object"} and said["rules"] == ["x"]

