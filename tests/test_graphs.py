"""Commit graphs, hash trees and nearest vectors, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest import model
from palimpsest.operators import commits, hashtree, log, nearest

D = "/root/testdata/sf0.001"
LOG = "publisher string, repo string, head string, parent string"


def graph(spark, edges, repo="r"):
    return spark.createDataFrame([("p", repo, h, p) for h, p in edges], LOG)


def test_commit_graph(spark):
    #   a - b - c - d      x - y (x's parent is missing)
    #        \\ e - f
    edges = [("a", "0x0"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", "b"), ("f", "e"), ("x", "gone"), ("y", "x"), ("f", "e")]
    g = graph(spark, edges).unionByName(graph(spark, [("a", "0x0"), ("z", "0x0"), ("b", "a")], "other"))  # the same names elsewhere
    assert sorted((r["repo"], r["parent"], r["n"]) for r in commits.forks(g).collect()) == [("other", "0x0", 2), ("r", "b", 2)]
    assert [(r["repo"], r["head"], r["parent"]) for r in commits.gaps(g).collect()] == [("r", "x", "gone")]
    depth = {(r["repo"], r["head"]): (r["depth"], r["first"]) for r in commits.depths(g).collect()}
    assert depth == {("r", "a"): (1, "a"), ("r", "b"): (2, "a"), ("r", "c"): (3, "a"), ("r", "d"): (4, "a"), ("r", "e"): (3, "a"), ("r", "f"): (4, "a"), ("r", "x"): (1, "x"), ("r", "y"): (2, "x"), ("other", "a"): (1, "a"), ("other", "z"): (1, "z"), ("other", "b"): (2, "a")}
    spans = spark.createDataFrame([("p", "r", "d", "f"), ("p", "r", "f", "d"), ("p", "r", None, "c"), ("p", "r", "b", "b"), ("p", "r", "a", None), ("p", "r", "a", "unknown"), ("p", "other", "z", "b")], 'publisher string, repo string, from string, to string')
    got = {}
    for r in commits.commits_between(g, spans).collect():
        got.setdefault((r["from"], r["to"], r["repo"]), set()).add(r["head"])
    assert got == {("d", "f", "r"): {"e", "f"}, ("f", "d", "r"): {"c", "d"}, (None, "c", "r"): {"a", "b", "c"}, ("z", "b", "other"): {"a", "b"}}
    assert commits.depths(g.limit(0)).count() == 0 and commits.commits_between(g.limit(0), spans).count() == 0


def test_long_histories(spark):
    n = 300
    g = graph(spark, [(str(i), str(i - 1) if i else "0x0") for i in range(n)])
    assert {r["head"]: r["depth"] for r in commits.depths(g).collect()} == {str(i): i + 1 for i in range(n)}
    spans = spark.createDataFrame([("p", "r", "17", "255")], "publisher string, repo string, from string, to string")
    assert sorted(int(r["head"]) for r in commits.commits_between(g, spans).collect()) == list(range(18, 256))


def test_hash_tree(spark):
    heads = log.stitch(model.update_log(spark, D), ["*"]).select(*model.REPO, "head").cache()
    n = heads.count()
    depth = hashtree.depth_for(n)
    assert depth >= 1 and hashtree.depth_for(0) == 0 == hashtree.depth_for(16) and hashtree.depth_for(17) == 1 and hashtree.depth_for(16**4) == 3
    nodes = hashtree.tree(heads, depth)
    root = nodes.where("level = 0").first()
    assert root["n"] == n and hashtree.tree(heads.repartition(7), depth).where("level = 0").first()["hash"] == root["hash"]
    one = heads.orderBy(*model.REPO).first()
    other = heads.withColumn("head", F.when((F.col("publisher") == one["publisher"]) & (F.col("repo") == one["repo"]), "moved").otherwise(F.col("head"))).where("NOT (publisher = 'u3' AND repo = 'view')").unionByName(spark.createDataFrame([("new", "repo", "h")], "publisher string, repo string, head string"))
    theirs = hashtree.tree(other, depth)
    want = {tuple(r) for r in heads.withColumnRenamed("head", "mine").join(other.withColumnRenamed("head", "theirs"), model.REPO, "full_outer").where("NOT mine <=> theirs").collect()}
    assert {tuple(r) for r in hashtree.replica_difference(heads, other, depth).collect()} == want and 2 <= len(want) <= 3
    assert hashtree.differing(nodes, theirs, depth).count() <= len(want) and hashtree.replica_difference(heads, heads, depth).count() == 0

    proof = [tuple(r) for r in hashtree.head_proof(heads, nodes, depth, one["publisher"], one["repo"]).collect()]
    holds = lambda head, said=proof: hashtree.proves(said, depth, one["publisher"], one["repo"], head, root["hash"])
    assert holds(one["head"]) and not holds("moved") and len(proof) < 16 * (depth + 1) + 60
    for i, (level, name, h) in enumerate(proof):
        assert not holds(one["head"], [*proof[:i], (level, name, "0" * 64), *proof[i + 1 :]])
    assert not holds(one["head"], proof[1:]) or proof[0][0] != depth + 1


@pytest.mark.parametrize("dims", [5, 64, 100])
def test_nearest_against_brute_force(spark, monkeypatch, dims):
    monkeypatch.setattr(nearest, "SLICE", 2)
    r = np.random.default_rng(dims)
    x = np.round(r.normal(size=(150, dims)), 1)  # small steps, so that some tie
    x[3] = 0
    x[20:24] = x[19]
    odd = [(900, None), (901, [1.0, 2.0])]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + odd, "key long, vec array<double>")
    asked = rows.where("key % 10 = 0 OR key = 3 OR key >= 900")
    norms = np.sqrt((x * x).sum(axis=1))
    cos = np.round(np.divide(x @ x.T, norms[:, None] * norms, out=np.zeros((150, 150)), where=norms[:, None] * norms > 0), 9)
    bits = (x >= 0).astype(int)
    apart = (bits[:, None, :] != bits[None]).sum(axis=2)

    def want(pool):
        out = set()
        for q in [*range(0, 150, 10), 3]:
            near = range(150) if pool is None else sorted(range(150), key=lambda i: (apart[q, i], i))[:pool]
            out |= {(q, i, p + 1) for p, i in enumerate(sorted(near, key=lambda i: (-cos[q, i], i))[:6])}
        return out

    def got(pool):
        best = lambda q, v, k, b: small(q, v, k, b, 16, 4)
        small = nearest._best if nearest._best.__name__ == "_best" else original
        with monkeypatch.context() as m:
            m.setattr(nearest, "_best", best)
            return {(a["query"], a["key"], a["place"]) for a in nearest.nearest(asked, rows, 6, pool).collect()}

    original = nearest._best
    assert got(20) == want(20) and got(None) == want(None)
    packed = {a["key"]: a["b"] for a in rows.where("vec IS NOT NULL").select("key", nearest.packed_signs(F.col("vec")).alias("b")).collect()}
    for i in (0, 3, 77):
        flat = [(w >> j) & 1 for w in packed[i] for j in range(64)][:dims]
        assert flat == bits[i].tolist() and len(packed[i]) == -(-dims // 64)
    assert nearest.nearest(asked.limit(0), rows).count() == 0 == nearest.nearest(asked, rows.limit(0)).count()


def test_nearest_sends_blocks_once(spark, monkeypatch):
    """A place of the grid gets each of its blocks once, not once for each block that it meets, and gives the few best of all its rows."""
    monkeypatch.setattr(nearest, "SLICE", 1000)
    x = np.random.default_rng(3).normal(size=(200, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key long, data array<double>")
    found = nearest._best(rows.where("key < 40"), rows, 3, False, 10, 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cost = -np.round(unit[:40] @ unit.T, 9)
    want = {(q, i) for q in range(40) for i in sorted(range(200), key=lambda i: (cost[q, i], i))[:3]}
    assert {(r["query"], r["key"]) for r in found.collect()} == want


def test_steps_are_numbers(spark):
    """Tables of steps hold no names, which are joined once at the end; spans that repeat count once."""
    g = spark.createDataFrame([("p", "r", "a", "0x0"), ("p", "r", "b", "a"), ("p", "r", "c", "b"), ("p", "r", "c", "b"), ("p", "s", "a", "0x0")], "publisher string, repo string, head string, parent string")
    steps = commits.links(commits.named(g))
    assert {f.dataType.simpleString() for f in steps.schema.fields} == {"bigint"} and steps.count() == 2
    spans = spark.createDataFrame([("p", "r", "a", "c"), ("p", "r", "a", "c"), ("p", "s", None, "a"), ("p", "s", None, "gone")], "publisher string, repo string, from string, to string")
    assert sorted((r["repo"], r["head"]) for r in commits.commits_between(g, spans).collect()) == [("r", "b"), ("r", "c"), ("s", "a")]
