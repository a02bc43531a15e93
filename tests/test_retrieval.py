import json
import sqlite3

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import text as tx
from palimpsest.functions import vectors as vx
from palimpsest.operators import lexical, maintain, ranking, search

ITEMS = [("t", "item", "oak table", "OAK-1"), ("c", "item", "pine chair", "PIN-2"), ("l", "item", "brass lamp", "BRS-3"), ("r", "rug", "wool rug", "WOL-4")]
WORDS = ["table", "chair", "lamp", "rug", "garden"]


def fake(text):
    """Counts of a few words; furniture counts as table and chair."""
    counts = [float(text.lower().split().count(w)) for w in WORDS]
    if "furniture" in text.lower():
        counts[0] += 1
        counts[1] += 1
    return counts


@pytest.fixture(scope="module")
def shop(spark):
    rows = [(i, "0xa" if k != "r" else "0xb", "shop", k, f"cid-{k}", t, json.dumps({"name": n, "sku": s}), f"name: {n}\nsku: {s}") for i, (k, t, n, s) in enumerate(ITEMS)]
    records = spark.createDataFrame(rows, "rowseq long, publisher string, repo string, id string, cid string, type string, payload string, text string")
    vectors = spark.createDataFrame([(r[0], fake(r[7])) for r in rows], "rowseq long, vec array<float>")
    return records, vectors


def ids(df):
    return [r["id"] for r in df.collect()]


def test_modes_and_filters(shop):
    records, vectors = shop
    find = lambda q, **o: ids(search.search(records, vectors, q, fake(q), **o))
    assert set(find("furniture", mode="semantic", k=2)) == {"t", "c"}
    assert find("furniture", mode="lexical") == []
    assert find("BRS-3", mode="lexical") == ["l"]
    assert set(find("lamp OAK-1", k=2)) == {"l", "t"}
    assert find("rug", mode="lexical", where=search.filters(publisher=["0xA"])) == []
    assert find("anything at all", mode="semantic", where=search.filters(type=["rug"])) == ["r"]
    assert find('un"balanced AND (OR', mode="lexical") == []


def test_payload_text_and_fused_score(spark):
    rows = [(0, "p", "r", "a", "c", "t", json.dumps({"text": "lamp", "survey": "moon"}), "text: lamp\nsurvey: moon")]
    records = spark.createDataFrame(rows, "rowseq long, publisher string, repo string, id string, cid string, type string, payload string, text string")
    vectors = spark.createDataFrame([(0, fake("lamp"))], "rowseq long, vec array<float>")
    assert ids(search.search(records, vectors, "moon", None, mode="lexical", payload_text=True)) == []
    hit = search.search(records, vectors, "lamp", fake("lamp"), payload_text=True).first()
    assert hit["score"] == pytest.approx(2 / 61)


def test_bm25_against_fts5(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.col("doc_id").alias("rowseq"), "text")
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE f USING fts5(text)")
    db.executemany("INSERT INTO f(rowid, text) VALUES (?, ?)", [tuple(r) for r in docs.collect()])
    for q in ["the scum", "of-the", "éen que nonesuch", "and"]:
        match = " OR ".join(f'"{w}"' for w in q.split())
        want = dict(db.execute("SELECT rowid, -bm25(f) FROM f WHERE f MATCH ?", (match,)).fetchall())
        got = {r["rowseq"]: r["score"] for r in lexical.bm25(docs, ["rowseq"], q).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-9) for k in want)


def test_fusion_against_model(spark):
    a, b = [3, 1, 2, 9], [2, 7, 3]
    frame = lambda xs: spark.createDataFrame([(x, i + 1) for i, x in enumerate(xs)], "k int, rank int")
    want = {}
    for xs in (a, b):
        for i, x in enumerate(xs):
            want[x] = want.get(x, 0) + 1 / (60 + i + 1)
    got = ranking.fuse(frame(a), frame(b), "k", 10).collect()
    assert [r["k"] for r in got] == sorted(want, key=lambda x: (-round(want[x], 12), a.index(x) if x in a else 99, b.index(x) if x in b else 99))


def test_text_of(spark):
    payloads = ['{"name":"x","dims":{"w":2},"tags":["a","b"]}', '{"b":1.0,"a":null,"2":0,"1":false,"e":{}}', "no json", None, '"s"']
    got = [r[0] for r in spark.createDataFrame([(p,) for p in payloads], "p string").select(tx.text_of(F.col("p"))).collect()]
    assert got == ["name: x\ndims.w: 2\ntags.0: a\ntags.1: b", "1: false\n2: 0\nb: 1", None, None, ": s"]


def test_repo_text_and_cards(spark):
    card = json.dumps({"name": "N", "description": "D", "skills": [{"name": "s", "tags": ["x", "y"]}], "capabilities": {"extensions": [{"uri": "u", "params": {"publisher": "0xAB", "repo": "field-notes", "chainId": "eip155:1", "dataRegistry": "0xR"}}]}})
    df = spark.createDataFrame([("0xab", "field-notes", card), ("0xab", "other", card), ("0xab", "field-notes", None)], "publisher string, repo string, card string")
    rows = df.select(tx.repo_text(F.col("repo"), F.col("card")), maintain.card_binds(F.col("card"), F.col("publisher"), F.col("repo"), maintain.Network("u", "eip155:1", "0xr"))).collect()
    assert [tuple(r) for r in rows] == [("field notes\nN\nD\ns\nx\ny", True), ("other\nN\nD\ns\nx\ny", False), ("field notes", False)]


@given(st.lists(st.floats(-1, 1), min_size=1, max_size=40))
def test_packing(values):
    back = vx.unpack_int8(vx.pack_int8(values))
    assert all(abs(a - b) <= 0.5 / 127 + 1e-9 for a, b in zip(values, back, strict=True))
    bits = vx.unpack_bits(vx.pack_bits(values), len(values))
    assert vx.pack_bits(bits) == vx.pack_bits(values) and all((b > 0) == (v >= 0) for v, b in zip(values, bits, strict=True))
    assert vx.unpack_int8("*") is None and vx.unpack_bits(None) is None


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([1.0],), (None,), ([2.0, 0.0, 5.0],)], "v array<float>")
    assert [r[0] for r in df.select(vx.cosine(F.col("v"), [1.0, 0.0])).collect()] == [1.0, 0.0, 0.0, None, 1.0]


@pytest.mark.parametrize(("k", "want"), [(None, 10), (3.9, 3), (0, 10), (-5, 1), (99, 50), ("x", 10)])
def test_clamp(k, want):
    assert search.clamp(k) == want
