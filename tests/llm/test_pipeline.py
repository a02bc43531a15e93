"""Each stage of the pipeline against a brute-force version, and odd rows through all of them."""

import collections
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as p
from palimpsest.llm import quality, secrets
from palimpsest.llm.packing import LENGTH

D = "/root/testdata/sf0.001"
W = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text):
    w = W.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def one_of_each(texts):
    """Smallest ids of what pairs at the similarity connect, all pairs compared."""
    sets, root = {k: sets_of(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(k) for k in ids}


def good(rows):
    """Documents that EM keeps, votes by Python."""
    signals = {}
    for k, t in rows.items():
        w, t = W.findall(t or ""), t or ""
        c = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        lines = [x for x in t.split("\n") if W.search(x)]
        signals[k] = {
            "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines), "n_distinct": len(set(w)),
            "n_repeat_words": len({j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}), "n_capitals": sum(x.isupper() for x in t), "n_mark_runs": len(re.findall("[#*$%&<>!?]{2,}| [|] ", t)),
        }
    says = lambda sql, s: eval(sql.replace("AND", "and").replace("OR", "or"), {"least": min, "sqrt": np.sqrt}, s)  # noqa: E731, S307
    votes = {k: tuple(-1 if says(r.bad, s) else 1 if says(r.good, s) else 0 for r in quality.RULES) for k, s in signals.items()}
    model = quality.fit(sorted(collections.Counter(votes.values()).items()), len(quality.RULES))
    odds = lambda v: np.log(model.prior / (1 - model.prior)) + sum(np.log(a / (1 - b)) if x == 1 else np.log((1 - a) / b) for x, a, b in zip(v, model.on_good, model.on_bad, strict=True) if x)
    return {k for k, s in signals.items() if s["n_words"] >= 10 and 100 * s["n_repeat_words"] <= 20 * s["n_words"] and odds(votes[k]) >= 0}


def test_stages(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = start = spark.read.parquet(f"{D}/documents.parquet")
    given = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    for name, stage in p.STAGES:
        before = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
        stage(spark, docs, D).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == p.STAGES[-1][0]:
            break
        assert docs.columns == start.columns
        after = collections.Counter((r["doc_id"], r["text"]) for r in docs.collect())
        texts = dict(before)
        if name == "quality":
            assert {k for k, _ in after} == good(given[0])
        elif name == "near_duplicates":
            assert after == collections.Counter({x: 1 for x in texts if x[0] in one_of_each(dict(texts.keys()))})
        elif name == "secrets":
            assert after == collections.Counter((k, secrets.redact(t)) for k, t in before) and not any(secrets.spans(t) for _, t in after)
        elif name == "mixture":
            assert set(after) <= set(before) and set(after.values()) <= {1, 2}
            words = lambda rows: sum(len(W.findall(t)) * n for (_, t), n in rows.items())
            assert 1.45 * words(before) < words(after) <= 1.5 * words(before)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, filled = collections.Counter(), collections.Counter()
    for (k, t), n in before.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        for i, at in enumerate(range(0, len(ids), LENGTH)):
            want[(k, i, at, len(ids[at : at + LENGTH]), zlib.crc32(ids[at : at + LENGTH].tobytes()))] += n
    rows = docs.collect()
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    for r in rows:
        filled[r["sequence_id"]] += r["length"]
    assert max(filled.values()) <= LENGTH


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names, and no rows at all, stage by stage."""
    prose = spark.read.parquet(f"{D}/documents.parquet")
    names = ["__key", "key", "n", "row", "h", "band", "size", "root", "k_", "__n", "votes", "words"]
    odd = [(None, "no key " * 20, None, None, None), (10**6, None, "en", None, 0), (10**6, "", "en", "s", None), (10**6 + 1, "long word " * 200_000, None, None, None), (10**6 + 2, "\n\t ", "en", "s", 3)]
    docs = prose.unionByName(spark.createDataFrame(odd, prose.schema)).unionByName(prose.limit(3))
    docs = docs.withColumns({c: F.lit(c) for c in names})
    for start in (docs, docs.limit(0)):
        now = start
        for name, stage in p.STAGES:
            out = stage(spark, now, D)
            if name != p.STAGES[-1][0]:
                assert out.columns == start.columns
                assert out.where(" OR ".join(f"{c} <> '{c}'" for c in names)).count() == 0
            path = str(tmp_path / f"{name}-{start is docs}")
            out.write.parquet(path)
            now = spark.read.parquet(path)
        assert (now.count() > 0) == (start is docs)


def test_run(spark):
    assert p.run(spark, D).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
