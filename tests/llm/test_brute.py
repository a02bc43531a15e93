"""Operators that SQL can't express, against plain Python."""

import math
import re
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from palimpsest.llm import queries, secrets, site_style, toxicity

D = "/root/testdata/sf0.01"
S = site_style


def extracted(pages, named=S.NAMED, shown=1.0):
    """Texts by page number: the trees of all hosts by counting, their entropies, and a walk down each block's ancestors. pages: number, url, html. How a page is read is tested by itself."""
    read, trees, sizes = {}, defaultdict(dict), {}
    for n, url, page in pages:
        m = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", url or "")
        host, (blocks, nodes) = (m[1].lower() if m else ""), S.read_page(page)
        read[n] = host, blocks, nodes
        whole = " ".join(b for _, b in blocks)
        trees[host].setdefault(whole, nodes)
        sizes[whole] = sum(len(b) for _, b in blocks)
    odds = {}
    for host, tree in trees.items():
        seen = defaultdict(list)
        for whole, nodes in tree.items():
            for path, (_, _, chars, links, content, style) in nodes.items():
                if chars:
                    seen[path].append((sizes[whole], chars, links, content, style))
        for path, of in seen.items():
            m = len(of)

            def entropy(values, most, m=m):
                h = sum(c / m * math.log(m / c) for c in Counter(values).values())
                return min(h / math.log(most), 1.0) if m > 1 else 1.0

            say, look = entropy([x[3] for x in of], m), entropy([x[4] for x in of], min(m, S.LOOKS))
            total, chars, links = (sum(x[k] for x in of) for k in range(3))
            looks, share = S.LOOK * (look - 0.5), S.SHARE * (chars / max(total, 1) - 0.3)
            repeats, linked = S.SAY * min(say - 0.5, 0), -S.LINKS * max(links / max(chars, 1) - 0.5, 0)
            e = (m - 1) / (m - 1 + S.PRESUMED)
            odds[host, path] = shown * e * (looks + share + repeats + linked), shown * e * (max(looks, 0) + max(share, 0) + repeats), shown * e * (look - 0.5) > 0.1, max(1 - e, S.FADED)
    texts = {}
    for n, (host, blocks, nodes) in read.items():
        kept = []
        for paths, block in blocks:
            within = 0.0
            for path in paths:
                kind, part = nodes[path][:2]
                branch, as_part, main, prior = odds.get((host, path), (0.0, 0.0, False, 1.0))
                if kind == S.HIDDEN or S.PLAIN + named * prior * kind + (max(within, S.WITHIN) + as_part if part else within + branch) < 0:
                    break
                if kind == S.MAIN_KIND and named or main and not part:
                    within = S.WITHIN
            else:
                kept.append(block)
        texts[n] = " ".join(kept)
    return texts


def test_extraction_against_brute_force(spark):
    """All pages of sf0.01, and two hosts with pages that repeat, have comments, or nothing."""
    extra = [(10_000 + i, f"https://me@Shop.example:81/{i}", f"<body><nav>home</nav><div class=a><h2>Item {i}</h2>{'<p>some words</p>' * (i % 4)}</div><div id=reply>said {i % 3}</div></body>") for i in range(12)]
    extra += [(11_000 + i, "no host", page) for i, page in enumerate(["<p>one", "<p>one", "<p>two<div>more</div>", "", None])]
    given = spark.read.parquet(f"{D}/pages.parquet").select("page_id", "url", "html")
    df = given.union(spark.createDataFrame(extra, given.schema))
    pages = [tuple(r) for r in df.collect()]
    for options in ({}, {"named": 0.0}, {"shown": 0.0}):
        got = {r["page_id"]: r["text"] for r in S.main_text(df, **options).collect()}
        assert got == extracted(pages, **options), options


def test_names_and_entropies_both_decide(spark):
    """On the given pages neither names alone nor entropies alone give what both give: names fade where hosts have pages, entropies say little where they have few."""
    pages = spark.read.parquet(f"{D}/pages.parquet")
    both = queries.op5_extraction(spark, D)
    n = pages.count()
    for options in ({"named": 0.0}, {"shown": 0.0}):
        assert S.main_text(pages, **options).exceptAll(both).count() > n / 2


def sentences_of(text):
    return [set(words) for s in re.split(r"[.!?\n]+", text.lower()) if (words := re.findall(r"[^\W\d_]+", s))]


def naive_features(words):
    return {f for w in words for f in [w, *[w[:k] + "*" for k in toxicity.PREFIXES if len(w) > k]]}


def noisy_or(text, weights, bias):
    clean = 1.0
    for s in sentences_of(text):
        z = bias + sum(weights.get(f, 0.0) for f in naive_features(s))
        clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean


BAGS = [(f"the {a} {b} sat here. it was {c} there!\nand so on {i}", int("vile" in (a, b, c) or "wretch" in (a, b, c))) for i, (a, b, c) in enumerate(product(["kind", "vile", "old"], ["person", "wretch", "neighbour"], ["calm", "vile", "windy"]))]


def test_toxic_scores_against_brute_force(spark):
    """Scores of all documents by the product over their sentences."""
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    assert model.weights
    for r in docs.select("text", toxicity.scores(F.col("text"), model).alias("s")).collect():
        assert r["s"]["score"] == pytest.approx(noisy_or(r["text"] or "", model.weights, model.bias), abs=1e-9)


def test_toxicity_learns_as_brute_force_does():
    """Features by counting, and gradient ascent on the likelihood with numeric gradients."""
    texts, toxic = [t for t, _ in BAGS], [y for _, y in BAGS]
    weigh, rounds = 1.5, 25
    model = toxicity.fit(texts, toxic, clean_weight=weigh, rounds=rounds)
    n1, n0 = sum(toxic), len(toxic) - sum(toxic)
    holds = [set().union(*map(naive_features, sentences_of(t))) for t in texts]
    chosen = []
    for f in set().union(*holds):
        a, b = (sum(f in h for h, y in zip(holds, toxic, strict=True) if y == k) for k in (1, 0))
        if a >= 2 and a / n1 - b / n0 > 2 * math.sqrt((a + 1) / n1**2 + (b + 1) / n0**2):
            chosen.append(f)
    assert set(model.weights) == set(chosen) and chosen
    total = sum(1 if y else weigh for y in toxic)

    def likelihood(x):
        said = [noisy_or(t, dict(zip(chosen, x, strict=False)), x[-1]) for t in texts]
        return sum(math.log(p) if y else weigh * math.log(1 - p) for p, y in zip(said, toxic, strict=True)) / total - 0.5e-4 * sum(w * w for w in x[:-1])

    x, m, v = [0.0] * len(chosen) + [-6.0], [0.0] * (len(chosen) + 1), [0.0] * (len(chosen) + 1)
    for t in range(1, rounds + 1):
        at = lambda j, d: likelihood([*x[:j], x[j] + d, *x[j + 1 :]])  # noqa: B023, E731
        slope = [(at(j, 1e-5) - at(j, -1e-5)) / 2e-5 for j in range(len(x))]
        m = [0.9 * a + 0.1 * g for a, g in zip(m, slope, strict=True)]
        v = [0.999 * a + 0.001 * g * g for a, g in zip(v, slope, strict=True)]
        x = [w + 0.1 * (a / (1 - 0.9**t)) / (math.sqrt(b / (1 - 0.999**t)) + 1e-8) for w, a, b in zip(x, m, v, strict=True)]
    assert model.bias == pytest.approx(x[-1], rel=1e-3)
    assert [model.weights[f] for f in chosen] == pytest.approx(x[:-1], rel=1e-3)


NAMES = ["password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "credentials", "credential", *[f"{a}{s}key" for a in ("api", "access", "private", "client", "auth", "encryption") for s in ("_", "-", "")], "authorization"]
VALUE = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,./:;<=>?@^_`{|}~-")


def contexts(text):
    """Start and end of the values that stand where credentials do, by trying every place, name and sign in order."""
    fold = "".join(c.lower() if c.isascii() else c for c in text)
    blanks = lambda at: next((k for k in range(at, len(text)) if text[k] != " "), len(text)) - at

    def value(at):
        """What stands behind the sign: blanks, perhaps a scheme and blanks, perhaps a quote, and a value. Fewer blanks or no quote would only begin with what no value may hold."""
        at += blanks(at)
        for scheme in ("bearer", "basic", ""):
            if fold.startswith(scheme, at):
                b = at + len(scheme)
                n = blanks(b) if scheme else 0
                if scheme and not n:
                    continue
                b += n
                b += text[b : b + 1] in ('"', "'") and b < len(text)
                end = next((k for k in range(b, len(text)) if text[k] not in VALUE), len(text))
                if end - b >= 6:
                    return b, end
        return None

    def found(at):
        for name in NAMES:
            if fold.startswith(name, at):
                b = at + len(name)
                b += text[b : b + 1] in ('"', "'") and b < len(text)
                b += blanks(b)
                for sign in (":=", "=>", ":", "="):
                    if text.startswith(sign, b) and (v := value(b + len(sign))):
                        return v
        return None

    out, at = [], 0
    while at < len(text):
        before = text[at - 1 : at] if at else ""
        v = None if before.isascii() and before.isalnum() else found(at)
        if v:
            out.append(v)
        at = v[1] if v else at + 1
    return out


def test_guess_spans_against_brute_force(spark):
    """The spans that the method adds in all documents, and in texts with every name, sign and quote."""
    made = [f"x {n}{q}{s}{v}{q} y" for n, q, s, v in product(["password", "my_token", "mytoken", "API-KEY", "credentials", "Authorization"], ["", '"', "'"], [":", " = ", ":=", " => ", "==", "=>  "], ["X9kQz72mLpVt4", "Bearer Zk8vQ2pL0sRt5", "basic x", "bearer 'Zk8vQ2pL0sRt5", "short", "bearerZk8vQ2pL0sRt5"])]
    made += ["password", "token:", "secret: pwd=X9kQz72mLpVt4", "pwd=X9kQz72mLpVt4", "éto­ken=X9kQz72mLpVt4 paſſword=X9kQz72mLpVt4", None, ""]
    texts = made + [r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").select("text").collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n = 0
    for r in df.select("text", secrets.scan(F.col("text")).alias("s")).select("text", "s.spans").collect():
        text = r["text"] or ""
        want = [f"guess:{a}:{b}" for a, b in contexts(text) if secrets.guess_bits(text[a:b]) >= secrets.MIN_BITS]
        assert [s for s in r["spans"].split(",") if s.startswith("guess")] == want, text
        n += len(want)
    assert n > 100
