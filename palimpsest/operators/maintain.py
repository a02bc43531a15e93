"""The bounded steps that keep an index up to date: vectors, repo cards, references, quotas."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import repo_text
from palimpsest.functions.vectors import cosine, is_json, packed_int8
from palimpsest.model import KEY, REPO

MAX_CARD = 64 * 1024


#: Texts that are embedded together.
BATCH = 32


class HashedWords:
    """An embedder without a model: words hashed into dimensions. Texts that share words are near. id names the space."""

    def __init__(self, dim: int = 64) -> None:
        self.dim, self.id = dim, f"hashed-words-{dim}"

    def embed(self, texts: list[str]) -> list[list[float]]:
        import re

        import xxhash

        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = xxhash.xxh64_intdigest(w)
                out[i, h % self.dim] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norms, out=out, where=norms > 0).tolist()

    def query(self, text: str) -> list[float]:
        return self.embed([text])[0]


def missing_vectors(records: DataFrame, vectors: DataFrame, most: int, allowed: DataFrame | None = None) -> DataFrame:
    """Up to `most` records without a vector, the oldest first; with a gate only those that it lets in."""
    rows = records if allowed is None else records.join(allowed, "rowseq", "left_semi")
    return rows.join(vectors.where("vec IS NOT NULL").select("rowseq"), "rowseq", "left_anti").orderBy("rowseq").limit(most)


def embed_missing(records: DataFrame, vectors: DataFrame, embedder, most: int, allowed: DataFrame | None = None) -> DataFrame:
    """vectors and those of up to `most` more records. Texts go to the embedder in batches of its own size (its attribute batch, BATCH without one): a quantized model may give a text another vector in other company, and then asks for 1."""
    size = max(1, getattr(embedder, "batch", BATCH))

    @F.pandas_udf("array<float>")
    def embedded(texts: pd.Series) -> pd.Series:
        every = [t or "" for t in texts]
        return pd.Series([v for at in range(0, len(every), size) for v in embedder.embed(every[at : at + size])], dtype=object)

    batch = missing_vectors(records, vectors, most, allowed).select("rowseq", embedded("text").alias("vec"))
    return vectors.where("vec IS NOT NULL").select("rowseq", "vec").unionByName(batch)


class Network:
    """What a card must name to speak for a repo: the uri of an extension, and in its parameters, under these names, publisher, repo, chain (as written, such as eip155:1) and registry."""

    def __init__(self, uri: str, chain: str, registry: str, names: tuple[str, str, str, str] = ("publisher", "repo", "chainId", "dataRegistry")) -> None:
        self.uri, self.chain, self.registry, self.names = uri, chain, registry, names


def card_binds(card: Column, publisher: Column, repo: Column, network: Network) -> Column:
    """Whether a card is small enough, is JSON, and its first extension of the network's uri names this repo, publisher, chain and registry; addresses compare in any case."""
    extensions = "array<struct<uri: string, params: map<string, string>>>"
    parsed = F.from_json(card, f"capabilities struct<extensions: {extensions}>")
    ours = F.filter(F.coalesce(parsed["capabilities"]["extensions"], F.array().cast(extensions)), lambda x: x["uri"] == network.uri)
    p = F.get(ours, F.lit(0))["params"]
    who, which, chain, registry = (F.element_at(p, n) for n in network.names)
    bound = (F.lower(who) == F.lower(publisher)) & (which == repo) & (chain == network.chain) & (F.lower(registry) == network.registry.lower())
    return F.coalesce((F.length(card) <= MAX_CARD) & bound, F.lit(False))


def card_urls(records: DataFrame) -> DataFrame:
    """publisher, repo and url of the repos whose record @card names one; only http and https."""
    url = F.get_json_object("payload", "$.url")
    return records.where((F.col("id") == "@card") & url.rlike("^https?://")).select(*REPO, url.alias("url"))


def repos_apply(repos: DataFrame, moved: DataFrame, now: Column) -> DataFrame:
    """repos with moved heads (publisher, repo, to): stale until their cards are read again; cards, texts and vectors stay meanwhile."""
    m = moved.select(*REPO, F.col("to").alias("__to"))
    both = repos.join(m, REPO, "full_outer")
    hit = F.col("__to").isNotNull()
    return both.select(
        *REPO,
        F.coalesce("__to", "head").alias("head"),
        F.when(hit, now).otherwise(F.col("updated")).alias("updated"),
        "card_url", "card", F.coalesce("text", F.regexp_replace("repo", r"[-_.]+", " ")).alias("text"), "vec",
        (hit | F.coalesce("stale", F.lit(False))).alias("stale"),
    )


def cards_apply(repos: DataFrame, fetched: DataFrame, network: Network) -> DataFrame:
    """repos with fetched cards (publisher, repo, head, card_url, card), each only if the head is still the one it was fetched for. A card that doesn't bind to its repo counts as none. The vector stays if the text does."""
    f = fetched.select(*REPO, "head", F.col("card_url").alias("__url"), F.col("card").alias("__card"), F.lit(True).alias("__hit"))
    both = repos.join(f, [*REPO, "head"], "left")
    hit = F.coalesce(F.col("__hit"), F.lit(False))
    card = F.when(card_binds(F.col("__card"), F.col("publisher"), F.col("repo"), network), F.col("__card"))
    text = repo_text(F.col("repo"), card)
    return both.select(
        *REPO, "head", "updated",
        F.when(hit, F.when(card.isNotNull(), F.col("__url"))).otherwise(F.col("card_url")).alias("card_url"),
        F.when(hit, card).otherwise(F.col("card")).alias("card"),
        F.when(hit, text).otherwise(F.col("text")).alias("text"),
        F.when(~hit | text.eqNullSafe(F.col("text")), F.col("vec")).alias("vec"),
        (F.col("stale") & ~hit).alias("stale"),
    )


def stale_repos(repos: DataFrame, most: int) -> DataFrame:
    """Up to `most` repos whose cards are to be read again, in key order."""
    return repos.where("stale").orderBy(*REPO).limit(most)


def repo_rows(repos: DataFrame, whole: bool = False) -> DataFrame:
    """What is shown of repos: the whole card, or its name and description alone."""
    shown = [F.col("card")] if whole else [F.get_json_object("card", f"$.{c}").alias(c) for c in ("name", "description")]
    return repos.select(*REPO, "head", "updated", "card_url", *shown)


def repos_find(repos: DataFrame, vector: list[float] | None = None, publisher: str | None = None, k: int = 20) -> DataFrame:
    """The k repos nearest to a vector, with score, of those that have one; without a vector the k that changed last."""
    some = repos if publisher is None else repos.where(F.col("publisher") == publisher.lower())
    if vector is None:
        return repo_rows(some.orderBy(F.desc("updated"), *REPO).limit(k)).orderBy(F.desc("updated"), *REPO)
    scored = some.where("vec IS NOT NULL").withColumn("score", cosine(F.col("vec"), vector))
    best = scored.orderBy(F.desc(F.round("score", 9)), *REPO).limit(k)
    return best.select(*[c for c in repo_rows(repos).columns if c not in ("name", "description")], *[F.get_json_object("card", f"$.{c}").alias(c) for c in ("name", "description")], "score")


def repos_get(repos: DataFrame, publisher: str, repo: str) -> DataFrame:
    """One repo with its whole card, or no row."""
    return repo_rows(repos.where((F.col("publisher") == publisher.lower()) & (F.col("repo") == repo)), whole=True)


def pack_vectors(vectors: DataFrame, most: int) -> DataFrame:
    """vectors (rowseq, vec as text) with up to `most` that are still JSON, the oldest first, as base64 of int8. Ranks hardly move."""
    old = vectors.where(is_json(F.col("vec"))).orderBy("rowseq").limit(most)
    packed = old.withColumn("vec", packed_int8(F.from_json("vec", "array<double>")))
    return vectors.join(old.select("rowseq"), "rowseq", "left_anti").unionByName(packed)


def pin_references(refs: DataFrame, records: DataFrame) -> DataFrame:
    """References (publisher, repo, id) as their records are now: cid and type, null where there is none."""
    return refs.join(records.select(*KEY, "cid", "type"), KEY, "left")


def stale_references(pinned: DataFrame, records: DataFrame) -> DataFrame:
    """Pinned references whose record has another version by now, or is gone: with cid and now."""
    return pinned.join(records.select(*KEY, F.col("cid").alias("now")), KEY, "left").where(~F.col("cid").eqNullSafe(F.col("now")))


def daily(log: DataFrame) -> DataFrame:
    """day and published: entries by UTC day."""
    return log.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("published"))


