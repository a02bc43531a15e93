"""Search over records: semantic, lexical or hybrid, with exact filters and a gate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import fts_text
from palimpsest.functions.vectors import cosine
from palimpsest.operators.fulltext import Kept
from palimpsest.operators.lexical import bm25, bm25_of
from palimpsest.operators.numbering import cut
from palimpsest.operators.ranking import RRF_K, fuse, ranked, top

POOL = 50


def clamp(k: object, default: int = 10, most: int = 50) -> int:
    """A number of results: whole, 1 to most; the default for what is no number, and for 0."""
    try:
        return max(1, min(most, int(float(k)) or default))  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return default


def exactly(k: object, default: int = 10, most: int = 50) -> int:
    """The same for callers that are told: what is no whole number from 1 to most is an error."""
    if k is None:
        return default
    if isinstance(k, bool) or not isinstance(k, int) or not 1 <= k <= most:
        raise ValueError(f"k must be a whole number from 1 to {most}")
    return k


def filters(publisher: list[str] | None = None, repo: list[str] | None = None, type: list[str] | None = None) -> Column:
    """All given lists must match; publishers in any case."""
    kept = F.lit(True)
    for name, values in (("publisher", [p.lower() for p in publisher or []]), ("repo", repo), ("type", type)):
        if values:
            kept = kept & F.coalesce((F.lower(name) if name == "publisher" else F.col(name)).isin(list(values)), F.lit(False))
    return kept


def _among(df: DataFrame, keys: DataFrame | None) -> DataFrame:
    return df if keys is None else df.join(keys, "rowseq", "left_semi")


def _of_records(make: Callable[[DataFrame | None], DataFrame], records: DataFrame, keys: DataFrame | None) -> DataFrame:
    """A top list (rowseq, score) of records alone. make: gives it, from among these rowseqs, or of all."""
    if keys is not None:
        return make(keys)
    found = make(None)
    rows = found.collect()
    named = [r["rowseq"] for r in rows]
    there = {r["rowseq"] for r in records.where(F.col("rowseq").isin(named)).select("rowseq").collect()}
    return records.sparkSession.createDataFrame(rows, found.schema) if there >= set(named) else make(records.select("rowseq"))


def search(
    records: DataFrame, vectors: DataFrame | None, query: str, vector: list[float] | None, k: int = 10, mode: str = "hybrid", where: Column | None = None, allowed: DataFrame | None = None, rrf_score: bool = True, payload_text: bool = False,
    pool: int | None = None, index: Kept | tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """publisher, repo, id, cid, type, payload, score and place of the k best hits.

    records: with rowseq; vectors: rowseq and vec. where: an exact filter; allowed: rowseqs that a gate lets in. Both come before ranks, but not before the statistics of full text. rrf_score: scores of a single list are 1 / (60 + rank) too; else the cosine or BM25 score itself. payload_text: full text reads the payload's text first. pool: how many of each list are fused; at least k and 50 unless it is given. index: a kept full-text index, or postings and lengths, so that no text is read.

    Only a filter or a gate joins vectors and full text with records. Without either a list is made first, and its rows, a pool at most, are looked up; only if one of them is no record (any more) is the list made anew from a join. The k best are known before records are read, so that all else is left out of the scan.
    """
    mode = mode if mode in ("semantic", "lexical") else "hybrid"
    kept = records if where is None else records.where(where)
    if allowed is not None:
        kept = kept.join(allowed, "rowseq", "left_semi")
    # Written, as both lists are made from among them and a gate is a join of texts.
    keys, pool = None if where is None and allowed is None else cut(kept.select("rowseq")), pool or max(k, POOL)
    lists = []
    if mode != "lexical" and vectors is not None and vector is not None:

        def semantic(keys: DataFrame | None) -> DataFrame:
            scored = _among(vectors.where("vec IS NOT NULL"), keys).select("rowseq", cosine(F.col("vec"), vector).alias("score"))
            return top(scored, pool, "rowseq")

        lists.append(ranked(_of_records(semantic, records, keys), "rowseq"))
    if mode != "semantic":

        def lexical(keys: DataFrame | None) -> DataFrame:
            if isinstance(index, Kept):
                return index.top(query, pool, keys)
            corpus = records.withColumn("text", fts_text(F.col("payload"), F.col("text"))) if payload_text else records
            return top(_among(bm25(corpus, ["rowseq"], query) if index is None else bm25_of(*index, query), keys), pool, "rowseq")

        # A scan of the records finds records alone.
        lists.append(ranked(lexical(keys) if index is None else _of_records(lexical, records, keys), "rowseq"))
    if len(lists) == 2:
        best = fuse(lists[0], lists[1], "rowseq", k)
    elif lists:
        best = lists[0].where(F.col("rank") <= k)
        best = best.withColumn("score", 1.0 / (RRF_K + F.col("rank"))) if rrf_score else best
        best = best.withColumn("semantic_rank", F.col("rank")).withColumn("lexical_rank", F.lit(None).cast("int"))
    else:
        return kept.where(F.lit(False)).select("publisher", "repo", "id", "cid", "type", "payload", F.lit(0.0).alias("score"), F.lit(0).alias("place"))
    best = best.withColumn("place", ranked_place())
    # At most k rows, which name those to look up.
    found = best.select("rowseq", "score", "place").collect()
    named = records.sparkSession.createDataFrame(found, best.select("rowseq", "score", "place").schema)
    # They are all among the keys, so the gate isn't asked again.
    return records.where(F.col("rowseq").isin([r["rowseq"] for r in found])).join(F.broadcast(named), "rowseq").select("publisher", "repo", "id", "cid", "type", "payload", "score", "place").orderBy("place")


def search_by_vector(
    records: DataFrame, vectors: DataFrame, vector: list[float], k: int = 10, mode: str = "semantic", keywords: str = "", type: str | None = None, allowed: DataFrame | None = None, index: Kept | tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """search() as a server has it: by a vector, with keywords beside it. A single list has its own scores, cosine or BM25, and as many candidates as results; full text reads the payload's text first."""
    mode = mode if mode in ("lexical", "hybrid") else "semantic"
    where = None if type is None else filters(type=[type])
    return search(records, vectors, keywords, vector, k, mode, where, allowed, rrf_score=False, payload_text=True, pool=max(k, POOL) if mode == "hybrid" else k, index=index)


def ranked_place() -> Column:
    from pyspark.sql import Window

    return F.row_number().over(Window.orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("semantic_rank"), F.asc_nulls_last("lexical_rank")))
