"""A kept full-text index: an inverted index in segments, beside the records in a store, and BM25 searches that read a part of it.

fts_postings: a row for each segment, term and range of PART rows: seg, term, part, n (rows with the term), most (how often it occurs in one of them), least (the fewest tokens of one), and its rows as blocks.py packs them. In the order of terms and ranges, so that a search reads the row groups of its terms.
fts_gone:     rowseq and before: what segments before that one say of a row no longer holds.
fts_terms:    term and df, in how many rows it occurs now.
fts_sizes:    one row: n_docs, total (tokens), segs, the number of segments so far, and part, the rows of a range.

A save adds a segment for rows that are new or changed, and names the rows that went; nothing is rewritten. Statistics are merged: the numbers of rows, tokens and rows with a term change by what came and went. merged() makes one segment of all.

A search for the k best knows for each range of rows how good a row in it can be: a term's part of the score grows with its count and falls with the length, so the largest count and the fewest tokens bound it, and a range is no better than the sum over the terms. The ranges with the best bounds are scored first; what the k-th row has there is the least that a row must reach, and ranges whose bound lies below are never read. Where a query has a phrase, in how many rows it occurs isn't known beforehand, and all rows with its words are read.

Texts that are null or empty have no tokens, but count as rows. Row numbers are whole and not negative.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import tokens
from palimpsest.operators.blocks import NAMES, dropped, in_order, inverted, rows_of
from palimpsest.operators.lexical import K1, LEAST_IDF, B, phrases
from palimpsest.operators.numbering import cut, written
from palimpsest.operators.ranking import top
from palimpsest.sources.store import Delta

#: Rows of a range.
PART = 1024
#: Ranges that are named one by one to a scan.
MOST_NAMED = 1000
#: Rows of ranges with lost rows that are sent to all executors.
MOST_SENT = 25_000_000
#: Scores that differ by less may tie.
MARGIN = 2e-9


def segment(df: DataFrame, text: str = "text", part: int = PART) -> DataFrame:
    """The postings of rows (rowseq and text) as blocks, written where the rows are; in_order() puts them together."""
    return written(inverted(df.select("rowseq", tokens(F.coalesce(F.col(text), F.lit(""))).alias("tokens")), part))


def sizes(df: DataFrame, text: str = "text") -> DataFrame:
    """n_docs and total. Folding changes letters, not where tokens end, so they are counted without it."""
    return df.select(F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[\p{L}\p{N}]+")).alias("len")).agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("len"), F.lit(0)).alias("total"))


def spread(blocks: DataFrame) -> DataFrame:
    """term and df of a segment."""
    return blocks.groupBy("term").agg(F.sum("n").alias("df"))


def spread_of(df: DataFrame, text: str = "text") -> DataFrame:
    """The same of rows, without their postings."""
    return df.select(F.explode(F.array_distinct(tokens(F.coalesce(F.col(text), F.lit(""))))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def built(df: DataFrame, text: str = "text", part: int = PART) -> dict[str, DataFrame]:
    """The tables of an index over all rows, to save."""
    blocks = segment(df, text, part)
    total = blocks.agg(F.coalesce(F.sum(F.size("packed") - 3 * F.col("n") - 1), F.lit(0)).cast("long").alias("total")).first()["total"]
    return {
        "fts_postings": in_order(blocks).select(F.lit(0).alias("seg"), "*"),
        "fts_gone": df.sparkSession.createDataFrame([], "rowseq long, before int"),
        "fts_terms": spread(blocks).repartitionByRange("term").sortWithinPartitions("term"),
        "fts_sizes": df.sparkSession.createDataFrame([(df.count(), total, 1, part)], "n_docs long, total long, segs int, part int"),
    }


def renewed(table: Callable[[str], DataFrame | None], gone: DataFrame, new: DataFrame, text: str = "text", part: int | None = None) -> dict[str, DataFrame | Delta]:
    """What to save when rows went and came. gone: rowseq and the text that the index has of it; new: rowseq and text; a changed row is in both. table: gives the tables as they are. part: as the index has it."""
    was = table("fts_sizes").first()
    if part not in (None, was["part"]):
        raise ValueError(f"the ranges of this index have {was['part']} rows")
    came, went = sizes(new, text).first(), sizes(gone, text).first()
    blocks = segment(new, text, was["part"])
    change = spread(blocks).select("term", F.col("df").alias("by")).unionByName(spread_of(gone, text).select("term", (-F.col("df")).alias("by"))).groupBy("term").agg(F.sum("by").alias("by"))
    # As many terms as the changed rows have: the table of terms is only looked up.
    terms = cut(change.join(table("fts_terms"), "term", "left").select("term", (F.coalesce("df", F.lit(0)) + F.col("by")).alias("df")))
    now = (was["n_docs"] + came["n_docs"] - went["n_docs"], was["total"] + came["total"] - went["total"], was["segs"] + 1, was["part"])
    return {
        "fts_postings": Delta([], in_order(blocks).select(F.lit(was["segs"]).alias("seg"), "*")),
        "fts_gone": Delta(["rowseq"], gone.select("rowseq", F.lit(was["segs"]).alias("before"))),
        "fts_terms": Delta(["term"], terms.where("df > 0"), terms.where("df <= 0").select("term")),
        "fts_sizes": gone.sparkSession.createDataFrame([now], "n_docs long, total long, segs int, part int"),
    }


def without(blocks: DataFrame, gone: DataFrame, part: int) -> DataFrame:
    """Blocks without the rows that no longer hold. A range with such rows has for each of its rows, in order, the first segment that holds of it, so that a row is looked up by its place. Up to MOST_SENT rows, 4 bytes each, are sent to all executors."""

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(part, np.int32)
        out[(pdf["rowseq"] % part).to_numpy()] = pdf["before"].to_numpy()
        return pd.DataFrame({"part": [pdf["part"].iloc[0]], "first": [out]})

    by = cut(gone.withColumn("part", F.floor(F.col("rowseq") / part).cast("long")).groupBy("part").applyInPandas(first, "part long, first array<int>"))
    both = blocks.join(F.broadcast(by) if by.count() * part <= MOST_SENT else by, "part", "left")
    lost = F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda j: F.get("first", F.get("packed", j)) > F.col("seg"))
    return dropped(both.withColumn("lost", F.when(F.col("first").isNull(), F.array().cast("array<int>")).otherwise(lost)))


def merged(table: Callable[[str], DataFrame | None]) -> dict[str, DataFrame]:
    """One segment of all, without what is gone, to save in place of them."""
    part = table("fts_sizes").first()["part"]
    return {
        "fts_postings": in_order(without(table("fts_postings"), table("fts_gone"), part)).select(F.lit(0).alias("seg"), "*"),
        "fts_gone": table("fts_gone").limit(0),
        "fts_terms": table("fts_terms").repartitionByRange("term").sortWithinPartitions("term"),
        "fts_sizes": table("fts_sizes").withColumn("segs", F.lit(1)),
    }


class Kept:
    """Searches of a kept index. table: gives its tables by name, as SnapshotStore.table does."""

    def __init__(self, table: Callable[[str], DataFrame | None]) -> None:
        self.table = table
        self.postings, self.gone = table("fts_postings"), table("fts_gone")
        said = table("fts_sizes").first()
        self.n_docs, self.avg_len, self.segs = float(said["n_docs"]), (said["total"] or 0) / max(said["n_docs"], 1) or 1.0, said["segs"]
        self.size = said["part"]

    def live(self, blocks: DataFrame, places: bool = False) -> DataFrame:
        """term, part, rowseq, len and f of the rows of these blocks that still hold, and places if asked for."""
        rows = blocks.select("seg", "term", "part", F.explode(rows_of(self.size, places)).alias("r")).select("seg", "term", "part", "r.*")
        if self.segs == 1:
            return rows.drop("seg")
        return rows.join(self.gone, "rowseq", "left").where("before IS NULL OR seg >= before").drop("seg", "before")

    def idf(self, df: float) -> float:
        x = math.log((self.n_docs - df + 0.5) / (df + 0.5))
        return x if x > 0 else LEAST_IDF

    def part(self, f: Column, length: Column, idf: Column) -> Column:
        """What a term adds to a score."""
        return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / F.lit(self.avg_len)))

    def _idfs(self, terms: list[str]) -> dict[str, float]:
        found = {r["term"]: r["df"] for r in self.table("fts_terms").where(F.col("term").isin(terms)).collect()}
        return {t: self.idf(found.get(t, 0)) for t in terms}

    def scores(self, query: str) -> DataFrame:
        """rowseq and score of all rows that have a word of the query."""
        wanted = phrases(query)
        if not wanted:
            return self._none()
        return self._phrases(wanted) if any(len(p) > 1 for p in wanted) else self._terms([p[0] for p in wanted], self.postings)

    def top(self, query: str, k: int, among: DataFrame | None = None) -> DataFrame:
        """rowseq and score of the k best rows; among: rowseqs that count."""
        wanted = phrases(query)
        kept = lambda df: df if among is None else df.join(among.select("rowseq"), "rowseq", "left_semi")
        if not wanted or any(len(p) > 1 for p in wanted):
            return top(kept(self.scores(query)), k, "rowseq")
        terms = [p[0] for p in wanted]
        idfs = self._idfs(terms)
        bounds = self.bounds(terms, idfs).collect() if self._few() else None
        if bounds is None:
            return self._top_of_many(terms, idfs, k, kept)
        # First the ranges that may hold the best, enough of them for k rows.
        order, first, rows = sorted(bounds, key=lambda r: -r["bound"]), [], 0
        for r in order:
            if rows >= 2 * k:
                break
            first.append(r["part"])
            rows += r["rows"]
        best = top(kept(self._terms(terms, self._blocks(terms, first), idfs)), k, "rowseq").collect()
        least = best[-1]["score"] - MARGIN if len(best) == k else -math.inf
        rest = [r["part"] for r in order if r["bound"] >= least and r["part"] not in set(first)]
        spark = self.postings.sparkSession
        held = spark.createDataFrame(best, "rowseq long, score double")
        return top(held.unionByName(kept(self._terms(terms, self._blocks(terms, rest), idfs))), k, "rowseq") if rest else held

    def _few(self) -> bool:
        """Whether the bounds of all ranges are few enough for the driver."""
        return self.n_docs / self.size * self.segs <= 100 * MOST_NAMED

    def _top_of_many(self, terms: list[str], idfs: dict[str, float], k: int, kept: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The same where the bounds are a table of their own: only the first ranges come to the driver."""
        bounds = self.bounds(terms, idfs)
        first = [r["part"] for r in bounds.orderBy(F.desc("bound"), "part").limit(MOST_NAMED).collect()]
        best = top(kept(self._terms(terms, self._blocks(terms, first), idfs)), k, "rowseq").collect()
        least = best[-1]["score"] - MARGIN if len(best) == k else -math.inf
        held = self.postings.sparkSession.createDataFrame(best, "rowseq long, score double")
        rest = self.postings.where(F.col("term").isin(terms)).join(bounds.where((F.col("bound") >= least) & ~F.col("part").isin(first)).select("part"), "part", "left_semi")
        return top(held.unionByName(kept(self._terms(terms, rest, idfs))), k, "rowseq")

    def bounds(self, terms: list[str], idfs: dict[str, float]) -> DataFrame:
        """part, bound (no row in it has a larger score) and rows (that have a term, at least, if none is gone). Reads no postings."""
        idf = reduce(lambda a, t: F.when(F.col("term") == t, idfs[t]).otherwise(a), terms, F.lit(0.0))
        each = self.postings.where(F.col("term").isin(terms)).groupBy("part", "term").agg(F.max(self.part(F.col("most").cast("double"), F.col("least"), idf)).alias("bound"), F.sum("n").alias("n"))
        return each.groupBy("part").agg(F.sum("bound").alias("bound"), F.max("n").alias("rows"))

    def _blocks(self, terms: list[str], parts: list[int]) -> DataFrame:
        found = self.postings.where(F.col("term").isin(terms))
        if len(parts) <= MOST_NAMED:
            return found.where(F.col("part").isin(parts) if parts else F.lit(False))
        return found.join(self.postings.sparkSession.createDataFrame([(p,) for p in parts], "part long"), "part", "left_semi")

    def _terms(self, terms: list[str], blocks: DataFrame, idfs: dict[str, float] | None = None) -> DataFrame:
        idfs = idfs or self._idfs(terms)
        idf = reduce(lambda a, t: F.when(F.col("term") == t, idfs[t]).otherwise(a), terms, F.lit(0.0))
        rows = self.live(blocks.where(F.col("term").isin(terms)))
        # Parts are summed in the order of the query's words, as elsewhere: so scores are the same to the last digit.
        each = rows.groupBy("rowseq").agg(F.map_from_entries(F.collect_list(F.struct("term", self.part(F.col("f").cast("double"), F.col("len"), idf).alias("x")))).alias("by"))
        return each.select("rowseq", reduce(lambda a, b: a + b, [F.coalesce(F.col("by")[t], F.lit(0.0)) for t in terms]).alias("score"))

    def _phrases(self, wanted: list[list[str]]) -> DataFrame:
        terms = sorted({t for p in wanted for t in p})
        rows = self.live(self.postings.where(F.col("term").isin(terms)), places=True).groupBy("rowseq", "len").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("at"))
        starts = lambda t, shift: F.transform(F.coalesce(F.col("at")[t], F.array().cast("array<int>")), lambda x: x - shift)
        found = rows.select("rowseq", "len", *[F.size(reduce(F.array_intersect, [starts(t, j) for j, t in enumerate(p)])).cast("double").alias(f"f{i}") for i, p in enumerate(wanted)])
        n = range(len(wanted))
        # Rows with none add nothing to a count.
        found = cut(found.where(reduce(lambda a, b: a | b, [F.col(f"f{i}") > 0 for i in n])))
        df = found.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in n]).first()
        score = reduce(lambda a, b: a + b, [self.part(F.col(f"f{i}"), F.col("len"), F.lit(self.idf(df[f"n{i}"]))) for i in n])
        return found.select("rowseq", score.alias("score"))

    def _none(self) -> DataFrame:
        return self.postings.sparkSession.createDataFrame([], "rowseq long, score double")
