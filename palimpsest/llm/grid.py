"""The grid range join of SimHash fingerprints, which simhash.py and similar.py share; simhash.py says how it works."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import let, small, written

DISTANCE = 4
GRIDS = 8
HOT = 256
#: Rows of ids or cells that are sent to all executors, 16 bytes each or so; more are joined by a shuffle.
MOST_BROADCAST = 500_000
#: In the bytes of grids that a cell is not of: 10 is no coordinate in unary.
OPEN = 0xAAAAAAAAAAAAAAAA


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def majority(n: int, blocks: Iterable[np.ndarray]) -> int:
    """The fingerprint of n hashes: a bit is 1 if it is set in more than half of them."""
    counts = np.zeros(64, np.int64)
    for hashes in blocks:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def embedding(fp: Column) -> Column:
    """The 32 coordinates in unary."""
    low = F.lit(0x5555555555555555)
    one = F.shiftright(fp, 1)
    both, either = fp.bitwiseAND(one).bitwiseAND(low), fp.bitwiseOR(one).bitwiseAND(low)
    return F.shiftleft(both, 1).bitwiseOR(either)


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def filled(x: Column) -> Column:
    """The lowest bit of each byte of x that isn't zero."""
    ors = [F.shiftrightunsigned(x, i) for i in range(1, 8)]
    return reduce(lambda a, b: a.bitwiseOR(b), ors, x).bitwiseAND(F.lit(0x0101010101010101))


def chosen_of(cell: Column) -> Column:
    """The grids that a cell is of, the lowest bit of a byte for each."""
    return filled(cell.bitwiseXOR(F.lit(signed(OPEN))))


def cells_of(points: DataFrame, distance: int) -> DataFrame:
    """fp, and each cell that it lies in of 8 - distance grids, as one long: the coordinates in these grids, and OPEN in the others, which no coordinates are."""
    masks = [sum(0xFF << (8 * i) for i in c) for c in combinations(range(GRIDS), GRIDS - distance)]
    cells = points.select("fp", embedding(F.col("fp")).alias("at"), F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    return cells.select("fp", F.col("at").bitwiseAND(F.col("mask")).bitwiseOR(F.bitwise_not("mask").bitwiseAND(F.lit(signed(OPEN)))).alias("cell"))


def links(points: DataFrame, distance: int = DISTANCE, hot: int = HOT, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Columns a < b of linked fingerprints; of those that only meet in hot cells, enough links to connect what all links connect. points: a column fp, without repeats.

    A row of the join is a fingerprint and a cell, the same on both sides, so that one shuffle serves both; the embedding is made again where two meet. Spark takes the cells for no more rows than there are fingerprints, so the join is said to be by a shuffle: else it would send all cells to all executors, through the driver."""
    cells = cells_of(points, distance)
    crowded = cells.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    crowded = written(crowded.withColumn("blocks", F.ceil(F.col("n") / hot).cast("int")))
    some = bool(crowded.take(1))
    crowded = small(crowded, most_broadcast)
    a, b = ((cells.join(crowded, "cell", "left_anti") if some else cells).hint("merge").alias(x) for x in "ab")
    apart = embedding(F.col("a.fp")).bitwiseXOR(embedding(F.col("b.fp")))
    near = (F.bit_count(apart) <= distance) & (differing(F.col("a.fp"), F.col("b.fp")) <= distance)
    # A pair meets in every choice of grids where it shares the cells; it counts in the first, which has all shared ones up to its last. More than a few lines of this would be more code than Spark compiles, and it is asked of near pairs alone: so as let().
    chosen = chosen_of(F.col("a.cell"))
    shared_besides = lambda x: F.bitwise_not(filled(x)).bitwiseAND(F.bitwise_not(chosen)).bitwiseAND(F.lit(0x0101010101010101))
    once = let(apart, lambda x: let(shared_besides(x), lambda more: (more == 0) | (chosen < more.bitwiseAND(-more))))
    found = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.fp") < F.col("b.fp")) & near & once)
    found = found.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    if not some:
        return found
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    members = cells.join(crowded, "cell").withColumn("block", block)
    # Block i meets each block j: the pair is named by the smaller and the larger.
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].drop_duplicates().to_numpy()
        return spanning_forest(fps, fps.reshape(-1, 1), distance)

    return found.unionByName(members.groupBy("cell", "i", "j").applyInPandas(forest, "a long, b long"))


def spanning_forest(ids: np.ndarray, fps: np.ndarray, distance: int) -> pd.DataFrame:
    """Links that connect what all links among these fingerprints, one a row of fps, connect: from each one reached, its links to those not reached yet. Starts at the smallest ids, so that blocks with common members give common links."""
    order = np.argsort(ids, kind="stable")
    ids, fps = ids[order], fps[order]
    rest, out = np.arange(len(ids)), []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count((fps[rest] ^ fps[at]).view(np.uint64)).sum(axis=1, dtype=np.int64) <= distance
            reached, rest = rest[near], rest[~near]
            out += [(min(ids[at], ids[x]), max(ids[at], ids[x])) for x in reached]
            queue += reached.tolist()
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")
