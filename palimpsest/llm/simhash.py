"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked where they differ in few bits.

Links are found by an embedding whose Manhattan distance never exceeds the Hamming distance. A fingerprint is cut into 32 segments of two bits, and each becomes its number of set bits, 0 to 2; a changed bit moves one coordinate by one. Four neighbouring coordinates make one grid, in which a fingerprint lies in one of 81 cells. Points within a distance of d lie in the same cell of all but d of the 8 grids, so the range join meets them in the cells that 8 - d grids make together; then the Manhattan distance is checked, then the Hamming distance. All this runs on distinct fingerprints.

Coordinates are written in unary (00, 01, 11), so that a Manhattan distance is a count of differing bits, and a cell is a byte.

Cells with more than HOT fingerprints are not joined as a whole. Their members are dealt into blocks, each pair of blocks is compared on its own, and it gives a spanning forest of its links instead of all of them, which leaves the components as they are.

The join is in grid.py. The pipeline wants a similarity of 0.8, about 10 differing bits of 64: similar.py takes candidates from the same join, adds those that lie further apart, and checks all of them exactly.

Null and empty texts have no words, and fingerprint zero; they link like all others. Ties, repeated rows and equal texts share a fingerprint. Very long texts are hashed in blocks. An empty table gives an empty result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, shingle_hashes, small, written
from palimpsest.llm.components import components
from palimpsest.llm.grid import DISTANCE, HOT, MOST_BROADCAST, differing, embedding, links, majority, spanning_forest
from palimpsest.llm.similar import near_duplicates_by_similarity, one_of_each

SHINGLE = 4


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """A bit is 1 if it is set in more than half of the hashes."""
    return majority(*shingle_hashes(text, shingle))


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprints as signed longs."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(text)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """For each row of df: key, fp (the fingerprint as a long) and component, the smallest key that links reach from it."""
    rows = cut(df.select(df[key].alias("key"), fingerprints(df[text], shingle).alias("fp")))
    points = rows.groupBy("fp").agg(F.min("key").alias("least"))
    # Fingerprints are few bytes and their keys many: dealt out again, as the table alone would lie in few tasks. By a hash of its own, as Spark leaves out a repartition by what the groups lie by already.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = written(components(links(points.select("fp").repartition(parts, F.xxhash64("fp")), distance, hot)))
    # Most fingerprints have no link: the few that have are joined to the others' table, then the result to the rows.
    classes = points.join(small(joined.select(F.col("node").alias("fp"), "root"), MOST_BROADCAST), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # Written, so that both sides of a join are plain tables, of which Spark can split a key with very many rows.
    classes = cut(classes)
    least = cut(classes.groupBy("root").agg(F.min("least").alias("component")))
    named = cut(classes.join(least, "root").select("fp", "component"))
    return rows.join(named, "fp").select(F.col("key").alias(key), "fp", "component")


def to_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


__all__ = ["differing", "embedding", "fingerprint", "fingerprints", "links", "near_duplicates", "near_duplicates_by_similarity", "one_of_each", "spanning_forest", "to_hex"]
