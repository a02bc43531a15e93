"""A hash tree over heads, by which two replicas find where they differ without comparing all, and one head has a proof.

A repo's place is the SHA-256 of its name, in hexadecimal; nodes are its prefixes, so that each has at most 16 children and names spread evenly over the buckets at the bottom, of which there are about one for 16 repos. A bucket is the hash of its heads in the order of their places, another node that of its children with their digits; the root is the hash of all. Building is a group by prefix for each level, each a sixteenth of the one below.

Replicas compare their roots, then the children of nodes that differ, and so on down, so that few differing repos cost few nodes of each level. Both need the same depth, which is one of the number of repos that they agree upon. A proof of a head is its bucket and the children of the nodes above it: a few hundred bytes for each level, whatever the number of repos.

A repo comes once; a null in a name or head counts as empty. No heads: one empty bucket.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.model import REPO

FANOUT = 16


def depth_for(n: int) -> int:
    """Levels below the root for so many repos."""
    return max(0, math.ceil(math.log(max(n, 1) / FANOUT, FANOUT)))


def leaves(heads: DataFrame) -> DataFrame:
    """publisher, repo, head, place and leaf, the hash that stands for the head."""
    text = lambda *c: F.concat_ws("/", *[F.coalesce(F.col(x), F.lit("")) for x in c])
    return heads.select(*REPO, "head", F.sha2(text(*REPO), 256).alias("place"), F.sha2(text(*REPO, "head"), 256).alias("leaf"))


def _joined(by: str, value: Column) -> Column:
    """The hash of values in the order of a column."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by), value.alias("v")))), lambda x: x["v"]), ""), 256)


def tree(heads: DataFrame, depth: int) -> DataFrame:
    """level, prefix, hash and n (repos below it) of all nodes; level 0 is the root."""
    at = leaves(heads).groupBy(F.substring("place", 1, depth).alias("prefix")).agg(_joined("place", F.col("leaf")).alias("hash"), F.count("*").alias("n"))
    nodes = at.select(F.lit(depth).alias("level"), "prefix", "hash", "n")
    for level in range(depth - 1, -1, -1):
        digit = F.concat(F.substring("prefix", level + 1, 1), F.col("hash"))
        at = at.groupBy(F.substring("prefix", 1, level).alias("parent")).agg(_joined("prefix", digit).alias("hash"), F.sum("n").alias("n")).withColumnRenamed("parent", "prefix")
        nodes = nodes.unionByName(at.select(F.lit(level).alias("level"), "prefix", "hash", "n"))
    return nodes


def differing(mine: DataFrame, theirs: DataFrame, depth: int) -> DataFrame:
    """The prefixes of the buckets in which two trees differ, by descending: below a node that is the same nothing is looked at."""
    down = None
    for level in range(depth + 1):
        a, b = (t.where(F.col("level") == level).select("prefix", F.col("hash").alias(n)) for t, n in ((mine, "a"), (theirs, "b")))
        if down is not None:
            parent = F.substring("prefix", 1, level - 1)
            a, b = (x.join(down, parent == F.col("above"), "left_semi") for x in (a, b))
        down = a.join(b, "prefix", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("prefix").alias("above"))
    return down.withColumnRenamed("above", "prefix")


def replica_difference(mine: DataFrame, theirs: DataFrame, depth: int, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """publisher, repo, mine and theirs of the repos whose heads differ, or that one side lacks. mine, theirs: heads. trees: of both, where they are kept; only heads of buckets that differ are compared."""
    a, b = trees or (tree(mine, depth), tree(theirs, depth))
    down = differing(a, b, depth)
    one, two = (leaves(h).join(down, F.substring("place", 1, depth) == F.col("prefix"), "left_semi").select(*REPO, F.col("head").alias(n)) for h, n in ((mine, "mine"), (theirs, "theirs")))
    return one.join(two, REPO, "full_outer").where(~F.col("mine").eqNullSafe(F.col("theirs")))


def head_proof(heads: DataFrame, nodes: DataFrame, depth: int, publisher: str, repo: str) -> DataFrame:
    """level, name and hash: the leaves of a repo's bucket (level depth + 1, named by their places), and the children of each node above it (named by their prefixes). Enough for proves()."""
    place = hashlib.sha256(f"{publisher}/{repo}".encode()).hexdigest()
    bucket = leaves(heads).where(F.startswith(F.col("place"), F.lit(place[:depth]))).select(F.lit(depth + 1).alias("level"), F.col("place").alias("name"), F.col("leaf").alias("hash"))
    beside = F.lit(False)
    for level in range(1, depth + 1):
        beside = beside | ((F.col("level") == level) & F.startswith(F.col("prefix"), F.lit(place[: level - 1])))
    return bucket.unionByName(nodes.where(beside).select("level", F.col("prefix").alias("name"), "hash"))


def proves(proof: list[tuple[int, str, str]], depth: int, publisher: str, repo: str, head: str, root: str) -> bool:
    """Whether a proof, level, name and hash, shows that the root holds this head of a repo."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    place = sha(f"{publisher}/{repo}")
    at = {level: sorted((name, h) for lv, name, h in proof if lv == level) for level in range(1, depth + 2)}
    if (place, sha(f"{publisher}/{repo}/{head}")) not in at[depth + 1]:
        return False
    now = sha("".join(h for _, h in at[depth + 1]))
    for level in range(depth, 0, -1):
        if (place[:level], now) not in at[level]:
            return False
        now = sha("".join(name[-1] + h for name, h in at[level]))
    return now == root
