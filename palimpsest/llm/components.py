"""Connected components of a table of links, by alternating large-star and small-star rounds.

A large-star links every larger neighbour of a node to the smallest node among it and its neighbours, a small-star links its smaller neighbours and itself to that node. Both keep the components; when nothing changes, each node is linked to the smallest of its component alone. Links never gather at one node in a task: the rounds are group minima, which are summed up where the links are, and joins with these minima, which are sent to all executors where they are few and written where they are many, so that Spark can split the links of a node that has very many. The table of each round is written to the shared folder, so that a lost executor costs at most one round.

Links with a null end don't count. Repeated links and links of a node to itself change nothing. No links give no components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import written

#: Minima that are sent to all executors, 16 bytes each or so.
MOST_BROADCAST = 500_000


def components(links: DataFrame, rounds: int = 64, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """Columns node and root, the smallest node of its component, for each node that has a link. links: columns a and b of one type, in any order, with repeats or not."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state, held = None, lambda minima: F.broadcast(minima) if few else written(minima).hint("merge")
    few = 2 * edges.count() <= most_broadcast
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(held(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large if few else written(large)
        low = held(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        # Nothing changes once there is an edge from each node to its root alone.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components are not settled after {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
