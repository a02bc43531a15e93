"""Sharding by best-fit-decreasing bin packing: indivisible groups, largest first, each enter the open shard with the least room that still holds them.

Groups are the rows of equal text. Either the number of shards is given, and the smallest capacity that needs no more is sought, or the capacity, and there are as many shards as it takes. What is packed one by one is bounded: the groups above a share of the total size (there are at most as many as shares) and the buckets into which a hash deals all smaller groups. Only these units are packed. With a number of shards they are a few thousand or some dozens for each shard, whatever the size of the corpus, and are gathered and packed on the driver. With a capacity their number grows with the corpus, so that they are dealt by a hash to tasks of about UNITS units, which are packed on their own; each task leaves a few shards that are not full. The driver then gets one row for each task, and rows meet their units by joins that send nothing whole to all executors unless there are at most MOST_BROADCAST units.

Null texts form a group of their own with size 1, like empty ones. Repeated rows belong to one group. Groups of one size are taken in the order of their digests, and of shards with the same room the one opened first gets a group. Texts of any length count whole. Other columns play no part. Empty tables give an empty result. A single group above the capacity gets a shard of its own.
"""

from __future__ import annotations

import random
from itertools import accumulate
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut

#: Small groups are dealt into so many buckets at least, or so many for each shard; groups above half of a bucket's mean size are packed one by one.
BUCKETS, BUCKETS_A_SHARD = 4096, 16
#: Units that a task packs where a capacity is given, and units that are sent to all executors, some 100 bytes each.
UNITS, MOST_BROADCAST = 20_000, 200_000
#: Parts of a shard in which its rows are numbered.
PARTS = 512


class RoomTree:
    """Open bins by remaining room, in a treap: insert, and take the tightest bin with at least so much room, in logarithmic time."""

    def __init__(self) -> None:
        self.root, self.random = None, random.Random(0)

    @staticmethod
    def _split(node, item):
        """(items below item, the others)"""
        if node is None:
            return None, None
        value, rank, left, right = node
        if value < item:
            a, b = RoomTree._split(right, item)
            return (value, rank, left, a), b
        a, b = RoomTree._split(left, item)
        return a, (value, rank, b, right)

    @staticmethod
    def _join(a, b):
        if a is None or b is None:
            return a or b
        if a[1] < b[1]:
            return a[0], a[1], a[2], RoomTree._join(a[3], b)
        return b[0], b[1], RoomTree._join(a, b[2]), b[3]

    def add(self, room: int, bin_id: int) -> None:
        a, b = self._split(self.root, (room, bin_id))
        self.root = self._join(self._join(a, ((room, bin_id), self.random.random(), None, None)), b)

    def take(self, least: int) -> tuple[int, int] | None:
        a, b = self._split(self.root, (least, -1))
        if b is None:
            return None
        node = b
        while node[2] is not None:
            node = node[2]
        _, rest = self._split(b, (node[0][0], node[0][1] + 1))
        self.root = self._join(a, rest)
        return node[0]


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item. Bins are numbered as they open; an item above the capacity fills a bin of its own."""
    rooms, bins, opened = RoomTree(), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = rooms.take(sizes[i])
        if found is None:
            found, opened = (max(capacity, sizes[i]), opened), opened + 1
        bins[i] = found[1]
        rooms.add(found[0] - sizes[i], found[1])
    return bins


def into_shards(sizes: list[int], shards: int) -> list[int]:
    """Best-fit-decreasing with the smallest capacity, to a thousandth of a percent of the mean, that needs no more than so many shards."""
    low = max([ceil(sum(sizes) / shards), *sizes, 1])
    high = low + max([0, *sizes])
    best = best_fit_decreasing(sizes, low)
    if max(best, default=0) < shards:
        return best
    while max(best := best_fit_decreasing(sizes, high), default=0) >= shards:
        high *= 2
    while high - low > max(1, low // 100_000):
        middle = (low + high) // 2
        found = best_fit_decreasing(sizes, middle)
        if max(found, default=0) < shards:
            best, high = found, middle
        else:
            low = middle
    return best


def packed_in_tasks(units: DataFrame, capacity: int, units_a_task: int, n_units: int) -> DataFrame:
    """units (digest or bucket, and size) with shard, from 0 without gaps."""
    tasks = max(1, ceil(n_units / units_a_task))
    dealt = units.withColumn("task", F.pmod(F.xxhash64(F.coalesce("digest", F.col("bucket").cast("string"))), F.lit(tasks)).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(digest_=pdf["digest"].fillna(""), bucket_=pdf["bucket"].fillna(-1), alone=pdf["digest"].notna())
        pdf = pdf.sort_values(["size", "digest_", "bucket_", "alone"], ascending=False)
        return pdf[["digest", "bucket", "task"]].assign(bin=best_fit_decreasing(pdf["size"].tolist(), capacity))

    placed = cut(dealt.groupBy("task").applyInPandas(pack, "digest string, bucket int, task int, bin long"))
    bins = sorted((r["task"], r["n"]) for r in placed.groupBy("task").agg((F.max("bin") + 1).alias("n")).collect())
    starts = [(t, end - n) for (t, n), end in zip(bins, accumulate(n for _, n in bins), strict=True)]
    first = F.broadcast(units.sparkSession.createDataFrame(starts, "task int, start long"))  # one row for about UNITS units
    return placed.join(first, "task").select("digest", "bucket", (F.col("start") + F.col("bin")).cast("int").alias("shard"))


def packed_on_driver(units: DataFrame, shards: int) -> DataFrame:
    """The same for a number of shards: at most 3 * max(BUCKETS, BUCKETS_A_SHARD * shards) units."""
    packed = sorted(((r["size"], r["digest"] or "", -1 if r["bucket"] is None else r["bucket"], r["digest"] is not None) for r in units.collect()), reverse=True)
    places = into_shards([p[0] for p in packed], shards)
    return units.sparkSession.createDataFrame([(p[1] if p[3] else None, None if p[3] else p[2], s) for p, s in zip(packed, places, strict=True)], "digest string, bucket int, shard int")


def shard(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int | None = 8, capacity: int | None = None, units_a_task: int = UNITS, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """For each row of df: key, size (UTF-8 bytes and 1), text_crc32, shard and slot, its place in the shard. Equal texts share a shard. With a number of shards these have nearly equal sizes; with a capacity, which wins, there are as few shards as best-fit decreasing needs, in tasks of so many units."""
    rows = df.select(df[key].alias("key"), F.coalesce(df[text], F.lit("")).alias("text"), df[text].isNull().alias("none"))
    rows = rows.select(
        "key", (F.octet_length("text").cast("long") + 1).alias("size"), F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), F.when(F.col("none"), "").otherwise(F.sha2("text", 256)).alias("digest")
    )
    rows = cut(rows)
    groups = rows.groupBy("digest").agg(F.sum("size").alias("size"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    buckets = max(BUCKETS, BUCKETS_A_SHARD * (ceil(total / capacity) if capacity else shards or 1))
    bucket = F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int")
    large = F.col("size") * (2 * buckets) > total
    units = groups.groupBy(F.when(large, F.col("digest")).alias("digest"), F.when(~large, bucket).alias("bucket")).agg(F.sum("size").alias("size"))
    if capacity:
        units = cut(units)
        n_units = units.count()
        packed = packed_in_tasks(units, capacity, units_a_task, n_units)
        # Beyond the bound a hot text is one key of a join with narrow rows, which Spark splits where it is skewed.
        held = F.broadcast if n_units <= most_broadcast else lambda df: df
    else:
        packed, held = packed_on_driver(units, shards or 1), F.broadcast
    alone = held(packed.where("digest IS NOT NULL").select("digest", F.col("shard").alias("alone")))
    among = held(packed.where("bucket IS NOT NULL").select("bucket", F.col("shard").alias("among")))
    dealt = rows.withColumn("bucket", bucket).join(alone, "digest", "left").join(among, "bucket", "left")
    dealt = dealt.select("key", "size", "text_crc32", F.coalesce("alone", "among").alias("shard"))
    return number(dealt).select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot")


def number(df: DataFrame) -> DataFrame:
    """df with slot: from 0 without gaps within each shard. A shard's rows are dealt by their key to parts, which are numbered on their own, each from where the part before ends."""
    df = df.withColumn("part", F.pmod(F.xxhash64("key", "text_crc32"), F.lit(PARTS)).cast("int"))
    counts = df.groupBy("shard", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).drop("n")
    within = Window.partitionBy("shard", "part").orderBy("key", "text_crc32")
    return df.join(counts, ["shard", "part"]).withColumn("slot", (F.col("start") + F.row_number().over(within) - 1).cast("long")).drop("part", "start")
