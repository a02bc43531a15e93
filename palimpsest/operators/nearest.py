"""The nearest vectors of many queries at once.

Two stages: of every row's signs, packed into longs, those that differ least from a query's make a pool, and the pool is scored exactly by cosine. nearest() without a pool scores all rows exactly.

Queries and rows lie in blocks of bounded size. A block of queries meets each block of rows once, in a grid of groups of blocks, which Spark deals to tasks by the places in the grid: a task holds the blocks of one place, each once, and gives the few best of its rows for each of the queries. The best of all are a rank within each query, cut before the shuffle too. So nothing is a pair of a query and a row but inside an array, and no task grows with either side.

Rows whose vector is null, or of another length than most, are found by no query; a vector of zeros has the cosine 0 with all. Scores that differ by float noise tie, and so do equal numbers of signs; the smaller key goes first. Keys don't repeat.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators.numbering import cut

ROWS, QUERIES, SLICE, GROUP = 4096, 256, 16, 64
#: How many rows the first stage leaves for each query.
POOL = 80
BLOCK = "block long, keys binary, data binary"


def packed_signs(vec: Column) -> Column:
    """The signs of a vector as an array of longs, 64 in each: a bit is set for a number that isn't negative."""
    bit = lambda x, i: F.when(x >= 0, F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))).otherwise(F.lit(0).cast("long"))
    word = lambda j: F.aggregate(F.transform(F.slice(vec, j * 64 + 1, F.lit(64)), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))
    return F.when(F.size(vec) == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.ceil(F.size(vec) / 64).cast("int") - 1), word))


def cosine_of(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(0.0)


def _blocks(df: DataFrame, size: int, kind: str) -> DataFrame:
    """key and data (arrays of one length) in blocks, by key."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                keys = np.asarray(part.column("key").to_numpy(zero_copy_only=False), "<i8")
                data = np.asarray(part.column("data").flatten().to_numpy(zero_copy_only=False), kind)
                yield pa.RecordBatch.from_pydict({"block": [number], "keys": [keys.tobytes()], "data": [data.tobytes()]})
                number += 1

    return cut(df.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(pack, BLOCK))


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits each row of a differs from each of b."""
    out = np.zeros((len(a), len(b)), np.int64)
    for j in range(a.shape[1]):
        out += np.bitwise_count(a[:, j : j + 1] ^ b[None, :, j])
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines, negative, so that less is nearer; as far as float noise allows."""
    unit = lambda x: x / np.where((n := np.sqrt((x * x).sum(axis=1, keepdims=True))) > 0, n, 1)
    return -np.round(unit(a) @ unit(b).T, 9)


def _cut(rows: np.ndarray, keys: np.ndarray, cost: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k of least cost in each row; of equal costs the smaller key goes first."""
    order = np.lexsort((keys, cost, rows))
    keep = order[np.arange(len(order)) - np.searchsorted(rows[order], rows[order]) < k]
    return rows[keep], keys[keep], cost[keep]


def _best(queries: DataFrame, rows: DataFrame, k: int, bits: bool, n_rows: int = ROWS, n_queries: int = QUERIES) -> DataFrame:
    """query, key and cost of the k rows of least cost for each query. queries, rows: key and data."""
    kind = "<u8" if bits else "<f8"
    asked, held = _blocks(queries, n_queries, kind), _blocks(rows, n_rows, kind)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_held, n_asked = held.count(), asked.count()
    slices, groups = max(math.ceil(n_held / SLICE), min(n_held, parts), 1), max(math.ceil(n_asked / GROUP), 1)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    left = asked.select(deal(groups).alias("group"), every(slices).alias("slice"), F.col("keys").alias("q_keys"), F.col("data").alias("q_data"))
    right = held.select(deal(slices).alias("slice"), every(groups).alias("group"), "keys", "data")

    def scan(left: pa.Table, right: pa.Table) -> pa.Table:
        view = lambda t, c, i, of: np.frombuffer(t.column(c)[i].as_buffer(), of)
        blocks, out = [(view(right, "keys", j, "<i8"), view(right, "data", j, kind)) for j in range(right.num_rows)], []
        for i in range(left.num_rows if blocks else 0):
            q = view(left, "q_keys", i, "<i8")
            a, most = view(left, "q_data", i, kind).reshape(len(q), -1), np.full(len(q), np.inf)
            best = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            for x, data in blocks:
                cost = (_differing if bits else _apart)(a, data.reshape(len(x), -1))
                some = min(k, len(x))
                row, at = np.nonzero(cost <= np.minimum(np.partition(cost, some - 1, axis=1)[:, some - 1], most)[:, None])
                best = _cut(*(np.concatenate(c) for c in zip(best, (row, x[at], cost[row, at].astype(np.float64)), strict=True)), k)
                n = np.bincount(best[0], minlength=len(q))
                most = np.where(n == k, best[2][np.cumsum(n) - 1], np.inf)
            out.append(pa.RecordBatch.from_arrays([pa.array(q[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query", "key", "cost"]))
        return pa.Table.from_batches(out, pa.schema([("query", pa.int64()), ("key", pa.int64()), ("cost", pa.float64())]))

    place = ["group", "slice"]
    found = left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(scan, "query long, key long, cost double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("cost", "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(queries: DataFrame, rows: DataFrame, k: int = 10, pool: int | None = POOL) -> DataFrame:
    """query, key, place and score (cosine) of the k nearest rows of each query. queries, rows: key and vec. pool: how many rows the signs leave for each query; None: all rows are scored."""
    plain = lambda df: df.where(F.col("vec").isNotNull()).select(F.col("key").cast("long").alias("key"), F.col("vec").cast("array<double>").alias("vec"))
    queries, rows = plain(queries), plain(rows)
    sizes = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dims = sizes["n"] if sizes else 0
    queries, rows = (df.where(F.size("vec") == dims) for df in (queries, rows))
    if pool is None:
        best = _best(*(df.select("key", F.col("vec").alias("data")) for df in (queries, rows)), k, False).select("query", "key", (-F.col("cost")).alias("score"))
    else:
        signs = lambda df: df.select("key", packed_signs(F.col("vec")).alias("data"))
        found = _best(signs(queries), signs(rows), max(pool, k), True)
        # A pool for each query is looked up, not all rows.
        both = found.join(rows, "key").join(queries.select(F.col("key").alias("query"), F.col("vec").alias("q")), "query")
        best = both.select("query", "key", F.round(cosine_of(F.col("vec"), F.col("q")), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    return best.withColumn("place", place).where(F.col("place") <= k).select("query", "key", "place", "score")
