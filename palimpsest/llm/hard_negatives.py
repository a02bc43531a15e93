"""Hard negatives by a pivot table: for each anchor and each of its best rows of the same label, the best rows of other labels whose scores lie within a share of the positive's score.

A score is an inner product of whole numbers, x as floor(scale x). With M the largest norm, a row x becomes (x, sqrt(M^2 - |x|^2)) and an anchor q becomes (q, 0); their squared Euclidean distance is |q|^2 + M^2 - 2 <q, x>, so large scores are short distances. A table holds the distances of every row and anchor to a few pivots, rows picked far from each other among a sample. By the triangle inequality the distance of q and x lies between the largest |d(q, p) - d(x, p)| and the smallest d(q, p) + d(x, p) of all pivots p, which brackets the score. Anchors whose bracket with a block of rows can't matter are left out, then rows whose bracket with the anchors that are left can't; what survives gets exact scores, as a product of matrices, which takes less time than brackets of all pairs. Vectors that spread evenly in all directions leave pivots little to rule out, so that most pairs are scored then; the result is exact anyway.

Rows lie in blocks, sorted by their nearest pivot and the distance to it, so that a block is narrow in the table; anchors, a stated share of the rows, lie in smaller blocks, sorted alike. A slice of a few blocks of rows meets a group of a few blocks of anchors in a task, which gets each block once. Blocks have a bounded number of rows, whatever their label, so a label with most of the rows is spread as others are. Each task gives the few best for each of its anchors, and what it has found so far rules out most of what follows; these are merged by a rank within each anchor. Two rounds: the best positives, for which rows of one label meet anchors of that label, then, knowing their scores, the negatives.

Rows with a null key or label, a null vector, or any null or non-finite component take no part. A shorter vector counts as filled up with zeros. Repeated rows are rows of their own. Scores that tie go to the smaller key. Other columns play no part, whatever their names. An empty table, one without anchors, and one with a single label give an empty result. Scores are exact; vectors so large that a hundred times a score could exceed a long are an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import written

PIVOTS = 8
#: Rows, the first by a hash of their keys, among which pivots are picked.
SAMPLE = 1024
#: Rows of a block, anchors of a block, blocks of rows and of anchors that meet in a task, on average.
ROWS, ANCHORS, SLICE, GROUP = 2048, 512, 32, 32

NONE = np.iinfo(np.int64).min
#: The arrays of a block, packed. positives: for anchors, the key and score of each of their positives.
ARRAYS = {"ids": "<i8", "keys": "<i8", "labels": "<i8", "vectors": "<i8", "distances": "<f8", "norms": "<f8", "positives": "<i8"}
BLOCK = "block long, n int, " + ", ".join(f"{name} binary" for name in ARRAYS)
NAMES = ["block", "n", *ARRAYS]


def quantized(scale: int):
    """Rows with key, label and vec (doubles), without those of which a component is null or not finite: vec scaled, as whole numbers, and the square of its norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(batch.schema.get_field_index("vec"))
            values = vec.flatten().to_numpy(zero_copy_only=False)  # null is NaN
            ends = np.concatenate(([0], np.cumsum(vec.value_lengths().to_numpy())))
            odd, values = np.concatenate(([0], np.cumsum(~np.isfinite(values)))), np.clip(np.floor(values * scale), -(2.0**63), 2.0**63)
            with np.errstate(invalid="ignore", over="ignore"):
                squares = np.add.reduceat(np.append(values * values, 0.0), ends[:-1]) if batch.num_rows else np.empty(0)
            squares[ends[1:] == ends[:-1]] = 0
            made = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.float64()))
            columns = [made if name == "vec" else c for name, c in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(squares, pa.float64())], names=[*batch.schema.names, "square"]).filter(pa.array(odd[ends[1:]] == odd[ends[:-1]]))

    return run


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((a - p) ** 2).sum(axis=1) for p in b], axis=1)) if len(b) else np.zeros((len(a), 0))


class PivotTable:
    """Pivots in the augmented space, and distances to them. What floating point gets wrong is covered by a margin of the distances."""

    def __init__(self, vectors: np.ndarray, norm2: float, pivots: int = PIVOTS) -> None:
        """vectors: a sample, of which pivots are picked: the first, then always the one furthest from those picked. norm2: the largest squared norm."""
        self.norm2 = norm2
        points = self.augmented(vectors)
        picked, far = [0], _distances(points, points[:1])[:, 0]
        while len(picked) < min(pivots, len(points)) and far.max() > 0:
            picked.append(int(far.argmax()))
            far = np.minimum(far, _distances(points, points[picked[-1:]])[:, 0])
        self.points = points[picked]
        self.margin = 1e-6 * (1 + math.sqrt(norm2))

    def augmented(self, vectors: np.ndarray) -> np.ndarray:
        x = vectors.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(self.norm2 - (x * x).sum(axis=1), 0))[:, None]])

    def of_rows(self, vectors: np.ndarray) -> np.ndarray:
        return _distances(self.augmented(vectors), self.points)

    def of_anchors(self, vectors: np.ndarray) -> np.ndarray:
        return _distances(np.hstack([vectors.astype(np.float64), np.zeros((len(vectors), 1))]), self.points)

    def brackets(self, norms: np.ndarray, dq: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the greatest score of each anchor (their squared norms and distances to the pivots) with points whose distances lie between low and high. A row for each anchor, a column for each point, or box of points."""
        near, far = np.zeros((len(dq), len(low))), np.full((len(dq), len(low)), np.inf)
        for j in range(dq.shape[1]):
            d = dq[:, j : j + 1]
            np.maximum(near, np.maximum(low[None, :, j] - d, d - high[None, :, j]), out=near)
            np.minimum(far, d + high[None, :, j], out=far)
        near, far = np.maximum(near - self.margin, 0), far + self.margin
        score = lambda d: (norms[:, None] + self.norm2 - d * d) / 2
        return np.floor(score(far)), np.ceil(score(near))

    def greatest(self, norms: np.ndarray, dq: np.ndarray, dx: np.ndarray) -> np.ndarray:
        """The greatest score of each point (its distances to the pivots) with any of some anchors."""
        near = np.maximum(np.maximum(dx - dq.max(axis=0), dq.min(axis=0) - dx).max(axis=1, initial=0) - self.margin, 0)
        return np.ceil((norms.max() + self.norm2 - near * near) / 2)


class Blocks:
    """Blocks of a table in the order of their numbers, as one array each; the arrays of a block are views of the table."""

    def __init__(self, table: pa.Table, dims: int, kind: str, prefix: str = "") -> None:
        order = np.argsort(table.column(f"{prefix}block").to_numpy(), kind="stable").tolist()
        for name, of in (ARRAYS | {"vectors": kind}).items():
            column = table.column(prefix + name)
            setattr(self, name, np.concatenate([np.frombuffer(column[i].as_buffer(), of) for i in order]))
        n = len(self.ids)
        self.vectors, self.distances, self.positives = self.vectors.reshape(n, dims), self.distances.reshape(n, -1), self.positives.reshape(-1, n, 2) if not len(self.positives) else self.positives.reshape(n, -1, 2)

    def tiles(self, size: int, label: int | None = None) -> list[np.ndarray]:
        """The places of so many rows at a time, of one label or of all."""
        at = np.arange(len(self.ids)) if label is None else np.flatnonzero(self.labels == label)
        return [at[i : i + size] for i in range(0, len(at), size)]


def kind_of(norm2: float) -> str:
    """In what numbers scores are exact: an inner product and all its partial sums are whole numbers of at most the largest squared norm."""
    return "<f4" if norm2 < 2**24 else "<f8" if norm2 < 2**53 else "<i8"


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, of a kind_of() their norms."""
    if a.dtype.kind == "i" and float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1] >= 2**56:
        raise OverflowError("vectors are too large: a hundred times a score must fit into a long")
    return a @ b.T


class Best:
    """The k best scores of each of some lists; ties go to the smaller key. floor: the least of a list that is full, which others must reach."""

    def __init__(self, lists: int, k: int) -> None:
        self.k, self.floor, self.worst = k, np.full(lists, NONE), np.full(lists, np.iinfo(np.int64).max)
        self.held, self.waiting = [np.empty(0, np.int64)] * 3, []

    def add(self, at: np.ndarray, keys: np.ndarray, scores: np.ndarray) -> None:
        """Scores of the lists at."""
        new = (scores > self.floor[at]) | (scores == self.floor[at]) & (keys < self.worst[at])
        self.waiting.append((at[new], keys[new], scores[new]))
        if sum(len(x[0]) for x in self.waiting) > len(self.floor):
            self.settle()

    def settle(self) -> list[np.ndarray]:
        """List, key and score of the best so far, by list and rank."""
        at, keys, scores = (np.concatenate(x) for x in zip(self.held, *self.waiting, strict=True))
        order = np.lexsort((keys, -scores, at))
        order = order[np.arange(len(at)) - np.searchsorted(at[order], at[order]) < self.k]
        self.held, self.waiting = [at[order], keys[order], scores[order]], []
        n = np.bincount(self.held[0], minlength=len(self.floor))
        last = (np.cumsum(n) - 1)[n == self.k]
        self.floor[n == self.k], self.worst[n == self.k] = self.held[2][last], self.held[1][last]
        return self.held


class Miner:
    """What tasks need: the pivot table, dimensions, and how many are wanted. low and high: between which shares of a positive's score a negative's lies, in hundredths."""

    def __init__(self, table: PivotTable, dims: int, positives: int, negatives: int, low: int, high: int, rows: int, anchors: int) -> None:
        self.table, self.dims, self.positives, self.negatives, self.low, self.high = table, dims, positives, negatives, low, high
        self.rows, self.anchors, self.kind = rows, anchors, kind_of(table.norm2)
        self.number = {"<f4": "float", "<f8": "double", "<i8": "long"}[self.kind]

    def matrix(self, vectors: pd.Series) -> np.ndarray:
        if len(vectors) and all(len(v) == self.dims for v in vectors):
            out = np.concatenate(vectors.to_list()).reshape(len(vectors), self.dims)
        else:
            out = np.zeros((len(vectors), self.dims))
            for i, v in enumerate(vectors):
                out[i, : len(v)] = v
        return (np.clip(out, -(2.0**62), 2.0**62) if self.kind == "<i8" else out).astype(self.kind, copy=False)

    def place(self, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows with their nearest pivot and the distance to it."""
        for pdf in parts:
            x = self.matrix(pdf["vec"])
            d = self.table.of_rows(x)
            yield pdf.assign(vec=list(x), pivot=d.argmin(axis=1).astype(np.int32), distance=d.min(axis=1, initial=np.inf))

    def pack(self, size: int, anchors: bool):
        """Blocks of rows, in the order in which they come. Their numbers don't repeat."""

        def block(number: int, pdf: pd.DataFrame) -> pd.DataFrame:
            x = self.matrix(pdf["vec"])
            known = np.full((len(pdf), self.positives, 2), NONE)
            for i, ps in enumerate(pdf["positives"] if "positives" in pdf else ()):
                for j, p in enumerate(ps):
                    known[i, j] = p["key"], p["score"]
            arrays = {
                "ids": pdf["id"], "keys": pdf["key"], "labels": pdf["label"], "vectors": x, "norms": (x.astype(np.float64) ** 2).sum(axis=1),
                "distances": self.table.of_anchors(x) if anchors else self.table.of_rows(x), "positives": known if anchors else known[:0],
            }
            return pd.DataFrame([(number, len(pdf), *[np.ascontiguousarray(arrays[a], kind).tobytes() for a, kind in (ARRAYS | {"vectors": self.kind}).items()])], columns=NAMES)

        def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            number, rest = TaskContext.get().partitionId() << 32, None
            for pdf in parts:
                rest = pdf if rest is None else pd.concat([rest, pdf])
                while len(rest) >= size:
                    yield block(number, rest[:size])
                    number, rest = number + 1, rest[size:]
            if rest is not None and len(rest):
                yield block(number, rest)

        return run

    def survivors(self, a: Blocks, at: np.ndarray, b: Blocks, rows: np.ndarray, least: np.ndarray, most: np.ndarray, enough: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the anchors `at` and which of the rows have a score between least and most (of each anchor), and the score: exact ones of the anchors that may want any row as far as brackets tell, with the rows that any of these may want. enough: not all are needed where an anchor has nothing yet, but those that score as high as so many of them. In order of anchors, best first, ties by key."""
        d, e = a.distances[at], b.distances[rows]
        low, high = self.table.brackets(a.norms[at], d, e.min(axis=0)[None], e.max(axis=0)[None])
        asks = np.flatnonzero((high[:, 0] >= least) & (low[:, 0] <= most))
        if not len(asks):
            return (np.empty(0, np.int64),) * 3
        among = rows[self.table.greatest(a.norms[at[asks]], d[asks], e) >= least[asks].min()]
        scores = products(a.vectors[at[asks]], b.vectors[among])
        limit = least[asks].astype(scores.dtype)
        if 0 < enough < len(among) and least[asks].min() == NONE:
            limit = np.maximum(limit, np.partition(scores, len(among) - enough, axis=1)[:, len(among) - enough])
        found = np.flatnonzero(scores >= limit[:, None])
        i, c = np.divmod(found, max(len(among), 1))
        i, scores = asks[i], scores.ravel()[found].astype(np.int64)
        within = scores <= most[i]
        i, c, scores = i[within], among[c[within]], scores[within]
        order = np.lexsort((b.keys[c], -scores, i))
        return i[order], c[order], scores[order]

    def best_positives(self, left: pa.Table, right: pa.Table) -> pa.Table:
        """id of an anchor, and key and score of its best rows of the same label. What an anchor has found rules out more."""
        out = [[np.empty(0, np.int64)] * 3]
        if left.num_rows and right.num_rows:
            a, b = Blocks(left, self.dims, self.kind, "a_"), Blocks(right, self.dims, self.kind)
            for label in np.intersect1d(a.labels, b.labels):
                tiles = b.tiles(self.rows, label)
                for at in a.tiles(self.anchors, label):
                    best = Best(len(at), self.positives)
                    for rows in tiles:
                        i, c, scores = self.survivors(a, at, b, rows, best.floor, np.full(len(at), np.inf), self.positives + 1)  # itself among them
                        other = a.ids[at[i]] != b.ids[c]
                        best.add(i[other], b.keys[c[other]], scores[other])
                    i, keys, scores = best.settle()
                    out.append([a.ids[at[i]], keys, scores])
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["id", "key", "score"])

    def best_negatives(self, left: pa.Table, right: pa.Table) -> pa.Table:
        """id of an anchor, the place of a positive among its positives, and the best rows of other labels within the shares of the positive's score."""
        out = [[np.empty(0, np.int64)] * 7]
        if left.num_rows and right.num_rows:
            a, b = Blocks(left, self.dims, self.kind, "a_"), Blocks(right, self.dims, self.kind)
            tiles = b.tiles(self.rows)
            for at in a.tiles(self.anchors):
                p = a.positives[at, :, 1]
                real = p != NONE
                p = np.where(real, p, 0)
                low, high = np.where(real, -((-self.low * p) // 100), np.iinfo(np.int64).max), np.where(real, self.high * p // 100, NONE)
                best = Best(low.size, self.negatives)
                for rows in tiles:
                    least = np.maximum(low, best.floor.reshape(low.shape))
                    i, c, scores = self.survivors(a, at, b, rows, least.min(axis=1), high.max(axis=1))
                    other = a.labels[at[i]] != b.labels[c]
                    i, c, scores = i[other], c[other], scores[other]
                    for j in range(self.positives):
                        within = np.flatnonzero((scores >= least[i, j]) & (scores <= high[i, j]))
                        within = within[np.arange(len(within)) - np.searchsorted(i[within], i[within]) < self.negatives]
                        best.add(i[within] * self.positives + j, b.keys[c[within]], scores[within])
                lists, keys, scores = best.settle()
                i, j = np.divmod(lists, self.positives)
                out.append([a.ids[at[i]], j, a.keys[at[i]], a.positives[at[i], j, 0], p[i, j], keys, scores])
        return pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["id", "place", "anchor", "positive", "positive_score", "negative", "negative_score"])


def hard_negatives(
    df: DataFrame, key: Column, label: Column, vec: Column, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, pivots: int = PIVOTS, sample: int = SAMPLE, rows: int = ROWS, anchors: int = ANCHORS
) -> DataFrame:
    """anchor_id, positive_id, rank (of the negative, from 1), negative_id, positive_score and negative_score. key, label, vec (an array of numbers, which are scaled) and anchor (whether a row is one): columns of df. low, high: a negative's score is at least and at most so many hundredths of the positive's."""
    spark = df.sparkSession
    used = df.select(key.cast("long").alias("key"), label.cast("long").alias("label"), vec.cast("array<double>").alias("vec"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    used = used.where("key IS NOT NULL AND label IS NOT NULL AND vec IS NOT NULL")
    used = written(used.mapInArrow(quantized(scale), "key long, label long, vec array<double>, anchor boolean, square double"))
    norm2, dims = used.agg(F.max("square"), F.max(F.size("vec"))).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not dims:
        return spark.createDataFrame([], out)
    first = used.orderBy(F.xxhash64("key", "vec")).select("vec").limit(sample).toPandas()
    of = lambda table: Miner(table, dims, positives, negatives, low, high, rows, anchors)
    miner = of(PivotTable(of(PivotTable(np.zeros((1, dims)), norm2)).matrix(first["vec"]), norm2, pivots))

    placed = used.select("key", "label", "vec", "anchor", F.monotonically_increasing_id().alias("id"))
    placed = placed.mapInPandas(miner.place, f"key long, label long, vec array<{miner.number}>, anchor boolean, id long, pivot int, distance double")
    # Written, so that a row's id and block stay what they are.
    placed = written(placed)
    order = ["pivot", "distance", "key"]
    blocks = written(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(miner.pack(rows, False), BLOCK))
    mine = placed.where("anchor").drop("anchor")
    n_rows, n_anchors, n_blocks = placed.count(), mine.count(), blocks.count()
    # Groups and slices are of bounded size. Each slice gives the few best of each anchor, so there are no more slices than that asks for, and cores.
    groups = max(math.ceil(n_anchors / (GROUP * anchors)), 1)
    slices = max(math.ceil(n_rows / (SLICE * rows)), min(n_blocks, math.ceil(2 * spark.sparkContext.defaultParallelism / groups)), 1)

    def against(chosen: DataFrame, step, schema: str) -> DataFrame:
        asked = written(chosen.repartitionByRange(groups, *order).sortWithinPartitions(*order).mapInPandas(miner.pack(anchors, True), BLOCK))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        # In turn, and beginning elsewhere in each task that made blocks.
        deal = lambda n: F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(0xFFFFFFFF), F.lit(n)).cast("int")
        place = ["group", "slice"]
        left = asked.select(deal(groups).alias("group"), every(slices).alias("slice"), *[F.col(c).alias(f"a_{c}") for c in NAMES])
        right = blocks.select(deal(slices).alias("slice"), every(groups).alias("group"), *NAMES)
        # Twice as many tasks as places in the grid, so that few of them get two.
        left, right = (x.repartition(2 * groups * slices, *place) for x in (left, right))
        return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(lambda a, b: step(a, b), schema)

    found = written(against(mine, miner.best_positives, "id long, key long, score long"))
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), "key"))).where(F.col("place") <= positives)
    chosen = found.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "key", "score"))), lambda p: F.struct(p["key"].alias("key"), p["score"].alias("score"))).alias("positives"))
    found = against(mine.join(chosen, "id"), miner.best_negatives, "id long, place long, anchor long, positive long, positive_score long, negative long, negative_score long")
    rank = F.row_number().over(Window.partitionBy("id", "place").orderBy(F.desc("negative_score"), "negative"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("negative").alias("negative_id"), "positive_score", "negative_score")
