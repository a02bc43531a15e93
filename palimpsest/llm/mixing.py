"""Mixing sources to target weights by weighted fair queueing. Every document of a source, in shuffled order, gets a virtual finish time: the words of its source up to and with it, divided by the source's target. All sources finish their targets at time 1, so the documents of the mix are those with the smallest finish times, cut where the budget is spent.

Sources in code point order, null last, take the weights in turn. The budget is a share of all words. A target stops at max_epochs times its source's words; what it can't use is shared among the others by weight.

Documents are dealt by a hash, so that no source, however large, meets in one task: words are summed for each source and range of hashes, and the sums are then carried on. Null and empty texts have size 0 and are never taken. Repeated rows count as often as they occur. An empty table gives an empty result. A rerun gives the same mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, n_words
from palimpsest.operators.numbering import numbered, running

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = 17
#: log2 of the number of ranges of hashes a source.
RANGE_BITS = 12
#: Ranges of finish times in which words are summed to find where the budget ends; each level looks into one range of the level before.
SLICES = 4096
LEVELS = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """A row for each source of sizes (source, size): source_key, source, source_size and target.

    Sources fill like vessels of width weight and volume epochs * size: in the order of size by weight, a source is full if the level at which the rest would stand is above its brim. Sources are numbered, and what lies before each is summed, by ranges of their order, so that no task sees them all, however many there are.
    """
    by_source = sizes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    by_source = numbered(by_source.withColumn("none", F.col("source").isNull()), ["none", "source"], "turn").drop("none")
    by_source = by_source.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights)).cast("int"))).drop("turn")
    volume = epochs * F.col("source_size").cast("double")
    by_source = cut(by_source.withColumns({"volume": volume, "brim": volume / F.col("weight")}))
    words, width = by_source.agg(F.sum("source_size"), F.sum("weight")).first()
    if not words:
        return by_source.select("source_key", "source", "source_size", F.lit(0.0).alias("target"))
    before = running(by_source, ["brim", "source_key"], {"full": "volume", "taken": "weight"})
    level = F.try_divide(F.lit(float(words) * share) - F.col("full"), F.lit(float(width)) - F.col("taken"))
    first = before.withColumn("level", level).where("brim > level").agg(F.min_by("level", F.struct("brim", "source_key"))).first()[0]
    target = F.col("volume") if first is None else F.least("volume", F.lit(first) * F.col("weight"))
    return by_source.select("source_key", "source", "source_size", target.alias("target"))


def queue(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """A row for each row of df: its place in the queue of its source, and its finish time in the first epoch. One pass over the texts."""
    sizes = df.select(df[key].alias("key"), df[source].alias("source"), n_words(df[text]).alias("size"))
    sizes = sizes.withColumn("source_key", F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")))
    sizes = cut(sizes.withColumn("hash", F.xxhash64(F.lit(seed), "key")))
    sizes = sizes.withColumn("range", F.shiftright("hash", 64 - RANGE_BITS))
    sums = sizes.groupBy("source_key", "range").agg(F.sum("size").alias("sum"))
    sums = sums.withColumn("start", F.sum("sum").over(Window.partitionBy("source_key").orderBy("range")) - F.col("sum"))
    starts = sums.join(targets(sizes, weights, share, epochs).drop("source"), "source_key").select("source_key", "range", "start", "source_size", "target")
    placed = sizes.join(starts, ["source_key", "range"])
    within = Window.partitionBy("source_key", "range").orderBy("hash", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return cut(placed.withColumn("end", F.col("start") + F.sum("size").over(within)).select("key", "source", "size", "source_size", "target", "hash", "end"))


def budget_end(items: DataFrame, budget: float) -> tuple[tuple, bool] | None:
    """(item, whether it is in the mix): what stands before the item in the order of finish, hash and key is in the mix, what stands behind it is not. None if all items fit.

    items: key, size, hash, finish. Words are summed in slices of finish times, then in slices of the slice where the budget ends, and so on; the driver gets at most SLICES + 1 sums each time.
    """
    spent, low, high = 0, 0.0, items.agg(F.max("finish")).first()[0] or 0.0
    for _ in range(LEVELS):
        width = (high - low) / SLICES or 1.0
        items = items.withColumn("slice", F.floor((F.col("finish") - low) / width))
        at = None
        for s in items.groupBy("slice").agg(F.sum("size").alias("sum")).orderBy("slice").collect():
            if spent + s["sum"] > budget:
                at = s["slice"]
                break
            spent += s["sum"]
        if at is None:
            return None
        items = items.where(F.col("slice") == at)
        low, high = low + at * width, low + (at + 1) * width
    order = Window.orderBy("finish", "hash", "key")
    edge = items.withColumn("spent", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + spent)
    place = F.struct("finish", "hash", "key")
    last, first = edge.agg(F.max(F.when(F.col("spent") <= budget, place)), F.min(place)).first()
    return (tuple(last), True) if last else (tuple(first), False)


def mix(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """For each row of df: key, source, size (words), source_size, target (words of its source in the mix) and epochs_taken, how often the mix takes it."""
    queued = queue(df, key, text, source, weights, share, epochs, seed)
    finish = [F.try_divide(e * F.col("source_size") + F.col("end"), F.col("target")) for e in range(epochs)]
    items = queued.where("size > 0").select("key", "size", "hash", F.explode(F.array(*finish)).alias("finish")).where("finish IS NOT NULL")
    end = budget_end(items, share * (queued.agg(F.sum("size")).first()[0] or 0))

    def inside(f: Column) -> Column:
        if end is None:
            return f.isNotNull()
        (at, hash_at, key_at), itself = end
        same = (f == at) & (F.col("hash") == hash_at)
        here = F.col("key").eqNullSafe(F.lit(key_at))
        before = F.coalesce(F.col("key") < F.lit(key_at), F.lit(False))
        return F.coalesce((f < at) | ((f == at) & (F.col("hash") < hash_at)) | (same & (before | (here & F.lit(itself)))), F.lit(False))

    taken = sum((F.when((F.col("size") > 0) & inside(f), 1).otherwise(0) for f in finish), F.lit(0))
    return queued.select(F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", taken.cast("int").alias("epochs_taken"))


def mixed_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The rows of df, each as often as the mix takes it. Rows that share key and source stand or fall together: each is taken as often as the most taken of them."""
    taken = mix(df, key, text, source, **options).where("epochs_taken > 0").groupBy(F.col(key).alias("k_"), F.col(source).alias("s_")).agg(F.max("epochs_taken").alias("n_"))
    joined = df.join(taken, df[key].eqNullSafe(taken["k_"]) & df[source].eqNullSafe(taken["s_"]))
    # As a struct, so that no name of df's columns is in the way.
    rows = joined.select(F.struct(*[df[c] for c in df.columns]).alias("row"), taken["n_"].alias("n"))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
