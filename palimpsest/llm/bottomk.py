"""Bottom-k sketches of documents: the k smallest hashes of the distinct shingles of a text. Sketches of parts merge into the sketch of the whole, and two sketches estimate resemblance (Jaccard), containment and the number of distinct shingles.

A sketch is an ascending array of at most k longs. A text of fewer words than a shingle has one shingle, all of its words; a text without words has none and an empty sketch; null counts as empty. Two empty sketches resemble each other fully, an empty and another one not at all. Equal texts have equal sketches; repeated rows stay. Whole texts are hashed, however long. Of rows with one key the next is that with the next larger text. Other columns stay out of it, whatever their names, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import let, window_hashes, word_hashes, words

SHINGLE = 5
K = 128


def shingle_hashes(hashes: Column, n: int = SHINGLE) -> Column:
    """Hashes of the shingles, repeats included. hashes: word_hashes(), as a column of the frame."""
    return F.when((F.size(hashes) > 0) & (F.size(hashes) < n), F.array(F.xxhash64(hashes))).otherwise(window_hashes(hashes, n))


def sketch(hashes: Column, k: int = K, n: int = SHINGLE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(hashes, n))), 1, k)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, n: int = SHINGLE) -> DataFrame:
    """df and the sketch of its column text. The words' hashes stand in a column of their own for a moment, so that they are computed once."""
    held = f"{name}__hashes"
    return df.withColumn(held, word_hashes(words(F.col(text)))).withColumn(name, sketch(F.col(held), k, n)).drop(held)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both together. It is associative, so that sketches of parts merge in any order."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_groups(df: DataFrame, keys: list[str], name: str = "sketch", k: int = K) -> DataFrame:
    """A sketch for each group: the k smallest distinct hashes of its sketches. Distinct hashes are ranked where they are, before and after the shuffle, so that a large group is never gathered."""
    hashes = df.select(*keys, F.explode(name).alias("hash")).distinct()
    ranked = hashes.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("hash"))).where(F.col("rank") <= k)
    return ranked.groupBy(*keys).agg(F.sort_array(F.collect_list("hash")).alias(name))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity, exact if both texts together have at most k distinct shingles."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(
        let(merge(a, b, k), lambda both: F.size(F.array_intersect(F.array_intersect(a, b), both)) / F.size(both))
    )


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles; exact below k."""
    share = (F.get(a, F.lit(k - 1)).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    j = resemblance(a, b, k)
    both = j / (1 + j) * (distinct_shingles(a, k) + distinct_shingles(b, k))
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def to_hex(a: Column) -> Column:
    """A sketch as text: 16 lower-case hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def with_next(df: DataFrame, key: str, columns: dict[str, str], tie: str, buckets: int | None = None) -> DataFrame:
    """df and, under the new names in columns, what the row with the next larger key has; after the last row comes the first.

    Rows are dealt into ranges of the integer key, and lead() runs within each. A copy of the first row of a range goes to the end of the range before. Ranges come from approximate quantiles, one for each of a number of buckets that follows from the shuffle partitions, so what the driver holds is bounded by the cluster and not by the data. Null keys come first; equal keys are in the order of the column tie.
    """
    spark = df.sparkSession
    buckets = buckets or min(4096, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.select(F.percentile_approx(key, [i / buckets for i in range(1, buckets)] or [0.5], F.lit(20 * buckets)).alias("cuts")).first()["cuts"]
    cuts = sorted(set(cuts or []))
    bounds, steps = F.array(*[F.lit(x) for x in cuts]).cast("array<bigint>"), [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    bucket = F.aggregate(
        F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, step: F.when(F.coalesce(F.col(key) >= F.get(bounds, at + step - 1), F.lit(False)), at + step).otherwise(at)
    )
    # At most one row for each bucket.
    firsts = sorted(tuple(r) for r in df.select(key).groupBy(bucket.alias("b")).agg(F.when(F.count("*") == F.count(key), F.min(key))).collect())
    before = [(first, firsts[i - 1][0], int(i == 0)) for i, (_, first) in enumerate(firsts)]
    before = spark.createDataFrame(before or [], "first bigint, to int, wrap int")
    moved = df.withColumn("__bucket", bucket).join(F.broadcast(before), F.col(key).eqNullSafe(before["first"]), "left")
    place = lambda b, copy, wrap: F.struct(b.alias("bucket"), F.lit(copy).alias("copy"), wrap.alias("wrap"))
    moved = moved.withColumn("__at", F.explode(F.filter(F.array(place(F.col("__bucket"), False, F.lit(0)), place(F.col("to"), True, F.col("wrap"))), lambda x: x["bucket"].isNotNull())))
    moved = moved.select(*df.columns, F.col("__at.bucket").alias("__bucket"), F.col("__at.copy").alias("__copy"), F.col("__at.wrap").alias("__wrap"))
    order = Window.partitionBy("__bucket").orderBy("__wrap", F.col(key).asc_nulls_first(), F.col(tie).asc_nulls_first())
    return moved.select("*", *[F.lead(a).over(order).alias(b) for a, b in columns.items()]).where(~F.col("__copy")).drop("__bucket", "__copy", "__wrap")


def against_edits(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = K, n: int = SHINGLE) -> DataFrame:
    """Each document beside an edited text, whose last quarter (rounded down, in code points) is replaced by as many of the first code points of the next document.

    Columns: the key, text, n_chars, sketch, edited, edited_sketch, next_sketch.
    """
    docs = df.select(df[key].alias("key"), F.coalesce(df[text], F.lit("")).alias("text"))
    docs = with_next(with_sketch(docs, "text", "sketch", k, n), "key", {"text": "next_text", "sketch": "next_sketch"}, "text")
    docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.col("next_text"), F.lit(1), quarter)))
    return with_sketch(docs, "edited", "edited_sketch", k, n).drop("next_text").withColumnRenamed("key", key)
