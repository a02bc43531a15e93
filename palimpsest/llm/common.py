"""What the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators.numbering import cut, shared_dir

#: The white space that ends a word, as a character class of Java's and Python's regular expressions.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """The same as a Parquet table, which is smaller than a checkpoint. It takes one job, where a checkpoint makes the rows twice, and small files are read several to a task, so that a chain of many small tables leaves the driver few tasks to keep account of."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int) -> DataFrame:
    """df, to be broadcast in a join if it has few rows, else to be joined by a shuffle whatever size Spark takes it for: it takes a table for its bytes as compressed, and for as many rows as before an explode."""
    return F.broadcast(df) if df.count() <= most else df.hint("merge")


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words of a text in order; none for null. Splitting at one plain character is several times as fast as at a class, so the other characters are made blanks first."""
    text = F.coalesce(text, F.lit(""))
    for c in SPACE_CHARS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_hashes(words: Column) -> Column:
    """The 64-bit hash of each word."""
    return F.transform(words, lambda w: F.xxhash64(w))


def window_hashes(hashes: Column, n: int) -> Column:
    """The 64-bit hash of every run of n words; empty for fewer words. hashes: word_hashes(), as a column of the frame, as each window looks it up n times."""
    runs = F.transform(hashes, lambda x, i: F.xxhash64(x, *[F.get(hashes, i + k) for k in range(1, n)]))
    return F.slice(runs, F.lit(1), F.greatest(F.size(hashes) - (n - 1), F.lit(0)))


SEED = 42
#: Hashes made at once.
BLOCK = 1 << 13


def shingle_hashes(text: str | None, shingle: int) -> tuple[int, Iterator[np.ndarray]]:
    """How many shingles a text has, repeats included, and their XXH64 hashes in blocks. A-Z count as a-z; fewer words than a shingle make one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return 0, iter(())
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(len(words) - shingle + 1, 1)
    first = np.concatenate(([0], ends[: n - 1] + 1))
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]

    def blocks() -> Iterator[np.ndarray]:
        for at in range(0, n, BLOCK):
            yield np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(first[at : at + BLOCK].tolist(), last[at : at + BLOCK].tolist(), strict=True)), "<u8")

    return n, blocks()


__all__ = ["cut", "let", "n_words", "shared_dir", "shingle_hashes", "small", "table", "window_hashes", "word_hashes", "words", "written"]
