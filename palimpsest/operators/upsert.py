"""Set operations by primary key: upsert, delete, fill in what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.model import KEY
from palimpsest.operators.numbering import numbered, written
from palimpsest.sources.store import Delta


def upsert(old: DataFrame, new: DataFrame, key: list[str] = KEY, seq: str = "rowseq") -> DataFrame:
    """old with the rows of new in place of those with the same key. A replaced row keeps its seq; rows that are new are numbered on from the largest, in key order. new has all columns of old but seq."""
    kept = old.join(new.select(*key), key, "left_anti")
    merged = new.join(old.select(*key, seq), key, "left")
    fresh = merged.where(F.col(seq).isNull()).drop(seq)
    most = old.agg(F.coalesce(F.max(seq), F.lit(-1)).alias("most"))
    # One row: broadcast is safe.
    fresh = numbered(fresh, key, seq).crossJoin(F.broadcast(most)).withColumn(seq, F.col("most") + 1 + F.col(seq)).drop("most")
    return kept.unionByName(merged.where(F.col(seq).isNotNull()).select(old.columns)).unionByName(fresh.select(old.columns))


def delete(old: DataFrame, keys: DataFrame, key: list[str] = KEY) -> DataFrame:
    return old.join(keys.select(*key), key, "left_anti")


def delete_verdicts(verdicts: DataFrame, gone: DataFrame, key: list[str] = KEY) -> DataFrame:
    """verdicts without those on deleted records (gone: keys): a verdict goes with its record."""
    return delete(verdicts, gone, key)


def delta(records: DataFrame, changes: DataFrame, key: list[str] = KEY, seq: str = "rowseq") -> Delta:
    """What apply_changes() changes, alone: rows to put, with the seq that their key has or with new ones behind the largest, and keys to delete. records are only looked up, by the keys of the changes; no more than the changes is written."""
    # Each is used several times, and what lies behind them is a diff and a merge of segments.
    changes = written(changes)
    puts = changes.where("op = 'put'").select([c for c in records.columns if c != seq])
    found = written(puts.join(records.select(*key, seq), key, "left"))
    most = records.agg(F.coalesce(F.max(seq), F.lit(-1)).alias("most"))
    # One row: broadcast is safe.
    fresh = numbered(found.where(F.col(seq).isNull()).drop(seq), key, seq).crossJoin(F.broadcast(most)).withColumn(seq, F.col("most") + 1 + F.col(seq)).drop("most")
    both = written(found.where(F.col(seq).isNotNull()).select(records.columns).unionByName(fresh.select(records.columns)))
    return Delta(key, both, changes.where("op = 'delete'").select(*key))


def apply_changes(records: DataFrame, changes: DataFrame, key: list[str] = KEY) -> DataFrame:
    """records after puts and deletes. changes: key, op and the other columns of records but rowseq. Applying them twice changes nothing more."""
    puts = changes.where("op = 'put'").select([c for c in records.columns if c != "rowseq"])
    return upsert(delete(records, changes.where("op = 'delete'"), key), puts, key)


def backfill(index: DataFrame, rows: DataFrame, key: list[str] = KEY) -> DataFrame:
    """index and the rows whose key it lacks."""
    return index.unionByName(rows.select(index.columns).join(index.select(*key), key, "left_anti"))
