"""The tables of the record index, and how the fixed test tables stand for them.

records:    rowseq, publisher, repo, id, cid, type, payload (JSON), text
verdicts:   publisher, repo, id, cid, checker, reason (null: let in)
update_log: pos, t, ts, publisher, repo, parent, head
changes:    publisher, repo, head, pos, id, op ('put' or 'delete'), cid, type, payload
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

KEY = ["publisher", "repo", "id"]
REPO = ["publisher", "repo"]
ZERO_HEAD = "0x0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def type_of(n_chars: Column) -> Column:
    return F.when(n_chars < 500, "note").when(n_chars < 3000, "page").otherwise("book")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each document: its source publishes it in the repo of its language."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("rowseq"),
        F.col("source").alias("publisher"),
        F.col("lang").alias("repo"),
        F.col("doc_id").cast("string").alias("id"),
        F.sha2("text", 256).alias("cid"),
        type_of(F.col("n_chars")).alias("type"),
        F.to_json(F.struct("text", "n_chars")).alias("payload"),
        "text",
    )


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for each labelled document; every seventh is on an older version of it."""
    labels = table(spark, sf_dir, "labels")
    d = table(spark, sf_dir, "documents")
    reason = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low quality")
    return d.join(labels, "doc_id").select(
        F.col("source").alias("publisher"),
        F.col("lang").alias("repo"),
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.sha2("text", 256)).alias("cid"),
        F.concat(F.lit("check-"), type_of(F.col("n_chars"))).alias("checker"),
        reason.alias("reason"),
    )


def update_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit for each event: the user publishes in the repo of the event's type. t counts hundreds of positions, as blocks do."""
    e = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("pos"), F.floor(F.col("event_id") / 100).cast("long").alias("t"), "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("publisher"), F.col("event_type").alias("repo")
    )
    head = F.sha2(F.concat_ws("/", "publisher", "repo", F.col("pos").cast("string")), 256)
    e = e.withColumn("head", head)
    return e.withColumn("parent", F.coalesce(F.lag("head").over(Window.partitionBy(*REPO).orderBy("pos")), F.lit(ZERO_HEAD)))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single change of each commit: errors delete the record that other events put."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("pos"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("publisher"),
        F.lit("events").alias("repo"),
        F.get_json_object("props", "$.k").alias("id"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        F.when(F.col("event_type") != "error", F.sha2(F.concat_ws("|", "event_type", F.col("props")), 256)).alias("cid"),
        F.col("event_type").alias("type"),
        F.col("props").alias("payload"),
    )


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A repo for each vector: with a card or without, and some without a vector."""
    e = table(spark, sf_dir, "embeddings")
    id, label = F.col("vec_id").cast("string"), F.col("label").cast("string")
    about = F.when(F.col("vec_id") % 3 != 0, F.concat(F.lit("about "), label))
    return e.select(
        F.concat(F.lit("p"), label).alias("publisher"),
        F.concat(F.lit("r"), id).alias("repo"),
        F.sha2(id, 256).alias("head"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(secs=F.floor(F.col("vec_id") / 3).cast("decimal(18,6)"))).alias("updated"),
        F.lit(None).cast("string").alias("card_url"),
        F.when(F.col("vec_id") % 4 != 0, F.to_json(F.struct(F.concat(F.lit("card "), id).alias("name"), about.alias("description")))).alias("card"),
        F.concat(F.lit("r"), id).alias("text"),
        F.when(F.col("vec_id") % 5 != 0, F.col("embedding")).alias("vec"),
        F.lit(False).alias("stale"),
    )
