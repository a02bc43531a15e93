"""Numbers without gaps for rows in an order, with no task that sees them all."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, the application's own below spark.checkpoint.dir; a temporary one only on a single machine where none is set, as in tests. It goes when the application ends, and intermediate tables with it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    path = spark._jvm.org.apache.hadoop.fs.Path(context.getCheckpointDir())
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed once, written to the shared folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows as a Parquet table in the shared folder, which is smaller than a checkpoint where rows hold arrays or texts."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str, first: Column | int = 0) -> DataFrame:
    """df with a column `name`: first, first + 1, ... in the order. Rows are dealt to ranges of the order and written; each range is numbered on its own, from where the ranges before it end. The driver gets a count for each range."""
    dealt = cut(df.repartitionByRange(*order)).withColumn("__range", F.spark_partition_id())
    at, starts = 0, []
    for r in dealt.groupBy("__range").agg(F.count("*").alias("n")).orderBy("__range").collect():
        starts.append((r["__range"], at))
        at += r["n"]
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, "__range int, __start long"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    first = F.lit(first) if isinstance(first, int) else first
    return dealt.join(starts, "__range").withColumn(name, (first + F.col("__start") + within - 1).cast("long")).drop("__range", "__start")


def running(df: DataFrame, order: list[str], sums: dict[str, str]) -> DataFrame:
    """df with, under each name of sums, the sum of a column over all rows before in the order; rows that tie have an order of their own. Ranges as in numbered()."""
    dealt = cut(df.repartitionByRange(*order)).withColumn("__range", F.spark_partition_id())
    totals = dealt.groupBy("__range").agg(*[F.sum(F.col(c).cast("double")).alias(n) for n, c in sums.items()]).orderBy("__range").collect()
    at, starts = dict.fromkeys(sums, 0.0), []
    for r in totals:
        starts.append((r["__range"], *[float(at[n]) for n in sums]))
        at = {n: at[n] + (r[n] or 0.0) for n in sums}
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, "__range int, " + ", ".join(f"__{n} double" for n in sums)))
    before = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    added = {n: F.col(f"__{n}") + F.coalesce(F.sum(F.col(c).cast("double")).over(before), F.lit(0.0)) for n, c in sums.items()}
    return dealt.join(starts, "__range").select(*df.columns, *[x.alias(n) for n, x in added.items()])
