"""The graph of commits: each names its parent. Ancestors are found by pointer jumping: a table says where a number of steps leads from each commit, and joined with itself it says it for twice as many. So a history of n commits needs log n joins, each over the commits alone, and no repo's history is in one task. Names are long, so commits are numbered first, the tables of steps hold numbers alone, and names are joined again at the end.

Heads are names of content and don't repeat within a repo; a commit that the log has twice counts once. A parent that the log doesn't have ends the walk, and is told by gaps().
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.model import REPO, ZERO_HEAD
from palimpsest.operators.numbering import written

ROUNDS = 64


def named(log: DataFrame) -> DataFrame:
    """id, publisher, repo, head and up (the name of the parent): a number for each commit, which holds as long as the table that is written here."""
    commits = log.select(*REPO, "head", F.col("parent").alias("up")).dropDuplicates([*REPO, "head"])
    return written(commits.select(F.monotonically_increasing_id().alias("id"), *REPO, "head", "up"))


def links(commits: DataFrame) -> DataFrame:
    """id and up, as numbers: a step from each commit of named() to its parent, where the log has it."""
    parents = commits.select(*REPO, F.col("head").alias("up"), F.col("id").alias("to"))
    return commits.where(F.col("up") != ZERO_HEAD).select("id", *REPO, "up").join(parents, [*REPO, "up"]).select("id", F.col("to").alias("up"))


def doubled(steps: DataFrame) -> DataFrame:
    """Twice as many steps; commits from which there are not so many go."""
    more = steps.select(F.col("id").alias("up"), F.col("up").alias("further"))
    return steps.join(more, "up").select("id", F.col("further").alias("up"))


def forks(log: DataFrame) -> DataFrame:
    """publisher, repo, parent and n: where n commits, more than one, come after the same one, or begin a repo."""
    return log.dropDuplicates([*REPO, "head"]).groupBy(*REPO, "parent").agg(F.count("*").alias("n")).where("n > 1")


def gaps(log: DataFrame) -> DataFrame:
    """publisher, repo, head and parent of the commits whose parent the log doesn't have."""
    known = log.select(*REPO, F.col("head").alias("parent")).distinct()
    return log.where(F.col("parent") != ZERO_HEAD).join(known, [*REPO, "parent"], "left_anti").select(*REPO, "head", "parent").distinct()


def depths(log: DataFrame) -> DataFrame:
    """publisher, repo, head, depth (1 for a commit without a parent in the log) and first, the commit at which its history begins."""
    commits = named(log)
    step = F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")
    at = written(commits.select("id").join(links(commits), "id", "left").select("id", F.coalesce("up", "id").alias("first"), step.alias("steps"), step.alias("more")))
    for _ in range(ROUNDS):
        if not at.where("more > 0").take(1):
            break
        # Who came to where a history begins is done.
        on = at.where("steps > 0").select(F.col("id").alias("first"), F.col("first").alias("further"), F.col("steps").alias("on"))
        moved = at.where("more > 0").join(on, "first", "left").select("id", F.coalesce("further", "first").alias("first"), (F.col("steps") + F.coalesce("on", F.lit(0))).alias("steps"), F.coalesce("on", F.lit(0)).alias("more"))
        at = written(at.where("more = 0").unionByName(moved))
    else:
        raise RuntimeError("commits are their own ancestors")
    first = commits.select(F.col("id").alias("first"), F.col("head").alias("begins"))
    ends = commits.select("id", *REPO, "head").join(at.select("id", "first", "steps"), "id")
    return ends.join(first, "first").select(*REPO, "head", (F.col("steps") + 1).alias("depth"), F.col("begins").alias("first"))


def ancestors(commits: DataFrame, of: DataFrame) -> DataFrame:
    """The columns of `of`, all numbers, and id: each commit itself and all its ancestors. commits: named(); of: commit, a number, and further columns."""
    steps = [written(links(commits))]
    while steps[-1].take(1):
        if len(steps) == ROUNDS:
            raise RuntimeError("commits are their own ancestors")
        steps.append(written(doubled(steps[-1])))
    found = of.withColumn("id", F.col("commit"))
    for far in steps[:-1]:
        # Who has all ancestors within 2^k steps has, 2^k steps on, all within twice as many, and none of them twice.
        more = found.join(far, "id").drop("id").withColumnRenamed("up", "id").select(found.columns)
        found = written(found.unionByName(more))
    return found


def commits_between(log: DataFrame, spans: DataFrame) -> DataFrame:
    """publisher, repo, from, to and head: the commits that `to` has in its history, itself included, and `from` has not; a null `from` has none. spans: publisher, repo, from and to. On a fork this is one side of it."""
    commits = named(log)
    ends = written(spans.select(*REPO, "from", "to").where(F.col("to").isNotNull()).distinct().select(F.monotonically_increasing_id().alias("span"), "*"))
    both = ends.select("span", *REPO, F.col("to").alias("head"), F.lit(True).alias("after")).unionByName(ends.where(F.col("from").isNotNull()).select("span", *REPO, F.col("from").alias("head"), F.lit(False).alias("after")))
    asked = both.join(commits, [*REPO, "head"]).select("span", "after", F.col("id").alias("commit"))
    every = ancestors(commits, asked).groupBy("span", "id").agg(F.min("after").alias("after")).where("after").select("span", "id")
    return every.join(commits.select("id", "head"), "id").join(ends, "span").select(*REPO, "from", "to", "head")
