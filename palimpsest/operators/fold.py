"""Folds: a deterministic, ordered reduction of the log. Events of one key are in order; keys are independent, and so are dealt to tasks."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.model import KEY, REPO
from palimpsest.operators.log import matches
from palimpsest.operators.numbering import numbered


def events(log: DataFrame, patterns: list[str], first: int = 0, last: int | None = None) -> DataFrame:
    """The followed commits of blocks first to last, both included. To resume, go on from the block behind the last."""
    rows = log.where(matches(patterns) & (F.col("t") >= first))
    return rows if last is None else rows.where(F.col("t") <= last)


def commits(log: DataFrame, changes: DataFrame) -> DataFrame:
    """The log with puts (id, cid, type, payload) and deletes (ids) of each commit, against the records of its parent: a put counts if it is of another version, a delete if the record was there. Commits without changes have empty arrays. A commit's changes fit into a row; a repo's history is never gathered."""
    was = F.lag(F.when(F.col("op") == "put", F.col("cid"))).over(Window.partitionBy(*KEY).orderBy("pos"))
    counts = F.when(F.col("op") == "put", ~F.col("cid").eqNullSafe(F.col("was"))).otherwise(F.col("was").isNotNull())
    real = changes.withColumn("was", was).where(counts)
    put = F.when(F.col("op") == "put", F.struct("id", "cid", "type", "payload"))
    gone = F.when(F.col("op") == "delete", F.col("id"))
    grouped = real.groupBy("pos").agg(F.array_sort(F.collect_list(put)).alias("puts"), F.array_sort(F.collect_list(gone)).alias("deletes"))
    both = log.join(grouped, "pos", "left")
    return both.withColumns({"puts": F.coalesce("puts", F.array().cast("array<struct<id: string, cid: string, type: string, payload: string>>")), "deletes": F.coalesce("deletes", F.array().cast("array<string>"))})


def fold_groups(rows: DataFrame, key: list[str], reduce: Callable[[dict, dict], dict], state_json: Callable[[dict], str], order: str = "pos", start: DataFrame | None = None, load: Callable[[str], dict] = json.loads) -> DataFrame:
    """key and state, as JSON: reduce(state, event) in Python over the events of each key. start: key and state of an earlier fold, which load() reads, to go on from. Rows are dealt and sorted by Spark, and stream through the task, so a key's history is never held as a whole."""
    columns = rows.columns
    rows = rows.withColumn("__start", F.lit(None).cast("string"))
    if start is not None:
        rows = rows.unionByName(start.select(*key, F.col("state").cast("string").alias("__start")), allowMissingColumns=True)
    # A state to start from comes before all events.
    ordered = rows.repartition(*key).sortWithinPartitions(*key, F.col("__start").isNull(), order)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*key).schema.fields)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, {}
        for pdf in parts:
            done = []
            for *values, began in pdf[[*columns, "__start"]].itertuples(index=False, name=None):
                event = dict(zip(columns, values, strict=True))
                k = tuple(event[c] for c in key)
                if k != at:
                    if at is not None:
                        done.append((*at, state_json(state)))
                    at, state = k, {}
                state = load(began) if isinstance(began, str) else reduce(state, event)
            if done:
                yield pd.DataFrame(done, columns=[*key, "state"])
        if at is not None:
            yield pd.DataFrame([(*at, state_json(state))], columns=[*key, "state"])

    return ordered.mapInPandas(run, f"{schema}, state string")


def fold_all(rows: DataFrame, reduce: Callable[[object, dict], object], state: object, order: str = "pos") -> object:
    """A fold whose order spans all keys is sequential: rows are range-sorted by Spark and come to the driver a partition at a time."""
    for event in rows.orderBy(order).toLocalIterator(prefetchPartitions=True):
        state = reduce(state, event.asDict(recursive=True))
    return state


def first_claims(rows: DataFrame, slot: str, by: str = "publisher", order: str = "pos") -> DataFrame:
    """slot, owner and claims: the first to claim a slot owns it."""
    return rows.groupBy(slot).agg(F.min_by(by, order).alias("owner"), F.count("*").alias("claims"))


def metering(rows: DataFrame, amount: str, payer: str, payload: str | None = None, failed: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """Sums of a range of the log, whole or by columns: number, total, distinct payers, bytes of payloads, and how many failed."""
    more = [] if payload is None else [F.sum(F.octet_length(payload)).alias("bytes")]
    more += [] if failed is None else [F.count_if(failed).alias("reverted")]
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.sum(amount).alias("total"), F.countDistinct(payer).alias("payers"), *more)


def growth(changes: DataFrame, sizes: list[int]) -> DataFrame:
    """How an index grows with those whom it follows: for each number n of publishers, taken in the order in which they first came, followers (fewer, if there are not so many), commits, records there are at the end, embeds (puts of another version than before, which a follower embeds), and reverted (changes that change nothing). One pass for all numbers: a change counts for every n that its publisher is among."""
    came = changes.groupBy("publisher").agg(F.min("pos").alias("first"))
    order = numbered(came, ["first", "publisher"], "number")
    was = F.lag(F.when(F.col("op") == "put", F.col("cid"))).over(Window.partitionBy(*KEY).orderBy("pos"))
    real = F.when(F.col("op") == "put", ~F.col("cid").eqNullSafe(F.col("was"))).otherwise(F.col("was").isNotNull())
    last = F.lead("pos").over(Window.partitionBy(*KEY).orderBy("pos")).isNull() & (F.col("op") == "put")
    told = changes.withColumn("was", was).withColumn("last", last).withColumn("real", real)
    each = told.groupBy("publisher").agg(F.count("*").alias("commits"), F.count_if("last").alias("records"), F.count_if(F.col("real") & (F.col("op") == "put")).alias("embeds"), F.count_if(~F.col("real")).alias("reverted"))
    among = each.join(order, "publisher").withColumn("n", F.explode(F.array(*[F.lit(n) for n in sizes]))).where(F.col("number") < F.col("n"))
    return among.groupBy("n").agg(F.count("*").alias("followed"), *[F.sum(c).alias(c) for c in ("commits", "records", "embeds", "reverted")])


def state_hash(state: object) -> str:
    """A name for a state: whoever folds the same log by the same rules gets the same one."""
    return hashlib.sha256(json.dumps(state, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()[:16]


def claims(state: dict | None, event: dict) -> dict:
    """A reducer: a commit of one put, whose payload names a slot that is free, owns the slot; any other commit is rejected as a whole. The state is changed in place, so that a fold of n commits costs n steps."""
    state = state or {"owner": {}, "rejected": 0, "commits": 0}
    slot = json.loads(event["puts"][0]["payload"]).get("slot") if len(event["puts"]) == 1 and not event["deletes"] else None
    if slot is None or slot in state["owner"]:
        state["rejected"] += 1
    else:
        state["owner"][slot] = event["publisher"]
    state["commits"] += 1
    return state


def fold_several(rows: DataFrame, key: list[str], reducers: dict[str, Callable[[dict, dict], dict]], state_json: Callable[[dict], str] = json.dumps, order: str = "pos") -> DataFrame:
    """key and a column for each reducer: several folds over one pass of the events, which are dealt and sorted once. So rules are compared without folding the log for each of them."""

    def every(state: dict, event: dict) -> dict:
        return {n: r(state.get(n, {}), event) for n, r in reducers.items()}

    both = fold_groups(rows, key, every, lambda s: json.dumps({n: state_json(x) for n, x in s.items()}), order)
    return both.select(*key, *[F.get_json_object("state", f"$.{n}").alias(n) for n in reducers])


def owners(log: DataFrame, changes: DataFrame, path: str = "$.slot") -> DataFrame:
    """slot, owner, and the position of the claim, as claims() gives them, without going through one task: only commits of one put count, and of those the first of each slot. Its other commits are rejected."""
    c = commits(log, changes).where((F.size("puts") == 1) & (F.size("deletes") == 0))
    slot = F.get_json_object(F.col("puts")[0]["payload"], path)
    first = c.select(*REPO, "pos", slot.alias("slot")).where("slot IS NOT NULL")
    return first.groupBy("slot").agg(F.min_by("publisher", "pos").alias("owner"), F.min("pos").alias("pos"))
