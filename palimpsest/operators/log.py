"""The update log: patterns, snapshots of heads (stitches), and differences between them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.model import KEY, REPO


def matches(patterns: list[str]) -> Column:
    """Rows that one of the patterns names: `publisher/repo`, `repo` of any publisher, `*` for all, `/regex/` over publisher/repo. Publishers match in any case."""
    pairs = [p.lower().split("/", 1)[0] + "/" + p.split("/", 1)[1] for p in patterns if "/" in p and not p.startswith("/")]
    bare = [p for p in patterns if "/" not in p and p != "*"]
    full = F.concat(F.lower("publisher"), F.lit("/"), F.col("repo"))
    kept = F.lit("*" in patterns)
    if pairs:
        kept = kept | full.isin(pairs)
    if bare:
        kept = kept | F.col("repo").isin(bare)
    for p in patterns:
        if p.startswith("/"):
            kept = kept | full.rlike(p.removeprefix("/").removesuffix("/"))
    return kept


def patterns_of(follow: list[str] | None = None, publishers: list[str] | None = None, repos: list[str] | None = None) -> list[str]:
    """follow as it is; else each repo of each publisher; else the repos of any."""
    if follow:
        return follow
    return [f"{p}/{r}" for p in publishers for r in repos or []] if publishers else list(repos or [])


def repo_names(patterns: list[str]) -> list[str] | None:
    """Distinct repo names in the patterns, in order; None if one can match any name."""
    if any(p == "*" or p.startswith("/") for p in patterns):
        return None
    return list(dict.fromkeys(p.split("/", 1)[-1] for p in patterns))


def expanded(publishers: DataFrame, repos: DataFrame) -> DataFrame:
    """pattern: each repo of each publisher, from tables of names (publisher; repo)."""
    # One row: the names of a configuration.
    names = repos.agg(F.collect_set("repo").alias("repos"))
    return publishers.select("publisher").distinct().crossJoin(F.broadcast(names)).select("publisher", F.explode("repos").alias("repo")).select(F.concat("publisher", F.lit("/"), "repo").alias("pattern"))


def pattern_parts(patterns: DataFrame) -> DataFrame:
    """pattern, kind (pair, name, star or regex), publisher in lower case, repo, regex, and prefix: what every text that the regular expression finds must begin with, where it says so at its beginning; else null."""
    p = F.col("pattern")
    kind = F.when(p == "*", "star").when(F.startswith(p, F.lit("/")), "regex").when(F.contains(p, F.lit("/")), "pair").otherwise("name")
    inner = F.regexp_replace(F.regexp_replace(p, "^/", ""), "/$", "")
    begins = F.regexp_extract(inner, r"^\^([\w/-]+)", 1)
    # A quantifier that allows none takes the last letter; alternatives count only within one group behind the beginning.
    begins = F.when(F.substring(inner, F.length(begins) + 2, F.lit(1)).isin("*", "?", "{"), F.left(begins, F.length(begins) - 1)).otherwise(begins)
    sure = ~F.contains(inner, F.lit("|")) | inner.rlike(r"^\^[\w/-]+\([^()]*\)[^()|]*$")
    return patterns.select(
        "pattern", kind.alias("kind"),
        F.when(kind == "pair", F.lower(F.substring_index(p, "/", 1))).alias("publisher"),
        F.when(kind == "pair", F.substring(p, F.instr(p, "/") + 1, F.length(p))).when(kind == "name", p).alias("repo"),
        F.when(kind == "regex", inner).alias("regex"),
        F.when((kind == "regex") & sure & (F.length(begins) > 0), begins).alias("prefix"),
    ).distinct()


def names_in(patterns: DataFrame) -> DataFrame:
    """repo: the repo names in a table of patterns; none if one of them can match any name."""
    parts = pattern_parts(patterns)
    some = parts.agg(F.max(F.col("kind").isin("star", "regex")).alias("some"))  # one row
    return parts.select("repo").where("repo IS NOT NULL").distinct().crossJoin(F.broadcast(some)).where("NOT some").select("repo")


def followed(repos: DataFrame, patterns: DataFrame) -> DataFrame:
    """publisher and repo of the repos that a table of patterns (pattern) names, each once. Pairs and names are hash joins. Regular expressions that say how a text begins are met by that beginning, cut to each length that occurs, and tried on what they meet; the others are tried on every distinct repo."""
    parts = pattern_parts(patterns)
    full = F.concat(F.lower("publisher"), F.lit("/"), F.col("repo"))
    names = repos.select(*REPO).distinct().withColumn("full", full).withColumn("low", F.lower("publisher"))
    of = lambda kind: parts.where(F.col("kind") == kind)
    pairs = names.join(of("pair").select(F.col("publisher").alias("low"), "repo"), ["low", "repo"], "left_semi")
    bare = names.join(of("name").select("repo"), "repo", "left_semi")
    one = lambda df, **named: F.broadcast(df.agg(*[c.alias(n) for n, c in named.items()]))  # noqa: E731  a single row
    star = names.crossJoin(one(of("star"), every=F.count("*"))).where("every > 0")
    starts = of("regex").where("prefix IS NOT NULL").select("regex", "prefix")
    cut = names.crossJoin(one(starts, sizes=F.collect_set(F.length("prefix")))).select("*", F.explode("sizes").alias("size")).where(F.length("full") >= F.col("size"))
    found = cut.withColumn("prefix", F.left("full", F.col("size"))).join(starts, "prefix").where(F.rlike("full", F.col("regex")))
    rest = names.crossJoin(one(of("regex").where("prefix IS NULL"), all=F.collect_set("regex"))).where(F.exists("all", lambda r: F.rlike("full", r)))
    every = [df.select(*REPO) for df in (pairs, bare, star, found, rest)]
    return reduce(DataFrame.unionByName, every).distinct()


def by_patterns(log: DataFrame, patterns: DataFrame) -> DataFrame:
    """The entries of followed repos. Patterns meet repos, of which there are few, and these the log."""
    return log.join(followed(log, patterns), REPO, "left_semi")


def log_range(log: DataFrame, first: int, last: int) -> DataFrame:
    """Entries of the blocks from first to last, both included."""
    return log.where(F.col("t").between(first, last))


def stitch(log: DataFrame, patterns: list[str], until: int | None = None, since: tuple[DataFrame, int] | None = None) -> DataFrame:
    """publisher, repo, head and pos: the latest head of each followed repo, up to block `until`. since: heads of an earlier stitch and its block, so that only the log behind it is read."""
    rows = log.where(matches(patterns)).select(*REPO, "head", "pos", "t")
    if until is not None:
        rows = rows.where(F.col("t") <= until)
    rows = rows.where(F.col("t") > since[1]).drop("t").unionByName(since[0].select(*REPO, "head", "pos")) if since else rows.drop("t")
    return rows.groupBy(*REPO).agg(F.max_by("head", "pos").alias("head"), F.max("pos").alias("pos"))


def root(heads: DataFrame) -> DataFrame:
    """One row: root, a hash of the heads alone, and n. Each head is hashed where it is; the hashes are summed in any order, as 64 pieces of digits, so that nothing is gathered."""
    h = heads.select(F.sha2(F.concat_ws("/", "publisher", "repo", "head"), 256).alias("h"))
    parts = [F.sum(F.conv(F.substring("h", 1 + 8 * i, 8), 16, 10).cast("long")) for i in range(8)]
    return h.agg(F.count("*").alias("n"), *[p.alias(f"s{i}") for i, p in enumerate(parts)]).select(F.sha2(F.concat_ws(",", F.col("n").cast("string"), *[F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(8)]), 256).alias("root"), "n")


def heads_diff(now: DataFrame, was: DataFrame) -> DataFrame:
    """publisher, repo, from (null for a new repo) and to of the heads that moved. Repos that are gone aren't told."""
    w = was.select(*REPO, F.col("head").alias("from"))
    return now.join(w, REPO, "left").where(~F.col("head").eqNullSafe(F.col("from"))).select(*REPO, "from", F.col("head").alias("to"))


def state_at(changes: DataFrame, pos: int) -> DataFrame:
    """The records at a position of the log: the last change of each id, without deletes."""
    last = changes.where(F.col("pos") <= pos).groupBy(*KEY).agg(F.max_by(F.struct("op", "cid", "type", "payload"), "pos").alias("c"))
    return last.where("c.op = 'put'").select(*KEY, "c.cid", "c.type", "c.payload")


def repo_diff(changes: DataFrame, before: int | None, after: int) -> DataFrame:
    """publisher, repo, id, op and cid: what turns the state at one position into that at another; before None: all."""
    new = state_at(changes, after).select(*KEY, F.col("cid").alias("new"))
    old = state_at(changes, -1 if before is None else before).select(*KEY, F.col("cid").alias("old"))
    both = new.join(old, KEY, "full_outer").where(~F.col("new").eqNullSafe(F.col("old")))
    return both.select(*KEY, F.when(F.col("new").isNull(), "delete").otherwise("put").alias("op"), F.col("new").alias("cid"))


def diff_since(changes: DataFrame, before: int, after: int, known: DataFrame) -> DataFrame:
    """The same from the changes between alone. known: key and cid of the records that are indexed; a put counts if they have another cid or none, a delete if they have the id. One position holds for all repos; where they have their own, or some are new, diff_by_repo() tells."""
    last = changes.where((F.col("pos") > before) & (F.col("pos") <= after)).groupBy(*KEY).agg(F.max_by(F.struct("op", "cid"), "pos").alias("c"))
    both = last.join(known.select(*KEY, F.col("cid").alias("old")), KEY, "left")
    counts = F.when(F.col("c.op") == "put", ~F.col("c.cid").eqNullSafe(F.col("old"))).otherwise(F.col("old").isNotNull())
    return both.where(counts).select(*KEY, "c.op", "c.cid")


def spans(now: DataFrame, was: DataFrame) -> DataFrame:
    """publisher, repo, after (null for a new repo) and until: between which positions the heads moved."""
    w = was.select(*REPO, F.col("head").alias("from"), F.col("pos").alias("after"))
    return now.join(w, REPO, "left").where(~F.col("head").eqNullSafe(F.col("from"))).select(*REPO, "after", F.col("pos").alias("until"))


def diff_by_repo(changes: DataFrame, spans: DataFrame, known: DataFrame) -> DataFrame:
    """What changed in each repo between its own positions: key, op, cid, type and payload. spans: publisher, repo, after and until. known: key and cid of the records that are indexed.

    A repo with an `after` needs the changes behind it alone; a put counts if known has another cid or none, a delete if it has the id. A repo without one is new to the index, or lost: its whole state until then counts, and what known has beside it is deleted. Changes before the smallest `after` are left out of the scan for all but the repos that are read whole; those are few, and are met by a join of their own.
    """
    older = spans.where(F.col("after").isNotNull())
    first = older.agg(F.min("after")).first()[0]
    recent = changes.where(F.col("pos") > (first if first is not None else 0)).join(older, REPO).where((F.col("pos") > F.col("after")) & (F.col("pos") <= F.col("until")))
    whole = spans.where(F.col("after").isNull())
    entire = changes.join(whole, REPO).where(F.col("pos") <= F.col("until"))
    last = recent.unionByName(entire).groupBy(*KEY).agg(F.max_by(F.struct("op", "cid", "type", "payload"), "pos").alias("c"))
    # What a whole repo had and has no more: a delete that no change tells.
    held = known.join(whole.select(*REPO), REPO, "left_semi").select(*KEY)
    gone = held.join(last.select(*KEY), KEY, "left_anti").select(*KEY, F.struct(F.lit("delete").alias("op"), *[F.lit(None).cast("string").alias(c) for c in ("cid", "type", "payload")]).alias("c"))
    both = last.unionByName(gone).join(known.select(*KEY, F.col("cid").alias("old")), KEY, "left")
    counts = F.when(F.col("c.op") == "put", ~F.col("c.cid").eqNullSafe(F.col("old"))).otherwise(F.col("old").isNotNull())
    return both.where(counts).select(*KEY, "c.op", "c.cid", "c.type", "c.payload")


def parents(log: DataFrame) -> DataFrame:
    """The log with was, the head before each commit in its repo, for comparing with parent."""
    return log.withColumn("was", F.lag("head").over(Window.partitionBy(*REPO).orderBy("pos")))


def moved(log: DataFrame, patterns: list[str], since: int | None, publishers: list[str] | None = None) -> bool:
    """Whether the log has moved for what is followed; True if that can't be told by repo names."""
    names = repo_names(patterns)
    if since is None or publishers or names is None:
        return True
    return bool(log.where(F.col("repo").isin(names) & (F.col("t") > since)).take(1))


def verify(log: DataFrame, patterns: list[str], root_hash: str, t: int) -> bool:
    """Whether a stitch is what the log gives: the heads up to its block, folded anew, have its root."""
    return root(stitch(log, patterns, t)).first()["root"] == root_hash


def read_record(changes: DataFrame, publisher: str, repo: str, id: str) -> DataFrame:
    """The record as the log has it now, whatever an index holds: one row or none."""
    one = changes.where((F.lower("publisher") == publisher.lower()) & (F.col("repo") == repo) & (F.col("id") == id))
    last = one.groupBy(*KEY).agg(F.max_by(F.struct("op", "cid", "type", "payload"), "pos").alias("c"))
    return last.where("c.op = 'put'").select(*KEY, "c.cid", "c.type", "c.payload")


def list_repo(changes: DataFrame, publisher: str, repo: str) -> DataFrame:
    """The records of a repo as the log has them now."""
    one = changes.where((F.lower("publisher") == publisher.lower()) & (F.col("repo") == repo))
    last = one.groupBy(*KEY).agg(F.max_by(F.struct("op", "cid", "type", "payload"), "pos").alias("c"))
    return last.where("c.op = 'put'").select(*KEY, "c.cid", "c.type", "c.payload")
