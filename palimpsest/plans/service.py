"""What serves an index: tools and their dispatch, publishing with its checks, the update pipeline, and the configuration. Rows come from DataFrames; only answers, of at most a hundred rows, are collected, and lists of repos."""

from __future__ import annotations

import base64
import binascii
import datetime
import json
import os
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import fulltext, gate, maintain, search
from palimpsest.operators import log as ops_log
from palimpsest.operators.log import matches, patterns_of, repo_names
from palimpsest.operators.rules import listed
from palimpsest.sources.store import Blobs

MAX_FILE = 5 << 20
MAX_LIST = 100
PIN = ("publisher", "repo", "id")


class Refused(Exception):
    def __init__(self, status: int, reason: str) -> None:
        super().__init__(reason)
        self.status, self.reason = status, reason


@dataclass
class Config:
    """What is followed (follow, or repos with publishers or without), what is served, and what may be published."""

    repos: list[str] = field(default_factory=list)
    follow: list[str] = field(default_factory=list)
    publishers: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    index: str = "records"
    publish_repos: list[str] = field(default_factory=list)
    publish_view: str | None = None
    publish_per_day: int = 20
    publisher: str | None = None
    name: str = "index"
    instructions: str | None = None
    network: str | None = None
    schema: dict | str | None = None
    rules: list = field(default_factory=list)

    @property
    def patterns(self) -> list[str]:
        return patterns_of(self.follow, self.publishers, self.repos)


def read_config(text: str, environment: dict[str, str] | None = None) -> Config:
    """From JSON; values in the environment under INDEX_<FIELD>, as JSON or plain text, win. repos or follow is needed, lists that are given aren't empty, index is records or repos, and the index must not follow the view that it publishes, or each view would cause the next."""
    raw = json.loads(text)
    for name in Config.__dataclass_fields__:
        given = (os.environ if environment is None else environment).get(f"INDEX_{name.upper()}")
        if given is not None:
            try:
                raw[name] = json.loads(given)
            except ValueError:
                raw[name] = given
    for name in ("repos", "follow", "publishers"):
        if name in raw and not (isinstance(raw[name], list) and raw[name]):
            raise ValueError(f"{name} must be a list that is not empty")
    if not raw.get("follow") and not raw.get("repos"):
        raise ValueError("repos or follow is needed")
    config = Config(**{k: v for k, v in raw.items() if k in Config.__dataclass_fields__})
    if config.index not in ("records", "repos"):
        raise ValueError("index is records or repos")
    if config.publish_view and follows(config.patterns, config.publisher, config.publish_view):
        raise ValueError("the index follows the repo of its own view")
    return config


def follows(patterns: list[str], publisher: str | None, repo: str) -> bool:
    """Whether patterns name a repo of a publisher; of one who isn't known, whether they can."""
    session = SparkSession.active()
    if publisher is None:
        named = [p for p in patterns if "/" in p and not p.startswith("/")]
        publisher = next((p.split("/", 1)[0] for p in named if p.split("/", 1)[1] == repo), "0x0")
    return bool(session.range(1).select(F.lit(publisher).alias("publisher"), F.lit(repo).alias("repo")).where(matches(patterns)).take(1))


@dataclass
class Index:
    """An index to serve: records with rowseq, vectors, verdicts and their checker, an embedder for queries, blobs, the changes of the log for reads past the index, a kept full-text index, or postings and lengths, repos with their cards, and how to publish."""

    spark: SparkSession
    records: DataFrame
    vectors: DataFrame | None = None
    verdicts: DataFrame | None = None
    checker: Any = None
    embedder: Any = None
    blobs: Blobs | None = None
    changes: DataFrame | None = None
    postings: fulltext.Kept | tuple[DataFrame, DataFrame] | None = None
    repos: DataFrame | None = None
    publish: Callable[[dict], dict] | None = None

    def served(self) -> DataFrame:
        return self.records if self.verdicts is None else gate.allowed(self.records, self.verdicts, self.checker)

    def rows(self, df: DataFrame) -> list[dict]:
        return [{**r, "payload": json.loads(r["payload"]) if r.get("payload") else None} for r in (x.asDict() for x in df.collect())]


@dataclass
class Tool:
    name: str
    description: str
    run: Callable[[Index, dict], Any]
    schema: dict = field(default_factory=lambda: {"type": "object"})


def tool_search(index: Index, a: dict) -> list[dict]:
    """mode hybrid unless it is another; keywords are the query unless given; a lexical search never embeds."""
    mode = a.get("mode") if a.get("mode") in ("semantic", "lexical") else "hybrid"
    text = a.get("keywords") or a.get("query") or ""
    vector = None if mode == "lexical" or index.embedder is None else index.embedder.query(a.get("query") or "")
    kinds = {k: [a[k]] if isinstance(a.get(k), str) else a.get(k) for k in ("publisher", "repo", "type")}
    allowed = None if index.verdicts is None else index.served().select("rowseq")
    found = search.search(index.records, index.vectors, text, vector, search.clamp(a.get("k")), mode, search.filters(**kinds), allowed, index=index.postings)
    return index.rows(found.drop("place"))


def tool_repos(index: Index, a: dict) -> list[dict]:
    """All repos, with their number of records. A row for each repo: the list is a catalogue, not the data."""
    return [r.asDict() for r in index.served().groupBy("publisher", "repo").agg(F.count("*").alias("records")).orderBy("publisher", "repo").collect()]


def with_file(index: Index, found: dict) -> dict:
    """A record and the file that it names: JSON of at most 5 MB as data, else by its name."""
    payload = found["payload"]
    src = payload.get("src") if isinstance(payload, dict) else None
    if src and index.blobs:
        data = index.blobs.get(src) if payload.get("mime", "application/json") == "application/json" else None
        found["url"] = src
        if data is not None and len(data) <= MAX_FILE:
            try:
                found["file"] = json.loads(data)
            except ValueError:
                pass
    return found


def tool_get(index: Index, a: dict) -> dict | None:
    """One record: as the log has it now where the index knows the log, else as it is indexed. With a gate only the version that it lets in."""
    publisher, repo, id = str(a.get("publisher", "")).lower(), str(a.get("repo")), str(a.get("id"))
    columns = ["publisher", "repo", "id", "cid", "type", "payload"]
    if index.changes is None:
        one = index.served().where((F.col("publisher") == publisher) & (F.col("repo") == repo) & (F.col("id") == id))
    else:
        one = ops_log.read_record(index.changes, publisher, repo, id)
    found = index.rows(one.select(*columns).limit(1))
    if not found or index.changes is not None and not gate.allows(index.records, index.verdicts, index.checker, publisher, repo, id, found[0]["cid"]):
        return None
    return with_file(index, found[0])


def tool_read(index: Index, a: dict) -> dict:
    """A repo as the log has it now: one record by its id, or how many it has and the first hundred. Without a log, what is indexed of it."""
    publisher, repo = str(a.get("publisher", "")).lower(), str(a.get("repo"))
    rows = index.served().where((F.col("publisher") == publisher) & (F.col("repo") == repo)) if index.changes is None else ops_log.list_repo(index.changes, publisher, repo)
    if a.get("id"):
        found = index.rows(rows.where(F.col("id") == str(a["id"])).select("id", "cid", "type", "payload").limit(1))
        if not found:
            raise LookupError(f"no record {a['id']} in {publisher}/{repo}")
        return found[0]
    return {"total": rows.count(), "records": [r.asDict() for r in rows.select("id", "cid", "type").orderBy("id").limit(MAX_LIST).collect()]}


def tool_find(index: Index, a: dict) -> list[dict]:
    """Repos nearest to a query, or those that changed last."""
    vector = index.embedder.query(str(a["query"])) if a.get("query") and index.embedder else None
    return [r.asDict() for r in maintain.repos_find(index.repos, vector, a.get("publisher"), search.clamp(a.get("k"), 20)).collect()]


def tool_repo(index: Index, a: dict) -> dict:
    """One repo and its whole card."""
    found = maintain.repos_get(index.repos, str(a.get("publisher", "")), str(a.get("repo"))).take(1)
    if not found:
        raise LookupError(f"{a.get('publisher')}/{a.get('repo')} is not indexed")
    row = found[0].asDict()
    return {**row, "card": json.loads(row["card"]) if row["card"] else None}


def tool_publish(index: Index, a: dict) -> dict:
    return index.publish(a)


K = {"type": "integer", "minimum": 1, "maximum": 50}
TEXT = {"type": "string"}
REPO_SCHEMA = {"type": "object", "required": ["publisher", "repo"], "properties": {"publisher": TEXT, "repo": TEXT, "id": TEXT}}
BASE = [
    Tool("search", "Searches records by meaning and words.", tool_search, {"type": "object", "required": ["query"], "properties": {"query": TEXT, "keywords": TEXT, "mode": {"type": "string", "enum": ["hybrid", "semantic", "lexical"]}, "type": TEXT, "k": K}}),
    Tool("repos", "Lists repos with their number of records.", tool_repos),
    Tool("get", "Gets a record, with the file that it names.", tool_get, {**REPO_SCHEMA, "required": ["publisher", "repo", "id"]}),
]
PUBLISH = Tool("publish", "Publishes a record into the caller's own repo.", tool_publish, {"type": "object", "required": ["record"], "properties": {"repo": TEXT, "record": {"type": "object"}, "file": {"type": "object"}, "pin": {"type": "array", "items": TEXT}}})
REPOS = [
    Tool("find", "Finds repos by what they are about, or lists those that changed last.", tool_find, {"type": "object", "properties": {"query": TEXT, "publisher": TEXT, "k": K}}),
    Tool("repo", "Gets a repo and its card.", tool_repo, {**REPO_SCHEMA}),
    Tool("read", "Reads a repo as the log has it now.", tool_read, {**REPO_SCHEMA}),
]
LOCAL = [
    Tool("search", "Searches records.", lambda index, a: tool_search(index, {**a, "k": search.exactly(a.get("k"))}), BASE[0].schema),
    BASE[1],
    BASE[2],
]


def tools_of(own: list[Tool] | None = None, types: list[str] | None = None, config: Config | None = None) -> dict[str, Tool]:
    """The base tools, of records or of repos by the configuration's index, and an application's, which win by name. Publishing is listed only where it is on. The listed types become the choices of search and publish."""
    base = REPOS if config and config.index == "repos" else [*BASE, *([PUBLISH] if config and config.publish_repos else [])]
    types = types or (config.types if config else None)
    found = {t.name: t for t in [*base, *(own or [])]}
    for name in ("search", "publish") if types else ():
        if name in found:
            t = found[name]
            inside = t.schema.get("properties", {})
            more = {"type": {"type": "string", "enum": types}} if name == "search" else {"record": {"type": "object", "properties": {"type": {"enum": types}}}}
            found[name] = Tool(name, t.description, t.run, {**t.schema, "properties": {**inside, **more}})
    return found


def index_of(config: Config, spark: SparkSession, store: Any, embedder: Any = None, changes: DataFrame | None = None, checks: tuple[gate.Checks, dict[str, gate.Checks]] | None = None, own: list[Tool] | None = None) -> tuple[Index, dict[str, Tool]]:
    """What a configuration serves from a store, and its tools: repos with their cards, or records with their vectors, their kept full text where it is saved, and, with checks, behind their gate."""
    tools = tools_of(own, config=config)
    if config.index == "repos":
        repos = store.table("repos")
        if repos is None:
            raise LookupError("the store has no repos")
        return Index(spark, records=store.table("records"), embedder=embedder, changes=changes, repos=repos), tools
    records, gates = store.table("records"), gate.gates_of(*checks) if checks else None
    if records is None:
        raise LookupError("the store has no records")
    verdicts = store.table("verdicts") if gates else None
    if gates and verdicts is None:  # nothing is checked yet, so nothing is served
        verdicts = records.where(F.lit(False)).select("publisher", "repo", "id", "cid", F.lit("").alias("checker"), F.lit(None).cast("string").alias("reason"))
    checker = gate.checker_of(F.col("type"), gates.by_type, gates.other) if gates else None
    kept = fulltext.Kept(store.table) if store.table("fts_sizes") is not None else None
    return Index(spark, records, store.table("vectors"), verdicts, checker, embedder, changes=changes, postings=kept), tools


def dispatch(index: Index, message: dict, tools: dict[str, Tool], name: str = "index", instructions: str | None = None) -> dict | None:
    """The answer to a JSON-RPC message; None for notifications. A tool that fails answers with its error."""
    if "id" not in message:
        return None
    answer = lambda **x: {"jsonrpc": "2.0", "id": message["id"], **x}
    method, params = message.get("method"), message.get("params") or {}
    if method == "initialize":
        return answer(result={"protocolVersion": params.get("protocolVersion", "2025-03-26"), "capabilities": {"tools": {}}, "serverInfo": {"name": name}, **({"instructions": instructions} if instructions else {})})
    if method == "ping":
        return answer(result={})
    if method == "tools/list":
        return answer(result={"tools": [{"name": t.name, "description": t.description, "inputSchema": t.schema} for t in tools.values()]})
    if method == "tools/call":
        try:
            said = tools[params["name"]].run(index, params.get("arguments") or {})
            return answer(result={"content": [{"type": "text", "text": json.dumps(said, default=str)}]})
        except Exception as e:  # the caller is told
            return answer(result={"isError": True, "content": [{"type": "text", "text": str(e)}]})
    return answer(error={"code": -32601, "message": f"no method {method}"})


def file_of(given: dict) -> tuple[bytes, str]:
    """Bytes and mime type of {json} or {base64, mime}."""
    if "json" in given:
        data, mime = json.dumps(given["json"]).encode(), "application/json"
    else:
        try:
            data, mime = base64.b64decode(given["base64"], validate=True), given["mime"]
        except (KeyError, TypeError, binascii.Error) as e:
            raise Refused(400, "file must be json, or base64 and mime") from e
    if len(data) > MAX_FILE:
        raise Refused(400, "the file is too large")
    return data, mime


def pinned(index: Index, payload: dict, names: list[str], publisher: str, repo: str) -> dict:
    """payload, whose references under these names get the repo, version and type of what they refer to as it is now. A reference without publisher or repo is to the caller's own. All are looked up in one join."""
    wanted = [(n, i, r) for n in names if payload.get(n) is not None for i, r in enumerate(payload[n] if isinstance(payload[n], list) else [payload[n]])]
    if not wanted:
        return payload
    if any(not isinstance(r, dict) or not isinstance(r.get("id"), str) or not r["id"] for _, _, r in wanted):
        raise Refused(400, "a reference needs an id")
    rows = [(k, str(r.get("publisher") or publisher).lower(), str(r.get("repo") or repo), r["id"]) for k, (_, _, r) in enumerate(wanted)]
    # As many rows as the caller names.
    refs = F.broadcast(index.spark.createDataFrame(rows, "k int, p string, r string, i string"))
    same = (F.col("p") == F.lower("publisher")) & (F.col("r") == F.col("repo")) & (F.col("i") == F.col("id"))
    if index.changes is None:
        now = index.records.join(refs, same).select("k", *PIN, "cid", "type")
    else:
        last = index.changes.join(refs, same).groupBy("k").agg(F.max_by(F.struct(*PIN, "op", "cid", "type"), "pos").alias("c"))
        now = last.where("c.op = 'put'").select("k", *[f"c.{x}" for x in (*PIN, "cid", "type")])
    found = {x["k"]: x for x in now.collect()}
    out = dict(payload)
    for k, (name, at, r) in enumerate(wanted):
        if k not in found:
            raise Refused(400, f"no record {rows[k][1]}/{rows[k][2]}/{r['id']}")
        ref = {c: found[k][c] for c in (*PIN, "cid", "type")}
        if isinstance(payload[name], list):
            out[name] = [*out[name][:at], ref, *out[name][at + 1 :]]
        else:
            out[name] = ref
    return out


class Quota:
    """How much was published on each day, by all together, in a store's meta, where it outlives updates. A place is taken before the commit, so that writers at the same time can't take more than there are, and given back if it fails."""

    def __init__(self, store: Any) -> None:
        self.store = store

    def used(self, day: str) -> int:
        return int(self.store.get_meta(f"published:{day}", 0))

    def take(self, day: str, most: int) -> bool:
        """Whether there was a place left."""
        return self.store.change_meta(f"published:{day}", lambda n: n + 1 if n < most else None, 0) is not None

    def give_back(self, day: str) -> None:
        self.store.change_meta(f"published:{day}", lambda n: max(n - 1, 0), 0)


def publish(
    index: Index, config: Config, body: Any, grant: dict | None, quota: Quota, base: gate.Checks | None = None, types: dict[str, gate.Checks] | None = None, commit: Callable[[dict], Any] | None = None, today: datetime.date | None = None
) -> dict:
    """Publishes one record, or refuses with a status: 404 publishing is off or the repo isn't open, 400 the body, its type, references or file, 401 no grant, 403 a grant for another repo or a publisher that the index doesn't follow, 429 the day's quota, which all publishers share, 422 the checks. Only what is committed counts. Without a repo the only one that is open is meant."""
    if not config.publish_repos:
        raise Refused(404, "publishing is off")
    if not isinstance(body, dict) or not isinstance(body.get("record"), dict):
        raise Refused(400, "a record is needed")
    repo = body.get("repo") or (config.publish_repos[0] if len(config.publish_repos) == 1 else None)
    if repo not in config.publish_repos:
        raise Refused(404, f"no repo {repo}" if repo else f"name the repo: one of {', '.join(config.publish_repos)}")
    record = dict(body["record"])
    if not isinstance(record.get("id"), str) or not record["id"] or not isinstance(record.get("payload"), dict):
        raise Refused(400, "a record needs id and payload")
    if config.types and record.get("type") not in config.types:
        raise Refused(400, f"type {record.get('type')} is not listed")
    pins = body.get("pin") or []
    if not (isinstance(pins, list) and all(isinstance(p, str) for p in pins)):
        raise Refused(400, "pin must be a list of names")
    file = file_of(body["file"]) if body.get("file") is not None else None
    if not grant or not grant.get("publisher"):
        raise Refused(401, "no grant")
    if repo not in grant.get("repos", []):
        raise Refused(403, "the grant does not cover the repo")
    publisher = grant["publisher"].lower()
    if not follows(config.patterns, publisher, repo):
        raise Refused(403, "the index does not follow this publisher")
    day = (today or datetime.datetime.now(datetime.UTC).date()).isoformat()
    if quota.used(day) >= config.publish_per_day:
        raise Refused(429, "the day's quota is used up")
    record["payload"] = pinned(index, record["payload"], pins, publisher, repo)
    if file and index.blobs:
        record["payload"] = {**{k: v for k, v in record["payload"].items() if k != "mime"}, "src": index.blobs.put(file[0]), **({} if file[1] == "application/json" else {"mime": file[1]})}
    reason = gate.reason_of(record, base or gate.Checks(), types or {}, {"publisher": publisher, "repo": repo, "file": file and file[0]})
    if reason:
        raise Refused(422, reason)
    entry = {"publisher": publisher, "repo": repo, "day": day, **record}
    if not quota.take(day, config.publish_per_day):
        raise Refused(429, "the day's quota is used up")
    if commit:
        try:
            commit(entry)
        except BaseException:
            quota.give_back(day)
            raise
    return entry


def update_all(config: Config, log: DataFrame, store: Any, steps: dict[str, Callable[[], int]], stitch_step: Callable[[], str], publish_view: Callable[[], None] | None = None, now: Callable[[], str] | None = None) -> dict[str, Any]:
    """One run of what keeps an index up to date, in this order: has the log moved for what is followed, the stitch, then the bounded steps "cards", "checks", "vectors" and "packing" as far as they are given, each of which says how much it did, and the view. A refused record is never embedded, as checks come first. The view is published once for each version, which is the root and the last change of verdicts; one that failed is tried again by the next run."""
    said: dict[str, Any] = {"moved": ops_log.moved(log, config.patterns, store.get_meta("checked"), config.publishers or None)}
    clock = log.agg(F.max("t")).first()[0] or 0
    if said["moved"]:
        said["root"] = stitch_step()
    store.set_meta("checked", clock)
    for name in ("cards", "checks", "vectors", "packing"):
        if name in steps:
            said[name] = steps[name]()
            if name == "checks" and said[name]:
                store.set_meta("verdicts", now() if now else datetime.datetime.now(datetime.UTC).isoformat())
    version = view_version(store)
    if publish_view and version is not None and version != store.get_meta("published"):
        publish_view()
        store.set_meta("published", version)
        said["view"] = version
    return said


def view_version(store: Any, checks: str | None = None) -> str | None:
    """What a view depends on: the root, the checks, and the last change of verdicts. None before there is a stitch."""
    saved = store.load()
    return None if saved is None else ":".join([saved.root, *([checks] if checks else []), str(store.get_meta("verdicts", ""))])


class ViewCache:
    """The last view, as long as its version stays. make: gives a view."""

    def __init__(self, make: Callable[[], Any]) -> None:
        self.make, self.version, self.held = make, None, None

    def get(self, version: str | None) -> Any:
        if version is None:
            return None
        if version != self.version:
            self.held, self.version = self.make(), version
        return self.held


def manifest(config: Config, base_url: str, tools: dict[str, Tool]) -> dict:
    """What an index is and how to use it."""
    out = {"name": config.name, "network": config.network, "schema": config.schema, "rules": listed(config.rules), "index": config.index, "repos": repo_names(config.patterns) or [], "types": config.types, "tools": list(tools), "search": f"{base_url}/search", "view": f"{base_url}/view.json"}
    return {**out, **({"publish": f"{base_url}/publish", "connect": f"{base_url}/connect"} if config.publish_repos else {})}
