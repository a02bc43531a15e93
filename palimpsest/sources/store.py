"""Snapshots of an index: rows and the stitch that they stand for, visible together or not at all.

A table is a list of segments, folders of Parquet files that never change: a whole table, and behind it deltas, each with rows to put and keys to delete. A save writes what it is given, and no more: a delta of k rows costs k rows, however large the table is. Reading merges them: what the deltas have last for a key counts, and rows of the whole table stay where no delta has their key. compact() folds deltas together, and into the whole table once they are large beside it.

What counts is the pointer with the largest number, CURRENT.<number>, a small file that names the segments of each table, the stitch and the meta values. It is written last, under the next number, by an operation that fails if the name is taken. So a crash at any point leaves the state before, and of two writers one is told that the other was first: it looks at the new state and tries again, or gives up with Conflict if its work rests on the old one. Segments have names of their own, so writers never meet there either.

vacuum() removes pointers and segments that are out of use for longer than a while, in which readers end and writers commit. All files go through Hadoop's file system, so a store can lie wherever Spark reads.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deltas are folded together when there are so many; into the whole table when their bytes are this share of its own.
MOST_DELTAS, SHARE = 8, 0.25
#: Seconds for which what is out of use stays.
RETAIN = 24 * 3600


class Conflict(OSError):
    """Another writer was first."""


@dataclass
class Stitch:
    """What a snapshot stands for: a hash of the heads, the block up to which the log was read, what is followed, and whose vectors it has. meta: values beside it, as they were when it was loaded; set_meta() changes them, a save doesn't."""

    root: str
    t: int
    patterns: list[str]
    embedder: str | None = None
    meta: dict = field(default_factory=dict)


@dataclass
class Delta:
    """What changes in a table: rows to put in place of those with the same key, and keys to delete. No key comes twice. Where a key is in both, its row counts. Without a key, rows are put behind those that are there."""

    key: list[str]
    puts: DataFrame | None = None
    gone: DataFrame | None = None

    def rows(self) -> DataFrame:
        """The rows of both, with a column __gone; rows to delete have a key alone."""
        gone = None if self.gone is None else self.gone.select(*self.key, F.lit(True).alias("__gone"))
        if self.puts is None:
            return gone
        puts = self.puts.withColumn("__gone", F.lit(False))
        if gone is None:
            return puts
        return puts.unionByName(without(gone, self.puts, self.key), allowMissingColumns=True)


def without(df: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """df without the rows whose key is in keys; a null in a key is a value like others. Only keys move, and only if they are too many to be sent to all."""
    named = keys.select([F.col(k).alias(f"__{k}") for k in key])
    return df.join(named, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]), "left_anti")


def newest(deltas: list[DataFrame], key: list[str]) -> DataFrame:
    """The last row for each key of deltas, oldest first."""
    if len(deltas) == 1:
        return deltas[0]
    if not key:
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), deltas)
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("__n", F.lit(n)) for n, d in enumerate(deltas)])
    rest = [c for c in every.columns if c not in (*key, "__n")]
    return every.groupBy(*key).agg(F.max_by(F.struct(*rest), "__n").alias("__row")).select(*key, "__row.*")


def merged(whole: DataFrame | None, deltas: list[DataFrame], key: list[str]) -> DataFrame:
    """A table from its whole state and deltas behind it, oldest first, as Delta.rows() gives them."""
    if not deltas:
        return whole
    last = newest(deltas, key)
    live = last.where(~F.col("__gone")).drop("__gone")
    if whole is None:
        return live
    return (without(whole, last, key) if key else whole).unionByName(live, allowMissingColumns=True)


class Files:
    """Small files under a root that appear whole, and once."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.root = spark._jvm, root
        self.fs = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def read(self, name: str) -> bytes | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def put(self, name: str, data: bytes) -> None:
        """A new file, whole or not at all. FileExistsError if the name is taken, also by one who takes it at the same time: a hard link on a local disk, a rename on HDFS, which takes no name that is there, and elsewhere a conditional write, as object stores have it."""
        self.fs.mkdirs(self.path(""))
        where = self.fs.resolvePath(self.path(""))
        scheme = where.toUri().getScheme()
        if scheme not in ("file", "hdfs"):
            try:
                self._write(self.fs.createFile(self.path(name)).overwrite(False).opt("fs.option.create.conditional.overwrite", "true").build(), data)
            except Py4JJavaError as e:
                if "Exist" in e.java_exception.getClass().getSimpleName() or self.fs.exists(self.path(name)):
                    raise FileExistsError(name) from e
                raise
            return
        partial = self.path(f"_{name}.{uuid.uuid4().hex}")
        self._write(self.fs.create(partial, False), data)
        try:
            if scheme == "file":
                local = lambda n: self.jvm.java.nio.file.Paths.get(self.jvm.java.net.URI.create(f"file://{where.toUri().getRawPath()}/{n}"))
                self.jvm.java.nio.file.Files.createLink(local(name), local(partial.getName()))
            elif not self.fs.rename(partial, self.path(name)):
                raise FileExistsError(name)
        except Py4JJavaError as e:
            if "Exist" in e.java_exception.getClass().getSimpleName():
                raise FileExistsError(name) from e
            raise
        finally:
            self.fs.delete(partial, False)

    @staticmethod
    def _write(stream, data: bytes) -> None:
        stream.write(bytearray(data))
        stream.close()

    def versions(self, name: str) -> list[int]:
        if not self.fs.exists(self.path("")):
            return []
        found = (re.fullmatch(rf"{re.escape(name)}\.(\d+)", f.getPath().getName()) for f in self.fs.listStatus(self.path("")))
        return sorted(int(m[1]) for m in found if m)

    def latest(self, name: str) -> bytes | None:
        """What was last put under the name by replace()."""
        found = self.versions(name)
        return self.read(f"{name}.{found[-1]:012d}") if found else None

    def replace(self, name: str, data: bytes) -> None:
        """Readers by latest() see the old or the new content; of two who replace it at once one comes after the other. Of old versions the last stays, for readers that are at it."""
        while True:
            found = self.versions(name)
            try:
                self.put(f"{name}.{(found[-1] + 1 if found else 0):012d}", data)
            except FileExistsError:
                continue
            for n in found[:-1]:
                self.fs.delete(self.path(f"{name}.{n:012d}"), False)
            return


EMPTY = {"stitch": None, "meta": {}, "tables": {}}


class SnapshotStore:
    """load() and save() of named tables with their stitch."""

    def __init__(self, spark: SparkSession, root: str, embedder: str | None = None) -> None:
        self.spark, self.root, self.files, self.embedder = spark, root, Files(spark, root), embedder
        now = self.load()
        if now and embedder and now.embedder and now.embedder != embedder:
            raise ValueError(f"the index was written with embedder {now.embedder}, not {embedder}: their vectors don't compare")

    def head(self) -> tuple[int, dict]:
        """The number of the pointer that counts, and what it says; -1 where there is none."""
        while found := self.files.versions("CURRENT"):
            raw = self.files.read(f"CURRENT.{found[-1]:012d}")
            if raw is not None:  # else it went meanwhile, as newer ones came
                return found[-1], json.loads(raw)
        return -1, EMPTY

    @property
    def version(self) -> int:
        """To give to save(), by who has read the state at it."""
        return self.head()[0]

    def load(self, patterns: list[str] | None = None) -> Stitch | None:
        """The saved stitch; None if there is none, or if it was for other patterns, so that the index starts over."""
        held = self.head()[1]
        if held["stitch"] is None or patterns is not None and held["stitch"]["patterns"] != patterns:
            return None
        return Stitch(**held["stitch"], meta=held["meta"])

    def table(self, name: str) -> DataFrame | None:
        held = self.head()[1]["tables"].get(name)
        return None if held is None else self._read(held)

    def _read(self, held: dict) -> DataFrame:
        whole = [s for s in held["segments"] if not s["delta"]]
        return merged(self._segment(whole[0]) if whole else None, [self._segment(s) for s in held["segments"] if s["delta"]], held["key"])

    def _segment(self, s: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/segments/{s['name']}")

    def _write(self, df: DataFrame, delta: bool) -> dict:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.root}/segments/{name}")
        return {"name": name, "delta": delta, "bytes": self.files.fs.getContentSummary(self.files.path(f"segments/{name}")).getLength()}

    def _commit(self, change: Callable[[dict], dict], expected: int | None = None) -> int:
        """The next pointer, which change() makes from the last. Whoever finds it taken looks again; with an expected version it is a Conflict."""
        while True:
            n, held = self.head()
            if expected is not None and n != expected:
                raise Conflict(f"the store is at version {n}, not {expected}")
            try:
                self.files.put(f"CURRENT.{n + 1:012d}", json.dumps(change(held), sort_keys=True).encode())
                return n + 1
            except FileExistsError as e:
                if expected is not None:
                    raise Conflict(f"another writer came after version {expected}") from e

    def save(self, stitch: Stitch, tables: dict[str, DataFrame | Delta], expected: int | None = None) -> int:
        """Tables that aren't given stay as they are, and so does meta. With other patterns than before the index starts over: old tables go, and deltas are all there is. expected: the version on which the new state rests."""
        written = {name: (t.key, self._write(t.rows(), True)) if isinstance(t, Delta) else ([], self._write(t, False)) for name, t in tables.items()}

        def change(held: dict) -> dict:
            new = dict(held["tables"]) if held["stitch"] and held["stitch"]["patterns"] == stitch.patterns else {}
            for name, (key, segment) in written.items():
                before = new.get(name, {"key": key, "segments": []})
                if segment["delta"] and before["key"] not in ([], key):
                    raise ValueError(f"{name} has the key {before['key']}, not {key}")
                new[name] = {"key": key or before["key"], "segments": [*(before["segments"] if segment["delta"] else []), segment]}
            said = {**asdict(stitch), "embedder": stitch.embedder or self.embedder}
            return {"stitch": {k: v for k, v in said.items() if k != "meta"}, "meta": {**stitch.meta, **held["meta"]}, "tables": new}

        return self._commit(change, expected)

    def compact(self, name: str, most: int = MOST_DELTAS, share: float = SHARE) -> bool:
        """Folds the deltas of a table into one if there are more than most, and into the whole table if they are large beside it. What is saved meanwhile stays behind. Whether anything was done."""
        held = self.head()[1]["tables"].get(name, {"segments": []})
        old, deltas = held["segments"], [s for s in held["segments"] if s["delta"]]
        small = sum(s["bytes"] for s in deltas) < share * sum(s["bytes"] for s in old if not s["delta"])
        if not deltas or small and len(deltas) <= most:
            return False
        new = self._write(newest([self._segment(s) for s in deltas], held["key"]) if small else self._read(held), small)

        def change(now: dict) -> dict:
            found = now["tables"].get(name, {"segments": []})["segments"]
            if found[: len(old)] != old:
                raise Conflict(f"{name} was written anew")
            segments = [*(old[: len(old) - len(deltas)] if small else []), new, *found[len(old) :]]
            return {**now, "tables": {**now["tables"], name: {"key": held["key"], "segments": segments}}}

        self._commit(change)
        return True

    def vacuum(self, retain: float = RETAIN) -> int:
        """Removes pointers but the last, and segments that no pointer names, once they are older than retain seconds. How many went."""
        fs, before, gone = self.files.fs, (time.time() - retain) * 1000, 0
        # By the time of the pointer that came after it: until then it was in use.
        found = self.files.versions("CURRENT")
        for n, after in zip(found, found[1:], strict=False):
            if fs.getFileStatus(self.files.path(f"CURRENT.{after:012d}")).getModificationTime() < before:
                gone += fs.delete(self.files.path(f"CURRENT.{n:012d}"), False)
        used = {s["name"] for n in self.files.versions("CURRENT") for t in json.loads(self.files.read(f"CURRENT.{n:012d}"))["tables"].values() for s in t["segments"]}
        if fs.exists(self.files.path("segments")):
            for f in fs.listStatus(self.files.path("segments")):
                if f.getPath().getName() not in used and f.getModificationTime() < before:
                    gone += fs.delete(f.getPath(), True)
        return gone

    def get_meta(self, key: str, default: object = None) -> object:
        return self.head()[1]["meta"].get(key, default)

    def change_meta(self, key: str, change: Callable[[object], object], default: object = None) -> object:
        """A value becomes change(value), whoever else changes it at the same time; None from change() leaves it. The new value, or None. Needs no snapshot, and outlives those that come."""
        while True:
            n, held = self.head()
            value = change(held["meta"].get(key, default))
            if value is None:
                return None
            try:
                self._commit(lambda now: {**now, "meta": {**now["meta"], key: value}}, n)
                return value
            except Conflict:
                continue

    def set_meta(self, key: str, value: object) -> None:
        """A value beside the stitch, such as up to where the log was checked."""
        self._commit(lambda held: {**held, "meta": {**held["meta"], key: value}})


class MemoryStore:
    """The same without files, for tests and previews."""

    def __init__(self) -> None:
        self.version, self.stitch, self.tables, self.meta = -1, None, {}, {}

    def load(self, patterns: list[str] | None = None) -> Stitch | None:
        if self.stitch is None or patterns is not None and self.stitch.patterns != patterns:
            return None
        return Stitch(self.stitch.root, self.stitch.t, self.stitch.patterns, self.stitch.embedder, dict(self.meta))

    def table(self, name: str) -> DataFrame | None:
        return self.tables.get(name)

    def save(self, stitch: Stitch, tables: dict[str, DataFrame | Delta], expected: int | None = None) -> int:
        if expected is not None and expected != self.version:
            raise Conflict(f"the store is at version {self.version}, not {expected}")
        new = dict(self.tables) if self.stitch and self.stitch.patterns == stitch.patterns else {}
        for name, t in tables.items():
            new[name] = merged(new.get(name), [t.rows()], t.key) if isinstance(t, Delta) else t
        self.stitch, self.tables, self.meta, self.version = stitch, new, {**stitch.meta, **self.meta}, self.version + 1
        return self.version

    def compact(self, name: str) -> bool:
        return False

    def get_meta(self, key: str, default: object = None) -> object:
        return self.meta.get(key, default)

    def change_meta(self, key: str, change: Callable[[object], object], default: object = None) -> object:
        value = change(self.meta.get(key, default))
        if value is not None:
            self.set_meta(key, value)
        return value

    def set_meta(self, key: str, value: object) -> None:
        self.meta[key] = value
        self.version += 1


class RecordStore:
    """The stitch alone, as the record "stitch" of a repo of the indexer's own. read: gives its payload, or None; commit: takes a record to publish."""

    def __init__(self, read: Callable[[], dict | None], commit: Callable[[dict], object]) -> None:
        self.read, self.commit = read, commit

    def load(self, patterns: list[str] | None = None) -> Stitch | None:
        held = self.read()
        return None if held is None or patterns is not None and held["patterns"] != patterns else Stitch(**held)

    def table(self, name: str) -> None:
        return None

    def save(self, stitch: Stitch, tables: dict[str, DataFrame]) -> int:
        self.commit({"id": "stitch", "type": "stitch", "payload": asdict(stitch)})
        return 0


def view(records: DataFrame) -> DataFrame:
    """What a view shows of records, in key order."""
    return records.select("publisher", "repo", "id", "cid", "type", "payload").orderBy("publisher", "repo", "id")


def write_view(records: DataFrame, stitch: Stitch, path: str, refused: DataFrame | None = None) -> dict:
    """The view as JSON lines in a new folder named by the root, and a manifest that points to it, replaced last. refused: what a gate left out, and why. Fails if what was written can't be read back."""
    spark, files = records.sparkSession, Files(records.sparkSession, path)
    rows = f"{path}/root={stitch.root}"
    view(records).write.mode("overwrite").json(rows)
    n = spark.read.text(rows).count()
    manifest = {"root": stitch.root, "t": stitch.t, "records": n, "rows": rows}
    if refused is not None:
        manifest["refused"] = f"{path}/refused={stitch.root}"
        refused.write.mode("overwrite").json(manifest["refused"])
    files.replace("manifest", json.dumps(manifest, sort_keys=True).encode())
    if read_manifest(spark, path) != manifest:
        raise OSError("the view did not land")
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    raw = Files(spark, path).latest("manifest")
    return None if raw is None else json.loads(raw)


def publish_view(manifest: dict, commit: Callable[[dict], object], read: Callable[[str], dict | None]) -> dict:
    """A record "view" that points to a view, published by commit; fails if read("view") doesn't give it back."""
    record = {"id": "view", "type": "view", "payload": {"src": manifest["rows"], "root": manifest["root"], "t": manifest["t"], "records": manifest["records"]}}
    commit(record)
    if (read("view") or {}).get("payload") != record["payload"]:
        raise OSError("the view did not land")
    return record


def seed(records: DataFrame) -> DataFrame:
    """The records without vectors: whoever starts from them embeds anew."""
    return records.withColumn("vec", F.lit(None).cast("array<float>"))


def write_seed(store: SnapshotStore, root: str) -> SnapshotStore:
    """A new store with the stitch and the records of another, without vectors and without the name of what made them."""
    now = store.load()
    if now is None:
        raise LookupError("nothing is saved yet")
    out = SnapshotStore(store.spark, root)
    out.save(Stitch(now.root, now.t, now.patterns), {"records": seed(store.table("records")), **{n: store.table(n) for n in ("heads", "verdicts") if store.table(n) is not None}})
    return out


class Blobs:
    """Content-addressed bytes: a file is named by the SHA-256 of its content."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root, Files(spark, root)

    def put(self, data: bytes) -> str:
        cid = hashlib.sha256(data).hexdigest()
        if not self.files.fs.exists(self.files.path(cid)):
            self.files.put(cid, data)
        return cid

    def table(self) -> DataFrame:
        """cid, bytes and content of all blobs, to join."""
        found = self.spark.read.format("binaryFile").load(self.root)
        return found.select(F.element_at(F.split("path", "/"), -1).alias("cid"), F.col("length").alias("bytes"), "content").where("cid RLIKE '^[0-9a-f]{64}$'")

    def get(self, cid: str) -> bytes | None:
        return self.files.read(cid)
