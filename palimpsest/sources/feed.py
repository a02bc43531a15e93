"""A log behind a service as a source of Spark: blocks of entries are fetched by the tasks, a range of blocks each, for tables and for streams.

A feed is any picklable object with clock(), the last block that is complete (None: there is none yet), and entries(first, last, repo), the entries of these blocks, both included, as dictionaries; repo, where not None, lets it leave out those of other repos. HttpFeed is one. The blocks to fetch, and a repo, are said when a log is read (between()). Conditions of a query are Spark's alone: Spark 4.1 keeps the conditions that a Python source takes over with the frame it has read, so that any other use of this frame would lose rows. Positions of a stream are blocks, so a stream that goes on from its checkpoint fetches each block once more at most, if a batch is repeated.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any, Protocol
from urllib.parse import urlencode
from urllib.request import urlopen

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Blocks a task fetches, and entries a batch of rows holds.
BLOCKS, ROWS = 10_000, 5_000


class Feed(Protocol):
    def clock(self) -> int | None: ...

    def entries(self, first: int, last: int, repo: str | None) -> Iterator[dict[str, Any]]: ...


@dataclass(frozen=True)
class HttpFeed:
    """A service that answers GET /clock with a number or null, and GET /entries?from=&to=[&repo=] with a line of JSON for each entry. An answer that breaks off is an error, which Spark meets by another try."""

    url: str
    seconds: float = 60

    def clock(self) -> int | None:
        with urlopen(f"{self.url}/clock", timeout=self.seconds) as answer:
            return json.load(answer)

    def entries(self, first: int, last: int, repo: str | None) -> Iterator[dict[str, Any]]:
        asked = {"from": first, "to": last} | ({} if repo is None else {"repo": repo})
        with urlopen(f"{self.url}/entries?{urlencode(asked)}", timeout=self.seconds) as answer:
            length, read = answer.headers.get("Content-Length"), 0
            for line in answer:
                read += len(line)
                if line.strip():
                    yield json.loads(line)
            if length is not None and read < int(length):
                raise EOFError(f"{read} of {length} bytes of blocks {first} to {last}")


class Blocks(InputPartition):
    """The blocks from first to last."""

    def __init__(self, first: int, last: int) -> None:
        super().__init__((first, last))

    def __repr__(self) -> str:
        return f"Blocks{self.value}"


def parts(first: int, last: int, width: int) -> list[Blocks]:
    return [Blocks(at, min(at + width - 1, last)) for at in range(first, last + 1, width)]


@dataclass
class Fetch:
    """What both readers share: how a task turns its blocks into rows."""

    feed: Feed
    schema: StructType
    width: int
    repo: str | None = None

    def rows(self, blocks: Blocks) -> Iterator[pa.RecordBatch]:
        first, last = blocks.value
        schema, held = to_arrow_schema(self.schema), []
        for entry in self.feed.entries(first, last, self.repo):
            if not first <= entry["t"] <= last:
                raise ValueError(f"block {entry['t']} is not between {first} and {last}")
            held.append(entry)
            if len(held) == ROWS:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)


class LogReader(DataSourceReader):
    def __init__(self, fetch: Fetch, first: int, last: int | None) -> None:
        self.fetch, self.first, self.last = fetch, first, last

    def partitions(self) -> list[InputPartition]:
        clock = self.fetch.feed.clock()
        if clock is None:
            return []
        return parts(self.first, clock if self.last is None else min(self.last, clock), self.fetch.width)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        # Spark asks for a task even where there are no blocks.
        return iter(()) if partition is None else self.fetch.rows(partition)


class LogStream(DataSourceStreamReader):
    def __init__(self, fetch: Fetch, first: int) -> None:
        self.fetch, self.first = fetch, first

    def initialOffset(self) -> dict[str, int]:
        """t: the last block that has been read."""
        return {"t": self.first - 1}

    def latestOffset(self) -> dict[str, int]:
        clock = self.fetch.feed.clock()
        return {"t": self.first - 1 if clock is None else max(clock, self.first - 1)}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[InputPartition]:
        return parts(start["t"] + 1, end["t"], self.fetch.width)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else self.fetch.rows(partition)

    def commit(self, end: dict[str, int]) -> None:
        pass


def register(spark: SparkSession, name: str, feed: Feed, columns: StructType) -> None:
    """Makes a feed a format, for spark.read and spark.readStream: format(name).load(), with the options first (the first block, 0), last (for tables; else the feed's clock), repo (all) and blocks (of a task, 10,000). columns: t is among them; an entry without a column has a null there, and what it has besides is left out. A frame is the log as it was when it was first read; load again for what has come since. An empty log gives no rows; so does a range that ends before it begins."""
    if "t" not in columns.names:
        raise ValueError("a log has a column t, the block")

    class Log(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> StructType:
            return columns

        def _fetch(self) -> Fetch:
            width = int(self.options.get("blocks", BLOCKS))
            if width < 1:
                raise ValueError("blocks is at least 1")
            return Fetch(feed, columns, width, self.options.get("repo"))

        def reader(self, schema: StructType) -> DataSourceReader:
            last = self.options.get("last")
            return LogReader(self._fetch(), int(self.options.get("first", 0)), None if last is None else int(last))

        def streamReader(self, schema: StructType) -> DataSourceStreamReader:
            return LogStream(self._fetch(), int(self.options.get("first", 0)))

    spark.dataSource.register(Log)


def between(spark: SparkSession, name: str, first: int = 0, last: int | None = None, repo: str | None = None) -> DataFrame:
    """The entries of a registered log in these blocks, both included, of one repo or of all. No other block is fetched; a feed may give other repos all the same."""
    said = {"first": first, "last": last, "repo": repo}
    log = spark.read.format(name).options(**{k: v for k, v in said.items() if v is not None}).load()
    return log if repo is None else log.where(F.col("repo") == repo)
