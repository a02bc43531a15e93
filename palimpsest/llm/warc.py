"""WARC archives: a writer that stores repeated payloads once, and a salvage reader.

The writer makes each record as a column expression, compresses it as a gzip member of its own, and leaves the files to Spark's text sink, so they go wherever Spark writes and a lost task is written again. A task joins members to archives of about ARCHIVE bytes, however large or small records are. The sink wants something behind each row; it gets an empty member, which readers of gzip pass over. Of equal payloads of at least MIN_PAYLOAD bytes that with the smallest id is a response, the others are revisits that refer to it. It is found from digests and ids alone; payloads are moved only where too many digests repeat to be sent to all executors.

The reader takes plain and gzip archives, with a member for each record or for many. It checks version line, header, length, the two line ends behind a record and the digests. After a failed check it goes on where the record should have ended if its length holds, else it searches for the next version line or member that passes, and logs the bytes between as a quarantined gap. A record found before the end that a damaged one declares may have been part of its payload: it is given as suspect. Of a member that can't be read to its end the records before the damage are kept.

Null payloads are empty. Rows that repeat the smallest id of a payload are all responses. A null id is written as an empty one and read as null; it is never the one referred to. Line ends in a url become blanks; urls and payloads can be of any length. An empty table gives no archive and an empty result.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import cut, shared_dir

MIN_PAYLOAD = 100
#: Bytes of an archive, about, but for a record that is larger by itself; a reader's task holds one at a time.
ARCHIVE = 16 << 20
#: Digests that are sent to all executors, some hundred bytes each.
MOST_BROADCAST = 100_000
DATE = "2024-01-01T00:00:00Z"
URN = "urn:x-page:"
END = "\r\n\r\n"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER = b"\x1f\x8b\x08"
PIECE = 1 << 14
EMPTY = gzip.compress(b"", mtime=0)


def deduplicated(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = MIN_PAYLOAD, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """key, url, payload, digest (SHA-256), bytes and first, the smallest key with this payload where it is another's."""
    rows = df.select(df[key].alias("key"), df[url].alias("url"), F.coalesce(df[payload], F.lit("")).alias("payload"))
    rows = rows.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload").cast("long")})
    firsts = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    firsts = cut(firsts)
    firsts = F.broadcast(firsts) if firsts.count() <= most_broadcast else firsts
    return rows.join(firsts, "digest", "left").withColumn("first", F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first")))


def record(date: str = DATE) -> Column:
    """A record, but for the two line ends behind it, from the columns of deduplicated()."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\r\n"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    revisit = F.col("first").isNotNull()
    http = F.concat(line("HTTP/1.1 200 OK"), line("Content-Type: text/html; charset=utf-8"), line("Content-Length: ", text("bytes")), F.lit("\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    head = F.concat(
        line("WARC/1.1"),
        line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        line(f"WARC-Record-ID: <{URN}", text("key"), ">"),
        line(f"WARC-Date: {date}"),
        line("WARC-Target-URI: ", F.regexp_replace(text("url"), r"[\r\n]+", " ")),
        F.when(revisit, F.concat(line(f"WARC-Refers-To: <{URN}", text("first"), ">"), line("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        line("Content-Type: application/http; msgtype=response"),
        line("WARC-Payload-Digest: sha256:", F.col("digest")),
    )
    return F.concat(head, line("WARC-Block-Digest: sha256:", F.sha2(block, 256)), line("Content-Length: ", F.octet_length(block).cast("string")), F.lit("\r\n"), block)


def write_warc(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", least: int = MIN_PAYLOAD, archive: int = ARCHIVE) -> None:
    """Archives of about so many bytes in the folder path, with a record for each row of df."""
    records = deduplicated(df, key, url, payload, least).select(F.encode(F.concat(record(), F.lit(END)), "UTF-8").alias("value"))

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        give = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
        for batch in batches:
            for r in batch.column(0):
                member = gzip.compress(r.as_py(), 6, mtime=0)
                if held and size + len(member) > archive:
                    yield give()
                    held, size = [], 0
                held.append(member)
                size += len(member)
        if held:
            yield give()

    # Strings of Spark are bytes: the cast leaves them as they are. Latin-1 does the same for the separator. A row is an archive, and a file.
    zipped = records.mapInArrow(archives, "value binary").select(F.col("value").cast("string"))
    sink = zipped.write.option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").option("compression", "none")
    sink.option("maxRecordsPerFile", 1).text(path)


@dataclass
class Record:
    """A record that passed all checks, or, with a reason, a gap. start and end are bytes in the file; of the records of one gzip member all but the first have none of their own. suspect: it lies where a damaged record should be."""

    start: int
    end: int
    reason: str | None = None
    headers: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""
    suspect: bool = False

    def get(self, name: str) -> str | None:
        return self.headers.get(name)


class Damaged(Exception):
    """end: where the record ends by its length, as far as that is known; whole: whether it does end there."""

    def __init__(self, why: str, end: int | None = None, whole: bool = False) -> None:
        super().__init__(why)
        self.end, self.whole = end, whole


def one_record(data: bytes, at: int) -> Record:
    """The record whose version line is at this place."""
    version = VERSION.match(data, at)
    if not version:
        raise Damaged("no version line")
    later = VERSION.search(data, version.end())
    stop = data.find(b"\r\n\r\n", at, later.start() if later else len(data))
    if stop < 0:
        raise Damaged("no end of the header")
    headers = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header line without a colon")
        headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Damaged("no length")
    start, end = stop + 4, stop + 4 + int(length)
    if not headers.get("warc-type") or not headers.get("warc-record-id"):
        raise Damaged("no type or no name", end)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("no end of the record where its length says", end)
    block = data[start:end]
    check(headers.get("warc-block-digest"), block, "block", end + 4)
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        if not blank:
            raise Damaged("no end of the HTTP header", end + 4, True)
        for line in http.split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            headers[f"http:{name.decode('latin-1').strip().lower()}"] = value.decode("latin-1").strip()
    if headers.get("warc-type") != "revisit":
        check(headers.get("warc-payload-digest"), payload, "payload", end + 4)
    return Record(at, end + 4, None, headers, payload)


def check(digest: str | None, data: bytes, what: str, end: int) -> None:
    if digest and digest.startswith("sha256:") and hashlib.sha256(data).hexdigest() != digest[7:].lower():
        raise Damaged(f"another {what} digest", end, True)


def inflated(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at this place, where it ends, and what is wrong with it; the content before the damage if something is."""
    inflate, parts, end, why = zlib.decompressobj(31), [], at, None
    try:
        while not inflate.eof and end < len(data):  # a piece at a time, as what is left over is copied
            piece = data[end : end + PIECE]
            parts.append(inflate.decompress(piece))
            end += len(piece)
    except zlib.error:
        why = "a damaged member"
    if not inflate.eof:
        why = why or "an unfinished member"
    return b"".join(parts), end - len(inflate.unused_data), why


STARTS = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")


def salvage(data: bytes) -> Iterator[Record]:
    """Records and gaps of an archive, in order; together they cover all of it but empty members."""
    at, gap, until = 0, None, 0
    while at < len(data):
        found, end, why = [], None, None
        if data.startswith(MEMBER, at):
            inner, end, why = inflated(data, at)
            found = [r for r in salvage(inner) if why is None or r.reason is None]
            if why is not None:
                end = at if found else None  # what comes before the damage is kept, the member's bytes are a gap
            elif inner and all(r.reason for r in found):
                found, why = [], found[0].reason if found else "a member without a record"
        else:
            try:
                one = one_record(data, at)
                found, end = [one], one.end
            except Damaged as e:
                why = str(e)
                if e.end is not None and at < e.end <= len(data):
                    until = max(until, e.end)
                    # Its length holds, or a record begins where it says: what lies within is its own.
                    after = [e.end + k for k in (0, 4) if VERSION.match(data, e.end + k)]
                    end = e.end if e.whole else after[0] if after else None
        if gap and (found or why is None):
            yield Record(gap[0], at, gap[1])
            gap = None
        for k, r in enumerate(found):
            yield Record(at if k == 0 else end, end, r.reason, r.headers, r.payload, r.suspect or at < until)
        if why is None:
            at = end
            continue
        gap = gap or (at, why)
        if end is None or end <= at:
            later = STARTS.search(data, at + 1)
            end = later.start() if later else len(data)
        at = end
    if gap:
        yield Record(gap[0], len(data), gap[1])


SCHEMA = "file string, start long, end long, gap string, record_type string, record_id string, refers_to string, url string, payload_digest string, payload_bytes long, suspect boolean, payload binary"


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """A row for each record, and for each gap, whose column gap says which check failed. Digest and bytes are those of the full payload, as a revisit's header has them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.bool_(), pa.binary()]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out = []
                for r in salvage(content.as_py()):
                    revisit = r.get("warc-type") == "revisit"
                    digest = (r.get("warc-payload-digest") or "").removeprefix("sha256:").lower() if revisit else hashlib.sha256(r.payload).hexdigest()
                    size = int(r.get("http:content-length") or 0) if revisit else len(r.payload)
                    gap = r.reason is not None
                    out.append((file, r.start, r.end, r.reason, *((None,) * 8 if gap else (r.get("warc-type"), r.get("warc-record-id"), r.get("warc-refers-to"), r.get("warc-target-uri"), digest, size, r.suspect, r.payload if payload else None))))
                columns = zip(*out, strict=True) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(rows, SCHEMA)


def page_key(urn: str) -> Column:
    """The key in a record's name, as text; null for an empty one."""
    return F.nullif(F.regexp_extract(urn, f"<{URN}([^>]*)>", 1), F.lit(""))


def round_trip(df: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", payloads: bool = False) -> DataFrame:
    """What read_warc() finds in the archives that write_warc() makes of df, in a new folder in the shared one."""
    path = f"{shared_dir(df.sparkSession)}/warc-{uuid.uuid4().hex}"
    write_warc(df, path, key, url, payload)
    return read_warc(df.sparkSession, path, payloads)


def without_gaps(found: DataFrame) -> DataFrame:
    """Records of archives that must be whole: a gap is an error."""
    broken = F.raise_error(F.concat(F.lit("a gap in "), "file", F.lit(": "), "gap"))
    return found.where(F.when(F.col("gap").isNull(), F.lit(True)).otherwise(broken.cast("boolean")))
