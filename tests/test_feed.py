"""A log behind a service, as tables and streams."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

from palimpsest.model import update_log
from palimpsest.operators.log import stitch
from palimpsest.sources.feed import Blocks, HttpFeed, between, parts, register
from palimpsest.streaming.follow import following

FOLDER = "/root/testdata/sf0.001"
SCHEMA = StructType([StructField(c, LongType() if c in ("pos", "t") else StringType()) for c in ("pos", "t", "publisher", "repo", "parent", "head")])


class Service:
    """Serves entries, and remembers what was asked for."""

    def __init__(self, entries):
        self.entries, self.asked, self.breaks, self.lock = entries, [], 0, threading.Lock()
        service = self

        class Handler(BaseHTTPRequestHandler):
            def do_GET(self):
                at, query = urlsplit(self.path), parse_qs(urlsplit(self.path).query)
                if at.path == "/clock":
                    body = json.dumps(max((e["t"] for e in service.entries), default=None)).encode()
                else:
                    first, last, repo = int(query["from"][0]), int(query["to"][0]), query.get("repo", [None])[0]
                    body = "".join(json.dumps(e) + "\n" for e in service.entries if first <= e["t"] <= last and repo in (None, e.get("repo"))).encode()
                    with service.lock:
                        service.asked.append((first, last, repo))
                        service.breaks -= 1
                        cut = service.breaks >= 0
                self.send_response(200)
                self.send_header("Content-Length", str(len(body)))
                self.end_headers()
                self.wfile.write(body[: body.index(b"\n") + 1] if at.path != "/clock" and cut else body)

            def log_message(self, *_):
                pass

        self.server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        self.url = f"http://127.0.0.1:{self.server.server_port}"


@pytest.fixture
def service():
    made = []

    def serve(entries):
        made.append(Service(entries))
        return made[-1]

    yield serve
    for s in made:
        s.server.shutdown()


def entries_of(spark):
    return [r.asDict() for r in update_log(spark, FOLDER).select(*SCHEMA.names).orderBy("pos").collect()]


def test_a_log_as_a_table(spark, service):
    s = service(entries_of(spark))
    register(spark, "log_table", HttpFeed(s.url), SCHEMA)
    log = spark.read.format("log_table").option("blocks", 2).load()
    assert sorted(log.collect()) == sorted(update_log(spark, FOLDER).select(*SCHEMA.names).collect())
    last = max(e["t"] for e in s.entries)
    assert sorted(s.asked) == [(at, min(at + 1, last), None) for at in range(0, last + 1, 2)]
    key = ["publisher", "repo"]
    assert sorted(stitch(log, ["*"], last).select(*key, "head").collect()) == sorted(stitch(update_log(spark, FOLDER), ["*"], last).select(*key, "head").collect())


def test_ranges_reach_the_service(spark, service):
    s = service(entries_of(spark))
    register(spark, "log_ranges", HttpFeed(s.url), SCHEMA)
    some = between(spark, "log_ranges", 3, 7, "click")
    want = [e["pos"] for e in s.entries if 3 <= e["t"] <= 7 and e["repo"] == "click"]
    assert sorted(r.pos for r in some.collect()) == want and want
    assert s.asked == [(3, 7, "click")]
    assert some.where("t = 4").count() == sum(e["t"] == 4 and e["repo"] == "click" for e in s.entries) > 0
    s.asked.clear()
    assert between(spark, "log_ranges", 5, 3).count() == 0 and between(spark, "log_ranges", 1000).count() == 0 and not s.asked


def test_a_frame_used_more_than_once(spark, service):
    """Conditions of one use of a frame are none of another's."""
    s = service(entries_of(spark))
    register(spark, "log_again", HttpFeed(s.url), SCHEMA)
    log = spark.read.format("log_again").option("blocks", 3).load()
    n = lambda t: sum(e["t"] == t for e in s.entries)
    assert log.where("t = 4").count() == n(4)
    assert log.count() == len(s.entries)
    assert sorted(r.t for r in log.where("t = 1").union(log.where("t = 8")).collect()) == [1] * n(1) + [8] * n(8)


def test_odd_logs(spark, service):
    s = service([])
    register(spark, "log_odd", HttpFeed(s.url), SCHEMA)
    log = spark.read.format("log_odd").load()
    assert log.count() == 0 and log.columns == SCHEMA.names
    s.entries = [{"t": 1, "pos": None, "publisher": None, "more": 3}, {"t": 1, "pos": 5, "repo": "ä b&c"}, {"t": 1, "pos": 5, "repo": "ä b&c"}]
    assert log.count() == 0  # a frame stays as it was first read
    log = spark.read.format("log_odd").load()
    assert sorted((r.pos or 0, r.publisher, r.repo) for r in log.collect()) == [(0, None, None), (5, None, "ä b&c"), (5, None, "ä b&c")]
    assert between(spark, "log_odd", repo="ä b&c").count() == 2 and s.asked[-1] == (0, 1, "ä b&c")
    assert between(spark, "log_odd", 2).count() == 0 and between(spark, "log_odd", 1, 9).count() == 3
    with pytest.raises(ValueError, match="column t"):
        register(spark, "log_without", HttpFeed(s.url), StructType([StructField("pos", LongType())]))


def test_an_answer_that_breaks_off(spark, service):
    s = service([{"t": 0, "pos": n, "repo": "r"} for n in range(100)])
    s.breaks = 1
    with pytest.raises(Exception, match="of blocks 0 to 0|IncompleteRead"):
        list(HttpFeed(s.url).entries(0, 0, None))
    assert len(list(HttpFeed(s.url).entries(0, 0, None))) == 100


def test_parts():
    assert [b.value for b in parts(0, 9, 4)] == [(0, 3), (4, 7), (8, 9)]
    assert parts(5, 4, 4) == [] and repr(Blocks(1, 2)) == "Blocks(1, 2)"


def test_a_log_as_a_stream_that_goes_on(spark, service, tmp_path):
    all_entries = entries_of(spark)
    s = service([e for e in all_entries if e["t"] <= 5])
    register(spark, "log_stream", HttpFeed(s.url), SCHEMA)
    seen = []

    def run():
        stream = spark.readStream.format("log_stream").option("blocks", 2).load()
        q = following(stream, ["click", "view"], lambda df, n: seen.extend(r.pos for r in df.collect()), str(tmp_path / "checkpoint"))
        assert q.awaitTermination(120)

    want = lambda: [e["pos"] for e in s.entries if e["repo"] in ("click", "view")]
    run()
    assert sorted(seen) == want() and seen
    run()
    assert sorted(seen) == want()  # nothing new
    s.entries = all_entries
    s.asked.clear()
    run()
    assert sorted(seen) == want() and min(first for first, _, _ in s.asked) == 6
