"""Queries over the test tables, one for each operator of the index, and the same in SQL."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest import model
from palimpsest.functions import tables
from palimpsest.functions import text as tx
from palimpsest.functions import vectors as vx
from palimpsest.model import KEY, REPO, ZERO_HEAD, table
from palimpsest.operators import commits, fold, fulltext, gate, hashtree, lexical, log, maintain, nearest, ranking, search, upsert
from palimpsest.operators.numbering import numbered, shared_dir
from palimpsest.sources import store
from palimpsest.streaming import follow

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

QUERY = "moron scum thing-of"
VECTOR = 7
CHECKERS = {"note": "check-note", "page": "check-page", "book": "check-book"}

TYPE = "CASE WHEN n_chars < 500 THEN 'note' WHEN n_chars < 3000 THEN 'page' ELSE 'book' END"
RECORDS = f"records AS (SELECT doc_id AS rowseq, source AS publisher, lang AS repo, CAST(doc_id AS VARCHAR) AS id, sha256(text) AS cid, {TYPE} AS type, text, n_chars FROM documents)"
VERDICTS = f"""verdicts AS (SELECT source AS publisher, lang AS repo, CAST(d.doc_id AS VARCHAR) AS id, CASE WHEN d.doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS cid, 'check-' || {TYPE} AS checker,
  CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN 'low quality' END AS reason FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""
LOG0 = "log0 AS (SELECT event_id AS pos, event_id // 100 AS t, ts, 'u' || user_id AS publisher, event_type AS repo, sha256('u' || user_id || '/' || event_type || '/' || event_id) AS head FROM events)"
LOG = f"{LOG0}, log AS (SELECT *, coalesce(lag(head) OVER (PARTITION BY publisher, repo ORDER BY pos), '0x0') AS parent FROM log0)"
CHANGES = "changes AS (SELECT event_id AS pos, 'u' || user_id AS publisher, 'events' AS repo, json_extract_string(props, '$.k') AS id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, CASE WHEN event_type <> 'error' THEN sha256(event_type || '|' || props) END AS cid, event_type AS type, props AS payload FROM events)"
TOKENS = f"{RECORDS}, toks AS (SELECT rowseq, publisher, repo, type, regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}]+') AS tokens FROM records)"
SEMANTIC = f"q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {VECTOR}), sem0 AS (SELECT vec_id AS rowseq, label, list_cosine_similarity(embedding::DOUBLE[], v) AS score FROM embeddings, q)"


def bm25_sql(words: list[list[str]]) -> str:
    """freq, stats and lex0 (rowseq, score) for phrases, behind TOKENS."""
    count = lambda p: f"len(list_filter(range(1, len(tokens) + 1), lambda i: {' AND '.join(f'tokens[i + {j}] = {chr(39)}{t}{chr(39)}' for j, t in enumerate(p))}))"
    n = range(len(words))
    freq = f"freq AS (SELECT *, len(tokens) AS len, {', '.join(f'{count(p)} AS f{i}' for i, p in enumerate(words))} FROM toks)"
    stats = f"stats AS (SELECT count(*) AS nd, avg(len) AS al, {', '.join(f'count(*) FILTER (f{i} > 0) AS n{i}' for i in n)} FROM freq)"
    idf = lambda i: f"CASE WHEN ln((nd - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((nd - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END"
    score = " + ".join(f"({idf(i)}) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * len / al))" for i in n)
    return f"{freq}, {stats}, lex0 AS (SELECT rowseq, publisher, repo, type, {score} AS score FROM freq, stats WHERE {' OR '.join(f'f{i} > 0' for i in n)})"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def vector(spark: SparkSession, d: str) -> list[float]:
    return list(table(spark, d, "embeddings").where(F.col("vec_id") == VECTOR).first()["embedding"])


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("rowseq"), F.col("embedding").alias("vec"), "label")


def scored(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("rowseq", "label", vx.cosine(F.col("vec"), vector(spark, d)).alias("score"))


def checker() -> Column:
    return gate.checker_of(F.col("type"), {k: CHECKERS[k] for k in ("note", "page")}, "check-book")


# Retrieval


def kept_index(s: SparkSession, d: str) -> fulltext.Kept:
    """The full-text index of the records, kept in the shared folder: built when it is first asked for, and anew when the files have changed."""
    files = store.Files(s, f"{d}/documents.parquet")
    listed = sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files.fs.listStatus(files.path("")))
    kept = store.SnapshotStore(s, f"{shared_dir(s)}/fulltext-{hashlib.sha256(' '.join(listed).encode()).hexdigest()[:32]}")
    if kept.load() is None:
        kept.save(store.Stitch("", 0, ["*"]), fulltext.built(model.records(s, d)))
    return fulltext.Kept(kept.table)


@query(f"WITH {SEMANTIC} SELECT rowseq, round(score, 6) AS score FROM sem0 ORDER BY round(score, 9) DESC, rowseq LIMIT 20")
def semantic_topk(s, d):
    return ranking.top(scored(s, d), 20, "rowseq").select("rowseq", F.round("score", 6).alias("score"))


@query(f"""WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {VECTOR}),
p AS (SELECT vec_id AS rowseq, list_transform(embedding, lambda x: greatest(-127, least(127, floor(x::DOUBLE * 127 + 0.5)))::DOUBLE) AS e FROM embeddings),
c AS (SELECT rowseq, list_cosine_similarity(e, v) AS score FROM p, q) SELECT rowseq, round(score, 6) AS score FROM c ORDER BY round(score, 9) DESC, rowseq LIMIT 20""")
def semantic_topk_int8(s, d):
    packed = vectors(s, d).select("rowseq", vx.int8(F.col("vec")).alias("vec"))
    return ranking.top(packed.select("rowseq", vx.cosine(F.col("vec"), vector(s, d)).alias("score")), 20, "rowseq").select("rowseq", F.round("score", 6).alias("score"))


@query(f"WITH {SEMANTIC} SELECT rowseq, label, round(score, 6) AS score FROM sem0 WHERE label IN (1, 3) ORDER BY round(score, 9) DESC, rowseq LIMIT 20")
def semantic_filtered_type(s, d):
    kept = vectors(s, d).where(F.col("label").isin(1, 3))
    return ranking.top(kept.select("rowseq", "label", vx.cosine(F.col("vec"), vector(s, d)).alias("score")), 20, "rowseq").select("rowseq", "label", F.round("score", 6).alias("score"))


@query("SELECT item_id, list_distinct_ordered AS terms FROM (SELECT item_id, (list_reduce(list_prepend([]::VARCHAR[], list_transform(regexp_extract_all(lower(text), '[^\\s\"]+'), lambda w: [w])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE list_concat(a, b) END))[1:64] AS list_distinct_ordered FROM benchmark)")
def lexical_terms(s, d):
    return table(s, d, "benchmark").select("item_id", tx.lexical_terms(F.col("text")).alias("terms"))


@query(f"WITH {TOKENS} SELECT rowseq, array_to_string(tokens, ' ') AS tokens FROM toks")
def lexical_tokens(s, d):
    return model.records(s, d).select("rowseq", F.array_join(tx.tokens(F.col("text")), " ").alias("tokens"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'said ' || event_type WHEN event_id % 3 = 1 THEN '' ELSE event_type END AS text FROM events")
def fts_text_source(s, d):
    """A payload's text counts before the record's, an empty one too; a null one doesn't."""
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("said "), "event_type")).when(F.col("event_id") % 3 == 1, "")
    payload = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(said.alias("text"), "value"))).otherwise(F.to_json(F.struct("value", said.alias("text")), {"ignoreNullFields": "false"}))
    return table(s, d, "events").select("event_id", tx.fts_text(payload, F.col("event_type")).alias("text"))


@query(f"WITH {TOKENS} SELECT count(*) AS n_docs, round(avg(len(tokens)), 6) AS avg_len, count(*) FILTER (list_contains(tokens, 'moron')) AS n_with FROM toks")
def bm25_corpus_stats(s, d):
    held = lexical.tokenized(model.records(s, d))
    return held.agg(F.count("*").alias("n_docs"), F.round(F.avg("len"), 6).alias("avg_len"), F.count_if(F.array_contains("tokens", "moron")).alias("n_with"))


@query(f"WITH {TOKENS}, {bm25_sql([['moron'], ['scum']])} SELECT rowseq, round(score, 6) AS score FROM lex0 ORDER BY round(score, 9) DESC, rowseq LIMIT 20")
def bm25_topk(s, d):
    """From a kept index, without reading ranges that can't hold a hit."""
    return kept_index(s, d).top("moron scum", 20).select("rowseq", F.round("score", 6).alias("score"))


@query(SQL["bm25_topk"])
def bm25_scanned(s, d):
    """The same by a scan of all texts."""
    return ranking.top(lexical.bm25(model.records(s, d), ["rowseq"], "moron scum"), 20, "rowseq").select("rowseq", F.round("score", 6).alias("score"))


@query(f"WITH {TOKENS}, {bm25_sql([['the'], ['of'], ['moron']])} SELECT rowseq, round(score, 6) AS score FROM lex0 ORDER BY round(score, 9) DESC, rowseq LIMIT 20")
def bm25_updated(s, d):
    """From an index over older texts of a part of the records, after an update that changes them, brings the others, and deletes what was never there now; two segments of it are one before the last."""
    r = model.records(s, d).select("rowseq", "text")
    kept = store.SnapshotStore(s, f"{shared_dir(s)}/index-{uuid.uuid4().hex}")
    middle = r.agg(F.max("rowseq")).first()[0] // 2
    older = F.when(F.length("text") % 2 == 0, F.concat(F.lit("moron of "), F.substring("text", 1, 50))).otherwise(F.col("text"))
    old = r.where(F.col("rowseq") <= middle).withColumn("text", older).unionByName(r.where(F.col("rowseq") <= middle).withColumn("rowseq", F.col("rowseq") + 10_000_000))
    stitch = store.Stitch("", 0, ["*"])
    kept.save(stitch, fulltext.built(old))
    kept.save(stitch, fulltext.renewed(kept.table, old.where(F.col("rowseq") > 10_000_000), r.where(F.col("rowseq") > middle)))
    kept.save(stitch, fulltext.merged(kept.table))
    changed = r.where((F.col("rowseq") <= middle) & (F.length("text") % 2 == 0))
    left = old.where("rowseq = 10000000").unionByName(old.join(changed.select("rowseq"), "rowseq", "left_semi"))
    kept.save(stitch, fulltext.renewed(kept.table, left, changed))
    return fulltext.Kept(kept.table).top("the of moron", 20).select("rowseq", F.round("score", 6).alias("score"))


@query(f"WITH {TOKENS}, {bm25_sql([['of', 'the'], ['moron']])} SELECT rowseq, round(score, 6) AS score FROM lex0 ORDER BY round(score, 9) DESC, rowseq LIMIT 20")
def bm25_phrase(s, d):
    return ranking.top(lexical.bm25(model.records(s, d), ["rowseq"], "of-the moron"), 20, "rowseq").select("rowseq", F.round("score", 6).alias("score"))


@query(f"WITH {TOKENS}, {bm25_sql([['moron'], ['scum']])} SELECT rowseq, round(score, 6) AS score FROM lex0 WHERE repo = 'en' AND type = 'page' ORDER BY round(score, 9) DESC, rowseq LIMIT 20")
def bm25_filtered_keeps_global_stats(s, d):
    r = model.records(s, d)
    found = lexical.bm25(r, ["rowseq"], "moron scum").join(r.where(search.filters(repo=["en"], type=["page"])).select("rowseq"), "rowseq", "left_semi")
    return ranking.top(found, 20, "rowseq").select("rowseq", F.round("score", 6).alias("score"))


@query(f"WITH {TOKENS}, t AS (SELECT rowseq, len(tokens) AS len, unnest(tokens) AS term, unnest(range(len(tokens))) AS place FROM toks) SELECT term, rowseq, CAST(len AS INTEGER) AS len, array_to_string(list(place ORDER BY place), ',') AS places FROM t GROUP BY term, rowseq, len")
def fts_postings(s, d):
    """The index that a store keeps."""
    return lexical.postings(model.records(s, d)).select("term", "rowseq", "len", F.array_join(F.col("places").cast("array<string>"), ",").alias("places"))


@query(f"WITH {TOKENS}, {bm25_sql([['of', 'the'], ['moron']])} SELECT rowseq, round(score, 6) AS score FROM lex0 ORDER BY round(score, 9) DESC, rowseq LIMIT 20")
def bm25_indexed(s, d):
    """A search of postings, by its terms alone."""
    r = model.records(s, d)
    return ranking.top(lexical.bm25_of(lexical.postings(r), lexical.lengths(r), "of-the moron"), 20, "rowseq").select("rowseq", F.round("score", 6).alias("score"))


def own_scores(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").cast("long").alias("rowseq"), "place", F.round("score", 6).alias("score"))


@query(f"WITH {SEMANTIC}, {RECORDS} SELECT rowseq, CAST(row_number() OVER (ORDER BY round(s.score, 9) DESC, rowseq) AS INTEGER) AS place, round(s.score, 6) AS score FROM sem0 s JOIN records r USING (rowseq) WHERE r.type = 'page' QUALIFY place <= 10")
def search_d1_semantic(s, d):
    """By a vector: cosines themselves, of one type."""
    return own_scores(search.search_by_vector(model.records(s, d), vectors(s, d), vector(s, d), type="page"))


@query(f"WITH {TOKENS}, {bm25_sql([['moron'], ['scum'], ['thing', 'of']])} SELECT rowseq, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, rowseq) AS INTEGER) AS place, round(score, 6) AS score FROM lex0 QUALIFY place <= 10")
def search_d1_lexical(s, d):
    """By keywords: BM25 itself."""
    return own_scores(search.search_by_vector(model.records(s, d), vectors(s, d), vector(s, d), mode="lexical", keywords=QUERY))


def hybrid_sql(kept: str, score: str = "score", k: int = 10) -> str:
    return f"""WITH {TOKENS}, {VERDICTS}, {SEMANTIC}, {bm25_sql([['moron'], ['scum'], ['thing', 'of']])},
ok AS ({kept}),
sem AS (SELECT rowseq, row_number() OVER (ORDER BY round(score, 9) DESC, rowseq) AS sr FROM sem0 WHERE rowseq IN (SELECT rowseq FROM ok) QUALIFY sr <= 50),
lex AS (SELECT rowseq, row_number() OVER (ORDER BY round(score, 9) DESC, rowseq) AS lr FROM lex0 WHERE rowseq IN (SELECT rowseq FROM ok) QUALIFY lr <= 50),
fused AS (SELECT coalesce(sem.rowseq, lex.rowseq) AS rowseq, sr, lr, coalesce(1.0::DOUBLE / (60 + sr), 0) + coalesce(1.0::DOUBLE / (60 + lr), 0) AS score FROM sem FULL JOIN lex ON sem.rowseq = lex.rowseq),
best AS (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, sr NULLS LAST, lr NULLS LAST) AS place FROM fused QUALIFY place <= {k})
SELECT r.publisher, r.repo, r.id, r.cid, r.type, round(score, 9) AS score, CAST(place AS INTEGER) AS place FROM best JOIN records r ON r.rowseq = best.rowseq"""


def hits(df: DataFrame) -> DataFrame:
    return df.select("publisher", "repo", "id", "cid", "type", F.round("score", 9).alias("score"), "place")


@query(hybrid_sql("SELECT rowseq FROM records"))
def hybrid_search(s, d):
    return hits(search.search(model.records(s, d), vectors(s, d), QUERY, vector(s, d), index=kept_index(s, d)))


@query(hybrid_sql("SELECT r.rowseq FROM records r JOIN verdicts v ON r.publisher = v.publisher AND r.repo = v.repo AND r.id = v.id AND r.cid = v.cid AND 'check-' || r.type = v.checker AND v.reason IS NULL"))
def hybrid_search_gated(s, d):
    r = model.records(s, d)
    return hits(search.search(r, vectors(s, d), QUERY, vector(s, d), allowed=gate.allowed(r, model.verdicts(s, d), checker()).select("rowseq"), index=kept_index(s, d)))


@query(hybrid_sql("SELECT rowseq FROM records WHERE repo IN ('en', 'de') AND type = 'page'"))
def hybrid_search_filtered(s, d):
    return hits(search.search(model.records(s, d), vectors(s, d), QUERY, vector(s, d), where=search.filters(repo=["en", "de"], type=["page"])))


@query(hybrid_sql("SELECT r.rowseq FROM records r JOIN verdicts v ON r.publisher = v.publisher AND r.repo = v.repo AND r.id = v.id AND r.cid = v.cid AND 'check-' || r.type = v.checker AND v.reason IS NULL"))
def search_d1_hybrid(s, d):
    """Both lists fused, behind a gate, from postings."""
    r = model.records(s, d)
    return hits(search.search_by_vector(r, vectors(s, d), vector(s, d), mode="hybrid", keywords=QUERY, allowed=gate.allowed(r, model.verdicts(s, d), checker()).select("rowseq"), index=kept_index(s, d)))


@query(f"WITH {SEMANTIC} SELECT rowseq, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, rowseq) AS INTEGER) AS place, round(1.0::DOUBLE / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, rowseq)), 9) AS score FROM sem0 WHERE rowseq IN (SELECT doc_id FROM documents) QUALIFY place <= 10")
def single_mode_rrf_score(s, d):
    found = search.search(model.records(s, d), vectors(s, d), QUERY, vector(s, d), mode="semantic")
    return found.select(F.col("id").cast("long").alias("rowseq"), "place", F.round("score", 9).alias("score"))


@query(f"""WITH {SEMANTIC}, a AS (SELECT rowseq, row_number() OVER (ORDER BY round(score, 9) DESC, rowseq) AS r FROM sem0 QUALIFY r <= 50),
b AS (SELECT vec_id AS rowseq, row_number() OVER (ORDER BY label, vec_id) AS r FROM embeddings QUALIFY r <= 50),
f AS (SELECT coalesce(a.rowseq, b.rowseq) AS rowseq, a.r AS semantic_rank, b.r AS lexical_rank, coalesce(1.0::DOUBLE / (60 + a.r), 0) + coalesce(1.0::DOUBLE / (60 + b.r), 0) AS score FROM a FULL JOIN b ON a.rowseq = b.rowseq)
SELECT rowseq, CAST(semantic_rank AS INTEGER) AS semantic_rank, CAST(lexical_rank AS INTEGER) AS lexical_rank, round(score, 9) AS score FROM f ORDER BY round(score, 12) DESC, semantic_rank NULLS LAST, lexical_rank NULLS LAST LIMIT 30""")
def rrf_fuse(s, d):
    a = ranking.ranked(ranking.top(scored(s, d), 50, "rowseq"), "rowseq")
    b = vectors(s, d).select("rowseq", (-F.col("label")).cast("double").alias("score"))
    fused = ranking.fuse(a, ranking.ranked(ranking.top(b, 50, "rowseq"), "rowseq"), "rowseq", 30)
    return fused.select("rowseq", "semantic_rank", "lexical_rank", F.round("score", 9).alias("score"))


# Many queries at once: every vector whose id is divisible by 20, against all

NEAREST = """e AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_transform(embedding, lambda x: x >= 0) AS s FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0),
pairs AS (SELECT q.vec_id AS query, e.vec_id AS rowseq, round(list_cosine_similarity(q.v, e.v), 9) AS score, list_sum(list_transform(list_zip(q.s, e.s), lambda x: CASE WHEN x[1] <> x[2] THEN 1 ELSE 0 END)) AS apart FROM q, e),
exact AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, rowseq) AS INTEGER) AS place FROM pairs QUALIFY place <= 10),
pool AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY query ORDER BY apart, rowseq) <= 80),
pooled AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, rowseq) AS INTEGER) AS place FROM pool QUALIFY place <= 10)"""


def _asked(s, d) -> tuple[DataFrame, DataFrame]:
    rows = table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec"))
    return rows.where(F.col("key") % 20 == 0), rows


def _places(found: DataFrame) -> DataFrame:
    return found.select("query", F.col("key").alias("rowseq"), "place", F.round("score", 6).alias("score"))


@query(f"WITH {NEAREST} SELECT query, rowseq, place, round(score, 6) AS score FROM exact")
def nearest_exact(s, d):
    return _places(nearest.nearest(*_asked(s, d), pool=None))


@query(f"WITH {NEAREST} SELECT query, rowseq, place, round(score, 6) AS score FROM pooled")
def nearest_by_signs(s, d):
    """Of a pool of 80 by their signs the 10 nearest."""
    return _places(nearest.nearest(*_asked(s, d)))


@query(f"WITH {NEAREST} SELECT round(count(p.rowseq) / count(*), 6) AS recall, round(avg(x.score), 6) AS exact_score, (SELECT round(avg(score), 6) FROM pooled) AS pooled_score FROM exact x LEFT JOIN pooled p ON x.query = p.query AND x.rowseq = p.rowseq")
def nearest_recall(s, d):
    """How much of the 10 nearest a pool by signs holds, and how near what it gives is beside them."""
    exact, pooled = (nearest.nearest(*_asked(s, d), pool=pool) for pool in (None, nearest.POOL))
    pooled = pooled.select("query", "key", F.col("score").alias("got"))
    both = exact.join(pooled, ["query", "key"], "full_outer")
    return both.agg(F.round(F.count_if(F.col("score").isNotNull() & F.col("got").isNotNull()) / F.count("score"), 6).alias("recall"), F.round(F.avg("score"), 6).alias("exact_score"), F.round(F.avg("got"), 6).alias("pooled_score"))


# Repos


@query(f"WITH {LOG} SELECT publisher, repo, max_by(head, pos) AS head, max(ts) AS updated FROM log GROUP BY ALL ORDER BY updated DESC, publisher, repo LIMIT 20")
def repos_find_newest(s, d):
    return model.update_log(s, d).groupBy(*REPO).agg(F.max_by("head", "pos").alias("head"), F.max("ts").alias("updated")).orderBy(F.desc("updated"), *REPO).limit(20)


REPOS = """repos AS (SELECT 'p' || label AS publisher, 'r' || vec_id AS repo, sha256(CAST(vec_id AS VARCHAR)) AS head, TIMESTAMP '2024-01-01' + to_seconds(vec_id // 3) AS updated,
  CASE WHEN vec_id % 4 <> 0 THEN 'card ' || vec_id END AS name, CASE WHEN vec_id % 4 <> 0 AND vec_id % 3 <> 0 THEN 'about ' || label END AS description, CASE WHEN vec_id % 5 <> 0 THEN embedding END AS vec FROM embeddings)"""


@query(f"WITH {REPOS}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {VECTOR}), c AS (SELECT publisher, repo, head, name, description, list_cosine_similarity(vec::DOUBLE[], v) AS score FROM repos, q WHERE vec IS NOT NULL) SELECT publisher, repo, head, name, description, round(score, 6) AS score FROM c ORDER BY round(score, 9) DESC, publisher, repo LIMIT 20")
def repos_find_semantic(s, d):
    """Repos by the vectors of their cards; those without one don't count."""
    return maintain.repos_find(model.repos(s, d), vector(s, d)).select(*REPO, "head", "name", "description", F.round("score", 6).alias("score"))


@query(f"WITH {REPOS} SELECT publisher, repo, head, name, description, strftime(updated, '%Y-%m-%d %H:%M:%S') AS updated FROM repos WHERE publisher = 'p1' ORDER BY repos.updated DESC, publisher, repo LIMIT 20")
def repos_find_of_publisher(s, d):
    return maintain.repos_find(model.repos(s, d), publisher="P1").select(*REPO, "head", "name", "description", F.date_format("updated", "yyyy-MM-dd HH:mm:ss").alias("updated"))


@query(f"WITH {REPOS} SELECT publisher, repo, head, name FROM repos WHERE repo = 'r7'")
def repos_get(s, d):
    p = model.repos(s, d).where("repo = 'r7'").first()["publisher"]
    return maintain.repos_get(model.repos(s, d), p.upper(), "r7").select(*REPO, "head", F.get_json_object("card", "$.name").alias("name"))


CARDS = """cards AS (SELECT p_partkey, 'part-' || p_partkey || '__v.' || p_size AS repo, p_partkey % 3 <> 0 AS has, p_name, CASE WHEN p_partkey % 50 = 1 THEN repeat(p_name || ' ', 400) ELSE p_type END AS about, p_brand, p_type FROM part)"""


@query(f"""WITH {CARDS} SELECT repo, left(regexp_replace(repo, '[-_.]+', ' ', 'g') || CASE WHEN has THEN chr(10) || p_name || chr(10) || about || chr(10) || p_brand || chr(10) || p_type || chr(10) || 'tag' ELSE '' END, 4000) AS text FROM cards""")
def repo_text(s, d):
    """Names with punctuation, and cards with skills and tags, some too long; some repos have none."""
    p = table(s, d, "part")
    about = F.when(F.col("p_partkey") % 50 == 1, F.repeat(F.concat("p_name", F.lit(" ")), 400)).otherwise(F.col("p_type"))
    skills = F.array(F.struct(F.col("p_brand").alias("name"), F.lit(None).cast("string").alias("description"), F.array("p_type", F.lit("tag")).alias("tags")))
    card = F.when(F.col("p_partkey") % 3 != 0, F.to_json(F.struct(F.col("p_name").alias("name"), about.alias("description"), skills.alias("skills"))))
    repo = F.concat(F.lit("part-"), F.col("p_partkey").cast("string"), F.lit("__v."), F.col("p_size").cast("string"))
    return p.select(repo.alias("repo"), tx.repo_text(repo, card).alias("text"))


# Gate

SAME = "r.publisher = v.publisher AND r.repo = v.repo AND r.id = v.id AND r.cid = v.cid AND v.checker = 'check-' || r.type"


@query(f"WITH {RECORDS}, {VERDICTS} SELECT publisher, repo, id FROM records r WHERE EXISTS (SELECT 1 FROM verdicts v WHERE {SAME} AND v.reason IS NULL)")
def gate_allowed(s, d):
    return gate.allowed(model.records(s, d), model.verdicts(s, d), checker()).select(*KEY)


@query(f"WITH {RECORDS}, {VERDICTS} SELECT publisher, repo, id FROM records r WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE {SAME})")
def gate_unchecked(s, d):
    return gate.unchecked(model.records(s, d), model.verdicts(s, d), checker()).select(*KEY)


@query(f"WITH {RECORDS}, {VERDICTS} SELECT r.publisher, r.repo, r.id, r.type, v.reason FROM records r JOIN verdicts v ON {SAME} WHERE v.reason IS NOT NULL")
def gate_refused(s, d):
    return gate.refused(model.records(s, d), model.verdicts(s, d), checker()).select(*KEY, "type", "reason")


@query(f"WITH {RECORDS} SELECT CASE type WHEN 'note' THEN 'check-note' WHEN 'page' THEN 'check-page' ELSE 'check-book' END AS checker, count(*) AS n FROM records GROUP BY ALL")
def checker_by_type(s, d):
    return model.records(s, d).groupBy(checker().alias("checker")).agg(F.count("*").alias("n"))


@query(f"WITH {VERDICTS} SELECT checker, count(*) AS checked, count(*) FILTER (reason IS NOT NULL) AS refused FROM verdicts GROUP BY ALL")
def check_counts(s, d):
    return model.verdicts(s, d).groupBy("checker").agg(F.count("*").alias("checked"), F.count_if(F.col("reason").isNotNull()).alias("refused"))


@query(f"WITH {RECORDS}, {VERDICTS} SELECT r.publisher, r.repo, r.id FROM records r JOIN verdicts v ON r.publisher = v.publisher AND r.repo = v.repo AND r.id = v.id WHERE r.cid <> v.cid")
def verdict_stale_cid(s, d):
    v = model.verdicts(s, d).select(*KEY, F.col("cid").alias("judged"))
    return model.records(s, d).join(v, KEY).where("cid <> judged").select(*KEY)


@query(f"WITH {RECORDS}, {VERDICTS} SELECT DISTINCT reason IS NULL AS allowed FROM verdicts v JOIN records r ON {SAME} WHERE r.rowseq = 1")
def gate_allows_one(s, d):
    one = model.records(s, d).where(F.col("rowseq") == 1)
    return gate.judged(one, model.verdicts(s, d), checker()).select(F.col("reason").isNull().alias("allowed")).distinct()


@query("SELECT event_id, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN 'type ' || event_type || ' is not listed' WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 50 THEN '#/k is too large' WHEN event_type = 'view' AND CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 1 THEN 'even: odd' END AS reason FROM events")
def check_records(s, d):
    base = gate.Checks({"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "maximum": 50}}})
    types = {"click": gate.Checks(), "purchase": gate.Checks(), "view": gate.Checks(rules=[gate.Rule("even", lambda record, context: True if record["payload"]["k"] % 2 == 0 else "odd")])}
    e = table(s, d, "events")
    r = e.select(F.col("event_id").cast("string").alias("id"), F.lit("p").alias("publisher"), F.lit("r").alias("repo"), F.lit("c").alias("cid"), F.col("event_type").alias("type"), F.col("props").alias("payload"))
    none = r.where(F.lit(False)).select(*KEY, "cid", F.lit("x").alias("checker"))
    return gate.check_missing(r, none, F.lit("x"), base, types).select(F.col("id").cast("long").alias("event_id"), "reason")


# Listings and aggregates


@query(f"WITH {RECORDS} SELECT publisher, repo, count(*) AS n FROM records GROUP BY ALL ORDER BY publisher, repo")
def repo_counts(s, d):
    return model.records(s, d).groupBy(*REPO).agg(F.count("*").alias("n")).orderBy(*REPO)


@query(f"WITH {RECORDS} SELECT count(*) AS n FROM records")
def record_count(s, d):
    return model.records(s, d).agg(F.count("*").alias("n"))


@query(f"WITH {RECORDS} SELECT publisher, repo, id, cid, type FROM records ORDER BY publisher, repo, id")
def rows_ordered(s, d):
    return store.view(model.records(s, d)).drop("payload")


@query(f"WITH {RECORDS} SELECT id, cid, count(*) OVER () AS total FROM records WHERE publisher = 'src1' AND repo = 'en' ORDER BY id LIMIT 100")
def repo_listing(s, d):
    one = model.records(s, d).where((F.col("publisher") == "src1") & (F.col("repo") == "en"))
    return one.select("id", "cid").orderBy("id").limit(100).crossJoin(F.broadcast(one.agg(F.count("*").alias("total"))))


@query(f"WITH {RECORDS} SELECT cid, min(rowseq) AS rowseq, count(*) AS copies FROM records GROUP BY cid HAVING count(*) > 1")
def content_dedup(s, d):
    return model.records(s, d).groupBy("cid").agg(F.min("rowseq").alias("rowseq"), F.count("*").alias("copies")).where("copies > 1")


@query("SELECT page_id, sha256(html) AS cid, CAST(strlen(html) AS INTEGER) AS bytes FROM pages")
def content_hash(s, d):
    return table(s, d, "pages").select("page_id", F.sha2("html", 256).alias("cid"), F.octet_length("html").alias("bytes"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS published FROM events GROUP BY ALL")
def daily_quota(s, d):
    return maintain.daily(model.update_log(s, d))


@query("SELECT event_id // 100 AS t, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS payers, sum(strlen(props)) AS bytes, count(*) FILTER (event_type = 'error') AS reverted FROM events GROUP BY ALL")
def metering(s, d):
    """A bill for each block."""
    e = table(s, d, "events").withColumn("t", F.floor(F.col("event_id") / 100))
    return fold.metering(e, "value", "user_id", "props", F.col("event_type") == "error", ["t"]).withColumn("total", F.round("total", 4))


@query(f"""WITH {CHANGES}, w AS (SELECT *, lag(cid) OVER (PARTITION BY publisher, repo, id ORDER BY pos) AS was, lead(pos) OVER (PARTITION BY publisher, repo, id ORDER BY pos) IS NULL AS last FROM changes),
came AS (SELECT publisher, row_number() OVER (ORDER BY min(pos), publisher) AS number FROM changes GROUP BY publisher),
sizes AS (SELECT unnest([8, 32, 96]) AS n)
SELECT n, count(DISTINCT w.publisher) AS followed, count(*) AS commits, count(*) FILTER (last AND op = 'put') AS records, count(*) FILTER (op = 'put' AND cid IS DISTINCT FROM was) AS embeds,
count(*) FILTER (op = 'put' AND cid IS NOT DISTINCT FROM was OR op = 'delete' AND was IS NULL) AS reverted FROM w JOIN came USING (publisher) JOIN sizes ON number <= n GROUP BY n""")
def growth(s, d):
    """What an index of 8, 32 and 96 publishers costs."""
    return fold.growth(model.changes(s, d), [8, 32, 96])


# Log and stitches. Where a query has an earlier point, it is the middle of the log, whatever its length; END is its end.

END = "(SELECT max(event_id) FROM events)"
HALF = "(SELECT max(event_id) // 2 FROM events)"
HALF_T = "(SELECT max(event_id // 100) // 2 FROM events)"


def end_of(s, d) -> int:
    return table(s, d, "events").agg(F.max("event_id")).first()[0]


def half_of(s, d) -> int:
    return end_of(s, d) // 2


def half_t(s, d) -> int:
    return end_of(s, d) // 100 // 2


@query(f"WITH {LOG} SELECT pos, t, publisher, repo, parent, head FROM log WHERE t BETWEEN {HALF_T} AND {END} // 100")
def log_range(s, d):
    return log.log_range(model.update_log(s, d), half_t(s, d), end_of(s, d) // 100).select("pos", "t", *REPO, "parent", "head")


@query(f"WITH {LOG} SELECT max(t) AS t FROM log")
def log_clock(s, d):
    return model.update_log(s, d).agg(F.max("t").alias("t"))


def _followed(patterns: list[str], where: str, name: str) -> None:
    QUERIES[name] = lambda s, d: model.update_log(s, d).where(log.matches(patterns)).select("pos", *REPO)
    SQL[name] = f"WITH {LOG0} SELECT pos, publisher, repo FROM log0 WHERE {where}"


_followed(["U1/click", "u2/view"], "publisher || '/' || repo IN ('u1/click', 'u2/view')", "pattern_filter_pairs")
_followed(["signup", "error"], "repo IN ('signup', 'error')", "pattern_filter_bare")
_followed(["*"], "TRUE", "pattern_filter_star")
_followed(["/^u1[0-9]*/(click|view)$/"], "regexp_matches(publisher || '/' || repo, '^u1[0-9]*/(click|view)$')", "pattern_filter_regex")


def _names(s, d) -> tuple[DataFrame, DataFrame]:
    """A catalogue of publishers and repos."""
    return table(s, d, "nation").select(F.col("n_name").alias("publisher")), table(s, d, "region").select(F.col("r_name").alias("repo"))


@query("SELECT n_name || '/' || r_name AS pattern FROM nation, region")
def pattern_expand(s, d):
    return log.expanded(*_names(s, d))


@query("SELECT DISTINCT r_name AS repo FROM region")
def repo_names(s, d):
    return log.names_in(log.expanded(*_names(s, d)))


PATTERNS = """patterns AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN 'U' || p_size || '/click' WHEN 1 THEN p_brand WHEN 2 THEN '/^u' || p_size || '[02]?\\/(view|error)$/' WHEN 3 THEN '/' || p_size || '.signup$/' ELSE p_type || '/purchase' END AS pattern FROM part)"""


@query(f"""WITH {LOG0}, {PATTERNS}, repos AS (SELECT DISTINCT publisher, repo, publisher || '/' || repo AS name FROM log0),
hit AS (SELECT DISTINCT publisher, repo FROM repos, patterns WHERE CASE WHEN starts_with(pattern, '/') THEN regexp_matches(name, pattern[2:-2]) WHEN contains(pattern, '/') THEN lower(split_part(pattern, '/', 1)) || substr(pattern, strpos(pattern, '/')) = name ELSE pattern = repo END)
SELECT pos, publisher, repo FROM log0 SEMI JOIN hit USING (publisher, repo)""")
def pattern_table(s, d):
    """What is followed by a table of patterns of all kinds, one for each part."""
    p, size = table(s, d, "part"), F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 5
    pattern = F.when(kind == 0, F.concat(F.lit("U"), size, F.lit("/click"))).when(kind == 1, F.col("p_brand")).when(kind == 2, F.concat(F.lit("/^u"), size, F.lit("[02]?\\/(view|error)$/")))
    pattern = pattern.when(kind == 3, F.concat(F.lit("/"), size, F.lit(".signup$/"))).otherwise(F.concat("p_type", F.lit("/purchase")))
    return log.by_patterns(model.update_log(s, d), p.select(pattern.alias("pattern"))).select("pos", *REPO)


STITCH = "SELECT publisher, repo, max_by(head, pos) AS head, max(pos) AS pos FROM log WHERE {} GROUP BY ALL"


@query(f"WITH {LOG} {STITCH.format('TRUE')}")
def stitch_heads(s, d):
    return log.stitch(model.update_log(s, d), ["*"])


@query(f"WITH {LOG} {STITCH.format(f't <= {HALF_T}')}")
def stitch_heads_as_of(s, d):
    return log.stitch(model.update_log(s, d), ["*"], half_t(s, d))


@query(f"WITH {LOG} {STITCH.format('TRUE')}")
def stitch_incremental(s, d):
    entries = model.update_log(s, d)
    middle = half_t(s, d)
    return log.stitch(entries, ["*"], since=(log.stitch(entries, ["*"], middle), middle))


@query(f"""WITH {LOG}, heads AS ({STITCH.format("repo IN ('click', 'view')")}), h AS (SELECT sha256(publisher || '/' || repo || '/' || head) AS h FROM heads)
SELECT sha256(concat_ws(',', count(*), {', '.join(f"sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT))" for i in range(8))})) AS root, count(*) AS n FROM h""")
def stitch_root(s, d):
    return log.root(log.stitch(model.update_log(s, d), ["click", "view"]))


@query(f"WITH {LOG}, a AS ({STITCH.format(f't <= {HALF_T}')}), b AS ({STITCH.format('TRUE')}) SELECT b.publisher, b.repo, a.head AS \"from\", b.head AS \"to\" FROM b LEFT JOIN a ON a.publisher = b.publisher AND a.repo = b.repo WHERE a.head IS DISTINCT FROM b.head")
def heads_diff(s, d):
    entries = model.update_log(s, d)
    return log.heads_diff(log.stitch(entries, ["*"]), log.stitch(entries, ["*"], half_t(s, d)))


def root_sql(heads: str) -> str:
    return f"(SELECT sha256(concat_ws(',', count(*), {', '.join(f"coalesce(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)), 0)" for i in range(8))})) FROM (SELECT sha256(publisher || '/' || repo || '/' || head) AS h FROM ({heads})))"


@query(f"WITH {LOG}, r AS (SELECT {root_sql(STITCH.format('TRUE'))} AS root, {root_sql(STITCH.format(f't <= {HALF_T}'))} AS before) SELECT root, TRUE AS now, root = before AS earlier FROM r")
def verify_stitch(s, d):
    """A stitch holds if the log gives it again up to its block; it doesn't stand for another block."""
    entries, middle, end = model.update_log(s, d), half_t(s, d), end_of(s, d) // 100
    root = log.root(log.stitch(entries, ["*"], end)).select("root")
    holds = lambda t, name: log.root(log.stitch(entries, ["*"], t)).select(F.col("root").alias(name))
    # One row each.
    return root.crossJoin(holds(end, "a")).crossJoin(holds(middle, "b")).select("root", (F.col("a") == F.col("root")).alias("now"), (F.col("b") == F.col("root")).alias("earlier"))


def tree_sql(heads: str, name: str) -> str:
    """The nodes of the hash tree over heads, two levels below its root, as a table."""
    return f"""{name}_l AS (SELECT *, sha256(publisher || '/' || repo) AS place, sha256(publisher || '/' || repo || '/' || head) AS leaf FROM {heads}),
{name}_2 AS (SELECT left(place, 2) AS prefix, sha256(string_agg(leaf, '' ORDER BY place)) AS hash, CAST(count(*) AS BIGINT) AS n FROM {name}_l GROUP BY ALL),
{name}_1 AS (SELECT left(prefix, 1) AS prefix, sha256(string_agg(prefix[2] || hash, '' ORDER BY prefix)) AS hash, CAST(sum(n) AS BIGINT) AS n FROM {name}_2 GROUP BY left(prefix, 1)),
{name}_0 AS (SELECT '' AS prefix, sha256(string_agg(prefix || hash, '' ORDER BY prefix)) AS hash, CAST(sum(n) AS BIGINT) AS n FROM {name}_1),
{name} AS (SELECT CAST(2 AS INTEGER) AS level, * FROM {name}_2 UNION ALL SELECT 1, * FROM {name}_1 UNION ALL SELECT 0, * FROM {name}_0)"""


NOW = f"{LOG}, now AS ({STITCH.format('TRUE')})"


@query(f"WITH {NOW}, {tree_sql('now', 'nodes')} SELECT level, prefix, hash, n FROM nodes")
def hash_tree(s, d):
    return hashtree.tree(log.stitch(model.update_log(s, d), ["*"]), 2)


@query(f"WITH {NOW}, was AS ({STITCH.format(f't < {END} // 100')}) SELECT publisher, repo, n.head AS mine, w.head AS theirs FROM now n FULL JOIN was w USING (publisher, repo) WHERE n.head IS DISTINCT FROM w.head")
def replica_difference(s, d):
    """Where a replica that lacks the last block differs, found from the root downwards."""
    entries = model.update_log(s, d)
    return hashtree.replica_difference(log.stitch(entries, ["*"]), log.stitch(entries, ["*"], end_of(s, d) // 100 - 1), 2)


@query(f"""WITH {NOW}, {tree_sql('now', 'nodes')}, p AS (SELECT min(publisher || '/' || repo) AS name, sha256(min(publisher || '/' || repo)) AS place FROM now)
SELECT CAST(3 AS INTEGER) AS level, l.place AS name, leaf AS hash FROM nodes_l l, p WHERE left(l.place, 2) = left(p.place, 2) UNION ALL SELECT level, prefix, hash FROM nodes, p WHERE level = 1 OR level = 2 AND left(prefix, 1) = left(place, 1)""")
def head_proof(s, d):
    """What shows that the root holds the head of one repo, the first by its name."""
    heads = log.stitch(model.update_log(s, d), ["*"])
    publisher, repo = heads.agg(F.min(F.concat_ws("/", *REPO))).first()[0].split("/")
    return hashtree.head_proof(heads, hashtree.tree(heads, 2), 2, publisher, repo)


def state_sql(pos: str) -> str:
    return f"(SELECT publisher, repo, id, c.cid AS cid, c.type AS type, c.payload AS payload FROM (SELECT publisher, repo, id, max_by(struct_pack(op := op, cid := cid, type := type, payload := payload), pos) AS c FROM changes WHERE pos <= {pos} GROUP BY ALL) WHERE c.op = 'put')"


@query(f"WITH {CHANGES} SELECT publisher, repo, id, cid, type, payload FROM {state_sql(END)}")
def state_at(s, d):
    return log.state_at(model.changes(s, d), end_of(s, d))


DIFF = "SELECT publisher, repo, id, CASE WHEN b.cid IS NULL THEN 'delete' ELSE 'put' END AS op, b.cid AS cid FROM {} a FULL JOIN {} b USING (publisher, repo, id) WHERE a.cid IS DISTINCT FROM b.cid"


@query(f"WITH {CHANGES} {DIFF.format(state_sql(HALF), state_sql(END))}")
def repo_diff_full(s, d):
    return log.repo_diff(model.changes(s, d), half_of(s, d), end_of(s, d))


@query(f"WITH {CHANGES} {DIFF.format(state_sql(HALF), state_sql(END))}")
def diff_since(s, d):
    c = model.changes(s, d)
    return log.diff_since(c, half_of(s, d), end_of(s, d), log.state_at(c, half_of(s, d)))


AFTER = f"CASE WHEN user_id % 3 = 0 THEN -1 ELSE {HALF} + user_id END"
BY_REPO = f"""WITH {CHANGES}, spans AS (SELECT DISTINCT 'u' || user_id AS publisher, {AFTER} AS after FROM events),
old AS (SELECT publisher, repo, id, c.cid AS cid FROM (SELECT c.publisher, repo, id, max_by(struct_pack(op := op, cid := cid), pos) AS c FROM changes c JOIN spans s ON c.publisher = s.publisher AND pos <= after GROUP BY ALL) WHERE c.op = 'put')"""


def _spans(s, d) -> DataFrame:
    """Where an index stands that has followed some publishers for longer than others, and every third not at all."""
    number = F.col("user_id")
    after = F.when(number % 3 != 0, half_of(s, d) + number)
    return table(s, d, "events").select(F.concat(F.lit("u"), number.cast("string")).alias("publisher"), F.lit("events").alias("repo"), after.alias("after")).distinct().withColumn("until", F.lit(end_of(s, d)).cast("long"))


def _known(s, d, spans: DataFrame) -> DataFrame:
    c = model.changes(s, d).join(spans.where("after IS NOT NULL"), REPO).where("pos <= after")
    return log.state_at(c, end_of(s, d)).select(*KEY, "cid")


@query(f"{BY_REPO} {DIFF.format('old', state_sql(END))}")
def diff_by_repo(s, d):
    """Differences from each repo's own position; of repos that are new to the index all that they have, however old."""
    spans = _spans(s, d)
    return log.diff_by_repo(model.changes(s, d), spans, _known(s, d, spans)).select(*KEY, "op", "cid")


@query(f"WITH {CHANGES} SELECT publisher, repo, id, cid, type, payload FROM {state_sql(END)}")
def index_updates(s, d):
    """The records of an index after two update steps, the second of them with what moved since the middle of the log alone."""
    c, kept = model.changes(s, d), store.SnapshotStore(s, f"{shared_dir(s)}/index-{uuid.uuid4().hex}")
    entries = c.select("pos", F.floor(F.col("pos") / 100).cast("long").alias("t"), *REPO, F.sha2(F.col("pos").cast("string"), 256).alias("head"))
    for t in (half_t(s, d), end_of(s, d) // 100):
        follow.update(entries.where(F.col("t") <= t), ["*"], kept, follow.indexing(c, kept))
    return kept.table("records").select(*KEY, "cid", "type", "payload")


@query(f"WITH {LOG} SELECT pos, parent, coalesce(lag(head) OVER (PARTITION BY publisher, repo ORDER BY pos), '0x0') AS was FROM log")
def commit_parents(s, d):
    return log.parents(model.update_log(s, d)).select("pos", "parent", F.coalesce("was", F.lit(ZERO_HEAD)).alias("was"))


FORKED = f"{LOG}, forked AS (SELECT pos, t, publisher, repo, head, CASE WHEN pos % 5 = 0 THEN coalesce(lag(head, 2) OVER (PARTITION BY publisher, repo ORDER BY pos), '0x0') ELSE parent END AS parent FROM log)"


def forked(s, d) -> DataFrame:
    """The log, where every fifth commit was made beside the one before it."""
    entries = model.update_log(s, d)
    two = F.lag("head", 2).over(Window.partitionBy(*REPO).orderBy("pos"))
    return entries.withColumn("parent", F.when(F.col("pos") % 5 == 0, F.coalesce(two, F.lit(ZERO_HEAD))).otherwise(F.col("parent")))


@query(f"WITH {FORKED} SELECT publisher, repo, parent, count(*) AS n FROM forked GROUP BY ALL HAVING count(*) > 1")
def forks(s, d):
    return commits.forks(forked(s, d))


@query(f"WITH {FORKED}, kept AS (SELECT * FROM forked WHERE t <> {HALF_T}) SELECT publisher, repo, head, parent FROM kept k WHERE parent <> '0x0' AND NOT EXISTS (SELECT 1 FROM kept o WHERE o.publisher = k.publisher AND o.repo = k.repo AND o.head = k.parent)")
def commit_gaps(s, d):
    """Commits whose parents are missing, as a block of the log is."""
    return commits.gaps(forked(s, d).where(F.col("t") != half_t(s, d)))


@query(f"WITH RECURSIVE {FORKED}, walk AS (SELECT publisher, repo, head, CAST(1 AS BIGINT) AS depth, head AS first FROM forked WHERE parent = '0x0' UNION ALL SELECT f.publisher, f.repo, f.head, depth + 1, first FROM forked f JOIN walk w ON f.publisher = w.publisher AND f.repo = w.repo AND f.parent = w.head) SELECT publisher, repo, head, depth, first FROM walk")
def commit_depths(s, d):
    return commits.depths(forked(s, d))


@query(f"""WITH RECURSIVE {FORKED}, ends AS (SELECT publisher, repo, max_by(head, pos) FILTER (t <= {HALF_T}) AS "from", max_by(head, pos) AS "to" FROM forked GROUP BY ALL),
after AS (SELECT publisher, repo, "to" AS head FROM ends UNION ALL SELECT f.publisher, f.repo, f.parent FROM forked f JOIN after a USING (publisher, repo, head) WHERE f.parent <> '0x0'),
before AS (SELECT publisher, repo, "from" AS head FROM ends WHERE "from" IS NOT NULL UNION ALL SELECT f.publisher, f.repo, f.parent FROM forked f JOIN before a USING (publisher, repo, head) WHERE f.parent <> '0x0')
SELECT publisher, repo, "from", "to", head FROM after ANTI JOIN before USING (publisher, repo, head) JOIN ends USING (publisher, repo)""")
def commits_between(s, d):
    """What the last commit of each repo has in its history and that of the middle of the log has not."""
    entries, middle = forked(s, d), half_t(s, d)
    ends = entries.groupBy(*REPO).agg(F.max_by(F.when(F.col("t") <= middle, F.col("head")), F.when(F.col("t") <= middle, F.col("pos"))).alias("from"), F.max_by("head", "pos").alias("to"))
    return commits.commits_between(entries, ends)


@query(f"WITH {LOG} SELECT count(*) > 0 AS moved FROM log WHERE repo IN ('click') AND t > {HALF_T}")
def log_moved(s, d):
    return s.createDataFrame([(log.moved(model.update_log(s, d), ["u1/click", "click"], half_t(s, d)),)], "moved boolean")


# Sets by key

UPSERT = f"""WITH {CHANGES}, s3 AS (SELECT publisher, repo, id, cid FROM {state_sql(HALF)}), s6 AS (SELECT publisher, repo, id, cid FROM {state_sql(END)}),
old AS (SELECT CAST(row_number() OVER (ORDER BY publisher, repo, id) - 1 AS BIGINT) AS rowseq, * FROM s3), fresh AS (SELECT * FROM s6 ANTI JOIN old USING (publisher, repo, id)),
merged AS (SELECT o.rowseq, o.publisher, o.repo, o.id, coalesce(n.cid, o.cid) AS cid FROM old o LEFT JOIN s6 n USING (publisher, repo, id)
UNION ALL SELECT (SELECT max(rowseq) FROM old) + row_number() OVER (ORDER BY publisher, repo, id), * FROM fresh)"""


def _old(s, d) -> tuple[DataFrame, DataFrame]:
    c = model.changes(s, d)
    return numbered(log.state_at(c, half_of(s, d)).select(*KEY, "cid"), KEY, "rowseq"), log.state_at(c, end_of(s, d)).select(*KEY, "cid")


@query(f"{UPSERT} SELECT rowseq, publisher, repo, id, cid FROM merged")
def upsert_records(s, d):
    old, new = _old(s, d)
    return upsert.upsert(old, new)


@query(f"{UPSERT} SELECT rowseq, publisher, repo, id, cid FROM old ANTI JOIN s6 USING (publisher, repo, id)")
def delete_records(s, d):
    old, new = _old(s, d)
    return upsert.delete(old, new)


@query(f"WITH {CHANGES} SELECT publisher, repo, id, cid FROM {state_sql(END)}")
def apply_changes(s, d):
    """Applying the difference to the older records gives the newer."""
    c = model.changes(s, d)
    old, _ = _old(s, d)
    return upsert.apply_changes(old, log.diff_since(c, half_of(s, d), end_of(s, d), log.state_at(c, half_of(s, d)))).drop("rowseq")


@query(f"{UPSERT} SELECT publisher, repo, id, cid FROM s3 UNION ALL SELECT * FROM fresh")
def fts_backfill(s, d):
    old, new = _old(s, d)
    return upsert.backfill(old.drop("rowseq"), new)


# Snapshots


def _saved(s, d) -> store.SnapshotStore:
    """A store whose records are those of the middle of the log, with what changed until three quarters and until the end behind it."""
    c, kept = model.changes(s, d), store.SnapshotStore(s, f"{shared_dir(s)}/index-{uuid.uuid4().hex}")
    points = [half_of(s, d), half_of(s, d) + half_of(s, d) // 2, end_of(s, d)]
    kept.save(store.Stitch("", points[0], ["*"]), {"records": numbered(log.state_at(c, points[0]), KEY, "rowseq")})
    for before, after in zip(points, points[1:], strict=False):
        moved = log.diff_since(c, before, after, kept.table("records")).join(log.state_at(c, after).drop("cid"), KEY, "left")
        kept.save(store.Stitch("", after, ["*"]), {"records": upsert.delta(kept.table("records"), moved)})
    return kept


@query(f"WITH {CHANGES} SELECT publisher, repo, id, cid, type, payload FROM {state_sql(END)}")
def snapshot_merged(s, d):
    """Records read through two deltas."""
    return _saved(s, d).table("records").select(*KEY, "cid", "type", "payload")


@query(f"WITH {CHANGES} SELECT publisher, repo, id, cid, type, payload FROM {state_sql(END)}")
def snapshot_compacted(s, d):
    """The same after the deltas became one, and that one part of the whole."""
    kept = _saved(s, d)
    kept.compact("records", most=1, share=float("inf"))
    kept.compact("records", share=0)
    return kept.table("records").select(*KEY, "cid", "type", "payload")


# Folds

FOLD = "SELECT user_id, list_reduce(list_prepend(7::BIGINT, list(CAST(length(event_type) AS BIGINT) ORDER BY event_id)), lambda a, x: (a * 31 + x) % 1000003) AS state FROM events WHERE {} GROUP BY user_id"


def _fold(s, d, where: str, start: DataFrame | None = None) -> DataFrame:
    """A reducer in Python over the events of each user, which stream through the tasks in their order."""

    def reduce(state: dict, event: dict) -> dict:
        return {"s": (state.get("s", 7) * 31 + len(event["event_type"])) % 1000003}

    e = table(s, d, "events").where(where).select("user_id", "event_id", "event_type")
    return fold.fold_groups(e, ["user_id"], reduce, lambda x: str(x["s"]), "event_id", start, lambda x: {"s": int(x)}).withColumn("state", F.col("state").cast("long"))


@query(FOLD.format("TRUE"))
def fold_state(s, d):
    return _fold(s, d, "TRUE")


@query(FOLD.format(f"event_id < {HALF}"))
def fold_until(s, d):
    return _fold(s, d, f"event_id < {half_of(s, d)}")


@query(FOLD.format("TRUE"))
def fold_resume(s, d):
    """The state at one point, then the events behind it: the same as a fold over all."""
    middle = half_of(s, d)
    return _fold(s, d, f"event_id >= {middle}", _fold(s, d, f"event_id < {middle}"))


@query(FOLD.format("TRUE"))
def fold_python(s, d):
    """The same by another reducer, over whole events, whose state is read back as JSON."""

    def reduce(state: dict, event: dict) -> dict:
        return {"s": (state.get("s", 7) * 31 + len(event["event_type"])) % 1000003, "n": state.get("n", 0) + 1}

    found = fold.fold_groups(table(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], reduce, json.dumps, "event_id")
    return found.select("user_id", F.get_json_object("state", "$.s").cast("long").alias("state"))


@query(FOLD.format("TRUE"))
def fold_stream(s, d):
    """The same by a stream over the events, which wait for those that come late; the last of each user are folded once it is quiet."""

    def reduce(state: dict, event: dict) -> dict:
        return {"s": (state.get("s", 7) * 31 + len(event["event_type"])) % 1000003}

    # As a pattern, which takes a file as well as a folder of files.
    files = s.readStream.schema(table(s, d, "events").schema).parquet(f"{d}/events.parque[t]")
    stream = files.select("user_id", F.col("event_id").alias("pos"), "event_type", "ts")
    work = f"{shared_dir(s)}/stream-{uuid.uuid4().hex}"
    last = follow.drained(follow.streaming_fold(stream, "user_id", reduce, hold=200, quiet=1000), "user_id", f"{work}/said", f"{work}/state")
    return last.select("user_id", F.get_json_object("state", "$.s").cast("long").alias("state"))


@query(f"SELECT s.user_id, s.state, events, clicks FROM ({FOLD.format('TRUE')}) s JOIN (SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY ALL) c USING (user_id)")
def fold_sql(s, d):
    """Two folds in one pass, called from SQL as a table function over a partitioned and ordered table."""
    reducers = {
        "hash": lambda state, event: {"s": (state.get("s", 7) * 31 + len(event["event_type"])) % 1000003},
        "clicks": lambda state, event: {"n": state.get("n", 0) + (event["event_type"] == "click")},
    }
    tables.register(s, reducers, "fold_hash")
    e = table(s, d, "events").select("user_id", "event_id", "event_type")
    found = s.sql("SELECT * FROM fold_hash(TABLE({e}), 'user_id', 'event_id')", e=e)
    return found.select("user_id", F.get_json_object("hash", "$.s").cast("long").alias("state"), "events", F.get_json_object("clicks", "$.n").cast("long").alias("clicks"))


COMMITS = f"WITH {CHANGES}, w AS (SELECT *, lag(cid) OVER (PARTITION BY publisher, repo, id ORDER BY pos) AS was FROM changes)"


@query(f"{COMMITS} SELECT pos, publisher, CASE WHEN op = 'put' AND cid IS DISTINCT FROM was THEN id END AS put, CASE WHEN op = 'delete' AND was IS NOT NULL THEN id END AS gone FROM w")
def commit_changes(s, d):
    """What each commit changes against its parent; one that puts what is there, or deletes what isn't, changes nothing."""
    c = model.changes(s, d)
    both = fold.commits(c.select("pos", "publisher"), c)
    return both.select("pos", "publisher", F.get(F.col("puts")["id"], F.lit(0)).alias("put"), F.get("deletes", F.lit(0)).alias("gone"))


@query(f"{COMMITS} SELECT id AS slot, min_by(publisher, pos) AS owner, min(pos) AS pos FROM w WHERE op = 'put' AND cid IS DISTINCT FROM was GROUP BY id")
def claims_of_valid_commits(s, d):
    """The first valid claim of each slot; a commit that changes nothing claims nothing."""
    c = model.changes(s, d)
    return fold.owners(c.select("pos", *REPO), c, "$.k")


@query(f"WITH {CHANGES} SELECT id AS slot, min_by(publisher, pos) AS owner, count(*) AS claims FROM changes WHERE op = 'put' GROUP BY id")
def first_claim_wins(s, d):
    return fold.first_claims(model.changes(s, d).where("op = 'put'").withColumnRenamed("id", "slot"), "slot")


@query(f"WITH {CHANGES}, o AS (SELECT id, min_by(publisher, pos) AS owner FROM changes WHERE op = 'put' GROUP BY id) SELECT owner, count(*) AS cells FROM o GROUP BY owner")
def scoreboard(s, d):
    return first_claim_wins(s, d).groupBy("owner").agg(F.count("*").alias("cells"))


# References


@query(f"WITH {CHANGES} SELECT a.publisher, a.repo, a.id, b.cid, b.type FROM {state_sql(HALF)} a LEFT JOIN {state_sql(END)} b USING (publisher, repo, id)")
def pin_references(s, d):
    c = model.changes(s, d)
    return maintain.pin_references(log.state_at(c, half_of(s, d)).select(*KEY), log.state_at(c, end_of(s, d)))


@query(f"WITH {CHANGES} SELECT a.publisher, a.repo, a.id, a.cid, b.cid AS now FROM {state_sql(HALF)} a LEFT JOIN {state_sql(END)} b USING (publisher, repo, id) WHERE a.cid IS DISTINCT FROM b.cid")
def stale_citations(s, d):
    c = model.changes(s, d)
    return maintain.stale_references(log.state_at(c, half_of(s, d)).select(*KEY, "cid"), log.state_at(c, end_of(s, d)))


# Texts and vectors


NUMBER = "regexp_replace(CAST({} AS VARCHAR), '\\.0$', '')"


def nested() -> Column:
    """A payload with nested values, arrays, numbers of all kinds, booleans, nulls, empty containers and keys that are numbers."""
    k = F.get_json_object("props", "$.k").cast("int")
    inner = F.struct("value", (F.col("value") > 50).alias("large"), F.array(k, k + 1).alias("ks"), F.array().cast("array<int>").alias("none"))
    tiny = F.lit(1e-7) * F.lit(1.0)
    named = F.struct(F.col("event_type").alias("type"), F.lit(None).cast("string").alias("nothing"), inner.alias("in"), k.alias("10"), F.lit("two").alias("2"), F.lit("").alias("²"), tiny.alias("tiny"))
    return F.to_json(named, {"ignoreNullFields": "false"})


K = "json_extract_string(props, '$.k')"
LEAVES = f"""[{{'path': '2', 'value': 'two', 'type': 'string'}}, {{'path': '10', 'value': {K}, 'type': 'number'}}, {{'path': 'type', 'value': event_type, 'type': 'string'}}, {{'path': 'in.value', 'value': {NUMBER.format('value')}, 'type': 'number'}},
  {{'path': 'in.large', 'value': CASE WHEN value > 50 THEN 'true' ELSE 'false' END, 'type': 'boolean'}}, {{'path': 'in.ks.0', 'value': {K}, 'type': 'number'}}, {{'path': 'in.ks.1', 'value': CAST(CAST({K} AS INTEGER) + 1 AS VARCHAR), 'type': 'number'}},
  {{'path': '²', 'value': '', 'type': 'string'}}, {{'path': 'tiny', 'value': '1e-7', 'type': 'number'}}]"""


@query(f"SELECT event_id, array_to_string(list_transform({LEAVES}, lambda x: x.path || ': ' || x.value), chr(10)) AS text FROM events")
def text_of(s, d):
    return table(s, d, "events").select("event_id", tx.text_of(nested()).alias("text"))


@query(f"WITH l AS (SELECT event_id, unnest({LEAVES}) AS x FROM events) SELECT event_id, x.path AS path, x.value AS value, x.type AS type FROM l")
def leaf_rows(s, d):
    """A row for each leaf."""
    return table(s, d, "events").select("event_id", F.inline(tx.leaf_rows(nested())))


@query(SQL["leaf_rows"])
def leaf_table(s, d):
    """The same by a table function, called from SQL beside the rows."""
    tables.register(s)
    e = table(s, d, "events").select("event_id", nested().alias("payload"))
    return s.sql("SELECT event_id, path, value, type FROM {e}, LATERAL leaves(payload)", e=e)


@query("WITH h AS (SELECT vec_id, embedding[1:16]::DOUBLE[] AS v FROM embeddings) SELECT vec_id, round(v[1] / sqrt(list_inner_product(v, v)), 6) AS first, round(list_aggregate(list_transform(v, lambda x: abs(x)), 'sum') / sqrt(list_inner_product(v, v)), 6) AS total FROM h")
def matryoshka(s, d):
    m = table(s, d, "embeddings").select("vec_id", vx.matryoshka(F.col("embedding"), 16).alias("v"))
    return m.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x)), 6).alias("total"))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CAST(greatest(-127, least(127, floor(x::DOUBLE * 127 + 0.5))) AS INTEGER)), ',') AS packed FROM embeddings")
def int8_pack(s, d):
    return table(s, d, "embeddings").select("vec_id", F.array_join(vx.int8(F.col("embedding")).cast("array<string>"), ",").alias("packed"))


@query("SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings")
def sign_bits(s, d):
    return table(s, d, "embeddings").select("vec_id", vx.sign_bits(F.col("embedding")).alias("bits"))


BYTES = "base64(from_hex(array_to_string(list_transform(embedding, lambda x: printf('%02X', (CAST(greatest(-127, least(127, floor(x::DOUBLE * 127 + 0.5))) AS INTEGER) + 256) % 256)), '')))"
SIGNS = "array_to_string(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN '1' ELSE '0' END), '')"


@query(f"SELECT vec_id, {BYTES} AS packed, base64(from_hex(array_to_string(list_transform(range(8), lambda i: printf('%02X', CAST(list_reduce(list_transform(range(8), lambda j: CASE WHEN substr({SIGNS}, i * 8 + j + 1, 1) = '1' THEN 1 << (7 - j) ELSE 0 END), lambda a, b: a + b) AS INTEGER))), ''))) AS bits FROM embeddings")
def packed_vectors(s, d):
    return table(s, d, "embeddings").select("vec_id", vx.packed_int8(F.col("embedding")).alias("packed"), vx.packed_bits(F.col("embedding")).alias("bits"))


@query("SELECT vec_id, CAST(list_sum(list_transform(embedding, lambda x: greatest(-127, least(127, floor(x::DOUBLE * 127 + 0.5))))) AS BIGINT) AS total, CAST(list_sum(list_transform(embedding, lambda x: CASE WHEN x >= 0 THEN 1 ELSE -1 END)) AS DOUBLE) AS signs FROM embeddings")
def unpacked_vectors(s, d):
    """There and back again; what isn't base64 gives none."""
    e, total = table(s, d, "embeddings"), lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    whole = e.select("vec_id", vx.unpacked_int8(vx.packed_int8(F.col("embedding"))).alias("v"), vx.unpacked_bits(vx.packed_bits(F.col("embedding"))).alias("b"), vx.unpacked_int8(F.lit("?")).alias("bad"))
    return whole.where("bad IS NULL").select("vec_id", F.round(total("v") * 127).cast("long").alias("total"), total("b").alias("signs"))


@query(f"WITH v AS (SELECT vec_id AS rowseq, vec_id % 2 = 0 AS old, {BYTES} AS packed FROM embeddings), n AS (SELECT *, row_number() OVER (PARTITION BY old ORDER BY rowseq) AS k FROM v) SELECT rowseq, old AND k > 100 AS json, CASE WHEN NOT old OR k <= 100 THEN packed END AS packed FROM n")
def pack_legacy_vectors(s, d):
    """Vectors that are stored as JSON are rewritten, a hundred a run, the oldest first."""
    mixed = F.when(F.col("vec_id") % 2 == 0, F.to_json("embedding")).otherwise(vx.packed_int8(F.col("embedding")))
    done = maintain.pack_vectors(table(s, d, "embeddings").select(F.col("vec_id").alias("rowseq"), mixed.alias("vec")), 100)
    return done.select("rowseq", vx.is_json(F.col("vec")).alias("json"), F.when(~vx.is_json(F.col("vec")), F.col("vec")).alias("packed"))


@query(f"WITH {CHANGES} SELECT publisher, repo, id, cid, type FROM {state_sql(END)} WHERE publisher = 'u7' AND repo = 'events' ORDER BY id")
def live_repo(s, d):
    """A repo as the log has it now."""
    return log.list_repo(model.changes(s, d), "U7", "events").drop("payload").orderBy("id")


@query(f"WITH {CHANGES} SELECT publisher, repo, id, cid, payload FROM {state_sql(END)} WHERE publisher = 'u7' AND repo = 'events' AND id = (SELECT min(id) FROM changes WHERE publisher = 'u7')")
def live_record(s, d):
    c = model.changes(s, d)
    return log.read_record(c, "u7", "events", c.where("publisher = 'u7'").agg(F.min("id")).first()[0]).drop("type")


@query("SELECT doc_id AS rowseq FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) ORDER BY doc_id LIMIT 100")
def embed_missing_batch(s, d):
    return maintain.missing_vectors(model.records(s, d), vectors(s, d), 100).select("rowseq")


@query(f"WITH {RECORDS}, {VERDICTS} SELECT publisher, repo, id, cid, type FROM records r WHERE EXISTS (SELECT 1 FROM verdicts v WHERE {SAME} AND v.reason IS NULL) ORDER BY publisher, repo, id")
def view_rows(s, d):
    return store.view(gate.allowed(model.records(s, d), model.verdicts(s, d), checker())).drop("payload")


@query(f"WITH {RECORDS} SELECT publisher, repo, id, cid, TRUE AS without FROM records")
def seed_rows(s, d):
    return store.seed(model.records(s, d)).select(*KEY, "cid", F.col("vec").isNull().alias("without"))
