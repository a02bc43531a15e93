"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import bottomk, hard_negatives, mixing, packing, periodic, quality, secrets, sharding, simhash, site_style, toxicity, warc, winnow
from palimpsest.llm.common import table, words


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.pmod(F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")), F.lit(5)) == 0
    model = toxicity.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.scores(F.col("text"), model).alias("s"))
    return scored.select("doc_id", "held_out", "s.score", F.when(F.col("s.score") >= 0.5, 1).otherwise(0).alias("predicted"), toxicity.listed(F.col("s.offending")).alias("offending"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.without_gaps(warc.round_trip(table(spark, sf_dir, "pages")))
    return found.select(
        warc.page_key("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_key("refers_to").cast("long").alias("refers_to")
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.to_hex(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("epochs_taken")).alias("taken"))


def op5_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_style.main_text(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", secrets.scan(F.col("text")).alias("s")).select("doc_id", "s.*")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = bottomk.against_edits(table(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        bottomk.to_hex(F.col("sketch")).alias("fingerprint"),
        bottomk.to_hex(F.col("edited_sketch")).alias("edited_fingerprint"),
        bottomk.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        bottomk.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        bottomk.containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_in_edited"),
        bottomk.distinct_shingles(F.col("sketch")).alias("n_shingles"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return judged.select(F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(e, F.col("vec_id"), label, F.col("embedding"), F.col("vec_id") % 50 == 0)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    f = F.col("found")
    return found.select(
        "row.doc_id", f["n_words"].alias("n_words"), f["n_hit"].alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"), winnow.listed_sha256(f["items"]).alias("items_sha256"), (f["n_hit"] > 0).alias("contaminated")
    )


def planted(key: Column, text: Column) -> Column:
    """Every tenth text by a hash h of its key repeats itself: with a = h / 10 modulo its words, word i from a on is word a + (i - a) % p. A null key plants nothing."""
    h, w = F.crc32(F.encode(key.cast("string"), "UTF-8")), words(text)
    g, n = F.floor(h / 10), F.size(w)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " ")).otherwise(text)


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    r = docs.select("doc_id", periodic.found(F.col("text")).alias("r")).select("doc_id", "r.*")
    best = F.col("strongest")
    milli = F.floor(1000 * best["length"] / best["period"]).cast("long")
    return r.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"), milli.alias("exponent_milli"), "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256")
    )


QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_warc, op3_simhash, op4_mixing, op5_extraction, op6_packing, op7_secrets, op8_fingerprints, op9_sharding, op10_quality, op11_hard_negatives, op12_decontamination, op13_periodic)
}

WORDS_12 = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: CRC-32 of doc_id in decimal, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ord(substr(CAST(doc_id AS VARCHAR), k, 1)) AS BIGINT))),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""

SQL: dict[str, str] = {
    "op2_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first FROM p),
e AS (SELECT *, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM e""",
    "op11_hard_negatives": """WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.rid, a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 50 = 0 AND a.rid <> b.rid),
p AS (SELECT rid, anchor_id, other AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY rid ORDER BY score DESC, other) AS place FROM s WHERE same QUALIFY place <= 5),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.rid, p.place ORDER BY s.score DESC, s.other) AS INTEGER) AS rank FROM p JOIN s ON p.rid = s.rid AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score QUALIFY rank <= 3)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n""",
    "op12_decontamination": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {WORDS_12} AS w FROM documents), i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {WORDS_12} AS w FROM benchmark),
m AS (SELECT *, least(10, len(w)) AS m FROM i WHERE len(w) > 0),
passages AS (SELECT DISTINCT m, item, array_to_string(w[k : k + m - 1], ' ') AS passage FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS k FROM m)),
lengths AS (SELECT DISTINCT m FROM m),
windows AS (SELECT rid, m, k, array_to_string(w[k : k + m - 1], ' ') AS passage FROM (SELECT rid, m, w, unnest(range(1, len(w) - m + 2)) AS k FROM d, lengths)),
hits AS (SELECT rid, w.m, k, item FROM windows w JOIN passages p ON w.m = p.m AND w.passage = p.passage),
n_hit AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(k, k + m)) AS at FROM (SELECT DISTINCT rid, m, k FROM hits)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, h.n IS NOT NULL AS contaminated FROM d LEFT JOIN n_hit h USING (rid) LEFT JOIN items i USING (rid)""",
    "op13_periodic": f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {CRC32} AS h FROM documents),
g AS (SELECT *, len(w) AS n, h // 10 AS g, h % 10 = 0 AND len(w) > 0 AS planted FROM d),
a AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM g),
p AS (SELECT rid, doc_id, n, w, a, CASE WHEN planted THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
words AS (SELECT rid, n, i, CASE WHEN i >= a THEN w[1 + a + (i - a) % p] ELSE w[1 + i] END AS word FROM (SELECT *, unnest(range(n)) AS i FROM p)),
same AS (SELECT x.rid, x.i, y.i - x.i AS p, x.i - row_number() OVER (PARTITION BY x.rid, y.i - x.i ORDER BY x.i) AS island FROM words x JOIN words y ON x.rid = y.rid AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
stretches AS (SELECT rid, p, min(i) AS start, max(i) + 1 + p - min(i) AS length FROM same GROUP BY rid, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
runs AS (SELECT rid, start, length, min(p) AS period FROM stretches GROUP BY rid, start, length),
dropped AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM runs),
rest AS (SELECT w.rid, string_agg(word, ' ' ORDER BY w.i) AS collapsed FROM words w ANTI JOIN dropped x ON w.rid = x.rid AND w.i = x.i GROUP BY w.rid),
listed AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY rid),
best AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY CAST(length AS DECIMAL(38, 20)) / period DESC, start, period) AS place FROM runs QUALIFY place = 1)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(collapsed, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (rid) LEFT JOIN best b USING (rid) LEFT JOIN rest USING (rid)""",
}
