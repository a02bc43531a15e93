"""From raw documents to packed training sequences: quality rules, near-duplicates, secrets, mixture, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read again as the next one's docs. All but the last give the columns of documents, further columns included, whatever their names.

Null and empty texts have no words, so the quality rules reject them. Rows without a doc_id are never near-duplicates of others. Ties go to the smallest doc_id, and rows that repeat doc_id and text count once. Texts of any length are handled whole. An empty table gives an empty result at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import mixing, packing, quality, secrets, simhash
from palimpsest.llm.common import shared_dir, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them. Repeated rows get one verdict and stay repeated."""
    return quality.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, at a Jaccard similarity of 0.8 of their sets of five-word shingles, the document with the smallest doc_id stays, once. Null and empty texts form one group; rows without a doc_id stay."""
    return simhash.one_of_each(docs, shingle=5, similarity=0.8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by a mark, and n_chars follows. Null texts stay null, and so is their n_chars; spans that overlap get one mark."""
    return docs.withColumn("text", secrets.redacted(F.col("text"))).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it: not at all, once or twice. Documents without words are never taken; those without a source are a source of their own, the last."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences. A document without text is its end token; repeated documents are packed as often as they occur."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixture", mix_sources),
    ("packing", pack_sequences),
]

#: EM, hashes, components and tokens are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. What a stage gives is written to the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
