"""A corpus pipeline over documents: language, quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, and leave other columns out. Null texts count as
empty: they have no language, so the first stage drops them, and no stage fails on them. The first three stages drop rows without a doc_id. Rows that
share a doc_id stay together in the first two stages; the third tells their texts apart, and keeps the row of the smallest hash of the text where several tie. Very long texts go through
every stage whole. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import packing, pii, quality, simhash
from tidemark.llm.queries import identified
from tidemark.llm.shared import fold, read, stored, tokenizer_path
from tidemark.session import discard
from tidemark.session import run as own_tables

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _kept(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is among ids (distinct, not null)."""
    return docs.select(*COLUMNS).join(ids, "doc_id", "left_semi").select(*COLUMNS)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the fused evidence is sure of; lang becomes that language."""
    docs = docs.select(*COLUMNS)
    found = identified(spark, docs, sf_dir).where("kept").groupBy("doc_id").agg(F.min("lang").alias("found"))
    return docs.join(found, "doc_id").withColumn("lang", F.col("found")).select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels outside the held-out fold, scores 0.5 or more."""
    scored = quality.classify(docs, read(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    return _kept(docs, scored.where("predicted = 1").select("doc_id").distinct())


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, that of the smallest doc_id, and of those of the smallest hash of the text.

    Shingles of five words, and fingerprints that differ in six bits or fewer. Rows of one doc_id with different texts are rows of their own.
    """
    docs = docs.select(*COLUMNS).where("doc_id is not null").withColumn("tag", F.xxhash64(F.coalesce("text", F.lit(""))))
    groups = simhash.near_duplicates(docs, shingle=5, budget=6, tag=F.col("tag"))
    first = groups.groupBy("component_id").agg(F.min(F.struct("doc_id", "tag")).alias("first")).select("first.doc_id", "first.tag")
    return docs.join(first, ["doc_id", "tag"], "left_semi").dropDuplicates(["doc_id", "tag"]).select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each personal span replaced by its kind in brackets; n_chars follows."""
    found = pii.find(docs, keep=("lang", "source"))
    out = found.select("doc_id", pii.redacted(F.col("text"), F.col("spans")).alias("text"), "lang", "source")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2,048 tokens."""
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_duplicates", one_of_each_group),
    ("personal_data", without_personal_data),
    ("packing", packed),
]

#: Hash fingerprints, learnt scores and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir; each stage's result is written to the shared folder and read again, and what came before it is deleted."""
    docs = read(spark, sf_dir, "documents")
    with own_tables():  # what other runs in this driver write is not theirs to delete
        for _, stage in STAGES[:-1]:
            docs = stored(stage(spark, docs, sf_dir))
            discard(spark, keep=[docs])
    return STAGES[-1][1](spark, docs, sf_dir)
