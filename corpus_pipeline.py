"""The corpus pipeline: documents in, token ids out. Each stage applies one operator of rolefit.llm to all that the one before kept;
what it returns is written as Parquet and read again by the next. All stages but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.llm import bpe, jaccard_join, langid, secret_scan, spaced_seeds
from rolefit.llm.common import checkpointed, fold, read, written
from rolefit.llm.queries import default_codec

#: A document stays if its language is found with at least this calibrated probability.
LEAST_CERTAIN = 0.5
#: Keys that are broadcast at most to drop documents; beyond that they are joined by shuffle.
BROADCAST_KEYS = 2_000_000


def without(docs: DataFrame, key: str | Column, keys: DataFrame) -> DataFrame:
    """The rows whose key is none of the keys, the only column of the other table; rows with a null key stay."""
    gone = checkpointed(keys.toDF("_gone").where("_gone is not null").distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone, (docs[key] if isinstance(key, str) else key) == gone["_gone"], "left_anti")


def accepted(language: str, certainty: float) -> bool:
    return language != langid.UNKNOWN and certainty >= LEAST_CERTAIN


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (null and empty texts too) and those whose language is uncertain."""
    return langid.keep_identified(docs, langid.fit(docs.where(fold(F.col("doc_id"), 4) != 2)), accepted)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays. Documents without words are in no group and stay. Where a doc_id is
    null or repeats, rows are grouped by their number in a written copy; of a group the row with the smallest doc_id stays, null last,
    ties to the smallest number."""
    if docs.groupBy("doc_id").count().where("doc_id is null or count > 1").isEmpty():
        groups = checkpointed(jaccard_join.similar_groups(docs))
        return without(docs, "doc_id", groups.where("doc_id <> component_id").select("doc_id"))
    copy = written(docs.withColumn("_row", F.monotonically_increasing_id()))
    groups = checkpointed(jaccard_join.similar_groups(copy.select("_row", "text"), key="_row"))
    member = groups.join(copy.select("_row", F.col("doc_id").alias("_doc")), "_row")
    first = member.groupBy("component_id").agg(F.min(F.struct(F.col("_doc").isNull(), "_doc", "_row")).getField("_row").alias("_first"))
    return without(copy, "_row", member.join(first, "component_id").where("_row <> _first").select("_row")).drop("_row")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. A text alone decides, so rows are dropped by the digest of their text, whatever their ids."""
    prints = docs.select(F.md5(F.col("text").cast("binary")).alias("_print"), "text")
    leaks = spaced_seeds.find_leaks(prints, read(spark, sf_dir, "benchmark"), doc_key="_print")
    return without(docs, F.md5(F.col("text").cast("binary")), leaks.select("_print"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; each secret in their texts becomes a mark. n_chars follows the text where the table has it."""
    out = secret_scan.redact(docs, secret_scan.fit(checkpointed(secret_scan.scan(docs))))
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their count, digest and the digest of the bytes that they decode to."""
    encoded = bpe.encode_decode(docs, default_codec())
    return bpe.digest_table(encoded, "doc_id", keep=("token_ids",))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("byte-level BPE", tokens),
]

#: Language ID, the secret scan and the tokens cannot be put in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
