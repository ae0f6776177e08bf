"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolefit.llm import (bpe, digest, fill_middle, fm_substrings, hilbert_shards, html_text, jaccard_join, langid, periodic_runs, quality, repeats,
                         secret_scan, spaced_seeds)
from rolefit.llm.common import fold, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(plan: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = plan
        if sql:
            ORACLES[name] = sql
        return plan
    return add


def default_codec() -> bpe.Codec:
    import public_tokenizers

    return bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@query("op10_bpe_codec")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digest_table(bpe.encode_decode(read(spark, folder, "documents"), default_codec()))


def language_model(docs: DataFrame) -> langid.Model:
    return langid.fit(docs.where(fold(F.col("doc_id"), 4) != 2))


@query("op4_language_id")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return langid.identify(docs, language_model(docs)).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op2_quality")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    held = fold(F.col("doc_id"), 5) == 0
    labels = read(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.classify(read(spark, folder, "documents"), labels, ~held).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op3_secrets")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.digest_table(secret_scan.find_secrets(read(spark, folder, "documents")))


@query("op5_html_text")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract_text(read(spark, folder, "pages"))


@query("op6_hilbert_shards")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return hilbert_shards.assign(read(spark, folder, "documents"))


@query("op1_spaced_seeds", spaced_seeds.oracle_sql())
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return spaced_seeds.find_leaks(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query("op9_fingerprints")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return digest.neighbours(read(spark, folder, "documents"))


@query("op8_jaccard_join", jaccard_join.oracle_sql())
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_groups(read(spark, folder, "documents"))


@query("op7_repeats")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digest_table(repeats.remove_repeats(read(spark, folder, "documents")))


@query("op11_periodic_runs", periodic_runs.oracle_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digest_table(periodic_runs.find_runs(periodic_runs.planted(read(spark, folder, "documents"))))


@query("op12_fm_substrings", fm_substrings.oracle_sql())
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return fm_substrings.digest_table(fm_substrings.remove_substrings(read(spark, folder, "documents")))


@query("op13_fill_middle", fill_middle.oracle_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return fill_middle.digest_table(fill_middle.fill_middle(read(spark, folder, "documents")))
