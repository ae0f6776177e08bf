"""Corpus readers and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet table, in the splits that the session's split size and the row groups give."""
    return spark.read.parquet(path)


def decode_utf8(content: F.Column) -> F.Column:
    """Bytes to text; bytes that are not UTF-8 are dropped."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.regexp_replace(F.make_valid_utf8(text), "\ufffd", ""))


def read_text_corpus(spark: SparkSession, path: str, fmt: str = "parquet", text_col: str = "text") -> DataFrame:
    """Text documents from a parquet table, or one document per file for fmt 'text' and 'binaryFile'."""
    if fmt == "parquet":
        df = read_table(spark, path)
        return df.withColumn(text_col, decode_utf8(F.col(text_col)))
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path"), decode_utf8(F.col("content")).alias(text_col))


@lru_cache(maxsize=1)
def _local_root() -> str:
    return tempfile.mkdtemp(prefix="rolefit-")


def work_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared folder the session names in spark.checkpoint.dir.

    Only a local session without that setting, as in tests, falls back to a temporary folder of its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage through a written table in the shared folder; it outlives any executor."""
    path = work_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
