"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python step holds as Python objects at a time.
SLICE_ROWS = 256
#: Bytes of an Arrow batch, whatever its rows: long texts make batches of few rows.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return small_batches(spark).read.parquet(f"{folder}/{table}.parquet")


def small_batches(spark: SparkSession) -> SparkSession:
    """The session, set to send Python workers batches of BATCH_BYTES."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without that setting, as in tests, gets one of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _own_folder()
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


@lru_cache(maxsize=1)
def _own_folder() -> str:
    import tempfile

    return tempfile.mkdtemp(prefix="rolefit-llm-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage by a checkpoint in the shared folder; it keeps partitions and their order."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cut lineage by a compressed table in the shared folder, of which later steps read the columns that they need."""
    path = f"{shared_folder(small_batches(df.sparkSession))}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Each batch in slices of a few rows, with their texts; a null text is empty. What the worker has freed goes back to the system at the end."""
    for part in slices(batches):
        yield part, [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch in slices of a few rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)
    give_back()


def give_back() -> None:
    """Return freed memory of this worker to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key as text, modulo parts: the folds that fix which rows a model may learn from."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(parts))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(maxsize=4)
def char_table(kind: str) -> np.ndarray:
    """A boolean for each code point: kind names a str method such as isalpha."""
    test = getattr(str, kind)
    return np.fromiter((test(chr(c)) for c in range(0x110000)), bool, 0x110000)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that all bits of a sum count."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x
