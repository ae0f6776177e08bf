"""Document fingerprints: a quartile digest of hashed byte triplets.

fingerprint(text): the bytes of the text are read in triplets (adjacent, and two variants with a gap), each hashed into one of BUCKETS counters; every counter
becomes two bits, the quartile its count falls into. Length (a logarithmic byte) and the ratios of the quartiles stand in front.
likeness(a, b): one less the difference score over the score that unrelated digests reach on average, and never below 0.

neighbours(): pairs each document with the next one by key without a global window. Cut points that are keys of documents split the keys into
ranges; the rows are dealt out by range, and the first document of a range is dealt to the range before as well, so that each range is a stream in
which every document meets its successor. The text is shuffled once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import text_slices

BUCKETS = 256
#: Places of a triplet relative to its first byte.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
#: Distance of two quartile codes by their difference: opposite quartiles count double.
_STEP = np.array([0, 1, 2, 6])
#: Mean of that distance over two unrelated codes, times the buckets: the score at which likeness is 0.
UNRELATED = 1.625 * BUCKETS
#: The most that length and each ratio add to a score.
LENGTH_CAP, RATIO_CAP = 40, 12


def fingerprint(text: str) -> str:
    """Lowercase hex: a byte of length, a byte of quartile ratios, two bits for each bucket. Texts under three bytes have no counts."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    counts = np.zeros(BUCKETS, np.int64)
    scaled = raw * _ODD[0], raw * _ODD[1], raw * _ODD[2]
    for k, (a, b, c) in enumerate(TRIPLETS):
        n = len(raw) - c
        if n > 0:
            h = scaled[0][a:a + n] + scaled[1][b:b + n]
            h += scaled[2][c:c + n]
            h += np.uint32(0x51ED270B * (k + 1) & 0xFFFFFFFF)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x2C1B3C6D)
            counts += np.bincount(h >> np.uint32(24), minlength=BUCKETS)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    codes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    packed = codes[0::4] << 6 | codes[1::4] << 4 | codes[2::4] << 2 | codes[3::4]
    length = min(255, int(round(np.log(len(raw) + 1) / np.log(1.12))))
    ratios = ((15 * q1 // q3) << 4 | 15 * q2 // q3) if q3 else 0
    return bytes([length, ratios]).hex() + packed.astype(np.uint8).tobytes().hex()


def _codes(digest: bytes) -> np.ndarray:
    packed = np.frombuffer(digest, np.uint8)[2:]
    return np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], axis=1).astype(np.int8)


def difference(a: str, b: str) -> int:
    """The bounded difference score of two digests; 0 for equal ones."""
    x, y = bytes.fromhex(a), bytes.fromhex(b)
    score = min(LENGTH_CAP, abs(x[0] - y[0]))
    for shift in (4, 0):
        score += min(RATIO_CAP, abs((x[1] >> shift & 15) - (y[1] >> shift & 15)))
    return int(score + _STEP[np.abs(_codes(x) - _codes(y))].sum())


def likeness(a: str, b: str) -> float:
    return max(0.0, 1.0 - difference(a, b) / UNRELATED)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars and fingerprint for every row; a null text counts as empty. A map without any shuffle."""
    key_type = docs.schema[key].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()),
                                              pa.array([fingerprint(t) for t in texts], pa.string())], ["key", "n_chars", "fingerprint"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        step, f"key {key_type}, n_chars long, fingerprint string").withColumnRenamed("key", key)


def dealt_by_range(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, copy) in as many ranges of keys as the session has shuffle partitions, each sorted, behind it the first rows of the next range
    (of the first range, behind the last) with copy = 1. The key is a number; null keys come first."""
    spark = docs.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [F.lit(k / ranges) for k in range(1, ranges)] or [F.lit(0.5)]
    row = docs.agg(F.min(key).alias("low"), F.count(F.when(F.col(key).isNull(), 1)).alias("nulls"),
                   F.percentile_approx(key, F.array(*shares), max(10_000, 20 * ranges)).alias("cuts")).first()
    low = None if row.nulls else row.low
    # a cut is the key of a document: of the first one of its range
    cuts = np.array(sorted({c for c in row.cuts or [] if ranges > 1 and (low is None or c > low)}), np.int64)
    last = len(cuts)

    @F.pandas_udf("array<int>")
    def targets(keys: pd.Series) -> pd.Series:
        # twice the range of the row; odd for the copy behind another range
        out = []
        for k in keys:
            null = k is None or k != k
            at = 0 if null else int(np.searchsorted(cuts, int(k), "right"))
            found = [2 * at]
            if at and cuts[at - 1] == k:
                found.append(2 * (at - 1) + 1)
            if (null and low is None) or (not null and low is not None and k == low):
                found.append(2 * last + 1)
            out.append(found)
        return pd.Series(out)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.select("key", "text", F.explode(targets("key")).alias("target"))
    return (rows.repartitionById(last + 1, F.shiftright("target", 1)).select("key", "text", F.col("target").bitwiseAND(F.lit(1)).alias("copy"))
            .sortWithinPartitions("copy", F.col("key").asc_nulls_first(), "text"))


def neighbours(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next for every row.

    The edited text has the first code points of the next document in place of the last floor(n/2) of its own. After the last document
    comes the first. Null texts count as empty. Rows of one key follow each other in the order of their texts; a table of one row is its own
    successor. Other columns are not read.
    """
    key_type = docs.schema[key].dataType.simpleString()
    columns = ["key", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # the last own row: key, text, fingerprint
        for part, texts in text_slices(batches, "text"):
            out = []
            for k, text_, copy in zip(part.column(0).to_pylist(), texts, part.column(2).to_pylist()):
                if copy and before is None:
                    break  # only the first copy is a successor
                digest = fingerprint(text_)
                if before is not None:
                    own_key, own, own_digest = before
                    half = len(own) // 2
                    edited = own[:len(own) - half] + text_[:half]
                    edited_digest = fingerprint(edited)
                    out.append((own_key, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own_digest,
                                edited_digest, likeness(own_digest, edited_digest), likeness(own_digest, digest)))
                before = None if copy else (k, text_, digest)
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            values = list(zip(*out)) or [()] * len(columns)
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(values, types)], columns)

    out = dealt_by_range(docs, key, text).mapInArrow(
        step, "key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    return out.withColumn("key", F.col("key").cast(key_type)).withColumnRenamed("key", key)
