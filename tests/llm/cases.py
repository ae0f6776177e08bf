"""Rows that every operator has to stand: nulls, empty and long texts, ties, repeated rows, columns of clashing names."""

from __future__ import annotations

LONG = " ".join(f"word{i % 997} and{i % 13}" for i in range(30_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, id long, n long, shard int, token_ids string, doc string, a int"


def odd_documents(spark):
    """Documents with nulls in every column, an empty text, a long one, equal texts and one row twice."""
    rows = [(1, "The quick brown fox jumps over the lazy dog near the river bank", "en", "s1"), (2, None, "en", "s2"), (3, "", None, "s1"),
            (4, "The quick brown fox jumps over the lazy dog near the river bank", None, None), (5, LONG, "en", "s1"), (6, "...", "de", "s1"),
            (7, "Der schnelle braune Fuchs springt", "de", "s3"), (7, "Der schnelle braune Fuchs springt", "de", "s3"), (None, "no key at all", None, None),
            (9, "token = \"0641917ea4e9feb9cda83477b57ac2654884f485\" éè \U0001f600", "fr", "s1"), (10, "   \x00\x0b", None, "s1")]
    return spark.createDataFrame([(*r, None, "k", 0.5, 3, 4, 5, "t", "d", 1) for r in rows], SCHEMA).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)
