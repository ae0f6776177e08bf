"""Fill-in-the-middle: documents cut at two ranks and put together with marks, the middle last.

The ranks count units (code points, words with the blanks behind them, or lines); cuts are made between code points. SkipList leads from one to the other: its lowest
lane has one node for each unit, every lane above it a quarter of the nodes below, chosen by a hash of their number so that no
order of the text can make a lane degenerate. Each link carries two widths, how many units and how many code points it leaps. find(rank) starts at the head of the
highest lane, takes links as long as the units that they leap fit into what is left of the rank, goes down a lane, and so on; the code points that were
leaped on the way are the place of the cut. Lanes are arrays, built with a few array operations a lane.

A map over the rows without any shuffle; memory is bounded by the longest text. restored() turns outputs into texts again, in column functions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import mix64, text_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Of 100 documents so many are cut; of 100 cut ones so many have the suffix in front.
CUT_SHARE, SUFFIX_FIRST_SHARE = 90, 20
#: One node in so many goes up a lane (a power of two), and the nodes that a highest lane has at most.
FAN, TOP = 4, 8
UNITS = {"word": re.compile(r"\s*\S+\s*|\s+"), "line": re.compile(r"[^\n]*\n|[^\n]+")}


@lru_cache(maxsize=1)
def _promoted(size: int) -> np.ndarray:
    chosen = mix64(np.arange(size, dtype=np.uint64) + np.uint64(0x51ED270B)) & np.uint64(FAN - 1) == 0
    chosen[0] = True  # the head is in every lane
    return chosen


def promoted(n: int) -> np.ndarray:
    """Which of n nodes of a lane are in the lane above."""
    return _promoted(1 << max(16, int(n - 1).bit_length()))[:n]


class SkipList:
    """Lanes from the lowest: (units leaped, code points leaped, number of the node in the lane below) of every node's link."""

    def __init__(self, widths: np.ndarray):
        units, points = np.ones(len(widths), np.int32), widths.astype(np.int32)
        self.n_units, self.n_points = len(widths), int(points.sum())
        self.lanes: list[tuple[np.ndarray, np.ndarray, np.ndarray | None]] = [(units, points, None)]
        while len(units) > TOP:
            up = np.flatnonzero(promoted(len(units)))
            if len(up) == len(units):
                break
            units, points = np.add.reduceat(units, up), np.add.reduceat(points, up)
            self.lanes.append((units, points, up))

    def find(self, rank: int) -> int:
        """Code points before the unit of this rank; all of them for the rank behind the last unit."""
        if not 0 <= rank <= self.n_units:
            raise IndexError(rank)
        left, place, node = rank, 0, 0
        for units, points, down in reversed(self.lanes):
            while left and node < len(units) and units[node] <= left:
                left -= int(units[node])
                place += int(points[node])
                node += 1
            if not left:
                return place
            if down is not None:
                node = int(down[node])
        return place


def unit_widths(text: str, unit: str = "char") -> np.ndarray:
    """Code points of each unit."""
    if unit == "char":
        return np.ones(len(text), np.int32)
    return np.fromiter((len(m) for m in UNITS[unit].findall(text)), np.int32)


def draws(seed: int, key: object) -> list[int]:
    """Four numbers of 32 bits that depend on seed and key alone; a null key counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[4 * k:4 * k + 4], "big") for k in range(4)]


def rearranged(text: str, key: object, seed: int = 1, unit: str = "char") -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output). Texts that are empty or hold a mark stay plain."""
    widths = unit_widths(text, unit)
    n = len(widths)
    h1, h2, h3, h4 = draws(seed, key)
    if not text or any(mark in text for mark in MARKS) or h3 % 100 >= CUT_SHARE:
        return n, "plain", None, None, text
    lanes = SkipList(widths)
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = lanes.find(first), lanes.find(second)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST_SHARE:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def fill_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, unit: str = "char") -> DataFrame:
    """key, n (units), form (plain, psm or spm), prefix_chars, middle_chars and output for every row.

    A null text is empty, and empty texts stay plain. The draws depend on seed and key alone: repeated rows get equal outputs, rows without key are drawn as one
    key. Other columns are not read; an empty table gives an empty one.
    """
    if unit != "char" and unit not in UNITS:
        raise ValueError(f"unit is char, {', '.join(UNITS)}")
    key_type = docs.schema[key].dataType.simpleString()
    columns = ["key", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            found = [rearranged(t, k, seed, unit) for t, k in zip(texts, part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([f[i] for f in found], kind) for i, kind in enumerate(types))], columns)

    rows = docs.select(F.col(key).alias("key"), F.col(key).cast("string").alias("name"), F.col(text).alias("text"))
    return rows.mapInArrow(step, f"key {key_type}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: what stands between its marks, in the order of the text."""
    def between(left: str, right: str) -> Column:
        begin = F.instr(output, left) + len(left)
        return F.substr(output, begin, F.instr(output, right) - begin)

    tail = F.substr(output, F.instr(output, MIDDLE) + len(MIDDLE))
    return (F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), tail, between(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(between(PREFIX, MIDDLE), tail, between(SUFFIX, PREFIX))).otherwise(output))


def digest_table(cut: DataFrame, key: str = "doc_id") -> DataFrame:
    return cut.select(key, "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


def oracle_sql() -> str:
    """The cuts and outputs by the rule, with substrings in place of lanes."""
    h = ", ".join(f"('0x' || substr(digest, {8 * k + 1}, 8))::BIGINT AS h{k + 1}" for k in range(4))
    marked = " OR ".join(f"contains(body, '{m}')" for m in MARKS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
h AS (SELECT doc_id, body, length(body) AS n, {h} FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN body = '' OR {marked} OR h3 % 100 >= {CUT_SHARE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST_SHARE} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(body, 1, a) AS pre, substr(body, a + 1, b - a) AS mid, substr(body, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
    ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256, sha256(body) AS restored_sha256
FROM p"""
