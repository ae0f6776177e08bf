"""Gestalt (Ratcliff-Obershelp) similarity. Spark has no such function, so it is an Arrow-batched UDF.

The UDF bodies are nested functions: they travel to the executors by value and need nothing installed there.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def gestalt_ratio(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Similarity of two strings, 0 to 1; the argument order matters.

    Below a positive threshold the result is null, and upper bounds spare most of the full comparisons: two before a comparison, and one that falls with each
    block that it finds. A null argument gives null. Equal pairs of one batch are compared once, and a second string is prepared once for all its pairs.
    """

    def score(m: SequenceMatcher):
        if m.real_quick_ratio() < threshold or m.quick_ratio() < threshold:
            return None
        a, b = len(m.a), len(m.b)
        if not a + b:
            return 1.0
        # what is matched, and what can be in the open boxes at most: the shorter side of each
        matched, open_chars, boxes = 0, min(a, b), [(0, a, 0, b)]
        while boxes:
            if 2.0 * (matched + open_chars) / (a + b) < threshold:
                return None
            a_from, a_to, b_from, b_to = boxes.pop()
            open_chars -= min(a_to - a_from, b_to - b_from)
            i, j, n = m.find_longest_match(a_from, a_to, b_from, b_to)
            if n:
                matched += n
                for box in ((a_from, i, b_from, j), (i + n, a_to, j + n, b_to)):
                    if box[0] < box[1] and box[2] < box[3]:
                        open_chars += min(box[1] - box[0], box[3] - box[2])
                        boxes.append(box)
        r = 2.0 * matched / (a + b)
        return r if r >= threshold else None

    @F.pandas_udf(DoubleType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        known, firsts = {}, {}
        for x, y in set(zip(left, right)):
            if x is None or y is None:
                known[x, y] = None
            else:
                firsts.setdefault(y, []).append(x)
        for y, own in firsts.items():
            m = SequenceMatcher(None, "", y)
            for x in own:
                m.set_seq1(x)
                known[x, y] = score(m)
        return pd.Series([known[pair] for pair in zip(left, right)], dtype="float64")

    return ratio(a, b)
