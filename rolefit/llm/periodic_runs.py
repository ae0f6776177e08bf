"""Periodic runs of words: maximal stretches of a text that repeat with a period, at least three times and over at least 24 words.

runs() finds them by longest common extensions (LCE) in suffix trees:
1. Ukkonen's algorithm builds the suffix tree of the words and that of the words in reverse.
2. A tour through a tree writes the string depth of the node that each step down leaves; the least entry between two leaves is the depth of their lowest
   common ancestor, which is the LCE of their suffixes. A table of minima over powers of two answers that in constant time, for arrays of pairs at once.
3. Every run holds a Lyndon root: the longest Lyndon word that starts at some place, for one of the two orders of the alphabet. That word ends where the
   next suffix of lesser (for the other order: greater) rank starts, so a stack over the ranks of the suffixes gives two candidates for each place.
4. Each candidate is extended to both sides, forward in the one tree and backward in the other. What is long enough is a run, with its least period.

Trees are built only for stretches that can hold a run (stretches()): inside one, every eight adjacent words occur again at the distance of the period, a third
of the run at most. This is a necessary condition, so nothing is lost, and most texts have no such stretch. A map over the rows without any shuffle; memory
grows with the longest repetitive stretch of one text, some 700 bytes a word of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import mix64, text_slices

#: Words and periods that a run has at least.
LENGTH, PERIODS = 24, 3
#: Adjacent words that occur again inside a run: as many as are left of LENGTH words behind two periods, at least.
GRAM = LENGTH // PERIODS
_MULTIPLIERS = mix64(np.arange(1, GRAM + 1, dtype=np.uint64)) | np.uint64(1)


class SuffixTree:
    """Of a sequence of positive numbers; a 0 is put behind it. rank: of every suffix in the order of its numbers."""

    def __init__(self, symbols: np.ndarray):
        s = symbols.tolist() + [0]
        self.size = len(s)
        parent, start, stop = self._grown(s, int(symbols.max(initial=0)) + 1)
        self._toured(s, parent, start, stop)

    @staticmethod
    def _grown(s: list[int], alphabet: int) -> tuple[list[int], list[int], list[int]]:
        """Ukkonen: for each node its parent and the piece of s on the edge to it; node 0 is the root."""
        n = len(s)
        parent, start, stop, link = [0], [0], [0], [0]
        edges: dict[int, int] = {}  # node and first symbol: child
        node = edge = length = waiting = 0
        for i, c in enumerate(s):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                at = node * alphabet + s[edge]
                child = edges.get(at)
                if child is None:
                    edges[at] = len(start)
                    parent.append(node), start.append(i), stop.append(n), link.append(0)
                    if unlinked:
                        link[unlinked] = node
                    unlinked = 0
                else:
                    first = start[child]
                    span = stop[child] - first
                    if length >= span:  # the place lies behind this edge
                        edge += span
                        length -= span
                        node = child
                        continue
                    if s[first + length] == c:
                        if unlinked:
                            link[unlinked] = node
                        length += 1
                        break
                    inner = len(start)
                    edges[at] = inner
                    parent.append(node), start.append(first), stop.append(first + length), link.append(0)
                    edges[inner * alphabet + c] = inner + 1
                    parent.append(inner), start.append(i), stop.append(n), link.append(0)
                    start[child] = first + length
                    parent[child] = inner
                    edges[inner * alphabet + s[first + length]] = child
                    if unlinked:
                        link[unlinked] = inner
                    unlinked = inner
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        return parent, start, stop

    def _toured(self, s: list[int], parent: list[int], start: list[int], stop: list[int]) -> None:
        up, begin = np.array(parent, np.int64), np.array(start, np.int64)
        first = np.array(s, np.int64)[begin]
        kids = np.lexsort((-first[1:], up[1:])) + 1  # of each node together, the last symbol first: the stack turns them round
        cuts = np.searchsorted(up[kids], np.arange(len(up) + 1)).tolist()
        kids = kids.tolist()
        n = len(s)
        depth = [0] * len(parent)
        tour = []  # depth of the node that the step to each node leaves
        place, rank, leaves = [0] * n, [0] * n, 0
        stack = [0]
        while stack:
            v = stack.pop()
            above = depth[parent[v]]
            below = depth[v] = above + stop[v] - start[v]
            a, b = cuts[v], cuts[v + 1]
            if a == b:
                place[n - below], rank[n - below] = len(tour), leaves
                leaves += 1
            else:
                stack += kids[a:b]
            tour.append(above)
        self.place, self.rank = np.array(place, np.int64), rank
        self.table = [np.array(tour, np.int32)]
        while 2 << (len(self.table) - 1) <= len(tour):
            low, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(low[:-half], low[half:]))

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and at b (different places) share at their front."""
        left, right = np.minimum(self.place[a], self.place[b]) + 1, np.maximum(self.place[a], self.place[b]) + 1
        level = np.frexp((right - left).astype(np.float64))[1] - 1
        out = np.zeros(len(left), np.int64)
        for k, low in enumerate(self.table):
            own = level == k
            if own.any():
                out[own] = np.minimum(low[left[own]], low[right[own] - (1 << k)])
        return out


def next_lower(rank: list[int]) -> list[int]:
    """For each place the next one of lower rank, or the length."""
    out = [len(rank)] * len(rank)
    stack: list[int] = []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def stretch_runs(symbols: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of the runs of one sequence of numbers, by start and period."""
    n = len(symbols)
    symbols = np.unique(symbols, return_inverse=True)[1] + 1
    tree = SuffixTree(symbols)
    rank = tree.rank[:n]
    lower = np.array(next_lower(rank), np.int64)
    higher = np.array(next_lower([-r for r in rank]), np.int64)
    places = np.arange(n)
    # the end mark is the least symbol of the one order, so behind the last place no candidate of the other one ends
    i, j = np.r_[places, places[higher < n]], np.r_[lower, higher[higher < n]]
    period = j - i
    forward = np.zeros(len(i), np.int64)
    inside = j < n
    forward[inside] = tree.extension(i[inside], j[inside])
    del tree
    tree = SuffixTree(symbols[::-1])
    back = np.zeros(len(i), np.int64)
    inside = i > 0
    back[inside] = tree.extension(n - i[inside], n - j[inside])
    length = period + forward + back
    found = (length >= LENGTH) & (length >= PERIODS * period)
    return np.unique(np.stack([i - back, period, length], axis=1)[found], axis=0)[:, [0, 2, 1]]


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(begin, end) of the stretches that hold all runs: each GRAM words of one occur again in it, at most a third of it away."""
    n = len(ids) - GRAM + 1
    if len(ids) < LENGTH:
        return []
    grams = np.zeros(n, np.uint64)
    for k in range(GRAM):
        grams += ids[k:k + n] * _MULTIPLIERS[k]
    out, todo = [], [(0, len(ids))]
    while todo:
        begin, end = todo.pop()
        own = grams[begin:end - GRAM + 1]
        order = np.argsort(own, kind="stable")
        near = (own[order[1:]] == own[order[:-1]]) & (np.diff(order) * PERIODS <= end - begin)
        again = np.zeros(len(own) + 2, bool)
        again[order[1:][near] + 1] = True
        again[order[:-1][near] + 1] = True
        turns = np.flatnonzero(again[1:] != again[:-1])
        for a, b in zip(turns[::2].tolist(), (turns[1::2] + GRAM - 1).tolist()):
            if b - a == end - begin:
                out.append((begin, end))
            elif b - a >= LENGTH:
                todo.append((begin + a, begin + b))
    return sorted(out)


def runs(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the words, by start and period."""
    if len(words) < LENGTH:
        return []
    known: dict = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.uint64, len(words))
    out = []
    for begin, end in stretches(ids):
        found = stretch_runs(ids[begin:end])
        found[:, 0] += begin
        out += found.tolist()
    return sorted((a, n, p) for a, n, p in out)


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length over period, compared exactly; ties go to the least start and then period."""
    return min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run holds behind its first period."""
    if not found:
        return words
    turns = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        turns[start + period] += 1
        turns[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(turns[:-1]) == 0).tolist()]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUN = "struct<start:long,length:long,period:long>"


def find_runs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs (array of start, length and period, by start and period), strongest (one of them, or null) and collapsed (the words
    that stay, joined by one blank) for every row.

    Words are parted by ASCII blanks; a null text has none. Repeated rows have equal results, keys are not looked at. Other columns are not read; an empty
    table gives an empty one.
    """
    key_type = docs.schema[key].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
            found = [runs(w) for w in words]
            as_rows = [[dict(zip(("start", "length", "period"), r)) for r in f] for f in found]
            best = [None if (r := strongest(f)) is None else dict(zip(("start", "length", "period"), r)) for f in found]
            kept = [b" ".join(collapsed(w, f)).decode("utf-8", "surrogatepass") for w, f in zip(words, found)]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(w) for w in words], pa.int64()), pa.array(as_rows, pa.list_(_RUN)), pa.array(best, _RUN),
                 pa.array(kept, pa.string())], ["key", "n_words", "runs", "strongest", "collapsed"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        step, f"key {key_type}, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string").withColumnRenamed("key", key)


def planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with a period put into every tenth text: with h the crc32 of the key as text and g = h / 10, where h divides by 10 the words from number g % n on
    repeat the first 1 + (n - g % n) / (3 + g % 8) of them. A null key plants nothing."""
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    rows = docs.select(F.col(key), F.col(text).alias("_text"), F.when(h % 10 == 0, h).alias("_h")).select(
        key, "_text", "_h", F.when(F.col("_h").isNotNull(), F.regexp_extract_all("_text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("_words"))
    n, g = F.size("_words"), F.floor(F.col("_h") / 10)
    a = (g % n).cast("int")
    parts = rows.select(key, "_text", "_words", F.when(n > 0, a).alias("_a"), F.when(n > 0, (1 + F.floor((n - a) / (3 + g % 8))).cast("int")).alias("_p"))
    a, p = F.col("_a"), F.col("_p")
    tail = F.flatten(F.array_repeat(F.slice("_words", a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.concat_ws(" ", F.slice("_words", F.lit(1), a), F.slice(tail, F.lit(1), n - a))
    return parts.select(key, F.when(a.isNotNull(), changed).otherwise(F.col("_text")).alias(text))


def digest_table(found: DataFrame, key: str = "doc_id") -> DataFrame:
    best = F.col("strongest")
    line: Column = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        key, F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def oracle_sql() -> str:
    """The rule itself: places where GRAM words stand again at a distance make islands of that distance, and the least period of a stretch counts. crc32 is
    worked out bit by bit."""
    crc = ("xor(4294967295, list_reduce([4294967295] || [ascii(x) FOR x IN string_split(doc_id::VARCHAR, '')], "
           "lambda c, b: list_reduce([xor(c, b)] || [0 FOR _ IN range(8)], lambda v, _: xor(v >> 1, 3988292384 * (v & 1)))))")
    gram = ", ".join(f"lead(word, {k}) OVER s" for k in range(1, GRAM))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, {crc} AS h FROM documents),
p AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
x AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(n), lambda i:
        w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END]) END AS w FROM p),
e AS (SELECT r, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM x),
g AS (SELECT r, n, i, concat_ws(' ', word, {gram}) AS gram FROM e WINDOW s AS (PARTITION BY r ORDER BY i) QUALIFY lead(word, {GRAM - 1}) OVER s IS NOT NULL),
m AS (SELECT b.r, b.i, c.i - b.i AS q FROM g b JOIN g c ON b.r = c.r AND b.gram = c.gram AND c.i > b.i AND {PERIODS} * (c.i - b.i) <= b.n),
k AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m),
t AS (SELECT r, q, min(i) AS s, max(i) + {GRAM} + q - min(i) AS l FROM k GROUP BY r, q, island),
u AS (SELECT * FROM t b WHERE l >= {LENGTH} AND l >= {PERIODS} * q
        AND NOT EXISTS (SELECT 1 FROM t c WHERE c.r = b.r AND c.q < b.q AND c.s <= b.s AND c.s + c.l >= b.s + b.l)),
best AS (SELECT r, s, l, q FROM u QUALIFY row_number() OVER (PARTITION BY r ORDER BY l::DOUBLE / q DESC, s, q) = 1),
every AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS line FROM u GROUP BY r),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS body FROM e
           WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.r = e.r AND e.i >= u.s + u.q AND e.i < u.s + u.l) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, s::BIGINT AS start, l::BIGINT AS length, q::BIGINT AS period, (1000 * l // q)::BIGINT AS exponent_milli,
  sha256(coalesce(line, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM x LEFT JOIN best USING (r) LEFT JOIN every USING (r) LEFT JOIN kept USING (r)"""
