"""Substring duplicates: words that lie in a window of WINDOW words whose word sequence also starts anywhere else, in this or another document.

Documents are searched in compressed full-text indexes (rolefit.llm.fm_index), one for each shard; the words are dealt to shards so that equal windows meet in one:
1. One pass over every text. Each window has an anchor: the GRAM adjacent words in it of least hash, the leftmost among equals. Adjacent windows of one
   anchor make a stretch (some 50 words). Equal windows have equal anchors, so an anchor's stretches hold all windows that can equal one of them. What is
   shuffled is a few numbers a stretch; stretches of equal content (128 bits of hashes) are counted, a task's own before the shuffle. A stretch that
   occurs twice is repeated as a whole, and no other can change that.
2. Anchors with several different contents, of which one at least occurs once, go on. One stretch of each content is fetched from the texts. A shard is a
   block of anchors: its stretches go into a wavelet tree, with their counts, and those that occur once are streamed through it by backward
   search. Their matching statistics give the places from which WINDOW words or more occur twice. Words are compared as such here.
3. The spans of a document meet its text in a last pass.

Anchors that a sample shows to be very frequent, such as a line that a third of the documents have in different surroundings, are cut
into single windows in step 1 (each window is its own anchor then), so that they spread over all tasks; so are those of step 2 whose group is larger than
GROUP. The sample steers the work only; the result is the same with any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import checkpointed, mix64, text_slices, written
from rolefit.llm.fm_index import FmIndex
from rolefit.llm.shingles import powers

#: Words of a window and of an anchor; anchors in a window; the most words of a stretch.
WINDOW, GRAM = 35, 8
REACH = WINDOW - GRAM + 1
STRETCH = WINDOW - 1 + REACH
#: Share of the documents whose anchors are counted, different contents there that make one frequent, and how many are kept at most.
SAMPLE, FREQUENT, MAX_FREQUENT = 1 / 32, 4, 1_000_000
#: Stretches that a task settles at a time; contents of an anchor that one index takes; words of one index as a rule.
SETTLED, GROUP, SHARD_WORDS = 500_000, 2_048, 100_000
#: Rows that are broadcast at most to meet the texts; beyond that they are joined by shuffle.
BROADCAST_ROWS = 2_000_000

_MULTIPLIERS = mix64(np.arange(101, 101 + GRAM, dtype=np.uint64)) | np.uint64(1)


def words_of(text: str) -> list[bytes]:
    """Words as they stand, parted by the ASCII blanks that bytes.split knows: space and 9 to 13."""
    return text.encode("utf-8", "surrogatepass").split()


class WordHashes(dict):
    """The 64-bit hash of a word; short words are remembered, up to a number."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word, seed=12)
        if len(self) < 200_000 and len(word) <= 48:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def stretches(hashes: np.ndarray, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, content, first window, number of windows) of the stretches of a text; those of frequent anchors as single windows."""
    n = len(hashes) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    places = len(hashes) - GRAM + 1
    grams = np.zeros(places, np.uint64)
    for k in range(GRAM):
        grams += hashes[k:k + places] * _MULTIPLIERS[k]
    grams = mix64(grams)
    anchor = np.lib.stride_tricks.sliding_window_view(grams, REACH).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[first, n])
    up, down = powers(len(hashes) + 1)

    def content(letters: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(letters * up[:len(hashes)], out=sums[1:])
        return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))

    gram, body = grams[anchor[first]], content(hashes, first, first + count + WINDOW - 1)
    if frequent is not None and len(frequent):
        hot = frequent[np.minimum(np.searchsorted(frequent, gram), len(frequent) - 1)] == gram
        if hot.any():
            ends = np.cumsum(count[hot])
            single = np.arange(ends[-1]) + np.repeat(first[hot] - (ends - count[hot]), count[hot])
            gram = np.r_[gram[~hot], content(hashes, single, single + WINDOW)]
            body = np.r_[body[~hot], content(mix64(hashes + np.uint64(1)), single, single + WINDOW)]
            first, count = np.r_[first[~hot], single], np.r_[count[~hot], np.ones(len(single), np.int64)]
    return gram, body, first, count


def frequent_anchors(docs: DataFrame) -> np.ndarray:
    """Anchors with at least FREQUENT different contents in the sample, ascending."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for _, texts in text_slices(batches, "text"):
            parts = [stretches(known.of(words_of(t))) for t in texts]
            both = np.unique(np.stack([np.concatenate([p[i] for p in parts]) for i in (0, 1)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, i].copy().view(np.int64)) for i in (0, 1)], ["gram", "body"])

    pairs = docs.sample(SAMPLE, seed=13).select("text").mapInArrow(step, "gram long, body long").distinct()
    top = pairs.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "gram").limit(MAX_FREQUENT)
    return np.sort(top.select("gram").toArrow().column(0).to_numpy().view(np.uint64))


#: copies: 1, or 2 for a content that occurs at least twice. settled rows are windows known to be repeated, without anchor.
ENTRIES = "settled boolean, gram long, body long, doc long, start int, count int, copies int"
_NAMES = [c.split()[0] for c in ENTRIES.split(", ")]


def _entries(settled: bool, gram, body, doc, start, count, copies) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(doc), settled)), *(pa.array(c.view(np.int64)) for c in (gram, body)), pa.array(doc.astype(np.int64)),
         *(pa.array(c.astype(np.int32)) for c in (start, count, copies))], _NAMES)


def joined_up(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of places, those that touch or overlap in one document as one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], start[order] + count[order]
    if not len(doc):
        return doc, start, count
    number = np.cumsum(np.r_[False, doc[1:] != doc[:-1]])
    reach = np.maximum.accumulate(end + (number << 32)) - (number << 32)  # never less than the documents before
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])]
    at = np.flatnonzero(fresh)
    return doc[at], start[at], reach[np.r_[at[1:], len(doc)] - 1] - start[at]


def _settled(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    runs = joined_up(doc.astype(np.int64), start.astype(np.int64), count.astype(np.int64))
    spread = mix64(runs[0].astype(np.uint64) * np.uint64(3) + runs[1].astype(np.uint64))
    return _entries(True, spread, spread, *runs, np.zeros(len(runs[0])))


def entries(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """One stretch of (doc, text) for each content of a part of a task, and as settled rows all windows of the contents that occur several times there."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def settle(parts: list) -> Iterator[pa.RecordBatch]:
        gram, body, doc, start, count = (np.concatenate([p[i] for p in parts]) for i in range(5))
        order = np.lexsort((body, gram))
        gram, body, doc, start, count = (x[order] for x in (gram, body, doc, start, count))
        at = np.flatnonzero(np.r_[True, (gram[1:] != gram[:-1]) | (body[1:] != body[:-1])])
        sizes = np.diff(np.r_[at, len(gram)])
        again = np.repeat(sizes > 1, sizes)
        if again.any():
            yield _settled(doc[again], start[again], count[again])
        back = at[np.lexsort((start[at], doc[at]))]  # documents in order again: neighbours compress well
        copies = np.minimum(np.repeat(sizes, sizes)[back], 2)
        yield _entries(False, *(x[back] for x in (gram, body, doc, start, count)), copies)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, known = [], 0, WordHashes()
        for part, texts in text_slices(batches, "text"):
            for doc, text in zip(part.column(0).to_pylist(), texts):
                gram, body, first, count = stretches(known.of(words_of(text)), shared.value)
                if len(gram):
                    parts.append((gram, body, np.full(len(gram), doc), first, count))
                    held += len(gram)
            if held >= SETTLED:
                yield from settle(parts)
                parts, held = [], 0
        if parts:
            yield from settle(parts)

    return docs.select("doc", "text").mapInArrow(step, ENTRIES)


def met_by_anchor(rows: DataFrame) -> DataFrame:
    """settled rows: windows that are repeated. Other rows: one stretch for each content of an anchor that has several, with its copies (1 or 2).

    Each partition is sorted and read as a stream; of the last anchor no more is held than one row of its last content.
    """
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, several_before = None, False  # the last content so far, and whether its anchor has others before it
        for batch in batches:
            settled, *columns = (np.asarray(batch.column(i)) for i in range(7))
            settled = settled.astype(bool)
            if settled.any():
                yield _entries(True, *(c[settled] for c in columns))
            columns = [c[~settled] for c in columns]
            if not len(columns[0]):
                continue
            if held is not None:
                columns = [np.r_[h, c] for h, c in zip(held, columns)]
            gram, body, doc, start, count, copies = columns
            new_gram = np.r_[True, gram[1:] != gram[:-1]]
            at = np.flatnonzero(new_gram | np.r_[True, body[1:] != body[:-1]])
            sizes = np.diff(np.r_[at, len(gram)])
            total = np.minimum(np.add.reduceat(copies, at), 2)
            late = np.repeat(total > 1, sizes) & (copies == 1)  # rows of 2 are settled already
            if late.any():
                yield _settled(doc[late], start[late], count[late])
            group = np.cumsum(new_gram)[at] - 1
            several = np.bincount(group)[group] > 1
            several[group == 0] |= several_before and held is not None and held[0][0] == gram[0]
            done = at[:-1][several[:-1]]
            if len(done):
                yield _entries(False, *(c[done] for c in columns[:5]), total[:-1][several[:-1]])
            held, several_before = [*(c[at[-1:]] for c in columns[:5]), total[-1:]], bool(several[-1])
        if held is not None and several_before:
            yield _entries(False, *held)

    return rows.repartition("gram").sortWithinPartitions("settled", "gram", "body", "doc", "start").mapInArrow(step, ENTRIES)


def fetched(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(gram, doc, start, count, copies, words) of the chosen stretches, their words joined by one blank."""
    small = chosen.count() <= BROADCAST_ROWS
    lists = checkpointed(chosen.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("gram", "start", "count", "copies")).alias("parts")))
    met = rows.select("doc", "text").join(F.broadcast(lists) if small else lists, F.col("doc") == F.col("_doc"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            lists = part.column(2)
            flat = lists.flatten()
            start, count = (flat.field(i).to_numpy() for i in (1, 2))
            sizes = lists.value_lengths().to_numpy()
            out, at = [], 0
            for text, n in zip(texts, sizes.tolist()):
                words = words_of(text)
                out += [b" ".join(words[a:a + c + WINDOW - 1]) for a, c in zip(start[at:at + n].tolist(), count[at:at + n].tolist())]
                at += n
            doc = np.repeat(part.column(0).to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([flat.field(0), pa.array(doc), flat.field(1), flat.field(2), flat.field(3), pa.array(out, pa.binary())],
                                             ["gram", "doc", "start", "count", "copies", "words"])

    return met.select("doc", "text", "parts").mapInArrow(step, "gram long, doc long, start int, count int, copies int, words binary")


def searched(pieces: list[tuple[int, int, int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, first window, number of windows) that occur twice among the pieces (doc, start, copies, words) of one shard; of the pieces with one copy."""
    known: dict[bytes, int] = {}
    texts = [[known.setdefault(w, len(known) + 1) for w in p[3].split()] for p in pieces]
    copies = np.array([p[2] for p in pieces], np.int64)
    index = FmIndex([np.array(t, np.int64) for t in texts], copies, STRETCH + 1)
    long = index.statistics(np.flatnonzero(copies == 1), 2) >= WINDOW
    turns = np.flatnonzero(np.diff(np.r_[False, long, False].astype(np.int8)))
    begin, end = turns[::2], turns[1::2]
    of = np.searchsorted(index.starts, begin, "right") - 1
    doc, start = (np.array([p[i] for p in pieces], np.int64) for i in (0, 1))
    return doc[of], start[of] + begin - index.starts[of], end - begin


SPANS = "doc long, start int, count int"


def _spans(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                                      ["doc", "start", "count"])


def shard_matches(pieces: DataFrame) -> DataFrame:
    """(doc, start, count) of the windows that occur twice; anchors are read in order, and an index takes whole anchors until it has SHARD_WORDS words."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group, block, words = None, [], [], 0
        for batch in batches:
            for gram, *piece, count in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if gram != last:
                    block += group
                    last, group = gram, []
                    if words >= SHARD_WORDS:
                        yield _spans(*joined_up(*searched(block)))
                        block, words = [], 0
                group.append(piece)
                words += count + WINDOW
        if block or group:
            yield _spans(*joined_up(*searched(block + group)))

    columns = pieces.select("gram", "doc", "start", "copies", "words", "count")
    return columns.repartition("gram").sortWithinPartitions("gram").mapInArrow(step, SPANS)


def large_groups(pieces: DataFrame) -> DataFrame:
    """The same for anchors with very many contents, window by window: counted as strings, which combine before the shuffle."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc, start, count, copies, words in zip(*(batch.slice(at, 256).column(i).to_pylist() for i in range(5))):
                    words = words.split()
                    out += [(doc, start + i, copies, b" ".join(words[i:i + WINDOW])) for i in range(count)]
                columns = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                                                 ["doc", "start", "copies", "words"])

    single = pieces.select("doc", "start", "count", "copies", "words").mapInArrow(step, "doc long, start int, copies int, words binary")
    single = written(single)
    often = single.groupBy("words").agg(F.sum("copies").alias("n")).where("n > 1").select("words")
    return single.where("copies = 1").join(often, "words", "left_semi").select("doc", "start", F.lit(1).alias("count"))


def joined_runs(spans: DataFrame) -> DataFrame:
    """(doc, runs): the windows (doc, start, count) of each document as runs of words, those that touch or overlap as one."""
    listed = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "count")).alias("runs"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(1)
            sizes = runs.value_lengths().to_numpy()
            flat = runs.flatten()
            start, count = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            row, start, count = joined_up(np.repeat(np.arange(len(sizes)), sizes), start, count + WINDOW - 1)
            ends = np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)
            merged = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(start + count, pa.int64())], ["start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), merged)], ["doc", "runs"])

    return listed.mapInArrow(step, f"doc long, runs array<{SPAN}>")


SPAN = "struct<start:long,end:long>"


def numbered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, doc, text): doc is the key where that names one row, else a number of the row in a written table. A null text is empty."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = docs.schema[key].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
    if whole and rows.groupBy("key").count().where("count > 1 or key is null").isEmpty():
        return rows.withColumn("doc", F.col("key").cast("long"))
    return written(rows.withColumn("doc", F.monotonically_increasing_id()))


def remove_substrings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, spans (array of start and end in words, maximal removed runs) and kept (the other words, joined by one blank) for every row.

    Words are parted by ASCII blanks. A null text is empty; texts under WINDOW words keep all. Rows that share a key (or have none) are documents of their
    own, so of a row that stands there twice both lose all they share. Other columns are not read; an empty table gives an empty one. Keys are of any type.
    """
    key_type = docs.schema[key].dataType.simpleString()
    rows = numbered(docs, key, text)
    met = written(met_by_anchor(entries(rows, frequent_anchors(rows))))
    # an anchor whose contents all occur twice has nothing to be searched for
    open_ = met.where("not settled").select("gram", "doc", "start", "count", "copies")
    groups = checkpointed(open_.groupBy("gram").agg(F.count("*").alias("n"), F.min("copies").alias("least")).where("least = 1"))
    large = groups.where(F.col("n") > GROUP).select("gram")
    spans = shard_matches(fetched(rows, open_.join(groups.where(F.col("n") <= GROUP).select("gram"), "gram", "left_semi")))
    if not large.isEmpty():
        spans = spans.union(large_groups(fetched(rows, open_.join(large, "gram", "left_semi"))))
    per_doc = checkpointed(joined_runs(met.where("settled").select("doc", "start", "count").union(spans)))
    runs = per_doc.withColumnRenamed("doc", "_doc")
    small = (per_doc.select(F.sum(F.size("runs"))).first()[0] or 0) <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(runs) if small else runs, F.col("doc") == F.col("_doc"), "left")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            total, removed, kept, spans = [], [], [], []
            for text_, runs_ in zip(texts, part.column(2).to_pylist()):
                words = words_of(text_)
                own, at, gone = [], 0, 0
                for run in runs_ or ():
                    own += words[at:run["start"]]
                    at = run["end"]
                    gone += at - run["start"]
                own += words[at:]
                total.append(len(words)), removed.append(gone), spans.append(runs_ or [])
                kept.append(b" ".join(own).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())],
                ["key", "n_words", "n_removed", "spans", "kept"])

    out = joined.select("key", "text", "runs").mapInArrow(step, f"key {key_type}, n_words long, n_removed long, spans array<{SPAN}>, kept string")
    return out.withColumnRenamed("key", key)


def digest_table(removed: DataFrame, key: str = "doc_id") -> DataFrame:
    return removed.select(key, "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def oracle_sql() -> str:
    """The rule itself: every window as a string, counted; a word goes if a window that covers it occurs twice."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
w AS (SELECT r, unnest(range(1, len(words) - {WINDOW - 2})) AS i, words FROM d WHERE len(words) >= {WINDOW}),
h AS (SELECT r, i, md5(array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ')) AS body FROM w),
t AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY body) AS n FROM h) WHERE n > 1),
e AS (SELECT r, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS j FROM d WHERE len(words) > 0),
m AS (SELECT e.r, e.j, e.word, t.i FROM e LEFT JOIN t ON t.r = e.r AND t.i = e.j),
c AS (SELECT r, j, word, max(i) OVER (PARTITION BY r ORDER BY j ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS hit FROM m),
k AS (SELECT r, count(*) FILTER (WHERE hit IS NOT NULL) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (WHERE hit IS NULL) AS kept FROM c GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""
