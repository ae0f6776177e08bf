"""Suffix-array duplicates: bytes that lie in a string of LENGTH bytes which also starts earlier, in this document or one before.

The result is exact over the whole corpus. No global suffix array is built; the corpus is cut so that equal strings meet:
1. One pass over every text, as bytes. Each string of LENGTH bytes has an anchor: the GRAM bytes in it of least hash, the leftmost among equals. Adjacent strings
   with one anchor make a stretch (some 130 bytes). Equal strings have equal anchors at equal places, so only stretches of one anchor
   can share a string. Stretches of equal content are one entry with many occurrences: all but the first are repeats as they
   stand. A task settles those among its own documents before anything is shuffled, and what is left meets by anchor.
2. Anchors with several different contents go on. Their stretches are fetched from the texts and put, anchor by anchor, into an enhanced suffix array: the
   suffixes of at least LENGTH bytes in order, with the lengths of the prefixes that neighbours share. A scan with a stack walks the tree of
   common-prefix intervals; an interval whose occurrences differ in the byte before them is a maximal repeat and is put out with all its
   occurrences. Runs of suffixes that all have the same byte before them hold no such interval and are skipped as a whole.
3. Of each repeat all occurrences but the first are removed. The spans of a document meet its text in a last pass.

Anchors that a sample shows to be very frequent, such as a line that a third of the documents have in different surroundings, are cut
into single strings in step 1 (a stretch of one string has its own hash for an anchor), so that they spread over all tasks; so are
those of step 2 whose group is larger than GROUP. The sample steers the work only; the result is the same with any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import checkpointed, mix64, text_slices, written
from rolefit.llm.shingles import _LETTERS, powers

#: Bytes of a string that counts, of an anchor, and starts of anchors in such a string.
LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM + 1
#: The most bytes of a stretch.
STRETCH = LENGTH - 1 + REACH
#: Share of the documents whose anchors are counted, different contents there that make one frequent, and how many are kept at most.
SAMPLE, FREQUENT, MAX_FREQUENT = 1 / 32, 4, 1_000_000
#: Stretches that a task settles at a time; stretches of an anchor that one suffix array takes; stretches of one array as a rule.
SETTLED, GROUP, ARRAY = 1_000_000, 4_096, 512
#: Rows that are broadcast at most to meet the texts; beyond that they are joined by shuffle.
BROADCAST_ROWS = 2_000_000

_SECOND = mix64(np.arange(1001, 1257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _sums(raw: np.ndarray, letters: np.ndarray, up: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(letters[raw] * up[:len(raw)], out=sums[1:])
    return sums


def _hashes(sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))


def stretches(raw: np.ndarray, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, content hash, first start, number of starts) of the stretches of a text; those of frequent anchors as single strings."""
    n = len(raw) - LENGTH + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = powers(len(raw) + 1)
    sums = _sums(raw, _LETTERS, up)
    places = len(raw) - GRAM + 1
    grams = mix64((sums[GRAM:] - sums[:places]) * down[:places])
    order = (grams >> np.uint64(32)).astype(np.uint32)
    anchor = np.lib.stride_tricks.sliding_window_view(order, REACH).argmin(axis=1) + np.arange(n)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[first, n])
    gram = grams[anchor[first]]
    body = _hashes(sums, down, first, first + count + LENGTH - 1)
    if frequent is not None and len(frequent):
        hot = frequent[np.minimum(np.searchsorted(frequent, gram), len(frequent) - 1)] == gram
        if hot.any():
            ends = np.cumsum(count[hot])
            single = np.arange(ends[-1]) + np.repeat(first[hot] - (ends - count[hot]), count[hot])
            second = _sums(raw, _SECOND, up)
            gram = np.r_[gram[~hot], _hashes(sums, down, single, single + LENGTH)]
            body = np.r_[body[~hot], _hashes(second, down, single, single + LENGTH)]
            first, count = np.r_[first[~hot], single], np.r_[count[~hot], np.ones(len(single), np.int64)]
    return gram, body, first, count


def frequent_anchors(docs: DataFrame) -> np.ndarray:
    """Anchor hashes with at least FREQUENT different contents in the sample, ascending."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_slices(batches, "text"):
            parts = [stretches(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8)) for t in texts]
            both = np.unique(np.stack([np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, i].copy().view(np.int64)) for i in (0, 1)], ["gram", "body"])

    pairs = docs.sample(SAMPLE, seed=13).select("text").mapInArrow(step, "gram long, body long").distinct()
    top = pairs.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "gram").limit(MAX_FREQUENT)
    return np.sort(top.select("gram").toArrow().column(0).to_numpy().view(np.uint64))


ENTRIES = "settled boolean, gram long, body long, doc long, start int, count int"


def _entries(settled: bool, gram, body, doc, start, count) -> pa.RecordBatch:
    n = len(doc)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, settled)), pa.array(gram.view(np.int64)), pa.array(body.view(np.int64)), pa.array(doc.astype(np.int64)),
         pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))], ["settled", "gram", "body", "doc", "start", "count"])


def _joined_up(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts, those that touch or overlap in one document as one."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], start[order] + count[order]
    if not len(doc):
        return doc, start, count
    # starts of one document are disjoint here or nested runs; a running maximum within the document closes overlaps
    reach = np.maximum.accumulate(end + (np.cumsum(np.r_[False, doc[1:] != doc[:-1]]) << 40)) & ((1 << 40) - 1)
    fresh = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > reach[:-1])]
    at = np.flatnonzero(fresh)
    last = np.r_[at[1:], len(doc)] - 1
    return doc[at], start[at], reach[last] - start[at]


def entries(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """The stretches of (doc, text) of which no equal one comes earlier in the same part of a task, and as settled rows the runs of starts of all others."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def settle(parts: list) -> Iterator[pa.RecordBatch]:
        gram, body, doc, start, count = (np.concatenate([p[i] for p in parts]) for i in range(5))
        order = np.lexsort((start, doc, body, gram))
        gram, body, doc, start, count = gram[order], body[order], doc[order], start[order], count[order]
        first = np.r_[True, (gram[1:] != gram[:-1]) | (body[1:] != body[:-1])]
        runs = _joined_up(doc[~first], start[~first], count[~first])
        if len(runs[0]):
            spread = mix64(runs[0].astype(np.uint64) * np.uint64(3) + runs[1].astype(np.uint64))
            yield _entries(True, spread, spread, *runs)
        # documents in order again: neighbours compress well
        back = np.lexsort((start[first], doc[first]))
        yield _entries(False, *(c[first][back] for c in (gram, body, doc, start, count)))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for part, texts in text_slices(batches, "text"):
            for doc, text in zip(part.column(0).to_pylist(), texts):
                found = stretches(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), shared.value)
                if len(found[0]):
                    parts.append((found[0], found[1], np.full(len(found[0]), doc), found[2], found[3]))
                    held += len(found[0])
            if held >= SETTLED:
                yield from settle(parts)
                parts, held = [], 0
        if parts:
            yield from settle(parts)

    return docs.select("doc", "text").mapInArrow(step, ENTRIES)


def met_by_anchor(rows: DataFrame) -> DataFrame:
    """settled rows: runs of starts that repeat. Other rows: the first stretch of each content of an anchor that has several contents.

    Each partition is sorted and read as a stream; of the current anchor no more than its first row is held.
    """
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # anchor and content of the last row
        held = None  # first row of the last anchor, as long as that has one content
        for batch in batches:
            if not batch.num_rows:
                continue
            settled, gram, body, doc, start, count = (np.asarray(batch.column(i)) for i in range(6))
            settled = settled.astype(bool)
            if settled.any():
                yield _entries(True, gram[settled], body[settled], doc[settled], start[settled], count[settled])
            own = ~settled
            if not own.any():
                continue
            gram, body, doc, start, count = gram[own], body[own], doc[own], start[own], count[own]
            before = last if last is not None else (~gram[0], body[0])
            same_gram = np.r_[gram[0] == before[0], gram[1:] == gram[:-1]]
            fresh = ~(same_gram & np.r_[body[0] == before[1], body[1:] == body[:-1]])
            if (~fresh).any():
                yield _runs(doc[~fresh], start[~fresh], count[~fresh])
            last = (gram[-1], body[-1])
            group = np.cumsum(~same_gram)  # 0: the anchor of the batch before goes on
            several = np.zeros(group[-1] + 1, bool)
            np.logical_or.at(several, group[fresh & same_gram], True)
            if same_gram[0]:
                if held is None:
                    several[0] = True  # its first row is out already, or it will be with none of its own
                elif several[0]:
                    yield _entries(False, *held)
                    held = None
            chosen = fresh & several[group]
            if same_gram[0] and held is not None and not several[0]:
                chosen &= group != 0
            if chosen.any():
                yield _entries(False, gram[chosen], body[chosen], doc[chosen], start[chosen], count[chosen])
            if group[-1] > 0 or not same_gram[0]:
                held = None
                if not several[-1]:
                    i = np.flatnonzero(fresh & (group == group[-1]))[0]
                    held = tuple(c[i:i + 1] for c in (gram, body, doc, start, count))

    order = ["settled", "gram", "body", "doc", "start"]
    return rows.repartition("gram").sortWithinPartitions(*order).mapInArrow(step, ENTRIES)


def _runs(doc: np.ndarray, start: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    runs = _joined_up(doc.astype(np.int64), start.astype(np.int64), count.astype(np.int64))
    return _entries(True, np.zeros(len(runs[0]), np.int64), np.zeros(len(runs[0]), np.int64), *runs)


def suffix_order(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The enhanced suffix array of several texts, over suffixes of LENGTH bytes and more: (text, offset, shared prefix with the suffix before, symbol
    before). The symbol before a whole text is like no other."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    width = int(sizes.max())
    padded = np.zeros((len(texts) + 1, 2 * width), np.uint8)
    for i, t in enumerate(texts):
        padded[i, :len(t)] = np.frombuffer(t, np.uint8)
    flat = padded.reshape(-1)
    starts = np.maximum(sizes - LENGTH + 1, 0)
    text = np.repeat(np.arange(len(texts)), starts)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(starts) - starts, starts)
    rows = np.lib.stride_tricks.sliding_window_view(flat, width)[text * 2 * width + offset]
    # the end of a text counts as less than a zero byte: where only zero bytes follow, the shorter suffix comes first
    left = sizes[text] - offset
    order = np.argsort(left, kind="stable")
    order = order[np.argsort(rows[order].view(f"S{width}").ravel(), kind="stable")]
    rows, text, offset, left = rows[order], text[order], offset[order], left[order]
    shared = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = rows[1:] != rows[:-1]
        shared[1:] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), np.minimum(left[1:], left[:-1]))
    symbol = np.where(offset > 0, flat[np.maximum(text * 2 * width + offset - 1, 0)], 256 + text)
    return text, offset, shared, symbol


def maximal_repeats(shared: np.ndarray, symbol: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(length, first, last) of the common-prefix intervals of at least LENGTH bytes whose suffixes differ in the symbol before them."""
    deep = np.r_[shared[1:] >= LENGTH, False] | (shared >= LENGTH)
    joins = shared >= LENGTH
    if not joins.any():
        return
    # runs: a suffix that shares nothing with the one before, and those behind it that do
    heads = np.flatnonzero(~joins & deep)
    tails = np.r_[heads[1:], len(shared)]
    low = np.minimum.reduceat(np.where(deep, symbol, np.iinfo(np.int64).max), heads)
    high = np.maximum.reduceat(np.where(deep, symbol, -1), heads)
    for a, b in zip(heads[low != high].tolist(), tails[low != high].tolist()):
        end = a + 1
        while end < b and joins[end]:
            end += 1
        lengths, symbols = shared[a:end].tolist(), symbol[a:end].tolist()
        stack: list[list] = []  # length, first suffix, symbol before all of them or None where they differ
        for i in range(1, len(lengths) + 1):
            now = lengths[i] if i < len(lengths) else 0
            first, before = i - 1, symbols[i - 1]
            while stack and stack[-1][0] > now:
                length, first, inner = stack.pop()
                before = inner if inner == before else None
                if before is None:
                    yield length, a + first, a + i - 1
            if now < LENGTH:
                continue
            if stack and stack[-1][0] == now:
                if stack[-1][2] != before:
                    stack[-1][2] = None
            else:
                stack.append([now, first, before])


def repeat_spans(texts: list[bytes], doc: np.ndarray, start: np.ndarray) -> list[tuple[int, int, int]]:
    """(document, start, number of starts of LENGTH bytes) of every occurrence but the first of each maximal repeat of the texts."""
    text, offset, shared, symbol = suffix_order(texts)
    docs, places = doc[text], start[text] + offset
    out = []
    for length, first, last in maximal_repeats(shared, symbol):
        found = sorted(zip(docs[first:last + 1].tolist(), places[first:last + 1].tolist()))
        out += [(d, p, length - LENGTH + 1) for d, p in found[1:]]
    return out


def shared_suffixes(pieces: DataFrame) -> DataFrame:
    """(doc, start, count) of the repeats among the pieces (gram, doc, start, text) of one anchor."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, group, block = None, [], []  # group: pieces of the current anchor; block: those of complete anchors

        def out(rows: list) -> pa.RecordBatch:
            spans = repeat_spans([r[2] for r in rows], np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
            doc, start, count = _joined_up(*(np.array([s[i] for s in spans], np.int64) for i in range(3)))
            return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start, pa.int32()), pa.array(count, pa.int32())], ["doc", "start", "count"])

        for batch in batches:
            for gram, *row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if gram != last:
                    block += group
                    last, group = gram, []
                    if len(block) >= ARRAY:
                        yield out(block)
                        block = []
                group.append(row)
        if block or group:
            yield out(block + group)

    return pieces.select("gram", "doc", "start", "text").repartition("gram").sortWithinPartitions("gram").mapInArrow(step, "doc long, start int, count int")


def large_groups(pieces: DataFrame) -> DataFrame:
    """The same for anchors with very many stretches, string by string: each string has its first place, all others repeat it."""
    single = pieces.select("doc", "start", "text", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("at")).select(
        "doc", (F.col("start") + F.col("at")).cast("int").alias("start"), F.substring("text", F.col("at") + 1, F.lit(LENGTH)).alias("string"))
    first = single.groupBy("string").agg(F.min(F.struct("doc", "start")).alias("first"))
    return single.join(first, "string").where(F.struct("doc", "start") != F.col("first")).select("doc", "start", F.lit(1).alias("count"))


def joined_runs(spans: DataFrame) -> DataFrame:
    """(doc, runs): the spans (doc, start, count) of each document, those whose strings touch or overlap as one."""
    listed = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "count")).alias("runs"))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = batch.column(1)
            sizes = runs.value_lengths().to_numpy()
            flat = runs.flatten()
            row = np.repeat(np.arange(len(sizes)), sizes)
            start, count = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
            row, start, count = _joined_up(row, start, count + LENGTH - 1)
            ends = np.searchsorted(row, np.arange(len(sizes) + 1)).astype(np.int32)
            merged = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(count - LENGTH + 1, pa.int32())], ["start", "count"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), merged)], ["doc", "runs"])

    return listed.mapInArrow(step, "doc long, runs array<struct<start:int,count:int>>")


def _small(rows: DataFrame) -> bool:
    return rows.count() <= BROADCAST_ROWS


def _pieces(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(gram, doc, start, count, text) of the chosen stretches."""
    small = _small(chosen)
    lists = checkpointed(chosen.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("gram", "start", "count")).alias("parts")))
    at_hand = rows.select("doc", "text").join(F.broadcast(lists) if small else lists, F.col("doc") == F.col("_doc"))
    return at_hand.select("doc", F.col("text").cast("binary").alias("text"), F.inline("parts")).select(
        "gram", "doc", "start", "count", F.substring("text", F.col("start") + 1, F.col("count") + (LENGTH - 1)).alias("text"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept (the remaining bytes) and spans (array of start and end) for every row.

    A null text is empty; texts under LENGTH bytes keep all. A null key comes before all others. Rows of one key follow each other in the
    order of their texts, so that a repeated row loses what the one before it has. Other columns are not read. Keys are integers.
    """
    key_type = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if rows.groupBy("key").count().where("count > 1").isEmpty():
        rows = rows.withColumn("doc", F.coalesce("key", F.lit(-(1 << 63)).cast("long")))
    else:  # a number for each row, in the order of key and text
        ordered = written(rows.repartitionByRange("key", "text").sortWithinPartitions("key", "text").withColumn("doc", F.monotonically_increasing_id()))
        rows = ordered
    met = written(met_by_anchor(entries(rows, frequent_anchors(rows))))
    open_ = met.where("not settled").select("gram", "doc", "start", "count")
    large = checkpointed(open_.groupBy("gram").count().where(F.col("count") > GROUP).select("gram"))
    if large.isEmpty():
        spans = shared_suffixes(_pieces(rows, open_))
    else:
        spans = shared_suffixes(_pieces(rows, open_.join(large, "gram", "left_anti"))).union(
            large_groups(_pieces(rows, open_.join(large, "gram", "left_semi"))))
    every = met.where("settled").select("doc", "start", "count").union(spans)
    per_doc = checkpointed(joined_runs(every))
    runs = per_doc.withColumnRenamed("doc", "_doc")
    small = per_doc.select(F.sum(F.size("runs"))).first()[0] or 0
    joined = rows.join(F.broadcast(runs) if small <= BROADCAST_ROWS else runs, F.col("doc") == F.col("_doc"), "left")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            kept, spans = [], []
            for t, runs in zip(texts, part.column(2)):
                raw = t.encode("utf-8", "surrogatepass")
                if runs.is_valid and len(runs):
                    flat = runs.values
                    start, count = (flat.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                    _, start, count = _joined_up(np.zeros(len(start), np.int64), start, count + LENGTH - 1)
                    ends = start + count
                    kept.append(b"".join(raw[a:b] for a, b in zip(np.r_[0, ends], np.r_[start, len(raw)])))
                    spans.append([{"start": int(a), "end": int(b)} for a, b in zip(start, ends)])
                else:
                    kept.append(raw)
                    spans.append([])
            sizes = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sizes, pa.int64()), pa.array([n - len(k) for n, k in zip(sizes, kept)], pa.int64()),
                 pa.array([len(s) for s in spans], pa.int64()), pa.array(kept, pa.binary()),
                 pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                ["key", "n_bytes", "n_removed", "n_spans", "kept", "spans"])

    out = joined.select("key", "text", "runs").mapInArrow(
        step, "key long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>")
    return out.withColumn("key", F.col("key").cast(key_type)).withColumnRenamed("key", key)


def digest_table(removed: DataFrame, key: str = "doc_id") -> DataFrame:
    return removed.select(key, "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
