"""Secret scans: base patterns, and a character convolutional network over every other candidate in its context.

1. One map over the table finds in every whole text the matches of the three base patterns, and as further candidates all runs of
   RUN_CHARS or more key characters, of those that base matches touch the parts left over. Each finding carries the characters around its value as
   codes, in windows that cover the whole of it. Keyword and prefix of a base match count as surroundings, so that a value is coded alike
   whatever found it. Findings are written once and no text is read again.
2. The network (one convolution over characters, maximum over positions, one hidden layer; numpy only) is trained on all labelled
   findings: values of base matches are the positive ones; the negative ones are the candidates made of plain words, numbers, dates,
   addresses and paths, those with digits a class of their own. Any other candidate has no label, so a secret that the patterns miss is never learned as harmless. Each
   different piece is learned in its own and in other characters, with its own surroundings, with none, and with those of a piece of any label. The pieces are dealt
   into shards of some SHARD_PIECES; a round trains a copy of the network on every shard, and the mean of the copies goes into the next round. The logits are calibrated
   (Platt) on a quarter of the pieces, held back by hash, and the threshold is the highest one that still recalls `recall` of the positives held back, both from the counts of all logits
   in steps of 1 / LOGIT_STEPS.
3. A second map scores every candidate, equal windows of a batch once. Those at or above the threshold become spans of kind `model`. Base spans always stay.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolefit.llm.common import checkpointed, give_back, slices, text_slices, written

# The base patterns, their kinds in order, and what a match must have.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

RUN_CHARS = 12
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % RUN_CHARS)
#: Characters before a piece, of a piece and behind it that the network sees at once; a longer candidate is seen piece by piece.
BEFORE, PIECE, BEHIND = 20, 36, 8
WINDOW, SYMBOLS, WIDTH, FILTERS, HIDDEN = BEFORE + PIECE + BEHIND, 97, 5, 24, 16
#: A character of the context has another code than the same character of the candidate.
CODES = 2 * SYMBOLS
#: A candidate is plain if all its parts between signs are words, also joined by capitals or with a short number, or numbers.
SIGNS = re.compile(r"[+/_=.-]+")
PLAIN = re.compile(r"(?:[A-Z]?[a-z]{2,}+)++[0-9]{0,4}|[A-Z]+|[a-z]|[0-9]+")

FINDINGS = "array<struct<kind:string,start:int,end:int,label:int,windows:binary>>"
_FINDING = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("label", pa.int32()), ("windows", pa.binary())])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end) of the base matches, in code points, ordered."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _windows(text: str, start: int, end: int) -> bytes:
    """Codes of WINDOW characters for each piece: 0 beyond the text, 1 for a character outside ASCII, else 2 and up; SYMBOLS more
    for what surrounds the candidate. The last piece of several ends with the candidate; equal pieces are one."""
    out = {}
    for at in range(start, end, PIECE):
        at = max(start, min(at, end - PIECE))
        left, right = max(0, at - BEFORE), min(len(text), at + PIECE + BEHIND)
        codes = np.frombuffer(text[left:right].encode("ascii", "replace"), np.uint8).astype(np.int16) - 30
        codes[(codes < 2) | (codes >= SYMBOLS)] = 1
        codes[:max(0, start - left)] += SYMBOLS
        codes[end - left:] += SYMBOLS
        row = np.zeros(WINDOW, np.uint8)
        row[BEFORE - (at - left):BEFORE - (at - left) + len(codes)] = codes
        out[row.tobytes()] = None
    return b"".join(out)


def value_start(text: str, start: int, kind: int) -> int:
    """Where the value of a base match begins: behind keyword and separator, or behind the prefix."""
    return ASSIGN.match(text, start).start(2) if kind == 0 else start + 4 if kind == 1 else start


def plain_label(run: str) -> int | None:
    """0 for plain words, -1 for plain candidates with digits, none for others."""
    if all(PLAIN.fullmatch(part) for part in SIGNS.split(run) if part):
        return -1 if any(c.isdigit() for c in run) else 0
    return None


def other_candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """All runs of key characters outside the base matches; what a match leaves of a run is one if it is long enough."""
    others, i = [], 0
    for m in RUN.finditer(text):
        at = m.start()
        while i < len(spans) and spans[i][2] <= at:
            i += 1
        for a, _, b in spans[i:] if i < len(spans) and spans[i][0] < m.end() else ():
            if a >= m.end():
                break
            if a - at >= RUN_CHARS:
                others.append((at, a))
            at = max(at, b)
        if m.end() - at >= RUN_CHARS:
            others.append((at, m.end()))
    return others


def findings(text: str) -> list[dict]:
    """Base matches and other candidates of a text with their windows, by start and kind; label 1 for base matches, see plain_label for the others."""
    spans = base_spans(text)
    found = [(a, k, b, 1, value_start(text, a, k)) for a, k, b in spans]
    found += [(a, 3, b, plain_label(text[a:b]), a) for a, b in other_candidates(text, spans)]
    return [{"kind": KINDS[k], "start": a, "end": b, "label": label, "windows": _windows(text, at, b)} for a, k, b, label, at in sorted(found, key=lambda f: f[:3])]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and findings for every row; candidates that are no base match have the kind `model` and are not yet decided."""
    key_type = docs.schema[key].dataType.simpleString()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([findings(t) for t in texts], pa.list_(_FINDING))], ["key", "findings"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(
        step, f"key {key_type}, findings {FINDINGS}").withColumnRenamed("key", key)


#: What a network learns.
TRAINED = ("filters", "bias", "hidden", "hidden_bias", "out", "out_bias")


@dataclass
class Network:
    filters: np.ndarray  # WIDTH x CODES x FILTERS
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 2.0  # nothing reaches it

    @classmethod
    def fresh(cls, seed: int = 7) -> Network:
        g = np.random.default_rng(seed)
        return cls(g.normal(0, 0.3, (WIDTH, CODES, FILTERS)), np.zeros(FILTERS), g.normal(0, FILTERS ** -0.5, (FILTERS, HIDDEN)),
                   np.zeros(HIDDEN), g.normal(0, HIDDEN ** -0.5, HIDDEN), 0.0)

    def _forward(self, codes: np.ndarray):
        filters, codes = self.filters.astype(np.float32), codes.astype(np.intp)
        steps = codes.shape[1] - WIDTH + 1
        maps = filters[0].take(codes[:, :steps], axis=0)
        for k in range(1, WIDTH):
            maps += filters[k].take(codes[:, k:k + steps], axis=0)
        at = maps.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(maps, at[:, None, :], 1)[:, 0] + self.bias, 0)
        inner = np.maximum(pooled @ self.hidden + self.hidden_bias, 0)
        return at, pooled, inner, inner @ self.out + self.out_bias

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i:i + 256])[3] for i in range(0, len(codes), 256)]) if len(codes) else np.zeros(0)

    def probabilities(self, found: list[bytes]) -> np.ndarray:
        """Calibrated probability of each finding: that of its most suspicious piece. Equal pieces are scored once."""
        if not found:
            return np.zeros(0)
        pieces = np.frombuffer(b"".join(found), np.dtype((np.void, WINDOW)))
        different, place = np.unique(pieces, return_inverse=True)
        logits = self.logits(different.view(np.uint8).reshape(-1, WINDOW))[place]
        first = np.cumsum([0] + [len(w) // WINDOW for w in found[:-1]])
        return 1 / (1 + np.exp(-np.clip(self.slope * np.maximum.reduceat(logits, first) + self.shift, -500, 500)))

    def probability(self, windows: bytes) -> float:
        return float(self.probabilities([windows])[0])

    def flat(self) -> np.ndarray:
        """All that train() changes, as one vector."""
        return np.concatenate([np.ravel(getattr(self, n)) for n in TRAINED])

    def with_flat(self, values: np.ndarray) -> Network:
        """A network with these trained values."""
        parts, at = {}, 0
        for n in TRAINED:
            size = np.size(getattr(self, n))
            parts[n] = values[at:at + size].reshape(np.shape(getattr(self, n))) if np.ndim(getattr(self, n)) else float(values[at])
            at += size
        return replace(self, **parts)

    def train(self, codes: np.ndarray, labels: np.ndarray, kinds: np.ndarray | None = None, passes: int = 8, rate: float = 0.004, seed: int = 7,
              weights: dict[int, float] | None = None) -> None:
        """weights: of a row of each kind; by default those of class_weights() of these rows."""
        first = {n: np.zeros_like(getattr(self, n), float) for n in TRAINED}
        second = {n: np.zeros_like(getattr(self, n), float) for n in TRAINED}
        kinds = labels if kinds is None else kinds
        own, place, counts = np.unique(kinds, return_inverse=True, return_counts=True)
        weights = weights or class_weights(dict(zip(own.tolist(), counts.tolist())))
        weight = np.array([weights[k] for k in own.tolist()])[place]
        g, t, every = np.random.default_rng(seed), 0, np.arange(FILTERS)
        for _ in range(passes):
            share = np.zeros(len(codes))  # every kind is spread evenly over a pass
            for i, n in enumerate(counts):
                share[place == i] = (g.permutation(n) + g.random(n)) / n
            order = np.argsort(share, kind="stable")
            for i in range(0, len(order), 64):
                pick = order[i:i + 64]
                x = codes[pick]
                at, pooled, inner, logit = self._forward(x)
                d = (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - labels[pick]) * weight[pick] / len(pick)
                d_inner = np.outer(d, self.out) * (inner > 0)
                d_pooled = (d_inner @ self.hidden.T) * (pooled > 0)
                grads = {"out": inner.T @ d, "out_bias": d.sum(), "hidden": pooled.T @ d_inner, "hidden_bias": d_inner.sum(axis=0),
                         "bias": d_pooled.sum(axis=0)}
                near = x[np.arange(len(pick))[:, None], at + np.arange(WIDTH)[:, None, None]] + CODES * np.arange(WIDTH)[:, None, None]
                grads["filters"] = np.bincount((near * FILTERS + every).ravel(), np.tile(d_pooled.ravel(), WIDTH), self.filters.size).reshape(self.filters.shape)
                t += 1
                for n in TRAINED:
                    first[n] = 0.9 * first[n] + 0.1 * grads[n]
                    second[n] = 0.999 * second[n] + 0.001 * grads[n] ** 2
                    setattr(self, n, getattr(self, n) - rate * (first[n] / (1 - 0.9 ** t)) / (np.sqrt(second[n] / (1 - 0.999 ** t)) + 1e-8))

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, recall: float, counts: np.ndarray | None = None) -> None:
        """Platt scaling by damped Newton steps with smoothed targets; then the highest threshold with that recall of the positives. counts: how often each
        logit and label was found, once by default."""
        counts = np.ones(len(labels)) if counts is None else counts
        up, down = counts[labels == 1].sum(), counts[labels != 1].sum()
        target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
        x, w = np.column_stack([logits, np.ones(len(logits))]), np.array([1.0, 0.0])
        def loss(w: np.ndarray) -> float:
            z = x @ w
            return float((counts * (np.logaddexp(0, z) - target * z)).sum() + 5e-4 * ((w - [1.0, 0.0]) ** 2).sum())

        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
            step = np.linalg.solve((x * (counts * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (counts * (p - target)) + 1e-3 * (w - [1.0, 0.0]))
            part = 1.0  # a whole step may overshoot where the classes are nearly apart
            while part > 1e-6 and loss(w - part * step) > loss(w):
                part /= 2
            if part <= 1e-6:
                break
            w = w - part * step
        self.slope, self.shift = float(w[0]), float(w[1])
        p, n = 1 / (1 + np.exp(-np.clip(x[labels == 1] @ w, -500, 500))), counts[labels == 1]
        order = np.argsort(p)
        self.threshold = float(p[order][np.searchsorted(np.cumsum(n[order]), np.floor((1 - recall) * up), side="right")])


def class_weights(counts: dict[int, int]) -> dict[int, float]:
    """Weight of a row of each kind: all kinds of a label (1, or 0 and below) weigh the same together, as do the labels."""
    own = {label: [k for k in counts if max(k, 0) == label] for label in (0, 1)}
    return {k: sum(counts.values()) / (2 * len(own[max(k, 0)]) * n) for k, n in counts.items()}


#: Forms of each piece that variant() makes.
VARIANTS = 6
_LETTERS = {kind: np.array([ord(c) - 30 for c in chars]) for kind, chars in (("low", string.ascii_lowercase), ("up", string.ascii_uppercase), ("no", string.digits))}


def variant(codes: np.ndarray, labels: np.ndarray, turn: int, g: np.random.Generator) -> np.ndarray:
    """Each piece in one of its forms, the next one every turn: in its own characters or in others (letters and digits of a secret renamed one to one at random,
    as keys of other alphabets look, a plain piece in capitals and with other digits), and with its own surroundings, with none, or with those of another piece,
    whatever the label of that."""
    form = (np.arange(len(codes)) + turn) % VARIANTS
    every, capitals = np.concatenate(list(_LETTERS.values())), np.arange(CODES, dtype=np.uint8)
    capitals[_LETTERS["low"]] = _LETTERS["up"]
    out = codes.copy()
    for label, start, renamed in ((1, np.arange(CODES, dtype=np.uint8), every), (0, capitals, _LETTERS["no"])):
        rows = np.flatnonzero((labels == label) & (form % 2 == 1))
        names = np.tile(start, (len(rows), 1))
        names[:, renamed] = g.permuted(np.tile(renamed, (len(rows), 1)), axis=1)
        old = codes[rows]
        out[rows] = np.where((old > 0) & (old < SYMBOLS), np.take_along_axis(names, old.astype(np.int64), 1), old)
    own, other = (codes > 0) & (codes < SYMBOLS), codes[g.permutation(len(codes))]
    around = np.where(other > SYMBOLS, other, 0)
    around[form // 2 == 1] = 0
    return np.where(own | (form // 2 == 0)[:, None], out, around)


#: Different pieces of a shard, some. One shard alone is learned in one go, and so often that LEARNED forms are seen, but not more than MAX_PASSES times.
SHARD_PIECES, LEARNED, MAX_PASSES = 1 << 16, 400_000, 8
#: Trained values are averaged as whole numbers of these, so that the mean does not depend on the order of the copies; logits are counted in such steps.
FLAT_STEPS, LOGIT_STEPS = 1 << 30, 1 << 8


def pieces_of(scanned: DataFrame) -> DataFrame:
    """(label, piece, held): the different pieces of all labelled findings; held marks those that the network does not learn from."""
    rows = scanned.select(F.explode("findings").alias("f")).select("f.label", "f.windows").where("label is not null")
    starts = F.expr(f"sequence(1, CAST(length(windows) AS INT), {WINDOW})")
    each = rows.select("label", F.explode(F.transform(starts, lambda at: F.substring(F.col("windows"), at, F.lit(WINDOW)))).alias("piece")).distinct()
    return each.withColumn("held", F.pmod(F.xxhash64("piece"), F.lit(4)) == 0)


def _shards(batches: Iterator[pa.RecordBatch], held: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, codes and kinds of each shard of a task, the pieces in their order by bytes."""
    parts = []
    for batch in batches:
        batch = batch.filter(pa.compute.equal(batch.column(3), held))
        pieces = np.frombuffer(b"".join(batch.column(1).to_pylist()), f"S{WINDOW}")
        parts.append((batch.column(2).to_numpy(), batch.column(0).to_numpy(), pieces))
    if not parts:
        return
    shards, kinds, pieces = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((kinds, pieces, shards))
    shards, kinds, codes = shards[order], kinds[order], pieces[order].view(np.uint8).reshape(-1, WINDOW)
    for shard, at, n in zip(*np.unique(shards, return_index=True, return_counts=True)):
        yield int(shard), codes[at:at + n], kinds[at:at + n]


def averaged(dealt: DataFrame, net: Network, turns: range, passes: int, weights: dict[int, float]) -> Network:
    """The mean of the copies of a network that each learned one shard in the forms of these turns. dealt: (label, piece, shard, held)."""
    shared = dealt.sparkSession.sparkContext.broadcast(net)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, codes, kinds in _shards(batches, False):
            own, labels = shared.value.with_flat(shared.value.flat()), np.maximum(kinds, 0)
            g = np.random.default_rng([shard, turns.start])
            forms = np.concatenate([variant(codes, labels, turn, g) for turn in turns])
            own.train(forms, np.tile(labels, len(turns)), np.tile(kinds, len(turns)), passes, seed=7 + turns.start, weights=weights)
            flat = np.rint(own.flat() * FLAT_STEPS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["place", "value"])
        give_back()

    sums = dealt.mapInArrow(step, "place int, value long").groupBy("place").agg(F.sum("value").alias("value"), F.count(F.lit(1)).alias("n")).collect()
    shared.destroy()
    values = net.flat()
    for r in sums:
        values[r.place] = r.value / r.n / FLAT_STEPS
    return net.with_flat(values)


def held_logits(dealt: DataFrame, net: Network) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, rounded down to steps, and labels of all pieces held back in all their forms, and how often each was found."""
    shared = dealt.sparkSession.sparkContext.broadcast(net)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, codes, kinds in _shards(batches, True):
            labels, g = np.maximum(kinds, 0), np.random.default_rng([shard, VARIANTS])
            for turn in range(VARIANTS):
                steps = np.floor(np.clip(shared.value.logits(variant(codes, labels, turn, g)), -100, 100) * LOGIT_STEPS)
                yield pa.RecordBatch.from_arrays([pa.array(steps.astype(np.int32)), pa.array(labels.astype(np.int32))], ["step", "label"])
        give_back()

    counts = dealt.mapInArrow(step, "step int, label int").groupBy("step", "label").count().orderBy("step", "label").collect()
    shared.destroy()
    return np.array([r.step / LOGIT_STEPS for r in counts]), np.array([r.label for r in counts]), np.array([r["count"] for r in counts], float)


def fit(scanned: DataFrame, recall: float = 0.98, shard_pieces: int = SHARD_PIECES) -> Network:
    """A network trained on every labelled finding. With no base match or no plain candidate to learn from, one that adds nothing."""
    pieces = written(pieces_of(scanned))
    sizes = {(r.held, r.label): r["count"] for r in pieces.groupBy("held", "label").count().collect()}
    net, labels = Network.fresh(), {label for _, label in sizes}
    if len(labels) < 2 or 1 not in labels:
        return net
    apart = all(any(h == held and max(kind, 0) == label for h, kind in sizes) for held in (False, True) for label in (0, 1))
    learned = {k: sum(n for (held, kind), n in sizes.items() if kind == k and not (apart and held)) for k in labels}
    learned = {k: n for k, n in learned.items() if n}
    total = sum(learned.values())
    shards = -(-total // shard_pieces)
    if not apart:  # too few to hold any back: all are learned, and all calibrate
        pieces = pieces.select("label", "piece", F.explode(F.array(F.lit(False), F.lit(True))).alias("held"))
    number = F.pmod(F.xxhash64("piece", F.lit(1)), F.lit(shards)).cast("int").alias("shard")
    dealt = checkpointed(pieces.select("label", "piece", number, "held").repartition(shards, "shard"))
    weights = class_weights(learned)
    if shards == 1:
        net = averaged(dealt, net, range(VARIANTS), max(1, min(MAX_PASSES, -(-LEARNED // (VARIANTS * total)))), weights)
    else:
        for turn in range(VARIANTS):
            net = averaged(dealt, net, range(turn, turn + 1), 1, weights)
    logits, found, counts = held_logits(dealt, net)
    net.calibrate(logits, found, recall, counts)
    return net


def decide(scanned: DataFrame, net: Network, key: str = "doc_id") -> DataFrame:
    """key and spans array<struct<kind,start,end,probability>>: the base spans, and the candidates that reach the threshold."""
    shared = scanned.sparkSession.sparkContext.broadcast(net)
    key_type = scanned.schema[key].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches):
            lists = []
            rows = batch.column(1).to_pylist()
            scores = iter(own.probabilities([f["windows"] for found in rows for f in found]))
            for found in rows:
                scored = [{**f, "probability": float(next(scores))} for f in found]
                lists.append([f for f in scored if f["kind"] != "model" or f["probability"] >= own.threshold])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lists, pa.list_(span))], ["key", "spans"])

    return scanned.select(F.col(key).alias("key"), "findings").mapInArrow(
        step, f"key {key_type}, spans array<struct<kind:string,start:int,end:int,probability:double>>").withColumnRenamed("key", key)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans for every row, by start and kind.

    A null text counts as empty and has no spans. Repeated rows stay repeated. Columns other than key and text are not read.
    """
    scanned = checkpointed(scan(docs, key, text))
    return decide(scanned, fit(scanned), key)


def _redact(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    out, at = [], 0
    for a, b in sorted(spans):
        if b > at:
            out.append(text[at:a] if a > at else "")
            if a >= at or not out:
                out.append(mask)
            at = b
    return "".join(out) + text[at:]


def redact(docs: DataFrame, net: Network, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows with every span in their text replaced by the mask, spans that overlap as one; all other columns and null texts as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches):
            place, new = part.schema.get_field_index(text), []
            for t in part.column(place).to_pylist():
                found = findings(t or "")
                spans = [(f["start"], f["end"]) for f, score in zip(found, own.probabilities([f["windows"] for f in found]))
                         if f["kind"] != "model" or score >= own.threshold]
                new.append(_redact(t, spans, mask) if spans else t)
            yield part.set_column(place, part.schema.field(place), pa.array(new, part.schema.field(place).type))

    return docs.mapInArrow(step, docs.schema)


def digest_table(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts, joined spans and the digest of the base spans of what find_secrets returns."""
    def joined(which):
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    count = [number(kind) for kind in KINDS]
    return spans.select(key, *count[:3], F.sha2(joined(F.filter("spans", lambda s: s.kind != "model")).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"), count[3])
