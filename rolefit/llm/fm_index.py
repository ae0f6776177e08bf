"""A compressed full-text index over sequences of words: the transform of Burrows and Wheeler in a Huffman-shaped wavelet tree, searched backward.

All searches of an index run side by side in numpy arrays.
"""

from __future__ import annotations

import heapq

import numpy as np


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, bits of the code) of each symbol; a single symbol has one bit."""
    heap = [(int(n), c) for c, n in enumerate(counts)]
    heapq.heapify(heap)
    kids: list[tuple[int, int]] = []  # of the inner nodes, which are numbered behind the symbols
    while len(heap) > 1:
        a, x = heapq.heappop(heap)
        b, y = heap[0]
        heapq.heapreplace(heap, (a + b, len(counts) + len(kids)))
        kids.append((x, y))
    total = len(counts) + len(kids)
    code, bits = [0] * total, [0] * total
    for at in range(len(kids) - 1, -1, -1):
        inner = len(counts) + at
        for bit, child in enumerate(kids[at]):
            code[child], bits[child] = code[inner] << 1 | bit, bits[inner] + 1
    if len(counts) == 1:
        bits[0] = 1
    return np.array(code[:len(counts)], np.int64), np.array(bits[:len(counts)], np.int64)


class BitRow:
    """Bits in words of 64 with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]].astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        below = self.words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word].astype(np.int64) + np.bitwise_count(below)


class WaveletTree:
    """rank(c, i): how often c is among the first i symbols of a sequence."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        code, bits = huffman(np.bincount(symbols, minlength=alphabet))
        self.depth = int(bits.max())
        left = code << (self.depth - bits)  # codes as the front bits of numbers of one width
        self.bits, self.rows = bits, []
        now = symbols
        for level in range(self.depth):
            # the symbols whose codes go on here, node by node, each node in the order of the sequence
            now = now[bits[now] > level]
            node = left[now] >> (self.depth - level)
            now = now[np.argsort(node, kind="stable")]
            row = BitRow((left[now] >> (self.depth - 1 - level)) & 1 == 1)
            begin = np.searchsorted(left[now] >> (self.depth - level), left >> (self.depth - level))
            begin = np.minimum(begin, len(now))
            turn = (left >> (self.depth - 1 - level)) & 1 == 1
            self.rows.append((row, begin, row.ones(begin), turn))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        out = i.astype(np.int64)
        live = np.arange(len(c))
        for level, (row, begin, before, turn) in enumerate(self.rows):
            if level:
                live = live[self.bits[c[live]] > level]
                if not len(live):
                    break
            own, at = c[live], out[live]
            ones = row.ones(begin[own] + at) - before[own]
            out[live] = np.where(turn[own], ones, at - ones)
        return out


def sorted_suffixes(text: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes in the order of their first reach symbols (rounded up to a power of two), and what each shares with the one before at most so far."""
    n = len(text)
    ranks = [text.astype(np.int64)]
    span = 1
    while span < reach:
        now = ranks[-1]
        behind = np.zeros(n, np.int64)
        behind[:max(n - span, 0)] = now[span:] + 1
        both = now * (int(now.max(initial=0)) + 2) + behind
        ranks.append(np.unique(both, return_inverse=True)[1])
        span *= 2
    order = np.argsort(ranks[-1], kind="stable")
    shared = np.zeros(n + 1, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        rank, step = ranks[level], 1 << level
        inside = (a < n) & (b < n)
        same = np.zeros(len(a), bool)
        same[inside] = rank[a[inside]] == rank[b[inside]]
        shared[1:n][same] += step
        a[same] += step
        b[same] += step
    shared[0] = shared[n] = -1
    return order, shared


class FmIndex:
    """Of several texts (sequences of numbers from 1 on) that count several times each. A 0 behind every text keeps matches inside of texts.

    reach is more than the length of any text: the suffixes need no order beyond it.
    """

    def __init__(self, texts: list[np.ndarray], weights: np.ndarray, reach: int):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.starts = np.cumsum(sizes) - sizes
        self.text = np.zeros(int(sizes.sum()), np.int64)
        for at, t in zip(self.starts.tolist(), texts):
            self.text[at:at + len(t)] = t
        order, self.shared = sorted_suffixes(self.text, reach)
        alphabet = int(self.text.max(initial=0)) + 1
        self.tree = WaveletTree(self.text[order - 1], alphabet)  # the symbol before the first place is the last one
        self.first = np.r_[0, np.cumsum(np.bincount(self.text, minlength=alphabet))]
        self.weight = np.r_[0, np.cumsum(np.repeat(weights, sizes)[order])]
        self.size = len(self.text)
        self.least = [self.shared.astype(np.int16)]  # minima over powers of two
        while 2 << (len(self.least) - 1) <= len(self.shared):
            low, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(low[:-half], low[half:]))

    def _widened(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of all suffixes that share depth symbols with those of [low, high)."""
        low, high = low.copy(), high.copy()
        for k in range(len(self.least) - 1, -1, -1):
            step, row = 1 << k, self.least[k]
            at = low - step + 1
            go = at >= 0
            go[go] = row[at[go]] >= depth[go]
            low[go] -= step
            go = high + step <= len(self.shared)
            go[go] = row[high[go]] >= depth[go]
            high[go] += step
        return low, high

    def statistics(self, chosen: np.ndarray, least: int) -> np.ndarray:
        """Matching statistics of the chosen texts, which are streamed from their ends: for every place of the whole sequence the length of the longest piece from
        there on, inside its text, that occurs at least so often; 0 for texts that are not chosen."""
        out = np.zeros(self.size, np.int64)
        ends = np.r_[self.starts[1:], self.size] - 1
        begin, at = self.starts[chosen], ends[chosen] - 1
        low, high, depth = np.zeros(len(at), np.int64), np.full(len(at), self.size), np.zeros(len(at), np.int64)
        while True:
            live = at >= begin
            if not live.all():
                begin, at, low, high, depth = (x[live] for x in (begin, at, low, high, depth))
            if not len(at):
                return out
            c = self.text[at]
            both = self.tree.rank(np.r_[c, c], np.r_[low, high])
            new_low, new_high = self.first[c] + both[:len(c)], self.first[c] + both[len(c):]
            found = self.weight[new_high] - self.weight[new_low] >= least
            low, high = np.where(found, new_low, low), np.where(found, new_high, high)
            depth += found
            out[at[found]] = depth[found]
            at = at - (found | (depth == 0))
            short = ~found & (depth > 0)  # drop symbols from the right until the interval grows
            if short.any():
                a, b = low[short], high[short]
                less = np.maximum(np.maximum(self.shared[a], self.shared[b]), 0)
                a, b = self._widened(a, b, less)
                whole = less == 0
                low[short], high[short], depth[short] = np.where(whole, 0, a), np.where(whole, self.size, b), less
