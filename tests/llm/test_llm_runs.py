import hashlib
import random
import zlib

import numpy as np
import pytest
from cases import LONG, empty_documents, odd_documents

from rolefit.llm import periodic_runs


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def repetitions(words, periods):
    """(start, length, period) of the maximal stretches in which words a period apart are equal."""
    out = []
    for q in periods:
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i:
                out.append((i, j - i + q, q))
            i = j + 1
    return out


def brute_runs(words):
    every = repetitions(words, range(1, len(words) // 3 + 1))
    return sorted((s, n, q) for s, n, q in every if n >= max(24, 3 * q)
                  and not any(p < q and a <= s and a + m >= s + n for a, m, p in every))


def brute_row(key, text):
    """The result columns by the rule, planted period included."""
    words = (text or "").encode().split()
    words = [w.decode() for w in words]
    n = len(words)
    if key is not None and n and (h := zlib.crc32(str(key).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    best = sorted(found, key=lambda r: (-r[1] / r[2], r[0], r[2]))[:1]
    start, length, period = best[0] if best else (None, None, None)
    return (key, len(found), start, length, period, 1000 * length // period if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def periodic_words(g, n, letters):
    words = [str(g.randrange(letters)) for _ in range(n)]
    for _ in range(g.randrange(5)):
        start, period = g.randrange(n), g.randrange(1, 20)
        for i in range(start + period, min(n, start + period * g.randrange(2, 9) + g.randrange(period))):
            words[i] = words[i - period]
    return words


def test_runs_equal_brute_force():
    g = random.Random(1)
    for k in range(400):
        words = periodic_words(g, g.randrange(1, 150), g.choice([1, 2, 3, 5, 50]))
        assert [tuple(r) for r in periodic_runs.runs(words)] == brute_runs(words), words


def test_trees_without_the_choice_of_stretches_find_the_same(monkeypatch):
    g = random.Random(2)
    cases = [periodic_words(g, 120, 3) for _ in range(60)]
    before = [periodic_runs.runs(w) for w in cases]
    monkeypatch.setattr(periodic_runs, "stretches", lambda ids: [(0, len(ids))])
    assert [periodic_runs.runs(w) for w in cases] == before


def test_extensions_and_ranks_of_a_tree():
    g = random.Random(3)
    for _ in range(40):
        s = [g.randrange(1, 4) for _ in range(g.randrange(2, 60))]
        tree = periodic_runs.SuffixTree(np.array(s))
        places = [(a, b) for a in range(len(s)) for b in range(len(s)) if a != b]

        def shared(a, b):
            n = 0
            while max(a, b) + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            return n

        got = tree.extension(np.array([a for a, _ in places]), np.array([b for _, b in places]))
        assert got.tolist() == [shared(a, b) for a, b in places]
        assert sorted(range(len(s)), key=lambda i: s[i:]) == sorted(range(len(s)), key=lambda i: tree.rank[i])


def test_shortest_and_just_too_short_runs():
    line = [f"w{i}" for i in range(8)]
    assert periodic_runs.runs(line * 3) == [(0, 24, 8)]
    assert periodic_runs.runs((line * 3)[:-1]) == []
    assert periodic_runs.runs(["a"] * 23) == [] and periodic_runs.runs(["a"] * 24) == [(0, 24, 1)]
    assert periodic_runs.runs([f"w{i}" for i in range(9)] * 3 + ["w0"]) == [(0, 28, 9)]


def test_long_repetitive_texts_take_linear_time():
    words = ["x"] * 30_000 + [f"u{i}" for i in range(100)] + [f"v{i}" for i in range(7_000)] * 4
    assert periodic_runs.runs(words) == [(0, 30_000, 1), (30_100, 28_000, 7_000)]


def test_ties_go_to_the_first_run_and_words_of_any_run_go():
    words = [f"a{i}" for i in range(8)] * 4 + [f"b{i}" for i in range(9)] * 4
    found = periodic_runs.runs(words)
    assert found == [(0, 32, 8), (32, 36, 9)] and periodic_runs.strongest(found) == (0, 32, 8)
    assert periodic_runs.strongest([]) is None
    assert [w.decode() for w in periodic_runs.collapsed([w.encode() for w in words], found)] == words[:8] + words[32:41]


def test_table(spark):
    g = random.Random(4)
    docs = odd_documents(spark)
    more = [(k, " ".join(periodic_words(g, g.randrange(1, 200), 40))) for k in range(100, 160)]
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text != LONG] + more
    table = docs.where(docs.doc_id.isNull() | (docs.doc_id != 5)).select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = periodic_runs.digest_table(periodic_runs.find_runs(periodic_runs.planted(table)))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((brute_row(*r) for r in rows), key=str)
    assert sum(r.n_runs for r in got.collect()) > 0
    assert periodic_runs.find_runs(empty_documents(spark)).count() == 0
    long = periodic_runs.find_runs(docs.where("doc_id = 5")).first()
    assert long.runs == [] and long.strongest is None and long.n_words == len(LONG.split())


@pytest.mark.parametrize("text", ["", "   ", "one"])
def test_texts_without_runs(text):
    assert periodic_runs.runs(text.encode().split()) == []
