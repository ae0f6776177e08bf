import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from cases import LONG, empty_documents, odd_documents

from rolefit.llm import fm_index, fm_substrings

SCHEMA = "doc_id long, text string"


def brute(rows):
    """(key, words, removed, digest of what is kept) of (key, text) rows by the rule."""
    words = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i:i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for (key, _), w in zip(rows, words):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i:i + 35])] > 1 for j in range(i, i + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, fm_substrings.digest_table(fm_substrings.remove_substrings(table)).collect()), key=str)


def corpus(seed=5):
    """Texts with passages in common, whole copies, near copies, a line that most share, texts that repeat themselves and 34 words in common."""
    g = random.Random(seed)
    prose = lambda n: [f"w{g.randrange(400)}" for _ in range(n)]
    passages = [prose(g.randrange(30, 60)) for _ in range(6)]
    line = prose(40)
    texts = []
    for k in range(90):
        w = prose(g.randrange(0, 160))
        if k % 3 == 0:
            at = g.randrange(len(w) + 1)
            w[at:at] = g.choice(passages)
        if k % 2:
            at = g.randrange(len(w) + 1)
            w[at:at] = line
        if k % 10 == 7 and texts:
            w = list(g.choice(texts))
            if len(w) > 50:
                w[g.randrange(len(w))] = "changed"
        if k % 15 == 4 and texts:
            w = list(texts[-1])
        if k % 20 == 11:
            w = w + w[-50:]
        texts.append(w)
    texts += [["same"] * 34, ["same"] * 34, ["one"] * 36, passages[0][:34] + ["x"]]
    return [(k, " ".join(w)) for k, w in enumerate(texts)]


def test_equal_to_brute_force(spark):
    rows = corpus()
    want = brute(rows)
    assert sum(r[2] for r in want) > 1000
    assert got(spark, rows) == want


@pytest.mark.parametrize("frequent", ["none", "all"])
def test_the_sample_steers_the_work_only(spark, monkeypatch, frequent):
    rows = corpus(6)
    every = np.unique(np.concatenate([fm_substrings.stretches(fm_substrings.WordHashes().of(t.encode().split()))[0] for _, t in rows]))
    monkeypatch.setattr(fm_substrings, "frequent_anchors", lambda docs: every if frequent == "all" else np.zeros(0, np.uint64))
    assert got(spark, rows) == brute(rows)


def test_large_groups_small_shards_and_shuffled_joins_give_the_same(spark, monkeypatch):
    rows = corpus(7)
    monkeypatch.setattr(fm_substrings, "frequent_anchors", lambda docs: np.zeros(0, np.uint64))
    monkeypatch.setattr(fm_substrings, "GROUP", 3)
    monkeypatch.setattr(fm_substrings, "SHARD_WORDS", 100)
    monkeypatch.setattr(fm_substrings, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(fm_substrings, "SETTLED", 20)
    assert got(spark, rows) == brute(rows)


def test_contents_that_span_batches_are_counted_once(spark):
    rows = corpus(8)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert got(spark, rows) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(20, "x " * 40), (20, "x " * 40), (None, "y " * 36), (21, "a\x0bb\x0cc\x1cd " * 20)]
    assert got(spark, rows) == brute(rows)
    removed = fm_substrings.remove_substrings(docs)
    assert removed.columns == ["doc_id", "n_words", "n_removed", "spans", "kept"]
    assert fm_substrings.remove_substrings(empty_documents(spark)).count() == 0
    strings = spark.createDataFrame([("a", LONG), ("b", LONG[-400:])], "name string, body string")
    found = {r.name: r for r in fm_substrings.remove_substrings(strings, "name", "body").collect()}
    assert found["b"].n_words - found["b"].n_removed <= 1 and found["a"].spans[-1].end == len(LONG.split())


def test_wavelet_tree_counts_as_a_scan_does():
    g = np.random.default_rng(3)
    for alphabet in (1, 2, 3, 17, 400):
        symbols = np.minimum(g.geometric(0.1, 500), alphabet) - 1
        tree = fm_index.WaveletTree(symbols, alphabet)
        c, i = symbols[g.integers(0, 500, 200)], g.integers(0, 501, 200)
        assert tree.rank(c, i).tolist() == [int((symbols[:b] == a).sum()) for a, b in zip(c, i)]


def test_matching_statistics_equal_a_count_of_all_pieces():
    g = random.Random(9)
    for _ in range(60):
        letters = g.choice([1, 2, 4, 30])
        texts = [[g.randrange(1, letters + 1) for _ in range(g.randrange(1, 25))] for _ in range(g.randrange(1, 10))]
        weights = np.array([g.choice([1, 1, 2]) for _ in texts])
        index = fm_index.FmIndex([np.array(t) for t in texts], weights, 32)
        seen = Counter()
        for t, w in zip(texts, weights.tolist()):
            for a in range(len(t)):
                for b in range(a + 1, len(t) + 1):
                    seen[tuple(t[a:b])] += w
        found = index.statistics(np.arange(len(texts)), 2)
        for t, start in zip(texts, index.starts.tolist()):
            for a in range(len(t)):
                n = 0
                while a + n < len(t) and seen[tuple(t[a:a + n + 1])] > 1:
                    n += 1
                assert found[start + a] == n
