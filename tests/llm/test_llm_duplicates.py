"""Leaks, near duplicates and repeats against brute force."""

import hashlib
import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from cases import LONG, empty_documents, odd_documents
from pyspark.sql import functions as F

from rolefit.llm import components, jaccard_join, queries, repeats, shingles, spaced_seeds

SMALL = "/root/testdata/sf0.01"
SMALLEST = "/root/testdata/sf0.001"


# --- spaced seeds ----------------------------------------------------------------------------------------------------
def passage(g, n):
    return [f"w{g.randrange(10 ** 6)}" for _ in range(n)]


def test_leaks_equal_the_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = sorted(con.sql(queries.ORACLES["op1_spaced_seeds"]).fetchall())
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    assert want and sorted(map(tuple, spaced_seeds.find_leaks(docs, items).collect())) == want
    assert sorted(map(tuple, spaced_seeds.find_leaks(docs, items, broadcast_seeds=1_500).collect())) == want


def test_leaks_survive_substitutions(spark):
    g = random.Random(4)
    item = passage(g, 40)
    clean, whole, edited, part, other_case = passage(g, 200), passage(g, 50) + item + passage(g, 9), list(item), passage(g, 30) + item[5:22] + passage(g, 30), [w.upper() + "," for w in item]
    for place in range(4, 40, 9):
        edited[place] = "changed"
    texts = {1: clean, 2: whole, 3: edited, 4: part, 5: other_case, 6: item[:9] + clean, 7: ["so", "too", "short"]}
    docs = spark.createDataFrame([(k, " ".join(v), k) for k, v in texts.items()], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, " ".join(item), 1), (8, " ".join(passage(g, 30)), 1), (9, "too short", 1), (10, None, 1)], "item_id long, text string, doc_id int")
    got = {(r.doc_id, r.item_id): r.n_equal for r in spaced_seeds.find_leaks(docs, items).collect()}
    assert got == {(2, 7): 15, (3, 7): 14, (4, 7): 15, (5, 7): 15, (7, 9): 2}


@pytest.mark.parametrize("n", range(1, spaced_seeds.WINDOW + 1))
def test_every_pattern_of_substitutions_that_the_rule_accepts_has_a_seed(n):
    masks = next(masks for low, high, masks in spaced_seeds.FAMILIES if low <= n <= (high or n))
    for gone in itertools.combinations(range(n), n - math.ceil(n * spaced_seeds.SHARE / 10)):
        assert any(all(at + k not in gone for k in mask) for mask in masks for at in range(n - mask[-1]))


def brute_leaks(docs, items):
    """Every diagonal of every document and item by the rule alone, with the equal tokens of the best window."""
    out = {}
    for d, w in docs.items():
        for k, v in items.items():
            window = min(spaced_seeds.WINDOW, len(v))
            for shift in range(1 - len(v), len(w)):
                same = [0 <= j + shift < len(w) and w[j + shift] == v[j] for j in range(len(v))]
                best = max(sum(same[s:s + window]) for s in range(len(v) - window + 1))
                if 10 * best >= spaced_seeds.SHARE * window:
                    out[d, k] = max(best, out.get((d, k), 0))
    return out


@pytest.mark.parametrize("n,changed", [(5, 1), (10, 2), (14, 2), (15, 3)])
def test_every_accepted_pattern_is_found(spark, n, changed):
    words = [f"w{i}" for i in range(n - 2)] + ["the"] * 2
    texts = [" ".join("x" if i in gone else w for i, w in enumerate(words)) for gone in itertools.combinations(range(n), changed)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, "the " * 3 + " ".join(f"v{i}" for i in range(20)))], "item_id long, text string")
    got = {r.doc_id: r.n_equal for r in spaced_seeds.find_leaks(docs, items).where("item_id = 1").collect()}
    assert got == dict.fromkeys(range(len(texts)), n - changed)


@pytest.mark.parametrize("broadcast_seeds", [spaced_seeds.BROADCAST_SEEDS, 100])
def test_leaks_are_those_of_the_rule_without_masks(spark, broadcast_seeds):
    g = random.Random(8)
    items = {k: [g.choice(("the", "of", f"a{g.randrange(40)}", f"w{g.randrange(9_000)}")) for _ in range(n)] for k, n in enumerate((3, 7, 11, 12, 14, 20, 38, 80, 130))}
    items[9] = ["a"] * 40
    docs, k = {}, 0
    for v in items.values():
        for share in (0.6, 0.7, 0.75, 0.8, 0.8, 0.85, 0.9, 1.0):
            for part in (v, v[:59], v[-59:], v[len(v) // 3:][:21]):
                docs[k] = [f"z{g.randrange(99)}"] * g.randrange(4) + [w if g.random() < share else f"y{g.randrange(99)}" for w in part]
                k += 1
    docs[k] = ["other" if i % 5 == 0 else w for i, w in enumerate(items[7])]
    rows = [spark.createDataFrame([(i, " ".join(w)) for i, w in x.items()], f"{c} long, text string") for c, x in (("doc_id", docs), ("item_id", items))]
    want = brute_leaks(docs, items)
    assert (k, 7) in want and len(want) > 50
    assert {(r.doc_id, r.item_id): r.n_equal for r in spaced_seeds.find_leaks(*rows, broadcast_seeds=broadcast_seeds).collect()} == want


def test_leaks_in_scripts_without_blanks(spark):
    docs = spark.createDataFrame([(1, "前文。問題は東京の人口はいくらですか、後文"), (2, "東京は大きい"), (3, "Résumé écrit ici")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "東京の人口はいくらですか"), (2, "résumé")], "item_id long, text string")
    assert sorted(map(tuple, spaced_seeds.find_leaks(docs, items).collect())) == [(1, 1, 12, 12), (3, 2, 1, 1)]


def test_leaks_of_odd_rows(spark):
    docs = odd_documents(spark)
    items = docs.select(F.col("doc_id").alias("item_id"), "text", "score", "doc_id")
    got = [sorted(((r.doc_id or 0, r.item_id or 0, r.n_equal, r.item_tokens) for r in spaced_seeds.find_leaks(docs, items, broadcast_seeds=n).collect()))
           for n in (spaced_seeds.BROADCAST_SEEDS, 20_000)]
    fox = [(a, b, 13, 13) for a in (1, 4) for b in (1, 4)]
    assert got[0] == got[1] == sorted([(0, 0, 4, 4), *fox, (5, 5, 15, 60_000), (7, 7, 5, 5), (9, 9, 3, 3)])
    assert spaced_seeds.find_leaks(empty_documents(spark), items).count() == 0
    assert spaced_seeds.find_leaks(docs, items.limit(0)).count() == 0


# --- n-gram Jaccard join ---------------------------------------------------------------------------------------------
def brute_sets(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    for blank in (9, 10, 11, 12, 13):
        words = words.replace(bytes([blank]), b" ")
    words = [w for w in words.split(b" ") if w]
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def brute_groups(rows):
    """Every pair of documents that share a shingle, one by one."""
    sets, meet, link = {k: brute_sets(t) for k, t in rows}, {}, {k: k for k, _ in rows}

    def find(x):
        while link[x] != x:
            x = link[x]
        return x

    for k in sorted(sets):
        common = {}
        for s in sets[k]:
            for o in meet.setdefault(s, []):
                common[o] = common.get(o, 0) + 1
            meet[s].append(k)
        for o, both in common.items():
            if 100 * both >= 75 * (len(sets[k]) + len(sets[o]) - both):
                a, b = find(k), find(o)
                link[max(a, b)] = min(a, b)
    return {k: (len(sets[k]), find(k)) for k in sets}


def near_copies(seed=6):
    """A group of many near copies at all distances, groups that share passages, copies and a common line."""
    g = random.Random(seed)
    base, line = passage(g, 120), passage(g, 14)
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(g.choice((0, 1, 2, 3, 4, 6, 8))):
            words[g.randrange(len(words))] = f"x{g.randrange(10 ** 6)}"
        rows.append(words)
    rows += [line + passage(g, g.choice((3, 8, 40))) for _ in range(80)]
    for _ in range(20):
        own = passage(g, g.choice((1, 3, 4, 5, 6, 7, 30)))
        rows += [own, own, own + passage(g, 1), [w.upper() for w in own]]
    rows += [[], ["\x0b"], ["é é"], ["É"]]
    g.shuffle(rows)
    return [(i * 3 + 1, g.choice((" ", "\n", "\t ")).join(words)) for i, words in enumerate(rows)]


@pytest.mark.parametrize("sample,salts,partners,members,rows", [(1 / 32, 64, 256, 1_024, 10 ** 6), (1.0, 3, 7, 20, 0)])
def test_groups_of_near_copies(spark, monkeypatch, sample, salts, partners, members, rows):
    for name, value in (("SAMPLE", sample), ("SALTS", salts), ("PARTNERS", partners), ("MEMBERS", members), ("BROADCAST_ROWS", rows)):
        monkeypatch.setattr(jaccard_join, name, value)
    data = near_copies()
    docs = spark.createDataFrame([(k, t, 1) for k, t in data], "doc_id long, text string, id int").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.similar_groups(docs).collect()}
    assert got == brute_groups(data)


def test_groups_of_the_small_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op8_jaccard_join"](spark, SMALL).collect()}
    assert got == brute_groups(docs)


def test_the_sql_finds_the_same_groups():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    data = [*near_copies(), (9_001, None), (9_002, "")]
    con.executemany("INSERT INTO documents VALUES (?, ?)", data)
    got = {k: (n, root) for k, n, root in con.sql(queries.ORACLES["op8_jaccard_join"]).fetchall()}
    assert got == brute_groups(data)


def test_groups_of_odd_rows(spark):
    got = sorted(map(tuple, jaccard_join.similar_groups(odd_documents(spark)).collect()), key=str)
    shingled = len(brute_sets(LONG))
    assert got == sorted([(1, 9, 1), (2, 0, 2), (3, 0, 3), (4, 9, 1), (5, shingled, 5), (6, 1, 6), (7, 1, 7), (7, 1, 7), (None, 1, None), (9, 1, 9), (10, 1, 10)], key=str)
    assert jaccard_join.similar_groups(empty_documents(spark)).count() == 0
    twice = spark.createDataFrame([(5, "a b c d e f"), (5, "q r s t u v"), (3, "q r s t u v"), (8, "a b c d e f"), (1, "z")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard_join.similar_groups(twice).collect()} == {(5, 3), (3, 3), (8, 3), (1, 1)}


def test_bounds_never_rule_out_a_link():
    g = np.random.default_rng(8)
    for _ in range(400):
        n, m = g.integers(1, 400, 2)
        both = g.integers(0, min(n, m) + 1)
        values = np.unique(g.integers(0, 2 ** 63, n + m).astype(np.uint64))
        a, b = np.sort(values[:n]), np.sort(np.r_[values[:both], values[n:n + m - both]])
        linked = 4 * len(np.intersect1d(a, b)) >= 3 * len(np.union1d(a, b))
        assert jaccard_join.links(a, b) == linked
        if linked:
            assert jaccard_join.may_link(len(a), jaccard_join.parity_bitmap(a), len(b), jaccard_join.parity_bitmap(b))
            assert set(a[:jaccard_join.prefix_size(len(a))].tolist()) & set(b[:jaccard_join.prefix_size(len(b))].tolist())


def test_shingle_sets_are_those_of_the_words():
    texts = ["a b c d e f", "A  b\tC\nd e\x0bf", "a b c d e", "a b c d", "a", "", "  ", "a b c d f e", "ab c d e f", LONG]
    sets = [shingles.shingle_set(t).tolist() for t in texts]
    for i, x in enumerate(texts):
        assert len(sets[i]) == len(brute_sets(x))
        for j, y in enumerate(texts):
            assert len(set(sets[i]) & set(sets[j])) == len(brute_sets(x) & brute_sets(y))


def test_components(spark):
    g = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(g.randrange(200, 300), g.randrange(200, 300)) for _ in range(60)] + [(7, 7)]
    link = {}

    def find(x):
        while link.setdefault(x, x) != x:
            x = link[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        link[max(x, y)] = min(x, y)
    want = {x: find(x) for a, b in edges if a != b for x in (a, b)}
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.id: r.root for r in got.collect()} == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- repeats ---------------------------------------------------------------------------------------------------------
def brute_repeats(rows, size=100):
    first, out = set(), []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - size + 1):
            string = raw[at:at + size]
            if string in first:
                gone[at:at + size] = True
            else:
                first.add(string)
        edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out.append((key, len(raw), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def mosaic(seed=3):
    """Texts of few letters made of overlapping parts of few strings, of short periods, and null."""
    g = random.Random(seed)
    base = ["".join(g.choice(("ab", "cde", "f", "ghij", "né", "\x00")) for _ in range(200)) for _ in range(6)]
    rows = []
    for i in range(120):
        text = "".join(g.choice(base)[g.randrange(100):][:g.randrange(90, 400)] for _ in range(g.randrange(4)))
        rows.append((i, None if i % 13 == 0 else "xy" * g.randrange(60, 200) if i % 9 == 0 else text))
    return rows


@pytest.mark.parametrize("sample,group,settled,rows", [(1 / 32, 4_096, 10 ** 6, 10 ** 6), (1.0, 4_096, 50, 0), (0.0, 3, 10, 10 ** 6)])
def test_repeats_of_a_mosaic(spark, monkeypatch, sample, group, settled, rows):
    for name, value in (("SAMPLE", sample), ("GROUP", group), ("SETTLED", settled), ("BROADCAST_ROWS", rows)):
        monkeypatch.setattr(repeats, name, value)
    docs = spark.createDataFrame([(k, t, "x") for k, t in mosaic()], "doc_id long, text string, start string").repartition(5)
    got = sorted(map(tuple, repeats.digest_table(repeats.remove_repeats(docs)).collect()), key=str)
    assert got == brute_repeats(mosaic())


def test_repeats_of_the_small_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op7_repeats"](spark, SMALL).collect()), key=str) == brute_repeats(docs)


def test_repeats_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = sorted(map(tuple, repeats.digest_table(repeats.remove_repeats(docs)).collect()), key=str)
    assert got == brute_repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert repeats.remove_repeats(empty_documents(spark)).count() == 0
    twice = spark.createDataFrame([(1, "a" * 50 + LONG[:300]), (1, LONG[:300]), (1, LONG[:300]), (None, LONG[:150]), (0, "é" * 49 + "xy")], "doc_id long, text string")
    rows = [(r.doc_id, r.text) for r in twice.collect()]
    assert sorted(map(tuple, repeats.digest_table(repeats.remove_repeats(twice)).collect()), key=str) == brute_repeats(rows)


def test_repeat_groups_have_all_occurrences():
    g = random.Random(5)
    common, inner = "".join(g.choice("abcdefgh") for _ in range(130)), "".join(g.choice("abcdefgh") for _ in range(104))
    texts = [("x" + common + "y").encode(), (common[5:] + "q").encode(), ("z" + common).encode(), (inner + "r").encode(), ("s" + inner).encode()]
    text, offset, shared, symbol = repeats.suffix_order(texts)
    whole = [texts[t][o:] for t, o in zip(text, offset)]
    assert whole == sorted(whole) and all(len(w) >= repeats.LENGTH for w in whole)
    found = set()
    for length, first, last in repeats.maximal_repeats(shared, symbol):
        places = [(int(t), int(o)) for t, o in zip(text[first:last + 1], offset[first:last + 1])]
        assert len({texts[t][o:o + length] for t, o in places}) == 1
        found.add((length, tuple(sorted(places))))
    assert found == {(130, ((0, 1), (2, 1))), (125, ((0, 6), (1, 0), (2, 6))), (104, ((3, 0), (4, 1)))}


def test_zero_bytes_at_the_end_keep_their_order():
    """One suffix ends where others go on with zero bytes."""
    body = bytes(range(1, 121))
    texts = [body + b"\0" * k for k in (1, 0, 2, 1, 0, 2)]
    text, offset, shared, symbol = repeats.suffix_order(texts)
    whole = [texts[t][o:] for t, o in zip(text, offset)]
    assert whole == sorted(whole)
    assert shared.tolist()[1:] == [next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(whole, whole[1:])]
