import hashlib

import numpy as np
import pytest
from cases import empty_documents, odd_documents
from pyspark.sql import functions as F

from rolefit.llm import fill_middle


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute_row(key, text):
    text = text or ""
    n = len(text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return key, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = text[:a], text[a:b], text[b:]
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return key, n, form, a, b - a, sha(out), sha(text)


@pytest.mark.parametrize("unit", ["char", "word", "line"])
def test_lanes_lead_to_every_rank(unit):
    for text in ("x", "abc" * 700, "é\U0001f600 x" * 200, "one two  three\n four\n\n" * 90, " lead", "tail \n"):
        widths = fill_middle.unit_widths(text, unit)
        lanes = fill_middle.SkipList(widths)
        assert [lanes.find(r) for r in range(len(widths) + 1)] == np.r_[0, np.cumsum(widths)].tolist()
        assert lanes.n_points == len(text)
        for units, points, _ in lanes.lanes:
            assert units.sum() == len(widths) and points.sum() == len(text)
        with pytest.raises(IndexError):
            lanes.find(len(widths) + 1)


def test_a_long_text_has_few_links_to_take():
    lanes = fill_middle.SkipList(np.ones(200_000, np.int32))
    assert len(lanes.lanes[-1][0]) <= fill_middle.TOP and len(lanes.lanes) < 16
    assert lanes.find(123_456) == 123_456


def test_table(spark):
    more = [(1000 + k, f"text {k} with <{m}> é\U0001f600 " * (k % 5)) for k, m in enumerate("PSMXp" * 60)]
    docs = odd_documents(spark)
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r.doc_id, r.text) for r in docs.collect()] + more
    got = fill_middle.digest_table(fill_middle.fill_middle(table)).collect()
    assert sorted(map(tuple, got), key=str) == sorted((brute_row(*r) for r in rows), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert all(r.output_sha256 == r.restored_sha256 for r in got if r.form == "plain")
    assert fill_middle.fill_middle(empty_documents(spark)).count() == 0
    assert fill_middle.fill_middle(docs).columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


@pytest.mark.parametrize("unit", ["word", "line"])
def test_other_units_cut_between_them_and_come_back(spark, unit):
    text = "first line here\nsecond  line\n\nlast < P line"
    rows = spark.createDataFrame([(k, text) for k in range(80)], "doc_id long, text string")
    cut = fill_middle.fill_middle(rows, unit=unit)
    edges = {0, *np.cumsum(fill_middle.unit_widths(text, unit)).tolist()}
    assert all({r.prefix_chars, r.prefix_chars + r.middle_chars} <= edges for r in cut.where("form <> 'plain'").collect())
    back = cut.select(fill_middle.restored(F.col("output"), F.col("form")).alias("text")).distinct().collect()
    assert [r.text for r in back] == [text]
    with pytest.raises(ValueError):
        fill_middle.fill_middle(rows, unit="page")


def test_marks_that_touch_text_like_marks_come_back(spark):
    texts = ["<", "<<S", "P>x<", "<M", ">S><P", "<S <P <M"]
    rows = spark.createDataFrame([(k, texts[k % len(texts)]) for k in range(300)], "doc_id long, text string")
    cut = fill_middle.fill_middle(rows)
    back = cut.select("doc_id", fill_middle.restored(F.col("output"), F.col("form")).alias("text")).collect()
    assert all(r.text == texts[r.doc_id % len(texts)] for r in back)
