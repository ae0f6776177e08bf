"""The stages of the pipeline against what their operators find, each on its own input."""

import re

import public_tokenizers
import pytest
import tiktoken
from test_llm_duplicates import brute_groups

import corpus_pipeline
from rolefit.llm import bpe, langid
from rolefit.llm.common import written

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], SMALL)))
    return out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_all_but_the_last_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns and df.schema == stages[0].schema for df in stages[1:-1])


def test_language_keeps_clean_documents(stages):
    gone = ids(stages[0]) - ids(stages[1])
    texts = {r.doc_id: r.text for r in stages[0].collect()}
    assert len(gone) < 5 and all(len(texts[k]) < 60 for k in gone)


def test_one_document_of_each_group_stays(stages):
    groups = brute_groups([(r.doc_id, r.text) for r in stages[1].collect()])
    assert ids(stages[2]) == {k for k, (_, root) in groups.items() if k == root}


def test_leaks_go_and_only_they(spark, stages):
    """Brute force: an item leaks if a document has 12 of its words in a row."""
    def words(text):
        return re.findall(r"[^\W_]+", text.lower())

    runs = {}
    for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = words(r.text)
        for i in range(len(w) - 11):
            runs[tuple(w[i:i + 12])] = r.item_id
    leaked = set()
    for r in stages[2].collect():
        w = words(r.text)
        if any(tuple(w[i:i + 12]) in runs for i in range(len(w) - 11)):
            leaked.add(r.doc_id)
    assert leaked and ids(stages[2]) - ids(stages[3]) == leaked


def test_secrets_are_gone_and_the_rest_is_as_it_was(stages):
    before = {r.doc_id: r.text for r in stages[3].collect()}
    after = {r.doc_id: r for r in stages[4].collect()}
    assert before.keys() == after.keys()
    changed = 0
    for k, row in after.items():
        assert not re.search(r"[0-9a-f]{16,}|AKIA[A-Z0-9]{14,}", row.text) and row.n_chars == len(row.text)
        if "[SECRET]" in row.text:
            changed += 1
            assert re.fullmatch(re.escape(row.text).replace(r"\[SECRET\]", r"[\s\S]+"), before[k])
        else:
            assert row.text == before[k]
    assert changed


def test_leaks_go_whatever_their_ids(spark):
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").first().text
    rows = [(None, "before " + item), (1, item + " after"), (1, "a clean text with the same number"), (None, "a clean text without one"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.decontamination(spark, docs, SMALL)
    assert sorted((r.doc_id or 0, r.text) for r in kept.where("text is not null").collect()) == [(0, rows[3][1]), (1, rows[2][1])] and kept.count() == 3


def test_tokens_are_those_of_the_library(stages):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    got = {r.doc_id: list(r.token_ids) for r in stages[5].collect()}
    assert got == {k: own.encode_ordinary(t) for k, t in texts.items()}


def test_run_returns_the_last_stage(spark, stages):
    assert ids(corpus_pipeline.run(spark, SMALL)) == ids(stages[5])


def test_pipeline_of_odd_rows(spark):
    rows = [(1, "the quick brown fox jumps over it", "en", "s", 5), (1, "the quick brown fox jumps over it", "en", "s", 5), (2, None, None, None, None), (3, "", "en", "s", 0),
            (None, "ohne Nummer steht dieser Text hier", "de", None, 3), (4, "THE quick brown fox jumps over it", "en", "s", 5),
            (None, "ohne Nummer steht dieser Text hier", "de", None, 3), (1, "another text altogether has the same number as the first", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = written(stage(spark, kept, SMALL))
        assert kept.schema == docs.schema, name
    assert sorted(((r.doc_id or 0), r.text[:4]) for r in kept.collect()) == [(0, "ohne"), (1, "anot"), (1, "the ")]
    assert corpus_pipeline.accepted("en", 0.9) and not corpus_pipeline.accepted(langid.UNKNOWN, 1.0)
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = written(stage(spark, none, SMALL))
    assert none.count() == 0
