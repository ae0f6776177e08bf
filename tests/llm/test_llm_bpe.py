import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from cases import LONG, empty_documents, odd_documents

from rolefit.llm import bpe


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def wanted(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_knows_strangers():
    keys = [f"key{i}".encode() for i in range(5_000)]
    table = bpe.PerfectHash(keys)
    assert sorted(table.slots) == sorted(keys)  # every slot is used, once
    assert {table.find(k) for k in keys} == set(range(len(keys)))
    assert table.find(b"stranger") == -1 and table.find(b"") == -1
    assert bpe.PerfectHash([]).find(b"x") == -1 and bpe.PerfectHash([b"x"]).find(b"x") == 0


def test_ids_equal_those_of_the_library(codec, wanted):
    encode = bpe.encoder(codec)
    g = random.Random(5)
    texts = ["", " ", "a" * 20_000, "ab" * 999 + "\n\n  x", "don't we'll 12345 é中文\U0001f600", "<|endoftext|>", LONG,
             *("".join(g.choice("abc xyzAB .,!ßé\n\t0123") for _ in range(g.randrange(200))) for _ in range(300))]
    for text in texts:
        ids = encode(text)
        assert ids == wanted.encode_ordinary(text)
        assert bpe.decode_ids(codec, ids) == text.encode()


def test_merge_takes_least_rank_leftmost():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 301, b"aa": 302, b"abab": 303}
    codec = bpe.Codec(ranks, r"\S+")
    assert codec.merge(b"abc") == (300, ord("c"))
    assert codec.merge(b"aaaaa") == (302, 302, ord("a"))
    assert codec.merge(b"ababab") == (303, 300)


def test_results_do_not_depend_on_what_is_remembered(codec, monkeypatch):
    texts = ["one two three four", "five six one", "two two seven"] * 3
    whole = [bpe.encoder(codec)(t) for t in texts]
    monkeypatch.setattr(bpe, "REMEMBERED", 1)
    encode = bpe.encoder(codec)
    assert [encode(t) for t in texts] == whole


def test_table(spark, codec, wanted):
    docs = odd_documents(spark)
    got = bpe.digest_table(bpe.encode_decode(docs, codec)).collect()
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    want = [(k, len(i := wanted.encode_ordinary(t)), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
            for k, t in texts]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.encode_decode(empty_documents(spark), codec).count() == 0
    assert bpe.encode_decode(docs, codec, decoded=False).columns == ["doc_id", "token_ids"]


def test_large_vocabulary_is_refused(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_VOCABULARY", 1)
    with pytest.raises(ValueError):
        bpe.Codec({b"a": 0, b"b": 1}, ".")


def test_short_pieces_merge_as_the_heap_merges_them(codec, monkeypatch):
    g = random.Random(9)
    pieces = [bytes(g.choices(b"abt ing\xc3\xa9eros", k=g.randint(1, bpe.SHORT_PIECE))) for _ in range(2_000)]
    short = [codec.merge(p) for p in pieces]
    monkeypatch.setattr(bpe, "SHORT_PIECE", 0)
    assert [codec.merge(p) for p in pieces] == short
