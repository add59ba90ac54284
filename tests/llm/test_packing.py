"""Texts that are hard on the tokenisers, and rows that repeat an id."""

import zlib
from collections import Counter

import numpy as np
import pytest

from scorelens.llm import packing
from scorelens.llm.queries import vocabulary

EXACT, RANKS = vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken")


def pieces(spark, texts, **more):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return Counter(map(tuple, packing.pieces(docs, EXACT, **more).collect()))


@pytest.mark.parametrize("space", [" ", "\t", "\n", "\r\n", " \n", "\xa0", "\x85"])
def test_long_white_space(spark, space):
    run = space * (2_000_000 // len(space))
    texts = [run, "a" + run + "b", "word " + space * (packing.SPACES - 1) + "word", "x" + space * (packing.SPACES + 1)]
    assert pieces(spark, texts, ranks_path=RANKS) == pieces(spark, texts)


def test_failures_of_the_fast_library(monkeypatch):
    import tiktoken

    class PanicException(BaseException):
        pass

    def panic(self, text):
        raise PanicException("stack overflow")

    want = packing.tokenizer(EXACT, None)("some text")
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", panic)
    assert packing.tokenizer(EXACT, RANKS)("some text") == want
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        packing.tokenizer(EXACT, RANKS)("some text")


def test_rows_of_one_id(spark):
    """All rows of a frequent id, null or not, are dealt to many buckets, and packed whole."""
    rows = [(None, "same words here")] * 3000 + [(7, "same words here")] * 3000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    got = packing.pack(packing.pieces(docs, EXACT, RANKS)).collect()
    assert Counter(r.doc_id for r in got) == {None: 3000, 7: 3000}
    assert len({(r.sequence_id, r.offset) for r in got}) == 6000
    size = got[0].length
    assert len({r.sequence_id for r in got}) == -(-6000 // (1024 // size))


def test_sequences_reach_the_bound(spark):
    """Against the number of tokens, below which no packing can go."""
    r = np.random.default_rng(1)
    for _ in range(20):
        counts = dict(zip(*(x.tolist() for x in np.unique(r.integers(1, 1025, 20_000), return_counts=True)), strict=True))
        least = -(-sum(k * n for k, n in counts.items()) // 1024)
        assert sum(n for _, n in packing.plan(counts, 1024)) <= 1.01 * least + 1


def test_many_pieces_of_a_text(spark):
    text = "word " * 300_000
    got = sorted(pieces(spark, [text], ranks_path=RANKS))
    ids = np.frombuffer(packing.tokenizer(EXACT, None)(text), "<u4")
    assert sum(p[3] for p in got) == len(ids) and [p[1] for p in got] == list(range(len(got)))
    assert all(p[4] == zlib.crc32(ids[p[2] : p[2] + p[3]].tobytes()) for p in got)


def test_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, 7)], "doc_id long, text string, length long, bucket int, rank long")
    got = packing.pack(packing.pieces(docs, EXACT, RANKS)).first()
    assert got.length == 3 and got.offset == 0
