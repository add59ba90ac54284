"""Gaps that a very long document leaves."""

import re

import pytest

from scorelens.llm import mixing


@pytest.mark.parametrize("long", [5, 7, 11])
def test_gap_is_closed(spark, long):
    rows = [(k, "w " * (20_000 if k == long else 30), "b") for k in range(1000)]
    rows += [(1000 + k, "w " * 375, "a") for k in range(100)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    own = [r for r in got if r.doc_id < 1000]
    assert own[0].target == pytest.approx(24_991, abs=1)
    assert own[0].target - 30 < sum(r.taken for r in own) <= own[0].target


def test_repeated_rows_fit_together(spark):
    rows = [(k % 40, "w " * (5 + k % 40), "b") for k in range(120)] + [(1000 + k, "w " * 30, "a") for k in range(70)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    own = [r for r in got if r.doc_id < 1000]
    left = own[0].target - sum(r.taken for r in own)
    least = min(3 * r.size for r in own if r.copies == min(x.copies for x in own))
    assert 0 <= left < least


NAMES = ("row", "nth", "u", "f", "target", "more", "some", "copies", "source_size", "check", "size", "rank", "from", "whole")


def test_clashing_names(spark):
    rows = [(k, "w " * (1 + k % 9), "ab"[k % 2]) + tuple(f"{n}{k}" for n in NAMES) for k in range(60)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "source", *NAMES])
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(r for r in rows for _ in range(copies[r[0]]))


def test_counted_words(spark):
    texts = [None, "", " ", "\t\n\x0b\x0c\r ", "a", " a", "a ", " a  b c\nd ", "é \U0001f600\U0001f600 x", "\x1c \x85", "w " * 3_000_000, " " * 3_000_000, "w" * 3_000_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(13)
    got = dict(docs.select("id", mixing.count_words(docs["text"])).collect())
    assert got == {k: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for k, t in enumerate(texts)}
