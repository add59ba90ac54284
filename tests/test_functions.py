import math

import pytest
from pyspark.sql import functions as F

from scorelens.functions import text as T
from scorelens.functions import vectors as V


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("mode, want", [("exact", "  a \n b "), ("strip", "a \n b"), ("collapse-space", "a b")])
def test_normalise(spark, mode, want):
    assert value(spark, T.normalise(F.lit("  a \n b "), mode)) == want


def test_normalise_unknown():
    with pytest.raises(ValueError):
        T.normalise(F.lit(""), "loose")


def test_strip_takes_unicode_space(spark):
    assert value(spark, T.strip(F.lit("\x1c 　a​\x85"))) == "a​"


@pytest.mark.parametrize("piece, kind", [("a", "word"), (" é", "word"), ("_", "word"), (".b", "word"), ("!?", "punct"), (" ", "space"), ("\n", "space"), ("", "space")])
def test_piece_type(spark, piece, kind):
    assert value(spark, T.piece_type(F.lit(piece))) == kind


@pytest.mark.parametrize("text, want", [("x" * 12, "x" * 12), ("x" * 13, "x" * 11 + "…"), ("a b", "a·b")])
def test_compact_token(spark, text, want):
    assert value(spark, T.compact_token(F.lit(text))) == want


@pytest.mark.parametrize("text, want", [("x" * 18, "x" * 18), ("x" * 19, "x" * 17 + "..."), ("a\nb", "a\\nb")])
def test_compact_text(spark, text, want):
    assert value(spark, T.compact_text(F.lit(text))) == want


def test_html_escape(spark):
    assert value(spark, T.html_escape(F.lit("<a href=\"x\">&'"))) == "&lt;a href=&quot;x&quot;&gt;&amp;&#x27;"


@pytest.mark.parametrize("v, want", [(-746.0, 0.0), (-745.05, math.exp(-745.05)), (0.0, 1.0), (705.0, math.inf)])
def test_safe_exp(spark, v, want):
    got = value(spark, V.safe_exp(F.lit(v)))
    assert got == pytest.approx(want, abs=1e-300) if want == 0 or v == 705 else abs(got - want) < 1e-9


def test_pieces_cover_text(spark):
    text = "Hello, wörld!?\n\n  x_1 (a.b)--\t日本語テキスト ok"
    assert "".join(value(spark, T.pieces(F.lit(text)))) == text


def test_strip_against_python(spark):
    texts = ["", " ", " a\x1c", "a b", " a \n b\t", "\x85x\xa0", "a" + " " * 100_000 + "b ", " " * 100_000, "​ a", "퟿", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", T.strip(F.col("t")).alias("s"), T.collapse(F.col("t")).alias("c")).collect()
    assert {r.k: r.s for r in got} == {k: None if t is None else t.strip() for k, t in enumerate(texts)}
    assert {r.k: r.c for r in got} == {k: None if t is None else " ".join(t.split()) for k, t in enumerate(texts)}
