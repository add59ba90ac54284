"""Repeated ids, clashing names, long texts and long chains."""

import random

from scorelens.llm import simhash

from .test_llm import brute_components, slow_fingerprint

NAMES = ("row", "id", "check", "fp", "least", "i", "c", "stays", "gone_")


def test_one_row_of_each_component(spark):
    """An id may repeat with other texts, and rows may repeat as a whole."""
    r = random.Random(6)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    base = [" ".join(r.choice(words) for _ in range(120)) for _ in range(12)]
    rows = [(r.choice([None, *range(9)]), r.choice([*base, "", None])) for _ in range(120)]
    rows += [(k, base[0] + " " + words[k]) for k in range(6)] + [(3, base[5])] * 4 + [(None, "only here")] * 3
    rows = [(*x, *(f"{n}{k}" for n in NAMES)) for k, x in enumerate(rows)]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES)
    docs = spark.createDataFrame(rows, schema)
    of = brute_components([(k, slow_fingerprint(x[1])) for k, x in enumerate(rows)])
    out = simhash.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    place = {x: k for k, x in enumerate(rows)}
    kept = [place[tuple(x)] for x in out.collect()]
    assert sorted(of[k] for k in kept) == sorted(set(of))
    for k in kept:
        ids = [rows[j][0] for j in range(len(rows)) if of[j] == of[k]]
        assert rows[k][0] == min((i for i in ids if i is not None), default=None)


def test_parts_of_a_long_text(monkeypatch):
    r = random.Random(2)
    texts = ["".join(r.choice("ab \t\n\x0bé\x1c ") for _ in range(n)) for n in (0, 1, 5, 50, 500, 5000) for _ in range(20)]
    monkeypatch.setattr(simhash, "PART", 7)
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_long_chain(spark):
    """A path of 3,000 links, which takes more than a few steps."""
    edges = spark.createDataFrame([(k + 1, k) for k in range(3_000)], "u long, v long")
    assert {tuple(x) for x in simhash.connected(edges).collect()} == {(k, 0) for k in range(1, 3_001)}


def test_hot_fingerprints(spark):
    rows = [(k, "" if k % 3 else f"text number {k} has words of its own {k * 7}") for k in range(900)]
    got = {x.doc_id: x.component_id for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(zip(range(900), brute_components([(k, slow_fingerprint(t)) for k, t in rows]), strict=True))
