"""Toxicity against plain loops: votes, the label model and scores."""

import math
import random
import re

import numpy as np
import pytest

from scorelens.llm import toxicity as T


def slow_words(text):
    return {w.lower() for w in re.findall(r"[^\W\d_]+", text or "")}


def slow_hits(text, induced):
    words = slow_words(text)
    lexicons = [sum(w in words for w in own.split()) for kinds in T.LEXICONS.values() for own in kinds.values()]
    patterns = [len(re.findall(f"(?:{p[4:]})" if p.startswith("(?i)") else p, text or "", re.I if p.startswith("(?i)") else 0)) for p in T.PATTERNS.values()]
    prefixes = []
    for f in induced:
        n = sum(w.startswith(f[:-1]) and len(w) >= len(f) for w in words) if f.endswith("*") else int(f in words)
        prefixes.append(n if not f.endswith("*") or n * T.DENSE >= len(words) else 0)
    return lexicons + patterns + prefixes


def slow_votes(text, hits, written):
    words = slow_words(text)
    long = len(words) >= T.SPOKEN
    quiet = [long and not any(hits[:written]) and sum(w in words for w in own.split()) >= T.FUNCTION for own in T.FUNCTION_WORDS.values()]
    return [int(h > 0) for h in hits] + [-int(q) for q in [*quiet, long and not any(hits)]]


def texts(seed, n):
    r = random.Random(seed)
    plain = "the of and to in is that der die das und le la les des el los las que house garden river zorblat zorbik quiet".split()
    bad = "idiot MORON trash st*pid stuuupid l0ser zorblax zorbiq you are such a clown kill yourself basura abruti trottel".split(" ")
    return ["", None, "word", *(" ".join(r.choice(plain if r.random() < 0.9 else bad) for _ in range(r.choice([3, 15, 80, 300]))) for _ in range(n))]


def test_votes():
    voters = T.Voters(["zorb*", "quiet"])
    seen = np.zeros(voters.written + 2)
    for t in texts(1, 400):
        words = T.words_of(t)
        hits = voters.hits(words, voters.stems(words), voters.of_patterns(t, words))
        assert hits.tolist() == slow_hits(t, voters.induced)
        assert voters.votes(words, hits).tolist() == slow_votes(t, hits, voters.written)
        seen += hits > 0
    assert (seen > 0).sum() >= 10


@pytest.mark.parametrize("text", ["you are an idiot", "1diot", "st*pid", "stuuupid", "LOSER", "Kill yourself", "tr@sh", "quelle racaille", "du vollidiot", "qué payaso"])
def test_written_voters(text):
    voters = T.Voters()
    words = T.words_of(text)
    assert voters.hits(words, {}, voters.of_patterns(text, words)).any()


def test_label_model_in_loops():
    r = np.random.default_rng(3)
    y = r.random(300) < 0.2
    votes = np.where(r.random((300, 5)) < np.where(y, 0.6, 0.01)[:, None], 1, 0).astype(np.int8)
    votes = np.hstack((votes, -(~votes.any(1) & (r.random(300) < 0.9)).astype(np.int8)[:, None]))
    post, rates, _ = T.label_model(votes, rounds=4)
    n, m = votes.shape
    before = [T.BELIEF if any(v > 0 for v in row) else 1 - T.BELIEF for row in votes]
    want = list(before)
    for _ in range(4):
        p1 = [(a + b) / 2 for a, b in zip(want, before, strict=True)]
        rate, corr = [], []
        for p in ([1 - x for x in p1], p1):
            total = sum(p) + 1e-9
            rc = [(sum(p[i] for i in range(n) if votes[i][j]) + 0.5) / (total + 1) for j in range(m)]
            said = [[abs(int(v)) for v in row] for row in votes]
            cov = [[sum(p[i] * (said[i][j] - rc[j]) * (said[i][k] - rc[k]) for i in range(n)) / total for k in range(m)] for j in range(m)]
            corr.append([[cov[j][k] / math.sqrt(max(cov[j][j], 1e-9)) / math.sqrt(max(cov[k][k], 1e-9)) for k in range(m)] for j in range(m)])
            rate.append(rc)
        sign = [-1 if any(votes[i][j] < 0 for i in range(n)) else 1 for j in range(m)]
        share = min(max(sum(want) / n, 0.001), 0.5)
        new = []
        for i in range(n):
            z = math.log(share / (1 - share))
            for j in range(m):
                if votes[i][j]:
                    echo = sum(min(max((corr[0][j][k] + corr[1][j][k]) / 2, 0), 1) for k in range(m) if k != j and votes[i][k] and sign[j] == sign[k])
                    z += sign[j] * max(0, sign[j] * math.log(rate[1][j] / rate[0][j])) / (1 + echo)
            new.append(1 / (1 + math.exp(-min(max(z, -30), 30))))
        want = new
    assert post == pytest.approx(want, rel=1e-9)
    assert ((post > 0.5) == y).mean() > 0.93


def test_scores(spark):
    """The whole operator's scores from its model's numbers, document by document."""
    rows = list(enumerate(texts(5, 500)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    toxic = {k: int(any(w in slow_words(t) for w in ("idiot", "moron", "trash", "zorblax", "zorbiq", "clown"))) for k, t in rows}
    labels = spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int")
    model = T.fit(docs, labels)
    got = {r.doc_id: r.score for r in T.toxicity(docs, labels).collect()}
    for k, t in rows:
        hits = slow_hits(t, model.voters.induced)
        z = model.weights[0] + sum(w * math.log1p(h) for w, h in zip(model.weights[1:-1], hits, strict=True)) + model.weights[-1] * math.log1p(sum(hits))
        assert got[k] == pytest.approx(1 / (1 + math.exp(-min(max(model.curve[0] + model.curve[1] * z, -30), 30))), rel=1e-9)
    assert np.mean([(got[k] >= 0.5) == toxic[k] for k, _ in rows]) > 0.9


def test_induced_prefixes(spark):
    """Two families of words mark toxic rows, one of them covered by a lexicon already."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefg") for _ in range(8))
    rows = []
    for k in range(600):
        words = [word() for _ in range(40)] + (["xyzzy" + word() for _ in range(3)] if k % 10 == 0 else ["idiot"] if k % 10 == 1 else [])
        rows.append((k, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = T.fit(docs, spark.createDataFrame([(k, int(k % 10 < 2)) for k in range(600)], "doc_id long, toxic int"))
    assert [f[:4] for f in model.voters.induced] == ["xyzz"]
    toxic = [{"a", "b"}, {"a"}, {"a"}, {"a"}, {"b", "c"}, {"c"}, {"c"}, {"c"}, {"c"}, {"b"}]
    assert T.induce(toxic, {"a": 4, "b": 3, "c": 5}) == ["c", "a"]


NAMES = ("row", "score", "toxicity_", "predicted", "y", "y_id")


def test_clashing_names(spark):
    rows = [(k, t, *(f"{n}{k}" for n in NAMES)) for k, t in enumerate(texts(7, 60))]
    docs = spark.createDataFrame(rows, ["doc_id", "text", *NAMES])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, toxic int")
    kept = {r.doc_id for r in T.toxicity(docs, labels).collect() if r.score < 0.5}
    out = T.drop_toxic(docs, labels)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(r for r in rows if r[0] in kept)


def test_long_text():
    text = "The house and the garden of it. " * 200_000 + "idiot"
    words = T.words_of(text)
    assert "idiot" in words and len(words) == 7
    assert list(T.parts(text))[1][0] == " " and "".join(T.parts(text)) == text
