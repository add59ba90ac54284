"""Each form that the generators of candidates name, with single spaces."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelens.llm import pii

EMAILS = ["joe" + a + "mail" + d + "com" for a in ("[at]", "(at)", "{at}", "@", " at ", " [at] ", " (at) ", " {at} ", " @ ") for d in ("[dot]", "(dot)", "{dot}", ".", " dot ", " [dot] ", " (dot) ", " {dot} ")]
ADDRESSES = ["2001:db8:0:0:0:0:0:1", "2001:db8::1", "fe80::1", "fe80::", "::1", "::8a2e:370:7334", "2001:db8::8a2e:370:7334", "1:2:3:4:5::8"]


PHONES = ["(415) 555-1234", "415-555-1234", "415.555.1234", "0033 123 456 7890", "01 23 45 67 89", "030/1234567"]
CARDS = ["4111.1111.1111.1111", "4111_1111_1111_1111", "4111 - 1111 - 1111 - 1111", "4111  1111  1111  1111", "4111. 1111. 1111. 1111"]
DEFANGED = ["10[.]20[.]30[.]40", "10(.)20(.)30(.)40", "10[dot]20[dot]30[dot]40"]


@pytest.mark.parametrize("kind, spans", [("email", EMAILS), ("email", [s.upper() for s in EMAILS]), ("ip", ADDRESSES + DEFANGED), ("card", CARDS), ("phone", PHONES)])
def test_generators(spark, kind, spans):
    docs = spark.createDataFrame([(k, f"contact {s}, now") for k, s in enumerate(spans)], "doc_id long, text string")
    own = [x[1:] for x in pii.MORE.values() if x[0] == kind]
    got = docs.select("doc_id", *(F.struct(F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias("m"), F.col("text").rlike(h).alias("hint")) for p, h in own)).orderBy("doc_id").collect()
    for s, r in zip(spans, got, strict=True):
        assert any(s in x.m for x in r[1:]), s
        assert all(x.hint for x in r[1:] if x.m), s


def test_generators_overlap(spark):
    """Several proposals for one place; the best stays."""
    docs = spark.createDataFrame([(1, "mail me at joe@ mail[dot]com dot net, card 4111.1111.1111.1111 ok")], "doc_id long, text string")
    text = docs.first().text
    proposed = [m.span() for k, p, _ in pii.MORE.values() if k == "email" for m in re.finditer(p, text)]
    assert len(set(proposed)) > 1
    got = [x.split(":") for x in pii.digests(pii.personal_data(docs)).first().spans.split(",")]
    places = sorted((int(a), int(b)) for _, a, b in got)
    assert all(b <= c for (_, b), (c, _) in zip(places, places[1:], strict=False))


def test_precision_and_recall_of_added_spans(spark):
    """On sentences made with another seed, and so never seen in training."""
    judge = pii.train(spark)
    got = pii.candidates_of_examples(spark, pii.examples(3000, seed=77))
    x, y = np.array([r.f for r in got]), np.array([r.y for r in got])
    z = sum(pii._predict(t, x) for t in judge.trees)
    p = 1 / (1 + np.exp(-(judge.curve[0] + judge.curve[1] * z)))
    for k, kind in enumerate(pii.KINDS):
        own = x[:, 0] == k
        taken = own & (z >= judge.limits[k])
        assert judge.limits[k] < float("inf") and p[taken].min() >= 0.5 - 1e-9, kind
        assert y[taken].mean() > 0.84 and y[taken].sum() / y[own].sum() > 0.5, kind
    for low in np.arange(0, 1, 0.2):  # what is said to be likely is as often true
        part = (p >= low) & (p < low + 0.2)
        assert part.sum() < 50 or abs(p[part].mean() - y[part].mean()) < 0.12


def test_trees_in_sql(spark):
    """Scores of documents are those of the trees, and overlaps are settled by brute force."""
    made = pii.examples(300, seed=9)
    text = "\n".join(t for t, _ in made)
    docs = spark.createDataFrame([(1, text)] + [(2 + k, t) for k, (t, _) in enumerate(made)], "doc_id long, text string")
    judge = pii.train(spark)
    found = pii._located(docs, {g: x[1:] for g, x in pii.MORE.items()}, "more_", lambda k, m: F.lit(True))

    def numbers(g):
        return F.transform(f"more_{g}", lambda x: F.struct(x["start"].alias("a"), x["end"].alias("b"), pii._numbers(pii.MORE[g][0], x).alias("f")))

    found = found.select("doc_id", F.concat(*map(numbers, pii.MORE)).alias("c"))
    proposed = {r.doc_id: r.c for r in found.collect()}
    for r in pii.personal_data(docs).collect():
        base = [(x.start, x.end) for k in pii.KINDS for x in r[f"base_{k}"]]
        judged = set()
        for c in proposed[r.doc_id]:
            score = float(sum(pii._predict(t, np.array([c.f])) for t in judge.trees)[0])
            if score >= judge.limits[int(c.f[0])] and not any(c.a < b and a < c.b for a, b in base):
                judged.add((-round(score, 9), int(c.f[0]), c.a, -c.b))
        want = {x for x in judged if not any(y < x and y[2] < -x[3] and x[2] < -y[3] for y in judged)}
        assert {(-round(x.score, 9), k, x.start, -x.end) for k, kind in enumerate(pii.KINDS) for x in r[f"added_{kind}"]} == want


def test_redaction_of_nulls_and_overlaps(spark):
    rows = [(1, None), (None, ""), (2, "x@y.org" * 3), (3, "+1 415 555 1234 5678 9012 3456 a@b.cc"), (4, "no data"), (None, "1.2.3.4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = {k: p for k, (p, _) in pii.BASE.items()}
    assert base.keys() == set(pii.KINDS)
    got = [tuple(r) for r in pii.redact(docs).collect()]
    assert got[:2] == [(1, ""), (None, "")] and got[4:] == [(4, "no data"), (None, "[ip]")]
    assert got[2][1] == "[email]@[email]" and "a@b" not in got[3][1]


def test_long_directory(spark):
    """Ten thousand spans of each sort in one text."""
    text = "".join(f"joe at site dot com, mail k{k}@x.org, call 415-555-{k % 10_000:04}\n" for k in range(10_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.digests(pii.personal_data(docs)).first()
    assert r.n_email == 10_000 and len(r.spans.split(",")) > 20_000
    spans = sorted((int(a), int(b), k) for k, a, b in (x.split(":") for x in r.spans.split(",")))
    want, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            want += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    assert pii.redact(docs).first().text == "".join([*want, text[at:]])


def test_redaction_across_stretches(spark, monkeypatch):
    monkeypatch.setattr(pii, "STRETCH", 5)
    texts = ["ab x@y.org cd 1.2.3.4", "x@y.org", "é😀 +1 415 555 1234 5678 😀😀😀 me@a.bc", "nothing here"]
    got = [r.text for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert got == ["ab [email] cd [ip]", "[email]", "é😀 [phone] 😀😀😀 [email]", "nothing here"]


def test_accepted(spark):
    good = ["please contact joe at mail dot com", "mail me at kim[at]server[dot]org, thanks", "ip address 2001:db8::8a2e:370 ok", "login from host fe80:12::1f ok"]
    bad = ["they look at this. More follows later", "we met at noon. Then left", "use bad::dead in code", "at 12::30 we left", "std::vector of abc::def"]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    got = [re.sub(":[0-9:]*", "", r.spans) for r in pii.digests(pii.personal_data(docs)).orderBy("doc_id").collect()]
    assert got == ["email", "email", "ip", "ip", "", "", "", "", ""]
