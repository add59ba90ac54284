"""Each operator against brute force, and its defined cases: nulls, empty and very long texts,
ties and repeated rows, empty tables, columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelens.llm import exact_dedup, licenses, lm_scoring, mixing, packing, pii, quality, simhash, topk_search, toxicity
from scorelens.llm.queries import vocabulary

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as further columns of a table.
CLASHES = ("fp", "size", "rank", "digest", "length", "piece", "bucket", "label", "key", "u")


def documents(spark, rows, clashes=False):
    """rows: (doc_id, text[, source])."""
    df = spark.createDataFrame([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 0) for r in rows], DOCS)
    return df.withColumns({c: F.lit("x") for c in CLASHES}) if clashes else df


def edge_rows():
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, long), (6, long), (7, "same text here ok"), (7, "same text here ok"), (8, "same text here ok"), (None, "same text here ok"), (None, None), (9, "é" * 5000), (10, "<|endoftext|> x")]


def corpus(seed=0, n=150):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.choice([3, 30, 200, 1500]))) for _ in range(n)]
    for k in range(n // 3):
        t = texts[r.randrange(n)].split(" ")
        for _ in range(r.randint(0, 2)):
            t[r.randrange(len(t))] = r.choice(words)
        texts.append(" ".join(t))
    return [(k, t, r.choice(["a", "b", "b", "b", None])) for k, t in enumerate(texts)]


def both(spark):
    return [documents(spark, corpus()), documents(spark, edge_rows(), clashes=True)]


# --- packing


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(items):
            best[0] = len(bins)
            return
        for b in {v: i for i, v in enumerate(bins) if v >= items[k]}.values():
            bins[b] -= items[k]
            go(k + 1, bins)
            bins[b] += items[k]
        go(k + 1, [*bins, capacity - items[k]])

    go(0, [])
    return best[0]


def test_dominance_keeps_the_optimum():
    r = random.Random(1)
    for _ in range(300):
        capacity = r.choice([10, 20, 30])
        items = [r.randint(1, capacity) for _ in range(r.randint(1, 9))]
        fixed, kept = packing.reduce(dict(Counter(items)), capacity)
        assert sum(n for _, n in fixed) + optimum([x for x, c in kept.items() for _ in range(c)], capacity) == optimum(items, capacity)


def test_plan_places_all():
    r = random.Random(2)
    for _ in range(60):
        counts = Counter(r.randint(1, 64) for _ in range(r.choice([0, 1, 50, 3000])))
        got = Counter()
        for shape, n in packing.plan(dict(counts), 64):
            assert n > 0 and sum(x * k for x, k in shape) <= 64
            for x, k in shape:
                got[x] += k * n
        assert got == counts


@pytest.mark.parametrize("which", [0, 1])
def test_packing(spark, which):
    from tokenizers import Tokenizer

    docs = both(spark)[which]
    exact = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for r in docs.collect():
        ids = exact.encode(r.text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        edges = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    cuts = packing.pieces(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    got = packing.pack(cuts).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(sequences) <= sum(r.length for r in got) / 1024 * 1.1 + 2


def test_packing_nothing(spark):
    assert packing.pack(packing.pieces(documents(spark, []), vocabulary("byte_bpe_50k.json"))).isEmpty()


# --- exact dedup


@pytest.mark.parametrize("heavy", [1, 256])
def test_exact_groups(spark, heavy):
    rows = [(k, f"t{k % 5}" if k % 3 else "hot") for k in range(90)]
    found = {r.doc_id: r for r in exact_dedup.groups(documents(spark, rows).repartition(7), heavy=heavy).collect()}
    by = defaultdict(list)
    for k, t in rows:
        by[t].append(k)
    for k, t in rows:
        r = found[k]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(by[t]), len(by[t]), k == max(by[t]), hashlib.sha256(t.encode()).hexdigest())


def test_exact_edges(spark):
    docs = documents(spark, edge_rows(), clashes=True)
    got = exact_dedup.groups(docs).collect()
    assert len(got) == len(edge_rows())
    texts = {t or "" for _, t in edge_rows()}
    assert sum(r.kept for r in got) == len(texts)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r.text or "") for r in kept.collect()) == sorted(texts)
    assert exact_dedup.groups(documents(spark, [])).isEmpty() and exact_dedup.drop_copies(documents(spark, [])).isEmpty()


# --- mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= over


@pytest.mark.parametrize("which", [0, 1])
def test_mix(spark, which):
    docs = both(spark)[which]
    if which == 0:
        docs = docs.unionByName(documents(spark, [(9000, "tiny", "aa"), (9001, "two words", "zz")]))
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    source = {r.doc_id: r.source for r in docs.collect()}
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    sums, taken, target = Counter(), Counter(), {}
    for r in got:
        assert (r.doc_id is None or r.size == size[r.doc_id]) and r.taken <= 3 * r.size and (r.taken == r.copies * r.size)
        sums[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    want = brute_targets(sums)
    for s, t in target.items():
        assert t == pytest.approx(want[s])
        assert taken[s] <= t + 1e-6
        if which == 0 and s in ("b",):
            assert taken[s] >= 0.98 * t
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))


def test_mixed_rows(spark):
    docs = documents(spark, corpus(), clashes=True)
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = Counter(r.doc_id for r in out.collect())
    assert got == Counter({k: v for k, v in copies.items() if v})
    assert mixing.mix(documents(spark, [])).isEmpty() and mixing.mixed(documents(spark, [])).isEmpty()


# --- SimHash


def slow_fingerprint(text, k=3):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [f for _, f in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                root[find(a)] = find(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            least[find(k)] = min(d, least.get(find(k), d))
    return [least.get(find(k)) for k in range(len(rows))]


@pytest.mark.parametrize("which", [0, 1])
def test_near_duplicates(spark, which):
    docs = both(spark)[which]
    rows = [(r.doc_id, slow_fingerprint(r.text)) for r in docs.collect()]
    want = Counter((d, f"{f:016x}", c) for (d, f), c in zip(rows, brute_components(rows), strict=True))
    assert Counter(map(tuple, simhash.near_duplicates(docs).collect())) == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(set(brute_components(rows)))


@pytest.mark.parametrize("limit", [None, 5])
def test_links_of_clusters(spark, limit):
    """Tight clusters, with nodes cut again where they exceed the limit."""
    r = random.Random(4)
    fps = set()
    for base in [r.getrandbits(64) for _ in range(6)]:
        for _ in range(60):
            x = base
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long")
    root = {r.u: r.v for r in simhash.connected(simhash.links(distinct, limit)).collect()}
    rows = [(f, f & (1 << 64) - 1) for f in signed]
    assert {f: root.get(f, f) for f in signed} == dict(zip(signed, brute_components(rows), strict=True))


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(documents(spark, [])).isEmpty()


# --- top-k search


def brute_top_k(rows, k=20):
    v = [(i, [math.floor(64 * float(np.float32(x))) for x in e]) for i, e in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = Counter()
    for n, (q, a) in enumerate(v):
        if q is not None and q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), c is None, c or 0) for m, (c, b) in enumerate(v) if m != n)[:k]
            out.update((q, r + 1, None if unknown else c, -s) for r, (s, unknown, c) in enumerate(scored))
    return out


@pytest.mark.parametrize("shard, block", [(16_384, 2_048), (70, 5), (7, 40)])
def test_top_k(spark, shard, block):
    r = random.Random(3)
    rows = [(i, [r.choice([-1, 0, 1, 0.5]) * r.random() for _ in range(8)]) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]
    rows += [(2000, None), (2020, [None] * 8), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (None, [1.0] * 8), (2080, [1.0]), (2100, [])]
    rows += [(40, rows[40][1]), (40, rows[3][1]), (7, rows[8][1])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("v", "row", "asks", "shard", "score")})
    got = topk_search.top_k(topk_search.scaled(vectors), F.col("vec_id") % 20 == 0, shard=shard, block=block)
    assert Counter(tuple(x) for x in got.collect()) == brute_top_k(rows)


@pytest.mark.parametrize("size", [5e6, 2.0**31, 2.0**24 * 3 + 1])
def test_top_k_of_large_components(spark, size):
    """Scores of more than 53 and of more than 62 bits, which the best ones need not have."""
    r = random.Random(4)
    rows = [(i, [r.choice([-1.0, 1.0]) * r.random() for _ in range(4)]) for i in range(200)]
    rows += [(100 * i + 3, [size * r.random() for _ in range(4)]) for i in range(2, 30)] + [(7, [2.0**60, 0.0, 0.0, 0.0])]
    rows = [(i, [float(np.float32(x)) for x in e]) for i, e in rows if i % 20 or e[0] < 0]
    got = topk_search.top_k(topk_search.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), F.col("vec_id") % 20 == 0, shard=50)
    assert Counter(tuple(x) for x in got.collect()) == brute_top_k(rows)


def test_scores_beyond_a_long(spark):
    rows = [(0, [2.0**100]), (1, [2.0**100]), (2, [-(2.0**100)])] + [(20 * k + 1, [0.0]) for k in range(1, 30)]
    vectors = topk_search.scaled(spark.createDataFrame(rows[:1] + rows[2:], "vec_id long, embedding array<float>"))
    got = topk_search.top_k(vectors, F.col("vec_id") % 20 == 0).collect()
    assert [x.score for x in got] == [0] * 20 and 2 not in {x.vec_id for x in got}
    with pytest.raises(Exception, match="does not fit"):
        topk_search.top_k(topk_search.scaled(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), F.col("vec_id") % 20 == 0).collect()


def test_top_k_of_few(spark):
    one = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    for rows in (one, one.limit(0)):
        assert topk_search.top_k(topk_search.scaled(rows), F.col("vec_id") % 20 == 0).isEmpty()


# --- classifiers


def accuracy(spark, scored, label):
    rows = scored.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").select("score", "predicted", label).toPandas()
    y = rows[label] == 1
    ranks = rows.score.rank()
    area = (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    return area, rows.predicted[y].mean(), rows.predicted[~y].mean()


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    area, found, wrong = accuracy(spark, toxicity.toxicity(docs, labels), "toxic")
    assert area > 0.95 and found > 0.88 and wrong < 0.01


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    area, found, wrong = accuracy(spark, quality.quality(docs, labels), "quality")
    assert area > 0.98 and found > 0.97 and wrong < 0.15


def test_label_model_weakens_echoes():
    """Ten voters that always say the same weigh little more than one of them."""
    r = np.random.default_rng(0)
    y = r.random(4000) < 0.3
    alone = (r.random((4000, 3)) < np.where(y, 0.8, 0.01)[:, None]).astype(np.int8)
    echo = (r.random(4000) < np.where(y, 0.5, 0.05))[:, None].astype(np.int8)
    odds = lambda p: np.log(p / (1 - p))
    many, rates, corr = toxicity.label_model(np.hstack((alone, np.repeat(echo, 10, 1))))
    one, *_ = toxicity.label_model(np.hstack((alone, echo)))
    only = (echo[:, 0] == 1) & ~alone.any(1)
    assert corr[0][3:, 3:].min() > 0.9 > corr[0][0, 1]
    assert abs(odds(many[only]).mean() - odds(one[only]).mean()) < 0.5
    assert rates[0, 1] > 10 * rates[0, 0] and ((many > 0.5) == y).mean() > 0.9


@pytest.mark.parametrize("operator, empty", [(toxicity.toxicity, 0.0), (quality.quality, 0.5)])
def test_classifier_edges(spark, operator, empty):
    docs = documents(spark, edge_rows(), clashes=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = operator(docs, none).collect()
    assert len(got) == len(edge_rows()) and all(abs(r.score - empty) < 1e-6 for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    some = spark.createDataFrame([(k, k % 2, k % 2) for k in range(12)] + [(None, 1, 1), (3, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = operator(docs, some).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
    assert operator(documents(spark, []), some).isEmpty()


def test_drop_toxic_keeps_columns(spark):
    docs = documents(spark, corpus(), clashes=True)
    labels = spark.createDataFrame([(k, 0) for k in range(50)], "doc_id long, toxic int")
    out = toxicity.drop_toxic(docs, labels)
    assert out.columns == docs.columns and out.count() == docs.count()


# --- language models


class Slow:
    """A model of some documents, in dictionaries; ``scale`` matches its size."""

    def __init__(self, split, ids, scale, vocabulary):
        self.word, self.pair, self.ends = Counter(), Counter(), Counter()
        for k in ids:
            self.word.update(split[k])
            self.pair.update(zip(split[k], split[k][1:], strict=False))
            self.ends.update(split[k][-1:])
        self.total, self.scale, self.vocabulary = sum(self.word.values()), scale, vocabulary

    def base(self, w):
        return (self.word[w] * self.scale + lm_scoring.PRIOR) / (self.total * self.scale + lm_scoring.PRIOR * self.vocabulary)

    def p(self, v, w):
        return (self.pair[v, w] * self.scale + lm_scoring.STRENGTH * self.base(w)) / (self.word[v] * self.scale + lm_scoring.STRENGTH)

    def loss(self, words):
        return (-math.log(self.base(words[0])) - sum(math.log(self.p(v, w)) for v, w in zip(words, words[1:], strict=False))) / len(words)


def test_losses_against_counting(spark):
    rows = [r[:2] for r in corpus(5, 40)]
    docs = documents(spark, rows)
    target = {k for k, _ in rows if k % 4 == 0}
    models = lm_scoring.fit(docs, spark.createDataFrame([(k,) for k in target], "doc_id long"))
    got = {r.doc_id: r for r in lm_scoring.score(docs, models).collect()}
    split = {k: t.split() for k, t in rows}
    scale = sum(len(split[k]) for k in target) / sum(map(len, split.values()))
    for k, _ in rows[:20]:
        for ids, by, name in ((target, 1, "target_loss"), (set(split), scale, "background_loss")):
            m = Slow(split, ids - {k}, by, lm_scoring.WORDS)  # without the document itself
            assert got[k][name] == pytest.approx(m.loss(split[k]), rel=1e-9)
    every, m = set().union(*split.values()), Slow(split, target, 1, lm_scoring.WORDS)
    for v in list(every)[:20]:
        unseen = (lm_scoring.WORDS - len(every)) * m.p(v, "not met")
        assert sum(m.p(v, w) for w in every) + unseen + m.ends[v] / (m.word[v] + lm_scoring.STRENGTH) == pytest.approx(1)
    assert np.mean([got[k].score for k in target]) < np.mean([got[k].score for k, _ in rows if k not in target])


def test_losses_of_many_words(spark, monkeypatch):
    """More words and pairs than any fixed number of classes, in several batches and buckets."""
    monkeypatch.setattr(lm_scoring, "TOKENS", 150_000)
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", 1 << 20)
    r = random.Random(8)
    rows = [(k, " ".join(f"x{r.randrange(400_000)}" for _ in range(20_000))) for k in range(60)]
    rows += [(100 + k, "the cat sat. the cat ran é") for k in range(3)]
    docs = documents(spark, rows)
    target = {k for k, _ in rows if k % 3 == 0}
    models = lm_scoring.fit(docs, spark.createDataFrame([(k,) for k in target], "doc_id long"))
    split = {k: t.split() for k, t in rows}
    seen = {w for words in split.values() for w in words}
    assert len(seen) > lm_scoring.WORDS and models.buckets > 4
    got = {x.doc_id: x for x in lm_scoring.score(docs, models).collect()}
    other = [(7, rows[3][1]), (8, "the cat ran away"), (9, None)]
    apart = {x.doc_id: x for x in lm_scoring.score(documents(spark, other), models).collect()}
    scale = sum(len(split[k]) for k in target) / sum(map(len, split.values()))
    for ids, by, name in ((target, 1, "target_loss"), (set(split), scale, "background_loss")):
        for k in (0, 1, 59, 100, 101, 102):
            assert got[k][name] == pytest.approx(Slow(split, ids - {k}, by, len(seen)).loss(split[k]), rel=1e-9)
        whole = Slow(split, ids, by, len(seen))  # of documents that were not counted nothing is taken out
        assert sum(whole.base(w) for w in seen) == pytest.approx(1)
        for k, t in other[:2]:
            assert apart[k][name] == pytest.approx(whole.loss(t.split()), rel=1e-9)
    assert apart[9].n_tokens == 0 and apart[9].score == 0


def test_lm_edges(spark):
    docs = documents(spark, edge_rows(), clashes=True)
    none = spark.createDataFrame([], "doc_id long")
    got = lm_scoring.score(docs, lm_scoring.fit(docs, none)).collect()
    assert len(got) == len(edge_rows()) and all(r.score == 0 for r in got)
    assert lm_scoring.score(documents(spark, []), lm_scoring.fit(documents(spark, []), none)).isEmpty()


# --- licences


def test_licences(spark):
    s = licenses.SENTENCES
    mit = f"{s['mit-title']}\n\nCopyright (c) X\n\n{s['mit-grant']}\n\n{s['mit-condition']}.\n\n{s['mit-warranty']}. IN NO EVENT ..."
    texts = [mit, "x y. Licensed under the Apache License, Version 2.0.\nmore", "ALL   rights -- reserved.", "Released under the MIT License.\nReleased under the MIT License. " + s["gpl-hope"], None, "", "nothing"]
    got = licenses.scan(documents(spark, list(enumerate(texts)), clashes=True)).orderBy("doc_id").collect()
    assert [r.licences for r in got] == ["MIT", "Apache-2.0", "LicenseRef-all-rights-reserved", "MIT", "", "", ""]
    assert got[0].n_known == 4 and got[3].rest == "gpl-hope"
    assert len(licenses.scan(documents(spark, edge_rows())).collect()) == len(edge_rows())
    assert licenses.scan(documents(spark, [])).isEmpty()


# --- personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def holds(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        doubled = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(digits))))
        return 13 <= len(digits) <= 19 and doubled % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_personal_data(spark):
    r = random.Random(3)
    rows = [(k, "".join(r.choice("ab1234567890@@..--  +()%_é😀:5") for _ in range(r.randint(0, 60)))) for k in range(1500)]
    rows += [(2000 + k, t) for k, (_, t) in enumerate(edge_rows())]
    rows += [(3000, "a@b.c%x@d.e 😀 1.2.3.4.5.6.7.8 x@y@z.com"), (3001, "1" * 5000), (3002, "a" * 100_000), (3003, "x@y.zz " * 2000), (3004, "a." * 20000 + "@b" + ".c" * 20000), (3005, "+1" + " (" * 3000)]
    got = {x.doc_id: x for x in pii.digests(pii.personal_data(documents(spark, rows, clashes=True))).collect()}
    for k, t in rows:
        base = {kind: [m.span() for m in re.finditer(p, t or "") if holds(kind, m.group())] for kind, p in PATTERNS.items()}
        spans = [f"{kind}:{a}:{b}" for kind in PATTERNS for a, b in base[kind]]
        assert [got[k][f"n_{kind}"] for kind in PATTERNS] == [len(base[kind]) for kind in PATTERNS]
        assert got[k].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(got[k].spans.split(",")) | {""}
    assert pii.digests(pii.personal_data(documents(spark, []))).isEmpty()


def test_candidates_and_redaction(spark):
    text = "call (415) 555-1234 or joe[at]mail[dot]com, order no 123 456 789, me@x.org"
    docs = documents(spark, [(1, text)])
    assert pii.digests(pii.personal_data(docs)).first().spans == "email:23:42,email:66:74,phone:5:19"
    assert pii.redact(docs).first().text == "call [phone] or [email], order no 123 456 789, [email]"


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "source_mixing", "best_fit_packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = docs
    for name, stage in P.STAGES[:3]:
        out = stage(spark, seen, DATA)
        assert out.columns == docs.columns, name
        before, after = ({r.doc_id: r.text for r in x.select("doc_id", "text").collect()} for x in (seen, out))
        if name == "exact_dedup":
            last = {t: max(k for k, v in before.items() if v == t) for t in set(before.values())}
            assert set(after) == set(last.values())
        if name == "simhash_near_dedup":
            rows = [(k, slow_fingerprint(t)) for k, t in before.items()]
            assert set(after) == {k for (k, _), c in zip(rows, brute_components(rows), strict=True) if k == c}
        assert all(before[k] == t for k, t in after.items())
        seen = spark.createDataFrame(out.collect(), docs.schema)
    mixed = Counter(r.doc_id for r in P.STAGES[3][1](spark, seen, DATA).collect())
    assert max(mixed.values()) <= 3 and set(mixed) <= {r.doc_id for r in seen.collect()}
    final = P.run(spark, DATA).collect()
    assert Counter(r.doc_id for r in final if r.piece == 0) == mixed
