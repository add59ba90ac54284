"""The pipeline's stages on odd tables: nulls, repeats, nothing at all, clashing names."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as P
from pyspark.sql import functions as F

from scorelens.llm import toxicity

from .test_llm import brute_components, brute_targets, slow_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ("row", "score", "digest", "fp", "size", "u", "copies", "length", "nth")


def table(spark, rows, clashes=False):
    docs = spark.createDataFrame(rows, SCHEMA)
    return docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in NAMES}) if clashes else docs


def odd_rows():
    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.choice([5, 40, 300]))), "en", r.choice(["a", "b", None]), 0) for k in range(120)]
    rows += [(200 + k, rows[k % 7][1], "en", "a", 0) for k in range(30)]
    rows += [(300 + k, rows[k][1] + " more", "en", "b", 0) for k in range(20)]
    rows += [(None, None, None, None, None), (None, "only text here", None, None, None), (400, None, "en", "a", 0), (401, "", "en", "a", 0), (402, " \n ", "en", "a", 0)]
    rows += [(500, "the same row", "en", "a", 0)] * 3 + [(501, "x " * 50_000, "en", "b", 0), (502, " " * 100_000, "en", "b", 0), (503, "you idiot and moron " * 9, "en", "b", 0)]
    return rows


def sizes(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", x[1] or "")) for x in rows]


def test_stages_by_brute_force(spark, tmp_path):
    """Each stage on what the one before kept, with columns that clash."""
    rows = odd_rows()
    spark.createDataFrame([(k, int(k == 503), 1) for k in [*range(100), 503]], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    data = str(tmp_path)
    docs = table(spark, rows, clashes=True)
    model = toxicity.fit(docs, spark.read.parquet(f"{data}/labels.parquet"))
    kept = P.STAGES[0][1](spark, docs, data)
    assert kept.columns == docs.columns
    got = Counter(tuple(x)[:2] for x in kept.collect())
    assert got == Counter(x[:2] for x, s in zip(rows, model.score([x[1] for x in rows]), strict=True) if s < 0.5)

    kept = spark.createDataFrame(kept.collect(), docs.schema)
    before = [tuple(x) for x in kept.collect()]
    kept = P.STAGES[1][1](spark, kept, data)
    after = [tuple(x) for x in kept.collect()]
    last = {}
    for x in before:
        last[x[1] or ""] = max(last.get(x[1] or "", -1), -1 if x[0] is None else x[0])
    assert kept.columns == docs.columns and Counter((x[1] or "", -1 if x[0] is None else x[0]) for x in after) == Counter(last.items())

    kept = spark.createDataFrame(after, docs.schema)
    near = P.STAGES[2][1](spark, kept, data)
    of = brute_components([(x[0], slow_fingerprint(x[1])) for x in after])
    least = defaultdict(list)
    for x, c in zip(after, of, strict=True):
        least[c].append(x)
    assert near.columns == docs.columns and Counter(x.doc_id for x in near.collect()) == Counter(list(least))

    rows = [tuple(x) for x in near.collect()]
    mixed = P.STAGES[3][1](spark, spark.createDataFrame(rows, docs.schema), data)
    assert mixed.columns == docs.columns
    times = Counter(tuple(x) for x in mixed.collect())
    assert set(times) <= set(rows) and max(times.values()) <= 3
    own, taken = Counter(), Counter()
    for x, n in zip(rows, sizes(rows), strict=True):
        own[x[3]] += n
        taken[x[3]] += n * times[x]
        assert n or not times[x]
    for s, target in brute_targets(own).items():
        most = max((n for x, n in zip(rows, sizes(rows), strict=True) if x[3] == s), default=0)
        assert target - most <= taken[s] <= target + 1e-6

    packed = P.STAGES[4][1](spark, mixed, data).collect()
    assert Counter(x.doc_id for x in packed if x.piece == 0) == Counter(k[0] for k, n in times.items() for _ in range(n))
    by = defaultdict(list)
    for x in packed:
        by[x.sequence_id].append((x.offset, x.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024


def test_stages_on_nothing(spark, tmp_path):
    spark.createDataFrame([(1, 1, 1), (2, 0, 0)], "doc_id long, toxic int, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    table(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).isEmpty()
    for name, stage in P.STAGES:
        assert stage(spark, table(spark, [], clashes=True), str(tmp_path)).isEmpty(), name


def test_only_the_result_stays(spark, tmp_path, monkeypatch):
    from scorelens.llm import common

    monkeypatch.setattr(P, "shared_folder", lambda _: str(tmp_path / "shared"))
    assert common.shared_folder(spark)
    P.run(spark, "/root/testdata/sf0.001")
    assert [x.name for x in (tmp_path / "shared").glob("pipeline-*/*")] == [P.STAGES[-1][0]]
