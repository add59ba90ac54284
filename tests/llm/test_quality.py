"""What stands late in a long text counts as well."""

import random

from scorelens.llm import quality


def test_blocks_from_all_over():
    texts = [bytes([97 + k]) * quality.BLOCK for k in range(20)]
    whole = b"".join(texts).decode()
    got = [quality.blocks(i, whole) for i in range(200)]
    assert all(len(g) == quality.SAMPLE_BYTES // quality.BLOCK for g in got)
    assert {part for g in got for part in g} == set(texts)
    assert quality.blocks(1, None) == [] and quality.blocks(1, "short") == [b"short"]


def test_marks_after_the_start(spark):
    """Good and bad texts start alike and differ after their first 4 KB."""
    r = random.Random(4)
    words = ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    say = lambda w, n: " ".join(r.choice(w) for _ in range(n))
    rows = [(k, say(words, 700) + " " + say(words[:200] if k % 2 else [w[::-1].upper() for w in words[:200]], 2_000)) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id long, quality int"))
    held = b"".join(d for pair in model.pairs for d in pair[1:])
    assert sum(w[::-1].upper().encode() in held for w in words[:200]) > 150


def test_scores_by_plain_compression(spark):
    """Every score from the dictionaries by zstandard itself, block by block; held-out rows and
    rows set aside for calibration fill no dictionary."""
    import math
    import zlib

    import zstandard as z

    r = random.Random(9)
    good, bad = (["".join(r.choice(letters) for _ in range(5)) for _ in range(300)] for letters in ("abcdefgh", "mnopqrst"))
    texts = {k: " ".join(r.choice(good if k % 2 else bad) for _ in range(r.choice([0, 5, 80, 900]))) for k in range(300)}
    docs = spark.createDataFrame([*texts.items(), (1000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in texts], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = {x.doc_id: x for x in quality.quality(docs, labels).collect()}
    tools = [[z.ZstdCompressor(level=quality.LEVEL, dict_data=z.ZstdCompressionDict(d), write_checksum=False, write_content_size=False, write_dict_id=False) for d in pair] for pair in model.pairs]
    for k, t in [*texts.items(), (1000, "")]:
        data = t.encode()
        parts = [data[i : i + quality.BLOCK] for i in range(0, len(data), quality.BLOCK)]
        less = sum(len(b.compress(p)) - len(g.compress(p)) for p in parts for g, b in tools) / max(1, len(data))
        score = 1 / (1 + math.exp(-(model.curve[0] + model.curve[1] * (less - model.centre) / model.scale)))
        assert abs(got[k].score - score) < 1e-9 and got[k].predicted == (score >= 0.3)
        assert got[k].held_out == (zlib.crc32(str(k).encode()) % 5 == 0)
    held = [x for x in got.values() if x.held_out and texts.get(x.doc_id, "").count(" ") > 50]
    assert sum((x.score >= 0.5) == (x.doc_id % 2 == 1) for x in held) > 0.95 * len(held)
