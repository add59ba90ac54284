"""Exact copies: rows that repeat an id, and columns named like those used inside."""

import random

from scorelens.llm import exact_dedup

NAMES = ("row", "id", "digest", "id_", "digest_", "i", "d", "last", "kept", "top", "rid", "check", "bytes", "group_size")


def test_one_row_of_each_text(spark):
    r = random.Random(3)
    rows = [(r.choice([None, *range(20)]), r.choice(["", None, "hot", "hot", "hot", *(f"t{k}" for k in range(30))])) for _ in range(300)]
    rows = [(*x, *(f"{n}{k}" for n in NAMES)) for k, x in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in NAMES))
    for heavy in (1, 256):
        out = exact_dedup.drop_copies(docs, heavy=heavy)
        assert out.columns == docs.columns
        got = [tuple(x) for x in out.collect()]
        assert set(got) <= set(rows) and len(got) == len({t or "" for _, t, *_ in rows})
        for x in got:
            assert x[0] == max((y[0] for y in rows if (y[1] or "") == (x[1] or "") and y[0] is not None), default=None)
        groups = exact_dedup.groups(docs, heavy=heavy).collect()
        assert sum(x.kept for x in groups) == len(got) and len(groups) == len(rows)
        sizes = {x.text_sha256: x.group_size for x in groups}
        assert sum(sizes.values()) == len(rows)
