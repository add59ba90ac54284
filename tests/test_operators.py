import math

import pytest
from pyspark.sql import functions as F

from scorelens.operators import dedup, pixels, prefix, regions, scores, units
from scorelens.operators.regions import MaskConfig

PIECES = ["Hel", "lo", ",", " wor", "ld", "!?", " ", "  ", "\n", "x_1", "(", "a", ".b", "--", " -", "é", "ok"]
UNITS = [("Hello", "word"), (",", "punct"), (" world", "word"), ("!?", "punct"), (" ", "space"), ("  ", "space"), ("\n", "space"), ("x_1", "word"), ("(", "punct"), ("a.b", "word"), ("--", "punct"), (" -", "punct"), ("éok", "word")]


def tokens(spark, pieces):
    rows = [(1, k, k, p, p, -1.0 - k, -2.0 - k, math.exp(-1.0 - k), math.exp(-2.0 - k)) for k, p in enumerate(pieces)]
    return spark.createDataFrame(rows, "response_id int, token_index int, token_id int, raw_token string, token string, logp_original double, logp_masked double, p_original double, p_masked double")


def test_units(spark):
    got = units.units_of_tokens(tokens(spark, PIECES)).orderBy("unit").collect()
    assert [(r.raw_text, r.unit_type) for r in got] == UNITS
    assert [r.text for r in got if r.unit_type != "space"] == [u.strip() for u, k in UNITS if k != "space"]
    ends = [r.token_end for r in got]
    assert [r.token_start for r in got] == [0, *ends[:-1]] and ends[-1] == len(PIECES)
    assert sum(r.token_count for r in got) == len(PIECES)
    assert sum(r.sum_logp_original for r in got) == pytest.approx(sum(-1.0 - k for k in range(len(PIECES))))


def test_unit_aggregates(spark):
    r = units.units_of_tokens(tokens(spark, ["a", "b"])).first()
    assert (r.sum_logp_original, r.mean_logp_original, r.sum_logp_masked) == (-3.0, -1.5, -5.0)
    assert r.p_original == pytest.approx(math.exp(-3)) and r.image_dependency_logp == 1.0
    assert (r.token_start, r.token_end, r.token_ids) == (0, 2, [0, 1])


def test_units_of_text_agree_with_rows(spark):
    docs = spark.createDataFrame([(1, "Hello, wörld!?\n\n x_1 (a.b)-- ok"), (2, ""), (3, None)], "doc_id int, text string")
    got = units.units_of_text(docs, "doc_id", "text").orderBy("doc_id", "unit").collect()
    assert {r.doc_id for r in got} == {1}
    assert "".join(r.raw_text for r in got) == "Hello, wörld!?\n\n x_1 (a.b)-- ok"


def test_token_statistics(spark):
    logits = spark.createDataFrame([(1, 0, 0, [0.0, math.log(3)])], "response_id int, token_index int, token_id int, z array<double>")
    r = scores.token_statistics(logits).first()
    assert r.p == pytest.approx(0.25) and r.logp == pytest.approx(math.log(0.25))
    assert r.top_token_id == 1 and r.top_p == pytest.approx(0.75)


def test_topk_ties_and_sum(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0, 2.0, 0.0])], "vec_id int, z array<double>")
    got = scores.next_token_topk(v, "vec_id", 3).orderBy("rank").collect()
    assert [r.token_id for r in got] == [1, 2, 0] and [r.rank for r in got] == [1, 2, 3]
    assert sum(r.probability for r in scores.next_token_topk(v, "vec_id", 9).collect()) == pytest.approx(1)


def test_trim_tail(spark):
    rows = [(1, k, t) for k, t in enumerate([5, 0, 7, 2, 0])] + [(2, k, t) for k, t in enumerate([0, 2])]
    got = scores.trim_tail(spark.createDataFrame(rows, "response_id int, token_index int, token_id int"), [0, 2]).orderBy("token_index").collect()
    assert [(r.response_id, r.token_id) for r in got] == [(1, 5), (1, 0), (1, 7)]


@pytest.mark.parametrize("p, want", [(0.5, 72.0), (1.2, 136.0), (-1.0, 8.0)])
def test_hue(spark, p, want):
    assert spark.range(1).select(scores.hue(F.lit(p)).alias("x")).first().x == want


def test_dedup_with_manifest(spark):
    manifest = spark.createDataFrame([], "text string").select(F.sha2("text", 256).alias("hash"), F.lit(1).alias("unique_index"))
    manifest = manifest.unionByName(spark.range(1).select(F.sha2(F.lit("a"), 256).alias("hash"), F.lit(1).alias("unique_index")))
    got = dedup.deduplicate(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "seq long, text string"), "strip", "seq", manifest=manifest)
    assert [(r.is_unique, r.unique_index) for r in got.orderBy("seq").collect()] == [(False, None), (True, 2), (False, None), (True, 3)]


def test_dedup_again_finds_nothing(spark):
    rows = spark.createDataFrame([(k, str(k % 7)) for k in range(50)], "seq long, text string")
    once = dedup.deduplicate(rows, "strip", "seq").where("is_unique")
    assert once.count() == 7
    assert dedup.deduplicate(rows, "strip", "seq", manifest=once.select("hash", "unique_index")).where("is_unique").count() == 0


def test_prefix(spark):
    rows = spark.createDataFrame([(2, 30), (0, 10), (1, 20)], "index int, token_id int")
    assert prefix.checked_prefix(rows, 2) == [10, 20, 30] and prefix.checked_prefix(rows, 1) == [10, 20]
    for end in (5, -1):
        with pytest.raises(ValueError):
            prefix.checked_prefix(rows, end)


@pytest.mark.parametrize("indexes", [[0, 2], [1, 2], [0, 0, 1]])
def test_prefix_gaps(spark, indexes):
    rows = spark.createDataFrame([(1, k, 5) for k in indexes], "g int, index int, token_id int")
    with pytest.raises(ValueError):
        prefix.checked_prefix(rows, max(indexes))
    assert not prefix.validity(rows, "g").first().is_valid
    assert prefix.prefix_ids(rows, "g").isEmpty()


def test_parse_ids(spark):
    one = spark.range(1)
    assert one.select(prefix.parse_ids(F.lit("271, 91,,")).alias("x")).first().x == [271, 91]
    for bad in (" , ", "x"):
        with pytest.raises(Exception):
            one.select(prefix.parse_ids(F.lit(bad))).collect()


def test_append_ids(spark):
    rows = spark.createDataFrame([([1, 2], [1, 1], [0, 1])], "input_ids array<int>, attention_mask array<int>, token_type_ids array<int>")
    r = prefix.append_ids(rows, F.array(F.lit(7), F.lit(8))).first()
    assert (r.input_ids, r.attention_mask, r.token_type_ids) == ([1, 2, 7, 8], [1, 1, 1, 1], [0, 1, 0, 0])
    with pytest.raises(Exception):
        prefix.append_ids(rows, F.array().cast("array<int>")).collect()


def test_runs(spark):
    rows = spark.createDataFrame([(1, p) for p in (0, 1, 4, 8)], "k int, p int")
    got = sorted(tuple(r)[1:] for r in regions.runs(rows, ["k"], "p", 2).collect())
    assert got == [(0, 5), (8, 9)]


def test_patch_grid(spark):
    got = regions.patch_grid(spark.createDataFrame([(1, 70, 40)], "k int, width int, height int"), "k", 32).orderBy("y1", "x1").collect()
    assert len(got) == 6 and tuple(got[-1])[1:] == (64, 32, 70, 40)


@pytest.mark.parametrize("n, ratio, k", [(5, 0.5, 2), (7, 0.5, 4), (3, 0.1, 1), (9, 0, 0), (9, 1, 9), (0, 0.5, 0)])
def test_sampled(spark, n, ratio, k):
    rows = spark.createDataFrame([(1, i, 0, i + 1, 1) for i in range(n)], "k int, x1 int, y1 int, x2 int, y2 int")
    first = regions.sampled(rows, "k", ratio, 7).collect()
    assert len(first) == k and sorted(first) == sorted(regions.sampled(rows.repartition(3), "k", ratio, 7).collect())


@pytest.mark.parametrize("box, size, want", [([0.1, 0.2, 0.5, 0.4], (200, 100), (20, 20, 100, 40)), ([50, 60, 10, 20], (400, 300), (10, 20, 50, 60)), ([0.5, 1.5, 2.5, 3.5], (400, 300), (0, 2, 2, 4)), ([390, 0, 500, 20], (400, 300), (390, 0, 400, 20)), ([5, 5, 5, 9], (400, 300), None)])
def test_box_to_region(spark, box, size, want):
    rows = spark.createDataFrame([([float(b) for b in box], *size)], "box array<double>, width int, height int")
    got = [tuple(r) for r in regions.box_to_region(rows).select(*regions.BOX).collect()]
    assert got == ([want] if want else [])


def test_json_boxes(spark):
    rows = spark.createDataFrame([('{"bbox":[1,2,3,4],"words":[{"box":[5,6,7,8]}]}',), ("nope",), (None,)], "text string")
    assert sorted(r.box for r in regions.boxes_of_json(rows).collect()) == [[1, 2, 3, 4], [5, 6, 7, 8]]


def test_clipped(spark):
    r = regions.clipped(spark.createDataFrame([(3, 3, 8, 8, 10, 10)], "x1 int, y1 int, x2 int, y2 int, width int, height int"), 5).first()
    assert tuple(r)[:4] == (0, 0, 10, 10)


@pytest.mark.parametrize("gap, want", [(2, [(0, 1, 5, 5), (8, 1, 12, 5)]), (3, [(0, 1, 12, 5)])])
def test_detect_words(spark, gap, want):
    dark = {(y, x) for y in range(1, 5) for x in [*range(5), *range(8, 12)]}
    rows = spark.createDataFrame([(1, y, x, 0 if (y, x) in dark else 255) for y in range(6) for x in range(12)], "image int, y int, x int, gray int")
    images = spark.createDataFrame([(1, 12, 6)], "image int, width int, height int")
    got = pixels.detect_words(rows, images, 100, gap, 4, 4).orderBy("x1").collect()
    assert [tuple(r)[1:] for r in got] == want


def gray(spark, value, n=8):
    return spark.createDataFrame([(1, y, x, value) for y in range(n) for x in range(n)], "image int, y int, x int, gray int")


def boxes(spark, *rows):
    return spark.createDataFrame([(1, *r) for r in rows], "image int, x1 int, y1 int, x2 int, y2 int")


def test_degrade(spark):
    black = MaskConfig(opacity=0.5, fill="black")
    got = {(r.y, r.x): r.value for r in pixels.degrade(gray(spark, 201), boxes(spark, (0, 0, 4, 4)), black).collect()}
    assert got[0, 0] == 100 and got[7, 7] == 201
    got = {(r.y, r.x): r.value for r in pixels.degrade(gray(spark, 100), boxes(spark, (0, 0, 4, 4), (2, 2, 6, 6)), black).collect()}
    assert (got[3, 3], got[0, 0], got[5, 5], got[7, 7]) == (25, 50, 50, 100)
    same = pixels.degrade(gray(spark, 100), boxes(spark, (0, 0, 4, 4)), MaskConfig(opacity=0))
    assert {r.value for r in same.collect()} == {100}


def test_degrade_blur_keeps_flat_image(spark):
    got = pixels.degrade(gray(spark, 100), boxes(spark, (0, 0, 4, 4)), MaskConfig(effect="blur"))
    assert {r.value for r in got.collect()} <= {99, 100}


@pytest.mark.parametrize("change", [{"ratio": 1.1}, {"patch_size": 0}, {"opacity": -0.1}, {"text_threshold": 256}, {"word_min_width": 0}, {"fill": "pink"}])
def test_config(change):
    with pytest.raises(ValueError):
        MaskConfig(**change).validate()


@pytest.mark.parametrize("strategy, effect, fill", [("patch", "replace", "mean"), ("patch", "noise", "mean"), ("patch", "blur_fade", "white"), ("word", "fade", "noise")])
def test_apply_mask(spark, strategy, effect, fill):
    rows = spark.createDataFrame([(1, y, x, 0 if 4 <= y < 10 and (x % 12) < 8 else 200) for y in range(16) for x in range(40)], "image int, y int, x int, gray int")
    images = spark.createDataFrame([(1, 40, 16)], "image int, width int, height int")
    config = MaskConfig(strategy=strategy, effect=effect, fill=fill, patch_size=8, word_gap=2, text_threshold=100, ratio=0.5)
    done, selected, counts = pixels.apply_mask(rows, images, config)
    c = counts.first()
    assert (c.num_candidates, c.num_selected) == ((10, 5) if strategy == "patch" else (4, 2)) and selected.count() == c.num_selected
    values = {(r.y, r.x): r.value for r in done.collect()}
    assert len(values) == 640 and all(0 <= v <= 255 for v in values.values())
    inside = {(y, x) for r in selected.collect() for y in range(r.y1, r.y2) for x in range(r.x1, r.x2)}
    before = {(r.y, r.x): r.gray for r in rows.collect()}
    assert all(values[k] == before[k] for k in before if k not in inside)
    assert sorted(done.collect()) == sorted(pixels.apply_mask(rows.repartition(3), images, config)[0].collect())


def test_keys_that_are_never_looked_into(spark):
    texts = ['{"bbox": {"box": [1, 2, 3, 4]}}', '{"x": [1, 2, 3, 4]}', '{"bbox": [[1, 2, 3, 4]]}', '{"x": "1", "y": "2", "w": "3", "h": "4"}', '{"x": null, "y": 1, "w": 1, "h": 1, "box": [1, 2, 3, 4]}', "[[true, 2, 3, 4]]"]
    got = regions.boxes_of_json(spark.createDataFrame(list(enumerate(texts)), "k int, text string"))
    assert sorted((r.k, r.box) for r in got.collect()) == [(3, [1, 2, 4, 6]), (5, [1, 2, 3, 4])]


def test_dedup_of_odd_sequences(spark):
    """Sequence numbers that repeat, are missing or lie far off."""
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "a"), (None, "c"), (10**15, "d"), (-(10**15), "e"), (2, "b"), (3, None)]
    got = dedup.deduplicate(spark.createDataFrame(rows, "seq long, text string").repartition(5), "strip", "seq").collect()
    unique = {r.text: (r.unique_index, r.seq) for r in got if r.is_unique}
    assert {t: s for t, (_, s) in unique.items()} == {"e": -(10**15), "a": 1, "b": 1, "d": 10**15, "c": None, None: 3}
    assert sorted(n for n, _ in unique.values()) == [1, 2, 3, 4, 5, 6] and unique["e"][0] == 1 and unique["c"][0] == 6
    assert sum(r.unique_index is not None for r in got) == 6 and len(got) == len(rows)


def test_many_uniques_are_numbered_in_order(spark):
    rows = spark.range(5_000).selectExpr("id * id AS seq", "concat('t', id % 1700) AS text").repartition(7)
    got = dedup.deduplicate(rows, "exact", "seq", kept=["seq"]).where("is_unique").orderBy("seq").collect()
    assert [r.unique_index for r in got] == list(range(1, 1701)) and "text" not in got[0].asDict()


def test_units_of_a_long_text_take_linear_time(spark):
    import time

    took = []
    for n in (20_000, 20_000, 160_000):
        docs = spark.createDataFrame([(1, " ".join(f"w{k % 977}" for k in range(n)))], "doc_id int, text string")
        began = time.perf_counter()
        assert units.units_of_text(docs, "doc_id", "text").count() == n
        took.append(time.perf_counter() - began)
    assert took[2] < 12 * took[1] + 2


@pytest.mark.parametrize("effect", ["replace", "fade", "blur", "noise", "blur_fade"])
def test_colour_channels_are_degraded_apart(spark, effect):
    """Each channel of a colour image is what the same grey image gives."""
    rows = [(1, y, x, (y * 7 + x * 3) % 256) for y in range(12) for x in range(20)]
    gray_ = spark.createDataFrame(rows, "image int, y int, x int, gray int")
    colour = gray_.select("image", "y", "x", F.col("gray").alias("r"), F.lit(9).alias("g"), F.col("gray").alias("b"))
    config = MaskConfig(effect=effect, opacity=0.7, fill="mean")
    where = boxes(spark, (0, 0, 9, 9), (4, 4, 20, 12))
    a = {(r.y, r.x): r.value for r in pixels.degrade(gray_, where, config).collect()}
    b = {(r.y, r.x): r for r in pixels.degrade(colour, where, config).collect()}
    if effect != "noise":
        assert all(a[k] == b[k].r == b[k].b and b[k].g in (8, 9) for k in a)
    else:
        assert any(b[k].r != b[k].b for k in a)
    outside = [(y, x) for _, y, x, _ in rows if not (y < 9 and x < 9) and not (y >= 4 and x >= 4)]
    assert all((b[k].r, b[k].g) == (dict(((y, x), v) for _, y, x, v in rows)[k], 9) for k in outside[:20])


def test_no_radius_no_blur(spark):
    got = pixels.degrade(gray(spark, 100), boxes(spark, (0, 0, 4, 4)), MaskConfig(effect="blur", blur_radius=0))
    assert {r.value for r in got.collect()} == {100}


def _words_model(spark):
    from scorelens.operators import generate

    vocab = spark.createDataFrame([(0, ""), (1, " a"), (2, "b"), (3, " c")], "token_id int, raw_token string")
    table = spark.createDataFrame([(0, [0.0, 9.0, 0.0, 0.0]), (1, [0.0, 0.0, 2.0, 1.0]), (2, [0.0, 0.0, 0.0, 5.0]), (3, [7.0, 0.0, 0.0, 0.0])], "last_id int, z array<double>")
    return generate.Bundle(vocab, generate.table_model(table), (0,), (0,))


def test_generation(spark):
    from scorelens.operators import generate

    model = _words_model(spark)
    inputs = spark.createDataFrame([(k, [k % 4], [1]) for k in range(12)] + [(99, [77], [1])], "id int, input_ids array<int>, attention_mask array<int>").repartition(3)
    got = {r.id: (r.token_ids, r.text) for r in generate.from_prompts(inputs, model, "id", 10).collect()}
    assert got[0] == ([1, 2, 3], "ab c") and got[3] == ([], "") and got[2] == ([3], "c") and got[99] == ([], "")
    got = {r.id: r for r in generate.from_prefilled(inputs, F.array(F.lit(3), F.lit(1)), model, "id", 1).collect()}
    assert (got[5].continuation_ids, got[5].continuation_text, got[5].full_ids, got[5].full_text) == ([2], "b", [3, 1, 2], "c ab")
    with pytest.raises(Exception, match="no tokens"):
        generate.from_prefilled(inputs, F.array().cast("array<int>"), model, "id", 1).collect()


def test_sampling(spark):
    """The same for every run; a small top_p is greedy; frequencies follow the logits."""
    from scorelens.operators import generate

    model = _words_model(spark)
    inputs = spark.createDataFrame([(k, [1], [1]) for k in range(4000)], "id int, input_ids array<int>, attention_mask array<int>")
    first = lambda **k: {r.id: tuple(r.token_ids) for r in generate.generated(inputs, model, "id", 1, do_sample=True, **k).collect()}
    a = first(temperature=0.7, top_p=0.95)
    assert a == {r.id: tuple(r.token_ids) for r in generate.generated(inputs.repartition(5), model, "id", 1, do_sample=True, temperature=0.7, top_p=0.95).collect()}
    assert set(first(top_p=0.01).values()) == {(2,)}
    got, total = first(), sum(math.exp(x) for x in (0, 0, 2, 1))
    for t, z in ((1, 0), (2, 2), (3, 1)):
        assert abs(sum(x == (t,) for x in got.values()) / 4000 - math.exp(z) / total) < 0.03
    assert first(temperature=0.01).values() and set(first(temperature=0.01).values()) == {(2,)}


def test_prompt_inputs(spark):
    from scorelens.operators import generate

    vocab = spark.createDataFrame([(0, "Hell"), (1, "o"), (2, ",")], "token_id int, raw_token string")
    rows = spark.createDataFrame([(1, "Hello, o"), (2, ""), (3, None)], "id int, text string")
    got = {r.id: (r.input_ids, r.attention_mask) for r in generate.prompt_inputs(rows, vocab, "id", "text", 9).collect()}
    assert got == {1: ([0, 1, 2, 9], [1, 1, 1, 1]), 2: ([], []), 3: ([], [])}


def test_units_of_text_are_those_of_its_pieces(spark):
    """Matched as a whole, and found from the tokeniser's pieces one by one."""
    import random

    r = random.Random(3)
    texts = ["".join(r.choice("aBé_9 \n\t\r.,-!　😀́") for _ in range(r.randint(0, 60))) for _ in range(400)] + ["a" * 9, " abcd", "\n\nabcde", ".....", "a  b", "\tx"]
    docs = spark.createDataFrame(list(enumerate(texts)), "response_id int, text string")
    got = units.units_of_text(docs, "response_id", "text")
    from scorelens.functions import text as T

    pieces = docs.select("response_id", F.posexplode(T.pieces(F.col("text"))).alias("token_index", "raw_token"))
    scored = pieces.selectExpr("*", "raw_token AS token", "token_index AS token_id", *(f"0.0D AS {x}_{c}" for x in ("logp", "p") for c in ("original", "masked")))
    same = ["response_id", "unit", "unit_type", "token_start", "token_end", "token_count", "raw_text", "text"]
    want = units.units_of_tokens(scored).select(*same)
    assert sorted(map(tuple, got.select(*same).collect())) == sorted(map(tuple, want.collect()))
