import json

import pytest
from pyspark.sql import functions as F

from scorelens.operators import scores, units
from scorelens.plans import catalog, cli
from scorelens.sources import readers, report, writers
from scorelens.streaming import unique


def test_manifest_lines(spark):
    lines = ['{"hash":"a"}', "", "  ", "not json", '{"hash":5}', '{"x":1}', '{"hash":"b"}', '{"hash":"a"}', '{"hash": "c', "[1]"]
    got = readers.hashes_of_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted(r.hash for r in got.select("hash").distinct().collect()) == ["a", "b"]


def test_missing_manifest_is_empty(spark, tmp_path):
    assert readers.manifest(spark, str(tmp_path / "none")).isEmpty()


def test_csv_keeps_awkward_tokens(spark, tmp_path):
    table = spark.createDataFrame([(k, t, [k, k + 1], k % 2 == 0) for k, t in enumerate(catalog.AWKWARD)], "index int, raw_token string, ids array<int>, flag boolean")
    writers.csv(table, str(tmp_path / "t.csv"), ["index", "raw_token", "ids", "flag"])
    got = readers.token_table(spark, str(tmp_path / "t.csv"), "index int, raw_token string, ids string, flag boolean").orderBy("index").collect()
    assert [r.raw_token for r in got] == catalog.AWKWARD
    assert got[1].ids == "[1,2]" and [r.flag for r in got[:2]] == [True, False]
    parts = [p.read_bytes() for p in (tmp_path / "t.csv").glob("part-*")]
    assert all(p.startswith(b"index,raw_token,ids,flag\r\n") and p.endswith(b"\r\n") for p in parts)


def test_image_roundtrip(spark, tmp_path):
    want = {(y, x): (10 * y, 20 * x, 30) for y in range(2) for x in range(3)}
    rows = spark.createDataFrame([(y, x, *c) for (y, x), c in want.items()], "y int, x int, r int, g int, b int")
    writers.rgb_image(rows, str(tmp_path / "sub/a.png"))
    got = readers.pixels(readers.images(spark, str(tmp_path / "sub/a.png")))
    assert {(r.y, r.x): (r.r, r.g, r.b) for r in got.collect()} == want


def test_stream_resumes(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for rows, want in (([(1, "a"), (2, "b"), (3, "b ")], [(1, 1), (2, 2), (3, None)]), ([(4, "c"), (5, "a"), (6, "d")], [(4, 3), (5, None), (6, 4)])):
        spark.createDataFrame(rows, "seq long, text string").coalesce(1).write.mode("append").parquet(source)
        unique.unique_loop(spark.readStream.schema("seq long, text string").parquet(source), out).awaitTermination()
        got = unique.runs_log(spark, out).where(F.col("seq") >= rows[0][0]).orderBy("seq").collect()
        assert [(r.seq, r.unique_index) for r in got] == want
    log = unique.runs_log(spark, out).collect()
    assert all((r.saved_path is not None) == r.is_unique and r.started_at <= r.finished_at for r in log)
    named = spark.read.json(f"{out}/unique").orderBy("name").collect()
    assert [(r.name, r.text) for r in named] == [("unique_000001", "a"), ("unique_000002", "b"), ("unique_000003", "c"), ("unique_000004", "d")]


def test_unique_response(spark, tmp_path):
    writers.unique_response(spark, str(tmp_path / "u"), 7, "né", {"hash": "h"})
    assert (tmp_path / "u/unique_000007.txt").read_text() == "né"
    assert '"né"' in (tmp_path / "u/unique_000007.json").read_text()


def test_config_nulls(spark, tmp_path):
    writers.config_json(spark, str(tmp_path / "c.json"), {"do_sample": False, "temperature": 0.7, "top_p": 0.9})
    assert '"temperature": null' in (tmp_path / "c.json").read_text()


@pytest.mark.parametrize("n, width", [(10, 10), (100, 28)])
def test_chart(n, width):
    assert report.chart_width(n) == width
    svg = report.chart([{"p_original": 0.5, "p_masked": 0.4, "compact": "<a>"}] * n, ("original", "masked"))
    assert svg.count("<text") == (n if n < 80 else n // 2) and "&lt;a&gt;" in svg
    with pytest.raises(ValueError):
        report.chart([], ("a", "b"))


def test_probe_command(spark, tmp_path):
    rows = [(1, k, k % 3, [0.1 * k, 1.0, -1.0]) for k in range(5)]
    for name in ("l", "m"):
        spark.createDataFrame(rows, "response_id long, token_index int, token_id int, z array<double>").write.parquet(str(tmp_path / name))
    spark.createDataFrame([(0, "a"), (1, " b"), (2, ",")], "token_id int, raw_token string").write.parquet(str(tmp_path / "v"))
    out = str(tmp_path / "out")
    cli.run_probe(spark, cli.parser().parse_args(["probe", "--logits", str(tmp_path / "l"), "--masked-logits", str(tmp_path / "m"), "--vocab", str(tmp_path / "v"), "--output-dir", out]))
    assert spark.read.options(**readers.CSV).csv(f"{out}/word_probabilities.csv").count() == 5
    page = spark.read.text(f"{out}/token_probabilities.html", wholetext=True).first()
    assert "<table>" in page.value and page.response_id == 1


def test_word_boxes(spark, tmp_path):
    (tmp_path / "words.json").write_text('{"words": [{"text": "a", "bbox": [120, 240, 188, 260]}, {"box": [210, 240, 280, 260]}, [300, 240, 360, 260]]}')
    got = readers.word_boxes(spark, str(tmp_path / "words.json"), 400, 300).orderBy("nth").collect()
    assert [tuple(r)[1:] for r in got] == [(120, 240, 188, 260), (210, 240, 280, 260), (300, 240, 360, 260)]


def test_force_continue_command(spark, tmp_path):
    table = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "index int, token_id int")
    writers.csv(table, str(tmp_path / "p.csv"), ["index", "token_id"])
    spark.createDataFrame([(0, "a"), (1, " b"), (2, ",")], "token_id int, raw_token string").write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([(0, [0.0, 1.0, 2.0])], "response_id int, z array<double>").write.parquet(str(tmp_path / "z"))
    out = str(tmp_path / "out")
    args = ["force-continue", "--prefix-token-csv", str(tmp_path / "p.csv"), "--prefix-end-index", "1", "--force-token-ids", "2, 0", "--vocab", str(tmp_path / "v"), "--next-logits", str(tmp_path / "z"), "--top-k", "2", "--output-dir", out]
    cli.run_force_continue(spark, cli.parser().parse_args(args))
    read = lambda n: (tmp_path / "out" / n).read_text()
    assert read("forced_prefix.txt") == "b,,a" and read("continuation.txt") == "" and read("full_forced_output.txt") == "b,,a"
    result = json.loads(read("result.json"))
    assert [x["token_id"] for x in result["next_token_before_force"]["top_tokens"]] == [2, 1]
    assert [x["token_id"] for x in result["next_token_before_force"]["inspected_tokens"]] == [2, 0]
    assert result["forced_tokens"] == [{"token_id": 2, "token": ","}, {"token_id": 0, "token": "a"}]
    spark.createDataFrame([(0, 0, 1), (0, 1, 0), (0, 2, 1)], "response_id int, token_index int, token_id int").write.parquet(str(tmp_path / "c"))
    cli.run_force_continue(spark, cli.parser().parse_args([*args, "--continuation", str(tmp_path / "c"), "--special-ids", "1"]))
    result = json.loads(read("result.json"))
    assert result["continuation_token_ids"] == [1, 0] and result["full_token_count"] == 6 and read("full_forced_output.txt") == ",,aa"


def test_unique_loop_command(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "a ")], "seq long, text string").write.parquet(str(tmp_path / "r"))
    out = str(tmp_path / "out")
    cli.run_unique_loop(spark, cli.parser().parse_args(["unique-loop", "--responses", str(tmp_path / "r"), "--output-dir", out, "--no-do-sample"]))
    assert unique.manifest(spark, out).count() == 1
    config = json.loads((tmp_path / "out/config.json").read_text())
    assert config["temperature"] is None and config["compare_mode"] == "strip" and config["max_new_tokens"] == 1024
    assert list(config) == ["created_at", "model_id", "image", "output_dir", "max_new_tokens", "do_sample", "temperature", "top_p", "compare_mode", "seed", "min_pixels", "max_pixels", "image_patch_size", "enable_thinking"]


def test_num_runs(spark, tmp_path):
    spark.createDataFrame([(k, f"t{k % 4}") for k in range(20)], "seq long, text string").repartition(5).write.parquet(str(tmp_path / "r"))
    out = str(tmp_path / "out")
    cli.run_unique_loop(spark, cli.parser().parse_args(["unique-loop", "--responses", str(tmp_path / "r"), "--output-dir", out, "--num-runs", "6", "--sleep-seconds", "0.5"]))
    assert unique.runs_log(spark, out).count() == 6


def test_manifest_is_gathered(spark, tmp_path, monkeypatch):
    """More batches than are kept apart; numbers and hashes go on over the gathering."""
    monkeypatch.setattr(unique, "COMPACT", 2)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(7):
        spark.createDataFrame([(2 * k, f"n{k}"), (2 * k + 1, "n0")], "seq long, text string").coalesce(1).write.mode("append").parquet(source)
        unique.unique_loop(spark.readStream.schema("seq long, text string").parquet(source), out).awaitTermination()
    got = unique.runs_log(spark, out).where("is_unique").orderBy("seq").collect()
    assert [(r.text, r.unique_index) for r in got] == [(f"n{k}", k + 1) for k in range(7)]
    assert unique.manifest(spark, out).count() == 7 and len(list((tmp_path / "out/manifest_until").glob("batch=*"))) == 2


def test_probe_of_two_responses_with_an_image(spark, tmp_path):
    """Every artifact: images, both responses' texts, tables, pages and charts, one JSON document."""
    image = spark.createDataFrame([(y, x, 10 * y, 200, 3 * x) for y in range(20) for x in range(30)], "y int, x int, r int, g int, b int")
    writers.rgb_image(image, str(tmp_path / "a.png"))
    for name, n in (("l", 5), ("m", 5), ("sl", 3), ("sm", 3)):
        rows = [(1, k, k % 3, [0.1 * k + len(name), 1.0, -1.0]) for k in range(n)]
        spark.createDataFrame(rows, "response_id long, token_index int, token_id int, z array<double>").write.parquet(str(tmp_path / name))
    spark.createDataFrame([(0, "<a>"), (1, " b"), (2, ",")], "token_id int, raw_token string").write.parquet(str(tmp_path / "v"))
    (tmp_path / "info.txt").write_text("the answer")
    out = str(tmp_path / "out")
    args = ["probe", "--vocab", str(tmp_path / "v"), "--output-dir", out, "--image", str(tmp_path / "a.png"), "--prompt", "what <is> it?", "--patch-size", "8", "--mask-fill", "black", "--privileged-info-file", str(tmp_path / "info.txt")]
    for option, name in (("--logits", "l"), ("--masked-logits", "m"), ("--second-logits", "sl"), ("--second-masked-logits", "sm")):
        args += [option, str(tmp_path / name)]
    cli.run_probe(spark, cli.parser().parse_args(args))
    got = json.loads(spark.read.text(f"{out}/token_probabilities.json", wholetext=True).first().value)
    want = "model_id prompt original_image_path masked_image_path original_condition_label masked_condition_label privileged_info mask_metadata responses generated_text generated_token_ids token_scores word_scores masked_generated_text masked_generated_token_ids masked_token_scores masked_word_scores"
    assert list(got) == want.split()
    assert got["generated_text"] == "<a> b,<a> b" and got["masked_generated_text"] == "<a> b,"
    assert got["responses"]["masked_image_response"]["token_scores"] == got["masked_token_scores"] and len(got["word_scores"]) == 5
    assert list(got["token_scores"][0]) == scores.TOKEN_COLUMNS and list(got["word_scores"][0]) == units.UNIT_COLUMNS
    assert got["privileged_info"]["num_chars"] == 10 and got["masked_condition_label"] == "masked image + privileged info"
    assert got["mask_metadata"]["grid_width"] == 4 and got["mask_metadata"]["num_candidates"] == 12 and len(got["mask_metadata"]["selected_regions"]) == 4
    page = spark.read.text(f"{out}/masked_response_word_probabilities.html", wholetext=True).first().value
    assert "what &lt;is&gt; it?" in page and "<a>" not in page and "num_word_units" in page
    assert "<svg" in spark.read.text(f"{out}/token_probabilities.svg", wholetext=True).first().value
    before, after = (readers.pixels(readers.images(spark, f"{out}/{n}.png")).drop("image") for n in ("original", "masked"))
    assert before.exceptAll(image).isEmpty() and 0 < after.exceptAll(image).count() < 600
    cli.run_probe(spark, cli.parser().parse_args([*args, "--skip-masked-generation", "--group-tokens", "none"]))
    got = json.loads(spark.read.text(f"{out}/token_probabilities.json", wholetext=True).first().value)
    assert "masked_image_response" not in got["responses"] and "masked_generated_text" not in got and got["word_scores"] == []


def test_merged_records(spark):
    got = spark.range(1).select(writers.merged({"a": F.lit(1), "b": F.lit(2)}, {"b": F.lit(3), "c": F.lit("x")}).alias("x")).first().x
    assert list(got.asDict().items()) == [("a", 1), ("b", 3), ("c", "x")]


def test_large_vocabulary_is_not_broadcast(spark, monkeypatch):
    tokens = spark.createDataFrame([(0, 0, 1), (0, 1, 9)], "response_id int, token_index int, token_id int")
    vocab = spark.createDataFrame([(k, f"p{k}") for k in range(5)], "token_id int, raw_token string")
    want = sorted(map(str, scores.decoded(tokens, vocab, {"token_id": ""}).collect()))
    monkeypatch.setattr(scores, "VOCABULARY", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = scores.decoded(tokens, vocab, {"token_id": ""})
        assert sorted(map(str, got.collect())) == want and "SortMergeJoin" in got._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _model(spark, tmp_path):
    spark.createDataFrame([(0, ""), (1, " a"), (2, "b"), (3, " c")], "token_id int, raw_token string").write.parquet(str(tmp_path / "v"))
    spark.createDataFrame([(0, [0.0, 9.0, 0.0, 0.0]), (1, [0.0, 0.0, 2.0, 1.0]), (2, [0.0, 0.0, 0.0, 5.0]), (3, [9.0, 0.0, 0.0, 0.0])], "last_id int, z array<double>").write.parquet(str(tmp_path / "t"))
    return ["--vocab", str(tmp_path / "v"), "--model-table", str(tmp_path / "t"), "--special-ids", "0", "--output-dir", str(tmp_path / "out")]


def test_force_continue_with_a_model(spark, tmp_path):
    writers.csv(spark.createDataFrame([(0, 3), (1, 2)], "index int, token_id int"), str(tmp_path / "p.csv"), ["index", "token_id"])
    args = ["force-continue", *_model(spark, tmp_path), "--prefix-token-csv", str(tmp_path / "p.csv"), "--prefix-end-index", "1", "--force-token-ids", "1"]
    cli.run_force_continue(spark, cli.parser().parse_args(args))
    result = json.loads((tmp_path / "out/result.json").read_text())
    assert result["continuation_token_ids"] == [2, 3] and result["full_token_count"] == 5
    assert (tmp_path / "out/full_forced_output.txt").read_text() == "cb ab c"


def test_unique_loop_with_a_model(spark, tmp_path):
    args = ["unique-loop", *_model(spark, tmp_path), "--num-runs", "40", "--max-new-tokens", "6", "--prompt", "b", "--seed", "3", "--temperature", "1.5"]
    cli.run_unique_loop(spark, cli.parser().parse_args(args))
    out = str(tmp_path / "out")
    assert unique.runs_log(spark, out).count() == 40 and 1 <= unique.manifest(spark, out).count() <= 40
    with pytest.raises(ValueError):
        cli.run_unique_loop(spark, cli.parser().parse_args(["unique-loop"]))
