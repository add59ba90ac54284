"""Commands over tables: probe, unique-loop and force-continue.

    python -m scorelens.plans.cli probe --logits L --masked-logits M --vocab V --output-dir OUT
    python -m scorelens.plans.cli unique-loop --responses R --output-dir OUT
    python -m scorelens.plans.cli force-continue --prefix-token-csv P --prefix-end-index N --force-token-ids 1,2 --vocab V --output-dir OUT

A model's logits come as a table (response_id, token_index, token_id, z), its vocabulary as
(token_id, raw_token), a continuation as (response_id, token_index, token_id).  A model itself may
come as a table (last_id, z) of what follows each id: force-continue goes on with it, and unique-loop
draws its responses from it.  Options that steer a model are taken and recorded; without one they
change nothing.

Artifacts of a response lie in a folder of their own, response_id=N, below the artifact's name.
"""

from __future__ import annotations

import argparse
import hashlib
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import generate, pixels, prefix, scores, units
from ..operators import regions as R
from ..sources import payload, readers, report, writers
from ..sources.shared import read_text
from ..streaming import unique

ON_OFF = argparse.BooleanOptionalAction


def _model_options(p: argparse.ArgumentParser, tokens: int) -> None:
    p.add_argument("--model-id", default="recorded logits")
    p.add_argument("--image", default=None)
    p.add_argument("--prompt", default="")
    p.add_argument("--max-new-tokens", type=int, default=tokens)
    p.add_argument("--device-map", default="auto")
    p.add_argument("--dtype", default="auto")
    p.add_argument("--trust-remote-code", action="store_true")
    p.add_argument("--min-pixels", type=int, default=2048)
    p.add_argument("--max-pixels", type=int, default=16777216)
    p.add_argument("--image-patch-size", type=int, default=16)
    p.add_argument("--enable-thinking", action=ON_OFF, default=False)


def _sampling_options(p: argparse.ArgumentParser, sample: bool, temperature: float | None, top_p: float | None) -> None:
    p.add_argument("--do-sample", action=ON_OFF, default=sample)
    p.add_argument("--temperature", type=float, default=temperature)
    p.add_argument("--top-p", type=float, default=top_p)


def _mask_options(p: argparse.ArgumentParser) -> None:
    d = R.MaskConfig()
    p.add_argument("--mask-strategy", choices=R.STRATEGIES, default=d.strategy)
    p.add_argument("--mask-ratio", type=float, default=d.ratio)
    p.add_argument("--patch-size", type=int, default=d.patch_size)
    p.add_argument("--mask-fill", choices=R.FILLS, default=d.fill)
    p.add_argument("--mask-effect", choices=R.EFFECTS, default=d.effect)
    p.add_argument("--mask-opacity", type=float, default=d.opacity)
    p.add_argument("--blur-radius", type=float, default=d.blur_radius)
    p.add_argument("--noise-std", type=float, default=d.noise_std)
    p.add_argument("--word-boxes", default=None)
    p.add_argument("--word-padding", type=int, default=d.word_padding)
    p.add_argument("--word-gap", type=int, default=d.word_gap)
    p.add_argument("--word-min-width", type=int, default=d.word_min_width)
    p.add_argument("--word-min-height", type=int, default=d.word_min_height)
    p.add_argument("--text-threshold", type=int, default=None)
    p.add_argument("--seed", type=int, default=d.seed)


def mask_config(a: argparse.Namespace) -> R.MaskConfig:
    named = {"strategy": a.mask_strategy, "ratio": a.mask_ratio, "fill": a.mask_fill, "effect": a.mask_effect, "opacity": a.mask_opacity}
    same = ("patch_size", "blur_radius", "noise_std", "word_boxes", "word_padding", "word_gap", "word_min_width", "word_min_height", "text_threshold", "seed")
    return R.MaskConfig(**named, **{k: getattr(a, k) for k in same}).validate()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="scorelens")
    sub = top.add_subparsers(dest="command", required=True)
    probe = sub.add_parser("probe")
    for name in ("--logits", "--masked-logits", "--vocab"):
        probe.add_argument(name, required=True)
    probe.add_argument("--second-logits", default=None, help="vectors of the response to the masked image, under the original condition")
    probe.add_argument("--second-masked-logits", default=None, help="the same under the masked condition")
    probe.add_argument("--output-dir", default="outputs/probe")
    _model_options(probe, 128)
    _sampling_options(probe, False, None, None)
    probe.add_argument("--group-tokens", choices=("none", "word"), default="word")
    probe.add_argument("--privileged-info-file", default=None)
    probe.add_argument("--skip-masked-generation", action="store_true")
    _mask_options(probe)
    loop = sub.add_parser("unique-loop")
    loop.add_argument("--responses", default=None, help="table (seq, text); or --model-table and --vocab, from which --num-runs responses are drawn")
    loop.add_argument("--vocab", default=None)
    loop.add_argument("--model-table", default=None)
    loop.add_argument("--special-ids", default="")
    loop.add_argument("--output-dir", default="outputs/unique_loop")
    _model_options(loop, 1024)
    loop.add_argument("--num-runs", type=int, default=0)
    loop.add_argument("--sleep-seconds", type=float, default=0.0)
    loop.add_argument("--seed", type=int, default=None)
    loop.add_argument("--compare-mode", choices=T.COMPARE_MODES, default="strip")
    loop.add_argument("--every", default=None, help="interval at which the loop looks for more responses; without one it ends")
    _sampling_options(loop, True, 0.7, 0.95)
    force = sub.add_parser("force-continue")
    force.add_argument("--prefix-token-csv", required=True)
    force.add_argument("--prefix-end-index", type=int, required=True)
    force.add_argument("--force-token-ids", required=True)
    force.add_argument("--vocab", required=True)
    force.add_argument("--next-logits", default=None)
    force.add_argument("--continuation", default=None)
    force.add_argument("--model-table", default=None, help="what follows each id, to go on where there is no --continuation")
    force.add_argument("--seed", type=int, default=7)
    force.add_argument("--special-ids", default="", help="ids that texts leave out, comma-separated")
    force.add_argument("--top-k", type=int, default=20)
    force.add_argument("--output-dir", default="outputs/force_continue")
    _model_options(force, 512)
    _sampling_options(force, False, None, None)
    return top


def masked_image(spark: SparkSession, a: argparse.Namespace, out: str) -> dict:
    """Writes the image and the masked image; what was done to it."""
    config = mask_config(a)
    decoded = readers.images(spark, a.image)
    rows = readers.pixels(decoded).withColumn("image", F.lit(0)).persist()
    size = decoded.select(F.lit(0).alias("image"), "width", "height")
    boxes = None
    if config.word_boxes:
        wide = size.first()
        boxes = readers.word_boxes(spark, config.word_boxes, wide.width, wide.height).select(F.lit(0).alias("image"), *R.BOX)
    done, _, record = pixels.apply_mask(rows, size, config, boxes)
    writers.rgb_image(rows, f"{out}/original.png")
    writers.rgb_image(done, f"{out}/masked.png")
    rows.unpersist()
    got = record.drop("image", "config").withColumnRenamed("num_selected", "num_selected_regions").first().asDict(recursive=True)
    return got | {"config": config.to_dict()}


def scored(spark: SparkSession, a: argparse.Namespace, original: str, masked: str) -> tuple[DataFrame, DataFrame | None]:
    """Token scores of a response under both conditions, decoded, and its units."""
    vocab = spark.read.parquet(a.vocab)
    both = [scores.token_statistics(scores.limited(spark.read.parquet(p), a.max_new_tokens)) for p in (original, masked)]
    table = scores.non_empty(scores.decoded(scores.paired(*both), vocab, {"token_id": "", "top_token_id_original": "_original", "top_token_id_masked": "_masked"}))
    named = {f"{r}token_{c}": f"top_{r}token_{c}" for r in ("", "raw_") for c in ("original", "masked")}
    table = table.withColumnsRenamed(named).withColumn("index", F.col("token_index")).persist()
    if a.group_tokens == "none":
        return table, None
    return table, units.units_of_tokens(table).withColumn("index", F.col("unit")).persist()


def artifacts(table: DataFrame, grouped: DataFrame | None, out: str, lead: str, text_name: str, about: dict, metadata: dict, labels: tuple[str, str]) -> None:
    """Text, tables, reports and chart of the responses to one image."""
    said = table.groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("index", "raw_token"))).alias("x"))
    writers.documents(said.select("response_id", F.array_join(F.transform("x", lambda v: F.coalesce(v["raw_token"], F.lit(""))), "").alias("text")), f"{out}/{text_name}", "text")
    writers.csv(table, f"{out}/{lead}token_probabilities.csv", ["response_id", *scores.TOKEN_COLUMNS])
    writers.documents(report.charts(table, labels), f"{out}/{lead}token_probabilities.svg", "svg")
    page = report.html(table, report.TOKEN_CELLS, "token_index", "token", ("p_original", "p_masked"), "Token probabilities", labels, about, metadata)
    writers.documents(page, f"{out}/{lead}token_probabilities.html", "html")
    if grouped is not None:
        writers.csv(grouped, f"{out}/{lead}word_probabilities.csv", ["response_id", *units.UNIT_COLUMNS])
        page = report.html(grouped, report.UNIT_CELLS, "unit", "text", ("first_token_logp_original", "first_token_logp_masked"), "Word probabilities", labels, about, metadata)
        writers.documents(page, f"{out}/{lead}word_probabilities.html", "html")


def run_probe(spark: SparkSession, a: argparse.Namespace) -> None:
    out, labels = a.output_dir, ("original image", "masked image")
    mask, paths = {}, (None, None)
    if a.image:
        mask, paths = masked_image(spark, a, out), (f"{out}/original.png", f"{out}/masked.png")
    info = None
    if a.privileged_info_file:
        info = read_text(spark, a.privileged_info_file)
        labels = (labels[0], "masked image + privileged info")
    secret = None if info is None else {"path": a.privileged_info_file, "num_chars": len(info), "sha256": hashlib.sha256(info.encode()).hexdigest(), "applied_to": "masked_condition_prompt"}
    run = {
        "model_id": F.lit(a.model_id),
        "prompt": F.lit(a.prompt),
        "original_image_path": F.lit(paths[0]).cast("string"),
        "masked_image_path": F.lit(paths[1]).cast("string"),
        "original_condition_label": F.lit(labels[0]),
        "masked_condition_label": F.lit(labels[1]),
        "privileged_info": payload.privileged(a.privileged_info_file, info) if info is not None else F.lit(None).cast("string"),
        "mask_metadata": F.try_parse_json(F.lit(writers.compact_json(mask))),
    }
    both = [("original_image_response", "original", "", "generated.txt", a.logits, a.masked_logits)]
    if not a.skip_masked_generation and a.second_logits and a.second_masked_logits:
        both.append(("masked_image_response", "masked", "masked_response_", "masked_generated.txt", a.second_logits, a.second_masked_logits))
    found = []
    for label, source, lead, name, first, second in both:
        table, grouped = scored(spark, a, first, second)
        metadata = {"response_label": label, "response_source_image": source, "original_image_path": paths[0], "masked_image_path": paths[1], "original_condition_label": labels[0], "masked_condition_label": labels[1]}
        metadata |= {"privileged_info": secret, "mask_metadata": mask, "num_generated_tokens": table.count(), "num_word_units": 0 if grouped is None else grouped.count(), "score_meaning": payload.meaning(labels)}
        artifacts(table, grouped, out, lead, name, {"Model": a.model_id, "Prompt": a.prompt}, metadata, labels)
        found.append(payload.responses(table, grouped, label, source))
        print(f"{label}: {metadata['num_generated_tokens']} tokens, {metadata['num_word_units']} units")
    writers.documents(payload.probe(found[0], found[1] if len(found) > 1 else None, run), f"{out}/token_probabilities.json", "payload")
    print(f"-> {out}")


def _ids(value: str) -> tuple[int, ...]:
    return tuple(int(x) for x in value.split(",") if x.strip())


def _sampling(a: argparse.Namespace) -> dict:
    return {"do_sample": a.do_sample, "temperature": a.temperature, "top_p": a.top_p, "seed": 7 if a.seed is None else a.seed}


def drawn_responses(spark: SparkSession, a: argparse.Namespace) -> str:
    """Writes ``num_runs`` responses to the prompt, each with draws of its own; where they lie."""
    specials = _ids(a.special_ids)
    model = generate.bundle(spark, a.vocab, a.model_table, specials, specials[:1])
    prompt = generate.prompt_inputs(spark.createDataFrame([(0, a.prompt)], "id int, text string"), model.vocabulary, "id", "text", -1).first().input_ids
    inputs = spark.range(1, max(1, a.num_runs) + 1).select(F.col("id").alias("seq"), F.lit(prompt).cast("array<int>").alias("input_ids"))
    generate.from_prompts(inputs, model, "seq", a.max_new_tokens, **_sampling(a)).select("seq", "text").write.mode("overwrite").parquet(f"{a.output_dir}/responses")
    return f"{a.output_dir}/responses"


def run_unique_loop(spark: SparkSession, a: argparse.Namespace) -> None:
    out = a.output_dir
    if not a.responses and not (a.model_table and a.vocab):
        raise ValueError("give --responses, or --model-table and --vocab")
    a.responses = a.responses or drawn_responses(spark, a)
    kept = ("model_id", "image", "output_dir", "max_new_tokens", "do_sample", "temperature", "top_p", "compare_mode", "seed", "min_pixels", "max_pixels", "image_patch_size", "enable_thinking")
    writers.config_json(spark, f"{out}/config.json", {"created_at": datetime.now(UTC).isoformat()} | {k: getattr(a, k) for k in kept})
    print(f"Output directory: {out}\nLoaded {unique.manifest(spark, out).count()} previous unique response hashes.")
    schema = spark.read.parquet(a.responses).schema
    every = a.every or (f"{a.sleep_seconds} seconds" if a.sleep_seconds > 0 else None)
    query = unique.unique_loop(spark.readStream.schema(schema).parquet(a.responses), out, a.compare_mode, every=every, runs=a.num_runs)
    try:
        # At an interval the loop goes on until it is stopped, or all the runs asked for are done.
        while not query.awaitTermination(1) and (a.num_runs <= 0 or unique.finished_runs(spark, out) < a.num_runs):
            pass
    except KeyboardInterrupt:
        print("Stopped.")
    query.processAllAvailable() if query.isActive and a.num_runs > 0 else None
    query.stop()
    print(f"{unique.manifest(spark, out).count()} unique responses -> {out}")


def run_force_continue(spark: SparkSession, a: argparse.Namespace) -> None:
    out = a.output_dir
    ids = prefix.checked_prefix(readers.prefix_rows(spark, a.prefix_token_csv), a.prefix_end_index)
    forced = spark.range(1).select(prefix.parse_ids(F.lit(a.force_token_ids)).alias("ids")).first().ids
    specials = list(_ids(a.special_ids))
    vocab = spark.read.parquet(a.vocab)
    more: list[int] = []
    if a.model_table and not a.continuation:
        model = generate.bundle(spark, a.vocab, a.model_table, tuple(specials), tuple(specials[:1]))
        start = generate.prompt_inputs(spark.createDataFrame([(0, a.prompt)], "response_id int, text string"), vocab, "response_id", "text", -1)
        found = generate.from_prefilled(start, F.array(*map(F.lit, ids + forced)), model, "response_id", a.max_new_tokens, **_sampling(a))
        more = found.first().continuation_ids
    if a.continuation:
        rows = scores.trim_tail(scores.limited(spark.read.parquet(a.continuation).where("response_id = 0"), a.max_new_tokens), specials)
        more = [r.token_id for r in rows.orderBy("token_index").select("token_id").collect()]
    said = {}
    for name, tokens in (("prefix", ids), ("forced_tokens", forced), ("forced_prefix", ids + forced), ("continuation", more), ("full_forced_output", ids + forced + more)):
        rows = spark.createDataFrame([(0, k, t) for k, t in enumerate(tokens)], "response_id int, token_index int, token_id int")
        found = scores.decoded_text(rows, vocab, specials).first()
        said[name] = found.text if found else ""
        writers.write_bytes(spark, f"{out}/{name}.txt", said[name].encode())
    shown = {r.token_id: r.token for r in scores.decoded(spark.createDataFrame([(t,) for t in set(forced)], "token_id int"), vocab, {"token_id": ""}).collect()}
    before = None
    if a.next_logits:
        vectors = spark.read.parquet(a.next_logits)
        top = scores.decoded(scores.next_token_topk(vectors, "response_id", a.top_k), vocab, {"token_id": ""})
        asked = scores.decoded(scores.inspected(vectors, "response_id", forced), vocab, {"token_id": ""})
        before = {
            "top_tokens": [{k: r[k] for k in ("rank", "token_id", "token", "raw_token", "probability")} for r in top.orderBy("rank").collect()],
            "inspected_tokens": [{k: r[k] for k in ("token_id", "token", "raw_token", "probability")} for r in asked.collect()],
        }
    result = {"model_id": a.model_id, "image": a.image, "prefix_token_csv": a.prefix_token_csv, "prefix_end_index": a.prefix_end_index, "prefix_token_count": len(ids), "forced_token_ids": forced}
    result |= {"forced_tokens": [{"token_id": t, "token": shown.get(t)} for t in forced], "continuation_token_ids": more, "continuation_token_count": len(more), "full_token_count": len(ids) + len(forced) + len(more), "next_token_before_force": before}
    result["generation"] = {"max_new_tokens": a.max_new_tokens, "do_sample": a.do_sample, "temperature": a.temperature if a.do_sample else None, "top_p": a.top_p if a.do_sample else None}
    writers.json_file(spark, f"{out}/result.json", result)
    print(f"Prefix tokens: {len(ids)}\nForced token ids: {forced!r} -> {said['forced_tokens']!r}\nContinuation tokens: {len(more)}\nOutput directory: {out}")


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("scorelens").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    {"probe": run_probe, "unique-loop": run_unique_loop, "force-continue": run_force_continue}[a.command](spark, a)


if __name__ == "__main__":
    main()
