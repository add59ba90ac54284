"""Every query by name, with the SQL that it is compared with.

Doubles are rounded to six places on both sides and integers cast, as sums of doubles depend on
their order and engines differ in the widths they infer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, generate, pixels, prefix, regions, scores, units
from ..operators.regions import MaskConfig
from ..sources import payload, readers, report, writers
from ..sources.shared import cut, new_folder
from ..streaming import unique
from . import bindings as B
from .oracle import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Explicit dark threshold of the word queries, and settings of the degradation queries.
THRESHOLD, WORD_GAP = 70, 2
PATCHES = MaskConfig(patch_size=16, ratio=0.35, opacity=0.5, fill="mean")
OVERLAP = MaskConfig(opacity=0.5, fill="black")
WHITE = MaskConfig(effect="fade", opacity=0.3, fill="white")
NOISE_FILL = MaskConfig(fill="noise")
NOISE = MaskConfig(effect="noise", noise_std=25.0)
BLUR = MaskConfig(effect="blur")
COLOUR = MaskConfig(effect="blur_fade", opacity=0.5, fill="mean")
IDS = ["271, 91,,", " 7 ,8", " , ", "x", "5"]
JSON_BOXES = [
    '{"words": [{"text": "a", "bbox": [120, 240, 188, 260]}, {"box": [210, 240, 280, 260]}, [300, 240, 360, 260]]}',
    '{"bbox": [1, 2, 3, 4], "words": [{"box": [5, 6, 7, 8]}]}',
    '{"x": 10, "y": 20, "w": 30, "h": 40}',
    "[0.1, 0.2, 0.5, 0.4]",
    "not json",
    '{"bbox": {"box": [1, 2, 3, 4]}, "x": [1, 2, 3, 4], "w": {"bbox": [1, 2, 3, 4]}}',
    '{"bbox": [[1, 2, 3, 4]], "deep": [{"box": [10, 10, 20, 30], "h": [9, 9, 9, 9]}]}',
    '{"x": "10", "y": "20.4", "w": "30", "h": "40"}',
    '{"x": "a", "y": 1, "w": 2, "h": 3, "box": [1, 2, 3, 4]}',
    '{"bbox": [5, 6, 7, 8], "box": [15, 16, 27, 28], "x": 1, "y": 2, "w": 3, "h": 4, "k": [30, 40, 50, 60]}',
]
UNIT_SHOWN = ["unit_type", "text", "token_start", "token_end", "token_count", *units.UNIT_COLUMNS[9:]]
#: Tokens that a careless CSV would spoil.
AWKWARD = ["a,b", 'say "x"', "two\nlines", "back\\slash", " leading", "", "lone\rreturn"]


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(r6(c).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def _number() -> Column:
    """Rows that are not unique have no number; in results it is 0."""
    return F.coalesce("unique_index", F.lit(0)).cast("long").alias("unique_index")


def token_log_softmax(spark, sf):
    return rounded(scores.token_statistics(B.logits(spark, sf)).select(*scores.KEY, "token_id", "logp", "p"))


def token_argmax(spark, sf):
    return rounded(scores.token_statistics(B.logits(spark, sf)).select(*scores.KEY, "top_token_id", "top_logp", "top_p"))


def token_scores_paired(spark, sf):
    return rounded(B.paired(spark, sf))


def shifted_scores(spark, sf):
    return rounded(scores.token_statistics(scores.shifted(B.logits(spark, sf))).select(*scores.KEY, "token_id", "logp"))


def _vectors(spark, sf):
    return B.read(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("z"))


def next_token_topk(spark, sf):
    return rounded(scores.next_token_topk(_vectors(spark, sf), "vec_id", 20))


def inspected_tokens(spark, sf):
    return rounded(scores.inspected(_vectors(spark, sf), "vec_id", [0, 7, 63]))


def token_pieces_decoded(spark, sf):
    return B.decoded(spark, sf).select(*scores.KEY, "raw_token", "token")


def response_text(spark, sf):
    return scores.decoded_text(scores.trim_tail(B.logits(spark, sf), B.SPECIALS), B.vocabulary(spark, sf), B.SPECIALS)


def piece_types(spark, sf):
    pieces = B.read(spark, sf, "documents").select(F.explode(T.pieces(F.coalesce("text", F.lit("")))).alias("piece"))
    return pieces.groupBy(T.piece_type(F.col("piece")).alias("unit_type")).agg(F.count(F.lit(1)).alias("n"))


def token_units(spark, sf):
    return units.units_of_text(B.read(spark, sf, "documents"), "doc_id", "text").drop("raw_text")


def _units(spark, sf):
    return units.units_of_tokens(B.decoded(spark, sf))


def unit_scores(spark, sf):
    return rounded(_units(spark, sf).select("response_id", "unit", *UNIT_SHOWN))


def unit_dependency_top(spark, sf):
    return rounded(units.dependency_top(_units(spark, sf).withColumn("image_dependency_logp", r6("image_dependency_logp")), 5).select("response_id", "unit", "image_dependency_logp", "rank"))


def compact_labels(spark, sf):
    return B.read(spark, sf, "part").select("p_partkey", T.compact_token(F.col("p_name")).alias("token_label"), T.compact_text(F.concat("p_type", F.lit("\n"), "p_name")).alias("text_label"))


def _dedup(mode: str):
    def query(spark, sf):
        done = dedup.deduplicate(B.responses(spark, sf), mode, "seq", kept=["seq"])
        return done.select(F.col("seq").alias("doc_id"), "hash", "is_unique", _number())

    return query


def dedup_resume(spark, sf):
    """The first half of the documents is the manifest."""
    every = B.responses(spark, sf)
    half = (every.agg(F.max("seq")).first()[0] or 0) // 2
    seen = dedup.deduplicate(every.where(F.col("seq") < half), "strip", "seq", kept=["seq"]).where("is_unique")
    done = dedup.deduplicate(every.where(F.col("seq") >= half), "strip", "seq", manifest=seen.select("hash", "unique_index"), kept=["seq"])
    return done.select(F.col("seq").alias("doc_id"), "hash", "is_unique", _number())


def dedup_stream(spark, sf):
    path = f"{sf}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema)
    # A stream reads folders; a table of one file is picked out of the folder that it lies in.
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        stream, path = stream.option("pathGlobFilter", "events.parquet"), sf
    rows = stream.parquet(path).select(F.col("event_id").alias("seq"), F.concat("event_type", "props").alias("text"))
    folder = new_folder(spark)
    unique.unique_loop(rows, folder).awaitTermination()
    return unique.runs_log(spark, folder).select(F.col("seq").alias("event_id"), "is_unique", _number())


def _prefixes(spark, sf):
    return B.read(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") - 1).cast("int").alias("index"), F.col("l_partkey").alias("token_id"))


def prefix_validity(spark, sf):
    return prefix.validity(_prefixes(spark, sf), "l_orderkey")


def prefix_splice(spark, sf):
    rows = prefix.prefix_ids(_prefixes(spark, sf), "l_orderkey").select("l_orderkey", F.col("ids").alias("input_ids"))
    rows = rows.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids"))).withColumn("token_type_ids", F.array_repeat(F.lit(1), F.size("input_ids")))
    done = prefix.append_ids(rows, F.array(F.lit(271).cast("long"), F.lit(91).cast("long")))
    return done.select("l_orderkey", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("input_ids", "attention_mask", "token_type_ids")))


def forced_ids_parsed(spark, sf):
    rows = spark.range(len(IDS)).select(F.col("id").alias("nth"), F.get(F.array(*map(F.lit, IDS)), F.col("id").cast("int")).alias("value"))
    return rows.select("nth", F.array_join(F.transform(prefix.try_parse_ids(F.col("value")), lambda x: x.cast("string")), ",").alias("ids"))


def trailing_trim(spark, sf):
    kept = scores.trim_tail(B.logits(spark, sf).select("response_id", "token_index", "token_id"), B.SPECIALS)
    ordered = F.array_sort(F.collect_list(F.struct("token_index", "token_id")))
    return kept.groupBy("response_id").agg(F.array_join(F.transform(ordered, lambda x: x["token_id"].cast("string")), ",").alias("kept_ids"))


def chat_messages(spark, sf):
    said = B.read(spark, sf, "conversations").where("role = 'user'")
    return said.select("conv_id", "turn", prefix.user_message(F.col("text"), F.concat(F.lit("image-"), F.col("conv_id").cast("string")), 2048, 16777216).alias("message"))


def privileged_prompts(spark, sf):
    said = B.read(spark, sf, "conversations").where("role = 'user'").withColumn("item_id", F.col("conv_id") % 40)
    info = B.read(spark, sf, "benchmark").select("item_id", F.col("text").alias("info"))
    both = said.join(info, "item_id")
    return both.select("conv_id", "turn", F.length("info").cast("long").alias("num_chars"), F.sha2("info", 256).alias("sha256"), F.sha2(prefix.with_privileged(F.col("text"), F.col("info")), 256).alias("prompt_sha256"))


def _grid(spark, sf):
    return regions.patch_grid(B.image_sizes(spark, sf), "p_partkey", 32)


def patch_grid(spark, sf):
    return _grid(spark, sf)


def region_clip(spark, sf):
    boxes = regions.box_to_region(B.part_boxes(spark, sf))
    return regions.word_regions(boxes, 2, 4, 4).select("p_partkey", *regions.BOX)


def region_sample(spark, sf):
    return regions.sampled(_grid(spark, sf), "p_partkey", 0.35, 7)


def dark_threshold(spark, sf):
    rows = B.pixels(spark, sf)
    limits = pixels.dark_thresholds(rows)
    return rows.join(limits, "image").groupBy("image", "threshold").agg(F.count_if(F.col("gray") <= F.col("threshold")).alias("n_dark"))


def text_lines(spark, sf):
    return pixels.text_lines(pixels.dark_pixels(B.pixels(spark, sf), THRESHOLD), B.pixel_images(spark, sf), 4, 0)


def word_boxes_detected(spark, sf):
    return pixels.detect_words(B.pixels(spark, sf), B.pixel_images(spark, sf), THRESHOLD, WORD_GAP, 4, 4)


def word_boxes_json(spark, sf):
    rows = spark.range(len(JSON_BOXES)).select(F.col("id"), F.get(F.array(*map(F.lit, JSON_BOXES)), F.col("id").cast("int")).alias("text"), F.lit(400).alias("width"), F.lit(300).alias("height"))
    return regions.box_to_region(regions.boxes_of_json(rows)).select("id", *regions.BOX)


def _patched(spark, sf):
    return regions.sampled(regions.patch_grid(B.pixel_images(spark, sf), "image", PATCHES.patch_size), "image", PATCHES.ratio, PATCHES.seed)


def degrade_patches(spark, sf):
    return pixels.degrade(B.pixels(spark, sf), _patched(spark, sf), PATCHES)


def degrade_overlap(spark, sf):
    return pixels.degrade(B.pixels(spark, sf), B.overlapping(spark, sf), OVERLAP)


def _degraded(config: MaskConfig):
    def query(spark, sf):
        return pixels.degrade(B.pixels(spark, sf), B.overlapping(spark, sf), config)

    return query


def _colours(spark, sf):
    g = F.col("gray")
    return B.pixels(spark, sf).select("image", "y", "x", g.alias("r"), (255 - g).alias("g"), (g * 3 % 256).cast("int").alias("b"))


def degrade_colour(spark, sf):
    return pixels.degrade(_colours(spark, sf), B.overlapping(spark, sf), COLOUR)


def gray_from_colour(spark, sf):
    return pixels.with_gray(_colours(spark, sf)).select("image", "y", "x", "gray")


def patch_mask_colour(spark, sf):
    """Colour images under a patch mask, whatever strategy the settings name."""
    config = MaskConfig(strategy="word", patch_size=16, fill="black")
    return pixels.apply_patch_mask(_colours(spark, sf), B.pixel_images(spark, sf), config)[0]


def mask_metadata(spark, sf):
    return regions.metadata(_grid(spark, sf), regions.sampled(_grid(spark, sf), "p_partkey", 0.35, 7), "p_partkey")


def mask_record(spark, sf):
    """The whole record of a patch mask, its regions one to a row."""
    got = pixels.apply_patch_mask(B.pixels(spark, sf), B.pixel_images(spark, sf), PATCHES)[2]
    got = got.select("*", F.posexplode("selected_regions").alias("nth", "region"))
    fields = ["image", "image_width", "image_height", "strategy", "effect", "num_candidates", "num_selected", "grid_width", "grid_height", "word_box_source", "nth"]
    setting = lambda k, kind: F.get_json_object("config", f"$.{k}").cast(kind).alias(k)
    return got.select(*fields, *(F.col(f"region.{c}").alias(c) for c in (*regions.BOX, "source")), setting("patch_size", "int"), setting("ratio", "double"), setting("seed", "int"))


def html_escaped(spark, sf):
    return B.read(spark, sf, "pages").select("page_id", T.html_escape(F.col("html")).alias("escaped"))


def report_hue(spark, sf):
    return B.paired(spark, sf).select(*scores.KEY, scores.hue(r6("p_original")).alias("hue_original"), scores.hue(r6("p_masked")).alias("hue_masked"))


def plot_ticks(spark, sf):
    table = B.read(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 100).alias("response_id"), (F.col("vec_id") % 100).cast("int").alias("token_index"))
    return scores.ticks(table)


def _full_table(spark, sf):
    vocab = B.vocabulary(spark, sf)
    table = scores.decoded(B.paired(spark, sf), vocab, {"token_id": "", "top_token_id_original": "_original", "top_token_id_masked": "_masked"})
    named = {f"{r}token_{c}": f"top_{r}token_{c}" for r in ("", "raw_") for c in ("original", "masked")}
    table = table.withColumnsRenamed(named).withColumn("index", F.col("token_index"))
    # Some tokens become ones that are hard to write as CSV.
    k = F.pmod(F.col("response_id") * 20 + F.col("token_index"), F.lit(50)).cast("int")
    awkward = F.get(F.array(*map(F.lit, AWKWARD)), k)
    return table.withColumn("raw_token", F.coalesce(awkward, "raw_token")).withColumn("token", T.display(F.col("raw_token")))


def csv_roundtrip(spark, sf):
    table = _full_table(spark, sf)
    columns = ["response_id", *scores.TOKEN_COLUMNS]
    path = f"{new_folder(spark)}/token_probabilities.csv"
    writers.csv(table, path, columns)
    schema = ", ".join(f"`{c}` {dict(table.dtypes)[c]}" for c in columns)
    return rounded(readers.token_table(spark, path, schema))


def json_payload(spark, sf):
    """Tokens as the JSON document of their response holds them, at its top and in the response."""
    said = payload.responses(_full_table(spark, sf), None, "original_image_response", "original")
    run = {"model_id": F.lit("recorded"), "privileged_info": payload.privileged("info.txt", "né")}
    tokens = "token_scores array<struct<index:int, token_id:int, raw_token:string, p_original:double, top_token_changed:boolean>>"
    schema = f"model_id string, privileged_info struct<num_chars:int, sha256:string>, generated_token_ids array<int>, {tokens}, responses struct<original_image_response:struct<label:string, {tokens.replace(' ', ':', 1)}>>"
    got = payload.probe(said, None, run).select("response_id", F.from_json("payload", schema).alias("d"))
    inner = F.col("d.responses.original_image_response")
    got = got.select("response_id", "d.model_id", "d.privileged_info.num_chars", "d.privileged_info.sha256", inner["label"].alias("label"), F.size("d.generated_token_ids").alias("n"), (inner["token_scores"] == F.col("d.token_scores")).alias("same"), F.inline("d.token_scores"))
    return rounded(got)


def unit_csv(spark, sf):
    """The columns of ``unit_scores``, through a unit table as CSV."""
    table = _units(spark, sf).withColumn("index", F.col("unit"))
    path = f"{new_folder(spark)}/word_probabilities.csv"
    columns = ["response_id", *units.UNIT_COLUMNS]
    writers.csv(table, path, columns)
    kinds = {k: "string" if v.startswith("array") else v for k, v in table.dtypes}
    got = readers.token_table(spark, path, ", ".join(f"`{c}` {kinds[c]}" for c in columns)).withColumnRenamed("index", "unit")
    return rounded(got.select("response_id", "unit", *UNIT_SHOWN))


def prefix_csv(spark, sf):
    """Token tables as CSV, of which only the index and the id are read."""
    path = f"{new_folder(spark)}/tokens.csv"
    table = _prefixes(spark, sf).select("index", F.col("token_id").cast("int").alias("token_id"), F.lit('a "b",\nc').alias("raw_token"))
    writers.csv(table, path, ["index", "raw_token", "token_id"])
    return readers.prefix_rows(spark, path)


def manifest_lines(spark, sf):
    """A manifest of which most lines are broken."""
    n = F.col("event_id")
    good = F.to_json(F.struct(F.sha2("props", 256).alias("hash"), n.alias("unique_index"), F.lit("strip").alias("compare_mode")))
    odd = [F.lit(""), F.lit("not json"), F.lit('{"hash": 5}'), F.substring(good, 1, 30), F.lit('["hash"]')]
    line = F.get(F.array(good, *odd), (n % 6).cast("int"))
    path = f"{new_folder(spark)}/manifest.jsonl"
    B.read(spark, sf, "events").select(line.alias("value")).write.text(path)
    return readers.manifest(spark, path, "strip")


def _bundle(spark, sf):
    """The first 64 vectors are what follows each id of the vocabulary."""
    table = B.read(spark, sf, "embeddings").where(F.col("vec_id") < B.VOCABULARY).select(F.col("vec_id").alias("last_id"), F.col("embedding").alias("z"))
    return generate.Bundle(cut(B.vocabulary(spark, sf)), generate.table_model(table), tuple(B.SPECIALS), (B.SPECIALS[0],))


def prompt_ids(spark, sf):
    """Prompts as ids: their number, how many are known, and all of them."""
    said = B.read(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    got = generate.prompt_inputs(said, B.vocabulary(spark, sf), "id", "text", B.VOCABULARY)
    known = F.size(F.filter("input_ids", lambda t: t < B.VOCABULARY)).alias("known")
    return got.select("id", F.size("attention_mask").alias("n"), known, F.array_join(F.transform("input_ids", lambda t: t.cast("string")), ",").alias("ids"))


def _first_ids(spark, sf):
    return B.read(spark, sf, "part").select("p_partkey", F.array((F.col("p_partkey") % B.VOCABULARY).cast("int")).alias("input_ids")).withColumn("attention_mask", F.array(F.lit(1)))


def generate_greedy(spark, sf):
    got = generate.from_prompts(_first_ids(spark, sf), _bundle(spark, sf), "p_partkey", 12)
    return got.select("p_partkey", F.array_join(F.transform("token_ids", lambda t: t.cast("string")), ",").alias("ids"), "text")


def generate_prefilled(spark, sf):
    got = generate.from_prefilled(_first_ids(spark, sf), F.array(F.lit(5), (F.col("p_partkey") % 7).cast("int")), _bundle(spark, sf), "p_partkey", 8)
    joined = lambda c: F.array_join(F.transform(c, lambda t: t.cast("string")), ",").alias(c)
    return got.select("p_partkey", joined("continuation_ids"), "continuation_text", joined("full_ids"), "full_text")


def table_rows(spark, sf):
    """Rows of a report's table as HTML."""
    table = _full_table(spark, sf)
    return table.select(*scores.KEY, report.row(table, ["index", "token", "p_original", "delta_p", "top_token_changed"]).alias("html"))


QUERIES = {
    f.__name__: f
    for f in (
        token_log_softmax, token_argmax, token_scores_paired, shifted_scores, next_token_topk, inspected_tokens, token_pieces_decoded, response_text,
        piece_types, token_units, unit_scores, unit_dependency_top, compact_labels, dedup_resume, dedup_stream, prefix_validity, prefix_splice,
        forced_ids_parsed, trailing_trim, chat_messages, privileged_prompts, patch_grid, region_clip, region_sample, dark_threshold, text_lines,
        word_boxes_detected, word_boxes_json, degrade_patches, degrade_overlap, degrade_colour, gray_from_colour, patch_mask_colour, mask_record, mask_metadata, html_escaped, report_hue, plot_ticks, csv_roundtrip, json_payload,
        unit_csv, prefix_csv, manifest_lines, table_rows, prompt_ids, generate_greedy, generate_prefilled,
    )
} | {"dedup_exact": _dedup("exact"), "dedup_strip": _dedup("strip"), "dedup_collapse": _dedup("collapse-space")} | {f"degrade_{n}": _degraded(c) for n, c in (("white", WHITE), ("noise_fill", NOISE_FILL), ("noise", NOISE), ("blur", BLUR))}
