"""SQL for DuckDB over the same tables, written apart from the operators."""

from __future__ import annotations

from ..functions.text import PIECE, SPACE, WORD

ORIGINAL = """original AS (
    SELECT vec_id // 20 AS response_id, (vec_id % 20)::INTEGER AS token_index, label AS token_id,
           list_transform(embedding, lambda v: v::DOUBLE) AS z FROM embeddings)"""
MASKED = """masked AS (
    SELECT k // 20 AS response_id, (k % 20)::INTEGER AS token_index, token_id, list_transform(e, lambda v: v * (1 - 0.55::DOUBLE) + m * 0.55::DOUBLE) AS z
    FROM (SELECT (vec_id + n - 1) % n AS k, label AS token_id, list_transform(embedding, lambda v: v::DOUBLE) AS e, list_avg(list_transform(embedding, lambda v: v::DOUBLE)) AS m
          FROM embeddings, (SELECT count(*) AS n FROM embeddings)))"""


def _no_sign(e: str) -> str:
    """``e`` to six places, zero without a sign."""
    return f"CASE WHEN round({e}, 6) = 0 THEN 0.0::DOUBLE ELSE round({e}, 6) END"


def _stats(of: str, name: str) -> str:
    return f"""{name} AS (
    SELECT response_id, token_index, token_id, z[token_id + 1] - lse AS logp, exp(z[token_id + 1] - lse) AS p,
           (list_position(z, top) - 1)::INTEGER AS top_token_id, top - lse AS top_logp, exp(top - lse) AS top_p
    FROM (SELECT *, top + ln(list_sum(list_transform(z, lambda v: exp(v - top)))) AS lse FROM (SELECT *, list_max(z) AS top FROM {of})))"""


PAIRED = f"""{ORIGINAL}, {MASKED}, {_stats("original", "so")}, {_stats("masked", "sm")}, paired AS (
    SELECT response_id, token_index, so.token_id,
           so.logp AS logp_original, so.p AS p_original, so.top_token_id AS top_token_id_original, so.top_logp AS top_logp_original, so.top_p AS top_p_original,
           sm.logp AS logp_masked, sm.p AS p_masked, sm.top_token_id AS top_token_id_masked, sm.top_logp AS top_logp_masked, sm.top_p AS top_p_masked,
           so.p - sm.p AS delta_p, so.logp - sm.logp AS delta_logp, so.top_token_id <> sm.top_token_id AS top_token_changed,
           so.token_id = so.top_token_id AS target_is_top_original, so.token_id = sm.top_token_id AS target_is_top_masked
    FROM so JOIN sm USING (response_id, token_index))"""

PIECES = f"""pieces AS (
    SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) - 1 AS pos
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{PIECE}') AS p FROM documents))"""
KIND = f"CASE WHEN regexp_matches(piece, '[{WORD}]') THEN 'word' WHEN regexp_matches(piece, '[^{SPACE}]') THEN 'punct' ELSE 'space' END"
VOCAB = f"""{PIECES}, vocab AS (
    SELECT (row_number() OVER (ORDER BY n DESC, piece) - 1)::INTEGER AS token_id, piece AS raw_token
    FROM (SELECT piece, count(*) AS n FROM pieces GROUP BY piece ORDER BY n DESC, piece LIMIT 64))"""


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def _shown(c: str) -> str:
    return f"replace(replace({c}, chr(10), '\\n'), chr(9), '\\t')"


def _units(source: str, key: str) -> str:
    """Rows of (key, pos, piece) of ``source`` with kind and number of their unit."""
    return f"""marked AS (SELECT *, lag(kind) OVER (PARTITION BY {key} ORDER BY pos) AS before FROM (SELECT *, {KIND} AS kind FROM {source})),
    numbered AS (SELECT *, (sum((before IS NULL OR before = 'space' OR kind = 'space' OR piece[1] IN (' ', chr(10), chr(9)) OR kind <> before)::INTEGER)
        OVER (PARTITION BY {key} ORDER BY pos) - 1)::INTEGER AS unit FROM marked)"""


SAFE = "CASE WHEN {0} < -745 THEN 0.0::DOUBLE WHEN {0} > 700 THEN 'inf'::DOUBLE ELSE exp({0}) END"
UNIT_SCORES = f"""{PAIRED}, {VOCAB},
    tokens AS (SELECT p.*, p.token_index AS pos, v.raw_token AS piece FROM paired p LEFT JOIN vocab v USING (token_id)),
    {_units("tokens", "response_id")},
    units AS (
        SELECT response_id, unit, first(kind) AS unit_type, string_agg(piece, '' ORDER BY pos) AS raw, min(pos)::INTEGER AS token_start, (max(pos) + 1)::INTEGER AS token_end,
               count(*)::INTEGER AS token_count, sum(logp_original) AS so, sum(logp_masked) AS sm, avg(logp_original) AS mo, avg(logp_masked) AS mm,
               first(p_original ORDER BY pos) AS fo, first(p_masked ORDER BY pos) AS fm, first(logp_original ORDER BY pos) AS lo, first(logp_masked ORDER BY pos) AS lm
        FROM numbered GROUP BY response_id, unit)"""

RESPONSES = "responses AS (SELECT doc_id AS seq, repeat(' ', (doc_id % 3)::INTEGER) || text AS text FROM documents)"


def _dedup(value: str) -> str:
    return f"""WITH {RESPONSES}, hashed AS (SELECT seq, sha256({value}) AS hash FROM responses),
        marked AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY seq) = 1 AS is_unique FROM hashed)
        SELECT seq AS doc_id, hash, is_unique, CASE WHEN is_unique THEN (sum(is_unique::INTEGER) OVER (ORDER BY seq))::BIGINT ELSE 0 END AS unique_index FROM marked"""


GRID = """sizes AS (SELECT p_partkey, 64 + 3 * p_size AS width, (48 + p_partkey % 50)::INTEGER AS height FROM part),
    grid AS (SELECT p_partkey, (gx * 32)::INTEGER AS x1, (gy * 32)::INTEGER AS y1, least(gx * 32 + 32, width)::INTEGER AS x2, least(gy * 32 + 32, height)::INTEGER AS y2
             FROM sizes, LATERAL (SELECT unnest(range((width + 31) // 32)) AS gx), LATERAL (SELECT unnest(range((height + 31) // 32)) AS gy))"""


def _sampled(source: str, key: str) -> str:
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY y1, x1, y2, x2) - 1 AS pos, count(*) OVER (PARTITION BY {key}) AS n FROM {source}),
    drawn AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY ('0x' || substr(md5('7:' || {key}::VARCHAR || ':' || pos::VARCHAR), 1, 12))::BIGINT, pos) AS draw FROM placed),
    sampled AS (SELECT {key}, x1, y1, x2, y2, (row_number() OVER (PARTITION BY {key} ORDER BY y1, x1, y2, x2))::INTEGER AS rank
                FROM drawn WHERE draw <= least(n, greatest(1, round_even(n * 0.35::DOUBLE, 0)::INTEGER)))"""


PIXELS = """pixels AS (
    SELECT vec_id // 50 AS image, (vec_id % 50)::INTEGER AS y, (generate_subscripts(embedding, 1) - 1)::INTEGER AS x,
           least(255, greatest(0, floor(128 + 255 * unnest(embedding)::DOUBLE)))::INTEGER AS gray FROM embeddings),
    images AS (SELECT image, (max(x) + 1)::INTEGER AS width, (max(y) + 1)::INTEGER AS height FROM pixels GROUP BY image)"""


def _runs(source: str, keys: str, position: str, gap: int) -> str:
    return f"""SELECT {keys}, min({position}) AS a, max({position}) + 1 AS b FROM (
        SELECT *, sum(opens) OVER (PARTITION BY {keys} ORDER BY {position}) AS run FROM (
            SELECT *, coalesce({position} - lag({position}) OVER (PARTITION BY {keys} ORDER BY {position}) > {gap} + 1, true)::INTEGER AS opens FROM {source}))
        GROUP BY {keys}, run"""


LINES = f"""{PIXELS}, dark AS (SELECT * FROM pixels WHERE gray <= 70),
    rows_ AS (SELECT d.image, y FROM dark d JOIN images i ON d.image = i.image GROUP BY d.image, y, width HAVING count(*) >= greatest(2, floor(width * 0.0015))),
    lines AS (SELECT image, a::INTEGER AS y1, b::INTEGER AS y2 FROM ({{lines}}) WHERE b - a >= 4)"""

SMALL_GRID = """grid AS (SELECT image, (gx * 16)::INTEGER AS x1, (gy * 16)::INTEGER AS y1, least(gx * 16 + 16, width)::INTEGER AS x2, least(gy * 16 + 16, height)::INTEGER AS y2
    FROM images, LATERAL (SELECT unnest(range((width + 15) // 16)) AS gx), LATERAL (SELECT unnest(range((height + 15) // 16)) AS gy))"""
COLOURS = PIXELS.replace("pixels AS (", "grays AS (", 1).replace("FROM pixels GROUP BY", "FROM grays GROUP BY") + ", pixels AS (SELECT image, y, x, gray AS r, 255 - gray AS g, (gray * 3) % 256 AS b FROM grays)"
#: Pixels inside the two regions that every image has.
IN_A, IN_B = ("p.x >= 8 AND p.x < 40 AND p.y >= 8 AND p.y < 30", "p.x >= 20 AND p.x < 60 AND p.y >= 15 AND p.y < 45")


def _uniform(name: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', '{name}', image, y, x, k)), 1, 12))::BIGINT / 281474976710656.0::DOUBLE)"


def _steps(column: str, step: str) -> str:
    """``step`` of v, the value so far, and k, for each of the two regions that hold a pixel."""
    once = f"(SELECT image, y, x, {column}, n, CASE WHEN n >= 1 THEN {step} ELSE v END AS v, 2 AS k FROM (SELECT p.*, {column}::DOUBLE AS v, 1 AS k, ({IN_A})::INTEGER + ({IN_B})::INTEGER AS n FROM pixels p))"
    return f"WITH {PIXELS} SELECT image, y, x, CASE WHEN n = 0 THEN {column} ELSE floor(CASE WHEN n >= 2 THEN {step} ELSE v END)::INTEGER END AS value FROM {once}"


def _blur(column: str) -> str:
    """CTEs down to soft_<column>: two passes of a Gaussian of deviation 1.2 over four neighbours
    to either side, edges repeated."""
    taps = "(SELECT d, exp(-0.5 * (d / 1.2::DOUBLE) ** 2) / (SELECT sum(exp(-0.5 * (e / 1.2::DOUBLE) ** 2)) FROM range(-4, 5) r(e)) AS w FROM range(-4, 5) t(d))"
    down = f"SELECT p.image, p.y, p.x, sum(w * q.{column}) AS v FROM pixels p JOIN images i ON p.image = i.image, {taps} JOIN pixels q ON TRUE WHERE q.image = p.image AND q.x = p.x AND q.y = greatest(0, least(height - 1, p.y + d)) GROUP BY ALL"
    return f"""down_{column} AS ({down}),
        soft_{column} AS (SELECT p.image, p.y, p.x, floor(round(sum(w * q.v), 6) + 0.5) AS soft FROM down_{column} p JOIN images i ON p.image = i.image, {taps} JOIN down_{column} q ON TRUE
            WHERE q.image = p.image AND q.y = p.y AND q.x = greatest(0, least(width - 1, p.x + d)) GROUP BY ALL)"""


#: What follows, likeliest first, until id 0 or as many as asked for; special ids at the end go.
GREEDY = """follows AS (
        SELECT vec_id AS last, list_position(embedding, list_max(embedding)) - 1 AS next FROM embeddings WHERE vec_id < 64),
    steps AS (
        {start}
        UNION ALL
        SELECT s.p_partkey, f.next, s.n + 1, s.ids || [f.next::BIGINT] FROM steps s JOIN follows f ON s.last = f.last WHERE s.n < {most} AND (s.n = 0 OR s.last <> 0)),
    last_ AS (SELECT p_partkey, max_by(ids, n) AS ids FROM steps GROUP BY p_partkey),
    trimmed AS (SELECT p_partkey, ids[1:coalesce(list_max(list_transform(generate_series(1, len(ids)), lambda k: CASE WHEN ids[k] NOT IN (0, 2) THEN k END)), 0)] AS kept FROM last_)"""


def _said(ids: str) -> str:
    """The stripped pieces of a list of ids, special ones left out."""
    raw = f"coalesce((SELECT string_agg(raw_token, '' ORDER BY k) FROM (SELECT unnest({ids}) AS t, generate_subscripts({ids}, 1) AS k) JOIN vocab ON t = token_id WHERE t NOT IN (0, 2)), '')"
    return _strip(raw)


ORACLE_SQL = {
    "token_log_softmax": f"WITH {ORIGINAL}, {_stats('original', 'so')} SELECT response_id, token_index, token_id, round(logp, 6) AS logp, round(p, 6) AS p FROM so",
    "token_argmax": f"WITH {ORIGINAL}, {_stats('original', 'so')} SELECT response_id, token_index, top_token_id, round(top_logp, 6) AS top_logp, round(top_p, 6) AS top_p FROM so",
    "token_scores_paired": f"""WITH {PAIRED} SELECT response_id, token_index, token_id, round(logp_original, 6) AS logp_original, round(p_original, 6) AS p_original,
        top_token_id_original, round(top_logp_original, 6) AS top_logp_original, round(top_p_original, 6) AS top_p_original, round(logp_masked, 6) AS logp_masked,
        round(p_masked, 6) AS p_masked, top_token_id_masked, round(top_logp_masked, 6) AS top_logp_masked, round(top_p_masked, 6) AS top_p_masked,
        {_no_sign('delta_p')} AS delta_p, {_no_sign('delta_logp')} AS delta_logp, top_token_changed, target_is_top_original, target_is_top_masked FROM paired""",
    "shifted_scores": f"""WITH {ORIGINAL}, earlier AS (SELECT response_id, token_index, token_id, lag(z) OVER (PARTITION BY response_id ORDER BY token_index) AS z FROM original),
        kept AS (SELECT * FROM earlier WHERE z IS NOT NULL), {_stats("kept", "s")} SELECT response_id, token_index, token_id, round(logp, 6) AS logp FROM s""",
    "next_token_topk": """WITH flat AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS token_id, unnest(embedding)::DOUBLE AS z FROM embeddings),
        p AS (SELECT vec_id, token_id, z, exp(z - max(z) OVER w) / sum(exp(z - m)) OVER w AS probability FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM flat) WINDOW w AS (PARTITION BY vec_id))
        SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, token_id))::INTEGER AS rank, token_id, round(probability, 6) AS probability FROM p QUALIFY rank <= 20""",
    "inspected_tokens": """WITH flat AS (SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS token_id, unnest(embedding)::DOUBLE AS z FROM embeddings),
        p AS (SELECT vec_id, token_id, exp(z - m) / sum(exp(z - m)) OVER (PARTITION BY vec_id) AS probability FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM flat))
        SELECT vec_id, token_id, round(probability, 6) AS probability FROM p WHERE token_id IN (0, 7, 63)""",
    "token_pieces_decoded": f"""WITH {VOCAB} SELECT vec_id // 20 AS response_id, (vec_id % 20)::INTEGER AS token_index, raw_token, {_shown("raw_token")} AS token
        FROM embeddings LEFT JOIN vocab ON label = token_id""",
    "response_text": f"""WITH {VOCAB}, tokens AS (SELECT vec_id // 20 AS response_id, vec_id AS pos, label AS token_id FROM embeddings),
        kept AS (SELECT * FROM (SELECT *, max(CASE WHEN token_id NOT IN (0, 2) THEN pos END) OVER (PARTITION BY response_id) AS last FROM tokens) WHERE pos <= last)
        SELECT response_id, {_strip("coalesce(string_agg(CASE WHEN k.token_id IN (0, 2) THEN '' ELSE raw_token END, '' ORDER BY pos), '')")} AS text
        FROM kept k LEFT JOIN vocab v ON k.token_id = v.token_id GROUP BY response_id""",
    "piece_types": f"WITH {PIECES} SELECT {KIND} AS unit_type, count(*) AS n FROM pieces GROUP BY 1",
    "token_units": f"""WITH {PIECES}, {_units("pieces", "doc_id")},
        units AS (SELECT doc_id, unit, first(kind) AS unit_type, min(pos)::INTEGER AS token_start, (max(pos) + 1)::INTEGER AS token_end, count(*)::INTEGER AS token_count, string_agg(piece, '' ORDER BY pos) AS raw
                  FROM numbered GROUP BY doc_id, unit)
        SELECT doc_id, unit, unit_type, token_start, token_end, token_count, CASE WHEN unit_type = 'space' THEN raw ELSE {_strip("raw")} END AS text FROM units""",
    "unit_scores": f"""WITH {UNIT_SCORES} SELECT response_id, unit, unit_type, CASE WHEN unit_type = 'space' THEN raw ELSE {_strip("raw")} END AS text, token_start, token_end, token_count,
        {_no_sign('lo - lm')} AS image_dependency_logp, round(lo, 6) AS first_token_logp_original, round(lm, 6) AS first_token_logp_masked, {_no_sign('lo - lm')} AS first_token_delta_logp,
        round({SAFE.format("so")}, 6) AS p_original, round({SAFE.format("sm")}, 6) AS p_masked, {_no_sign(SAFE.format('so') + ' - ' + SAFE.format('sm'))} AS delta_p,
        round(so, 6) AS sum_logp_original, round(sm, 6) AS sum_logp_masked, {_no_sign('so - sm')} AS delta_sum_logp, round(mo, 6) AS mean_logp_original, round(mm, 6) AS mean_logp_masked,
        {_no_sign('mo - mm')} AS delta_mean_logp, round(fo, 6) AS first_token_p_original, round(fm, 6) AS first_token_p_masked, {_no_sign('fo - fm')} AS first_token_delta_p FROM units""",
    "unit_dependency_top": f"""WITH {UNIT_SCORES} SELECT response_id, unit, {_no_sign('lo - lm')} AS image_dependency_logp,
        (row_number() OVER (PARTITION BY response_id ORDER BY round(lo - lm, 6) DESC, unit))::INTEGER AS rank FROM units QUALIFY rank <= 5""",
    "compact_labels": """SELECT p_partkey, CASE WHEN length(p_name) > 12 THEN substr(replace(p_name, ' ', '·'), 1, 11) || '…' ELSE replace(p_name, ' ', '·') END AS token_label,
        CASE WHEN length(t) > 18 THEN substr(t, 1, 17) || '...' ELSE t END AS text_label
        FROM (SELECT *, replace(replace(p_type || chr(10) || p_name, ' ', '·'), chr(10), '\\n') AS t FROM part)""",
    "dedup_exact": _dedup("text"),
    "dedup_strip": _dedup(_strip("text")),
    "dedup_collapse": _dedup(f"regexp_replace({_strip('text')}, '[{SPACE}]+', ' ', 'g')"),
    "dedup_resume": f"""WITH {RESPONSES}, hashed AS (SELECT seq, sha256({_strip("text")}) AS hash FROM responses), half AS (SELECT coalesce(max(seq), 0) // 2 AS h FROM responses),
        seen AS (SELECT DISTINCT hash FROM hashed, half WHERE seq < h),
        marked AS (SELECT seq, hash, row_number() OVER (PARTITION BY hash ORDER BY seq) = 1 AND hash NOT IN (SELECT hash FROM seen) AS is_unique FROM hashed, half WHERE seq >= h)
        SELECT seq AS doc_id, hash, is_unique, CASE WHEN is_unique THEN ((SELECT count(*) FROM seen) + sum(is_unique::INTEGER) OVER (ORDER BY seq))::BIGINT ELSE 0 END AS unique_index FROM marked""",
    "dedup_stream": """WITH marked AS (SELECT event_id, row_number() OVER (PARTITION BY event_type || props ORDER BY event_id) = 1 AS is_unique FROM events)
        SELECT event_id, is_unique, CASE WHEN is_unique THEN (sum(is_unique::INTEGER) OVER (ORDER BY event_id))::BIGINT ELSE 0 END AS unique_index FROM marked""",
    "prefix_validity": """SELECT l_orderkey, count(*) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS is_valid FROM lineitem GROUP BY l_orderkey""",
    "prefix_splice": """SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber) || ',271,91' AS input_ids, string_agg('1', ',') || ',1,1' AS attention_mask, string_agg('1', ',') || ',0,0' AS token_type_ids
        FROM lineitem GROUP BY l_orderkey HAVING min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*)""",
    "forced_ids_parsed": """SELECT nth, ids FROM (VALUES (0::BIGINT, '271,91'), (1, '7,8'), (2, NULL), (3, NULL), (4, '5')) v(nth, ids)""",
    "trailing_trim": """WITH tokens AS (SELECT vec_id // 20 AS response_id, vec_id AS pos, label AS token_id FROM embeddings),
        kept AS (SELECT *, max(CASE WHEN token_id NOT IN (0, 2) THEN pos END) OVER (PARTITION BY response_id) AS last FROM tokens)
        SELECT response_id, string_agg(token_id::VARCHAR, ',' ORDER BY pos) AS kept_ids FROM kept WHERE pos <= last GROUP BY response_id""",
    "chat_messages": """SELECT conv_id, turn, '[{"role":"user","content":[{"type":"image","image":"image-' || conv_id || '","min_pixels":2048,"max_pixels":16777216},{"type":"text","text":' || to_json(text)::VARCHAR || '}]}]' AS message
        FROM conversations WHERE role = 'user'""",
    "privileged_prompts": """SELECT conv_id, turn, length(b.text)::BIGINT AS num_chars, sha256(b.text) AS sha256, sha256(c.text || chr(10) || chr(10) || b.text) AS prompt_sha256
        FROM conversations c JOIN benchmark b ON b.item_id = c.conv_id % 40 WHERE role = 'user'""",
    "patch_grid": f"WITH {GRID} SELECT * FROM grid",
    "region_clip": """WITH raw AS (SELECT p_partkey, 64 + 3 * p_size AS w, 48 + p_partkey % 50 AS h, CASE WHEN p_partkey % 3 = 0 THEN list_transform(b, lambda v: v / 256.0::DOUBLE) ELSE b END AS b
            FROM (SELECT *, [p_size * 3.0::DOUBLE, (p_partkey % 40)::DOUBLE, p_size * 3.0::DOUBLE + (p_partkey % 60) - 5.0::DOUBLE, p_partkey % 40 + p_size % 13 + 0.5::DOUBLE] AS b FROM part)),
        scaled AS (SELECT *, CASE WHEN list_max(b) <= 1.5 THEN [b[1] * w, b[2] * h, b[3] * w, b[4] * h] ELSE b END AS s FROM raw),
        whole AS (SELECT p_partkey, w, h, greatest(0, round_even(least(s[1], s[3]), 0)::INTEGER) AS x1, greatest(0, round_even(least(s[2], s[4]), 0)::INTEGER) AS y1,
                         least(w, round_even(greatest(s[1], s[3]), 0)::INTEGER) AS x2, least(h, round_even(greatest(s[2], s[4]), 0)::INTEGER) AS y2 FROM scaled),
        padded AS (SELECT p_partkey, greatest(0, x1 - 2)::INTEGER AS x1, greatest(0, y1 - 2)::INTEGER AS y1, least(w, x2 + 2)::INTEGER AS x2, least(h, y2 + 2)::INTEGER AS y2 FROM whole WHERE x2 > x1 AND y2 > y1)
        SELECT * FROM padded WHERE x2 - x1 >= 4 AND y2 - y1 >= 4""",
    "region_sample": f"WITH {GRID}, {_sampled('grid', 'p_partkey')} SELECT * FROM sampled",
    "dark_threshold": f"""WITH {PIXELS}, t AS (SELECT image, least(220, greatest(80, floor(quantile_cont(gray, 0.2) + 25)))::INTEGER AS threshold FROM pixels GROUP BY image)
        SELECT image, threshold, count(*) FILTER (WHERE gray <= threshold) AS n_dark FROM pixels JOIN t USING (image) GROUP BY image, threshold""",
    "text_lines": f"WITH {LINES.format(lines=_runs('rows_', 'image', 'y', 0))} SELECT * FROM lines",
    "word_boxes_detected": f"""WITH {LINES.format(lines=_runs("rows_", "image", "y", 2))},
        cols AS (SELECT DISTINCT l.image, y1, y2, x FROM dark d JOIN lines l ON d.image = l.image AND d.y >= y1 AND d.y < y2)
        SELECT image, a::INTEGER AS x1, y1, b::INTEGER AS x2, y2 FROM ({_runs("cols", "image, y1, y2", "x", 2)}) WHERE b - a >= 4""",
    "degrade_patches": f"""WITH {PIXELS},
        grid AS (SELECT image, gx * 16 AS x1, gy * 16 AS y1, least(gx * 16 + 16, width) AS x2, least(gy * 16 + 16, height) AS y2
                 FROM images, LATERAL (SELECT unnest(range((width + 15) // 16)) AS gx), LATERAL (SELECT unnest(range((height + 15) // 16)) AS gy)),
        {_sampled("grid", "image")}, means AS (SELECT image, avg(gray) AS m FROM pixels GROUP BY image)
        SELECT p.image, y, x, CASE WHEN s.image IS NULL THEN gray ELSE floor(gray * 0.5::DOUBLE + m * 0.5::DOUBLE)::INTEGER END AS value
        FROM pixels p JOIN means USING (image) LEFT JOIN sampled s ON p.image = s.image AND x >= x1 AND x < x2 AND y >= y1 AND y < y2""",
    "degrade_overlap": f"""WITH {PIXELS} SELECT image, y, x, floor(gray * CASE WHEN x >= 8 AND x < 40 AND y >= 8 AND y < 30 THEN 0.5::DOUBLE ELSE 1 END
        * CASE WHEN x >= 20 AND x < 60 AND y >= 15 AND y < 45 THEN 0.5::DOUBLE ELSE 1 END)::INTEGER AS value FROM pixels""",
    "degrade_white": _steps("gray", "v * (1 - 0.3::DOUBLE) + 255 * 0.3::DOUBLE"),
    "degrade_noise_fill": _steps("gray", f"v * 0 + floor({_uniform('7-fill-gray')} * 256)"),
    "degrade_noise": _steps("gray", f"v * 0 + least(255, greatest(0, v + sqrt(-2 * ln(1 - {_uniform('7-a-gray')})) * cos(2 * pi() * {_uniform('7-b-gray')}) * 25))"),
    "degrade_blur": f"""WITH {PIXELS}, {_blur("gray")} SELECT p.image, p.y, p.x, CASE WHEN {IN_A} OR {IN_B} THEN soft::INTEGER ELSE gray END AS value
        FROM pixels p JOIN soft_gray s ON p.image = s.image AND p.y = s.y AND p.x = s.x""",
    "degrade_colour": f"""WITH {COLOURS}, {", ".join(_blur(c) for c in "rgb")}, means AS (SELECT image, avg(r) AS r, avg(g) AS g, avg(b) AS b FROM pixels GROUP BY image),
        both_ AS (SELECT p.*, {", ".join(f"s{c}.soft * 0.65::DOUBLE + m.{c} * 0.35::DOUBLE AS to_{c}" for c in "rgb")}, ({IN_A})::INTEGER + ({IN_B})::INTEGER AS n
            FROM pixels p JOIN means m ON p.image = m.image {" ".join(f"JOIN soft_{c} s{c} ON p.image = s{c}.image AND p.y = s{c}.y AND p.x = s{c}.x" for c in "rgb")})
        SELECT image, y, x, {", ".join(f"CASE n WHEN 0 THEN {c} WHEN 1 THEN floor({c} * 0.5::DOUBLE + to_{c} * 0.5::DOUBLE)::INTEGER ELSE floor(({c} * 0.5::DOUBLE + to_{c} * 0.5::DOUBLE) * 0.5::DOUBLE + to_{c} * 0.5::DOUBLE)::INTEGER END AS {c}" for c in "rgb")} FROM both_""",
    "gray_from_colour": f"WITH {COLOURS} SELECT image, y, x, (299 * r + 587 * g + 114 * b)::INTEGER // 1000 AS gray FROM pixels",
    "patch_mask_colour": f"""WITH {COLOURS}, {SMALL_GRID}, {_sampled("grid", "image")}
        SELECT p.image, y, x, {", ".join(f"CASE WHEN s.image IS NULL THEN {c} ELSE 0 END AS {c}" for c in "rgb")}
        FROM pixels p LEFT JOIN sampled s ON p.image = s.image AND x >= x1 AND x < x2 AND y >= y1 AND y < y2""",
    "mask_record": f"""WITH {PIXELS}, {SMALL_GRID}, {_sampled("grid", "image")}
        SELECT image, width AS image_width, height AS image_height, 'patch' AS strategy, 'replace' AS effect, (SELECT count(*) FROM grid g WHERE g.image = i.image) AS num_candidates,
            count(*) OVER (PARTITION BY image) AS num_selected, (width + 15) // 16 AS grid_width, (height + 15) // 16 AS grid_height, NULL::VARCHAR AS word_box_source,
            (row_number() OVER (PARTITION BY image ORDER BY y1, x1, y2, x2) - 1)::INTEGER AS nth, x1, y1, x2, y2, 'patch' AS source, 16 AS patch_size, 0.35::DOUBLE AS ratio, 7 AS seed
        FROM sampled JOIN images i USING (image)""",
    "mask_metadata": f"""WITH {GRID}, {_sampled("grid", "p_partkey")} SELECT p_partkey, num_candidates, coalesce(num_selected, 0) AS num_selected
        FROM (SELECT p_partkey, count(*) AS num_candidates FROM grid GROUP BY p_partkey) LEFT JOIN (SELECT p_partkey, count(*) AS num_selected FROM sampled GROUP BY p_partkey) USING (p_partkey)""",
    "html_escaped": """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages""",
    "report_hue": f"""WITH {PAIRED} SELECT response_id, token_index, round_even(8 + 128 * greatest(0, least(1, round(p_original, 6))), 1) AS hue_original,
        round_even(8 + 128 * greatest(0, least(1, round(p_masked, 6))), 1) AS hue_masked FROM paired""",
    "plot_ticks": """SELECT vec_id // 100 AS response_id, (vec_id % 100)::INTEGER AS token_index, (vec_id % 100) % greatest(1, count(*) OVER (PARTITION BY vec_id // 100) // 40) = 0 AS is_tick FROM embeddings""",
    "word_boxes_json": """SELECT * FROM (VALUES (0::BIGINT, 120, 240, 188, 260), (0, 210, 240, 280, 260), (0, 300, 240, 360, 260), (1, 1, 2, 3, 4), (1, 5, 6, 7, 8), (2, 10, 20, 40, 60), (3, 40, 60, 200, 120), (6, 10, 10, 20, 30), (7, 10, 20, 40, 60), (9, 5, 6, 7, 8), (9, 15, 16, 27, 28), (9, 1, 2, 4, 6), (9, 30, 40, 50, 60)) v(id, x1, y1, x2, y2)""",
    "csv_roundtrip": f"""WITH {PAIRED}, {VOCAB}, raw AS (
            SELECT p.*, coalesce(CASE (response_id * 20 + token_index) % 50 WHEN 0 THEN 'a,b' WHEN 1 THEN 'say "x"' WHEN 2 THEN 'two' || chr(10) || 'lines' WHEN 3 THEN 'back\\slash'
                WHEN 4 THEN ' leading' WHEN 5 THEN '' WHEN 6 THEN 'lone' || chr(13) || 'return' END, v.raw_token) AS raw_token, o.raw_token AS top_raw_token_original, m.raw_token AS top_raw_token_masked
            FROM paired p LEFT JOIN vocab v ON p.token_id = v.token_id LEFT JOIN vocab o ON top_token_id_original = o.token_id LEFT JOIN vocab m ON top_token_id_masked = m.token_id)
        SELECT response_id, token_index AS index, token_id, {_shown("raw_token")} AS token, raw_token, round(p_original, 6) AS p_original, round(p_masked, 6) AS p_masked, {_no_sign("delta_p")} AS delta_p,
            round(logp_original, 6) AS logp_original, round(logp_masked, 6) AS logp_masked, {_no_sign("delta_logp")} AS delta_logp, top_token_id_original, {_shown("top_raw_token_original")} AS top_token_original,
            top_raw_token_original, round(top_p_original, 6) AS top_p_original, round(top_logp_original, 6) AS top_logp_original, top_token_id_masked, {_shown("top_raw_token_masked")} AS top_token_masked,
            top_raw_token_masked, round(top_p_masked, 6) AS top_p_masked, round(top_logp_masked, 6) AS top_logp_masked, top_token_changed, target_is_top_original, target_is_top_masked FROM raw""",
    "prefix_csv": "SELECT l_linenumber - 1 AS index, l_partkey::INTEGER AS token_id FROM lineitem",
    "manifest_lines": "SELECT sha256(props) AS hash, event_id AS unique_index, 'strip' AS compare_mode FROM events WHERE event_id % 6 = 0",
}
_RAW = ORACLE_SQL["csv_roundtrip"][: ORACLE_SQL["csv_roundtrip"].index("SELECT response_id, token_index AS index")]
ORACLE_SQL |= {
    "unit_csv": ORACLE_SQL["unit_scores"],
    "json_payload": f"""{_RAW} SELECT response_id, 'recorded' AS model_id, 2 AS num_chars, sha256('né') AS sha256, 'original_image_response' AS label,
        (count(*) OVER (PARTITION BY response_id))::INTEGER AS n, true AS same, token_index AS index, token_id, raw_token, round(p_original, 6) AS p_original, top_token_changed FROM raw""",
    "table_rows": f"""{_RAW} SELECT response_id, token_index, '<tr><td>' || token_index || '</td><td>' || replace(replace(replace(replace(replace({_shown("raw_token")}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')
        || '</td><td>' || printf('%.6f', p_original) || '</td><td>' || printf('%+.6f', delta_p) || '</td><td>' || CASE WHEN top_token_changed THEN 'yes' ELSE 'no' END || '</td></tr>' AS html FROM raw""",
    "prompt_ids": f"""WITH {VOCAB}, said AS (
            SELECT id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos
            FROM (SELECT conv_id * 100 + turn AS id, regexp_extract_all(text, '{PIECE}') AS p FROM conversations WHERE role = 'user'))
        SELECT id, count(*)::INTEGER AS n, count(token_id)::INTEGER AS known, string_agg(coalesce(token_id, 64), ',' ORDER BY pos) AS ids
        FROM said LEFT JOIN vocab ON said.piece = vocab.raw_token GROUP BY id""",
    "generate_greedy": f"""WITH RECURSIVE {VOCAB}, {GREEDY.format(start="SELECT p_partkey, p_partkey % 64 AS last, 0 AS n, []::BIGINT[] AS ids FROM part", most=12)}
        SELECT p_partkey, array_to_string(kept, ',') AS ids, {_said("kept")} AS text FROM trimmed""",
    "generate_prefilled": f"""WITH RECURSIVE {VOCAB}, {GREEDY.format(start="SELECT p_partkey, p_partkey % 7 AS last, 0 AS n, []::BIGINT[] AS ids FROM part", most=8)},
        whole AS (SELECT p_partkey, kept, [5::BIGINT, p_partkey % 7] || kept AS every FROM trimmed)
        SELECT p_partkey, array_to_string(kept, ',') AS continuation_ids, {_said("kept")} AS continuation_text, array_to_string(every, ',') AS full_ids, {_said("every")} AS full_text FROM whole""",
}
