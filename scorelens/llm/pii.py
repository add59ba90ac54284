"""Personal data: fixed base patterns, and further candidates judged by boosted trees.

All of it on documents is DataFrame functions.  Several high-recall generators for each kind
propose spans that the base patterns miss (addresses with spelt-out, bracketed or spaced signs,
version-6 and defanged addresses, card numbers with other separators, telephone numbers without a
plus); spans of different generators may overlap.  Gradient-boosted trees judge a candidate by
format and context, a logistic curve fitted on examples set aside turns their sum into a
probability, and each kind has its threshold: the lowest probability, and at least a half, above
which PRECISION of those examples are right.  Of accepted candidates that overlap the best stays,
and none may overlap a base span.

The trees are trained here, on ``EXAMPLES`` made-up sentences in which a span is known to be
personal data or to look like it.  Both sorts have the same shapes, and words that speak for or
against stand beside both, only more or less often; half of such words are none that the features
know.  The features come from the same expressions as those of documents, and the trees become
expressions in turn.  Training does not depend on documents and is done once in a process.

Positions are found from what lies between the matches (split by the same pattern).  Possessive
quantifiers and look-behinds give the matches of the plain patterns in linear time.

Overlaps are looked for among the spans of about sqrt(n) stretches of the text, so that n spans
take about n * sqrt(n) steps.

Defined cases: null text is empty and has no spans; texts of any length are read as a whole; rows
repeated give rows repeated; a null doc_id stays null; positions are code points, the end
exclusive; of overlapping candidates with equal scores that of the first generator as listed, then
the first start, then the longer one stays; an empty table gives an empty result; further columns, whatever
their names, are left out.
"""

from __future__ import annotations

import json
import random
import zlib
from dataclasses import dataclass
from functools import partial, reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .toxicity import linear

KINDS = ("email", "ip", "card", "phone")
#: The base patterns, and a cheap test that a text can match at all.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    "card": (r"[0-9](?:[ -]?+[0-9])++", r"[0-9][ -]?[0-9]"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]"),
}
_AT, _DOT = r"[\[({]at[\])}]", r"[\[({](?:dot|\.)[\])}]"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Generators of further candidates: kind, pattern, and a test that every text with a match passes.
MORE = {
    "email_bracketed": ("email", rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:{_AT}|@) ?[a-z0-9-]++(?: ?(?:{_DOT}|\.) ?[a-z0-9-]++)++", rf"(?i)(?:{_AT}|@) ?[a-z0-9-]++ ?(?:{_DOT}|\.)"),
    "email_spelt": ("email", rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++(?: at | ?{_AT} ?| ?@ ?)[a-z0-9-]++(?:(?: dot | ?{_DOT} ?|\.)[a-z0-9-]++)++", rf"(?i)(?: at |{_AT} ?|@ ?)[a-z0-9-]++(?: dot | ?{_DOT}|\.)"),
    "ip_full": ("ip", rf"(?<![0-9A-Fa-f:]){_HEX}+(?:::?+{_HEX}+){{4,7}}+", "[0-9A-Fa-f]:[0-9A-Fa-f:]"),
    "ip_short": ("ip", rf"(?<![0-9A-Za-z:])(?:{_HEX}(?::{_HEX}){{0,6}}+::(?:{_HEX}(?::{_HEX}){{0,6}}+)?+|::{_HEX}(?::{_HEX}){{0,6}}+)(?![0-9A-Za-z:])", "::"),
    "ip_defanged": ("ip", r"(?<![0-9])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\))[0-9]{1,3}+){3}+(?![0-9])", r"[0-9][\[(](?:\.|dot)[\])][0-9]"),
    "card_fours": ("card", r"(?<![0-9])[0-9]{4}(?:[./_:]?+[0-9]{4}){3}+(?![0-9])", r"[0-9]{4}[./_:]?[0-9]{4}"),
    "card_spaced": ("card", r"(?<![0-9])[0-9]{4}(?:(?: ?[./_:-] ?|  )[0-9]{4}){3}+(?![0-9])", r"[0-9]{4}[ ./_:-]{1,3}[0-9]{4}"),
    "phone_national": ("phone", r"(?<![0-9A-Za-z+])(?:00[0-9]{1,3}[ .-]?+)?+\(?+[0-9]{2,4}\)?+[ ./-][0-9]{3,4}[ ./-]?+[0-9]{3,4}(?![0-9A-Za-z])", r"[0-9]{3}[ ./-]?[0-9]{3}"),
    "phone_pairs": ("phone", r"(?<![0-9A-Za-z+])0[0-9](?:[ .-][0-9]{2}){4}(?![0-9A-Za-z])", r"0[0-9][ .-][0-9]{2}[ .-]"),
}
TOP_LEVEL = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu"
#: Words before a span that speak for its kind, and words that speak against any.
CUES = {
    "email": "mail|contact|write|reach|send",
    "ip": "ip|address|host|server|login|from",
    "card": "card|visa|credit|payment|paid|debit",
    "phone": "call|phone|tel|mobile|fax|dial|ring",
}
AGAINST = "order|version|isbn|invoice|item|ref|id|build|serial|section|date|score|time|hash"
FEATURES = ("kind", "length", "digits", "letters", "separators", "cue", "against", "luhn", "spelt", "groups", "touches", "follows", "top_level", "parts")
EXAMPLES = 4_000
#: Characters of a text from which parts are taken.
STRETCH = 4_096
TREES, DEPTH, RATE = 40, 3, 0.3
PRECISION = 0.9


def _matches(text: Column, pattern: str, hint: str) -> Column:
    return F.when(text.rlike(hint), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(999)) <= 255)
    if kind == "card":
        digits = F.regexp_replace(m, "[ -]", "")
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(9, 15)
    return F.lit(True)


def _spans(matches: Column, gaps: Column, valid) -> Column:
    """array<struct<start, end, text, before, after>> of the valid matches, in order.

    A match starts after all gaps and matches before it.  Sums are taken over blocks of about
    sqrt(n) first, so that n matches take n * sqrt(n) steps at most.
    """
    n = F.size(matches)
    zero = F.lit(0)
    steps = F.transform(F.sequence(zero, n - 1), lambda i: F.length(F.get(gaps, i)) + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(zero))
    block = F.ceil(F.sqrt(n)).cast("int")

    def total(a: Column) -> Column:
        return F.aggregate(a, zero, lambda s, x: s + x)

    def from_steps(d: Column) -> Column:
        sums = F.transform(F.sequence(zero, F.ceil(n / block).cast("int") - 1), lambda b: total(F.slice(d, b * block + 1, block)))

        def one(i: Column, sums: Column) -> Column:
            b = F.floor(i / block).cast("int")
            start = total(F.slice(sums, F.lit(1), b)) + total(F.slice(d, b * block + 1, i - b * block + 1))
            m = F.get(matches, i)
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("text"), F.right(F.get(gaps, i), F.lit(24)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(2)).alias("after"))

        good = F.filter(F.sequence(zero, n - 1), lambda i: valid(F.get(matches, i)))
        return F.flatten(F.transform(F.array(sums), lambda s: F.transform(good, lambda i: one(i, s))))

    return F.flatten(F.transform(F.array(steps), from_steps))


PARTS = ("start", "end", "text", "before", "after")
EMPTY = "array<struct<start:int,end:int,text:string,before:string,after:string>>"
SCORED = EMPTY[:-2] + ",score:double>>"
JUDGED = SCORED[:-2] + ",kind:string,by:int>>"


def _located(docs: DataFrame, patterns: dict, prefix: str, valid) -> DataFrame:
    """Adds a column of spans for each kind; texts without a match are not split."""
    found = docs.withColumns({f"{prefix}m_{k}": _matches(F.col("text"), p, hint) for k, (p, hint) in patterns.items()})
    ready = found.withColumns({f"{prefix}m_{k}": F.when(F.exists(f"{prefix}m_{k}", partial(valid, k)), F.col(f"{prefix}m_{k}")) for k in patterns})
    cut = ready.withColumns({f"{prefix}g_{k}": F.when(F.col(f"{prefix}m_{k}").isNotNull(), F.split("text", p, -1)) for k, (p, _) in patterns.items()})
    spans = {
        f"{prefix}{k}": F.when(F.col(f"{prefix}m_{k}").isNull(), F.array().cast(EMPTY)).otherwise(_spans(F.col(f"{prefix}m_{k}"), F.col(f"{prefix}g_{k}"), partial(valid, k)))
        for k in patterns
    }
    return cut.withColumns(spans).drop(*(f"{prefix}{x}_{k}" for x in "mg" for k in patterns))


def _features(kind: str, x: Column) -> list[Column]:
    text, before = x["text"], F.lower(x["before"])
    digits = F.regexp_replace(text, "[^0-9]", "")
    yes = lambda c: c.cast("int")
    return [
        F.lit(KINDS.index(kind)),
        F.length(text),
        F.length(digits),
        F.length(F.regexp_replace(text, "[^A-Za-z]", "")),
        F.length(F.regexp_replace(text, "[A-Za-z0-9]", "")),
        yes(before.rlike(rf"(?:^|[^a-z])(?:{CUES[kind]})[a-z]{{0,6}}\W")),
        yes(before.rlike(rf"(?:^|[^a-z])(?:{AGAINST})[a-z]{{0,3}}\W")),
        yes(F.call_function("luhn_check", digits)),
        yes(text.rlike(r"[\[({]|\s(?:at|dot)\s")),
        F.size(F.split(text, "[^A-Za-z0-9]+")),
        yes(before.rlike(r"[\w.:/#$-]$")),
        yes(x["after"].rlike(r"^[\w/:-]|^\.\w")),
        yes(text.rlike(rf"(?i)[^a-z0-9](?:{TOP_LEVEL})$")),
        F.length(F.regexp_extract(text, "^[0-9A-Za-z]*", 0)),
    ]


def _numbers(kind: str, x: Column) -> Column:
    return F.array(*(c.cast("double") for c in _features(kind, x)))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int):
    """A tree: a number, or (feature, threshold, below or equal, above)."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 20:
        for f in range(x.shape[1]):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            values, gl, hl = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
            ends = np.nonzero(values[1:] != values[:-1])[0]
            if len(ends):
                gain = gl[ends] ** 2 / (hl[ends] + 1) + (g - gl[ends]) ** 2 / (h - hl[ends] + 1) - g**2 / (h + 1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], f, float(values[ends[k]] + values[ends[k] + 1]) / 2)
    if best[1] is None:
        return float(RATE * g / (h + 1))
    low = x[rows, best[1]] <= best[2]
    return best[1], best[2], _grow(x, grad, hess, rows[low], depth - 1), _grow(x, grad, hess, rows[~low], depth - 1)


def _predict(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    return np.where(x[:, tree[0]] <= tree[1], _predict(tree[2], x), _predict(tree[3], x))


def boost(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> list:
    """Trees whose sum is the log-odds of y."""
    z, out = np.zeros(len(y)), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        tree = _grow(x, y - p, p * (1 - p), np.arange(len(y)), DEPTH)
        z += _predict(tree, x)
        out.append(tree)
    return out


def _sql(tree) -> str:
    """A tree as SQL over x.f, the features of a candidate x."""
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    return f"CASE WHEN x.f[{tree[0]}] <= {tree[1]!r}D THEN {_sql(tree[2])} ELSE {_sql(tree[3])} END"


def examples(n: int = EXAMPLES, seed: int = 5) -> list[tuple[str, int]]:
    """Made-up sentences with one span that some generator proposes, and whether it is personal
    data.  Shapes are shared; what differs is how often digits check, names end like sites, groups
    have usual sizes, and which words stand before."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    usual = "the of and to in is that with for was on are as it this be by at from".split()
    prose = lambda k: " ".join(r.choice(usual) if r.random() < 0.4 else word() for _ in range(k))
    hexed = lambda k: ":".join(f"{r.randrange(16 ** r.randint(1, 4)):x}" for _ in range(k))
    good_words = {"email": "mail contact write reach inbox address", "ip": "ip host server login node peer", "card": "card visa credit payment amex bank", "phone": "call phone tel mobile line desk"}
    bad_words = "order version isbn invoice item ref build serial section date part batch lot page figure".split()

    def numbered(checks: bool) -> str:
        body = r.choice("3456") + digits(14)
        total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10) if checks else body + digits(1)

    def span(kind: str, good: bool) -> str:
        odd = r.random() < 0.08  # either sort may look like the other
        like = good != odd
        if kind == "email":
            a, d = r.choice([("[at]", "[dot]"), ("(at)", "(dot)"), ("{at}", "."), (" at ", " dot "), (" AT ", " DOT "), (" [at] ", " [dot] "), (" @ ", "."), ("@", " . "), (" at ", ".")])
            end = r.choice(TOP_LEVEL.split("|")) if like else word()
            return word() + a + word() + d + end
        if kind == "ip":
            shape = r.randrange(4)
            if shape == 0:
                return hexed(8) if like else r.choice([":".join(f"{r.randrange(256):02x}" for _ in range(6)), ":".join(digits(2) for _ in range(r.randint(5, 7)))])
            if shape == 1:
                a, b = ("[.]", "(.)")[r.randrange(2)], 256 if like else 1000
                return a.join(str(r.randrange(b)) for _ in range(4))
            return r.choice([hexed(r.randint(2, 4)) + "::" + hexed(r.randint(1, 3)), "fe80::" + hexed(2), "2001:db8::" + hexed(1)]) if like else r.choice(["add", "bad", "cafe", "dead", "face", "fade"]) + "::" + r.choice(["add", "abc", "bed", "dead", "fed"]) if r.random() < 0.6 else digits(2) + "::" + digits(2)
        if kind == "card":
            body = numbered(like)
            return r.choice([".", "/", "_", ":", " - ", ". ", "  "]).join(body[k : k + 4] for k in range(0, 16, 4))
        if like:
            return r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "0033 {} {} {}", "{} {} {}"]).format(digits(3), digits(3), digits(4)) if r.random() < 0.8 else "0" + digits(1) + "".join(" " + digits(2) for _ in range(4))
        return r.choice(["{}/{}{}", "{}-{}{}", "{} {} {}", "{}-{}-{}", "{}.{}.{}"]).format(digits(r.randint(2, 4)), digits(3), digits(r.randint(3, 4)))

    out = []
    for _ in range(n):
        kind, good, x = r.choice(KINDS), r.random() < 0.5, r.random()
        for_, against = (0.65, 0.7) if good else (0.1, 0.6)
        lead = r.choice(good_words[kind].split()) if x < for_ else r.choice(bad_words) if x < against else word()
        lead += r.choice(["", ":", " no", " is", " at" if kind == "email" else ""])
        touch = r.random() < (0.03 if good else 0.2)
        tail = r.choice(["/" + digits(2), "-" + word(), "_" + word()]) if touch else r.choice([".", ",", " " + prose(2), ""])
        out.append((f"{prose(r.randint(0, 6))} {lead} {span(kind, good)}{tail}", int(good)))
    return out


@dataclass(frozen=True)
class Judge:
    """Trees whose sum goes through a curve (bias, slope); for each kind the sum from which a
    candidate is accepted, and the share of accepted examples set aside that are right."""

    trees: tuple
    curve: tuple[float, float]
    limits: tuple[float, ...]
    right: tuple[float, ...]


_JUDGES: dict[tuple[int, int], Judge] = {}


def candidates_of_examples(spark: SparkSession, made: list[tuple[str, int]]) -> list:
    """Rows (text, y, f) of what the generators propose in examples."""
    given = json.dumps([{"text": t, "y": y} for t, y in made])
    texts = spark.range(1).select(F.inline(F.from_json(F.lit(given), "array<struct<text:string,y:int>>")))
    found = _located(texts, {g: x[1:] for g, x in MORE.items()}, "more_", lambda k, m: F.lit(True))
    every = F.concat(*(F.transform(f"more_{g}", partial(_numbers, x[0])) for g, x in MORE.items()))
    return found.select("text", "y", F.explode(F.array_distinct(every)).alias("f")).orderBy("text", "f").collect()


def train(spark: SparkSession, n: int = EXAMPLES, seed: int = 5) -> Judge:
    if (n, seed) in _JUDGES:
        return _JUDGES[n, seed]
    got = candidates_of_examples(spark, examples(n, seed))
    x, y = np.array([r.f for r in got]), np.array([float(r.y) for r in got])
    half = np.array([zlib.crc32(r.text.encode()) % 2 == 0 for r in got])
    trees = boost(x[half], y[half])
    z, own_y = sum(_predict(t, x[~half]) for t in trees), y[~half]
    bias, slope = linear(np.stack((np.ones(len(z)), z), 1), own_y, penalty=0.01)
    even = -bias / max(slope, 1e-9)  # where the curve says a half
    limits, right = [], []
    for k in range(len(KINDS)):
        own = x[~half][:, 0] == k
        order = np.argsort(-z[own], kind="stable")
        share = np.cumsum(own_y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.nonzero((share >= PRECISION) & (z[own][order] >= even))[0]
        limits.append(float(z[own][order][good[-1]]) if len(good) else float("inf"))
        right.append(float(share[good[-1]]) if len(good) else 0.0)
    _JUDGES[n, seed] = Judge(tuple(trees), (float(bias), float(slope)), tuple(limits), tuple(right))
    return _JUDGES[n, seed]


def _let(value: Column, body) -> Column:
    """``body(value)`` of an array, with the value computed once."""
    return F.flatten(F.transform(F.array(value), body))


def _apart(rows: DataFrame, spans: str, others: str, clash) -> DataFrame:
    """``rows`` with those of ``spans`` for which ``clash`` holds with none of the ``others`` that
    overlap them.  Others are dealt to stretches of the text first, and a span meets those of its
    own.  The stretches' number and width are columns, so that they are not found for each span."""
    rows = rows.withColumn("n_", F.ceil(F.sqrt(F.size(others) + 1)).cast("int")).withColumn("width_", (F.floor(F.length("text") / F.col("n_")) + 1).cast("int"))

    def meets(grouped: Column) -> Column:
        def hit(x: Column) -> Column:
            first = F.floor(x["start"] / F.col("width_")).cast("int")
            own = F.slice(grouped, first + 1, F.floor((x["end"] - 1) / F.col("width_")).cast("int") - first + 1)
            return F.exists(own, lambda g: F.exists(g, lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"]) & clash(x, b)))

        return F.filter(spans, lambda x: ~hit(x))

    stretches = F.transform(F.sequence(F.lit(0), F.col("n_") - 1), lambda s: F.filter(others, lambda b: (b["start"] < (s + 1) * F.col("width_")) & (b["end"] > s * F.col("width_"))))
    return rows.withColumn(spans, F.when((F.size(spans) == 0) | (F.size(others) == 0), F.col(spans)).otherwise(_let(stretches, meets))).drop("n_", "width_")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text, the base spans of each kind as arrays of (start,
    end, text, before, after) in base_*, and accepted further spans in added_*, with a score."""
    judge = train(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = _located(rows, BASE, "base_", _valid)
    rows = _located(rows, {g: x[1:] for g, x in MORE.items()}, "more_", lambda k, m: F.lit(True))
    none = F.array().cast(EMPTY[:-2] + ",by:int,f:array<double>>>")

    def with_features(g: str) -> Column:
        return F.transform(f"more_{g}", lambda x: F.struct(*(x[c].alias(c) for c in PARTS), F.lit(list(MORE).index(g)).alias("by"), _numbers(MORE[g][0], x).alias("f")))

    base = F.concat(*(F.transform(f"base_{k}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for k in KINDS))
    found = reduce(lambda a, b: a | b, (F.size(f"more_{g}") > 0 for g in MORE))
    rows = rows.withColumns({"more": F.when(found, F.concat(*map(with_features, MORE))).otherwise(none), "base": F.when(found, base).otherwise(F.array().cast("array<struct<start:int,end:int>>"))}).drop(*(f"more_{g}" for g in MORE))
    rows = _apart(rows, "more", "base", lambda x, b: F.lit(True)).drop("base")
    total = " + ".join(map(_sql, judge.trees))
    limits = ", ".join(f"{x!r}D" if np.isfinite(x) else "double('inf')" for x in judge.limits)
    parts = ", ".join(f"x.{c} AS {c}" for c in PARTS)
    kind = "element_at(array(" + ", ".join(f"'{k}'" for k in KINDS) + "), int(x.f[0]) + 1)"
    whole = ", ".join(f"x.{c} AS {c}" for c in (*PARTS, "by", "f"))
    judged = f"filter(transform(more, x -> struct({whole}, {total} AS sum)), x -> x.sum >= element_at(array({limits}), int(x.f[0]) + 1))"
    scored = f"transform({judged}, x -> struct({parts}, x.sum AS score, {kind} AS kind, x.by AS by))"
    rows = rows.withColumn("more", F.when(F.size("more") > 0, F.expr(scored)).otherwise(F.array().cast(JUDGED)))

    def beats(x: Column, b: Column) -> Column:
        place = lambda c: F.struct(-c["score"], c["by"], c["start"], -c["end"])
        return (b["score"] >= x["score"]) & (place(b) < place(x))

    rows = _apart(rows, "more", "more", beats)

    def of(k: str) -> Column:
        return F.filter("more", lambda x: x["kind"] == F.lit(k))

    return rows.withColumns({f"added_{k}": of(k) for k in KINDS}).drop("more")


def _kinded(spans: str, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with each span replaced by its kind in brackets; overlapping spans are replaced
    together, by the kind of the one that starts first.

    A text is cut into stretches of STRETCH characters once, from which the parts between spans
    are taken, as a place in a long text is only found by reading up to it.
    """
    found = personal_data(docs, id_col, text_col)
    every = F.array_sort(F.concat(*(_kinded(f"{w}_{k}", k) for w in ("base", "added") for k in KINDS)))
    numbered = F.transform(every, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), i.alias("i")))
    rows = found.select("doc_id", "text", numbered.alias("spans"), F.length("text").alias("n"))
    rows = rows.withColumn("parts", F.when(F.size("spans") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))))

    def between(a: Column, e: Column) -> Column:
        def one(k: Column) -> Column:
            low = F.greatest(a - k * STRETCH, F.lit(0))
            return F.substr(F.get("parts", k), low + 1, F.least(e - k * STRETCH, F.lit(STRETCH)) - low)

        places = F.sequence(F.floor(a / STRETCH).cast("int"), F.floor((e - 1) / STRETCH).cast("int"))
        return F.when(e > a, F.array_join(F.transform(places, one), "")).otherwise("")

    # Spans that no earlier one overlaps open a place; it ends where the last of those before the next ends.
    rows = _apart(rows.withColumn("heads", F.col("spans")), "heads", "spans", lambda x, b: b["i"] < x["i"])

    def place(x: Column, k: Column) -> Column:
        own = F.slice("spans", x["i"] + 1, F.coalesce(F.get("heads", k + 1)["i"], F.size("spans")) - x["i"])
        return F.struct(x["start"].alias("start"), F.array_max(F.transform(own, lambda y: y["end"])).alias("end"), x["kind"].alias("kind"))

    def shown(x: Column, k: Column) -> Column:
        before = F.when(k > 0, F.get("places", k - 1)["end"]).otherwise(F.lit(0))
        return F.concat(between(before, x["start"]), F.lit("["), x["kind"], F.lit("]"))

    rows = rows.withColumn("places", F.transform("heads", place))
    whole = F.concat(F.array_join(F.transform("places", shown), ""), between(F.element_at("places", -1)["end"], F.col("n")))
    return rows.select("doc_id", F.when(F.size("spans") > 0, whole).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and spans, from ``personal_data``."""

    def names(k: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.concat_ws(":", F.lit(k), x["start"].cast("string"), x["end"].cast("string")))

    def both(k: str) -> Column:
        return F.array_sort(F.concat(*(F.transform(f"{w}_{k}", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"))) for w in ("base", "added"))))

    return found.select(
        "doc_id",
        *(F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(F.concat_ws(",", F.concat(*(names(k, F.col(f"base_{k}")) for k in KINDS))), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(*(names(k, both(k)) for k in KINDS))).alias("spans"),
    )
