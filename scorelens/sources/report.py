"""Reports: HTML tables with colour strips, and charts as SVG.

Rows become HTML on the executors; one response's rows are gathered in order into its report.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators.scores import hue

#: Cells of a row in token and in unit tables.
TOKEN_CELLS = ["index", "token_id", "token", "p_original", "p_masked", "delta_p", "logp_original", "logp_masked", "delta_logp", "top_token_original", "top_p_original", "top_token_masked", "top_p_masked", "top_token_changed", "target_is_top_original", "target_is_top_masked", "raw_token"]
UNIT_CELLS = ["index", "unit_type", "text", "token_start", "token_end", "token_count", "image_dependency_logp", "first_token_logp_original", "first_token_logp_masked", "p_original", "p_masked", "delta_p", "sum_logp_original", "sum_logp_masked", "delta_sum_logp", "mean_logp_original", "mean_logp_masked"]


def cell(name: str, kind: str) -> Column:
    """A table cell; differences carry their sign."""
    c = F.col(name)
    if kind == "double":
        shown = F.format_string("%+.6f" if "delta" in name or name == "image_dependency_logp" else "%.6f", c)
    elif kind == "boolean":
        shown = F.when(c, "yes").otherwise("no")
    else:
        shown = T.html_escape(c.cast("string"))
    return F.concat(F.lit("<td>"), F.coalesce(shown, F.lit("")), F.lit("</td>"))


def row(table: DataFrame, cells: list[str]) -> Column:
    kinds = dict(table.dtypes)
    return F.concat(F.lit("<tr>"), *(cell(c, kinds[c]) for c in cells), F.lit("</tr>"))


def span(text: Column, p: Column) -> Column:
    """A piece of text on the colour of its probability."""
    return F.concat(F.lit('<span style="background:hsl('), hue(p).cast("string"), F.lit(' 70% 75%)">'), T.html_escape(text), F.lit("</span>"))


def html(scores: DataFrame, cells: list[str], order: str, text: str, p: tuple[str, str], title: str, labels: tuple[str, str], about: dict[str, str] | None = None, metadata: dict | None = None) -> DataFrame:
    """response_id, html: a report for each response: what the run was (``about``, with the text
    of the response), its metadata, a strip for each condition and the table.  ``p`` names the
    probabilities that colour the strips (of units: exp of the first token's logp)."""
    strips = [span(F.col(text), V.safe_exp(F.col(c)) if "logp" in c else F.col(c)) for c in p]
    raw = F.col("raw_text" if "raw_text" in scores.columns else "raw_token" if "raw_token" in scores.columns else text)
    drawn = scores.select("response_id", F.struct(order, row(scores, cells).alias("row"), raw.alias("raw"), *(s.alias(f"s{k}") for k, s in enumerate(strips))).alias("x"))
    whole = drawn.groupBy("response_id").agg(F.array_sort(F.collect_list("x")).alias("x"))

    def joined(field: str) -> Column:
        return F.array_join(F.transform("x", lambda v: F.coalesce(v[field], F.lit(""))), "")

    def panel(name: str, body: Column) -> list[Column]:
        return [F.lit(f"<h2>{_plain(name)}</h2><pre>"), T.html_escape(body), F.lit("</pre>")]

    head = "".join(f"<th>{c}</th>" for c in cells)
    parts = [F.lit(f'<!doctype html><html lang="en"><meta charset="utf-8"><title>{_plain(title)}</title><h1>{_plain(title)}</h1>')]
    for name, value in (about or {}).items():
        parts += panel(name, F.lit(value))
    parts += panel("Generated text", joined("raw"))
    if metadata is not None:
        parts += panel("Metadata", F.lit(json.dumps(metadata, ensure_ascii=False, indent=2)))
    for k, label in enumerate(labels):
        parts += [F.lit(f"<h2>{_plain(label.title())}</h2><p>"), joined(f"s{k}"), F.lit("</p>")]
    body = F.concat(*parts, F.lit(f"<table><tr>{head}</tr>"), joined("row"), F.lit("</table></html>"))
    return whole.select("response_id", body.alias("html"))


def charts(scores: DataFrame, labels: tuple[str, str]) -> DataFrame:
    """response_id, svg: the chart of each response, drawn where its rows are."""
    from ..functions.text import compact_token

    def draw(pdf):
        import pandas as pd

        got = pdf.sort_values("index").to_dict("records")
        return pd.DataFrame({"response_id": [got[0]["response_id"]], "svg": [chart(got, labels)]})

    kind = dict(scores.dtypes)["response_id"]
    drawn = scores.select("response_id", "index", "p_original", "p_masked", F.coalesce(compact_token(F.col("token")), F.lit("")).alias("compact"))
    return drawn.groupBy("response_id").applyInPandas(draw, f"response_id {kind}, svg string")


def chart_width(n: int) -> float:
    """Inches: 0.28 for each token, within 10..28."""
    return min(28.0, max(10.0, 0.28 * n))


def chart(scores: list[dict], labels: tuple[str, str]) -> str:
    """An SVG of both conditions' probabilities over the tokens of one response."""
    if not scores:
        raise ValueError("no scores to draw")
    w, h, n = chart_width(len(scores)) * 72, 288, len(scores)
    x = lambda k: 30 + (w - 40) * k / max(1, n - 1)
    y = lambda p: 10 + (h - 60) * (1 - p)
    lines = [[f"{x(k):.1f},{y(s[c]):.1f}" for k, s in enumerate(scores)] for c in ("p_original", "p_masked")]
    area = " ".join(lines[0] + lines[1][::-1])
    ticks = "".join(f'<text x="{x(k):.1f}" y="{h - 30}" font-size="8" transform="rotate(60 {x(k):.1f} {h - 30})">{_plain(s["compact"])}</text>' for k, s in enumerate(scores) if k % max(1, n // 40) == 0)
    drawn = "".join(f'<polyline fill="none" stroke="{c}" points="{" ".join(p)}"><title>{_plain(t)}</title></polyline>' for p, c, t in zip(lines, ("#1f77b4", "#d62728"), labels, strict=True))
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{w:.0f}" height="{h}"><polygon fill="#ddd" points="{area}"/>{drawn}{ticks}</svg>'


def _plain(text: str) -> str:
    from html import escape

    return escape(text)
