"""Text functions with the white-space and escaping rules of the data model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that count as white space.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORD = r"\p{L}\p{N}_"
#: A tokeniser that covers every character: short word pieces, single spaces, other pairs.
PIECE = rf"[ \n]?[{WORD}]{{1,4}}|[{SPACE}]|[^{WORD}{SPACE}]{{1,2}}"
#: What its pieces make up: of word and of other characters all that stand together, single spaces.
UNIT = rf"[ \n]?[{WORD}]+|[{SPACE}]|[^{WORD}{SPACE}]+"
COMPARE_MODES = ("exact", "strip", "collapse-space")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    return F.regexp_replace(strip(text), rf"[{SPACE}]+", " ")


def normalise(text: Column, mode: str) -> Column:
    """``text`` as it is compared: as it is, stripped, or with single spaces as well."""
    if mode not in COMPARE_MODES:
        raise ValueError(f"compare mode must be one of {COMPARE_MODES}, not {mode!r}")
    return {"exact": lambda t: t, "strip": strip, "collapse-space": collapse}[mode](text)


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def piece_type(piece: Column) -> Column:
    """'space' if nothing but white space (or nothing), 'word' if any letter, digit or '_'."""
    return F.when(piece.rlike(rf"[{WORD}]"), "word").when(piece.rlike(rf"[^{SPACE}]"), "punct").otherwise("space")


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def pieces_in(unit: Column, kind: Column) -> Column:
    """How many pieces the tokeniser makes of a unit."""
    led = F.left(unit, F.lit(1)).isin(" ", "\n").cast("int")
    return F.when(kind == "word", F.ceil((F.length(unit) - led) / 4)).when(kind == "punct", F.ceil(F.length(unit) / 2)).otherwise(1).cast("int")


def _shown(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def display(piece: Column) -> Column:
    """Line ends and tabs as escapes."""
    return _shown(piece, [("\n", "\\n"), ("\t", "\\t")])


def _short(text: Column, most: int, kept: int, mark: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, kept), F.lit(mark))).otherwise(text)


def compact_token(token: Column) -> Column:
    """A label of at most 12 characters, spaces as dots."""
    return _short(_shown(token, [(" ", "·")]), 12, 11, "…")


def compact_text(text: Column) -> Column:
    """A label of at most 20 characters, spaces as dots and line ends as escapes."""
    return _short(_shown(text, [(" ", "·"), ("\n", "\\n")]), 18, 17, "...")


def html_escape(text: Column) -> Column:
    return _shown(text, [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")])
