"""Text of HTML as column expressions: tokens by one pattern, muted parts by a fold over few segments."""

from __future__ import annotations

import html
import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace import fixed_values as fv
from millrace.functions.text import present

RAW_TAGS = [t for t in fv.MUTED_TAGS if t in ("script", "style")]  # their content is never markup
FOLDED_TAGS = [t for t in fv.MUTED_TAGS if t not in RAW_TAGS]
ATTRIBUTES = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
TOKEN = (rf"(?is)<!--.*?(?:-->|\z)|<({'|'.join(RAW_TAGS)})(?=[\s/>]){ATTRIBUTES}.*?(?:</\1\s*>|\z)"
         rf"|</?[a-z]{ATTRIBUTES}|</?[a-z][^>]*>|<[!?][^>]*>|[^<]+|<")
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)|[^&]+|&"
MUTE, SPEAK = "\x01", "\x02"

# Names that browsers also know without a semicolon, longest first.
BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
NAMES = json.dumps({"&" + n: c for n, c in html5.items()})
LOW = json.dumps({str(n): html.unescape(f"&#{n};") for n in range(160)})  # control characters have odd rules


def _table(text: str) -> Column:
    """A constant map; the optimizer folds the parsing away."""
    return F.from_json(F.lit(text), "map<string,string>")


def _number(digits: Column, base: int) -> Column:
    """The character of a number of at most eight digits, or the replacement character."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    n = F.when(F.length(short) <= 8, F.conv(short, base, 10).cast("long"))
    wide = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    bad = n.isNull() | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return F.when(bad, "\ufffd").when(n < 160, _table(LOW)[n.cast("string")]).otherwise(wide)


def _reference(piece: Column) -> Column:
    bare = F.regexp_extract(piece, f"^&(?:{'|'.join(BARE)})", 0)
    named = F.coalesce(_table(NAMES)[piece], F.when(
        bare != "", F.concat(_table(NAMES)[bare], F.substr(piece, F.length(bare) + 1))), piece)
    return (F.when(~F.startswith(piece, F.lit("&")) | (F.length(piece) == 1), piece)
            .when(piece.rlike("^&#[xX]"), _number(F.regexp_extract(piece, "^&#[xX]([0-9a-fA-F]+)", 1), 16))
            .when(F.startswith(piece, F.lit("&#")), _number(F.regexp_extract(piece, "^&#([0-9]+)", 1), 10))
            .otherwise(named))


def decoded(text: Column) -> Column:
    """Character references replaced as browsers do."""
    pieces = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, _reference), "")).otherwise(text)


def _shown(token: Column) -> Column:
    name = F.lower(F.regexp_extract(token, "^</?([A-Za-z][A-Za-z0-9]*)", 1))
    closing = F.startswith(token, F.lit("</"))
    both = F.endswith(token, F.lit("/>")) & ~closing  # opens and closes
    return (F.when(~F.startswith(token, F.lit("<")) | (token == "<"),
                   decoded(F.translate(token, MUTE + SPEAK, "")))
            .when(name.isin(FOLDED_TAGS), F.when(closing, SPEAK).when(both, "").otherwise(MUTE))
            .when(name.isin(fv.BREAK_TAGS), F.when(both, "\n\n").otherwise("\n")).otherwise(""))


def shown_text(page: Column) -> Column:
    """The text of a page with line breaks at block tags, without muted elements. Null is empty.

    A muted element that is never closed mutes the rest; a stray closing tag mutes nothing.
    """
    tokens = F.regexp_extract_all(present(page), F.lit(TOKEN), F.lit(0))
    joined = F.array_join(F.transform(tokens, _shown), "")
    segments = F.split(joined, f"(?=[{MUTE}{SPEAK}])")

    def step(state: Column, segment: Column) -> Column:
        first = F.substring(segment, 1, 1)
        depth = F.when(first == MUTE, state["depth"] + 1).when(
            first == SPEAK, F.greatest(F.lit(0), state["depth"] - 1)).otherwise(state["depth"])
        said = F.when(depth == 0, F.translate(segment, MUTE + SPEAK, "")).otherwise("")
        return F.struct(depth.alias("depth"), F.concat(state["said"], said).alias("said"))

    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("said"))
    return F.aggregate(segments, start, step, lambda s: s["said"])
