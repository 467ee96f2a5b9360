"""Text expressions. Unicode-aware throughout: (?U) makes \\s and \\d cover all scripts."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace import fixed_values as fv

# Everything that counts as white space, the four separator control characters included.
BLANKS = ("\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.btrim(text, F.lit(BLANKS))


def strip_right(text: Column) -> Column:
    return F.rtrim(text, F.lit(BLANKS))


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate a costly expression once and use it several times."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def present(text: Column) -> Column:
    """Missing values are empty strings."""
    return F.coalesce(text, F.lit(""))


def contains_any(text: Column, needles: Iterable[str]) -> Column:
    found = F.lit(False)
    for needle in needles:
        found = found | F.contains(text, F.lit(needle))
    return found


def stop_words(places: Iterable[str] = ()) -> list[str]:
    """Words to ignore in names: the fixed ones and the caller's own place names."""
    return fv.PLACE_WORDS + fv.FILLER_WORDS + [p.lower() for p in places]


def plain_name(text: Column, ignored: Iterable[str]) -> Column:
    """Lower-case words of a name without bracketed parts, punctuation and ignored words."""
    ignored = list(ignored)
    unbracketed = F.regexp_replace(F.lower(present(text)), r"\([^)]*\)", " ")
    words = F.split(F.regexp_replace(unbracketed, r"[^\p{L}\p{N}]+", " "), " ")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(ignored)), " ")


def long_numbers(*texts: Column) -> Column:
    """Distinct runs of six or more digits over several fields."""
    runs = [F.regexp_extract_all(present(t), F.lit(r"(?U)\d{6,}"), F.lit(0)) for t in texts]
    return F.array_distinct(F.concat(*runs))


def pad_to(text: Column, width: int) -> Column:
    """Pad on the right without ever cutting."""
    return F.rpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(" "))


def script_counts(text: Column) -> tuple[Column, Column]:
    """Number of right-to-left letters and of Latin letters."""
    rtl = F.length(F.regexp_replace(text, r"[^֐-ࣿ]", ""))
    latin = F.length(F.regexp_replace(text, r"[^A-Za-z]", ""))
    return rtl.cast("long"), latin.cast("long")


def line_kind(line: Column) -> Column:
    """Kind of one light-markup line."""
    return bind(strip(line), lambda bare: (
        F.when(bare == "", "blank")
        .when(bare.rlike(r"\A[=─—_]{5,}\z"), "rule")
        .when(F.startswith(strip_right(line), F.lit("## ")), "heading")
        .when(F.left(bare, F.lit(1)).isin("•", "-", "*"), "bullet")
        .otherwise("text")))


def tidy_lines(text: Column) -> Column:
    """Drop invisible padding, trim each line and keep one blank line of each run."""
    shown = F.regexp_replace(text, "[" + "".join(fv.INVISIBLE) + "]", "")
    lines = F.transform(F.split(shown, r"\R|[\x1c-\x1e]"), strip)
    joined = F.array_join(lines, "\n")
    return strip(F.regexp_replace(joined, r"\n{3,}", "\n\n"))
