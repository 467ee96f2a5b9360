"""Small tables with the awkward rows every operator must take, and word rules in plain Python."""

import re


SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ("score", "size", "k1", "id", "node", "part", "rank", "target", "text_", "component_id", "n", "shard")
DOC_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, "
              + ", ".join(f"{c} string" for c in CLASHING))
PROSE = ("the river ran past the old mill and nobody in the village could say who had built it or when "
         "it had last turned a stone because the records were lost in the fire of that winter").split()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def docs(spark, rows):
    """A documents table of (doc_id, text, lang, source) rows, with extra columns of clashing names."""
    full = [(*r, None if r[1] is None else len(r[1]), *(f"x{i}" for i in range(len(CLASHING)))) for r in rows]
    return spark.createDataFrame(full, DOC_SCHEMA)


def prose(i, n=60):
    """n words that differ from those of other i."""
    return " ".join(f"{PROSE[(i * 7 + k) % len(PROSE)]}{i if k % 3 else ''}" for k in range(n))


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long_text = " ".join(prose(i) for i in range(500))
    return docs(spark, [
        (1, prose(1), "en", "a"), (2, prose(1), "en", "b"), (3, prose(3), None, None), (3, prose(3), None, None),
        (4, None, "fr", "a"), (5, "", "de", "a"), (6, " \t\n ", "de", None), (7, "One", "en", "b"),
        (8, "ONE", "en", "b"), (9, long_text, "en", "a"), (10, long_text + " end", None, "a"),
        (None, prose(11), "es", "a"), (12, "12345 !!! ???", "es", "c"), (13, "été 日本   ñandú", "fr", "c")])


def thue_morse(n=1024):
    """Two words that any polynomial hash modulo a power of two takes for one."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]


def empty(spark):
    return docs(spark, [])


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))


def table(spark, name):
    from millrace.llm.common import table as given
    return given(spark, SF_DIR, name)


__all__ = ["SF_DIR", "WORD", "awkward", "docs", "empty", "lower", "plain", "prose", "table", "thue_morse"]
