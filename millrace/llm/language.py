"""Language ID by compression.

Per language a raw-content zstandard dictionary is filled with pieces of labelled texts. A text is
encoded with every dictionary, block by block, and the language whose dictionary leaves the fewest
bytes wins. A win by a narrow margin is rejected.

Edge cases: a text that is null or has no letter is `und`, score 0, rejected. Ties go to the
language with most labelled rows, then to the first in code point order. Without any learned language every text is `und`. Repeated rows
are judged one by one; other columns pass through `classify` untouched, a column that has the name
of an output column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import held_out

UNKNOWN = "und"
SAMPLE_TEXTS = 300      # labelled texts taken per language
PIECE_CHARS = 800       # of each of them, from a hashed place on, in the dictionary only
BLOCK_BYTES = 4_096     # a text is encoded in blocks of this size
SEARCH = {"strategy": zstandard.STRATEGY_GREEDY, "min_match": 3, "search_log": 3, "target_length": 8,
          "hash_log": 17, "chain_log": 17, "window_log": 19}
MIN_LEAD_BYTES = 1      # margins below either bound are narrow
MIN_LEAD_SHARE = 0.002
SHARPNESS = 40.0
OUTPUT = ("lang_pred", "score", "accepted")


def sample(docs: DataFrame, texts: int = SAMPLE_TEXTS, piece: int = PIECE_CHARS) -> DataFrame:
    """(lang, rank, piece): per language the labelled texts of lowest hash, outside the held-out fold.

    Languages are counted first, and only hashes low enough to leave about four times the wanted texts
    go to the ranking, so the rows that meet there grow with the languages, not with the corpus.
    """
    known = learnable(docs).where(F.col("text").rlike(r"\p{L}"))
    low = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 40))
    spots = F.greatest(F.length("text") - piece, F.lit(0)) + 1
    at = F.pmod(F.xxhash64("text", F.col("doc_id").cast("string")), spots).cast("int") + 1
    short = known.select("lang", F.substring("text", at, F.lit(piece)).alias("piece"), low.alias("h"))
    share = F.least(F.lit(1.0), F.lit(4.0 * texts) / F.col("times"))
    counts = known.groupBy("lang").agg(F.count("*").alias("times"))
    few = short.join(counts, "lang").where(F.col("h") <= share * (1 << 40))
    order = Window.partitionBy("lang").orderBy("h", "piece")
    return few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= texts)


def learnable(docs: DataFrame) -> DataFrame:
    """Rows with a label outside the held-out fold."""
    return docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))


def dictionaries(docs: DataFrame, texts: int = SAMPLE_TEXTS, piece: int = PIECE_CHARS) -> dict[str, bytes]:
    """Dictionary content per language, at most texts * piece characters each; commonest first."""
    found: dict[str, list[str]] = {}
    for r in sample(docs, texts, piece).orderBy("lang", "rank").collect():
        found.setdefault(r["lang"], []).append(r["piece"].lower())
    times = {r["lang"]: r["count"] for r in learnable(docs).groupBy("lang").count().collect()}
    order = sorted(found, key=lambda lang: (-times[lang], lang))
    return {lang: "\n".join(reversed(found[lang])).encode() for lang in order}


class Judge:
    """Encodes texts with each dictionary; made once per task."""

    def __init__(self, contents: dict[str, bytes]):
        self.langs = list(contents)
        self.coders = []
        settings = zstandard.ZstdCompressionParameters(
            **SEARCH, write_content_size=False, write_checksum=False, write_dict_id=False)
        for content in contents.values():
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(compression_params=settings)
            self.coders.append(zstandard.ZstdCompressor(dict_data=known, compression_params=settings))

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode()
        blocks = [data[i:i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)]
        return [sum(len(coder.compress(b)) for b in blocks) for coder in self.coders]

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        if text is None or not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, False
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        odds = sum(math.exp(-SHARPNESS * (s - sizes[best]) / sizes[best]) for s in sizes)
        lead = min((s - sizes[best] for i, s in enumerate(sizes) if i != best), default=sizes[best])
        clear = lead >= MIN_LEAD_BYTES and lead >= MIN_LEAD_SHARE * sizes[best]
        return self.langs[best], 1.0 / odds, clear


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def classify(docs: DataFrame, contents: dict[str, bytes]) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and accepted (false: no letter or a narrow margin)."""
    kept = docs.select([c for c in docs.columns if c not in OUTPUT])
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema)
    names = list(kept.columns)
    at = names.index("text")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Judge(contents)
        for batch in batches:
            told = [one(t) for t in batch.column(at).to_pylist()]
            new = [pa.array([t[i] for t in told], kind) for i, kind in
                   enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays(batch.columns + new, [*names, *OUTPUT])

    return kept.mapInArrow(judge, f"{schema}, lang_pred string, score double, accepted boolean")
