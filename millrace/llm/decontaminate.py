"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may differ from a passage by m // 20 edits. Cut into one piece more than that,
it must have one piece without an edit, so exact hits of pieces (an Aho-Corasick automaton over all of
them) lead to every passage within the budget; Myers' bit-parallel distance decides. Text and items
are lower-cased and their white space is one space.

The benchmark is taken in blocks of bounded size, one scan of the documents each; what a block finds is written before the
next one is taken.

Edge cases: null or empty texts match nothing, nor do null or empty items. Items shorter than MIN_CHARS have no edit
to spare; they are found where they stand between characters that are no letters or digits. Items longer than PART_CHARS are cut into parts, each searched on its own.
Repeated items and repeated rows are reported one by one. Extra columns are ignored or pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import settle

MIN_CHARS = 20
PART_CHARS = 1_000
CHARS_PER_EDIT = 20
BLOCK_CHARS = 2_000_000


def plain(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def parts(text: str | None) -> list[str]:
    """An item's normal form, cut evenly into parts of at most PART_CHARS."""
    text = plain(text)
    if not text:
        return []
    n = -(-len(text) // PART_CHARS)
    return [text[len(text) * i // n:len(text) * (i + 1) // n] for i in range(n)]


def on_its_own(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] is no part of a longer word at either end."""
    return not ((start and text[start - 1].isalnum() and text[start].isalnum())
                or (end < len(text) and text[end].isalnum() and text[end - 1].isalnum()))


class Pattern:
    """Myers' automaton of one part: a bit per character of the pattern."""

    def __init__(self, text: str):
        self.length, self.budget = len(text), len(text) // CHARS_PER_EDIT
        self.text = text
        self.bits = self._bits(text)
        self.reverse = self._bits(text[::-1])

    @staticmethod
    def _bits(text: str) -> dict[str, int]:
        bits: dict[str, int] = defaultdict(int)
        for i, c in enumerate(text):
            bits[c] |= 1 << i
        return dict(bits)

    def pieces(self) -> list[tuple[int, str]]:
        n = self.budget + 1
        cuts = [self.length * i // n for i in range(n + 1)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]

    def _scan(self, text: str, bits: dict[str, int], anchored: bool) -> tuple[int, int]:
        """(distance, end) of the best match that ends anywhere; anchored: and begins at the start."""
        full, top = (1 << self.length) - 1, 1 << (self.length - 1)
        plus, minus, score = full, 0, self.length
        best, end = score, 0
        for i, c in enumerate(text, 1):
            same = bits.get(c, 0)
            vertical = same | minus
            across = (((same & plus) + plus) ^ plus) | same
            up = minus | (full & ~(across | plus))
            down = plus & across
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = (up << 1 | anchored) & full
            down = down << 1 & full
            plus = down | (full & ~(vertical | up))
            minus = up & vertical
            if score < best:
                best, end = score, i
        return best, end

    def find(self, text: str) -> tuple[int, int, int]:
        """(distance, start, end) of the best match in text; the first of equals."""
        distance, end = self._scan(text, self.bits, False)
        _, back = self._scan(text[:end][::-1], self.reverse, True)
        return distance, end - back, end


class Finder:
    """All patterns of a block and the automaton of their pieces; made once per task."""

    def __init__(self, items: list[tuple]):
        self.patterns = [(key, part, Pattern(text)) for key, item in items for part, text in enumerate(parts(item))]
        spots: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, _, pattern) in enumerate(self.patterns):
            for offset, piece in pattern.pieces():
                spots[piece].append((n, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in spots.items():
            self.automaton.add_word(piece, where)
        if spots:
            self.automaton.make_automaton()

    def __call__(self, raw: str | None) -> list[tuple]:
        """(item key, part, distance, start, end) of every part found in a text."""
        text = plain(raw)
        if not text or not self.patterns:
            return []
        begins: dict[int, set[int]] = defaultdict(set)
        for last, where in self.automaton.iter(text):
            for n, after in where:
                begins[n].add(last + 1 - after)
        found = []
        for n, starts in begins.items():
            key, part, pattern = self.patterns[n]
            if pattern.length < MIN_CHARS:
                whole = [s for s in starts if on_its_own(text, s, s + pattern.length)]
                if whole:
                    found.append((key, part, 0, min(whole), min(whole) + pattern.length))
                continue
            best = None
            for low, high in self._regions(sorted(starts), pattern, len(text)):
                distance, start, end = pattern.find(text[low:high])
                if distance <= pattern.budget and (best is None or distance < best[0]):
                    best = (distance, low + start, low + end)
            if best:
                found.append((key, part, *best))
        return found

    @staticmethod
    def _regions(starts: list[int], pattern: Pattern, size: int) -> Iterator[tuple[int, int]]:
        """Where a passage may lie whose piece was hit, overlaps merged."""
        low, high = None, None
        for s in starts:
            a, b = max(0, s - pattern.budget), min(size, s + pattern.length + pattern.budget)
            if high is not None and a <= high:
                high = max(high, b)
            else:
                if high is not None:
                    yield low, high
                low, high = a, b
        if high is not None:
            yield low, high


def blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    """The items (item_id, text) in blocks of about BLOCK_CHARS."""
    chars = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = chars // BLOCK_CHARS + 1
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        F.col("text").isNotNull())
    for i in range(n):
        block = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        yield [tuple(r) for r in block.collect()]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, part, distance, first_char, end_char): every item part found in every document,
    its best match, in characters of the normal form of the text."""
    schema = "doc_id long, item_id long, part int, distance int, first_char int, end_char int"
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32()]
    names = [x.split()[0] for x in schema.split(", ")]

    def scan(items: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(items)
            for batch in batches:
                rows = [(doc, *hit) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                        for hit in finder(text)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names)
        return run

    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Each block's finds are written before the next block is taken: neither the driver nor a task holds two.
    return reduce(DataFrame.unionByName, (settle(wanted.mapInArrow(scan(b), schema), "leaks") for b in blocks(benchmark)))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no part of any item is found, all columns kept. Rows are known by two hashes of their
    text, which alone decides."""
    def scan(items: list[tuple]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            finder = Finder(items)
            for batch in batches:
                yield batch.select([1, 2]).filter(pa.array([bool(finder(t)) for t in batch.column(0).to_pylist()], pa.bool_()))
        return run

    taken = {c.lower() for c in docs.columns}
    names = ["h1", "h2"]
    while taken & set(names):
        names = [n + "_" for n in names]
    hashes = [F.xxhash64("text").alias(names[0]), F.xxhash64("text", F.lit(1)).alias(names[1])]
    texts = docs.where("text IS NOT NULL").select("text", *hashes)
    schema = ", ".join(f"{n} long" for n in names)
    found = reduce(DataFrame.unionByName, (settle(texts.mapInArrow(scan(b), schema), "leaks") for b in blocks(benchmark)))
    keyed = docs.select("*", *hashes)
    return keyed.join(found.distinct(), names, "left_anti").select(docs.columns)
