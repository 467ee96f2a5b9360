"""What the operators of this subpackage share: words, their hashes, folds, link components.

A word is a longest run of bytes other than space and 0x09 to 0x0D. Words are taken from Arrow chunks, so a
task holds a chunk of about a megabyte of text (or one document, if that is longer) and never a whole partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import settle

WORD = r"[^\x20\x09-\x0D]+"
CHUNK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20
LONG_WORD = 64

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=_U)  # masks of so many bytes
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables. Arrow batches are bounded in bytes: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):  # where workers look for this package
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """The fold nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over all of them."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte range start:end of data.

    A word is the sum over its runs of eight bytes, each mixed with its place, and of its length. No run acts on
    another and mixing is not linear, so repetitive words share nothing. Words over LONG_WORD bytes go through blake2b.
    """
    if not len(start):
        return np.empty(0, dtype=_U)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))  # the eight bytes from each byte on
    size = end - start
    total = mix(size.astype(_U) * _U(_BASE))
    at, words_left = start, None
    for lane in range(LONG_WORD // 8):
        if lane:
            more = np.flatnonzero(size > 8 * lane) if words_left is None else words_left[size[words_left] > 8 * lane]
            words_left = more
            if not len(more):
                break
            at = start[more] + 8 * lane
        left = (size if words_left is None else size[words_left]) - 8 * lane
        run = eights[at] & _KEEP[np.minimum(left, 8)]
        run = mix(run + _U((lane + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
        if words_left is None:
            total += run
        else:
            total[words_left] += run
    total = mix(total)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        total[i] = int.from_bytes(blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest(), "little")
    return total


class Words(NamedTuple):
    """Words of the rows lo to hi of a text column; first[i]:first[i + 1] are those of row lo + i."""

    lo: int
    hi: int
    hashes: np.ndarray
    first: np.ndarray
    body: bytes
    start: np.ndarray
    end: np.ndarray

    def joined(self, a: int, b: int) -> bytes:
        """The words a to b - 1 with a space between any two."""
        return b" ".join(self.body[self.start[a]:self.end[b - 1]].split()) if b > a else b""


def text_chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of about `size` bytes with their bytes and row offsets; null counts as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, body[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def words(texts: pa.Array, lower: bool = False) -> Iterator[Words]:
    """The words of each row with their hashes, chunk by chunk. lower: A-Z count as a-z."""
    for lo, hi, data, rows in text_chunks(texts):
        if lower:
            data = _LOWER[data]
        inside = ~_BLANK[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        full = rows[1:] > rows[:-1]
        begins[rows[:-1][full]] = inside[rows[:-1][full]]
        ends[rows[1:][full] - 1] = inside[rows[1:][full] - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        yield Words(lo, hi, word_hashes(data, start, end), np.searchsorted(start, rows), data.tobytes(), start, end)


_FACTORS = [int(x) | 1 for x in mix(np.arange(1000, 1064, dtype=_U) * _U(_BASE))]


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each `length` consecutive words."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, dtype=_U)
    total = np.full(n, length * 7919, dtype=_U)
    for i in range(length):
        total += hashes[i:i + n] * _U(_FACTORS[i])
    return mix(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def components(links: DataFrame, name: str) -> DataFrame:
    """(node, root) of the nodes of links (a, b) that are not themselves the smallest of theirs.

    Alternating stars: every node hangs its larger neighbours, then its smaller ones, under the
    smallest it knows, until only stars are left. A round moves links, never whole components, and
    its minimum per node combines before the shuffle.
    """
    edges = settle(links.where("a <> b").select(F.greatest("a", "b").alias("v"),
                                                F.least("a", "b").alias("u")).distinct(), name)
    seen = None
    while True:
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u") % (1 << 30))).first())
        if state == seen or not state[0]:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = state
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = settle(both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m")), name)
        large = settle(both.join(low, "v").where("u > v").select(F.col("u").alias("v"),
                                                                 F.col("m").alias("u"))
                       .where("v <> u").distinct(), name)
        low = settle(large.groupBy("v").agg(F.min("u").alias("m")), name)
        hung = large.join(low, "v").select(F.explode(F.array("u", "v")).alias("v"),
                                           F.col("m").alias("u"))
        edges = settle(hung.where("v <> u").distinct(), name)
