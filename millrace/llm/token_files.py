"""Token ids in Parquet files that can be read selectively.

Layout: `tokens` has a row per document in ascending id order, over all files and row groups: doc_id,
n_tokens, part, start_in_part and the list column ids; `parts` has the tokens before each part. Row
groups and pages are bounded, page indexes come with the format, so a reader of a range of ids skips
row groups and pages, and a reader of metadata never touches the ids. Ids use a dictionary per
row group where it pays and delta packing otherwise; ids and counts are delta packed.

A text is encoded in pieces cut before a space that a visible character follows, and before a line feed between
two visible ones; a byte-level BPE never joins over such a cut. Pieces that were met lately are not encoded again, which is most of them.

Edge cases: null text is empty, an empty text has the end id alone. Null ids come first. Rows that
repeat an id stand side by side, in the order of their texts' hashes. Extra columns are ignored.
Strings that look like special tokens are ordinary text.
"""

from __future__ import annotations

import os
import re
import string
import threading
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import BATCH_BYTES, text_chunks
from millrace.session import scratch_path

END_ID = 2
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
PART_CHARS = 8_000_000
MEMORY_PIECES = 500_000
LONG_PIECE = 100
IDLE_SECONDS = 5
TOGETHER = 512  # pieces encoded as one text
MARKS = string.punctuation
_CUT = re.compile(r"(?= \S)|(?<=\S)(?=\n\S)")
_PLAIN = re.compile(r"\n?\S+").fullmatch


class Encoder:
    """Encodes texts with a tokenizer file. The ids of up to MEMORY_PIECES pieces are kept, found by the piece itself;
    a full memory keeps the pieces that were met first, which are mostly the frequent ones."""

    def __init__(self, path: str, special_as_text: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = special_as_text
        known = self.library.get_vocab()
        self.sizes = np.zeros(max(known.values()) + 1, dtype=np.int64)  # in bytes: a token has a character per byte
        self.sizes[list(known.values())] = [len(t) for t in known]
        self.first: dict[str, bytes] = {"": b""}  # ids of pieces that begin a text
        # Ids of others, by what follows their space, or by all if there is none. False: a word after which, or before
        # which, a text cannot be cut.
        self.later: dict[str, bytes | bool] = {}
        self.tails: dict[str, bytes] = {}  # ids of marks after a word, each at most LONG_PIECE characters
        self.odd: dict[str, bytes] = {}  # ids of pieces that end in white space

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<i4")

    def _learn(self, words: list[str]) -> None:
        """Words whose only white space is their first character stand side by side in one text, which falls apart into
        them again by the sizes of its tokens. Others go one by one."""
        plain = [w for w in words if _PLAIN(w)]
        rest = [w for w in words if not _PLAIN(w)] if len(plain) < len(words) else []
        whole = [w if w[0] == "\n" else " " + w for w in plain]
        ends = np.cumsum(pc.binary_length(pa.array(whole, pa.large_string())).to_numpy(zero_copy_only=False))
        for low in range(0, len(plain), TOGETHER):
            some = slice(low, low + TOGETHER)
            ids = self._ids("x" + "".join(whole[some]))
            stops = np.cumsum(self.sizes[ids])
            cuts = 1 + np.append(0, ends[some] - (ends[low - 1] if low else 0))
            at = np.searchsorted(stops, cuts)
            if at[-1] < len(stops) and (stops[at] == cuts).all():
                body, marks = ids.tobytes(), ((at + 1) * 4).tolist()
                self.later.update(zip(plain[some], [body[a:b] for a, b in zip(marks, marks[1:])]))
            else:
                rest += plain[some]
        for w in rest:
            strange = not w or (w[1:] if w[0] == "\n" else w)[:1].isspace() or w[-1].isspace()
            self.later[w] = False if strange else self._ids(w if w[0] in " \n" else " " + w).tobytes()

    def _tail(self, marks: str) -> bytes:
        if marks not in self.tails:
            self.tails[marks] = self._ids("x" + marks)[len(self._ids("x")):].tobytes()
        return self.tails[marks]

    def _first(self, piece: str) -> bytes:
        if len(piece) > LONG_PIECE:
            return self._ids(piece).tobytes()
        if piece not in self.first:
            self.first[piece] = self._ids(piece).tobytes()
        return self.first[piece]

    def __call__(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text, as little-endian integers of 32 bits. A word is looked up once for all its places."""
        if not len(texts):
            return []
        if len(self.first) + len(self.later) + len(self.odd) + len(self.tails) > MEMORY_PIECES:
            self.first, self.odd, self.tails = {"": b""}, {}, {}
            self.later = dict(islice(self.later.items(), MEMORY_PIECES // 3))
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        told, at = cut.values.dictionary_encode(), cut.offsets.to_numpy()
        place, begins = told.indices.to_numpy().astype(np.int64), at[:-1]
        rest = np.ones(len(place), dtype=bool)
        rest[begins] = False
        used = np.zeros(len(told.dictionary), dtype=bool)
        used[place[rest]] = True
        known = self._known(told.dictionary.filter(pa.array(used)))
        words = len(known)
        known += [self._first(w) if w[-1:].strip() or not w else False
                  for w in _strings(told.dictionary.take(pa.array(place[begins])))]
        place = (np.cumsum(used) - 1)[place]
        place[begins] = np.arange(words, len(known))
        ids = pa.array([k or b"" for k in known], pa.large_binary()).take(pa.array(place))
        body = ids.buffers()[2].to_pybytes()
        ends = np.frombuffer(ids.buffers()[1], np.int64)[at].tolist()
        out = [body[a:b] for a, b in zip(ends, ends[1:])]
        if False in known:
            strange = np.fromiter((k is False for k in known), bool, len(known))[place]
            odd = np.flatnonzero(np.logical_or.reduceat(strange, begins)).tolist()
            for i, own in zip(odd, self._uneven([texts[i].as_py() for i in odd])):
                out[i] = own
        return out

    def _known(self, words: pa.Array) -> list[bytes | bool]:
        """The ids of each of some distinct words, which follow a space or begin with a line feed; False: a text with such a
        word is not cut at every space and line feed. A letter and a mark after it are never joined, so a word that ends
        in marks is looked up without them."""
        cores = pc.ascii_rtrim(words, MARKS)
        apart = pc.and_(pc.match_substring_regex(cores, r"\pL$"), pc.less_equal(pc.binary_length(words), LONG_PIECE))
        told = pc.if_else(apart, cores, words).dictionary_encode()
        keys = _strings(told.dictionary)
        known = list(map(self.later.get, keys))
        if None in known:
            at = [i for i, k in enumerate(known) if k is None]
            new = [keys[i] for i in at]
            self._learn(new)
            for i, k in zip(at, map(self.later.get, new)):
                known[i] = k
            self._drop_long(new)
        out = [known[i] for i in told.indices.to_numpy().tolist()]
        more = np.where(apart.to_numpy(zero_copy_only=False), pc.subtract(pc.binary_length(words), pc.binary_length(cores)), 0)
        at = np.flatnonzero(more)
        for i, w, n in zip(at.tolist(), _strings(words.take(pa.array(at))), more[at].tolist()):
            if out[i]:
                out[i] += self.tails.get(w[-n:]) or self._tail(w[-n:])
        return out

    def _uneven(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that are not cut at every space and line feed."""
        cut = []
        for text in texts:
            pieces = _CUT.split(text)
            cut.append((pieces[0], [p[1:] if p[0] == " " and len(p) > 1 and not p[1].isspace() else p for p in pieces[1:]]))
        met = {k for _, keys in cut for k in keys}
        alone = {k for k in met if k[-1].isspace()}  # only a text that is cut otherwise has such pieces
        others = list(met - alone)
        told = dict(zip(others, self._known(pa.array(others, pa.large_string()))))
        for k in alone.difference(self.odd):
            self.odd[k] = self._ids(k if k[0] in " \n" else " " + k).tobytes()
        out = [b"".join([self._first(first), *(self.odd[k] if k in alone else told[k] for k in keys)])
               for first, keys in cut]
        self._drop_long(alone)
        return out

    def _drop_long(self, words: list[str] | set[str]) -> None:
        for w in words:
            if len(w) > LONG_PIECE:  # what is long hardly comes again
                self.later.pop(w, None)
                self.odd.pop(w, None)


def _strings(column: pa.Array) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()


_encoders: dict[str, Encoder] = {}
_idle: dict[str, threading.Timer] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder: what it keeps serves the tasks that follow in the same process."""
    if path in _idle:
        _idle.pop(path).cancel()
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _rest(path: str) -> None:
    """A task is through. A worker also serves other stages, so an encoder that no task takes up again soon is let go."""
    def forget() -> None:
        if _idle.get(path) is timer:
            del _idle[path]
            _encoders.pop(path, None)
            pa.default_memory_pool().release_unused()

    timer = threading.Timer(IDLE_SECONDS, forget)
    timer.daemon = True
    _idle[path] = timer
    timer.start()


def encoded(docs: DataFrame, path: str, end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """doc_id, n_tokens, part, start_in_part, ids in ascending order of doc_id.

    Texts, not ids, are dealt out by ranges of doc_id: they are smaller. The part is the number of the task.
    """
    spark = docs.sparkSession
    wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if parts is None:
        chars = docs.select(F.sum(F.length("text"))).first()[0] or 0
        parts = max(spark.sparkContext.defaultParallelism, chars // PART_CHARS + 1)
    tie = F.xxhash64("text")
    dealt = wanted.repartitionByRange(int(parts), F.col("doc_id").asc_nulls_first()) \
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, before, part = encoder(path), 0, TaskContext.get().partitionId()
        stop = np.array([end_id], dtype="<i4").tobytes()
        for batch in batches:
            texts = batch.column(1).cast(pa.large_string())
            for lo, hi, _, _ in text_chunks(texts, BATCH_BYTES):
                told = [t + stop for t in encode(texts.slice(lo, hi - lo))]
                n = np.array([len(t) // 4 for t in told])
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()),
                                                 pa.array(np.frombuffer(b"".join(told), "<i4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n), pa.array(np.full(len(n), part, np.int32)),
                     pa.array(before + ends - n), lists], ["doc_id", "n_tokens", "part", "start_in_part", "ids"])
                before += int(ends[-1])
        _rest(path)

    return dealt.mapInArrow(run, "doc_id long, n_tokens long, part int, start_in_part long, ids array<int>")


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, parts: int | None = None) -> str:
    """Write the token files of docs under folder and return it."""
    spark = docs.sparkSession
    (encoded(docs, path, end_id, parts).write
     .option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES)
     .option("parquet.page.row.count.limit", PAGE_ROWS).option("parquet.writer.version", "PARQUET_2_0")
     .option("parquet.dictionary.page.size", 1 << 20).option("parquet.enable.dictionary", "true")
     .option("parquet.enable.dictionary#doc_id", "false")
     .option("parquet.enable.dictionary#start_in_part", "false").option("compression", "zstd")
     .parquet(f"{folder}/tokens"))
    sums = spark.read.parquet(f"{folder}/tokens").groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    (sums.withColumn("part_start", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).cast("long"))
     .write.parquet(f"{folder}/parts"))
    return folder


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and, if wanted, ids. Filters on doc_id reach row groups and pages."""
    rows = spark.read.parquet(f"{folder}/tokens")
    parts = spark.read.parquet(f"{folder}/parts").select("part", "part_start")
    return rows.join(parts, "part").select(
        "doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens",
        *(["ids"] if ids else []))


def checksums(rows: DataFrame) -> DataFrame:
    """rows with ids_crc32, the crc32 of the ids as little-endian unsigned 32-bit integers, for ids."""
    names = [c for c in rows.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(names))
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            ends = lists.offsets.to_numpy()
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sums, pa.int64())],
                                             [*names, "ids_crc32"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(names).schema)
    return rows.select(*names, "ids").mapInArrow(run, f"{schema}, ids_crc32 long")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Write docs to the shared folder and return doc_id, start, n_tokens and ids_crc32 from the files."""
    folder = write(docs, scratch_path(docs.sparkSession, "token-files"), path)
    return checksums(read(docs.sparkSession, folder))
