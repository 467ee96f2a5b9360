"""Alignment of two tokenizers' ids over the same bytes.

A text with a space before it is encoded by a byte-level BPE of tokenizers (A) and by a sentencepiece model (B, which
adds that space itself). The character offsets of A and the byte spans of B's proto are coarse cuts; where several
tokens share a character (A) or a character fell back to bytes (B), the decoded bytes of the tokens refine them.
Offsets where tokens of both end cut the text into groups; all A-B pairs of token occurrences in a group are links.

Neither tokenizer joins over a space between a character that is no space and a visible one, nor over a line feed between
two visible ones (for B this is checked on its vocabulary). A text is cut there, and each segment is encoded once per
worker and found by its characters; new segments are encoded many at a time, side by side in one text.

A document's linked pairs are written with the other results, so that no text is encoded twice. Counts of pairs over
documents combine in the task and again before the shuffle. The most frequent pairs, at most HOT_PAIRS, travel to every
task and are looked up there; occurrences of all others are joined with their counts by a shuffle, where no key is
frequent any more. Nothing depends on which way a pair goes.

Edge cases: null and empty texts, and texts that either tokenizer does not give back byte by byte (such as those
with U+2581), have zeros and an empty checksum. Rows that repeat an id are documents of their own. Null ids stay.
Extra columns are ignored. Memory in a task is bounded by MEMORY_SEGMENTS remembered segments, MERGE_PAIRS pairs and one document.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import settle

HOT_PAIRS = 1 << 20
MEMORY_SEGMENTS = 600_000  # per worker, each of LONG_SEGMENT characters at most
KEPT_SEGMENTS = 200_000  # of a full memory, those that were met first, which are mostly the frequent ones
LONG_SEGMENT = 64
MERGE_PAIRS = 1 << 21
DOCS_AT_ONCE = 256
TOGETHER = 256  # segments encoded as one text
SHIFT = 32  # a pair is A's id, shifted, plus B's
_CUT = re.compile(r"(?<! )(?= \S)|(?<=\S)(?=\n\S)")
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_letters() -> dict[str, int]:
    """The character a byte-level BPE writes for each byte: itself if visible in Latin-1, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + n): b for n, b in enumerate(hidden)}


def refined(spans: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """End offsets of tokens in bytes, from coarse spans (begin, end) and the sizes of the decoded tokens. A span that begins
    where the token before it ends by its bytes, and is as long as the token's bytes, stands; tokens that share a character,
    or whose span is empty, end where their bytes do."""
    ends = np.cumsum(sizes)
    begin, end = spans[:, 0], spans[:, 1]
    return np.where((end - begin == sizes) & (begin == ends - sizes), end, ends)


def grown(x: np.ndarray, n: int) -> np.ndarray:
    """x with room for n rows."""
    if n <= len(x):
        return x
    return np.concatenate([x, np.zeros((max(n, 2 * len(x)) - len(x), *x.shape[1:]), x.dtype)])


class Aligner:
    """Segments of texts, remembered by their characters: a segment's key is what follows its space, or the whole segment
    if it does not begin with a space that a visible character follows."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        plain = set(self.a.get_vocab(with_added_tokens=False))
        known = self.a.get_vocab()
        self.a_bytes = [b""] * (max(known.values()) + 1)
        for t, i in known.items():
            self.a_bytes[i] = bytes(map(letters.__getitem__, t)) if t in plain and set(t) <= letters.keys() else t.encode()
        names = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(names)]
        self.sizes = [np.array([len(x) for x in own]) for own in (self.a_bytes, self.b_bytes)]
        self.names = [[str(i).encode() for i in range(len(own))] for own in (self.a_bytes, self.b_bytes)]
        self.cuts_hold = not any("▁" in p.lstrip("▁") or "\n" in p for p in names)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.odd: set[str] = set()  # words of texts that are not cut at every space and line feed
        self.bad: set[int] = set()  # segments whose bytes a tokenizer does not give back
        self.groups: list[bytes] = []
        self.stats = np.zeros((1024, 4), dtype=np.int64)
        self.first = np.zeros(1025, dtype=np.int64)  # of the segment's links in pairs
        self.pairs = np.zeros(4096, dtype=np.int64)

    def _forget_late(self) -> None:
        """Make room: keep the segments that were met first."""
        kept = min(KEPT_SEGMENTS, MEMORY_SEGMENTS // 2, len(self.groups))
        if self.first[kept] > 8 * MEMORY_SEGMENTS:
            return self._forget()
        self.index = {k: n for k, n in self.index.items() if n < kept}
        self.bad = {n for n in self.bad if n < kept}
        self.odd = {w for w in self.odd if len(w) <= 1 or w in self.index}
        del self.groups[kept:]
        self.stats, self.first = self.stats[:kept].copy(), self.first[:kept + 1].copy()
        self.pairs = self.pairs[:self.first[kept]].copy()

    def _encoded(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Ids and end offsets of A and B for a text that begins with a space or a line feed; None if not given back."""
        source, spaced = text.encode(), text[0] == " "
        a, b = self.a.encode(text, add_special_tokens=False), self.b.encode_as_proto(text[1:] if spaced else text)
        told = list(b.pieces)[0 if spaced else 1:]  # B's own space is not in the text
        a_ids, b_ids = np.array(a.ids), np.array([p.id for p in told], dtype=np.int64)
        if (b"".join(map(self.a_bytes.__getitem__, a.ids)) != source
                or b"".join(map(self.b_bytes.__getitem__, b_ids.tolist())) != source):
            return None
        a_spans = np.array(a.offsets, dtype=np.int64).reshape(-1, 2)
        if len(source) != len(text):  # from characters to bytes
            marks = np.frombuffer(source, np.uint8)
            a_spans = np.append(np.flatnonzero(marks & 0xC0 != 0x80), len(source))[a_spans]
        b_spans = np.array([(p.begin, p.end) for p in told], dtype=np.int64).reshape(-1, 2) + spaced
        if spaced and len(b_spans):
            b_spans[0, 0] = 0
        return a_ids, refined(a_spans, self.sizes[0][a_ids]), b_ids, refined(b_spans, self.sizes[1][b_ids])

    def _add(self, keys: list[str], text: str, ends: np.ndarray) -> bool:
        """Remember the segments of a text that end at the given bytes; False if the text is not given back."""
        told = self._encoded(text)
        if told is None:
            return False
        a_ids, a_ends, b_ids, b_ends = told
        cuts = np.intersect1d(a_ends, b_ends)
        a_group, b_group = np.searchsorted(cuts, a_ends), np.searchsorted(cuts, b_ends)
        n_a, n_b = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        owner = np.searchsorted(ends, cuts)
        stats = np.stack([np.bincount(owner, w, len(keys)) for w in (n_a, n_b, np.ones(len(cuts)), n_a * n_b)], axis=1)
        at = np.arange(len(cuts)).repeat(n_a * n_b)
        k = np.arange(len(at)) - np.append(0, np.cumsum(n_a * n_b))[at]
        a_first, b_first = np.append(0, np.cumsum(n_a)), np.append(0, np.cumsum(n_b))
        pairs = a_ids[a_first[at] + k // n_b[at]] << SHIFT | b_ids[b_first[at] + k % n_b[at]]

        a_names = [self.names[0][i] for i in a_ids.tolist()]
        b_names = [self.names[1][i] for i in b_ids.tolist()]
        x, y = a_first.tolist(), b_first.tolist()
        texts = [(a_names[p] if q - p == 1 else b",".join(a_names[p:q])) + b"|" +
                 (b_names[r] if s - r == 1 else b",".join(b_names[r:s])) for p, q, r, s in zip(x, x[1:], y, y[1:])]
        last = np.searchsorted(cuts, ends, "right").tolist()
        n, low = len(self.groups), int(self.first[len(self.groups)])
        self.groups += [b";".join(texts[p:q]) for p, q in zip([0, *last], last)]
        self.index.update(zip(keys, range(n, n + len(keys))))
        self.stats, self.first = grown(self.stats, n + len(keys)), grown(self.first, n + len(keys) + 1)
        self.stats[n:n + len(keys)] = stats
        self.first[n + 1:n + len(keys) + 1] = low + np.cumsum(stats[:, 3].astype(np.int64))
        self.pairs = grown(self.pairs, low + len(pairs))
        self.pairs[low:low + len(pairs)] = pairs
        return True

    def _learn(self, keys: list[str]) -> None:
        """Segments that begin with their only white space and are not long stand side by side in one text, where they
        are cut as in their own texts; the others, and those of a text that is not given back, go one by one."""
        whole = {k: k if k[0] in " \n" else " " + k for k in keys}
        alone = [k for k, t in whole.items() if len(t) > LONG_SEGMENT or t[1:].split() != [t[1:]]]
        rest = sorted(whole.keys() - set(alone))
        for low in range(0, len(rest), TOGETHER):
            some = rest[low:low + TOGETHER]
            texts = [whole[k] for k in some]
            if not self._add(["x", *some], " x" + "".join(texts), 2 + np.cumsum([0, *(len(t.encode()) for t in texts)])):
                alone += some
        for k in alone:
            if not self._add([k], whole[k], np.array([len(whole[k].encode())])):
                self.index[k] = len(self.groups)
                self.bad.add(len(self.groups))
                n = len(self.groups) + 1
                self.groups.append(b"")
                self.stats, self.first = grown(self.stats, n), grown(self.first, n + 1)
                self.stats[n - 1] = 0
                self.first[n] = self.first[n - 1]

    def cut(self, text: str) -> list[str]:
        """The keys of the segments of a text that is not empty."""
        if not self.cuts_hold:
            return [" " + text]
        words = text.replace("\n", " \n").split(" ")
        kinds = set(words)
        if self.odd.isdisjoint(kinds):
            strange = [w for w in kinds.difference(self.index)
                       if not w or (w[1:] if w[0] == "\n" else w)[:1].isspace() or w[-1].isspace()]
            if not strange:
                return words
            self.odd.update(w for w in strange if len(w) <= LONG_SEGMENT)
        keys = [s[1:] if s[0] == " " and not s[1:2].isspace() and len(s) > 1 else s for s in _CUT.split(" " + text) if s]
        self.odd.update(k for k in keys if k[-1].isspace())  # known from now on, but no word to cut after
        return keys

    def places(self, texts: list[str | None]) -> Iterator[np.ndarray | None]:
        """Numbers of the segments of each text; None if it has no tokens. They hold until the next call: memory is
        given back only then."""
        if len(self.index) > MEMORY_SEGMENTS or len(self.pairs) > 16 * MEMORY_SEGMENTS:
            self._forget_late()
        cut = [self.cut(t) if t else None for t in texts]
        new = set().union(*(c for c in cut if c)).difference(self.index)
        if new:
            self._learn(list(new))
        for words in cut:
            if words is None:
                yield None
                continue
            own = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
            yield None if self.bad and not self.bad.isdisjoint(own.tolist()) else own
        for key in [k for k in new if len(k) > LONG_SEGMENT]:  # what is long hardly comes again
            del self.index[key]

    def told(self, places: np.ndarray) -> tuple[list[int], str, np.ndarray, np.ndarray]:
        """The counts of a text, the checksum of its groups, its pairs and how often each is linked."""
        counts = self.stats[places].sum(axis=0).tolist()
        sha = hashlib.sha256(b";".join([self.groups[p] for p in places.tolist()])).hexdigest()
        n = self.stats[places, 3]
        ends = np.cumsum(n)
        links = self.pairs[np.repeat(self.first[places] - ends + n, n) + np.arange(ends[-1])]
        return counts, sha, *np.unique(links, return_counts=True)


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner: what it remembers serves the tasks that follow in the same process."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _merged(parts: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    kinds, back = np.unique(np.concatenate(parts), return_inverse=True)
    return kinds, np.bincount(back, np.concatenate(times), len(kinds)).astype(np.int64)


def encoded(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """row (a number of its own), doc_id, the counts of its tokens, groups and links, groups_sha256, and its linked pairs
    with how often each is linked, of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, row = aligner(a_path, b_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for low in range(0, batch.num_rows, DOCS_AT_ONCE):
                ids = batch.column(0).slice(low, DOCS_AT_ONCE)
                none = ([0] * 4, "", np.empty(0, np.int64), np.empty(0, np.int64))
                told = [none if p is None else own.told(p)
                        for p in own.places(batch.column(1).slice(low, DOCS_AT_ONCE).to_pylist())]
                offsets = pa.array(np.cumsum([0, *(len(t[2]) for t in told)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + len(ids))), ids,
                     *(pa.array([t[0][i] for t in told], pa.int64()) for i in range(4)),
                     pa.array([t[1] for t in told], pa.string()),
                     *(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([t[i] for t in told]))) for i in (2, 3))],
                    names)
                row += len(ids)

    names = ["row", "doc_id", *_COUNTS, "groups_sha256", "pairs", "times"]
    kinds = ["long"] * 6 + ["string", "array<bigint>", "array<bigint>"]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def _merged(parts: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    kinds, back = np.unique(np.concatenate(parts), return_inverse=True)
    return kinds, np.bincount(back, np.concatenate(times), len(kinds)).astype(np.int64)


def pair_counts(told: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents ids are linked, and whether no pair of that A id is in more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, times, held = [], [], 0
        for batch in batches:
            parts.append(batch.column(0).flatten().to_numpy())
            times.append(np.ones(len(parts[-1])))
            held += len(parts[-1])
            if held > MERGE_PAIRS:
                kinds, n = _merged(parts, times)
                if len(kinds) > MERGE_PAIRS // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], ["pair", "n"])
                    kinds, n = kinds[:0], n[:0]
                parts, times, held = [kinds], [n], len(kinds)
        if parts:
            kinds, n = _merged(parts, times)
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(n)], ["pair", "n"])

    counts = settle(told.select("pairs").mapInArrow(run, "pair long, n long")
                    .groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    a_id = F.shiftright("pair", SHIFT)
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("high"))
    return settle(counts.withColumn("a", a_id).join(highest, "a")
                  .select("pair", "n", (F.col("n") == F.col("high")).alias("best")), "pairs")


def hot_pairs(counts: DataFrame, most: int = HOT_PAIRS) -> tuple[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The least count of a hot pair, and the hot pairs with their counts and whether they are best. Pairs are hot from
    the least power of two on that leaves at most `most`."""
    level = F.length(F.bin("n"))
    sizes = {r["level"]: r["k"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("k")).collect()}
    least, room = 64, most
    while least > 1 and sizes.get(least - 1, 0) <= room:
        least -= 1
        room -= sizes.get(least, 0)
    found = counts.where(level >= least).toArrow()
    pairs, n, best = (found.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(pairs)
    return least, (pairs[order], n[order], best[order].astype(np.int64))


def weighed(told: DataFrame, hot: Broadcast) -> DataFrame:
    """told with n_best and count_sum of its hot pairs, and in pairs and times what is left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, best = hot.value
        for batch in batches:
            lists, times = batch.column(width), batch.column(width + 1).flatten().to_numpy()
            pairs, n = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            owner = np.repeat(np.arange(len(lists)), n)
            where = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
            hit = known[where] == pairs if len(known) else np.zeros(len(pairs), bool)
            sums = [np.zeros(len(lists), np.int64) for _ in "ab"]
            for total, values in zip(sums, (best, counts)):
                np.add.at(total, owner[hit], times[hit] * values[where[hit]])
            offsets = pa.array(np.append(0, np.cumsum(np.bincount(owner[~hit], minlength=len(lists)))), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:width], *map(pa.array, sums),
                 *(pa.ListArray.from_arrays(offsets, pa.array(x[~hit])) for x in (pairs, times))],
                [*names, "n_best", "count_sum", "pairs", "times"])

    names = [c for c in told.columns if c not in ("pairs", "times")]
    width = len(names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in told.select(names).schema)
    return told.select(*names, "pairs", "times").mapInArrow(
        run, f"{schema}, n_best long, count_sum long, pairs array<bigint>, times array<bigint>")


def align(docs: DataFrame, a_path: str, b_path: str, most_hot: int = HOT_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    told = settle(encoded(docs, a_path, b_path), "encoded")
    counts = pair_counts(told)
    least, table = hot_pairs(counts, most_hot)
    rows = settle(weighed(told, docs.sparkSession.sparkContext.broadcast(table)), "weighed")
    rest = (rows.where("size(pairs) > 0").select("row", F.explode(F.arrays_zip("pairs", "times")).alias("p"))
            .select("row", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
            .join(counts.where(F.length(F.bin("n")) < least), "pair")
            .groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("more_best"),
                                F.sum(F.col("times") * F.col("n")).alias("more_count")))
    return rows.drop("pairs", "times").join(rest, "row", "left").select(
        "doc_id", *_COUNTS, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_count", F.lit(0))).alias("count_sum"), "groups_sha256")
