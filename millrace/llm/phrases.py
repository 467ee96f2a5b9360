"""Substring dedup: words of passages that were there before are removed.

A window is 20 consecutive words of a document; a word goes if a window that covers it starts with the
same words somewhere earlier. Steps, none of which sees all windows of a text at once:

1. Whole copies are told by two hashes of the word sequence; the smallest id stands for all of them.
2. Each window names one of its 11-word runs, its anchor, by its content alone (one window in nine or
   so has an anchor of its own). Only anchors met in two sequences, or twice in one, matter further.
3. Windows of such anchors are counted by hash with the smallest id: recurring ones are confirmed. In
   the document of smallest id they line up to passages, cut into pieces of bounded length.
4. Pieces, not documents, are dealt to shards of bounded size. Of a document, each shard gets the words from the first to the
   last window that its pieces share with it; a window that is met only at its first place calls for nothing. In a task the pieces of a shard come first and are compiled into an Aho-Corasick automaton, over
   words, not letters; then the shard's documents stream through. A shard that many documents visit is
   compiled in several tasks. Every 20 words of a piece hold one of its 10-word phrases whole; hits are
   extended along the piece word by word, so nothing is decided by a hash.

Edge cases: null and empty texts have no words. Texts with null ids are documents of their own after all others
(ids are taken to be below 2**62), in the order of a hash of the text; equal ones are one. Rows that repeat an id count as one document for what is earlier; rows that repeat id and text are judged
alike. Texts with fewer than 20 words keep all. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WORD, Words, mix, runs, signed, words
from millrace.session import settle

WINDOW, ANCHOR, STEP = 20, 11, 10  # an anchor starts at one of the first STEP words of its window
PHRASE, PHRASE_STEP = 10, 11
PIECE_WINDOWS = 256
SHARD_WORDS = 60_000
SHARD_VISITS = 2_000
NULLS = 1 << 62  # documents without an id get numbers from here on
LISTED_IDS = 500_000
_U = np.uint64


def sequence_key(hashes: np.ndarray) -> tuple[int, int]:
    """Two hashes of a word sequence."""
    with np.errstate(over="ignore"):
        place = mix(np.arange(1, len(hashes) + 1, dtype=_U))
        a = mix(np.array([mix(hashes + place).sum(dtype=_U) + _U(len(hashes))]))
        b = mix(np.array([(mix(hashes ^ place) * _U(0x9E3779B97F4A7C15)).sum(dtype=_U)]))
    return int(signed(a)[0]), int(signed(b)[0])


def sha(kept: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(kept)).hexdigest()


def named(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    own = F.xxhash64(text).bitwiseAND(NULLS - 1).bitwiseOR(F.lit(NULLS))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), own).alias("doc"),
                       F.col("doc_id").isNull().alias("unnamed"), text.alias("text"))


def profile(docs: DataFrame) -> DataFrame:
    """doc, unnamed, n_words, the two hashes of the sequence, and the checksum of all words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c in words(batch.column(2)):
                for i in range(c.hi - c.lo):
                    a, b = int(c.first[i]), int(c.first[i + 1])
                    rows.append((b - a, *sequence_key(c.hashes[a:b]), hashlib.sha256(c.joined(a, b)).hexdigest()))
            told = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(t, pa.int64()) for t in told[:3]),
                 pa.array(told[3], pa.string())], ["doc", "unnamed", "n_words", "k1", "k2", "kept_sha256"])

    return named(docs).mapInArrow(
        run, "doc long, unnamed boolean, n_words long, k1 long, k2 long, kept_sha256 string")


def anchor_starts(hashes: np.ndarray) -> np.ndarray:
    """For each window of a word run, where its anchor starts: the place of the smallest word hash modulo STEP."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.empty(0, dtype=np.int64)
    place = np.arange(len(hashes), dtype=_U)
    low = (mix(hashes ^ _U(0xA0761D6478BD642F)) & ~_U((1 << 26) - 1)) | (place & _U((1 << 26) - 1))
    size = 1
    while size * 2 <= WINDOW:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    low = np.minimum(low[:n], low[WINDOW - size:WINDOW - size + n])
    start = np.arange(n)
    at = ((low & _U((1 << 26) - 1)).astype(np.int64) - start) % (1 << 26)
    return start + at % STEP


def row_anchors(chunk: Words) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, anchor start of each window, hash of the run at each word, word hashes) of rows with a window."""
    for i in range(chunk.hi - chunk.lo):
        own = chunk.hashes[chunk.first[i]:chunk.first[i + 1]]
        if len(own) >= WINDOW:
            yield chunk.lo + i, anchor_starts(own), runs(own, ANCHOR), own


def _flat(columns: list[list[np.ndarray]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c) if c else np.empty(0, np.int64), pa.int64()) for c in columns], names)


def recurring_anchors(docs: DataFrame) -> DataFrame:
    """(anchor) of those met in two different sequences or twice in one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c in words(batch.column(0)):
                anchors, keys = [], []
                for _, starts, hashed, own in row_anchors(c):
                    kinds, times = np.unique(hashed[np.unique(starts)], return_counts=True)
                    twice = kinds[times > 1]
                    key = sequence_key(own)[0]
                    anchors += [signed(kinds), signed(twice)]
                    keys += [np.full(len(kinds), key), np.full(len(twice), ~key)]  # a second, different key
                yield _flat([anchors, keys], ["anchor", "key"])

    found = named(docs).select("text").mapInArrow(run, "anchor long, key long")
    return (found.groupBy("anchor").agg(F.min("key").alias("low"), F.max("key").alias("high"))
            .where("low < high").select("anchor"))


def anchor_places(docs: DataFrame) -> DataFrame:
    """(anchor, doc, at): every anchor of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            for c in words(batch.column(1)):
                out = [[], [], []]
                for row, starts, hashed, _ in row_anchors(c):
                    at = np.unique(starts)
                    for column, values in zip(out, (signed(hashed[at]), np.full(len(at), names[row]), at)):
                        column.append(values)
                yield _flat(out, ["anchor", "doc", "at"])

    return named(docs).select("doc", "text").mapInArrow(run, "anchor long, doc long, at long")


def recurring_windows(texts: DataFrame) -> DataFrame:
    """(window, doc, n, low, high) of the windows of texts (doc, text, ats) whose anchor starts at one of ats: how often
    each is met and where it is met first and last."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_numpy()
            for c in words(batch.column(1)):
                out = [[], [], [], [], []]
                for row, starts, _, own in row_anchors(c):
                    ats = batch.column(2)[row].values.to_numpy(zero_copy_only=False)
                    at = np.flatnonzero(np.isin(starts, ats))
                    here = runs(own, WINDOW)[at]
                    order = np.argsort(here, kind="stable")
                    first = np.flatnonzero(np.append(True, np.diff(here[order]) != 0))[:len(here)]
                    last = np.append(first[1:], len(here))[:len(first)] - 1
                    for column, values in zip(out, (signed(here[order[first]]), np.full(len(first), names[row]),
                                                    last - first + 1, at[order[first]], at[order[last]])):
                        column.append(values)
                yield _flat(out, ["window", "doc", "n", "low", "high"])

    return texts.select("doc", "text", "ats").mapInArrow(
        run, "window long, doc long, n long, low long, high long")


def passages(firsts: DataFrame) -> DataFrame:
    """(doc, begin, phrase, windows): pieces of passages, from texts with the hashes of the windows that
    are first there. phrase: the piece's words, joined by spaces; windows: its own hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for c in words(batch.column(1)):
                for row, _, _, own in row_anchors(c):
                    known = batch.column(2)[row].values.to_numpy(zero_copy_only=False)
                    here = signed(runs(own, WINDOW))
                    hit = np.flatnonzero(np.isin(here, known))
                    hit = np.sort(hit[np.unique(here[hit], return_index=True)[1]])  # first places only
                    a, names = int(c.first[row - c.lo]), batch.column(0)
                    for line in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1):
                        for k in range(0, len(line), PIECE_WINDOWS):
                            piece = line[k:k + PIECE_WINDOWS]
                            low, high = int(piece[0]), int(piece[-1]) + WINDOW
                            rows.append((names[row].as_py(), low, c.joined(a + low, a + high).decode(),
                                         here[piece].tolist()))
            told = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(t, k) for t, k in zip(told, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))],
                ["doc", "begin", "phrase", "windows"])

    return firsts.select("doc", "text", "windows").mapInArrow(
        run, "doc long, begin long, phrase string, windows array<bigint>")


class Automaton:
    """The pieces of a shard. A word is one character here; words that no piece has are all alike."""

    def __init__(self, pieces: list[tuple[int, int, str]]):
        self.letters: dict[bytes, str] = {}
        self.pieces = []
        spots: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (doc, begin, phrase) in enumerate(pieces):
            coded = "".join(self._letter(w) for w in phrase.encode().split())
            self.pieces.append((doc, begin, coded))
            for at in range(0, len(coded) - PHRASE + 1, PHRASE_STEP):
                spots[coded[at:at + PHRASE]].append((n, at))
        self.automaton = ahocorasick.Automaton()
        for phrase, where in spots.items():
            self.automaton.add_word(phrase, where)
        if spots:
            self.automaton.make_automaton()

    def _letter(self, word: bytes) -> str:
        if word not in self.letters:
            n = len(self.letters) + 1
            self.letters[word] = chr(n if n < 0xD800 else n + 0x800)
        return self.letters[word]

    def spans(self, doc: int, found: list[bytes], skipped: int = 0) -> list[tuple[int, int]]:
        """Word ranges [a, b) of a document that lie in a piece, its own first place excepted. found: its words without the
        first `skipped` ones and perhaps the last ones."""
        if not self.pieces:
            return []
        get = self.letters.get
        coded = "".join([get(w, "\0") for w in found])
        spans, seen = set(), set()
        for last, where in self.automaton.iter(coded):
            for n, at in where:
                shift = last + 1 - PHRASE - at  # where the piece's first word would be
                if (n, shift) in seen:
                    continue
                seen.add((n, shift))
                owner, begin, piece = self.pieces[n]
                if owner == doc and begin == shift + skipped:
                    continue
                low, high = max(0, shift), min(len(coded), shift + len(piece))
                mine, other = coded[low:high], piece[low - shift:high - shift]
                if mine == other:
                    if high - low >= WINDOW:
                        spans.add((low, high))
                    continue
                unlike = np.flatnonzero(np.frombuffer(mine.encode("utf-32-le"), np.uint32)
                                        != np.frombuffer(other.encode("utf-32-le"), np.uint32))
                a = np.append(0, unlike + 1)
                b = np.append(unlike, high - low)
                spans.update((low + x, low + y) for x, y in zip(a[b - a >= WINDOW].tolist(), b[b - a >= WINDOW].tolist()))
        return sorted((a + skipped, b + skipped) for a, b in spans)


def cut_out(texts: DataFrame) -> DataFrame:
    """(shard, salt, kind, doc, begin, skipped, text): from rows (doc, k1, text, routes), the words that each route names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, k1, text, routes in zip(*(x.to_pylist() for x in batch.columns)):
                found = text.encode().split()
                rows = [(r["shard"], r["salt"], 1, doc, k1, r["low"], b" ".join(found[r["low"]:r["high"] + WINDOW]).decode())
                        for r in routes]
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    schema = pa.schema([("shard", pa.int64()), ("salt", pa.int64()), ("kind", pa.int32()), ("doc", pa.int64()),
                        ("begin", pa.int64()), ("skipped", pa.int64()), ("text", pa.string())])
    return texts.select("doc", "k1", "text", "routes").mapInArrow(
        run, "shard long, salt long, kind int, doc long, begin long, skipped long, text string")


def located(shards: DataFrame) -> DataFrame:
    """(doc, k1, spans): from rows (shard, salt, kind, doc, begin, skipped, text), a shard's pieces (kind 0) before its
    documents (kind 1) in the same task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pieces, automaton = None, [], None
        for batch in batches:
            rows = []
            for shard, salt, kind, doc, begin, skipped, text in zip(*(x.to_pylist() for x in batch.columns)):
                if (shard, salt) != now:
                    now, pieces, automaton = (shard, salt), [], None
                if not kind:
                    pieces.append((doc, begin, text))
                    continue
                if automaton is None:
                    automaton = Automaton(pieces)
                spans = automaton.spans(doc, text.encode().split(), skipped)
                if spans:
                    rows.append((doc, begin, [s[0] for s in spans], [s[1] for s in spans]))
            told = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(t, k) for t, k in zip(told, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))],
                ["doc", "k1", "starts", "ends"])

    return shards.mapInArrow(run, "doc long, k1 long, starts array<bigint>, ends array<bigint>")


def listed(ids: DataFrame) -> DataFrame:
    """Ids to look for in a scan of whole texts: sent along if they are few, shuffled otherwise."""
    return F.broadcast(ids) if ids.count() <= LISTED_IDS else ids


def find_spans(docs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidate texts (doc, k1, text, ats) and their spans (doc, k1, starts, ends), several rows each."""
    recurring = settle(recurring_anchors(docs), "anchors")
    first = settle(rows.where(F.col("n_words") >= WINDOW).groupBy("k1", "k2").agg(F.min("doc").alias("doc")),
                   "sequences")
    places = settle(anchor_places(docs).join(recurring, "anchor")
                    .join(first.select("doc").distinct(), "doc", "left_semi"), "places")
    ats = settle(places.groupBy("doc").agg(F.collect_list("at").alias("ats")), "ats")
    chosen = named(docs).select("doc", "text").join(listed(ats.select("doc")), "doc", "left_semi")
    texts = settle(chosen.distinct().join(ats, "doc").withColumn("k1", F.xxhash64("text")), "texts")
    windows = recurring_windows(texts)
    known = windows.groupBy("window").agg(F.min("doc").alias("doc"), F.sum("n").alias("n"))
    firsts = settle(known.where("n > 1").groupBy("doc").agg(F.collect_list("window").alias("windows")), "windows")
    pieces = settle(passages(texts.join(firsts, "doc")), "pieces")
    total = pieces.agg(F.sum(F.length("phrase") - F.length(F.translate("phrase", " ", "")) + 1)).first()[0] or 0
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc", "begin"), F.lit(total // SHARD_WORDS + 1)))
    homes = pieces.select(F.explode("windows").alias("window"), "shard", F.col("doc").alias("owner"))
    met = windows.join(homes, "window").groupBy("window", "doc", "shard").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.min("owner").alias("owner"))
    routes = settle(met.where("doc <> owner OR n > 1").groupBy("doc", "shard").agg(
        F.min("low").alias("low"), F.max("high").alias("high")), "routes")
    salts = settle(routes.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_VISITS).alias("salts")), "salts")
    ready = (pieces.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
             .select("shard", "salt", F.lit(0).alias("kind"), "doc", F.col("begin"), F.lit(0).cast("long").alias("skipped"),
                     F.col("phrase").alias("text")))
    dealt = routes.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("doc", "shard"), F.col("salts")))
    visits = cut_out(texts.select("doc", "k1", "text").join(
        dealt.groupBy("doc").agg(F.collect_list(F.struct("shard", "salt", "low", "high")).alias("routes")), "doc"))
    streams = ready.unionByName(visits).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")
    return texts, settle(located(streams), "spans")


def removed(texts: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, k1, n_removed, kept_sha256, kept) of the texts that lose words."""
    merged = spans.groupBy("doc", "k1").agg(F.flatten(F.collect_list("starts")).alias("starts"),
                                            F.flatten(F.collect_list("ends")).alias("ends"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, starts, ends in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4))):
                found = text.encode().split()
                depth = np.zeros(len(found) + 1, dtype=np.int64)
                np.add.at(depth, starts, 1)
                np.add.at(depth, ends, -1)
                keep = np.flatnonzero(np.cumsum(depth)[:-1] == 0)
                kept = [found[i] for i in keep]
                rows.append((len(found) - len(kept), sha(kept), b" ".join(kept).decode()))
            told = list(zip(*rows)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(told[0], pa.int64()), pa.array(told[1], pa.string()),
                 pa.array(told[2], pa.string())], ["doc", "k1", "n_removed", "kept_sha256", "kept"])

    return (texts.select("doc", "k1", "text").join(merged, ["doc", "k1"]).select("doc", "k1", "text", "starts", "ends")
            .mapInArrow(run, "doc long, k1 long, n_removed long, kept_sha256 string, kept string"))


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    rows = settle(profile(docs), "profile")
    texts, spans = find_spans(docs, rows)
    lost = removed(texts, spans)
    # one row per (doc, all words' checksum): the text as it was names the row again
    whole = texts.select("doc", "k1", F.sha2(F.array_join(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), " "), 256)
                         .alias("was"))
    lost = settle(lost.join(whole, ["doc", "k1"]).select("doc", F.col("was").alias("kept_sha256"), "n_removed",
                                                         F.col("kept_sha256").alias("now"))
                  .dropDuplicates(["doc", "kept_sha256"]), "lost")
    first = rows.groupBy("k1", "k2").agg(F.min("doc").alias("first"))
    judged = rows.join(settle(first, "firsts"), ["k1", "k2"]).join(lost, ["doc", "kept_sha256"], "left")
    copy = (F.col("doc") > F.col("first")) & (F.col("n_words") >= WINDOW)
    return judged.select(
        F.when(~F.col("unnamed"), F.col("doc")).alias("doc_id"), "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(sha([]))).otherwise(F.coalesce("now", "kept_sha256")).alias("kept_sha256"))
