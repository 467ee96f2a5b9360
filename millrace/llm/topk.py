"""Exact top-k inner product search over a pivot-distance index.

Vectors are lifted by one component so that all have the same length M; then a larger inner product is
a smaller distance, and the triangle inequality applies: a vector at distance r from a pivot is at least
|r - d| from a query at distance d. The index keys each vector by its nearest pivot and the ring its
distance falls into; a cell (pivot, ring) is stored in rows of about BLOCK vectors, so a crowded cell is
many rows. A query first takes the cells of best bound until k others are seen, and the k-th score it finds
is its threshold. From there it expands to the rings whose bound reaches the threshold; sorted by bound,
it stops at the first that does not.

There are at most PIVOTS * MOST_RINGS cells, so their summary has a fixed bound and goes to every task.
Queries travel to cells in blocks, and only scores that reach a threshold come back.

Edge cases: vectors that are null, or hold a null or non-finite component, and rows with a null id take no
part. Shorter vectors count as padded with zeros; an empty vector scores 0. Rows that repeat id and
vector count once; an id with several vectors is a candidate with each and asks with the smallest.
Scores must fit 63 bits. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import settle

SCALE = 1_024
PIVOTS, MOST_RINGS, PIVOT_SAMPLE = 32, 64, 2_048
BLOCK, QUERY_BLOCK = 512, 128
ROW_MB = 8
K = 10


def quantized(vectors: DataFrame, name: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, q: floor(scale * x) of each component, for the vectors that take part."""
    x = F.col(name)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & sound).select(
        F.col("vec_id").cast("long").alias("vec_id"), q.cast("array<bigint>").alias("q")).dropDuplicates()


def rows_of(lists: pa.ListArray, width: int) -> np.ndarray:
    """A list column as a matrix, short rows padded with zeros."""
    ends = lists.offsets.to_numpy()
    sizes = np.diff(ends)
    out = np.zeros((len(lists), width), dtype=np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)[ends[0]:ends[-1]]
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def lifted(q: np.ndarray, top: float) -> np.ndarray:
    """Unit-scale vectors with the component that makes all of them as long as the longest."""
    x = q / top
    return np.hstack([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1)))[:, None]])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2.0 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0.0))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first from the first row."""
    picked = sample[:1]
    far = distances(sample, picked)[:, 0]
    while len(picked) < min(n, len(sample)):
        picked = np.vstack([picked, sample[np.argmax(far)]])
        far = np.minimum(far, distances(sample, picked[-1:])[:, 0])
    return picked


class Index:
    """The keyed vectors, stored cells, and what every task needs to bound them."""

    def __init__(self, vectors: DataFrame):
        base = settle(vectors, "vectors")
        norm = F.aggregate("q", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
        n, top, self.width = base.agg(F.count("*"), F.max(norm), F.max(F.size("q"))).first()
        self.n, self.top, self.width = n, float(top or 0.0) ** 0.5 or 1.0, max(self.width or 0, 1)
        sample = base.orderBy(F.xxhash64("vec_id"), "q").limit(PIVOT_SAMPLE).collect()
        grid = np.zeros((len(sample), self.width), dtype=np.int64)
        for i, r in enumerate(sample):
            grid[i, :len(r["q"])] = r["q"]
        self.pivots = choose_pivots(lifted(grid, self.top), PIVOTS) if n else np.zeros((1, self.width + 1))
        keyed = settle(self._keyed(base), "keyed")
        rings = int(min(MOST_RINGS, max(1, n // (PIVOTS * BLOCK))))
        span = keyed.groupBy("pivot").agg(F.min("r").alias("low"), F.max("r").alias("high"))
        keyed = keyed.join(F.broadcast(span), "pivot").withColumn(  # a row per pivot
            "ring", F.least(F.lit(rings - 1), F.coalesce(F.floor(
                (F.col("r") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * rings),
                F.lit(0))).cast("int")).drop("low", "high")
        self.keyed = settle(keyed, "ringed")
        cells = self.keyed.groupBy("pivot", "ring").agg(
            F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n"))
        self.cells = [tuple(c) for c in cells.orderBy("pivot", "ring").collect()]
        per_row = max(1, min(BLOCK, (ROW_MB << 20) // (8 * self.width)))
        rows_in = cells.select("pivot", "ring", F.ceil(F.col("n") / per_row).alias("rows"))
        self.stored = settle(
            self.keyed.join(F.broadcast(rows_in), ["pivot", "ring"])  # at most PIVOTS * MOST_RINGS rows
            .withColumn("part", F.pmod(F.xxhash64("vec_id", "q"), F.col("rows")))
            .groupBy("pivot", "ring", "part")
            .agg(F.collect_list(F.struct("vec_id", "q")).alias("v"))
            .select("pivot", "ring", F.col("v.vec_id").alias("ids"), F.flatten("v.q").alias("flat"),
                    F.transform("v.q", lambda x: F.size(x)).alias("sizes")), "cells")

    def _keyed(self, base: DataFrame) -> DataFrame:
        width, top, pivots = self.width, self.top, self.pivots

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                far = distances(lifted(rows_of(batch.column(1), width), top), pivots)
                near = far.argmin(1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(far)), near])],
                    ["vec_id", "q", "pivot", "r"])

        return base.mapInArrow(run, "vec_id long, q array<bigint>, pivot int, r double")

    def bounds(self):
        """A function from query vectors to the best score each cell can hold, never too low."""
        width, top, pivots = self.width, self.top, self.pivots
        cell = np.array([c[0] for c in self.cells], dtype=np.int64)
        low, high = (np.array([c[i] for c in self.cells], dtype=float) for i in (2, 3))

        def best(lists: pa.ListArray) -> np.ndarray:
            x = lifted(rows_of(lists, width), top)
            d = distances(x, pivots)[:, cell]
            gap = np.maximum(0.0, np.maximum(low - d, d - high) - 1e-7)
            return (1.0 - gap * gap / 2.0 + 1e-9) * top * top

        return best

    def visits(self, queries: DataFrame, k: int, seeds: bool) -> DataFrame:
        """(pivot, ring, query_id, q, floor): the cells each query takes. seeds: the first ones; else
        the further ones whose bound reaches the query's floor, the k-th score found so far."""
        best, cells = self.bounds(), [c[:2] for c in self.cells]
        held = np.array([c[4] for c in self.cells])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for low in range(0, batch.num_rows, QUERY_BLOCK):
                    part = batch.slice(low, QUERY_BLOCK)
                    top = best(pa.concat_arrays([part.column(1)]))
                    order = np.argsort(-top, axis=1, kind="stable")
                    seen = np.cumsum(held[order], axis=1)
                    first = np.zeros(top.shape, dtype=bool)
                    np.put_along_axis(first, order, np.hstack(
                        [np.zeros((len(top), 1)), seen[:, :-1]]) <= k, axis=1)  # k others and itself
                    take = first if seeds else ~first & (
                        top >= part.column(2).to_numpy(zero_copy_only=False)[:, None])
                    row, at = np.nonzero(take)
                    for a in range(0, len(row), 4_096):
                        some, where = row[a:a + 4_096], at[a:a + 4_096]
                        picked = part.take(pa.array(some))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([cells[c][i] for c in where], pa.int32()) for i in (0, 1)]
                            + picked.columns, ["pivot", "ring", "query_id", "q", "floor"])

        return queries.select("query_id", "q", "floor").mapInArrow(
            run, "pivot int, ring int, query_id long, q array<bigint>, floor double")

    def scored(self, visits: DataFrame, k: int) -> DataFrame:
        """(query_id, vec_id, score): of each visit the k best, from the floor on."""
        width, top = self.width, self.top
        some = max(1, min(QUERY_BLOCK, (ROW_MB << 20) // (8 * width)))
        asked = visits.groupBy("pivot", "ring", F.pmod(F.xxhash64("query_id"), F.lit(
            max(1, self.n // 100 // some + 1))).alias("block")).agg(
            F.collect_list(F.struct("query_id", "q", "floor")).alias("v"))
        asked = settle(asked.select(
            "pivot", "ring", F.col("v.query_id").alias("names"), F.flatten("v.q").alias("asked"),
            F.transform("v.q", lambda x: F.size(x)).alias("widths"), F.col("v.floor").alias("floors")), "visits")
        small = top * top < 2.0**52  # then products are exact in doubles

        def matrix(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
            out = np.zeros((len(sizes), width), dtype=np.int64)
            out[np.arange(width) < sizes[:, None]] = flat
            return out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    ids, flat, sizes, names, asked, widths, floors = (
                        batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(7))
                    x, q = matrix(flat, sizes), matrix(asked, widths)
                    score = (x.astype(float) @ q.T.astype(float)).astype(np.int64) if small else x @ q.T
                    rows = []
                    for j, name in enumerate(names):
                        fit = np.flatnonzero((score[:, j] >= floors[j]) & (ids != name))
                        s = score[fit, j]
                        if len(fit) > k:
                            near = s >= np.partition(s, len(s) - k)[len(s) - k]
                            fit, s = fit[near], s[near]
                        pick = np.lexsort((ids[fit], -s))[:k]
                        rows += [(int(name), int(a), int(b)) for a, b in zip(ids[fit][pick], s[pick])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[], [], []])],
                        ["query_id", "vec_id", "score"])

        pairs = self.stored.join(asked, ["pivot", "ring"]).select(
            "ids", "flat", "sizes", "names", "asked", "widths", "floors")
        return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for every query (query_id, q) its k best of vectors (vec_id, q)
    without its own id, ties to the smaller vec_id."""
    index = Index(vectors)
    asked = queries.groupBy("query_id").agg(F.min("q").alias("q"))
    asked = settle(asked.withColumn("floor", F.lit(float("-inf"))), "queries")
    first = settle(ranked(index.scored(index.visits(asked, k, True), k), k), "first")
    floors = first.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("reached"))
    more = asked.join(floors, "query_id", "left").withColumn("floor", F.coalesce("reached", "floor"))
    rest = index.scored(index.visits(more, k, False), k)
    both = first.select("query_id", "vec_id", "score").unionByName(rest)
    return ranked(both, k).select("query_id", "rank", "vec_id", "score")
