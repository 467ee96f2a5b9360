"""Exact Jaccard join of documents on word shingles by PartEnum signatures.

Copies are folded to one set first, which counts them. Of two sets with a Jaccard similarity of at least t, each shares all but
a share 1 - t of its own shingles with the other. So a set that has more shingles than that to itself, counted over the
shingles of a hashed part of the domain, is similar to none and goes no further. That is an exact bound, not a sample of sets.

The others are banded by size. Two sets of a band differ in at most k elements, k = (1 - t) / (1 + t) * 2 * (largest size
of the band). The domain is hashed into n1 > k / 2 groups of three partitions. One group must hold at most one difference,
so two of its partitions agree whole: each two partitions of each group are one signature. A set close to the next
band also signs there. Signatures of few elements say little, and empty ones nothing: a set drops those of fewer than m
elements, m being the most that leaves it enough groups all of whose signatures have m or more. Of two similar sets,
the one with the larger m has a group that agrees, so its signature there has m elements in both, and both keep it. No
similar pair can miss.

The smallest and largest set of each signature combine before the shuffle, members are tied to the smallest one, ties give
clusters of candidates, and clusters are verified in pairs of blocks of bounded size, spread evenly. A pair of blocks
returns one row per set, not per pair: a root inside the pair and its number of links. Signatures and sets are told from the
texts when they are needed: only sets that are in a cluster are moved, once, to their block.

Edge cases: a text with fewer words than a shingle has is one shingle; null texts and texts without
words are empty and linked with nothing. Null ids get a null class. Rows that repeat an id are
documents of their own; the class is the smallest id reachable. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from millrace.llm.common import components, mix, runs, signed, words
from millrace.session import settle

SHINGLE, NUM, DEN = 3, 90, 100
BAND_GROWTH = 1.5
PARTITIONS, DIFFERENCES = 3, 1  # of a group, and how many of its elements may differ
SPARE_GROUPS = 10  # a spare group for each so many: they make room for dropping weak signatures
BLOCK_SHINGLES, BLOCK_SETS = 1 << 16, 512
LISTED_IDS = 500_000  # ids of candidates up to this many are sent along as a list of 8 bytes each
_U = np.uint64


def bands(growth: float = BAND_GROWTH) -> np.ndarray:
    """Lower size limits of the bands, up to sizes no text can have."""
    lows = [1]
    while lows[-1] < 1 << 40:
        lows.append(int(lows[-1] * growth) + 1)
    return np.array(lows, dtype=np.int64)


LOWS = bands()


def row_sets(texts: pa.Array, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of every row."""
    for chunk in words(texts, lower=True):
        hashed = runs(chunk.hashes, width)
        for i in range(chunk.hi - chunk.lo):
            a, b = int(chunk.first[i]), int(chunk.first[i + 1])
            if b - a >= width:
                yield chunk.lo + i, np.unique(hashed[a:b - width + 1])
            else:
                yield chunk.lo + i, runs(chunk.hashes[a:b], b - a) if b > a else np.empty(0, _U)


_CHOICES = np.array(list(combinations(range(PARTITIONS), PARTITIONS - DIFFERENCES)))


def signatures(values: np.ndarray, num: int, den: int) -> np.ndarray:
    """The signatures of one set in its own size band and, if it may pair upwards, in the next ones."""
    size, found = len(values), []
    band = int(np.searchsorted(LOWS, size, "right")) - 1
    low, high = (x.astype(np.float64) for x in np.divmod(mix(values ^ _U(0x5851F42D4C957F2D)), _U(1 << 32))[::-1])
    b = band
    while b == band or size * den // num >= LOWS[b]:
        most = int(LOWS[b + 1]) - 1
        k = 2 * most * (den - num) // (den + num)
        if k:  # otherwise only equal sets are similar here
            groups = k // (DIFFERENCES + 1) + 1
            groups += groups // SPARE_GROUPS
            n = groups * PARTITIONS
            part = ((mix(values + _U(b + 1)) >> _U(32)) * _U(n) >> _U(32)).astype(np.int64)
            # sums of 32 bits are exact as floats
            sums = (np.bincount(part, low, n).astype(_U) * _U(0xC2B2AE3D27D4EB4F)
                    + np.bincount(part, high, n).astype(_U) * _U(0x9E3779B97F4A7C15) + np.arange(n, dtype=_U))
            sums = mix(sums).reshape(groups, PARTITIONS)[:, _CHOICES].sum(axis=2, dtype=_U)
            held = np.bincount(part, minlength=n).reshape(groups, PARTITIONS)[:, _CHOICES].sum(axis=2)
            differ = min(k, (den - num) * (size + min(most, size * den // num)) // (den + num))
            need = differ // (DIFFERENCES + 1) + 1
            least = np.sort(held.min(axis=1))[-need]
            found.append(mix(sums[held >= least] + _U(b * 0x2545F491 + 1)))
        b += 1
    return np.concatenate(found) if found else np.empty(0, _U)


def _key(values: np.ndarray) -> tuple[int, int]:
    """Two independent hashes of a set."""
    if not len(values):
        return 0, 0
    with np.errstate(over="ignore"):
        a = mix(np.array([values.sum(dtype=_U) + _U(len(values))]))
        b = mix(np.array([mix(values).sum(dtype=_U)]))
    return int(signed(a)[0]), int(signed(b)[0])


def keys(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and the two hashes of the set of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [(len(v), *_key(v)) for _, v in row_sets(batch.column(1), width)]
            columns = list(zip(*told)) or [[], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                ["doc_id", "n_shingles", "k1", "k2"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, k1 long, k2 long")


def keyed(docs: DataFrame, width: int, names: list[str]) -> DataFrame:
    """docs with their id as a long and the two hashes of the set of each row under the given names."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [_key(v) for _, v in row_sets(batch.column(batch.schema.get_field_index("text")), width)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([t[i] for t in told], pa.int64()) for i in (0, 1))], full.names)

    plain = docs.withColumn(names[0], F.col("doc_id").cast("long"))
    full = StructType([*plain.schema, *(StructField(n, LongType()) for n in names[1:])])
    return plain.mapInArrow(run, full)


def shared_enough(docs: DataFrame, groups: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Of groups (k1, n_shingles and more) those that may be similar to another: looked at are the shingles in a part of the
    domain half as large again as the share a set may have to itself."""
    part = _U(min(3 * (den - num) * (1 << 63) // den, (1 << 64) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, nodes = [np.empty(0, _U)], [np.empty(0, np.int64)]
            for _, own in row_sets(batch.column(0), width):
                if len(own):
                    some = own[mix(own ^ _U(0xD6E8FEB86659FD93)) < part]
                    values.append(some)
                    nodes.append(np.full(len(some), _key(own)[0]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(signed(np.concatenate(values))), pa.array(np.concatenate(nodes))], ["value", "node"])

    seen = docs.where("length(text) > 0").select("text").mapInArrow(run, "value long, node long")
    alone = (seen.groupBy("value").agg(F.min("node").alias("node"), F.max("node").alias("last"))
             .where("node = last").groupBy("node").agg(F.count("*").alias("alone")))
    return (groups.join(settle(alone, "alone"), F.col("k1") == F.col("node"), "left")
            .where(den * F.coalesce("alone", F.lit(0)) <= (den - num) * F.col("n_shingles"))
            .select(groups.columns))


def representatives(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(doc_id, text) of the rows whose id represents a member; another text under such an id is among them."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .join(listed(members.select("doc_id").distinct()), "doc_id", "left_semi"))


def signed_sets(docs: DataFrame, members: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(sig, node): every signature of the set of every representative, named by its first hash."""
    def told(own: list[np.ndarray], names: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(own)), pa.array(np.repeat(names, [len(x) for x in own]))], ["sig", "node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, names, held = [], [], 0
            for _, values in row_sets(batch.column(0), width):
                if not len(values):
                    continue
                own.append(signed(signatures(values, num, den)))
                names.append(_key(values)[0])
                held += len(own[-1])
                if held > 1 << 18:
                    yield told(own, names)
                    own, names, held = [], [], 0
            if own:
                yield told(own, names)

    return representatives(docs, members).select("text").mapInArrow(run, "sig long, node long")


def candidate_clusters(docs: DataFrame, members: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(node, cluster): sets that share signatures, directly or over others."""
    sigs = settle(signed_sets(docs, members, width, num, den), "signatures")
    leaders = settle(sigs.groupBy("sig").agg(F.min("node").alias("leader"), F.max("node").alias("last"))
                     .where("leader < last").select("sig", "leader"), "leaders")
    ties = settle(sigs.join(leaders, "sig").where("node <> leader")
                  .select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), "ties")
    rest = components(ties, "clusters")
    roots = rest.select(F.col("root").alias("node"), "root").distinct()
    return settle(rest.unionByName(roots).withColumnRenamed("root", "cluster"), "clusters")


def places(members: DataFrame, clusters: DataFrame) -> DataFrame:
    """The members that are in a cluster with their block, one of n. No sets are needed to deal them."""
    inside = members.join(clusters.withColumnRenamed("node", "k1"), "k1")
    room = inside.groupBy("cluster").agg(
        F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("n"))
    return settle(
        inside.join(settle(room, "room"), "cluster")
        .withColumn("block", F.pmod(F.xxhash64("k1", "k2"), F.col("n")).cast("int"))
        .select("doc_id", "k1", "k2", "copies", "cluster", "block", "n"), "places")


def fetch_sets(docs: DataFrame, members: DataFrame, width: int) -> DataFrame:
    """members with their sets, all of a cluster and block in one task. Only documents that represent a member leave the
    scan, and each set is moved once, to its block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told, rows, held = [], [], 0
            for row, values in row_sets(batch.column(1), width):
                told.append((*_key(values), signed(values)))
                rows.append(row)
                held += len(values)
                if held > 1 << 18:
                    yield _set_batch(batch, rows, told)
                    told, rows, held = [], [], 0
            if rows:
                yield _set_batch(batch, rows, told)

    sets = representatives(docs, members).mapInArrow(run, "doc_id long, k1 long, k2 long, values array<long>")
    return (sets.join(listed(members, LISTED_IDS // 4), ["doc_id", "k1", "k2"]).repartition("cluster", "block")
            .dropDuplicates(["cluster", "block", "k1", "k2"]))


def _set_batch(batch: pa.RecordBatch, rows: list[int], told: list[tuple]) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(np.cumsum([0, *(len(t[2]) for t in told)]).astype(np.int32),
                                     pa.array(np.concatenate([t[2] for t in told])))
    return pa.RecordBatch.from_arrays(
        [batch.column(0).take(pa.array(rows)), pa.array([t[0] for t in told], pa.int64()),
         pa.array([t[1] for t in told], pa.int64()), lists], ["doc_id", "k1", "k2", "values"])


def block_links(ids: np.ndarray, copies: np.ndarray, sets: list[np.ndarray], left: int,
                num: int, den: int) -> list[tuple[int, int, int]]:
    """(name, root, n_links) of the first `left` sets against the rest, or among themselves if all are.

    Shingles that occur once cannot be shared and are left out; the others are counted by a product of
    two 0/1 matrices, a bounded number of columns at a time.
    """
    inner = left == len(ids)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    order = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], order[column[keep]]
    right = 0 if inner else left
    common = np.zeros((left, len(ids) - right), dtype=np.float64)
    step = 4096
    by = np.argsort(column, kind="stable")
    owner, column = owner[by], column[by]
    for low in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(column, [low, low + step])
        part = np.zeros((len(ids), step), dtype=np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part[:left] @ part[right:].T
    union = sizes[:left, None] + sizes[None, right:] - common
    alike = den * common >= num * union
    if inner:
        np.fill_diagonal(alike, False)
    a, b = np.nonzero(alike)
    lowest = ids.copy()
    while len(a):
        before = lowest.copy()
        np.minimum.at(lowest, a, before[b + right])
        np.minimum.at(lowest, b + right, before[a])
        if (lowest == before).all():
            break
    links = np.zeros(len(ids), dtype=np.int64)
    np.add.at(links, a, copies[b + right])
    if not inner:
        np.add.at(links, b + right, copies[a])
    hit = np.flatnonzero(links)
    return [(int(ids[i]), int(lowest[i]), int(links[i])) for i in hit]


def verified(members: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root, n_links) rows of verified links from members with cluster, block, n, k1, copies and values. Most clusters
    are one block; only blocks of larger ones are moved to meet others."""
    packed = settle(members.groupBy("cluster", "block", "n").agg(
        F.collect_list(F.struct("k1", "copies", "values")).alias("sets")), "blocks")
    alone = packed.select("sets", F.array().cast(packed.schema["sets"].dataType).alias("others"))
    many = packed.where("n > 1")
    left = many.where("block < n - 1").select("cluster", "sets", F.explode(F.sequence(
        F.col("block") + 1, F.col("n") - 1)).alias("block"))
    right = many.select("cluster", "block", F.col("sets").alias("others"))
    pairs = alone.unionByName(left.join(right, ["cluster", "block"]).select("sets", "others"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sides = [batch.column(c)[i].values for c in (0, 1)]
                both = [np.concatenate([s.field(f).to_numpy(zero_copy_only=False) for s in sides])
                        for f in ("k1", "copies")]
                sets = [x.values.to_numpy() for s in sides for x in s.field("values")]
                told = block_links(*both, sets, len(sides[0]), num, den)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (list(zip(*told)) or [[], [], []])],
                    ["node", "root", "n_links"])

    return pairs.mapInArrow(run, "node long, root long, n_links long")


def classes(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, n_shingles, k1, k2), and of each set of theirs (class, k1, k2, doc_id, copies, n_links, class_id): the
    smallest id that has it, its class and the smallest id in that, and how many other rows a row of it is similar to."""
    rows = settle(keys(docs, width), "keys")
    real = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    groups = settle(real.groupBy("k1", "k2").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles")), "groups")
    members = settle(shared_enough(docs, groups, width, num, den), "members")
    placed = places(members, candidate_clusters(docs, members, width, num, den))
    links = settle(verified(fetch_sets(docs, placed, width), num, den), "links")
    roots = components(links.select(F.col("node").alias("a"), F.col("root").alias("b")), "classes")
    degree = links.groupBy("node").agg(F.sum("n_links").alias("near"))
    told = settle(
        groups.join(roots.withColumnRenamed("node", "k1"), "k1", "left")
        .join(degree.withColumnRenamed("node", "k1"), "k1", "left")
        .select("k1", "k2", "doc_id", "copies", F.coalesce("root", "k1").alias("class"),
                (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "told")
    low = told.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    return rows, settle(told.join(low, "class"), "classes")


def join(docs: DataFrame, width: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links (other rows it is similar to) of every row.

    Two rows are linked when den * shared shingles >= num * shingles of either.
    """
    rows, told = classes(docs, width, num, den)
    full = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return rows.join(told.select("k1", "k2", "class_id", "n_links"), ["k1", "k2"], "left").select(
        "doc_id", "n_shingles",
        F.when(full, F.col("class_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(full, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, width: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row of each class, of the smallest id in it. Rows with a null id, and rows without words, stay. Decided is by
    row: another text under the id of a row that goes stays. Of rows of that id that have the same set, or are in the same
    class, one stays."""
    rows, told = classes(docs, width, num, den)
    first = told.groupBy("class").agg(F.min(F.struct("doc_id", "k1", "k2")).alias("first"))
    held = settle(told.join(first, "class").where("k1 = first.k1 AND k2 = first.k2")
                  .select("k1", "k2", F.col("first.doc_id").alias("keeps")), "held")
    taken = {c.lower() for c in docs.columns}
    names = []
    for name in ("id", "k1", "k2"):
        while name in taken:
            name += "_"
        names.append(name)
        taken.add(name)
    judged = rows.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).groupBy("doc_id", "k1", "k2").agg(
        F.count("*").alias("n")).join(held, ["k1", "k2"], "left")
    stays = F.coalesce(F.col("doc_id") == F.col("keeps"), F.lit(False))
    judged = settle(judged.select("doc_id", "k1", "k2", "n", stays.alias("stays")).toDF(*names, "n", "stays"), "judged")
    ids = keyed(docs, width, names)
    once = ids.join(listed(judged.where("NOT stays OR n > 1").select(names)), names, "left_anti")
    more = ids.join(listed(judged.where("stays AND n > 1").select(names)), names, "left_semi").dropDuplicates(names)
    return once.unionByName(more).select(docs.columns)


def listed(ids: DataFrame, most: int | None = None) -> DataFrame:
    """Ids to look for in a scan of whole texts: sent along if they are few, shuffled otherwise."""
    ids = settle(ids, "ids")
    return F.broadcast(ids) if ids.count() <= (LISTED_IDS if most is None else most) else ids
