"""Mixing sources to target weights by a low-discrepancy schedule.

The documents of a source stand in an order shuffled by id hash and are read as one endless stream of
words, cut into blocks of equal size. Slot n of the mix takes the point frac(n * golden ratio); the
source whose stretch of the cumulative weights holds the point owns the slot, and the r-th slot of a
source takes block r of its stream. So every part of the mix has the sources in proportion. A source
whose quota of blocks is full leaves its later slots empty; blocks the sequence did not reach by its
end are appended. The last block is cut to the target.

Positions in streams and ranks of slots are running sums: sums per (source, bucket) first, then inside
a bucket, so a source that owns most rows is spread over all buckets.

Edge cases: null text has size 0 and is never taken. A null source is a source of its own, last in
order. Rows that repeat an id are documents of their own. A source without words has target 0. Extra
columns pass through `mixed_documents` and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD
from millrace.session import settle

WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_PASSES = 2
BLOCK_WORDS = 1_024
GOLDEN = 0x9E3779B97F4A7C15  # the golden ratio's fraction times 2**64
BUCKET_HEX = 3          # 4,096 buckets of a source's shuffled order
SLOT_CHUNK = 1 << 16    # slots ranked together


def row_keys(docs: DataFrame) -> list[Column]:
    """Two hashes that name rows of equal id, source and text."""
    whole = [F.col(c) for c in ("doc_id", "source", "text")]
    whole += [F.col(c).isNull() for c in ("doc_id", "source", "text")]
    return [F.xxhash64(*whole).alias("key_a"), F.hash(*whole).alias("key_b")]


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, the place in the shuffled order and two keys of the whole row."""
    return docs.select(
        "doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("place"), *row_keys(docs))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, number, source_size, weight, target) per source. One row per source, so one task will do.

    Filling by weight with a ceiling is a common level: sources are filled in the order of ceiling per
    weight, and the level is what the others share when all before are full.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("number", F.row_number().over(by_name) - 1)
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)),
                                                (F.col("number") % len(WEIGHTS) + 1).cast("int")))
    ceiling = MOST_PASSES * F.col("source_size")
    by_level = Window.orderBy(ceiling / F.col("weight"), "number")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * (SHARE_PERCENT / 100)
    per = per.withColumn("left", total - F.coalesce(F.sum(ceiling).over(before), F.lit(0)))
    per = per.withColumn("open", F.sum("weight").over(after))
    per = per.withColumn("full", F.col("weight") * F.col("left") / F.col("open") >= ceiling)
    level = F.max(F.when(~F.col("full"), F.struct("left", "open")))  # the first open source has most left
    per = per.withColumn("level", level.over(Window.partitionBy()))
    share = F.col("weight") * F.col("level.left") / F.col("level.open")
    return per.select("source", "number", "source_size", "weight",
                      F.when(F.col("full") | F.col("level").isNull(), ceiling.cast("double"))
                      .otherwise(share).alias("target"))


def streams(sizes: DataFrame, goals: DataFrame) -> DataFrame:
    """sizes with number, source_size, target and offset: the words of the source's stream before a row."""
    named = goals.withColumnRenamed("source", "owner")
    rows = settle(sizes.join(named, F.col("source").eqNullSafe(F.col("owner"))).drop("owner")
                  .withColumn("bucket", F.substring("place", 1, BUCKET_HEX)), "sizes")
    sums = rows.groupBy("number", "bucket").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("number").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(sums.select("number", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")),
                    "starts")
    inside = (Window.partitionBy("number", "bucket").orderBy("place", "doc_id", "size", "key_a", "key_b")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.join(starts, ["number", "bucket"])
            .withColumn("offset", F.col("start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .drop("bucket", "start", "place"))


def schedule(goals: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """(slot, number, rank, words): slot of the mix, source, block of its stream, words it takes."""
    spark = goals.sparkSession
    quota = goals.where("target > 0").select(
        "number", F.round("target").cast("long").alias("goal"), "target",
        F.ceil(F.round("target") / block).cast("long").alias("blocks")).where("blocks > 0")
    run = Window.orderBy("number").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy()
    high = F.sum("target").over(run) / F.sum("target").over(whole)
    quota = settle(quota.withColumn("high", high), "quota")
    edges = quota.orderBy("number").select("number", "blocks", "high").collect()  # a row per source
    slots = sum(e["blocks"] for e in edges)
    highs, numbers = np.array([e["high"] for e in edges]), np.array([e["number"] for e in edges], np.int32)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            point = (ids.astype(np.uint64) * np.uint64(GOLDEN)).astype(np.float64) / 2.0**64
            at = np.minimum(np.searchsorted(highs, point, "right"), len(highs) - 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(numbers[at]), pa.array(ids // SLOT_CHUNK)], ["id", "number", "chunk"])

    drawn = spark.range(slots).mapInArrow(draw, "id long, number int, chunk long")
    counts = drawn.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = settle(counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))), "slots")
    inside = Window.partitionBy("number", "chunk").orderBy("id")
    ranked = (drawn.join(counts, ["number", "chunk"])
              .select("id", "number", (F.col("start") + F.row_number().over(inside) - 1).alias("rank")))
    reached = counts.groupBy("number").agg(F.sum("n").alias("drawn"))
    missing = (quota.join(reached, "number", "left")
               .withColumn("drawn", F.coalesce("drawn", F.lit(0))).where("drawn < blocks")
               .select("number", F.explode(F.sequence("drawn", F.col("blocks") - 1)).alias("rank")))
    tail = missing.select((F.lit(slots) + F.col("rank")).alias("id"), "number", "rank")
    return (ranked.unionByName(tail).join(quota.select("number", "goal", "blocks"), "number")
            .where("rank < blocks")
            .select(F.col("id").alias("slot"), "number", "rank",
                    F.least(F.lit(block), F.col("goal") - F.col("rank") * block).alias("words")))


def mix(docs: DataFrame, block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The rows' places in the streams, and the mix: (number, slot, offset, pass, first, words).

    A row of the mix is a run of words of the row at `offset` of source `number`, from word `first`.
    """
    sizes = sized(docs)
    goals = settle(targets(sizes), "targets")
    rows = settle(streams(sizes, goals), "streams")
    plan = schedule(goals, block)
    turns = rows.where("size > 0").select(
        "number", "offset", "size", F.explode(F.sequence(F.lit(0), F.lit(MOST_PASSES - 1))).alias("pass"),
        "source_size", "target").withColumn("pos", F.col("pass") * F.col("source_size") + F.col("offset"))
    pieces = turns.where(F.col("pos") < F.round("target")).withColumn(
        "rank", F.explode(F.sequence(F.expr(f"pos div {block}"), F.expr(f"(pos + size - 1) div {block}"))))
    begin = F.greatest("pos", F.col("rank") * block)
    end = F.least(F.col("pos") + F.col("size"), F.col("rank") * block + F.col("words"))
    taken = pieces.join(plan, ["number", "rank"]).where(end > begin).select(
        "number", "slot", "offset", "pass", (begin - F.col("pos")).alias("first"), (end - begin).alias("words"))
    return rows, settle(taken, "mix")


def taken_words(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target and taken per row."""
    rows, taken = mix(docs, block)
    per = taken.groupBy("number", "offset").agg(F.sum("words").alias("taken"))
    sure = F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0))
    return rows.join(per, ["number", "offset"], "left").select(
        "doc_id", "size", "source_size", "target", sure.cast("long").alias("taken"))


def some_words(text: Column, first: Column, n: Column) -> Column:
    """A run of words, joined by single spaces."""
    found = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return F.array_join(F.slice(found, (first + 1).cast("int"), n.cast("int")), " ")


def mixed_documents(docs: DataFrame, block: int = BLOCK_WORDS) -> DataFrame:
    """The mix as rows of documents: a row for each pass over a document, its text cut to the words
    that the pass takes. Wholly taken texts stay as they are. n_chars, if there, follows the text."""
    rows, taken = mix(docs, block)
    per = taken.groupBy("number", "offset", "pass").agg(F.min("first").alias("first"), F.sum("words").alias("words"))
    picked = (rows.where("size > 0").join(per, ["number", "offset"])
              .select("key_a", "key_b", "size", "first", "words"))
    inner = [c for c in docs.columns]
    keyed = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(inner)), *row_keys(docs))
    one = Window.partitionBy("key_a", "key_b").orderBy("key_a")  # equal rows: the mix has them already
    keyed = keyed.withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth")
    joined = keyed.join(picked, ["key_a", "key_b"])
    text = F.col(f"c{inner.index('text')}")
    cut = F.when(F.col("words") == F.col("size"), text).otherwise(some_words(text, F.col("first"), F.col("words")))
    joined = joined.withColumn("cut", cut)
    out = {c: F.col(f"c{i}") for i, c in enumerate(inner)} | {"text": F.col("cut")}
    if "n_chars" in out:
        out["n_chars"] = F.length("cut").cast(docs.schema["n_chars"].dataType)
    return joined.select(*(v.alias(k) for k, v in out.items()))
