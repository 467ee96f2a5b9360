"""Joins that stay even when one key holds a large share of the left side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import settle

# A key is hot from this many rows on; each of its salts takes about this many. A frame of n rows has
# at most n / HOT_ROWS hot keys, which bounds what is sent to the tasks.
HOT_ROWS = 1_000_000


def hot_keys(left: DataFrame, on: list[str], hot_rows: int | None = None) -> DataFrame:
    """The hot keys of a frame with their number of salts, from one narrow pass that combines early."""
    return hottest(left.groupBy(*on).agg(F.count("*").alias("n")), hot_rows)


def hottest(counts: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Same, from counts (keys and n) that the caller has already."""
    hot_rows = hot_rows or HOT_ROWS
    salts = F.ceil(F.col("n") / hot_rows).cast("int")
    return settle(counts.where(F.col("n") >= hot_rows).withColumn("salts", salts).drop("n"), "hot")


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str, spread: list[str],
                hot: DataFrame | None = None, hot_rows: int | None = None) -> DataFrame:
    """Join on equal keys where any left key may be hot and right keys are unique.

    Rows of a hot left key are spread over several salts by the columns in `spread`, and
    the one right row of that key is repeated per salt; all other keys are joined as they
    are. Works for the join kinds that keep or test left rows.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join kind {how}")
    if hot is None:
        hot = hot_keys(left, on, hot_rows)
    if hot.isEmpty():
        return left.join(right, on, how)
    known = F.broadcast(hot)  # at most one key per HOT_ROWS rows
    salts = F.coalesce("salts", F.lit(1))
    salted_left = left.join(known, on, "left").withColumn(
        "salt", F.pmod(F.xxhash64(*spread), salts).cast("int")).drop("salts")
    salted_right = right.join(known, on, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    joined = salted_left.join(salted_right, on + ["salt"], how).drop("salt")
    return joined.select(left.join(right.limit(0), on, how).columns)
