"""Transitions over many windows in one pass over changes.

A key's state at any time is the number of its rows, how many of them have each tracked state, and the states of its last
row. It changes only where a row version of that key begins or ends. What a key counts for a window depends on its states
at both ends alone; a key that does not change inside the window counts what it counts against itself. The sum of the
latter over all keys is kept running over the snapshots, and a window corrects it by the keys that changed in it. So
states are never joined with states, and a window costs what changed in it.

The right end of a window may be the live table, which no snapshot holds: it counts as a snapshot after all others.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.identity import name_key
from millrace.functions.rules import state_bits
from millrace.session import settle
from millrace.sources.history import changed

BITS = {"cv": 1, "nr": 2, "adv": 4, "rej": 8}
COUNTED = ["new", *BITS]


def live_time() -> Column:
    """When the live table counts: after every snapshot."""
    return F.struct(F.lit("9999-12-31 00:00:00").cast("timestamp_ntz").alias("snap_ts"), F.lit("live").alias("label"))


def with_live(events: DataFrame, live: DataFrame, fields: list[str]) -> DataFrame:
    """events (row_no, fields, gone, at) and those that lead to the live table."""
    last = events.groupBy("row_no").agg(F.max_by(F.struct("gone", *fields), "at").alias("e"))
    before = last.select("row_no", "e.*").where("NOT gone")
    return events.unionByName(changed(before, live, fields).withColumn("at", live_time()))


def tracked(intervals: DataFrame, ignored: Iterable[str]) -> DataFrame:
    """(name_key, row_no, bits, valid_from, valid_to) of row versions; versions that follow each other alike stay apart."""
    return intervals.select(name_key(F.col("company"), F.col("title"), ignored).alias("name_key"), "row_no",
                            state_bits().alias("bits"), "valid_from", "valid_to")


def _against(bits: Column, state: Column) -> list[Column]:
    """What the rows of a state count against a last row with the given bits, null if there is none."""
    return [F.when(bits.isNull(), state["n"]).otherwise(0)] + [
        F.when(F.coalesce(bits, F.lit(0)).bitwiseAND(b) == 0, state[c]).otherwise(0) for c, b in BITS.items()]


def key_versions(versions: DataFrame) -> DataFrame:
    """(name_key, at, state, was): the state of each key from each change on, and before it; was is null at first.

    Row versions are folded to a row per key and snapshot before anything is put in order, so a key with many rows has
    no more of them than there are snapshots. The last row is the running maximum of row numbers; where that row has left
    the key meanwhile, the last of the versions that hold is looked up.
    """
    has = lambda b, d: F.when(F.col("bits").bitwiseAND(b) != 0, d).otherwise(0)
    begin = versions.select("name_key", F.col("valid_from").alias("at"), "bits", F.lit(1).alias("d"),
                            F.struct("row_no", "valid_from", "bits", "valid_to").alias("row"))
    end = versions.where("valid_to IS NOT NULL").select(
        "name_key", F.col("valid_to").alias("at"), "bits", F.lit(-1).alias("d"),
        F.lit(None).cast(begin.schema["row"].dataType).alias("row"))
    folded = begin.unionByName(end).groupBy("name_key", "at").agg(
        F.sum("d").alias("n"), *[F.sum(has(b, F.col("d"))).alias(c) for c, b in BITS.items()], F.max("row").alias("row"))
    so_far = Window.partitionBy("name_key").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    running = settle(folded.select("name_key", "at", *[F.sum(c).over(so_far).alias(c) for c in ["n", *BITS]],
                                   F.max("row").over(so_far).alias("row")), "key-states")
    left = F.col("row.valid_to").isNotNull() & (F.col("row.valid_to") <= F.col("at")) & (F.col("n") > 0)
    asked = running.where(left).select("name_key", "at")
    found = (asked.join(versions, "name_key")
             .where((F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to"))))
             .groupBy("name_key", "at").agg(F.max_by("bits", "row_no").alias("found")))
    last = F.when(F.col("n") > 0, F.coalesce("found", "row.bits"))
    state = F.struct(last.alias("last"), "n", *BITS)
    per_key = Window.partitionBy("name_key").orderBy("at")
    return (running.join(found, ["name_key", "at"], "left").select("name_key", "at", state.alias("state"))
            .withColumn("was", F.lag("state").over(per_key)))


def _still(versions: DataFrame, snaps: DataFrame) -> DataFrame:
    """(at, counts): per snapshot what all keys count against themselves, a running sum over snapshots."""
    now, was = F.col("state"), F.col("was")
    steps = versions.groupBy("at").agg(*[
        F.sum(a - F.coalesce(b, F.lit(0))).alias(c)
        for c, a, b in zip(COUNTED, _against(now["last"], now), _against(was["last"], was))])
    line = snaps.join(steps, "at", "left")
    so_far = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)  # a row per snapshot
    return line.select(F.col("at").alias("newer"), *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in COUNTED])


def transition_counts(windows: DataFrame, intervals: DataFrame, snaps: DataFrame, ignored: Iterable[str]) -> DataFrame:
    """Transitions per (report_ts, window), like diff.transition_counts, from the row versions of a history.

    snaps holds the times (snap_ts, label) of all snapshots, and that of the live table if a window ends with it.
    """
    windows = settle(windows, "windows")
    known = snaps.select(F.struct("snap_ts", "label").alias("at")).distinct()
    versions = settle(key_versions(settle(tracked(intervals, ignored), "tracked")), "key-versions")
    real = windows.where("newer IS NOT NULL AND older IS NOT NULL").select("report_ts", "window", "newer", "older")
    # A window meets the snapshots inside it by the day; the live table has a day of its own.
    day = lambda c: F.when(F.col(f"{c}.label") == "live", F.lit("9999-12-31").cast("date")).otherwise(F.to_date(f"{c}.snap_ts"))
    last = known.where("at.label <> 'live'").agg(F.max(day("at")).alias("day")).scalar()
    until = F.greatest(day("older"), F.least(day("newer"), last))
    days = real.withColumn("day", F.explode(F.array_distinct(F.concat(
        F.sequence(day("older"), until), F.array(day("newer"))))))
    # written, so that Spark knows how few they are and sends them, not the versions, to all tasks
    inside = settle(days.join(known.withColumn("day", day("at")), "day")
                    .where((F.col("older") < F.col("at")) & (F.col("at") <= F.col("newer")))
                    .select("report_ts", "window", "at"), "inside")
    moved = versions.join(inside, "at").groupBy("report_ts", "window", "name_key").agg(
        F.max_by("state", "at").alias("now"), F.min_by(F.struct("was"), "at")["was"].alias("before"))
    now, before = F.col("now"), F.col("before")
    fixed = moved.groupBy("report_ts", "window").agg(*[
        F.sum(a - b).alias(f"d_{c}") for c, a, b in zip(COUNTED, _against(before["last"], now), _against(now["last"], now))])
    counts = real.join(_still(versions, known), "newer", "left").join(fixed, ["report_ts", "window"], "left").select(
        "report_ts", "window", *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"d_{c}", F.lit(0))).alias(c) for c in COUNTED])
    return windows.join(counts, ["report_ts", "window"], "left").select("report_ts", "window", "shown", *COUNTED)
