"""State changes between two snapshots of a record table, over many windows at once.

A snapshot set is a table (snap_ts, label, row_no, fields...), partitioned by snap_ts.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace import fixed_values as fv
from millrace.functions.identity import name_key
from millrace.functions.rules import state_bits
from millrace.session import settle

COUNTED = ["new", "cv", "nr", "adv", "rej"]


def catalogue(snapshots: DataFrame) -> DataFrame:
    """One row per snapshot. Reads partition values only when the set is partitioned by them."""
    return snapshots.select("snap_ts", "label").distinct()


def expired(snapshots: DataFrame, as_of, days: int = fv.KEEP_SNAPSHOT_DAYS) -> DataFrame:
    """The catalogue with a flag for snapshots older than the retention time."""
    edge = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return catalogue(snapshots).withColumn("expired", F.col("snap_ts") < edge)


def latest_before(cutoffs: DataFrame, snaps: DataFrame, cutoff: str) -> DataFrame:
    """Backward as-of join: adds `snap`, the last (snap_ts, label) strictly before the cutoff.

    Both sides are put in time order within each hour, so no pairs are formed. Where the hour
    has no earlier snapshot, the last one of any former hour is carried along the list of
    hours, which has one row per hour of the data. Of equal times the later label counts.
    """
    hour = F.date_trunc("hour", "at")
    marks = snaps.groupBy(F.col("snap_ts").alias("at")).agg(F.max("label").alias("label")).select(
        "at", F.lit(1).alias("kind"), F.struct(F.col("at").alias("snap_ts"), "label").alias("snap"))
    points = cutoffs.select(F.col(cutoff).alias("at")).distinct().select(
        "at", F.lit(0).alias("kind"), F.lit(None).cast(marks.schema["snap"].dataType).alias("snap"))
    timeline = marks.unionByName(points).withColumn("hour", hour)
    hours = timeline.groupBy("hour").agg(F.max("snap").alias("last"))
    former = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = hours.select("hour", F.max("last").over(former).alias("carried"))
    so_far = Window.partitionBy("hour").orderBy("at", "kind")  # a cutoff precedes its equal
    found = (timeline.withColumn("here", F.max("snap").over(so_far)).where("kind = 0")
             .join(carried, "hour")
             .select(F.col("at").alias(cutoff), F.coalesce("here", "carried").alias("snap")))
    return cutoffs.join(found, cutoff, "left")


def report_windows(reports: DataFrame, snaps: DataFrame, label: str | None = None) -> DataFrame:
    """Per report time the two windows with their newer and older snapshot.

    `yesterday` runs from the last snapshot before yesterday to the last one before today and
    is void if both are the same or one is missing. `week` runs from the last snapshot at
    least seven days back (or the very first one) to the last one up to the report time, of any
    label or of the given one.
    """
    midnight = F.date_trunc("day", "report_ts").cast("timestamp_ntz")
    day = F.make_dt_interval(F.lit(1))
    cutoffs = reports.select("report_ts", F.explode(F.array(
        F.struct(F.lit("end").alias("kind"), midnight.alias("cutoff")),
        F.struct(F.lit("start").alias("kind"), (midnight - day).alias("cutoff")),
        F.struct(F.lit("week").alias("kind"),
                 (F.col("report_ts") - F.make_dt_interval(F.lit(7))).alias("cutoff")))).alias("c")) \
        .select("report_ts", "c.kind", "c.cutoff")
    found = latest_before(cutoffs, snaps, "cutoff").groupBy("report_ts").agg(*[
        F.max(F.when(F.col("kind") == k, F.col("snap"))).alias(k)
        for k in ("end", "start", "week")])
    first = snaps.agg(F.min(F.struct("snap_ts", "label")).alias("first")).scalar()
    week = F.coalesce("week", first)
    up_to = reports.select("report_ts", (F.col("report_ts") + F.expr("INTERVAL 0.000001 SECOND")).alias("cutoff"))
    current = latest_before(up_to, snaps if label is None else snaps.where(F.col("label") == label), "cutoff")
    found = found.join(current.select("report_ts", F.col("snap").alias("now")), "report_ts", "left")
    whole = F.col("end").isNotNull() & F.col("start").isNotNull() & (F.col("end") != F.col("start"))
    return found.select("report_ts", F.explode(F.array(
        F.struct(F.lit("yesterday").alias("window"), F.when(whole, F.col("end")).alias("newer"),
                 F.when(whole, F.col("start")).alias("older"), F.col("end").alias("shown")),
        F.struct(F.lit("week").alias("window"), F.when(week.isNotNull(), F.col("now")).alias("newer"),
                 week.alias("older"), week.alias("shown")))).alias("w")) \
        .select("report_ts", "w.*")


def needed_by(reports: DataFrame, snaps: DataFrame, label: str | None = None) -> DataFrame:
    """The snapshots (snap_ts, label) that the windows of some reports begin and end with."""
    windows = report_windows(reports, snaps, label)
    return windows.select(F.explode(F.array_compact(F.array("newer", "older", "shown"))).alias("s")).select("s.*").distinct()


def window_label() -> Column:
    """The heading of a window, from report_ts and the snapshot it shows."""
    shown = F.col("shown.snap_ts")
    date = F.date_format(shown, "dd/MM")
    days = F.timestamp_diff("DAY", shown, F.col("report_ts"))
    yesterday = F.to_date(shown) == F.date_sub(F.to_date("report_ts"), 1)
    return (F.when(shown.isNull(), fv.WINDOW_NONE)
            .when((F.col("window") == "yesterday") & yesterday, fv.WINDOW_YESTERDAY)
            .when(F.col("window") == "yesterday", F.concat(F.lit(fv.WINDOW_UP_TO), date))
            .when(days.between(6, 8), fv.WINDOW_WEEK)
            .otherwise(F.concat(F.lit(fv.WINDOW_SINCE), date)))


def folded_states(snapshots: DataFrame, snaps: DataFrame, ignored: Iterable[str]) -> DataFrame:
    """The wanted snapshots, folded to (snap, name_key, bits, n, last_row).

    At most sixteen rows remain per snapshot and key, so a key with many rows weighs nothing
    in later joins. Unwanted snapshots are pruned by their partition where there is one.
    """
    wanted = snapshots.join(snaps, ["snap_ts", "label"], "left_semi")
    return (wanted.select(F.struct("snap_ts", "label").alias("snap"), "row_no",
                          name_key(F.col("company"), F.col("title"), ignored).alias("name_key"),
                          state_bits().alias("bits"))
            .groupBy("snap", "name_key", "bits")
            .agg(F.count("*").alias("n"), F.max("row_no").alias("last_row")))


def up_to_now(windows: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The windows, the week's ending with the live table: the last state the set has up to the report time, whether it
    is in the catalogue the windows were made from or not."""
    behind = windows.where((F.col("window") == "week") & (F.col("newer.snap_ts") < F.col("report_ts")))
    if behind.isEmpty():
        return windows
    up_to = behind.select("report_ts", (F.col("report_ts") + F.expr("INTERVAL 0.000001 SECOND")).alias("cutoff"))
    live = latest_before(up_to, catalogue(snapshots), "cutoff").select("report_ts", F.lit("week").alias("window"),
                                                                       F.col("snap").alias("live"))
    return windows.join(live, ["report_ts", "window"], "left").withColumn(
        "newer", F.when(F.col("newer").isNotNull(), F.greatest("newer", F.coalesce("live", "newer")))).drop("live")


def transition_counts(windows: DataFrame, snapshots: DataFrame,
                      ignored: Iterable[str]) -> DataFrame:
    """Transitions per (report_ts, window). Of several older rows with one key the last counts;
    every newer row counts. `sweep.transition_counts` gives the same from a history of changes."""
    windows = settle(up_to_now(settle(windows, "windows"), snapshots), "windows")
    real = windows.where("newer is not null and older is not null")
    snaps = real.select("newer.*").union(real.select("older.*")).distinct()
    # Dealt by key once: a key has at most sixteen rows per snapshot here. All that follows up to the counts stays where it is.
    states = folded_states(snapshots, snaps, ignored).repartition("name_key")
    ends = real.select("report_ts", "window", F.explode(F.array(
        F.struct(F.col("newer").alias("snap"), F.lit(True).alias("is_newer")),
        F.struct(F.col("older").alias("snap"), F.lit(False).alias("is_newer")))).alias("e")).select("report_ts", "window", "e.*")
    new, old = F.col("is_newer"), ~F.col("is_newer")
    has = lambda bit: F.col("bits").bitwiseAND(bit) != 0
    pairs = states.join(ends, "snap").groupBy("name_key", "report_ts", "window").agg(
        F.max_by("bits", F.when(old, F.col("last_row"))).alias("old_bits"), F.sum(F.when(new, F.col("n")).otherwise(0)).alias("n"),
        *[F.sum(F.when(new & has(bit), F.col("n")).otherwise(0)).alias(f"n{bit}") for bit in (1, 2, 4, 8)])

    def gained(bit: int) -> Column:
        had = F.coalesce(F.col("old_bits"), F.lit(0)).bitwiseAND(bit) != 0
        return F.sum(F.when(~had, F.col(f"n{bit}")).otherwise(0))

    counts = pairs.groupBy("report_ts", "window").agg(
        F.sum(F.when(F.col("old_bits").isNull(), F.col("n")).otherwise(0)).alias("new"),
        gained(1).alias("cv"), gained(2).alias("nr"), gained(4).alias("adv"),
        gained(8).alias("rej"))
    void = F.col("newer").isNull() | F.col("older").isNull()
    return windows.join(counts, ["report_ts", "window"], "left").select(
        "report_ts", "window", "shown",
        *[F.when(~void, F.coalesce(F.col(c), F.lit(0))).alias(c) for c in COUNTED])


def report_lines(counts: DataFrame, mail: DataFrame) -> DataFrame:
    """Seven rows of three columns per report: the heading, five counts and the mail row.

    `mail` holds (report_ts, window, given, previous): counts given this time and the text
    shown last time, which stays if none is given.
    """
    keys = ["cv", "nr", "new", "adv", "rej"]
    full = counts.join(mail, ["report_ts", "window"], "left")
    shown = [F.struct(F.lit(0).alias("line"), F.lit(fv.REPORT_HEADING).alias("metric"),
                      window_label().alias("value"))]
    shown += [F.struct(F.lit(n + 1).alias("line"), F.lit(fv.ACTIVITY_LABELS[k]).alias("metric"),
                       F.coalesce(F.col(k).cast("string"), F.lit(fv.WINDOW_NONE)).alias("value"))
              for n, k in enumerate(keys)]
    kept = F.when(F.col("previous") != "", F.col("previous"))
    shown.append(F.struct(F.lit(6).alias("line"), F.lit(fv.ACTIVITY_LABELS["mail"]).alias("metric"),
                          F.coalesce(F.col("given").cast("string"), kept,
                                     F.lit(fv.WINDOW_NONE)).alias("value")))
    return (full.select("report_ts", "window", F.explode(F.array(*shown)).alias("l"))
            .groupBy("report_ts", "l.line", "l.metric").pivot("window", ["yesterday", "week"])
            .agg(F.first("l.value")))
