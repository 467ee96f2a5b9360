"""Row versions and the sweep over them against full copies."""

import random
from datetime import datetime as dt
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import diff, sweep
from millrace.operators.scan import FIELDS, read_records
from millrace.sources import history

WORDS = ["berlin"]
STATES = ["company", "title", "move", "stage"]
MOVES, STAGES = ["", "✅ Applied", "❌ Not Relevant"], ["", "📤 Applied", "📞 Screening", "❌ Rejected"]


def life(seed, snaps=12, rows=25):
    """Full copies of a table that loses rows, gets them back, renames them and changes their states."""
    rng, now, copies = random.Random(seed), {}, []
    at = dt(2024, 1, 1, 9)
    for n in range(snaps):
        at += timedelta(hours=rng.choice([0, 3, 20, 40]) or 1)
        for _ in range(rng.randint(0, 8)):
            r = rng.randint(2, rows)
            if r in now and rng.random() < 0.25:
                del now[r]
            else:
                now[r] = (rng.choice("ABC"), rng.choice("xy"), rng.choice(MOVES), rng.choice(STAGES))
        copies += [(at, f"s{n % 3}", r, *v) for r, v in now.items()]
        if not now:
            now[2] = ("A", "x", "", "")
            copies.append((at, f"s{n % 3}", 2, *now[2]))
    return copies


def frame(spark, copies):
    return spark.createDataFrame(copies, "snap_ts timestamp_ntz, label string, row_no long, company string, title string, "
                                         "move string, stage string")


@pytest.mark.parametrize("seed", range(2))
def test_versions_give_every_former_copy(spark, seed):
    copies = life(seed)
    versions = history.intervals(history.events_of(frame(spark, copies), STATES)).collect()
    for at in sorted({c[:2] for c in copies}):
        held = {(v["row_no"], *(v[f] for f in STATES)) for v in versions
                if tuple(v["valid_from"]) <= at and (v["valid_to"] is None or at < tuple(v["valid_to"]))}
        assert held == {c[2:] for c in copies if c[:2] == at}
    assert len(versions) < len(copies) / 2


@pytest.mark.parametrize("seed", range(2))
def test_sweep_equals_states_joined_with_states(spark, seed):
    """All pairs of snapshots as windows, a window of a snapshot with itself, and windows that end with the live table."""
    copies = life(seed)
    table, times = frame(spark, copies), sorted({c[:2] for c in copies})
    live = [(r, "A" if r % 2 else "B", "x", MOVES[r % 3], STAGES[r % 4]) for r in range(2, 20)]
    far = (dt(9999, 12, 31), "live")
    whole = table.unionByName(frame(spark, [(*far, *r) for r in live]))
    pairs = [(a, b) for a in times for b in [*times, far] if a <= b]
    windows = spark.createDataFrame([(dt(2024, 2, 1) + timedelta(days=n), "w", b, a, a) for n, (a, b) in enumerate(pairs)],
                                    "report_ts timestamp_ntz, window string, newer struct<snap_ts:timestamp_ntz,label:string>, "
                                    "older struct<snap_ts:timestamp_ntz,label:string>, shown struct<snap_ts:timestamp_ntz,label:string>")
    events = sweep.with_live(history.events_of(table, STATES),
                             spark.createDataFrame(live, "row_no long, company string, title string, move string, stage string"), STATES)
    snaps = spark.createDataFrame([*times, far], "snap_ts timestamp_ntz, label string")
    got = {r["report_ts"]: [r[c] for c in sweep.COUNTED] for r in
           sweep.transition_counts(windows, history.intervals(events), snaps, WORDS).collect()}
    want = {r["report_ts"]: [r[c] for c in diff.COUNTED] for r in diff.transition_counts(windows, whole, WORDS).collect()}
    assert got == want and len(got) == len(pairs)


def broadcasts(frame):
    """The subtrees that a plan sends to all tasks, as lists of lines."""
    lines = frame._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    found = []
    for n, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = n + 1
            while below < len(lines) and depth(lines[below]) > depth(line):
                below += 1
            found.append(lines[n:below])
    return found


def test_snapshots_go_to_the_copies_not_copies_to_them(spark, tmp_path):
    """Copies that are small as files are many rows; what is sent to all tasks is a row per snapshot."""
    path = str(tmp_path / "copies")
    times = spark.createDataFrame([(dt(2024, 1, d), "baseline") for d in range(1, 6)], "snap_ts timestamp_ntz, label string")
    rows = spark.range(1000).select(F.col("id").alias("row_no"), *[F.lit("x").alias(f) for f in STATES])
    times.crossJoin(rows).write.parquet(path)
    copies = spark.read.parquet(path)
    events = history.events_of(copies, STATES)
    sent = broadcasts(events)
    assert sent and not any("row_no" in line for tree in sent for line in tree)
    assert events.count() == 1000


def test_windows_go_to_the_versions_not_versions_to_them(spark):
    pair = "struct<snap_ts:timestamp_ntz,label:string>"
    times = [(dt(2024, 1, d), "baseline") for d in range(1, 6)]
    windows = spark.createDataFrame([(dt(2024, 2, d), "w", times[d], times[0], times[0]) for d in range(1, 5)],
                                    f"report_ts timestamp_ntz, window string, newer {pair}, older {pair}, shown {pair}")
    versions = spark.range(5000).select(
        F.col("id").alias("row_no"), F.concat(F.lit("c"), "id").alias("company"), F.lit("t").alias("title"), F.lit("").alias("move"),
        F.lit("📤 Applied").alias("stage"),
        F.struct(F.lit("2024-01-02").cast("timestamp_ntz").alias("snap_ts"), F.lit("baseline").alias("label")).alias("valid_from"), F.lit(None).cast(pair).alias("valid_to"))
    counts = sweep.transition_counts(windows, versions, spark.createDataFrame(times, "snap_ts timestamp_ntz, label string"), WORDS)
    sent = broadcasts(counts)
    assert not any("name_key" in line for tree in sent for line in tree if "FileScan" in line)
    assert {tuple(r[c] for c in sweep.COUNTED) for r in counts.collect()} == {(5000, 5000, 0, 0, 0)}


def test_recorded_states_come_back(spark, tmp_path):
    def table(*rows):
        return read_records(spark.createDataFrame(list(rows), "row_no long, company string, title string, stage string"))

    kept = history.History(spark, str(tmp_path / "h"))
    assert kept.catalogue().count() == 0 and kept.state().count() == 0
    first, second = table((2, "A", "x", ""), (3, "B", "y", "")), table((2, "A", "x", "Offer"), (4, "C", "z", ""))
    kept.record(first, "2024-01-05 09:30:40", "before-1")
    kept.record(second, "2024-01-06 09:30:40", "before-2")
    kept.record(first, "2024-01-05 09:30:40", "before-1")  # a replay
    kept.record(second, "2024-01-06 10:00:00", "before-3")
    at = lambda time, label: F.struct(F.lit(time).cast("timestamp_ntz").alias("snap_ts"), F.lit(label).alias("label"))
    whole = lambda t: sorted(map(tuple, t.select("row_no", *FIELDS).collect()))
    assert whole(kept.state(at("2024-01-05 09:30:00", "before-1"))) == whole(first)
    assert whole(kept.state(at("2024-01-06 09:30:00", "before-2"))) == whole(kept.state()) == whole(second)
    assert whole(kept.state(before=at("2024-01-06 09:30:00", "before-2"))) == whole(first)
    assert kept.catalogue().count() == 3 and kept.events().count() == 2 + 3  # nothing for the third
    spark.range(1).select(F.lit(9).cast("long").alias("row_no"), *[F.lit("").alias(f) for f in FIELDS], F.lit(False).alias("gone"),
                          at("2024-01-07 00:00:00", "cut short").alias("at")).write.parquet(str(tmp_path / "h/events/broken"))
    assert whole(kept.state()) == whole(second)  # a snapshot counts once it is in the catalogue


def test_copies_of_a_history_are_built_once(spark):
    from millrace.plans.fixtures import Inputs
    from millrace.plans.queries import _history
    read = _history(Inputs(spark, "/root/testdata/sf0.001")).inputFiles()
    assert read and not any("/root/testdata" in f for f in read)
