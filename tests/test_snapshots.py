from datetime import datetime as dt

from pyspark.sql import functions as F

from millrace.functions.text import stop_words
from millrace.operators import diff
from millrace.sources import snapshots as source

WORDS = stop_words()


def snaps(spark, *stamps):
    return spark.createDataFrame([(dt.fromisoformat(s), label) for s, label in stamps],
                                 "snap_ts timestamp_ntz, label string")


def reports(spark, *stamps):
    return spark.createDataFrame([(dt.fromisoformat(s),) for s in stamps], "report_ts timestamp_ntz")


def test_names(spark):
    names = ["2024-01-05-0930-baseline.json", "2024-1-5-0930.json", "2024-01-05-09x0-a.json",
             "notes.json", "2024-13-05-0930-a.json", "2024-01-05-0930-before-upsert.json",
             "2024-01-05-0930-a.txt", "2024-01-05-093-a.json"]
    got = source.parsed_names(spark.createDataFrame([(n,) for n in names], "file_name string"))
    assert {(r["file_name"], str(r["snap_ts"]), r["label"]) for r in got.collect()} == {
        (names[0], "2024-01-05 09:30:00", "baseline"), (names[1], "2024-01-05 09:30:00", ""),
        (names[5], "2024-01-05 09:30:00", "before-upsert"), (names[7], "2024-01-05 09:03:00", "a")}


def test_asof_is_strict_and_ties_go_to_the_later_label(spark):
    s = snaps(spark, ("2024-01-05T10:00", "a"), ("2024-01-05T10:00", "b"), ("2024-01-01T00:00", "c"))
    cut = spark.createDataFrame([(dt(2024, 1, 5, 10),), (dt(2024, 1, 5, 10, 1),), (dt(2024, 1, 9),),
                                 (dt(2023, 1, 1),)], "cut timestamp_ntz")
    got = {str(r["cut"]): r["snap"] and r["snap"]["label"]
           for r in diff.latest_before(cut, s, "cut").collect()}
    assert got == {"2024-01-05 10:00:00": "c", "2024-01-05 10:01:00": "b", "2024-01-09 00:00:00": "b",
                   "2023-01-01 00:00:00": None}


def heads(spark, s, *at):
    rows = diff.report_windows(reports(spark, *at), s).withColumn("head", diff.window_label()).collect()
    return {(r["window"], str(r["report_ts"])[:10]): (r["head"], r["newer"] is not None,
                                                      r["older"] is not None) for r in rows}


def test_window_labels(spark):
    s = snaps(spark, ("2024-01-01T23:55", "a"), ("2024-01-08T23:55", "a"), ("2024-01-09T23:55", "a"))
    got = heads(spark, s, "2024-01-10T12:00", "2024-01-12T12:00", "2024-01-03T12:00")
    assert got[("yesterday", "2024-01-10")] == ("Yesterday", True, True)
    # Both ends of the day are the same snapshot: nothing to compare.
    assert got[("yesterday", "2024-01-12")] == ("Up to 09/01", False, False)
    assert got[("yesterday", "2024-01-03")][1:] == (False, False)
    assert got[("week", "2024-01-10")] == ("Last 7 days", True, True)
    assert got[("week", "2024-01-12")] == ("Since 01/01", True, True)
    assert got[("week", "2024-01-03")] == ("Since 01/01", True, True)
    assert heads(spark, s.limit(0), "2024-01-10T12:00")[("week", "2024-01-10")] == ("—", False, False)


def test_transitions(spark):
    rows = [("2024-01-01T23:55", 2, "A", "x", "", "📤 Applied"), ("2024-01-01T23:55", 3, "a", "X", "", ""),
            ("2024-01-01T23:55", 4, "B", "y", "✅ Applied", "📞 Screening"),
            ("2024-01-10T12:00", 2, "A", "x", "", "📤 Applied"),
            ("2024-01-10T12:00", 3, "A", "x", "", "📤 Applied"),
            ("2024-01-10T12:00", 4, "B", "y", "❌ Not Relevant", "❌ Rejected"),
            ("2024-01-10T12:00", 5, "C", "z", "", "📤 Applied")]
    table = spark.createDataFrame(
        [(dt.fromisoformat(r[0]), "baseline", *r[1:]) for r in rows],
        "snap_ts timestamp_ntz, label string, row_no long, company string, title string, "
        "move string, stage string")
    windows = diff.report_windows(reports(spark, "2024-01-10T12:00"),
                                  snaps(spark, ("2024-01-01T23:55", "baseline")))
    counts = diff.transition_counts(windows, table, WORDS)
    week = counts.where("window = 'week'").first()
    # The older copy of A that counts is the last one, which had not applied.
    assert [week[c] for c in diff.COUNTED] == [1, 3, 1, 0, 1]
    day = counts.where("window = 'yesterday'").first()
    assert [day[c] for c in diff.COUNTED] == [None] * 5
    mail = spark.createDataFrame([(dt(2024, 1, 10, 12), "week", None, "7"),
                                  (dt(2024, 1, 10, 12), "yesterday", None, "")],
                                 "report_ts timestamp_ntz, window string, given long, previous string")
    lines = diff.report_lines(counts, mail).orderBy("line").collect()
    assert [(r["yesterday"], r["week"]) for r in lines] == [
        ("Up to 01/01", "Last 7 days"), ("—", "3"), ("—", "1"), ("—", "1"), ("—", "0"), ("—", "1"),
        ("—", "7")]


def test_written_snapshots_come_back_and_repeat_safely(spark, tmp_path):
    from millrace.operators.scan import read_records
    table = read_records(spark.createDataFrame([(2, "A", "x"), (3, "B", "y")],
                                               "row_no long, company string, title string"))
    folder = str(tmp_path / "set")
    for _ in range(2):
        source.write_snapshot(table, folder, "2024-01-05 09:30:40", "baseline")
    source.write_snapshot(table.where("row_no = 2"), folder, "2023-12-01 09:00:00", "old")
    got = source.read_snapshots(spark, folder)
    assert got.count() == 3
    kept = {r["label"]: r["expired"] for r in diff.expired(got, "2024-01-20 00:00:00").collect()}
    assert kept == {"baseline": False, "old": True}
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "2024-01-05-0930-x.json").write_text('[{"company": "A"}, {"title": "t"}]')
    (tmp_path / "files" / "other.json").write_text('[{"company": "no"}]')
    rows = source.read_files(spark, str(tmp_path / "files")).collect()
    assert {(str(r["snap_ts"]), r["label"], r["company"]) for r in rows} == {
        ("2024-01-05 09:30:00", "x", "A"), ("2024-01-05 09:30:00", "x", None)}


def test_a_report_at_any_time_takes_the_last_state(spark):
    s = snaps(spark, ("2024-01-01T12:00", "baseline"), ("2024-01-20T12:00", "baseline"), ("2024-01-20T12:10", "z"))
    rows = diff.report_windows(reports(spark, "2024-01-20T12:00", "2024-01-20T12:30"), s, "baseline").where(
        "window = 'week'").collect()
    assert [str(r["newer"]["snap_ts"]) for r in rows] == ["2024-01-20 12:00:00"] * 2
    free = diff.report_windows(reports(spark, "2024-01-20T12:30"), s).where("window = 'week'").first()
    assert free["newer"]["label"] == "z"


def test_pruning_keeps_what_reports_need(spark, tmp_path):
    from millrace.operators.scan import read_records
    folder = str(tmp_path / "set")
    days = ["2024-01-01", "2024-01-02", "2024-01-09", "2024-01-10", "2024-01-20"]
    for n, day in enumerate(days):
        table = read_records(spark.createDataFrame([(i, "A", str(i), "📤 Applied" if i <= n else "") for i in range(6)],
                                                   "row_no long, company string, title string, stage string"))
        source.write_snapshot(table, folder, f"{day} 23:55:00", "baseline")
    at = reports(spark, "2024-01-21T12:00", "2024-01-10T12:00")

    def counts():
        got = source.read_snapshots(spark, folder)
        rows = diff.transition_counts(diff.report_windows(at, diff.catalogue(got)), got, WORDS)
        return sorted(map(str, rows.collect()))

    before = counts()
    needed = diff.needed_by(at, diff.catalogue(source.read_snapshots(spark, folder)))
    gone = [str(r["snap_ts"])[:10] for r in source.prune(spark, folder, "2024-01-21 12:00:00", 5, needed).collect()]
    assert gone == ["2024-01-02"] and counts() == before
    assert len(list((tmp_path / "set").glob("snap_ts=*"))) == 4
    assert source.prune(spark, folder, "2024-01-21 12:00:00", 5, needed).count() == 0


def test_states_are_dealt_by_key_once_and_never_joined(spark):
    rows = [(t, "baseline", n, "A", str(n % 2), "", "📤 Applied" if t > "2024-01-03" and n else "")
            for t in ("2024-01-02 23:55:00", "2024-01-09 23:55:00") for n in range(4 if t < "2024-01-03" else 5)]
    snaps = spark.createDataFrame(rows, "t string, label string, row_no long, company string, title string, move string, stage string")
    snaps = snaps.withColumn("snap_ts", F.col("t").cast("timestamp_ntz")).drop("t")
    windows = diff.report_windows(reports(spark, "2024-01-10T12:00"), diff.catalogue(snaps))
    counts = diff.transition_counts(windows, snaps, WORDS)
    got = {r["window"]: (r["new"], r["cv"]) for r in counts.collect()}
    assert set(got.values()) == {(0, 4)}
    plan = counts._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x and "name_key" in x]
    assert len(dealt) == 2 and not any("SortMergeJoin" in x and "name_key" in x for x in plan.splitlines())
