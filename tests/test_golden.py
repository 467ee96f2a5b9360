"""Single values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import identity, rules, text
from millrace.operators import merge, rank, scan

WORDS = text.stop_words(["Berlin"])


def values(spark, column, inputs):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(inputs)], "n long, x string")
    return [r[0] for r in df.orderBy("n").select(column(F.col("x"))).collect()]


def test_names(spark):
    got = values(spark, lambda x: text.plain_name(x, WORDS), [
        "QA Engineer (Berlin)", "QA Engineer - Hybrid", "The A of", "Über_Größe №7", None,
        "a (b\nc) d", "東京🎉 Remote", "x(y", "l’été"])
    assert got == ["qa engineer", "qa engineer", "", "über größe 7", "", "d", "東京", "x y", "l été"]


LINKS = {
    "https://A.com/x/?b=2&jk=Z": "a.com/x?jk=Z",
    "https://m.com/ls/click?upn=1": None,
    "http://a.com/p?jk=": None,
    "https://a.com/p?": "a.com/p",
    "HTTP://Up.com/x": "up.com/x",
    "https://a.com/?REQ_ID=b&jid=a": "a.com?req_id=b&jid=a",
    "https://a.com/p///": "a.com/p",
    "https://a.com/p?position=a+b%20c%zz": "a.com/p?position=a b c%zz",
    "https://a.com/a b?gh_jid=1#frag": "a.com/a b?gh_jid=1",
    "ftp://a.com/x": None, "mailto:x": None, "": None, "https:///x": None,
    "  https://a.com/x \n": "a.com/x",
    "https://a.com/x?JK=1&jk=2": "a.com/x?jk=1&jk=2",
    "https://a.com/x?xjk=1": None,
    "https://a.com/é?vacancy=%C3%A9": "a.com/é?vacancy=é",
    "https://a.com/x?jk=1=2&&job": "a.com/x?jk=1=2",
    "//a.com/x": None,
}


def test_links(spark):
    assert values(spark, identity.link_reference, LINKS) == list(LINKS.values())


def test_numbers_and_blanks(spark):
    assert values(spark, text.long_numbers, ["a1234567b 12345 123456", "١٢٣٤٥٦", None]) == [
        ["1234567", "123456"], ["١٢٣٤٥٦"], []]
    assert values(spark, text.strip, ["\x1c  a b \n", "\t", ""]) == ["a b", "", ""]


def test_valid_link_is_case_sensitive(spark):
    assert values(spark, identity.valid_link, ["http://x", " https://x", "HTTP://x", "Apply", None]) \
        == [True, True, False, False, False]


def test_line_kinds_and_direction(spark):
    assert values(spark, text.line_kind, ["", " \t", "=====", "──—__ ", "====", "## head", " ## x",
                                          "## ", "- a", "  • b", "*c", "text"]) == [
        "blank", "blank", "rule", "rule", "text", "heading", "text", "text", "bullet", "bullet",
        "bullet", "text"]
    counts = lambda x: F.struct(*text.script_counts(x))
    assert [tuple(r) for r in values(spark, counts, ["שלום abc", "12", "abc"])] == [
        (4, 3), (0, 0), (0, 3)]


def test_padding_never_cuts(spark):
    assert values(spark, lambda x: text.pad_to(x, 4), ["ab", "abcdef"]) == ["ab  ", "abcdef"]


PRIORITY = [
    ({"stage": "🎤 Interview", "move": "❌ Not Relevant"}, 9.1),
    ({"stage": "❌ Rejected", "move": "✅ Applied"}, 9.1),
    ({"stage": "🎉 Offer", "location": "Nation_1"}, 1.0),
    ({"move": "🙋 Reach Out", "stage": "❌ Rejected"}, 2.1),
    ({"move": "✅ Applied"}, 3.1), ({"stage": "📤 Applied"}, 3.1),
    ({"fit": "🟢 Strong"}, 4.1), ({"fit": "🟡 Good Shot"}, 5.1), ({"fit": "🔴 Stretch"}, 6.1)]


def board(spark, rows):
    names = list(scan.FIELDS)
    return spark.createDataFrame(
        [(n + 2, *[r.get(k, "") for k in names]) for n, r in enumerate(rows)],
        "row_no long, " + ", ".join(f"`{n}` string" for n in names))


def test_priority(spark):
    table = board(spark, [r for r, _ in PRIORITY])
    got = rank.with_priority(table, " Nation_1 ").orderBy("row_no").collect()
    assert [r["priority"] for r in got] == [p for _, p in PRIORITY]
    order = [r["row_no"] for r in rank.ranked(table, "").collect()]
    assert order == [4, 5, 6, 7, 8, 9, 10, 2, 3]


def test_display_order(spark):
    rows = [{"notes": "⚠️ For Review — x", "move": "Not Relevant"}, {"stage": "No Response"},
            {"stage": "🎯 Action Required", "move": "To Apply"}, {"stage": "📞 Screening"},
            {"move": "📝 Tailor CV"}, {"fit": "🟡"}, {}]
    got = board(spark, rows).orderBy("row_no").select(rules.display_class()).collect()
    assert [r[0] for r in got] == ["review", "greyed", "action", "active", "marked", "yellow", "plain"]


def test_scan_drops_only_empty_rows(spark):
    df = spark.createDataFrame([(2, None, "t"), (3, "", None), (4, "c", "")],
                               "row_no long, company string, title string")
    got = scan.keyed_records(df, WORDS).orderBy("_row").collect()
    assert [(r["_row"], r["_key"], r["link"]) for r in got] == [(2, "|t", ""), (4, "c|", "")]


FLAGGED = [("a | ⚠️ For Review — x | b", "a | b | ⚠️ For Review — y"), ("", "⚠️ For Review — y"),
           ("⚠️ For Review — x", "⚠️ For Review — y"), ("a |  | b", "a |  | b | ⚠️ For Review — y")]


def test_flags(spark):
    assert values(spark, lambda x: rules.merged_flag(x, F.lit("y")), [a for a, _ in FLAGGED]) == [
        b for _, b in FLAGGED]


PROCESS = [  # old, direct, append, new
    ("", "p", None, "p"), ("p", "q", None, "p\n\nq"), ("p q", None, "q", "p q"),
    ("", "d", "a", "a"), ("p", "d", "a", "p\n\na\nd"), (" \n", None, "x", "x"), ("p", None, " ", "p"),
    ("p  ", None, "x", "p\n\nx")]


@pytest.mark.parametrize("strict", [False, True])
def test_process_cell(spark, strict):
    table = board(spark, [{"company": f"c{n}", "title": "t", "process": p[0]}
                          for n, p in enumerate(PROCESS)])
    items = [(n, {k: v for k, v in {"company": f"c{n}", "title": "t", "process": d,
                                    "process_append": a, "move": "m"}.items() if v is not None})
             for n, (_, d, a, _) in enumerate(PROCESS)]
    df = spark.createDataFrame(items, "ord long, fields map<string,string>")
    hits = merge.target_rows(table, df, WORDS)
    after = merge.apply_changes(table, merge.update_changes(hits, strict=strict), hits,
                                "2024-01-31 12:00:00").orderBy("row_no").collect()
    assert [r["process"] for r in after] == [p[3] for p in PROCESS]
    assert {r["move"] for r in after} == {"" if strict else "m"}


def test_first_row_of_a_key_is_the_target_and_the_last_append_wins(spark):
    table = board(spark, [{"company": "A", "title": "x"}, {"company": "the a", "title": "X"}])
    df = spark.createDataFrame(
        [(1, {"company": "a", "title": "x", "process_append": "one"}),
         (2, {"company": "a", "title": "x", "process_append": "two"}),
         (3, {"company": "nobody", "title": "x"})], "ord long, fields map<string,string>")
    hits = merge.target_rows(table, df, WORDS)
    changes = merge.update_changes(hits)
    after = {r["row_no"]: r for r in merge.apply_changes(table, changes, hits, "2024-01-31").collect()}
    assert (after[2]["process"], after[3]["process"], after[3]["updated"]) == ("two", "", "")
    assert [r["lost"] for r in merge.lost_appends(changes).collect()] == [1]
    missing = merge.missing_items(merge.match_items(table, df, WORDS)).collect()
    assert [r["line"] for r in missing] == ["nobody — x"]
