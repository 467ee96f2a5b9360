"""The registered queries: each runs one operator over the whole derived inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import fixed_values as fv
from millrace.functions.identity import link_reference, name_key, with_identity
from millrace.functions.text import (line_kind, long_numbers, plain_name, present, script_counts,
                                     stop_words)
from millrace.operators import admit, diff, extract, link_rules, merge, rank, scan, sweep
from millrace.plans.fixtures import (AS_OF, HOME, INTAKE_AT, INTAKE_DAYS, MESSAGES, PLACES,
                                     Inputs, with_heads)
from millrace.session import scratch_path, settle
from millrace.sources import history, intents, ledger
from millrace.sources.snapshots import parsed_names
from millrace.sources.token_index import TokenIndex
from millrace.sources.versions import Versions
from millrace.streaming import intake

WORDS = stop_words(PLACES)
STAMP = "yyyy-MM-dd HH:mm:ss"
STATES = ["company", "title", "move", "stage"]


def text_of(column) -> Column:
    return F.date_format(column, STAMP)


# ---- identity ----------------------------------------------------------------------

def table_scan(x: Inputs) -> DataFrame:
    return scan.keyed_records(x.cells(), WORDS).select("_row", "_key", "company", "title",
                                                       "stage", "link")


def norm_profile(x: Inputs) -> DataFrame:
    name = plain_name(F.col("text"), WORDS)
    names = x.spread("documents").select("doc_id", name_key(
        F.col("lang"), F.col("source"), WORDS).alias("name_key"), name.alias("name"))
    return names.select("doc_id", "name_key", F.md5("name").alias("name_md5"),
                        F.length("name").cast("long").alias("n_chars"))


def digit_ids(x: Inputs) -> DataFrame:
    fields = x.spread("documents").select(
        F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("a"),
        F.col("source").alias("b")).unionByName(x.postings().select(
            F.concat(F.lit("p"), "ord").alias("id"), F.col("link").alias("a"),
            F.col("notes").alias("b")))
    return fields.select("id", F.array_join(F.array_sort(
        long_numbers(F.col("a"), F.col("b"))), " ").alias("numbers"))


def link_identity(x: Inputs) -> DataFrame:
    links = x.spread("pages").select(F.concat(F.lit("g"), "page_id").alias("id"),
                                    F.col("url").alias("link")).unionByName(
        x.postings().select(F.concat(F.lit("p"), "ord").alias("id"), "link"))
    return links.select("id", link_reference(F.col("link")).alias("link_ref"))


# ---- admission ---------------------------------------------------------------------

def admit_validate(x: Inputs) -> DataFrame:
    return admit.validate(x.postings()).select("ord", present(F.col("problem")).alias("problem"))


def admit_existing(x: Inputs) -> DataFrame:
    return admit.known_in_table(x.board(), x.incoming(), WORDS)


def token_lookup(x: Inputs) -> DataFrame:
    """admit_existing from a standing index, which has followed an update of the table."""
    x = x.held()
    index = TokenIndex(x.spark, scratch_path(x.spark, "tokens"), WORDS).start(x.board())
    hits, changes = _updated(x)
    after = settle(merge.apply_changes(x.board(), changes, hits, AS_OF), "after")
    rows = after.join(hits.select("row_no").distinct(), "row_no", "left_semi")
    index.update(x.board().join(rows.select("row_no"), "row_no", "left_semi"), rows)
    tokens = settle(admit.batch_tokens(x.incoming(), WORDS), "batch-tokens")
    claims = index.holders(tokens).select("token").distinct()
    return admit.known_in_table(after, x.incoming(), WORDS, claims=claims)


def admit_batch(x: Inputs) -> DataFrame:
    valid = with_identity(admit.validate(x.postings()).where("problem is null"), WORDS)
    return admit.choose(valid.select("ord", "tokens")).select("ord")


def outcomes(x: Inputs) -> DataFrame:
    return admit.admit(x.board(), x.incoming(), WORDS)


def admit_outcomes(x: Inputs) -> DataFrame:
    return admit.outcome_counts(outcomes(x))


def admit_refusals(x: Inputs) -> DataFrame:
    return admit.outcome_lines(outcomes(x))


def admit_apply(x: Inputs) -> DataFrame:
    after = admit.append_admitted(x.board(), outcomes(x), AS_OF)
    return after.select("row_no", "company", "title", "link", "notes", "salary_range", "updated")


# ---- ranking -----------------------------------------------------------------------

def priority_rank(x: Inputs) -> DataFrame:
    return rank.ranked(scan.read_records(x.postings().withColumn("row_no", F.col("ord") + 2)),
                       HOME).select("row_no", "priority")


def row_class(x: Inputs) -> DataFrame:
    return rank.class_counts(x.postings().unionByName(x.board(), allowMissingColumns=True))


def domain_check(x: Inputs) -> DataFrame:
    return rank.foreign_values(x.postings())


# ---- merging -----------------------------------------------------------------------

def update_match(x: Inputs) -> DataFrame:
    matched = merge.match_items(x.board(), x.updates(), WORDS)
    lines = merge.missing_items(matched).select("ord", "line")
    return matched.select("ord", "row_no").join(lines, "ord", "left").select(
        "ord", F.coalesce("row_no", F.lit(0)).alias("row_no"), present(F.col("line")).alias("line"))


def _updated(x: Inputs):
    hits = merge.target_rows(x.board(), x.updates(), WORDS)
    return hits, merge.update_changes(hits)


def _flagged(x: Inputs):
    hits = merge.target_rows(x.board(), x.flags(), WORDS)
    return hits, merge.flag_changes(hits)


def update_apply(x: Inputs) -> DataFrame:
    hits, changes = _updated(x)
    return merge.apply_changes(x.board(), changes, hits, AS_OF).select(
        "row_no", "stage", "notes", "salary_range", "process", "updated")


def flag_apply(x: Inputs) -> DataFrame:
    hits, changes = _flagged(x)
    return merge.apply_changes(x.board(), changes, hits, AS_OF).select(
        "row_no", "notes", "process", "updated")


def audit_log(x: Inputs) -> DataFrame:
    return merge.log_lines(_updated(x)[1], AS_OF, 1).unionByName(
        merge.log_lines(_flagged(x)[1], AS_OF, 2)).orderBy(F.desc("cycle"), "ord", "pos")


# ---- snapshots ---------------------------------------------------------------------

def snapshot_catalog(x: Inputs) -> DataFrame:
    return (parsed_names(x.file_names()).groupBy("snap_ts", "label")
            .agg(F.count("*").alias("n")).withColumn("snap_ts", text_of("snap_ts")))


def snapshot_retention(x: Inputs) -> DataFrame:
    return diff.expired(parsed_names(x.file_names()), AS_OF, days=15).withColumn(
        "snap_ts", text_of("snap_ts"))


def baseline_asof(x: Inputs) -> DataFrame:
    """A report half past every hour of the data, against one snapshot per event."""
    snaps = diff.catalogue(parsed_names(x.file_names()))
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz")
    reports = x.table("events").select(
        (hour + F.make_dt_interval(mins=F.lit(30))).alias("report_ts")).distinct()
    windows = diff.report_windows(reports, snaps, "baseline")
    name = lambda c: present(F.concat_ws(" ", text_of(f"{c}.snap_ts"), f"{c}.label"))
    return windows.select(text_of("report_ts").alias("report_ts"), "window",
                          name("newer").alias("newer"), name("older").alias("older"),
                          diff.window_label().alias("heading"))


def _activity(x: Inputs) -> DataFrame:
    windows = diff.report_windows(x.reports(), x.snap_times(), "baseline")
    return diff.transition_counts(windows, x.snapshots(), WORDS)


def activity_counts(x: Inputs) -> DataFrame:
    return _activity(x).select(text_of("report_ts").alias("report_ts"), "window",
                               *[F.coalesce(c, F.lit(-1)).alias(c) for c in diff.COUNTED])


def _history(x: Inputs) -> DataFrame:
    # read twice: once for the list of copies, once for the copies
    copies = settle(x.snapshots().select("snap_ts", "label", "row_no", *STATES), "copies")
    return history.events_of(copies, STATES)


def history_states(x: Inputs) -> DataFrame:
    """Every former state out of the row versions, per snapshot."""
    versions = settle(history.intervals(_history(x)), "intervals")
    times = x.snap_times().select(F.struct("snap_ts", "label").alias("at"))
    # versions meet the times between their ends by slots of the ordered list of times
    slots = times.agg(F.array_sort(F.collect_set("at")).alias("all")).scalar()
    held = versions.withColumn("all", slots).select("row_no", *STATES, F.explode(F.filter(
        "all", lambda t: (F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (t < F.col("valid_to"))))).alias("at"))
    return held.groupBy("at").agg(
        F.count("*").alias("n"), F.sum("row_no").alias("row_nos"), F.count_if(F.col("stage") != "").alias("staged"),
        F.sum(F.length("move")).alias("move_chars"), F.count_distinct("company").alias("companies")).select(
            text_of("at.snap_ts").alias("snap_ts"), F.col("at.label").alias("label"), "n", "row_nos", "staged", "move_chars",
            "companies")


def activity_live(x: Inputs) -> DataFrame:
    """The activity of every report, each week up to the live table, which differs from the last snapshot."""
    events = settle(sweep.with_live(_history(x), x.live(), STATES), "events")
    windows = diff.report_windows(x.reports(), x.snap_times(), "baseline")
    live = windows.withColumn("newer", F.when(F.col("window") == "week", F.when(F.col("newer").isNotNull(), sweep.live_time()))
                              .otherwise(F.col("newer")))
    snaps = x.snap_times().unionByName(x.spark.range(1).select(sweep.live_time().alias("at")).select("at.*"))
    counts = sweep.transition_counts(live, history.intervals(events), snaps, WORDS)
    return counts.select(text_of("report_ts").alias("report_ts"), "window",
                         *[F.coalesce(c, F.lit(-1)).alias(c) for c in sweep.COUNTED])


def activity_report(x: Inputs) -> DataFrame:
    """Mail counts come from the day's view events; days with an even number give none."""
    day = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(12))
    views = (x.table("events").where("event_type = 'view'")
             .groupBy(day.alias("report_ts")).agg(F.count("*").alias("n")))
    mail = views.select("report_ts", F.explode(F.array(F.lit("yesterday"), F.lit("week")))
                        .alias("window"), F.when(F.col("n") % 2 == 1, F.col("n")).alias("given"),
                        F.when(F.col("n") % 4 == 0, F.lit("12")).otherwise("").alias("previous"))
    return (diff.report_lines(_activity(x), mail)
            .select(text_of("report_ts").alias("report_ts"), F.col("line").cast("long").alias("line"),
                    "metric", "yesterday", "week"))


# ---- messages ----------------------------------------------------------------------

def message_intake(x: Inputs) -> DataFrame:
    threads = extract.recent_threads(x.messages(), fv.ALERT_SENDERS, INTAKE_AT, INTAKE_DAYS)
    firsts = extract.first_messages(x.messages(), threads)
    return firsts.select("thread_id", "message_id", "sender",
                         extract.source_tag(F.col("sender")).alias("source"))


def ledger_anti(x: Inputs) -> DataFrame:
    threads = x.messages().select("thread_id").distinct()
    new = extract.unseen(threads, x.ledger())
    return extract.first_messages(x.messages(), new).select("thread_id", "message_id", "url")


def mime_bodies(x: Inputs) -> DataFrame:
    bodies = extract.bodies(x.parts())
    head = x.messages().select("message_id",
                               extract.header(F.col("headers"), "Subject").alias("subject"),
                               extract.header(F.col("headers"), "FROM").alias("sender"),
                               extract.header(F.col("headers"), "Cc").alias("cc"))
    return head.join(bodies, "message_id", "left").select(
        "message_id", "subject", "sender", "cc", F.md5(present(F.col("plain"))).alias("plain_md5"),
        F.md5(present(F.col("html"))).alias("html_md5"))


def mime_tree(x: Inputs) -> DataFrame:
    """Bodies out of nested payloads, with the number of parts and the depth of each."""
    parts = settle(extract.walked_parts(x.payloads()), "parts")
    sizes = parts.groupBy("message_id").agg(F.count("*").alias("n_parts"), F.max("depth").alias("depth"))
    return sizes.join(extract.bodies(parts), "message_id", "left").select(
        "message_id", "n_parts", "depth", F.md5(present(F.col("plain"))).alias("plain_md5"),
        F.md5(present(F.col("html"))).alias("html_md5"))


def _texts(x: Inputs) -> DataFrame:
    return extract.bodies(x.parts()).select("message_id", extract.search_text(
        F.col("html"), F.col("plain")).alias("text"))


def link_harvest(x: Inputs) -> DataFrame:
    return extract.link_rows(_texts(x)).withColumn("pos", F.col("pos").cast("long"))


def link_harvest_sites(x: Inputs) -> DataFrame:
    """Links by a rule per site: which sites' pages each message names, its own address included."""
    texts = x.messages().select("message_id", F.concat_ws("\n", F.lower("url"), "html").alias("text"))
    return link_rules.link_rows(texts, x.site_rules()).select("message_id", "source", "job_id", "url")


def unknown_domains(x: Inputs) -> DataFrame:
    return extract.domain_rows(_texts(x)).select("message_id", "domain", "n", "place")


def source_liveness(x: Inputs) -> DataFrame:
    senders = fv.ALERT_SENDERS + ["noreply@glassdoor.com", "someone@example.org"]
    return extract.source_liveness(x.messages(), senders, AS_OF).withColumn(
        "last_ts", present(text_of("last_ts")))


def digest_render(x: Inputs) -> DataFrame:
    return extract.digests(x.messages(), extract.bodies(x.parts())).select(
        "message_id", "source", "n_links", "zero_links", "content")


# ---- texts -------------------------------------------------------------------------

def html_text(x: Inputs) -> DataFrame:
    return x.spread("pages").select("page_id", extract.html_to_text(F.col("html")).alias("text"))


def _lines(x: Inputs) -> DataFrame:
    texts = x.spread("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text") \
        .unionByName(x.spread("conversations").select(
            F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text"))
    return texts.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def line_kinds(x: Inputs) -> DataFrame:
    urls = F.size(F.regexp_extract_all("line", F.lit(r"(?U)https?://[^\s]+"), F.lit(0)))
    return (_lines(x).select("id", line_kind(F.col("line")).alias("kind"), urls.alias("urls"))
            .groupBy("id", "kind").agg(F.count("*").alias("n"), F.sum("urls").alias("urls")))


def text_direction(x: Inputs) -> DataFrame:
    rtl, latin = script_counts(F.col("text"))
    return x.spread("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text") \
        .unionByName(x.spread("conversations").select(
            F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("id"), "text")) \
        .select("id", rtl.alias("rtl"), latin.alias("latin"),
                F.when(rtl >= latin, "rtl").otherwise("ltr").alias("direction"))


# ---- streams -----------------------------------------------------------------------

def _routes(x: Inputs) -> DataFrame:
    out, checkpoint = [scratch_path(x.spark, n) for n in ("routes", "offsets")]
    intake.route_stream(x.spark, x.outbox(), out, checkpoint).awaitTermination()
    return x.spark.read.parquet(out)


def intent_route(x: Inputs) -> DataFrame:
    return _routes(x).select("file", "route", "reason")


def intent_explode(x: Inputs) -> DataFrame:
    documents = intents.contents(_routes(x))
    rows = [intents.items(documents, s).select(
        "file", F.lit(s).alias("section"), F.col("pos").cast("long").alias("pos"),
        F.col("fields")["company"].alias("company"), F.col("fields")["title"].alias("title"),
        present(F.coalesce(F.col("fields")["link"], F.col("fields")["gmail_link"])).alias("link"))
        for s in intents.SECTIONS]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _arriving(x: Inputs) -> DataFrame:
    """The page table itself as a stream of messages."""
    schema = x.table("pages").schema
    # a pattern, as a stream takes no path of a single file; it fits a file and a folder of files alike
    pages = x.spark.readStream.schema(schema).parquet(f"{x.dir}/page[s].parquet")
    return with_heads(x.spark.sql(MESSAGES, pages=pages))


def ledger_stream(x: Inputs) -> DataFrame:
    out, checkpoint = [scratch_path(x.spark, n) for n in ("ledger", "offsets")]
    intake.ledger_stream(_arriving(x), out, checkpoint, seed=x.ledger()).awaitTermination()
    return x.spark.read.parquet(out).select("thread_id")


def ledger_entries(x: Inputs) -> DataFrame:
    out, checkpoint = [scratch_path(x.spark, n) for n in ("entries", "offsets")]
    intake.entry_stream(_arriving(x), out, checkpoint, AS_OF, seed=x.ledger()).awaitTermination()
    return ledger.read(x.spark, f"{out}/entries")


def ledger_recent(x: Inputs) -> DataFrame:
    """Each thread once, with state that forgets threads after the delay."""
    out, checkpoint = [scratch_path(x.spark, n) for n in ("recent", "offsets")]
    stamped = _arriving(x).withColumn("sent_ts", F.col("sent_ts").cast("timestamp"))
    intake.recent_ledger_stream(stamped, out, checkpoint).awaitTermination()
    return x.spark.read.parquet(out).select("thread_id")


def ledger_read(x: Inputs) -> DataFrame:
    """Every message as a ledger line; each third is cut, each seventh names no thread."""
    line = F.to_json(F.struct(F.when(F.col("message_id") % 7 != 0, F.col("thread_id")).alias("thread_id"),
                              F.col("subject")))
    cut = F.when(F.col("message_id") % 3 == 0, F.substring(line, 1, 20)).otherwise(line)
    path = scratch_path(x.spark, "lines")
    x.messages().select(cut.alias("value")).write.text(path)
    return ledger.read(x.spark, path).groupBy("thread_id").agg(F.count("*").alias("n"))


def _applied(x: Inputs) -> Versions:
    x = x.held()
    versions = Versions(x.spark, scratch_path(x.spark, "versions")).start(x.board())
    intake.intake_stream(x.spark, x.outbox(), versions, scratch_path(x.spark, "offsets"), WORDS,
                         AS_OF, HOME).awaitTermination()
    return versions


def intent_apply(x: Inputs) -> DataFrame:
    return _applied(x).read().select("row_no", "company", "title", "stage", "notes", "process",
                                     "updated", "priority")


def quiet_cycle(x: Inputs) -> DataFrame:
    """The digest of a cycle without files, and what the history and the table hold after it."""
    versions = Versions(x.spark, scratch_path(x.spark, "versions")).start(x.board())
    number = intake.quiet_cycle(x.spark, versions, WORDS, AS_OF, HOME)
    rows = versions.read().agg(F.count("*").alias("n_rows"), F.sum("row_no").alias("row_nos"))
    marks = intake.past(versions).catalogue().agg(F.count("*").alias("n_marks"))
    kept = intake.past(versions).state().agg(F.count("*").alias("n_kept"))
    digest = versions.side("digest").where(F.col("version") == number).select("added", "updated", "flagged", "warnings")
    return digest.select("*", rows.select("n_rows").scalar().alias("n_rows"), rows.select("row_nos").scalar().alias("row_nos"),
                         marks.scalar().alias("n_marks"), kept.scalar().alias("n_kept"))


def cycle_digest(x: Inputs) -> DataFrame:
    return _applied(x).side("digest").drop("version")


NAMED: dict[str, Callable[[Inputs], DataFrame]] = {f.__name__: f for f in (
    table_scan, norm_profile, digit_ids, link_identity,
    admit_validate, admit_existing, token_lookup, admit_batch, admit_outcomes, admit_refusals, admit_apply,
    priority_rank, row_class, domain_check,
    update_match, update_apply, flag_apply, audit_log,
    snapshot_catalog, snapshot_retention, baseline_asof, activity_counts, activity_report,
    history_states, activity_live,
    message_intake, ledger_anti, mime_bodies, mime_tree, link_harvest, link_harvest_sites, unknown_domains, source_liveness,
    digest_render, html_text, line_kinds, text_direction,
    intent_route, intent_explode, ledger_stream, ledger_recent, ledger_entries, ledger_read, intent_apply, quiet_cycle,
    cycle_digest)}


def whole_numbers(df: DataFrame) -> DataFrame:
    """One integer type in all results."""
    return df.select(*[F.col(n).cast("long").alias(n) if t == "int" else F.col(n)
                       for n, t in df.dtypes])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(plan):
        return lambda spark, sf_dir: whole_numbers(plan(Inputs(spark, sf_dir)))
    return {name: bound(plan) for name, plan in NAMED.items()}
