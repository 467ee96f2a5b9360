"""The same results as plain SQL for DuckDB, written without looking at the Spark plans.

Admission is checked by a walk over the records one by one, which the Spark job never does.
"""

from __future__ import annotations

from millrace import fixed_values as fv
from millrace.functions.text import stop_words
from millrace.plans import fixtures as fx

WORDS = stop_words(fx.PLACES)
BLANK = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- scalar pieces -----------------------------------------------------------------

def strip_right(x: str) -> str:
    return f"regexp_replace({x}, '{BLANK}+$', '')"


def strip(x: str) -> str:
    return strip_right(f"regexp_replace({x}, '^{BLANK}+', '')")


def name(x: str) -> str:
    words = ", ".join(lit(w) for w in WORDS)
    bare = rf"regexp_replace(lower({x}), '\([^)]*\)', ' ', 'g')"
    spaced = rf"regexp_replace({bare}, '[^\p{{L}}\p{{N}}]+', ' ', 'g')"
    return (f"array_to_string(list_filter(string_split({spaced}, ' '), "
            f"lambda w: w <> '' AND w NOT IN ({words})), ' ')")


def key(company: str, title: str) -> str:
    return f"{name(company)} || '|' || {name(title)}"


def numbers(*xs: str) -> str:
    found = [rf"regexp_extract_all(coalesce({x}, ''), '\p{{Nd}}{{6,}}')" for x in xs]
    both = found[0] if len(found) == 1 else f"list_concat({', '.join(found)})"
    return f"list_sort(list_distinct({both}))"


URL = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"


def link_ref(x: str) -> str:
    part = {n: f"regexp_extract({strip(x)}, '{URL}', {n})" for n in range(1, 5)}

    def decoded(piece: str) -> str:
        return f"url_decode(replace({piece}, '+', ' '))"

    filled = f"list_filter(string_split({part[4]}, '&'), lambda p: regexp_matches(p, '^[^=]*=.+'))"
    pairs = (f"list_sort(list_transform({filled}, lambda p: {{'k': "
             f"{decoded('split_part(p, chr(61), 1)')}, 'v': "
             f"{decoded('substr(p, instr(p, chr(61)) + 1)')}}}))")
    ids = f"list_filter({pairs}, lambda p: regexp_matches(p.k, '(?i){fv.POSTING_PARAMETER}'))"
    shown = f"array_to_string(list_transform({ids}, lambda p: lower(p.k) || '=' || p.v), '&')"
    base = f"lower({part[2]}) || regexp_replace({part[3]}, '/+$', '')"
    return (f"CASE WHEN NOT starts_with(lower({part[1]}), 'http') OR {part[2]} = '' THEN NULL "
            f"WHEN {part[4]} = '' THEN {base} WHEN {shown} <> '' THEN {base} || '?' || {shown} END")


def any_of(column: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(n)})" for n in needles) + ")"


PRIORITY = f"""CASE WHEN {any_of('move', ['Not Relevant'])} THEN 9
  WHEN {any_of('stage', fv.ACTIVE_STAGES)} THEN 1
  WHEN {any_of('move', fv.MARKED_MOVES)} THEN 2
  WHEN {any_of('stage', fv.CLOSED_STAGES)} THEN 9
  WHEN {any_of('stage', ['Applied'])} OR {any_of('move', ['Applied'])} THEN 3
  WHEN contains(fit, '🟢') THEN 4 WHEN contains(fit, '🟡') THEN 5 ELSE 6 END"""

DISPLAY = f"""CASE WHEN contains(notes, {lit(fv.REVIEW_FLAG)}) THEN 'review'
  WHEN regexp_matches(move, 'Not Relevant') OR regexp_matches(stage, 'Rejected|No Response')
    THEN 'greyed'
  WHEN regexp_matches(stage, 'Action Required') THEN 'action'
  WHEN regexp_matches(stage, 'Screening|Interview|Home Assignment|Offer') THEN 'active'
  WHEN regexp_matches(move, 'To Apply|Tailor CV|Reach Out') THEN 'marked'
  WHEN regexp_matches(fit, '🟢') THEN 'green' WHEN regexp_matches(fit, '🟡') THEN 'yellow'
  WHEN regexp_matches(fit, '🔴') THEN 'red' ELSE 'plain' END"""

STAMP = "'%Y-%m-%d %H:%M:%S'"
DAY_STAMP = "'31/01/2024 12:00'"


# ---- derived inputs ----------------------------------------------------------------

def duck_text(text: str) -> str:
    text = text.replace("@split", f"TIMESTAMP '{fx.SPLIT}'").replace("@days", fx.DAYS)
    for word in ("part", "events", "customer", "nation", "pages", "documents", "postings",
                 "incoming", "messages"):
        text = text.replace("{" + word + "}", word)
    return text


VALID = f"trim(company) <> '' AND trim(title) <> '' AND starts_with({strip('link')}, 'http')"


def tokens() -> str:
    return (f"list_concat(['K:' || {key('company', 'title')}], "
            f"CASE WHEN {link_ref('link')} IS NULL THEN [] ELSE ['L:' || {link_ref('link')}] END, "
            f"list_transform({numbers('link', 'notes')}, "
            f"lambda n: 'T:' || {name('title')} || '|' || n))")


CTES = {
    "postings": fx.POSTINGS,
    "board": fx.BOARD,
    "cells": fx.CELLS,
    "incoming": fx.INCOMING,
    "updates": fx.UPDATES,
    "flags": fx.FLAGS,
    "file_names": fx.FILE_NAMES,
    "snap_times": f"SELECT CAST(snap_at AS TIMESTAMP) AS snap_ts, label FROM ({fx.SNAP_TIMES})",
    "messages": f"SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_hours(hours) AS sent_ts "
                f"FROM ({fx.MESSAGES})",
    "ledger": fx.LEDGER,
    "intent_rows": fx.INTENT_ROWS,
    "plain_parts": fx.PLAIN_PARTS,
    "texts": """
        SELECT m.message_id, m.html, coalesce(p.plain, '') AS plain,
          CASE WHEN p.plain <> '' THEN m.html || chr(10) || p.plain ELSE m.html END AS text
        FROM messages m LEFT JOIN (SELECT message_id, string_agg(text, chr(10) ORDER BY pos) AS plain
          FROM plain_parts WHERE text <> '' GROUP BY 1) p USING (message_id)""",
    # Admission, one record after another.
    "taken": f"SELECT DISTINCT unnest({tokens()}) AS token FROM board",
    "valid": f"SELECT *, {tokens()} AS tokens FROM incoming WHERE {VALID}",
    "known": """
        SELECT ord, bool_or(token NOT LIKE 'T:%') AS by_key
        FROM (SELECT ord, unnest(tokens) AS token FROM valid) JOIN taken USING (token) GROUP BY 1""",
    "fresh": """
        SELECT ord, list_transform(tokens, lambda t: hash(t)) AS hashes,
          row_number() OVER (ORDER BY ord) AS n
        FROM valid WHERE ord NOT IN (SELECT ord FROM known)""",
    "walk": """
        SELECT 1 AS one, CAST(0 AS BIGINT) AS n, CAST([] AS UBIGINT[]) AS claimed,
          CAST([] AS BIGINT[]) AS admitted
        UNION ALL
        SELECT 1, f.n,
          CASE WHEN list_has_any(w.claimed, f.hashes) THEN w.claimed
               ELSE list_concat(w.claimed, f.hashes) END,
          CASE WHEN list_has_any(w.claimed, f.hashes) THEN w.admitted
               ELSE list_append(w.admitted, f.ord) END
        FROM walk w JOIN fresh f ON f.n = w.n + 1""",
    "admitted": "SELECT unnest(admitted) AS ord FROM walk",
    "claims": """
        SELECT unnest(v.tokens) AS token, v.ord AS by_ord FROM valid v JOIN admitted USING (ord)""",
    "key_hits": """
        SELECT DISTINCT t.ord FROM (SELECT ord, unnest(tokens) AS token FROM valid) t
        LEFT JOIN claims c ON c.token = t.token AND c.by_ord < t.ord
        LEFT JOIN taken x ON x.token = t.token
        WHERE t.token NOT LIKE 'T:%' AND (c.token IS NOT NULL OR x.token IS NOT NULL)""",
    "outcomes": f"""
        SELECT i.*, CASE WHEN trim(company) = '' OR trim(title) = '' THEN 'blank'
          WHEN NOT ({VALID}) THEN 'bad_link'
          WHEN a.ord IS NOT NULL THEN 'admitted'
          WHEN k.ord IS NOT NULL THEN 'same_key_or_link'
          ELSE 'same_title_and_number' END AS outcome
        FROM incoming i LEFT JOIN admitted a USING (ord) LEFT JOIN key_hits k USING (ord)""",
    # Merging.
    "first_rows": f"SELECT {key('company', 'title')} AS k, min(row_no) AS row_no FROM board GROUP BY 1",
    "update_hits": f"""
        SELECT u.*, f.row_no, b.stage AS old_stage, b.notes AS old_notes, b.process AS old_process,
          {strip("coalesce(u.process_append, '')")} AS add_line, {strip('b.process')} <> '' AS filled,
          {strip_right('b.process')} AS base
        FROM (SELECT *, {key('company', 'title')} AS k FROM updates) u
        JOIN first_rows f USING (k) JOIN board b USING (row_no)""",
    "update_lines": f"""
        SELECT *, CASE WHEN process IS NOT NULL AND filled THEN
            CASE WHEN add_line <> '' THEN {strip("add_line || chr(10) || process")}
                 ELSE process END ELSE add_line END AS line FROM update_hits""",
    "update_cells": f"""
        SELECT ord, row_no, company, title, gmail_link, 0 AS pos, 'stage' AS field, old_stage AS old,
          stage AS new FROM update_lines WHERE stage IS NOT NULL
        UNION ALL
        SELECT ord, row_no, company, title, gmail_link, CASE WHEN stage IS NULL THEN 0 ELSE 1 END,
          'notes', old_notes, notes FROM update_lines WHERE notes IS NOT NULL
        UNION ALL
        SELECT ord, row_no, company, title, gmail_link, CASE WHEN stage IS NULL THEN 0 ELSE 1 END
          + CASE WHEN notes IS NULL THEN 0 ELSE 1 END, 'process', old_process, new FROM (
          SELECT *, CASE WHEN line <> '' AND NOT contains(base, line) THEN
              CASE WHEN base <> '' THEN base || chr(10) || chr(10) || line ELSE line END
            WHEN NOT filled THEN process END AS new FROM update_lines) WHERE new IS NOT NULL""",
    "flag_hits": f"""
        SELECT *, CASE WHEN kept = '' THEN note ELSE kept || ' | ' || note END AS merged FROM (
          SELECT g.*, f.row_no, b.notes AS old_notes,
            {strip(lit(fv.REVIEW_FLAG + ' — ') + " || g.reason")} AS note,
            array_to_string(list_filter(string_split(b.notes, ' | '),
              lambda s: NOT contains(s, {lit(fv.REVIEW_FLAG)})), ' | ') AS kept
          FROM (SELECT *, {key('company', 'title')} AS k FROM flags) g
          JOIN first_rows f USING (k) JOIN board b USING (row_no))""",
    # Snapshots.
    "parsed": r"""
        SELECT strptime(substr(file_name, 1, 15), '%Y-%m-%d-%H%M') AS snap_ts,
          replace(substr(file_name, 17), '.json', '') AS label, file_name
        FROM file_names WHERE regexp_matches(file_name, '^\d{4}-\d\d-\d\d-\d{4}-')""",
    "catalogue": "SELECT DISTINCT snap_ts, label FROM parsed",
    "snapshots": f"""
        SELECT s.snap_ts, s.label, p.ord AS row_no, p.move, p.stage, p.source,
          {key('p.company', 'p.title')} AS k
        FROM (SELECT s.snap_ts, s.label, p.company, p.title,
                arg_max(p.ord, (p.ts, p.ord)) AS ord
              FROM snap_times s JOIN postings p ON p.ts < s.snap_ts GROUP BY ALL) s
        JOIN postings p USING (ord) WHERE s.label <> 'before-upsert' OR p.source <> 'view'""",
    "reports": "SELECT DISTINCT snap_ts AS report_ts FROM snap_times "
               "WHERE strftime(snap_ts, '%H') = '12'",
    "hours": "SELECT DISTINCT date_trunc('hour', ts) + INTERVAL 30 MINUTE AS report_ts FROM events",
}


def windows(reports: str, snaps: str) -> str:
    def before(cutoff: str) -> str:
        return (f"(SELECT max(struct_pack(t := snap_ts, l := label)) FROM {snaps} "
                f"WHERE snap_ts < {cutoff})")
    return f"""
        SELECT report_ts, unnest(['yesterday', 'week']) AS "window",
          unnest([CASE WHEN whole THEN s_end END, CASE WHEN s_week IS NOT NULL THEN s_now END]) AS newer,
          unnest([CASE WHEN whole THEN s_start END, s_week]) AS older,
          unnest([s_end, s_week]) AS shown
        FROM (SELECT *, coalesce(s_end <> s_start, false) AS whole FROM (
          SELECT report_ts, {before("date_trunc('day', report_ts)")} AS s_end,
            {before("date_trunc('day', report_ts) - INTERVAL 1 DAY")} AS s_start,
            coalesce({before("report_ts - INTERVAL 7 DAY")},
              (SELECT min(struct_pack(t := snap_ts, l := label)) FROM {snaps})) AS s_week
            , (SELECT max(struct_pack(t := snap_ts, l := label)) FROM {snaps}
               WHERE snap_ts <= report_ts AND label = 'baseline') AS s_now
          FROM {reports}))"""


HEADING = """CASE WHEN shown IS NULL THEN '—'
  WHEN "window" = 'yesterday' AND CAST(shown.t AS DATE) = CAST(report_ts AS DATE) - 1 THEN 'Yesterday'
  WHEN "window" = 'yesterday' THEN 'Up to ' || strftime(shown.t, '%d/%m')
  WHEN floor(epoch(report_ts - shown.t) / 86400) BETWEEN 6 AND 8 THEN 'Last 7 days'
  ELSE 'Since ' || strftime(shown.t, '%d/%m') END"""

CTES["activity_windows"] = windows("reports", "snap_times")
CTES["hour_windows"] = windows("hours", "catalogue")
CTES["states"] = f"""
    SELECT snap_ts, label, row_no, k,
      contains(move, '✅ Applied') OR contains(stage, '📤 Applied') AS cv,
      contains(move, '❌ Not Relevant') AS nr, {any_of('stage', fv.ACTIVE_STAGES)} AS adv,
      contains(stage, 'Rejected') AS rej FROM snapshots"""
CTES["activity"] = """
    SELECT report_ts, "window", shown, older IS NOT NULL AND newer IS NOT NULL AS real,
      count(*) FILTER (WHERE n.k IS NOT NULL AND b.k IS NULL) AS new,
      count(*) FILTER (WHERE n.cv AND NOT coalesce(b.cv, false)) AS cv,
      count(*) FILTER (WHERE n.nr AND NOT coalesce(b.nr, false)) AS nr,
      count(*) FILTER (WHERE n.adv AND NOT coalesce(b.adv, false)) AS adv,
      count(*) FILTER (WHERE n.rej AND NOT coalesce(b.rej, false)) AS rej
    FROM activity_windows w
    LEFT JOIN states n ON n.snap_ts = w.newer.t AND n.label = w.newer.l
    LEFT JOIN (SELECT snap_ts, label, k, arg_max(cv, row_no) AS cv, arg_max(nr, row_no) AS nr,
        arg_max(adv, row_no) AS adv, arg_max(rej, row_no) AS rej FROM states GROUP BY 1, 2, 3) b
      ON b.snap_ts = w.older.t AND b.label = w.older.l AND b.k = n.k
    GROUP BY ALL"""

CTES["board_after"] = """
    SELECT b.* REPLACE (coalesce(n.new, b.notes) AS notes) FROM board b LEFT JOIN (
      SELECT row_no, arg_max(new, ord) AS new FROM update_cells WHERE field = 'notes' GROUP BY 1) n USING (row_no)"""
CTES["taken_after"] = CTES["taken"].replace("FROM board", "FROM board_after")
CTES["known_after"] = CTES["known"].replace("taken", "taken_after")
CTES["site_rules"] = fx.SITE_RULES
CTES["live"] = fx.LIVE
CTES["live_states"] = f"""
    SELECT row_no, {key('company', 'title')} AS k,
      contains(move, '✅ Applied') OR contains(stage, '📤 Applied') AS cv,
      contains(move, '❌ Not Relevant') AS nr, {any_of('stage', fv.ACTIVE_STAGES)} AS adv,
      contains(stage, 'Rejected') AS rej FROM live"""
CTES["all_states"] = """
    SELECT * FROM states UNION ALL SELECT TIMESTAMP '9999-12-31 00:00:00', 'live', * FROM live_states"""
CTES["live_windows"] = """
    SELECT * REPLACE (CASE WHEN "window" = 'week' AND newer IS NOT NULL
      THEN struct_pack(t := TIMESTAMP '9999-12-31 00:00:00', l := 'live') ELSE newer END AS newer) FROM activity_windows"""
CTES["live_activity"] = CTES["activity"].replace("activity_windows", "live_windows").replace("states", "all_states")

# What each derived input needs, in order of definition.
NEEDS = {
    "board": ["postings"], "cells": ["postings"], "incoming": ["postings"],
    "updates": ["incoming"], "flags": ["incoming"], "file_names": ["postings"],
    "ledger": ["messages"], "intent_rows": ["postings"], "texts": ["messages", "plain_parts"],
    "taken": ["board"], "valid": ["incoming"], "known": ["valid", "taken"],
    "fresh": ["valid", "known"], "walk": ["fresh"], "admitted": ["walk"],
    "claims": ["valid", "admitted"], "key_hits": ["claims", "taken"],
    "outcomes": ["incoming", "admitted", "key_hits"],
    "first_rows": ["board"], "update_hits": ["updates", "first_rows"],
    "update_lines": ["update_hits"], "update_cells": ["update_lines"],
    "flag_hits": ["flags", "first_rows"],
    "parsed": ["file_names"], "catalogue": ["parsed"], "snapshots": ["snap_times", "postings"],
    "reports": ["snap_times"], "activity_windows": ["reports"], "hour_windows": ["hours", "catalogue"],
    "states": ["snapshots"], "activity": ["activity_windows", "states"],
    "board_after": ["board", "update_cells"], "taken_after": ["board_after"], "known_after": ["valid", "taken_after"],
    "live": ["postings"], "live_states": ["live"], "all_states": ["states", "live_states"],
    "live_windows": ["activity_windows"], "live_activity": ["live_windows", "all_states"],
}


def using(names: str, body: str) -> str:
    wanted: list[str] = []

    def add(cte: str) -> None:
        for need in NEEDS.get(cte, []):
            add(need)
        if cte not in wanted:
            wanted.append(cte)

    for cte in names.split():
        add(cte)
    head = {"walk": "walk(one, n, claimed, admitted) USING KEY (one)", "told": "told"}
    parts = [f"{head.get(c, c)} AS {'' if c in head else 'MATERIALIZED '}({duck_text(CTES[c])})"
             for c in wanted]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def link_rows_sql() -> str:
    per_rule = []
    for n, (source, pattern, template) in enumerate(fv.LINK_RULES):
        rx = lit(pattern.replace(r"\d", r"\p{Nd}").replace(r"\s", r"\s\p{Z}"))
        per_rule.append(
            f"SELECT message_id, {n} AS rule, min(i) AS i, '{source}' AS source, job_id, "
            f"replace('{template}', '{{}}', job_id) AS url FROM (SELECT message_id, "
            f"unnest(regexp_extract_all(text, {rx}, 1)) AS job_id, "
            f"generate_subscripts(regexp_extract_all(text, {rx}, 1), 1) AS i FROM texts) "
            f"GROUP BY message_id, job_id")
    union = " UNION ALL ".join(per_rule)
    return (f"SELECT message_id, row_number() OVER (PARTITION BY message_id ORDER BY rule, i) - 1 "
            f"AS pos, source, job_id, url FROM ({union})")


def unknown_sql() -> str:
    rules = " AND ".join("NOT regexp_matches(href, " + lit(
        p.replace(r"\d", r"\p{Nd}").replace(r"\s", r"\s\p{Z}")) + ")" for _, p, _ in fv.LINK_RULES)
    href = lit(fv.HREF_PATTERN.replace(r"\s", r"\s\p{Z}"))
    return f"""
        SELECT message_id, domain, n, row_number() OVER (
            PARTITION BY message_id ORDER BY n DESC, first_i) AS place FROM (
          SELECT message_id, regexp_replace(href, '^https?://([^/]+).*', '\\1') AS domain,
            count(*) AS n, min(i) AS first_i FROM (
            SELECT message_id, unnest(regexp_extract_all(text, {href}, 1)) AS href,
              generate_subscripts(regexp_extract_all(text, {href}, 1), 1) AS i FROM texts)
          WHERE {rules} GROUP BY 1, 2)"""


def page_text_sql(html: str) -> str:
    """Text of the pages of the test data, whose markup is regular enough for patterns."""
    x = html
    for tag in ("head", "script", "style", "title"):
        x = f"regexp_replace({x}, '(?is)<{tag}(?:\\s[^>]*)?>.*?</{tag}\\s*>', '', 'g')"
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', '', 'g')"
    breaks = "|".join(fv.BREAK_TAGS)
    x = f"regexp_replace({x}, '(?i)</?(?:{breaks})(?:[\\s/][^>]*)?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '(?s)<[!/a-zA-Z][^>]*>', '', 'g')"
    for entity, char in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "),
                         ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{entity}', '{char}')"
    x = f"regexp_replace({x}, '[{''.join(fv.INVISIBLE)}]', '', 'g')"
    lines = (f"list_transform(string_split_regex({x}, '\\r\\n|[\\n\\r\\x0b\\f\\x1c-\\x1e\\x85\\x{{2028}}"
             f"\\x{{2029}}]'), lambda s: {strip('s')})")
    return strip(f"regexp_replace(array_to_string({lines}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def texts_union() -> str:
    return ("(SELECT 'd' || doc_id AS id, text FROM documents UNION ALL "
            "SELECT 'c' || conv_id || '-' || turn, text FROM conversations)")


def _senders() -> str:
    names = fv.ALERT_SENDERS + ["noreply@glassdoor.com", "someone@example.org"]
    return ", ".join(lit(s) for s in names)


def _known() -> str:
    return any_of("lower(sender)", fv.ALERT_SENDERS)


TAG = "CASE " + " ".join(f"WHEN contains(lower(sender), '{t}') THEN '{t}'"
                         for t in fv.SOURCE_TAGS) + " ELSE 'other' END"


def oracle_sql() -> dict[str, str]:
    return {
        "table_scan": using("cells", f"""
            SELECT row_no AS _row, {key("coalesce(company, '')", "coalesce(title, '')")} AS _key,
              coalesce(company, '') AS company, coalesce(title, '') AS title,
              coalesce(stage, '') AS stage, coalesce(link, '') AS link FROM cells
            WHERE coalesce(company, '') <> '' OR coalesce(title, '') <> ''"""),
        "norm_profile": f"""
            SELECT doc_id, {key('lang', 'source')} AS name_key, md5({name('text')}) AS name_md5,
              length({name('text')}) AS n_chars FROM documents""",
        "digit_ids": using("postings", f"""
            SELECT id, array_to_string({numbers('a', 'b')}, ' ') AS numbers FROM (
              SELECT 'd' || doc_id AS id, text AS a, source AS b FROM documents UNION ALL
              SELECT 'p' || ord, link, notes FROM postings)"""),
        "link_identity": using("postings", f"""
            SELECT id, {link_ref('link')} AS link_ref FROM (
              SELECT 'g' || page_id AS id, url AS link FROM pages UNION ALL
              SELECT 'p' || ord, link FROM postings)"""),
        "admit_validate": using("postings", f"""
            SELECT ord, CASE WHEN trim(company) = '' OR trim(title) = '' THEN 'blank'
              WHEN {VALID} THEN '' ELSE 'bad_link' END AS problem FROM postings"""),
        "admit_existing": using("known", "SELECT ord, by_key FROM known"),
        "token_lookup": using("known_after", "SELECT ord, by_key FROM known_after"),
        "admit_batch": using("admitted", "SELECT ord FROM admitted")
            .replace(duck_text(CTES["incoming"]), "SELECT * FROM postings")
            .replace("WHERE ord NOT IN (SELECT ord FROM known)", ""),
        "admit_outcomes": using("outcomes",
                                "SELECT outcome, count(*) AS n FROM outcomes GROUP BY 1"),
        "admit_refusals": using("outcomes", f"""
            SELECT ord, outcome, {strip('company')} || ' — ' || {strip('title')} || CASE outcome
              WHEN 'bad_link' THEN ' (link=''' || {strip('link')} || ''')'
              WHEN 'same_title_and_number' THEN ' (same title + shared job id)' ELSE '' END AS line
            FROM outcomes WHERE outcome NOT IN ('blank', 'admitted')"""),
        "admit_apply": using("outcomes", f"""
            SELECT row_no, company, title, link, notes, '' AS salary_range, '' AS updated FROM board
            UNION ALL
            SELECT (SELECT max(row_no) FROM board) + row_number() OVER (ORDER BY ord),
              company, title, link, notes, '', {DAY_STAMP}
            FROM outcomes WHERE outcome = 'admitted'"""),
        "priority_rank": using("postings", f"""
            SELECT ord + 2 AS row_no, CAST({PRIORITY} AS DOUBLE) + CAST(CASE WHEN
              contains(lower(location), '{fx.HOME}') THEN 0.0 ELSE 0.1 END AS DOUBLE) AS priority
            FROM postings"""),
        "row_class": using("board", f"""
            SELECT {DISPLAY} AS display_class, count(*) AS n FROM (
              SELECT move, stage, fit, notes FROM postings UNION ALL
              SELECT move, stage, fit, notes FROM board) GROUP BY 1"""),
        "domain_check": using("postings", f"""
            SELECT field, value, count(*) AS n FROM (
              SELECT 'move' AS field, move AS value FROM postings WHERE move NOT IN
                ({', '.join(map(lit, fv.MOVE_VALUES))}) UNION ALL
              SELECT 'stage', stage FROM postings WHERE stage NOT IN
                ({', '.join(map(lit, fv.STAGE_VALUES))})) WHERE value <> '' GROUP BY 1, 2"""),
        "update_match": using("updates first_rows", f"""
            SELECT ord, coalesce(row_no, 0) AS row_no, CASE WHEN row_no IS NULL THEN
              company || ' — ' || title ELSE '' END AS line
            FROM (SELECT *, {key('company', 'title')} AS k FROM updates)
            LEFT JOIN first_rows USING (k)"""),
        "update_apply": using("update_cells", f"""
            SELECT b.row_no, coalesce(s.new, b.stage) AS stage, coalesce(n.new, b.notes) AS notes,
              '' AS salary_range, coalesce(p.new, b.process) AS process,
              CASE WHEN h.row_no IS NULL THEN '' ELSE {DAY_STAMP} END AS updated
            FROM board b LEFT JOIN (SELECT DISTINCT row_no FROM update_hits) h USING (row_no)
            """ + "".join(
                f"LEFT JOIN (SELECT row_no, arg_max(new, ord) AS new FROM update_cells "
                f"WHERE field = '{f}' GROUP BY 1) {f[0]} USING (row_no) "
                for f in ("stage", "notes", "process"))),
        "flag_apply": using("flag_hits", f"""
            SELECT b.row_no, coalesce(g.new, b.notes) AS notes, b.process,
              CASE WHEN g.row_no IS NULL THEN '' ELSE {DAY_STAMP} END AS updated
            FROM board b LEFT JOIN (SELECT row_no, arg_max(merged, ord) AS new FROM flag_hits
              GROUP BY 1) g USING (row_no)"""),
        "audit_log": using("update_cells flag_hits", f"""
            SELECT 1 AS cycle, ord, pos, {DAY_STAMP} AS log_date, '{fv.ACTION_UPDATED}' AS action,
              company, title, CASE field WHEN 'stage' THEN 'Stage' WHEN 'notes' THEN 'Notes'
              ELSE 'Hiring Process' END AS field, old AS old_value, new AS new_value,
              gmail_link AS source_link FROM update_cells
            UNION ALL
            SELECT 2, ord, 0, {DAY_STAMP}, '{fv.ACTION_FLAGGED}', company, title, 'Notes', old_notes,
              merged, gmail_link FROM flag_hits"""),
        "snapshot_catalog": using("parsed", f"""
            SELECT strftime(snap_ts, {STAMP}) AS snap_ts, label, count(*) AS n FROM parsed
            GROUP BY ALL"""),
        "snapshot_retention": using("catalogue", f"""
            SELECT strftime(snap_ts, {STAMP}) AS snap_ts, label,
              snap_ts < TIMESTAMP '{fx.AS_OF}' - INTERVAL 15 DAY AS expired FROM catalogue"""),
        "baseline_asof": using("hour_windows", f"""
            SELECT strftime(report_ts, {STAMP}) AS report_ts, "window",
              coalesce(strftime(newer.t, {STAMP}) || ' ' || newer.l, '') AS newer,
              coalesce(strftime(older.t, {STAMP}) || ' ' || older.l, '') AS older,
              {HEADING} AS heading FROM hour_windows"""),
        "activity_counts": using("activity", f"""
            SELECT strftime(report_ts, {STAMP}) AS report_ts, "window", """ + ", ".join(
                f"CASE WHEN real THEN {c} ELSE -1 END AS {c}"
                for c in ("new", "cv", "nr", "adv", "rej")) + " FROM activity"),
        "history_states": using("snapshots", f"""
            SELECT strftime(s.snap_ts, {STAMP}) AS snap_ts, s.label, count(*) AS n,
              CAST(sum(s.row_no) AS BIGINT) AS row_nos, count(*) FILTER (WHERE p.stage <> '') AS staged,
              CAST(sum(length(p.move)) AS BIGINT) AS move_chars, count(DISTINCT p.company) AS companies
            FROM snapshots s JOIN postings p ON p.ord = s.row_no GROUP BY s.snap_ts, s.label"""),
        "activity_live": using("live_activity", f"""
            SELECT strftime(report_ts, {STAMP}) AS report_ts, "window", """ + ", ".join(
                f"CASE WHEN real THEN {c} ELSE -1 END AS {c}"
                for c in ("new", "cv", "nr", "adv", "rej")) + " FROM live_activity"),
        "activity_report": using("activity", f"""
            , mail AS (SELECT date_trunc('day', ts) + INTERVAL 12 HOUR AS report_ts, count(*) AS n
              FROM events WHERE event_type = 'view' GROUP BY 1),
            shown AS (SELECT a.*, {HEADING} AS heading, CASE WHEN n % 2 = 1 THEN CAST(n AS STRING)
                WHEN n % 4 = 0 THEN '12' ELSE '—' END AS mails
              FROM activity a LEFT JOIN mail USING (report_ts)),
            lines AS (SELECT report_ts, "window", unnest(range(7)) AS line, unnest(['RECENT ACTIVITY',
                {', '.join(lit(v) for v in fv.ACTIVITY_LABELS.values())}]) AS metric,
              unnest([heading, """ + ", ".join(
                f"CASE WHEN real THEN CAST({c} AS STRING) ELSE '—' END"
                for c in ("cv", "nr", "new", "adv", "rej")) + f""", mails]) AS value FROM shown)
            SELECT strftime(report_ts, {STAMP}) AS report_ts, line, metric,
              max(value) FILTER (WHERE "window" = 'yesterday') AS yesterday,
              max(value) FILTER (WHERE "window" = 'week') AS week FROM lines GROUP BY 1, 2, 3"""),
        "message_intake": using("messages", f"""
            SELECT thread_id, message_id, sender, {TAG} AS source FROM messages
            WHERE thread_id IN (SELECT thread_id FROM messages
              WHERE sent_ts > TIMESTAMP '{fx.INTAKE_AT}' - INTERVAL {fx.INTAKE_DAYS} DAY AND {_known()}
              GROUP BY 1)
            QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY sent_ts, message_id) = 1"""),
        "ledger_anti": using("ledger", """
            SELECT thread_id, message_id, url FROM messages
            WHERE thread_id NOT IN (SELECT thread_id FROM ledger)
            QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY sent_ts, message_id) = 1"""),
        "mime_bodies": using("texts", """
            SELECT message_id, m.subject, m.sender, '' AS cc, md5(coalesce(t.plain, '')) AS plain_md5,
              md5(coalesce(t.html, '')) AS html_md5 FROM messages m LEFT JOIN texts t USING (message_id)"""),
        "mime_tree": using("texts", """
            SELECT message_id, CAST(3 + coalesce(sum(2 + pos % 5), 0) AS BIGINT) AS n_parts,
              greatest(2, coalesce(max(2 + pos % 5), 0)) AS depth, md5(any_value(coalesce(t.plain, ''))) AS plain_md5,
              md5(any_value(coalesce(t.html, ''))) AS html_md5
            FROM messages m LEFT JOIN texts t USING (message_id) LEFT JOIN plain_parts p USING (message_id)
            GROUP BY message_id"""),
        "link_harvest": using("texts", link_rows_sql()),
        "link_harvest_sites": using("messages site_rules", """
            SELECT DISTINCT message_id, source, job_id, replace(template, '{}', job_id) AS url
            FROM (SELECT message_id, source, template,
                unnest(regexp_extract_all(lower(url) || chr(10) || html, pattern, 1)) AS job_id
              FROM messages JOIN site_rules ON contains(lower(url) || chr(10) || html, literal))"""),
        "unknown_domains": using("texts", unknown_sql()),
        "source_liveness": using("messages", f"""
            SELECT s.sender, count(m.message_id) AS n,
              coalesce(strftime(max(sent_ts), {STAMP}), '') AS last_ts,
              coalesce(max(sent_ts) < TIMESTAMP '{fx.AS_OF}' - INTERVAL 7 DAY, true) AS broken
            FROM (SELECT unnest([{_senders()}]) AS sender) s
            LEFT JOIN messages m ON contains(lower(m.sender), s.sender) GROUP BY 1"""),
        "digest_render": using("texts", f"""
            , links AS (SELECT message_id, count(*) AS n, string_agg(rpad(source, 12, ' ') || ' '
                || rpad(job_id, CAST(greatest(18, length(job_id)) AS INTEGER), ' ') || ' ' || url, chr(10)
                ORDER BY pos) AS lines FROM ({link_rows_sql()}) GROUP BY 1),
            unknown AS (SELECT message_id, '(unrecognised: ' || string_agg(domain || '×' || n, ', '
                ORDER BY place) || ')' AS line FROM ({unknown_sql()}) GROUP BY 1)
            SELECT message_id, {TAG} AS source, coalesce(n, 0) AS n_links, n IS NULL AS zero_links,
              concat_ws(chr(10), 'Subject: ' || CASE WHEN subject = '' THEN '(no subject)'
                  ELSE subject END, 'From:    ' || sender, 'Date:    ',
                'Gmail:   {fv.MAIL_ADDRESS}' || thread_id, '',
                '=== canonical job links (' || coalesce(n, 0) || ') ===', lines,
                CASE WHEN n IS NULL THEN {lit(fv.NO_LINKS_WARNING)} END, u.line, '',
                '=== email body (stripped text) ===',
                {page_text_sql('t.html')}, '') AS content
            FROM messages m JOIN texts t USING (message_id) LEFT JOIN links l USING (message_id)
            LEFT JOIN unknown u USING (message_id)"""),
        "html_text": f"SELECT page_id, {page_text_sql('html')} AS text FROM pages",
        "line_kinds": f"""
            SELECT id, kind, count(*) AS n, CAST(sum(urls) AS BIGINT) AS urls FROM (
              SELECT id, len(regexp_extract_all(line, 'https?://[^\\s\\p{{Z}}]+')) AS urls, CASE
                WHEN {strip('line')} = '' THEN 'blank'
                WHEN regexp_matches({strip('line')}, '^[=─—_]{{5,}}$') THEN 'rule'
                WHEN starts_with({strip_right('line')}, '## ') THEN 'heading'
                WHEN left({strip('line')}, 1) IN ('•', '-', '*') THEN 'bullet' ELSE 'text' END AS kind
              FROM (SELECT id, unnest(string_split(text, chr(10))) AS line FROM {texts_union()}))
            GROUP BY 1, 2""",
        "intent_route": using("intent_rows", """
            SELECT DISTINCT name || kind AS file, route, reason FROM intent_rows, (VALUES
              ('', 'ready', ''), ('-half', 'pending', ''),
              ('-list', 'failed', 'An outbox file must be a JSON object ({...}) with '
                || 'upserts/updates/flags — got list'),
              ('-text', 'failed', 'An outbox file must be a JSON object ({...}) with '
                || 'upserts/updates/flags — got str')) v(kind, route, reason)"""),
        "intent_explode": using("intent_rows updates flags", """
            SELECT name AS file, section, row_number() OVER (PARTITION BY name, section ORDER BY ord)
              - 1 AS pos, company, title, link FROM (
              SELECT name, ord, 'upserts' AS section, company, title, link FROM intent_rows UNION ALL
              SELECT name, ord, 'updates', u.company, u.title, u.gmail_link
              FROM intent_rows JOIN updates u USING (ord) UNION ALL
              SELECT name, ord, 'flags', g.company, g.title, g.gmail_link
              FROM intent_rows JOIN flags g USING (ord))"""),
        "ledger_stream": using("ledger", """
            SELECT DISTINCT thread_id FROM messages
            WHERE thread_id NOT IN (SELECT thread_id FROM ledger)"""),
        "ledger_recent": using("messages", "SELECT DISTINCT thread_id FROM messages"),
        "quiet_cycle": using("board", """
            SELECT 0 AS added, 0 AS updated, 0 AS flagged, 0 AS warnings, count(*) AS n_rows,
              CAST(sum(row_no) AS BIGINT) AS row_nos, 2 AS n_marks, count(*) AS n_kept FROM board"""),
        "ledger_entries": using("ledger", f"""
            SELECT thread_id, strftime(TIMESTAMP '{fx.AS_OF}', '%Y-%m-%dT%H:%M:%S') AS date_fetched,
              {TAG} AS source, CASE WHEN subject = '' THEN {lit(fv.DIGEST_NO_SUBJECT)} ELSE subject END AS subject,
              strftime(TIMESTAMP '{fx.AS_OF}', '%Y%m%d') || '-' || {TAG} || '-' || thread_id || '.txt' AS file
            FROM messages WHERE thread_id NOT IN (SELECT thread_id FROM ledger)
            QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY sent_ts, message_id) = 1"""),
        "ledger_read": using("messages", """
            SELECT thread_id, count(*) AS n FROM messages WHERE message_id % 3 <> 0 AND message_id % 7 <> 0
            GROUP BY 1"""),
        "text_direction": f"""
            SELECT *, CASE WHEN rtl >= latin THEN 'rtl' ELSE 'ltr' END AS direction FROM (
              SELECT id, length(regexp_replace(text, '[^\\x{{0590}}-\\x{{08FF}}]', '', 'g')) AS rtl,
                length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin FROM {texts_union()})""",
    }
