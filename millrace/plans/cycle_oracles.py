"""SQL for the applied stream: the steps of each row told one after another by recursion."""

from __future__ import annotations

from millrace import fixed_values as fv
from millrace.plans import fixtures as fx
from millrace.plans.oracles import (CTES, DAY_STAMP, NEEDS, PRIORITY, key, lit, strip, strip_right,
                                    using)


def _line(i: str) -> str:
    """The text an item adds to the running notes of row t."""
    filled = f"{strip('t.process')} <> ''"
    joined = strip(f"{i}.add_line || chr(10) || {i}.direct")
    return (f"CASE WHEN {i}.direct IS NOT NULL AND {filled} THEN CASE WHEN {i}.add_line <> '' "
            f"THEN {joined} ELSE {i}.direct END ELSE {i}.add_line END")


def _process(i: str) -> str:
    base = strip_right("t.process")
    return (f"CASE WHEN {_line(i)} <> '' AND NOT contains({base}, {_line(i)}) THEN CASE WHEN "
            f"{base} <> '' THEN {base} || chr(10) || chr(10) || {_line(i)} ELSE {_line(i)} END "
            f"WHEN {strip('t.process')} = '' THEN {i}.direct END")


def _given(expression: str) -> str:
    return (f"list_filter(list_transform(s.items, lambda i: {expression}), "
            f"lambda v: v IS NOT NULL)")


KEPT = (f"array_to_string(list_filter(string_split(t.notes, ' | '), "
        f"lambda n: NOT contains(n, {lit(fv.REVIEW_FLAG)})), ' | ')")
FLAGGED = strip(lit(fv.REVIEW_FLAG + " — ") + " || s.items[-1].reason")

CTES["all_rows"] = """
    SELECT row_no, '' AS since, company, title, stage, notes, process, move, fit, location FROM board
    UNION ALL
    SELECT (SELECT max(row_no) FROM board) + row_number() OVER (ORDER BY o.ord), r.name, o.company,
      o.title, o.stage, o.notes, '', '', o.fit, o.location
    FROM outcomes o JOIN intent_rows r USING (ord) WHERE outcome = 'admitted'"""
CTES["targets"] = f"""
    SELECT k, min(row_no) AS row_no, arg_min(since, row_no) AS since
    FROM (SELECT row_no, since, {key('company', 'title')} AS k FROM all_rows) GROUP BY 1"""
CTES["items"] = f"""
    SELECT i.*, t.row_no, r.name AS file FROM (
      SELECT ord, 1 AS section, company, title, stage, notes, process AS direct,
        {strip("coalesce(process_append, '')")} AS add_line, NULL AS reason,
        {key('company', 'title')} AS k FROM updates
      UNION ALL
      SELECT ord, 2, company, title, NULL, NULL, NULL, '', reason, {key('company', 'title')}
      FROM flags) i
    JOIN intent_rows r USING (ord) LEFT JOIN targets t ON t.k = i.k AND t.since <= r.name"""
CTES["steps"] = """
    SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY file, section) AS step FROM (
      SELECT row_no, file, section, list(struct_pack(stage := stage, notes := notes,
        direct := direct, add_line := add_line, reason := reason) ORDER BY ord) AS items
      FROM items WHERE row_no IS NOT NULL GROUP BY 1, 2, 3)"""
CTES["told"] = f"""
    SELECT CAST(row_no AS BIGINT) AS row_no, CAST(0 AS BIGINT) AS step, 0 AS section, stage, notes,
      process, CAST(0 AS BIGINT) AS n_cells FROM all_rows
    UNION ALL
    SELECT t.row_no, s.step, s.section, coalesce({_given('i.stage')}[-1], t.stage),
      CASE WHEN s.section = 1 THEN coalesce({_given('i.notes')}[-1], t.notes)
        WHEN {KEPT} = '' THEN {FLAGGED} ELSE {KEPT} || ' | ' || {FLAGGED} END,
      coalesce({_given(_process('i'))}[-1], t.process),
      len(s.items) + CASE WHEN s.section = 2 THEN len(s.items) ELSE len({_given('i.stage')})
        + len({_given('i.notes')}) + len({_given(_process('i'))}) END
    FROM told t JOIN steps s ON s.row_no = t.row_no AND s.step = t.step + 1"""
CTES["notices"] = f"""
    SELECT r.name AS file, 0 AS section, 'Rejected (no valid link): ' || string_agg(
        {strip('o.company')} || ' — ' || {strip('o.title')} || ' (link=' || chr(39)
        || {strip('o.link')} || chr(39) || ')', ' · ' ORDER BY ord) AS line
    FROM outcomes o JOIN intent_rows r USING (ord) WHERE outcome = 'bad_link' GROUP BY 1
    UNION ALL
    SELECT file, section, CASE section WHEN 1 THEN
        'Status update — job not found in sheet (check spelling): '
        ELSE 'Flag — job not found in sheet: ' END
      || string_agg(company || ' — ' || title, ' · ' ORDER BY ord)
    FROM items WHERE row_no IS NULL GROUP BY 1, 2
    UNION ALL
    SELECT DISTINCT name || '-' || kind, 0,
      'File FAILED (moved to outbox/failed/, nothing applied): ' || name || '-' || kind
      || ' — An outbox file must be a JSON object ({{...}}) with upserts/updates/flags — got ' || got
    FROM intent_rows, (VALUES ('list', 'list'), ('text', 'str')) v(kind, got)"""

NEEDS.update({
    "all_rows": ["outcomes", "board", "intent_rows"], "targets": ["all_rows"],
    "items": ["updates", "flags", "targets", "intent_rows"], "steps": ["items"],
    "told": ["all_rows", "steps"], "notices": ["outcomes", "items"]})


def oracle_sql() -> dict[str, str]:
    return {
        "intent_apply": using("told", f"""
            , ends AS (SELECT * FROM told QUALIFY row_number() OVER (
              PARTITION BY row_no ORDER BY step DESC) = 1),
            whole AS (SELECT a.row_no, since, company, title, move, fit, location, t.step, t.stage,
              t.notes, t.process FROM all_rows a JOIN ends t USING (row_no))
            SELECT row_no, company, title, stage, notes, process,
              CASE WHEN since <> '' OR step > 0 THEN {DAY_STAMP} ELSE '' END AS updated,
              CAST({PRIORITY} AS DOUBLE) + CAST(CASE WHEN contains(lower(location), '{fx.HOME}')
                THEN 0.0 ELSE 0.1 END AS DOUBLE) AS priority FROM whole"""),
        "cycle_digest": using("told notices", f"""
            , mails AS (SELECT name, count(*) FILTER (WHERE source = 'view') AS views
              FROM intent_rows GROUP BY 1),
            sums AS (SELECT
              (SELECT count(*) FROM outcomes WHERE outcome = 'admitted') AS added,
              (SELECT count(*) FROM outcomes WHERE outcome LIKE 'same%') AS skipped,
              (SELECT CAST(sum(n_cells) FILTER (WHERE section = 1) AS BIGINT) FROM told) AS updated,
              (SELECT CAST(sum(n_cells) FILTER (WHERE section = 2) AS BIGINT) FROM told) AS flagged,
              (SELECT count(*) FROM notices) AS warnings,
              (SELECT string_agg('• ' || line, chr(10) ORDER BY file, section) FROM notices) AS lines,
              (SELECT string_agg('part ' || name, {lit(fv.PART_SEPARATOR)} ORDER BY name)
               FROM mails) AS parts, (SELECT count(*) FROM mails) AS n_mails)
            SELECT added, skipped, updated, flagged, warnings, '{fv.SUBJECT_PREFIX} — 31/01' AS subject,
              '## 🔧 Dispatch Summary' || chr(10) || CASE WHEN n_mails > 1 THEN n_mails || ' runs'
              ELSE '1 run' END || ' processed · ' || added || ' jobs added · ' || skipped
              || ' skipped as duplicate · ' || updated || ' cells updated · ' || flagged
              || ' to approve' || chr(10) || chr(10) || '## ⚠️ Dispatch warnings — needs a look'
              || chr(10) || lines || chr(10) || chr(10) || parts AS body,
              (SELECT arg_max(views, name) FROM mails) AS mails_yesterday,
              CAST(9 AS BIGINT) AS mails_week FROM sums"""),
    }
