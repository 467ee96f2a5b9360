"""Record-shaped inputs projected from the given tables.

The given tables hold no intake records, so every input is a deterministic projection of
whole tables. The texts are SQL that Spark and DuckDB both accept; the comparison SQL uses
the same ones. Braces name the tables.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators.scan import read_records
from millrace.session import prepare, scratch_path, settle, spread_small

# Records before this time are the current table, those from it on are incoming.
SPLIT = "2024-01-04 00:00:00"
AS_OF = "2024-01-31 12:00:00"
PLACES = ["berlin"]
HOME = "nation_1"
# Message intake looks back this many days from this time.
INTAKE_AT = "2024-01-09 12:00:00"
INTAKE_DAYS = 7

POSTINGS = """
SELECT e.event_id AS ord, e.ts AS ts, e.event_type AS source, n.n_name AS location,
  CASE e.event_id % 7 WHEN 0 THEN upper(c.c_name) WHEN 1 THEN 'The ' || c.c_name
       ELSE c.c_name END AS company,
  CASE WHEN e.event_id % 23 = 0 THEN ''
       WHEN e.event_id % 3 = 0 THEN p.p_name
       WHEN e.event_id % 3 = 1 THEN p.p_name || ' (Remote)'
       ELSE upper(p.p_name) || ' - Hybrid' END AS title,
  CASE WHEN e.event_id % 11 < 3 THEN
         'https://Boards.example.com/viewjob/?utm=x&jk='
         || CAST(e.event_id - e.event_id % 3 AS STRING)
       WHEN e.event_id % 11 < 5 THEN
         'https://jobs.example.com/p/' || CAST(1000000 + e.event_id - e.event_id % 2 AS STRING)
         || '/'
       WHEN e.event_id % 11 = 5 THEN
         'https://mail.example.com/ls/click?upn=' || CAST(e.event_id AS STRING)
       WHEN e.event_id % 11 = 6 THEN 'Apply'
       WHEN e.event_id % 11 = 7 THEN ''
       WHEN e.event_id % 11 < 10 THEN
         'https://boards.example.com/embed?gh_jid=' || CAST(1000000 + e.event_id AS STRING)
       ELSE 'HTTP://upper.example.com/x' END AS link,
  CASE WHEN e.event_id % 6 < 2 THEN
         'req ' || CAST(2000000 + e.event_id - e.event_id % 100 AS STRING)
       ELSE '' END AS notes,
  CASE WHEN e.value < 10 THEN '🟢 Strong' WHEN e.value < 25 THEN '🟡 Good Shot'
       ELSE '🔴 Stretch' END AS fit,
  CASE e.event_type WHEN 'click' THEN '📞 Screening' WHEN 'signup' THEN '📤 Applied'
       WHEN 'purchase' THEN '🎉 Offer' WHEN 'error' THEN '❌ Rejected' ELSE '' END AS stage,
  CASE WHEN e.event_id % 6 = 0 THEN '⭐ To Apply' WHEN e.event_id % 6 = 1 THEN '✅ Applied'
       WHEN e.event_id % 12 = 2 THEN '❌ Not Relevant' WHEN e.event_id % 12 = 3 THEN 'maybe'
       ELSE '' END AS move
FROM (SELECT *, event_id % (SELECT count(*) FROM {part}) AS part_no FROM {events}) e
JOIN {customer} c ON c.c_custkey = e.user_id
JOIN {part} p ON p.p_partkey = e.part_no
JOIN {nation} n ON n.n_nationkey = c.c_nationkey
"""

# The current table: every valid record so far, copies of a name key included.
BOARD = """
SELECT ord + 2 AS row_no, move, stage, company, title, fit, location, source, link,
  CASE WHEN ord % 10 < 3 THEN notes || ' | ⚠️ For Review — old | kept' ELSE notes END AS notes,
  CASE source WHEN 'purchase' THEN 'note click' WHEN 'signup' THEN 'call booked  '
       ELSE '' END AS process
FROM {postings} WHERE ts < @split AND title <> '' AND link LIKE 'http%'
"""

# The same as raw cells: some missing, some rows empty.
CELLS = """
SELECT ord + 2 AS row_no, CASE WHEN title <> '' THEN company END AS company, title, stage,
  CASE WHEN link LIKE 'http%' THEN link END AS link
FROM {postings}
"""

INCOMING = "SELECT * FROM {postings} WHERE ts >= @split"

# Update items as columns; empty cells are keys the item does not have.
UPDATES = """
SELECT ord, ts, company, title, CASE WHEN stage <> '' THEN stage END AS stage,
  CASE WHEN notes <> '' THEN notes END AS notes, '100k' AS salary_range,
  CASE WHEN source <> 'view' THEN 'note ' || source END AS process_append,
  CASE WHEN source IN ('view', 'signup') THEN 'direct ' || fit END AS process,
  'https://mail.example.com/' || CAST(ord AS STRING) AS gmail_link
FROM {incoming} WHERE source <> 'error'
"""
UPDATE_KEYS = ["company", "title", "stage", "notes", "salary_range", "process_append", "process",
               "gmail_link"]

FLAGS = """
SELECT ord, ts, company, title, 'check ' || source || ' ' || fit AS reason,
  'https://mail.example.com/' || CAST(ord AS STRING) AS gmail_link
FROM {incoming} WHERE source IN ('error', 'click')
"""
FLAG_KEYS = ["company", "title", "reason", "gmail_link"]

# Snapshots: every evening of the data but two, one evening twice, and every noon.
SNAP_TIMES = """
SELECT DISTINCT day || ' 23:55:00' AS snap_at, 'baseline' AS label FROM (@days) d
WHERE day NOT IN ('2024-01-12', '2024-01-13')
UNION ALL
SELECT DISTINCT day || ' 23:55:00' AS snap_at, 'before-upsert' AS label FROM (@days) d
WHERE day = '2024-01-20'
UNION ALL
SELECT DISTINCT day || ' 12:00:00' AS snap_at, 'baseline' AS label FROM (@days) d
"""
DAYS = "SELECT substr(CAST(ts AS STRING), 1, 10) AS day FROM {events}"

# The live table: the last posting of each name, some of them edited since the last snapshot and some removed.
LIVE = """
SELECT ord AS row_no, company, title,
  CASE WHEN ord % 9 = 4 THEN '❌ Not Relevant' ELSE move END AS move,
  CASE WHEN ord % 8 = 3 THEN '📤 Applied' ELSE stage END AS stage
FROM (SELECT *, row_number() OVER (PARTITION BY company, title ORDER BY ts DESC, ord DESC) AS place FROM {postings}) p
WHERE place = 1 AND ord % 13 <> 6
"""

# One file name per event; some are no snapshot names.
FILE_NAMES = """
SELECT ord, CASE WHEN ord % 10 = 3 THEN 'export-' ELSE '' END
  || substr(CAST(ts AS STRING), 1, 10) || '-' || substr(CAST(ts AS STRING), 12, 2)
  || CASE WHEN ord % 10 = 4 THEN 'h0' ELSE substr(CAST(ts AS STRING), 15, 2) END
  || '-' || CASE source WHEN 'view' THEN 'before-upsert' ELSE 'baseline' END || '.json' AS file_name
FROM {postings}
"""

MESSAGES = """
SELECT page_id AS message_id, url,
  'thread-' || lpad(CAST(page_id - page_id % 2 AS STRING), 8, '0') AS thread_id,
  CASE page_id % 6 WHEN 0 THEN 'Alerts <hello@jobalert.indeed.com>'
    WHEN 1 THEN 'jobalerts-noreply@linkedin.com' WHEN 2 THEN 'jobs-noreply@linkedin.com'
    WHEN 3 THEN 'clever@mail.example.com' WHEN 4 THEN 'someone@example.org'
    ELSE 'JOBALERTS-NOREPLY@LINKEDIN.COM' END AS sender,
  CASE WHEN page_id % 9 = 0 THEN '' ELSE 'Digest ' || CAST(page_id AS STRING) END AS subject,
  page_id AS hours,
  html || CASE page_id % 5
    WHEN 1 THEN '<a href="https://track.example.com/r?u=viewjob%3Fjk%3Dabcdef'
      || lpad(CAST(page_id AS STRING), 8, '0') || '">a</a><a href="https://x.example.com/?jk=abcdef'
      || lpad(CAST(page_id AS STRING), 8, '0') || '">b</a>'
    WHEN 2 THEN '<a href="https://www.linkedin.com/comm/jobs/view/'
      || CAST(3000000 + page_id AS STRING) || '?trk=1">c</a>'
    WHEN 3 THEN '<a href="https://boards.example.com/x?gh_jid=' || CAST(40000 + page_id AS STRING)
      || '">d</a><a href="https://news.example.net/1">e</a><a href="http://ads.example.org?x=1">f'
      || '</a><a href="https://news.example.net/2">g</a>'
    WHEN 4 THEN '<a href="https://jobs.lever.co/acme/abcdef'
      || lpad(CAST(page_id AS STRING), 8, '0') || '">h</a>'
    ELSE '' END AS html
FROM {pages}
"""

# Which intent file an incoming posting belongs to.
INTENT_ROWS = """
SELECT *, 'intent-' || lpad(CAST(ord - ord % 500 AS STRING), 10, '0') AS name
FROM {postings} WHERE ts >= @split
"""

# Threads taken in before.
# A rule per site of the pages.
SITE_RULES = """
SELECT host AS source, replace(host, '.', '\\.') || '/(?:en|fr|de|es)/([0-9]+)' AS pattern,
  'https://' || host || '/' || chr(123) || chr(125) AS template, host || '/' AS literal
FROM (SELECT DISTINCT lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM {pages}) h WHERE host <> ''
"""

LEDGER = "SELECT thread_id FROM {messages} WHERE url LIKE '%/en/%'"

# Plain parts: every document goes to one message.
PLAIN_PARTS = """
SELECT doc_id % (SELECT count(*) FROM {pages}) AS message_id, 1 + doc_id AS pos, text
FROM {documents}
"""


def spark_text(text: str) -> str:
    return (text.replace("@split", f"TIMESTAMP_NTZ '{SPLIT}'").replace("@days", DAYS))


def coded(text: Column) -> Column:
    """The URL-safe base64 code of a text."""
    return F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_")


def with_heads(messages: DataFrame) -> DataFrame:
    """Messages with their time and headers."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return (messages.withColumn("sent_ts", start + F.make_dt_interval(F.lit(0), F.col("hours")))
            .withColumn("headers", F.expr("""array(
                struct('X-Test' AS name, '1' AS value), struct('SUBJECT' AS name, subject AS value),
                struct('From' AS name, sender AS value), struct('from' AS name, 'x' AS value))""")))


class Inputs:
    """The derived inputs of one data folder, each a lazy frame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.dir = sf_dir

    @cache
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table whose rows get costly work: over all cores even if it is one small file."""
        return spread_small(self.table(name))

    def _sql(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(spark_text(text), **frames)

    @cache
    def postings(self) -> DataFrame:
        others = {n: self.table(n) for n in ("part", "customer", "nation")}
        return self._sql(POSTINGS, events=self.spread("events"), **others)

    def held(self) -> Inputs:
        """The same inputs with the postings written once, for a query that reads them many times: each reading joins the
        events to the whole of the smaller tables, which go through the driver every time."""
        twin, rows = Inputs(self.spark, self.dir), settle(self.postings(), "postings")
        twin.postings = lambda: rows
        return twin

    @cache
    def board(self) -> DataFrame:
        return read_records(self._sql(BOARD, postings=self.postings()))

    def cells(self) -> DataFrame:
        return self._sql(CELLS, postings=self.postings())

    @cache
    def incoming(self) -> DataFrame:
        return self._sql(INCOMING, postings=self.postings())

    def _items(self, text: str, keys: list[str]) -> DataFrame:
        rows = self._sql(text, incoming=self.incoming())
        entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("value"))
                                     for k in keys]), lambda e: e["value"].isNotNull())
        return rows.select("ord", "ts", F.map_from_entries(entries).alias("fields"))

    @cache
    def updates(self) -> DataFrame:
        return self._items(UPDATES, UPDATE_KEYS)

    @cache
    def flags(self) -> DataFrame:
        return self._items(FLAGS, FLAG_KEYS)

    def file_names(self) -> DataFrame:
        return self._sql(FILE_NAMES, postings=self.postings())

    @cache
    def snap_times(self) -> DataFrame:
        return (self._sql(SNAP_TIMES, events=self.table("events"))
                .select(F.col("snap_at").cast("timestamp_ntz").alias("snap_ts"), "label"))

    @cache
    def snapshots(self) -> DataFrame:
        """Per snapshot and (company, title) the latest posting before it.

        Postings are first folded to one per name and interval between snapshots, so the
        window below sees at most as many rows per name as there are snapshots.
        """
        times = F.array_sort(F.collect_set("snap_ts"))
        at = self.snap_times().agg(times.alias("times")).scalar()
        rows = self.postings().withColumn("times", at)
        slotted = rows.withColumn("slot", F.size(F.filter(
            "times", lambda t: t <= F.col("ts"))))
        kept = ["move", "stage", "source"]
        folded = (slotted.groupBy("company", "title", "slot").agg(
            F.max_by(F.struct(F.col("ord").alias("row_no"), *kept), F.struct("ts", "ord"))
            .alias("row")).withColumn("times", at))
        nexts = F.lead("slot").over(Window.partitionBy("company", "title").orderBy("slot"))
        until = F.coalesce(nexts, F.size("times"))
        return (folded.withColumn("until", until).where(F.col("slot") < F.col("until"))
                .withColumn("i", F.explode(F.sequence(F.col("slot"), F.col("until") - 1)))
                .select(F.col("times")[F.col("i")].alias("snap_ts"), "company", "title", "row.*")
                .join(self.snap_times(), "snap_ts")
                .where("label <> 'before-upsert' OR source <> 'view'"))

    def live(self) -> DataFrame:
        return self._sql(LIVE, postings=self.postings())

    def reports(self) -> DataFrame:
        """A report every noon."""
        noon = self.snap_times().where("date_format(snap_ts, 'HH') = '12'")
        return noon.select(F.col("snap_ts").alias("report_ts"))

    @cache
    def messages(self) -> DataFrame:
        return with_heads(self._sql(MESSAGES, pages=self.spread("pages")))

    def site_rules(self) -> DataFrame:
        """Rules numbered by their source."""
        rules = self._sql(SITE_RULES, pages=self.table("pages"))
        return rules.withColumn("rule_no", F.xxhash64("source"))  # each source has one rule, so any number will do

    def ledger(self) -> DataFrame:
        return self._sql(LEDGER, messages=self.messages())

    @cache
    def _texts(self) -> DataFrame:
        """The parts of each message as texts."""
        plain = self._sql(PLAIN_PARTS, pages=self.table("pages"), documents=self.spread("documents"))
        return (self.messages().select("message_id", F.lit(0).cast("long").alias("pos"),
                                       F.lit("text/html").alias("mime"), F.col("html").alias("text"))
                .unionByName(plain.withColumn("mime", F.lit("text/plain"))))

    @cache
    def parts(self) -> DataFrame:
        return self._texts().select("message_id", "pos", "mime", coded(F.col("text")).alias("data"))

    def payloads(self) -> DataFrame:
        """The parts of each message as one nested payload: part n lies 1 + n % 5 levels below a multipart of its own.

        Texts are gathered as they are and coded after that: they are shorter and, unlike their codes, compress well.
        """
        open_, close = '{"mimeType":"multipart/mixed","parts":[', "]}"

        def branch(part: Column) -> Column:
            leaf = F.to_json(F.struct(part["mime"].alias("mimeType"), F.struct(coded(part["text"]).alias("data")).alias("body")))
            levels = (1 + part["pos"] % 5).cast("int")
            return F.concat(F.repeat(F.lit(open_), levels), leaf, F.repeat(F.lit(close), levels))

        parts = F.array_sort(F.collect_list(F.struct("pos", "mime", "text")))
        return self._texts().groupBy("message_id").agg(parts.alias("parts")).select("message_id", F.concat(
            F.lit(open_), F.array_join(F.transform("parts", branch), ","), F.lit(close)).alias("payload"))

    @cache
    def documents_by_file(self) -> DataFrame:
        """Intent files (name, value): one per five hundred postings, with some broken ones."""
        named = self._sql(INTENT_ROWS, postings=self.postings())
        upsert = F.to_json(F.struct("company", "title", "link", "notes", "fit", "source", "stage",
                                    "location"))
        # texts made from few bytes of a file: not to be sent to all tasks
        update = self.updates().select("ord", F.to_json("fields").alias("update")).hint("merge")
        flag = self.flags().select("ord", F.to_json("fields").alias("flag")).hint("merge")
        rows = named.select("name", "ord", "source", upsert.alias("upsert")) \
            .join(update, "ord", "left").join(flag, "ord", "left")

        def listed(column: str) -> Column:
            items = F.array_sort(F.collect_list(F.when(F.col(column).isNotNull(),
                                                       F.struct("ord", column))))
            return F.concat(F.lit("["), F.array_join(F.transform(
                items, lambda x: x[column]), ","), F.lit("]"))

        whole = rows.groupBy("name").agg(
            listed("upsert").alias("a"), listed("update").alias("b"), listed("flag").alias("c"),
            F.count_if(F.col("source") == "view").alias("views")).select("name", F.concat(
                F.lit('{"upserts": '), "a", F.lit(', "updates": '), "b", F.lit(', "flags": '), "c",
                F.lit(', "email_md": "'), F.concat(F.lit("part "), "name"),
                F.lit('", "email_subject": ""'), F.lit(', "activity_gmail": {"yesterday": '),
                F.col("views").cast("string"), F.lit(', "week": 9}}')).alias("value"))
        broken = named.select("name").distinct().select(F.explode(F.array(
            F.struct(F.concat("name", F.lit("-list")).alias("name"),
                     F.lit('[{"upserts": []}]').alias("value")),
            F.struct(F.concat("name", F.lit("-half")).alias("name"), F.lit('{"ups').alias("value")),
            F.struct(F.concat("name", F.lit("-text")).alias("name"), F.lit('"done"').alias("value"))
        )).alias("x")).select("x.*")
        return whole.unionByName(broken)

    def outbox(self) -> str:
        """The same written to a new shared folder, one file each."""
        folder = scratch_path(self.spark, "outbox")
        # Tiny rows, each a file of its own: dealt evenly by number, not by bytes, and renamed by the tasks that wrote them
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), self.spark.sparkContext.defaultParallelism)
        (self.documents_by_file().repartition(tasks, "name").write.partitionBy("name")
         .option("mapreduce.fileoutputcommitter.algorithm.version", "2").text(folder))
        return folder
