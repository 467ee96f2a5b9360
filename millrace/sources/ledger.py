"""The ledger of threads that were taken in: JSON lines in, JSON lines out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace import fixed_values as fv
from millrace.functions.text import present
from millrace.operators.extract import header, ledger_entries, source_tag

SHAPE = "thread_id string, date_fetched string, source string, subject string, file string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """The entries of JSON-lines files. Lines that do not parse or name no thread are left out."""
    lines = spark.read.text(path).select(F.from_json("value", SHAPE).alias("e")).select("e.*")
    return lines.where("thread_id is not null")


def entries(messages: DataFrame, as_of) -> DataFrame:
    """What to remember of each message taken in: thread, time, source, subject and file."""
    subject = F.coalesce(F.nullif(present(header(F.col("headers"), "Subject")), F.lit("")),
                         F.lit(fv.DIGEST_NO_SUBJECT))
    return ledger_entries(messages.select(
        "thread_id", source_tag(header(F.col("headers"), "From")).alias("source"), subject.alias("subject")), as_of)
