"""Reading a record table: every field present, empty instead of missing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace import fixed_values as fv
from millrace.functions.identity import name_key
from millrace.functions.text import present

FIELDS = list(fv.FIELD_LABELS)


def read_records(source: DataFrame) -> DataFrame:
    """All fields as strings, plus row_no. Rows with neither company nor title are no records."""
    have = set(source.columns)
    fields = [(present(F.col(f).cast("string")) if f in have else F.lit("")).alias(f)
              for f in FIELDS]
    return (source.select("row_no", *fields)
            .where((F.col("company") != "") | (F.col("title") != "")))


def keyed_records(source: DataFrame, ignored: Iterable[str]) -> DataFrame:
    """The table as handed to readers: each record with its row number and name key."""
    return read_records(source).select(
        F.col("row_no").alias("_row"),
        name_key(F.col("company"), F.col("title"), ignored).alias("_key"), *FIELDS)
