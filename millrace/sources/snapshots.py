"""Snapshot sets: names, files and the partitioned table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import diff
from millrace.operators.scan import FIELDS
from millrace.session import settle

# Year, month, day, hour and minute in front of the label.
NAME = r"^(\d{1,4})-(\d{1,2})-(\d{1,2})-(\d{2})(\d{2}|\d(?=-|$))"


def name_time(file_name: Column) -> Column:
    """The time in a snapshot name, NULL if it has none."""
    part = [F.regexp_extract(file_name, NAME, n).try_cast("int") for n in range(1, 6)]
    return F.when(file_name.rlike(NAME),
                  F.try_make_timestamp_ntz(*part, F.lit(0)))


def name_label(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"^(?:[^-]*-){4}(.*?)(?:\.json)?$", 1)


def parsed_names(names: DataFrame) -> DataFrame:
    """(snap_ts, label, file_name) of the names that are snapshot names."""
    name = F.col("file_name")
    return (names.where(F.endswith(name, F.lit(".json")))
            .select(name_time(name).alias("snap_ts"), name_label(name).alias("label"), "file_name")
            .where("snap_ts is not null"))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """All snapshot files of a folder (each a JSON list of records) as one snapshot set."""
    schema = ", ".join(f"`{f}` string" for f in FIELDS)
    rows = spark.read.schema(schema).option("multiLine", True).json(
        folder, pathGlobFilter="*.json")
    name = F.col("_metadata.file_name")
    return (rows.select(name_time(name).alias("snap_ts"), name_label(name).alias("label"),
                        F.monotonically_increasing_id().alias("row_no"), *FIELDS)
            .where("snap_ts is not null"))


def write_snapshot(table: DataFrame, folder: str, snap_ts: str, label: str) -> None:
    """Keep the whole table as the partition of one time and label; a repeat replaces it."""
    stamp = F.date_format(F.lit(snap_ts).cast("timestamp"), "yyyy-MM-dd HH:mm:00")
    (table.select(stamp.alias("snap_ts"), F.lit(label).alias("label"), "row_no", *FIELDS)
     .write.partitionBy("snap_ts", "label").option("partitionOverwriteMode", "dynamic")
     .mode("overwrite").parquet(folder))


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    fields = ", ".join(f"`{f}` string" for f in FIELDS)
    return (spark.read.schema(f"row_no long, {fields}, snap_ts string, label string")
            .parquet(folder).withColumn("snap_ts", F.col("snap_ts").cast("timestamp_ntz")))


def prune(spark: SparkSession, folder: str, as_of, days: int, protected: DataFrame | None = None) -> DataFrame:
    """Remove the partitions of snapshots older than the retention time and return their (snap_ts, label).

    Only partition folders are listed and deleted; no row is read. `protected` (snap_ts, label) stays whatever its age: give it
    the snapshots that open reports start from, see `diff.needed_by`. Removing again changes nothing.
    """
    old = diff.expired(read_snapshots(spark, folder), as_of, days).where("expired").select("snap_ts", "label")
    if protected is not None:
        old = old.join(protected.select("snap_ts", "label"), ["snap_ts", "label"], "left_anti")
    old = settle(old, "expired")
    path_of, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    files = path_of(folder).getFileSystem(conf)
    name = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for row in old.toLocalIterator():
        parts = (("snap_ts", str(row["snap_ts"])), ("label", row["label"]))
        files.delete(path_of("/".join([folder.rstrip("/"), *(f"{k}={name.escapePathName(v)}" for k, v in parts)])), True)
    return old
