"""Reads of one table's records: by key, partition key and range, with counts and sizes.

Key predicates are plain comparisons, so they reach the Parquet scan; on files sorted by key
they skip row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import NotFound
from tidemark.functions.checks import bounds, sampled
from tidemark.functions.values import payload_bytes

COLUMNS = ["table_id", "partition_key", "secondary_key", "timestamp", "deleted", "data", "partition_id"]


def live(records: DataFrame, include_deleted: bool = False) -> DataFrame:
    return records if include_deleted else records.where(~F.col("deleted"))


def tombstones(records: DataFrame) -> DataFrame:
    return records.where("deleted")


def point(records: DataFrame, table_id: int, partition_key: int, secondary_key: int, include_deleted: bool = False) -> DataFrame:
    """The record with this key: a row, or none."""
    return live(records.where((F.col("table_id") == table_id) & (F.col("partition_key") == partition_key) & (F.col("secondary_key") == secondary_key)), include_deleted)


def found(rows: DataFrame) -> DataFrame:
    """The rows, or NotFound if there are none (runs a job)."""
    if rows.isEmpty():
        raise NotFound("no such record")
    return rows


def partition_key_scan(records: DataFrame, table_id: int, partition_key: int, include_deleted: bool = False) -> DataFrame:
    return live(records.where((F.col("table_id") == table_id) & (F.col("partition_key") == partition_key)), include_deleted).orderBy("secondary_key")


def within(records: DataFrame, table_id: int, lower: int, upper: int, include_deleted: bool = False) -> DataFrame:
    """Records with lower <= partition_key < upper; reversed and empty bounds are an error."""
    bounds(lower, upper)
    return live(records.where((F.col("table_id") == table_id) & (F.col("partition_key") >= lower) & (F.col("partition_key") < upper)), include_deleted)


def range_scan(records: DataFrame, table_id: int, lower: int, upper: int, include_deleted: bool = False) -> DataFrame:
    return within(records, table_id, lower, upper, include_deleted).orderBy("partition_key", "secondary_key")


def count_range(records: DataFrame, table_id: int, lower: int, upper: int) -> DataFrame:
    return within(records, table_id, lower, upper).agg(F.count("*").alias("n_records"))


def range_size(records: DataFrame, table_id: int, lower: int, upper: int) -> DataFrame:
    """Bytes of live payloads in a range; 0 if there are none."""
    return within(records, table_id, lower, upper).agg(F.coalesce(F.sum(payload_bytes()), F.lit(0)).cast("long").alias("payload_bytes"))


def file_size(records: DataFrame) -> DataFrame:
    """Bytes of the files that the table is read from."""
    files = records.select("_metadata.file_path", "_metadata.file_size").distinct()
    return files.agg(F.coalesce(F.sum("file_size"), F.lit(0)).cast("long").alias("file_bytes"))


def read_accesses(returned: DataFrame, time_ms: int) -> DataFrame:
    """The accesses that a read makes: one for each row it returns whose stored label is neither null nor empty, tombstones too."""
    return returned.where(sampled()).select("table_id", "partition_key", F.lit(False).alias("is_write"), "partition_id", F.lit(time_ms).cast("long").alias("time_ms"))


def write_accesses(mutations: DataFrame, time_ms: int) -> DataFrame:
    """The accesses that applied writes make: one for each that came with a label, stale ones and tombstones too; physical deletes make none."""
    return mutations.where((F.col("kind") == "write") & sampled()).select("table_id", "partition_key", F.lit(True).alias("is_write"), "partition_id", F.lit(time_ms).cast("long").alias("time_ms"))
