"""Generated records and operations for load runs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.schema import LONG_MIN


def spread_keys(keys: int) -> list[int]:
    """So many keys over the whole signed 64-bit range, both ends included."""
    if keys < 1:
        raise InvalidArgument("keys must be positive")
    return [LONG_MIN + ((1 << 64) - 1) * i // max(keys - 1, 1) for i in range(keys)]


def records(spark: SparkSession, table_id: int, n: int, keys: int = 100, *, hot_key: int | None = None, base: int = 0, run_id: str = "run", padding: int = 0) -> DataFrame:
    """Records 0 to n-1: partition keys in turn (or one hot key), secondary keys from ``base`` on."""
    payload = json.dumps({"load_run": run_id, "padding": "x" * padding}, separators=(",", ":")).encode()
    names = F.array(*map(F.lit, spread_keys(keys) if hot_key is None else [hot_key]))
    at = (F.col("id") % F.size(names) + 1).cast("int")
    return spark.range(n).select(F.col("id").alias("index"), F.lit(table_id).cast("long").alias("table_id"), F.element_at(names, at).cast("long").alias("partition_key"), (F.col("id") + base).alias("secondary_key"), F.lit(payload).alias("data"))


def operations(spark: SparkSession, n: int, records: int, read_percent: int, seed: int = 0) -> DataFrame:
    """Random operations: a record each, and whether it is read."""
    return spark.range(n).select(F.col("id").alias("seq"), F.floor(F.rand(seed) * records).cast("long").alias("index"), (F.rand(seed + 1) * 100 < read_percent).alias("read"))
