"""Composite reads and writes over replicas: what a client asks for, as one plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument, NotReady
from tidemark.functions.checks import bounds
from tidemark.functions.values import decrypted
from tidemark.operators.lww import reconcile
from tidemark.operators.replicas import choose_replica, range_replicas, replicated_writes
from tidemark.operators.ring import forwarded, route
from tidemark.schema import KEYS


def ready(tables: DataFrame, table_id: int) -> None:
    """Fails unless the table is there, ready and not encrypted."""
    row = tables.where(F.col("table_id") == table_id).first()
    if row is None or not row["is_ready"]:
        raise NotReady(f"table {table_id} isn't ready")
    decrypted(row["secret_key_id"])


def _read_from(keys: DataFrame, partitions: DataFrame, on_miss: str) -> DataFrame:
    targets = F.broadcast(forwarded(partitions).select(F.col("table_id").alias("t"), F.col("hash_start").alias("s"), "read_replicas"))
    routed = route(keys.select(*KEYS).distinct(), partitions, on_miss)
    return routed.join(targets, (F.col("table_id") == F.col("t")) & (F.col("hash_start") == F.col("s"))).select(*KEYS, "read_replicas")


def get_consistent(keys: DataFrame, copies: DataFrame, partitions: DataFrame, on_miss: str = "error") -> DataFrame:
    """The live records of keys that all replicas of their owners agree on; tombstones are dropped after the copies are compared."""
    asked = _read_from(keys, partitions, on_miss).select(*KEYS, F.explode("read_replicas").alias("node_id"))
    return reconcile(copies.join(asked, ["node_id", *KEYS])).where(~F.col("deleted"))


def get_inconsistent(keys: DataFrame, copies: DataFrame, partitions: DataFrame, on_miss: str = "error", seed: int = 0) -> DataFrame:
    """The live records of keys as the first of their replicas that has them says, in an order that follows from key and seed; a tombstone is an answer."""
    asked = _read_from(keys, partitions, on_miss).select(*KEYS, F.explode("read_replicas").alias("node_id"))
    rank = F.struct(F.xxhash64(F.lit(seed), "node_id", *KEYS), "node_id")
    answer = copies.join(asked, ["node_id", *KEYS]).groupBy(*KEYS).agg(F.min_by(F.struct("timestamp", "deleted", "data", "partition_id"), rank).alias("v"))
    return answer.select(*KEYS, "v.*").where(~F.col("deleted"))


def fetch_range(copies: DataFrame, partitions: DataFrame, table_id: int, lower: int, upper: int, seed: int = 0) -> DataFrame:
    """Live records in a range, in order of key, each segment from one replica; equal bounds give none."""
    bounds(lower, upper, empty=True)
    if lower == upper:
        return copies.limit(0).select(*KEYS, "timestamp", "deleted", "data", "partition_id")
    ring = partitions.where(F.col("table_id") == table_id)
    cut = range_replicas(ring, lower, upper, seed).select(F.col("table_id").alias("t"), "lo", "hi", F.col("node_id").alias("n"))
    mine = copies.where((F.col("table_id") == table_id) & (F.col("partition_key") >= lower) & (F.col("partition_key") < upper) & ~F.col("deleted"))
    read = mine.join(F.broadcast(cut), (F.col("node_id") == F.col("n")) & (F.col("partition_key") >= F.col("lo")) & (F.col("partition_key") < F.col("hi")))
    return read.select(*KEYS, "timestamp", "deleted", "data", "partition_id").orderBy("partition_key", "secondary_key")


def put(writes: DataFrame, partitions: DataFrame, consistent: bool = True) -> DataFrame:
    """What each node is sent for these writes; an inconsistent write needs a second replica to go on without waiting."""
    if not consistent and not forwarded(partitions).where(F.size("write_replicas") < 2).isEmpty():
        raise InvalidArgument("an inconsistent write needs two replicas")
    return replicated_writes(writes, partitions)


__all__ = ["choose_replica", "fetch_range", "get_consistent", "get_inconsistent", "put", "ready"]
