"""Schemas of all tables, and fixed values."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DecimalType, DoubleType, LongType, StringType, StructField, StructType

LONG_MIN, LONG_MAX = -(1 << 63), (1 << 63) - 1
#: Accesses kept for each (table, partition), and milliseconds that statistics are kept.
SAMPLE_BOUND = 65_536
RETENTION_MS = 30 * 24 * 3600 * 1000
FLUSH_MS = 60_000
#: Writes that may wait, rows of a write group, seconds of a lease, latencies kept by a load run.
BACKLOG_LIMIT = 65_536
WRITE_GROUP = 256
LEASE_SECONDS = 300
LATENCIES = 10_000
#: Operations per second and node above which a partition is hot, and below which it is cold.
HOT_WRITES, HOT_READS, COLD = 200.0, 1000.0, 50.0
KEYS = ["table_id", "partition_key", "secondary_key"]


def _of(**fields: object) -> StructType:
    return StructType([StructField(k, v, True) for k, v in fields.items()])


L, S, B, X, D = LongType(), StringType(), BooleanType(), BinaryType(), DoubleType()
RECORDS = _of(table_id=L, partition_id=S, partition_key=L, secondary_key=L, data=X, timestamp=L, deleted=B)
REPLICA_RECORDS = StructType([StructField("node_id", L, True), *RECORDS.fields])
MUTATIONS = _of(seq=L, kind=S, table_id=L, partition_key=L, secondary_key=L, data=X, timestamp=L, deleted=B, partition_id=S, lower_bound=L, upper_bound=L)
TABLES = _of(table_id=L, table_name=S, owner=L, owner_control_node=L, backup_control_node=L, partition_key_name=S, sort_key_name=S, secret_key_id=L, is_ready=B)
PARTITIONS = _of(table_id=L, hash_start=L, partition_id=S, forward_to=L, replicas=ArrayType(L))
NODES = _of(node_id=L, url=S)
LEASES = _of(table_id=L, hash_start=L, lease_end=L, lock_token=S)
ACCESSES = _of(table_id=L, partition_key=L, is_write=B, partition_id=S, time_ms=L)
ACCESS_STATISTICS = _of(
    table_id=L, partition_id=S, start_ms=L, end_ms=L, reads_per_second=D, writes_per_second=D, contributing_nodes=L, average_write_position=L, median_write_position=L, read_count=L, write_count=L, write_position_sum=S, window_seconds=D
)
COMPLETIONS = _of(seq=L, status=S, read=B, seed=B, latency=D, error=S)
#: Sums of 64-bit positions are exact in it.
WIDE = DecimalType(38, 0)
