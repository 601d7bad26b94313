"""Inputs made from the ``events`` table: a log, deletes, rings, replicas, accesses and completions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.checks import sampled
from tidemark.functions.values import micros
from tidemark.schema import LONG_MIN, MUTATIONS, PARTITIONS
from tidemark.sources import log

DAY = 86_400_000_000
#: Places in the log and scopes of the physical deletes.
DELETES = [(2500, log.delete_range(1, -30, -10)), (5000, log.delete_partition_key(2, 10)), (7000, log.delete_table(1))]
#: Starts of a ring that covers all keys, and of one that begins above the lowest.
STARTS, WRAPPING = (LONG_MIN, -20, 30), (-20, 0, 30)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes: days as timestamps, so that many tie; errors are tombstones; sign-ups have no label."""
    ts = micros("ts")
    error = F.col("event_type") == "error"
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        F.lit("write").alias("kind"),
        (1 + F.col("event_id") % 2).cast("long").alias("table_id"),
        (F.col("user_id") - 75).alias("partition_key"),
        (F.col("event_id") % 5).alias("secondary_key"),
        F.when(error, F.lit(b"")).otherwise(F.encode("props", "UTF-8")).alias("data"),
        (ts - F.pmod(ts, F.lit(DAY))).alias("timestamp"),
        error.alias("deleted"),
        F.when(F.col("event_type") != "signup", F.concat(F.lit("p"), (F.col("user_id") % 4).cast("string"))).alias("partition_id"),
        F.lit(None).cast("long").alias("lower_bound"),
        F.lit(None).cast("long").alias("upper_bound"),
    )


def mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The writes with three physical deletes between them."""
    names = [f.name for f in MUTATIONS]
    dels = spark.createDataFrame([tuple({"seq": s, **e}.get(n) for n in names) for s, e in DELETES], MUTATIONS)
    return wal(spark, sf_dir).select(*names).unionByName(dels)


def ring(spark: SparkSession, starts: tuple[int, ...] = STARTS, forwarding: bool = False) -> DataFrame:
    """Two tables' partitions p0, p1, p2 with rotated replicas; with ``forwarding`` the last is being split from the second."""
    rows = [(t, s, f"p{i}", starts[1] if forwarding and i == 2 else None, [(i + j + t) % 4 + 1 for j in range(3)]) for t in (1, 2) for i, s in enumerate(starts)]
    return spark.createDataFrame(rows, PARTITIONS)


def nodes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, f"http://node{i}:80{'/' * (i % 3)}") for i in range(1, 7)], "node_id long, url string")


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes as three replicas have them, each without a different third."""
    each = wal(spark, sf_dir).withColumn("node_id", F.explode(F.array(*(F.lit(n).cast("long") for n in (1, 2, 3)))))
    return each.where((F.col("seq") + F.col("node_id")) % 3 != 0)


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = events(spark, sf_dir).select(F.col("event_id").alias("seq"), F.floor(micros("ts") / 1000).cast("long").alias("time_ms"), (F.col("user_id") % 3).alias("node_id"))
    log_rows = wal(spark, sf_dir).select("seq", "table_id", "partition_key", "partition_id", (F.col("seq") % 3 != 0).alias("is_write"))
    return log_rows.join(times, "seq").where(sampled())


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.col("event_type") == "error"
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"), F.when(failed, "500").when(F.col("event_id") % 7 == 0, "404").otherwise("204").alias("status"), F.col("event_type").isin("view", "click").alias("read"),
        (F.col("event_type") == "signup").alias("seed"), F.col("value").alias("latency"), F.when(failed, F.lit("failed")).alias("error"),
        F.floor(micros("ts") / 1000).cast("long").alias("time_ms"), (F.col("user_id") % 5).alias("worker"),
    )
