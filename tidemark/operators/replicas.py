"""Physical copies: which nodes a key is on, writes to all of them, copies between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.checks import bounds
from tidemark.functions.values import trimmed_url
from tidemark.operators.lww import compact
from tidemark.operators.ring import forwarded, route, segments
from tidemark.schema import KEYS, RECORDS


def replica_urls(routed: DataFrame, nodes: DataFrame, replicas: str = "replicas") -> DataFrame:
    """Rows by the distinct addresses of their replicas; a replica without a node fails."""
    keys = [c for c in routed.columns if c != replicas]
    each = routed.select(*keys, F.explode(replicas).alias("replica"))
    named = each.join(F.broadcast(nodes.select(F.col("node_id").alias("replica"), "url")), "replica", "left")
    url = F.when(F.col("url").isNull(), F.raise_error(F.lit("a replica's node doesn't exist"))).otherwise(trimmed_url())
    return named.select(*keys, url.alias("url")).distinct()


def table_nodes(partitions: DataFrame) -> DataFrame:
    """The distinct nodes of each table."""
    return partitions.select("table_id", F.explode("replicas").alias("node_id")).distinct()


def obsolete(partitions: DataFrame, kept: str = "kept", replicas: str = "replicas") -> DataFrame:
    """Replicas that aren't kept."""
    return partitions.withColumn("obsolete", F.array_except(replicas, kept))


def retained(partitions: DataFrame, total: int) -> DataFrame:
    """The first replicas, at most so many."""
    return partitions.withColumn("kept", F.slice("replicas", 1, total))


def distinct_replicas(partitions: DataFrame) -> DataFrame:
    """Whether a partition names each replica once."""
    return partitions.withColumn("is_distinct", F.size(F.array_distinct("replicas")) == F.size("replicas"))


def rotated(replicas: list[int], by: int) -> list[int]:
    return replicas[by % len(replicas) :] + replicas[: by % len(replicas)] if replicas else []


def replicated_writes(writes: DataFrame, partitions: DataFrame) -> DataFrame:
    """Each write once for each node that has to store it (column ``node_id``): the owner's replicas, and the source's while a split is under way."""
    targets = forwarded(partitions).select(F.col("table_id").alias("t"), F.col("hash_start").alias("s"), "write_replicas")
    routed = route(writes, partitions, on_miss="wrap")
    placed = routed.join(F.broadcast(targets), (F.col("table_id") == F.col("t")) & (F.col("hash_start") == F.col("s")))
    return placed.select(F.explode("write_replicas").alias("node_id"), *writes.columns)


def visible_prefix(replicated: DataFrame, applied: DataFrame) -> DataFrame:
    """What each node has of writes that are acknowledged before all replicas have them: the log up to its ``applied_seq``."""
    return replicated.join(F.broadcast(applied), "node_id").where("seq <= applied_seq").drop("applied_seq")


def apply_replicated(replicated: DataFrame) -> DataFrame:
    """The copies that nodes hold once they have applied their writes."""
    return compact(replicated, ["node_id", *KEYS])


def copy_range(copies: DataFrame, table_id: int, lower: int, upper: int, sources: list[int], targets: list[int], partition_id: str) -> DataFrame:
    """All copies after every version in the range, tombstones too, was written from the sources to each target under a new label."""
    bounds(lower, upper)
    moved = copies.where((F.col("table_id") == table_id) & (F.col("partition_key") >= lower) & (F.col("partition_key") < upper) & F.col("node_id").isin(sources))
    written = moved.select(F.explode(F.array(*(F.lit(t).cast("long") for t in targets))).alias("node_id"), *KEYS, "data", "timestamp", "deleted", F.lit(partition_id).alias("partition_id"), F.lit(1).alias("seq"))
    before = copies.select("node_id", *KEYS, "data", "timestamp", "deleted", "partition_id", F.lit(0).alias("seq"))
    return compact(before.unionByName(written), ["node_id", *KEYS])


def delete_copies(copies: DataFrame, table_id: int, lower: int | None, upper: int | None, nodes: list[int]) -> DataFrame:
    """Copies without those of some nodes in a range; a missing bound is unbounded."""
    hit = (F.col("table_id") == table_id) & F.col("node_id").isin(nodes)
    hit &= (F.col("partition_key") >= lower) if lower is not None else F.lit(True)
    hit &= (F.col("partition_key") < upper) if upper is not None else F.lit(True)
    return copies.where(~hit)


def choose_replica(replicas: str = "read_replicas", *, by: list[str], seed: int = 0) -> Column:
    """One of the replicas, the same for the same columns and seed: what stands in for a random choice."""
    return F.element_at(replicas, (F.pmod(F.xxhash64(F.lit(seed), *by), F.size(replicas)) + 1).cast("int"))


def range_replicas(partitions: DataFrame, lower: int, upper: int, seed: int = 0) -> DataFrame:
    """The segments of a range with the node that each is read from."""
    targets = forwarded(partitions).select(F.col("table_id").alias("t"), F.col("hash_start").alias("s"), "read_replicas")
    cut = segments(partitions, lower, upper)
    return cut.join(F.broadcast(targets), (F.col("table_id") == F.col("t")) & (F.col("hash_start") == F.col("s"))).select("table_id", "lo", "hi", "partition_id", choose_replica(by=["table_id", "lo"], seed=seed).alias("node_id"))


def empty_copies(spark) -> DataFrame:  # noqa: ANN001
    return spark.createDataFrame([], f"node_id long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in RECORDS)}")
