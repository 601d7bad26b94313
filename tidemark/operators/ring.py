"""The ring of a table: partitions by their first key, lookups of keys and ranges in it.

A key belongs to the partition with the largest ``hash_start`` that is not above it.  Keys
below the first start have no owner (``on_miss="error"`` drops them from point reads) or that of
the last partition (``on_miss="wrap"``, for writes and ranges).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.functions.checks import bounds

#: Starts of a table up to which keys are compared with all of them in a join; beyond it they are looked up by binary search.
JOINED_STARTS = 128


def intervals(partitions: DataFrame) -> DataFrame:
    """Partitions with ``next_start`` (null for the last of a table)."""
    return partitions.withColumn("next_start", F.lead("hash_start").over(Window.partitionBy("table_id").orderBy("hash_start")))


def floor_lookup(keys: DataFrame, starts: DataFrame, columns: list[str], key: str = "partition_key") -> DataFrame:
    """Rows with ``hash_start`` and further columns of the start at or below their key (null: none), by table.

    ``starts`` is metadata: one row a partition.  With few starts a table, they are broadcast
    as intervals and joined on the table's id with the bounds as a condition.  With more, that
    would compare each key with each start, so sorted starts are broadcast as arrays and
    searched; their size is a few bytes a start.
    """
    most = starts.groupBy("table_id").count().agg(F.max("count")).first()[0] or 0
    columns = [c for c in columns if c != "hash_start"]
    named = starts.select(F.col("table_id").alias("ring_table"), "hash_start", *columns)
    if most <= JOINED_STARTS:
        ring = named.withColumn("next_start", F.lead("hash_start").over(Window.partitionBy("ring_table").orderBy("hash_start")))
        inside = (F.col("table_id") == F.col("ring_table")) & (F.col(key) >= F.col("hash_start")) & (F.col("next_start").isNull() | (F.col(key) < F.col("next_start")))
        return keys.join(F.broadcast(ring), inside, "left").drop("ring_table", "next_start")
    sorted_starts = {r["table_id"]: np.array(r["s"]) for r in starts.groupBy("table_id").agg(F.array_sort(F.collect_list("hash_start")).alias("s")).toLocalIterator()}
    shared = keys.sparkSession.sparkContext.broadcast(sorted_starts)

    @F.pandas_udf("long")
    def floor(table: pd.Series, value: pd.Series) -> pd.Series:
        out = pd.Series(pd.array([None] * len(table), dtype="Int64"))
        for t, rows in value.groupby(table).groups.items():
            found = shared.value.get(t)
            if found is not None:
                at = np.searchsorted(found, value[rows].to_numpy(), side="right") - 1
                out[rows] = pd.array(np.where(at < 0, 0, found[at]), dtype="Int64")
                out[rows[at < 0]] = pd.NA
        return out

    looked = keys.withColumn("found_start", floor("table_id", key))
    on = (F.col("table_id") == F.col("ring_table")) & (F.col("found_start") == F.col("hash_start"))
    return looked.join(F.broadcast(named), on, "left").drop("ring_table", "found_start")


def route(keys: DataFrame, partitions: DataFrame, on_miss: str = "error") -> DataFrame:
    """Keys with the start (``hash_start``) and id (``owner``) of the partition that owns them.

    ``error``: keys below the first start aren't routed and drop out; ``wrap``: they go to the
    table's last partition.
    """
    if on_miss not in ("error", "wrap"):
        raise InvalidArgument("on_miss is error or wrap")
    found = floor_lookup(keys, partitions.withColumnRenamed("partition_id", "owner"), ["owner"])
    if on_miss == "error":
        return found.where("hash_start IS NOT NULL")
    last = partitions.groupBy(F.col("table_id").alias("ring_table")).agg(F.max("hash_start").alias("last_start"), F.max_by("partition_id", "hash_start").alias("last_id"))
    wrapped = found.join(F.broadcast(last), F.col("table_id") == F.col("ring_table"), "left")
    missed = F.col("hash_start").isNull()
    return wrapped.withColumn("owner", F.when(missed, F.col("last_id")).otherwise(F.col("owner"))).withColumn("hash_start", F.coalesce("hash_start", "last_start")).where("hash_start IS NOT NULL").drop("ring_table", "last_start", "last_id")


def segments(partitions: DataFrame, lower: int, upper: int) -> DataFrame:
    """A range cut at the starts it spans: (table_id, lo, hi, hash_start, partition_id) in order; what is below the first start is the last partition's."""
    bounds(lower, upper)
    lo, hi = F.lit(lower), F.lit(upper)
    ring = intervals(partitions)
    inside = ring.where((F.col("hash_start") < hi) & (F.col("next_start").isNull() | (F.col("next_start") > lo))).select(
        "table_id", F.greatest("hash_start", lo).alias("lo"), F.least(F.coalesce("next_start", hi), hi).alias("hi"), "hash_start", "partition_id"
    )
    ends = partitions.groupBy("table_id").agg(F.min("hash_start").alias("first"), F.max("hash_start").alias("hash_start"), F.max_by("partition_id", "hash_start").alias("partition_id"))
    below = ends.where(F.col("first") > lo).select("table_id", lo.alias("lo"), F.least("first", hi).alias("hi"), "hash_start", "partition_id")
    return inside.unionByName(below).where("lo < hi").orderBy("table_id", "lo")


def neighbours(partitions: DataFrame) -> DataFrame:
    """Each partition's start with those before and after it around the ring."""
    ring = Window.partitionBy("table_id").orderBy("hash_start")
    whole = Window.partitionBy("table_id")
    return partitions.select(
        "table_id",
        F.coalesce(F.lag("hash_start").over(ring), F.max("hash_start").over(whole)).alias("previous_start"),
        "hash_start",
        F.coalesce(F.lead("hash_start").over(ring), F.min("hash_start").over(whole)).alias("next_start"),
    )


def forwarded(partitions: DataFrame) -> DataFrame:
    """Partitions with the replicas that reads and writes go to, one hop along ``forward_to``.

    Reads go to the source while a split is under way; writes to the partition's own
    replicas, then those of the source that it doesn't have.  A source that isn't there fails.
    """
    source = partitions.select(F.col("table_id").alias("source_table"), F.col("hash_start").alias("source_start"), F.col("replicas").alias("source_replicas"))
    joined = partitions.join(source, (F.col("table_id") == F.col("source_table")) & (F.col("forward_to") == F.col("source_start")), "left")
    there = F.when(F.col("forward_to").isNotNull() & F.col("source_start").isNull(), F.raise_error(F.lit("forward_to names no partition")).cast("array<bigint>"))
    return joined.select(
        "table_id", "hash_start", "partition_id", "forward_to",
        F.coalesce(there, "source_replicas", "replicas").alias("read_replicas"),
        F.coalesce(there, F.array_union("replicas", F.coalesce("source_replicas", F.array().cast("array<bigint>")))).alias("write_replicas"),
    )


def forward_chain(partitions: DataFrame, most: int = 64) -> DataFrame:
    """The end of each partition's chain of ``forward_to`` (table_id, hash_start, target, hops), and the replicas of all partitions along it, in order of id; both are null for a loop or a start that isn't there.

    A hop is a join of metadata; chains end after as many hops as the longest has, at most ``most``.
    """
    own = F.col("replicas") if "replicas" in partitions.columns else F.array().cast("array<bigint>")
    link = partitions.select(F.col("table_id").alias("t"), F.col("hash_start").alias("s"), F.col("forward_to").alias("next"), own.alias("more"))
    at = partitions.select("table_id", "hash_start", F.col("hash_start").alias("target"), F.col("forward_to").alias("ahead"), own.alias("replicas"), F.array("hash_start").alias("seen"), F.lit(0).alias("hops"))
    for _ in range(most):
        if at.where("ahead IS NOT NULL").isEmpty():
            break
        moved = at.join(link, (F.col("table_id") == F.col("t")) & (F.col("ahead") == F.col("s")), "left")
        lost = F.col("ahead").isNotNull() & (F.col("s").isNull() | F.array_contains("seen", F.col("ahead")))
        at = moved.select(
            "table_id", "hash_start",
            F.when(F.col("ahead").isNull(), F.col("target")).when(~lost, F.col("ahead")).alias("target"),
            F.when(F.col("ahead").isNotNull() & ~lost, F.col("next")).alias("ahead"),
            F.when(F.col("ahead").isNull() | lost, F.col("seen")).otherwise(F.array_append("seen", F.col("ahead"))).alias("seen"),
            F.when(F.col("ahead").isNull() | lost, F.col("replicas")).otherwise(F.array_union("replicas", "more")).alias("replicas"),
            (F.col("hops") + F.when(F.col("ahead").isNull() | lost, 0).otherwise(1)).alias("hops"),
        )
    return at.select("table_id", "hash_start", "target", "hops", F.when(F.col("target").isNotNull(), F.array_sort("replicas")).alias("replicas"))
