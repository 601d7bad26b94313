"""Access statistics of partitions: bounded samples, rates and positions, merged over nodes, and what they call for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.checks import history, sampled
from tidemark.functions.values import truncated_average
from tidemark.schema import COLD, HOT_READS, HOT_WRITES, RETENTION_MS, SAMPLE_BOUND, WIDE

GROUP = ["table_id", "partition_id"]
#: Parts in which the newest accesses of a partition are first looked for.
SALTS = 64


def newest(accesses: DataFrame, bound: int = SAMPLE_BOUND, group: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The newest ``bound`` rows of each group.

    Each of SALTS parts of a group is cut to the bound, then the group: a group with most of
    the rows is worked on by many tasks, and the last sees a bounded number of rows.
    """
    group, order = group or GROUP, order or ["time_ms", "seq"]
    newest_first = [F.col(c).desc() for c in order]
    parts = accesses.withColumn("salt", F.pmod(F.xxhash64(*order), SALTS))
    first = parts.withColumn("place", F.row_number().over(Window.partitionBy(*group, "salt").orderBy(*newest_first))).where(F.col("place") <= bound)
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*newest_first))).where(F.col("place") <= bound).drop("salt", "place")


def access_stats(accesses: DataFrame, now_ms: int, start_ms: int | None = None, bound: int | None = SAMPLE_BOUND) -> DataFrame:
    """Statistics of each (table, partition) as one node reports them.

    ``start_ms`` is when the node began to observe; an older access moves it back.  A full
    sample is observed from its oldest access on.  Sums are exact, averages truncated, and the
    median is the upper middle one of the written positions.  Accesses without a label don't count.

    Accesses are counted by position first, and the median is found in running counts, so no
    list of a partition's accesses is held in memory.
    """
    labelled = accesses.where(sampled())
    oldest = F.least(F.min("time_ms"), F.lit(start_ms).cast("long"))
    begun = labelled.agg(oldest.alias("begun"))
    kept = labelled if bound is None else newest(labelled, bound)
    keyed = kept.groupBy(*GROUP, "partition_key").agg(F.count("*").alias("n"), F.min("time_ms").alias("oldest"), F.count_if(~F.col("is_write")).alias("reads"), F.count_if("is_write").alias("writes"))
    by_key = Window.partitionBy(*GROUP).orderBy("partition_key")
    placed = keyed.withColumns({"up_to": F.sum("writes").over(by_key.rowsBetween(Window.unboundedPreceding, 0)), "in_all": F.sum("writes").over(by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    grouped = placed.groupBy(*GROUP).agg(
        F.sum("n").alias("n"),
        F.min("oldest").alias("oldest"),
        F.sum("reads").alias("read_count"),
        F.sum("writes").alias("write_count"),
        F.coalesce(F.sum(F.when(F.col("writes") > 0, F.col("partition_key").cast(WIDE) * F.col("writes")).cast(WIDE)), F.lit(0)).cast(WIDE).alias("position_sum"),
        F.min(F.when(F.col("up_to") > F.floor(F.col("in_all") / 2), F.struct("up_to", "partition_key")))["partition_key"].alias("median_write_position"),
    )
    start = F.when(F.col("n") == F.lit(bound), F.col("oldest")).otherwise(F.col("begun")) if bound is not None else F.col("begun")
    timed = grouped.crossJoin(F.broadcast(begun)).withColumn("start_ms", start).withColumn("window_seconds", (F.lit(now_ms) - F.col("start_ms")) / 1000.0)  # begun is one row
    rate = lambda n: F.when(F.col("window_seconds") > 0, F.col(n) / F.col("window_seconds")).otherwise(0.0)
    return timed.select(
        *GROUP, "start_ms", F.lit(now_ms).cast("long").alias("end_ms"),
        rate("read_count").alias("reads_per_second"), rate("write_count").alias("writes_per_second"), F.lit(1).cast("long").alias("contributing_nodes"),
        truncated_average(F.col("position_sum"), F.col("write_count")).alias("average_write_position"),
        "median_write_position", "read_count", "write_count", F.col("position_sum").cast("string").alias("write_position_sum"), "window_seconds",
    )


def merge_stats(stats: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Statistics of several nodes as one: rates, counts and sums add up; the window is the shortest that isn't 0; the average follows from the sums; a median stays only if one node alone has writes."""
    wrote = F.col("write_count") > 0
    merged = stats.groupBy(*(group or GROUP)).agg(
        F.sum("reads_per_second").alias("reads_per_second"),
        F.sum("writes_per_second").alias("writes_per_second"),
        F.sum("contributing_nodes").alias("contributing_nodes"),
        F.sum("read_count").alias("read_count"),
        F.sum("write_count").alias("write_count"),
        F.sum(F.col("write_position_sum").cast(WIDE)).cast(WIDE).alias("position_sum"),
        F.coalesce(F.min(F.when(F.col("window_seconds") > 0, F.col("window_seconds"))), F.lit(0.0)).alias("window_seconds"),
        F.when(F.count_if(wrote) == 1, F.max(F.when(wrote, F.col("median_write_position")))).alias("median_write_position"),
    )
    return merged.select(
        *(group or GROUP), "reads_per_second", "writes_per_second", "contributing_nodes", truncated_average(F.col("position_sum"), F.col("write_count")).alias("average_write_position"),
        "median_write_position", "read_count", "write_count", F.col("position_sum").cast("string").alias("write_position_sum"), "window_seconds",
    )


def for_table(stats: DataFrame, table_id: int) -> DataFrame:
    return stats.where(F.col("table_id") == table_id)


def replayed(journal: DataFrame, checkpoint_seq: int, now_ms: int, retention_ms: int = RETENTION_MS) -> DataFrame:
    """Accesses of a journal that statistics don't hold yet: from the checkpoint on, and not older than the retention."""
    return journal.where((F.col("seq") >= checkpoint_seq) & (F.col("time_ms") >= now_ms - retention_ms))


def history_scan(samples: DataFrame, table_id: int, partition_id: str, start_ms: int, end_ms: int, now_ms: int, retention_ms: int = RETENTION_MS) -> DataFrame:
    """Kept samples of a partition that overlap a time; one that ends right at its start counts."""
    history(start_ms, end_ms)
    own = (F.col("table_id") == table_id) & (F.col("partition_id") == partition_id)
    return samples.where(own & (F.col("end_ms") >= start_ms) & (F.col("start_ms") < end_ms) & (F.col("end_ms") >= now_ms - retention_ms)).orderBy("start_ms")


def pruned(samples: DataFrame, now_ms: int, retention_ms: int = RETENTION_MS) -> DataFrame:
    """Samples that are still to be kept."""
    return samples.where(F.col("end_ms") >= now_ms - retention_ms)


def windows(accesses: DataFrame, width_ms: int) -> DataFrame:
    """Reads and writes by tumbling window of the accesses' time."""
    start = (F.col("time_ms") - F.pmod(F.col("time_ms"), F.lit(width_ms))).alias("window_start_ms")
    return accesses.where(sampled()).groupBy(*GROUP, start).agg(F.count_if(~F.col("is_write")).alias("read_count"), F.count_if("is_write").alias("write_count"))


def node_rates(merged: DataFrame) -> DataFrame:
    return merged.withColumns({f"{x}_per_node": F.col(f"{x}_per_second") / F.col("contributing_nodes") for x in ("reads", "writes")})


def classify(merged: DataFrame, partitions: DataFrame, hot_reads: float = HOT_READS, hot_writes: float = HOT_WRITES, cold_reads: float = COLD, cold_writes: float = COLD) -> DataFrame:
    """Known partitions with what their load calls for: replicate or consolidate for reads, split or merge for writes, null for neither."""

    def call(rate: str, hot: float, cold: float, more: str, less: str) -> Column:
        return F.when(F.col(rate) > hot, more).when(F.col(rate) < cold, less)

    known = F.broadcast(partitions.select("partition_id", "hash_start"))
    rated = node_rates(merged).join(known, "partition_id")
    return rated.select(*GROUP, "hash_start", "reads_per_node", "writes_per_node", call("reads_per_node", hot_reads, cold_reads, "replicate", "consolidate").alias("read_action"), call("writes_per_node", hot_writes, cold_writes, "split", "merge").alias("write_action"))


def top_partitions(merged: DataFrame, n: int = 100) -> DataFrame:
    """The busiest partitions by reads and writes a second; ties go by table and label."""
    return merged.withColumn("operations_per_second", F.col("reads_per_second") + F.col("writes_per_second")).orderBy(F.desc("operations_per_second"), *GROUP).limit(n)


def backlog(log: DataFrame, progress: DataFrame) -> DataFrame:
    """Mutations of each node that are logged but not committed: queued, in flight, and both; ``progress`` has node_id, committed_seq and in_flight_seq (the last of the batch under way)."""
    waiting = log.join(F.broadcast(progress), "node_id").where(F.col("seq") > F.col("committed_seq"))
    flying = F.col("seq") <= F.col("in_flight_seq")
    return waiting.groupBy("node_id").agg(F.count_if(~F.coalesce(flying, F.lit(False))).alias("queued"), F.count_if(flying).alias("in_flight"), F.count("*").alias("total"))


def backlog_total(backlogs: DataFrame) -> DataFrame:
    return backlogs.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("queued", "in_flight", "total")))


def stage_timings(timings: DataFrame) -> DataFrame:
    """Calls, total and average of each stage's time."""
    return timings.groupBy("operation", "stage").agg(F.count("*").alias("calls"), F.sum("elapsed_ms").alias("total_ms"), F.avg("elapsed_ms").alias("average_ms"))
