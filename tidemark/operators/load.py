"""What a load run reports: counts, statuses, latency and throughput."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.operators.telemetry import newest
from tidemark.schema import LATENCIES


#: Statuses of seeds that succeeded, and of reads that found nothing.
SEEDED, MISSED = ("204", "OK"), ("404", "NotFound")


def _seed() -> Column:
    return F.coalesce(F.col("seed"), F.lit(False))


def requests(completions: DataFrame) -> DataFrame:
    """Completions of the run itself: seeds prepare it and count in nothing but seeded and seed_errors."""
    return completions.where(~_seed()) if "seed" in completions.columns else completions


def counts(completions: DataFrame) -> DataFrame:
    """Completions by outcome: an error if there is an error text, a miss if the status says that nothing was found, else a success; seeds for themselves."""
    n, own = F.count_if, ~_seed()
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    missed = F.coalesce(F.col("status").isin(*MISSED), F.lit(False))
    return completions.agg(
        n(own).alias("completed"), n(~own).alias("seeded"), n(own & F.col("read")).alias("reads"), n(own & ~F.col("read")).alias("writes"),
        n(own & failed).alias("errors"), n(own & ~failed & missed).alias("misses"), n(own & ~failed & ~missed).alias("successes"),
        n(~own & ~F.coalesce(F.col("status").isin(*SEEDED), F.lit(False))).alias("seed_errors"),
    )


def statuses(completions: DataFrame) -> DataFrame:
    return requests(completions).groupBy("status").agg(F.count("*").alias("n"))


def merge_counts(batches: DataFrame, by: str = "status") -> DataFrame:
    """Counts of several batches as one."""
    return batches.groupBy(by).agg(F.sum("n").alias("n"))


def p95(completions: DataFrame, last: int = LATENCIES) -> DataFrame:
    """The latency at place (n - 1) * 95 / 100, rounded down, of the newest in order; 0 without any."""
    recent = newest(requests(completions).where("latency IS NOT NULL").withColumn("one", F.lit(1)), last, ["one"], ["seq"])
    sample = recent.agg(F.array_sort(F.collect_list("latency")).alias("s"))
    return sample.select(F.when(F.size("s") > 0, F.element_at("s", (F.floor(F.greatest(F.size("s") - 1, F.lit(0)) * 95 / 100) + 1).cast("int"))).otherwise(0.0).alias("p95_ms"))


def throughput(completions: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Completions a second over the whole run, and over its last second (all of a shorter run), to one digit."""
    elapsed = (end_ms - start_ms) / 1000
    if elapsed <= 0:
        return completions.limit(1).agg(F.lit(0.0).alias("current_tps"), F.lit(0.0).alias("average_tps"))
    recent = F.count_if(F.col("time_ms") >= end_ms - 1000)
    return requests(completions).where((F.col("time_ms") >= start_ms) & (F.col("time_ms") <= end_ms)).agg(F.round(recent / min(elapsed, 1.0), 1).alias("current_tps"), F.round(F.count("*") / elapsed, 1).alias("average_tps"))


def trailing(completions: DataFrame, width_ms: int = 1000) -> DataFrame:
    """For each worker's completions, how many it had in the time up to each, both ends included.

    A worker's times are counted first, and cut into stretches of the width.  A window ends in
    its own stretch and begins there or in the one before: it holds all of the stretch before,
    and what its own has up to its end, without what the stretch before had until the window's
    begin.  So one running sum over a stretch, with a copy of the one before that is taken
    off, gives all windows, however many times they hold.  Null times are of one time.
    """
    if width_ms < 0:
        raise InvalidArgument("width must not be negative")
    width = max(width_ms, 1)
    counted = completions.groupBy("worker", "time_ms").agg(F.count("*").alias("n"))
    own = F.floor(F.col("time_ms") / width)
    stretches = F.array(own, own + 1) if width_ms else F.array(own)
    spread = counted.select("*", F.posexplode(stretches).alias("late", "stretch")).withColumn("place", F.pmod("time_ms", F.lit(width)))
    late = F.col("late") == 1
    spread = spread.where(~late | F.col("stretch").isNotNull())
    by_place = Window.partitionBy("worker", "stretch").orderBy("place", "late")
    before = F.sum(F.when(late, F.col("n")).otherwise(0)).over(by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    since = F.sum(F.when(late, -F.col("n")).otherwise(F.col("n"))).over(by_place.rowsBetween(Window.unboundedPreceding, 0))
    summed = spread.withColumn("recent", before + since).where(~late).select(F.col("worker").alias("w"), F.col("time_ms").alias("t"), "recent")
    return completions.join(summed, F.col("worker").eqNullSafe(F.col("w")) & F.col("time_ms").eqNullSafe(F.col("t")), "left").drop("w", "t")


def report(completions: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """A run's report as a row: counts, throughput and latency side by side; each part is one row."""
    return counts(completions).crossJoin(throughput(completions, start_ms, end_ms)).crossJoin(p95(completions))


def write_report(rows: DataFrame, path: str) -> None:
    """Writes a report as lines of JSON."""
    rows.coalesce(1).write.mode("overwrite").json(path)  # a report is a row
