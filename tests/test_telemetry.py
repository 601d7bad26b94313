import itertools

import pytest
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument
from tidemark.functions import values
from tidemark.operators import load, reads, telemetry
from tidemark.schema import LONG_MAX, LONG_MIN
from tidemark.sources import log, synthetic

ACCESS = "seq long, table_id long, partition_key long, is_write boolean, partition_id string, time_ms long"


def stats(spark, keys, now=10_000, **kw):
    rows = [(i, 1, k, k is not None, "a", 1000 + i) for i, k in enumerate(keys)]
    return telemetry.access_stats(spark.createDataFrame(rows, ACCESS), now, **kw).first()


def test_exact_sums(spark):
    s = stats(spark, [LONG_MAX, LONG_MAX, LONG_MAX, LONG_MIN])
    assert (s.write_position_sum, s.median_write_position) == ("18446744073709551613", LONG_MAX)


def test_truncated_average(spark):
    s = stats(spark, [10, 10, 99])
    assert (s.average_write_position, s.median_write_position) == (39, 10)
    assert stats(spark, [-3, -4]).average_write_position == -3


def test_bounded_window(spark):
    df = spark.range(65_541).selectExpr("id AS seq", "1L AS table_id", "id AS partition_key", "true AS is_write", "'a' AS partition_id", "id AS time_ms")
    s = telemetry.access_stats(df, 100_000).first()
    assert (s.write_count, s.average_write_position, s.start_ms) == (65_536, (5 + 65_540) // 2, 5)


def test_unsampled_accesses_do_not_count(spark):
    df = spark.createDataFrame([(0, 1, 1, True, None, 5), (1, 1, 1, True, "", 5), (2, 1, 1, False, "a", 5)], ACCESS)
    s = telemetry.access_stats(df, 5).collect()
    assert [(r.partition_id, r.read_count, r.reads_per_second, r.median_write_position) for r in s] == [("a", 1, 0.0, None)]


def test_accounting(spark):
    entries = [log.write(1, 10, 1, b"", 1, partition_id="a"), log.write(1, 10, 1, b"", 0, partition_id="a"), log.write(1, 10, 2, b"", 1, deleted=True, partition_id="a"), log.delete_record(1, 10, 3, 9), log.delete_table(2)]
    m = log.mutations(spark, entries)
    assert reads.write_accesses(m, 7).count() == 3
    assert reads.read_accesses(m, 7).count() == 3


SAMPLES = [("p", 4.0, 2.0, 1, 12, 6, "600", 3.0, 50), ("p", 1.0, 2.0, 1, 8, 2, "200", 1.0, 70), ("p", 5.0, 2.0, 1, 8, 4, "10", 2.0, 30)]
MERGE = "partition_id string, reads_per_second double, writes_per_second double, contributing_nodes long, read_count long, write_count long, write_position_sum string, window_seconds double, median_write_position long"


def test_merged_in_any_order(spark):
    for rows in itertools.permutations(SAMPLES):
        m = telemetry.merge_stats(spark.createDataFrame(list(rows), MERGE), ["partition_id"]).first()
        assert (m.reads_per_second, m.writes_per_second, m.contributing_nodes, m.read_count, m.write_count, m.write_position_sum, m.average_write_position, m.median_write_position, m.window_seconds) == (10, 6, 3, 28, 12, "810", 67, None, 1)


def test_a_single_writer_keeps_its_median(spark):
    rows = [("p", 4.0, 0.0, 1, 4, 0, "0", 10.0, None), ("p", 0.0, 2.0, 1, 0, 2, "-20", 20.0, -10), ("p", 0.0, 0.0, 0, 0, 0, "0", 0.0, None)]
    m = telemetry.merge_stats(spark.createDataFrame(rows, MERGE), ["partition_id"]).first()
    assert (m.average_write_position, m.median_write_position, m.window_seconds, m.contributing_nodes) == (-10, -10, 10, 2)


def test_history_and_retention(spark):
    rows = spark.createDataFrame([(1, "p", 0, 10), (1, "p", 10, 20), (1, "p", 20, 30), (1, "q", 0, 30)], "table_id long, partition_id string, start_ms long, end_ms long")
    assert [r.start_ms for r in telemetry.history_scan(rows, 1, "p", 10, 20, 30).collect()] == [0, 10]
    assert [r.start_ms for r in telemetry.history_scan(rows, 1, "p", 0, 99, 30, retention_ms=10).collect()] == [10, 20]
    assert telemetry.pruned(rows, 30, 5).count() == 2
    with pytest.raises(InvalidArgument):
        telemetry.history_scan(rows, 1, "p", 5, 5, 0)


def test_classes(spark):
    known = spark.createDataFrame([("h", 1), ("c", 2), ("m", 3)], "partition_id string, hash_start long")
    rows = spark.createDataFrame([(1, "h", 2002.0, 402.0, 2), (1, "c", 49.0, 49.0, 1), (1, "m", 1000.0, 200.0, 1), (1, "x", 0.0, 0.0, 1)], "table_id long, partition_id string, reads_per_second double, writes_per_second double, contributing_nodes long")
    got = {r.partition_id: (r.read_action, r.write_action) for r in telemetry.classify(rows, known).collect()}
    assert got == {"h": ("replicate", "split"), "c": ("consolidate", "merge"), "m": (None, None)}


def test_load(spark):
    assert synthetic.spread_keys(3) == [LONG_MIN, -1, LONG_MAX] and synthetic.spread_keys(1) == [LONG_MIN]
    for total in (1, 5, 7, 501, 100_003):
        for n in range(1, 17):
            parts = values.share(total, n)
            assert sum(parts) == total and max(parts) - min(parts) <= 1
    hot = synthetic.records(spark, 1, 10, hot_key=5).select("partition_key").distinct().collect()
    assert [r.partition_key for r in hot] == [5]
    ops = synthetic.operations(spark, 1000, 7, 25).collect()
    assert {o["index"] for o in ops} == set(range(7)) and 150 < sum(o["read"] for o in ops) < 350
    done = spark.createDataFrame([(i, float(i)) for i in range(40)], "seq long, latency double")
    assert load.p95(done).first().p95_ms == 39 * 95 // 100
    assert load.p95(done, 10).first().p95_ms == 30 + 9 * 95 // 100
    assert load.p95(done.limit(0)).first().p95_ms == 0
    timed = spark.createDataFrame([(i * 100,) for i in range(41)], "time_ms long")
    t = load.throughput(timed, 0, 4000).first()
    assert load.throughput(timed.withColumn("seed", F.lit(True)), 0, 4000).first().average_tps == 0
    assert (t.current_tps, t.average_tps) == (11.0, 10.3)


def test_outcomes_of_a_load_run(spark, tmp_path):
    """Seeds count for themselves alone; an empty error text is no error; 404 and NotFound are misses."""
    rows = [(0, "204", False, True, 1.0, None), (1, "500", False, True, 2.0, "boom"), (2, "OK", False, True, 3.0, ""), (3, "200", True, False, 4.0, ""), (4, "404", True, False, 5.0, None), (5, "NotFound", True, None, 6.0, ""), (6, "500", False, False, 7.0, "boom"), (7, "404", True, False, 8.0, "late")]
    done = spark.createDataFrame(rows, "seq long, status string, read boolean, seed boolean, latency double, error string")
    c = load.counts(done).first().asDict()
    assert c == {"completed": 5, "seeded": 3, "reads": 4, "writes": 1, "errors": 2, "misses": 2, "successes": 1, "seed_errors": 1}
    assert {r.status: r.n for r in load.statuses(done).collect()} == {"200": 1, "404": 2, "NotFound": 1, "500": 1}
    assert load.p95(done).first().p95_ms == 7.0
    load.write_report(load.counts(done), f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report").first().asDict() == c


def test_trailing_counts_of_a_busy_worker(spark):
    import random

    r = random.Random(3)
    rows = [(i, r.choice([0, 0, 0, 1, None]), r.randrange(400)) for i in range(300)]
    df = spark.createDataFrame(rows, "seq long, worker long, time_ms long")
    got = {x.seq: x.recent for x in load.trailing(df, 50).collect()}
    assert got == {i: sum(w == v and t - 50 <= u <= t for _, v, u in rows) for i, w, t in rows}


def test_trailing_counts_of_many_times_in_a_window(spark):
    """A window's times are not summed anew for each of its ends; null times are of one time, and any width does."""
    rows = [(i, i % 2 or None, t) for i, t in enumerate([*range(-30, 31), None, None, 7, 7, -20])]
    df = spark.createDataFrame(rows, "seq long, worker long, time_ms long")
    for width in (0, 1, 7, 20, 1000):
        got = {x.seq: x.recent for x in load.trailing(df, width).collect()}
        assert got == {i: sum(w == v and (t is None and u is None or None not in (t, u) and t - width <= u <= t) for _, v, u in rows) for i, w, t in rows}
    with pytest.raises(InvalidArgument):
        load.trailing(df, -1)
    plan = load.trailing(df, 7)._jdf.queryExecution().executedPlan().toString()
    assert "unboundedpreceding" in plan and "RangeFrame" not in plan


def test_file_size(spark, tmp_path):
    import glob
    import os

    spark.range(1000).repartition(3).write.parquet(f"{tmp_path}/t")
    assert reads.file_size(spark.read.parquet(f"{tmp_path}/t")).first()[0] == sum(map(os.path.getsize, glob.glob(f"{tmp_path}/t/*.parquet")))
