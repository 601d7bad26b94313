import random

import pytest

from tidemark.errors import InvalidArgument, NotFound, ResourceExhausted
from tidemark.operators import lww, reads
from tidemark.schema import LONG_MAX, LONG_MIN
from tidemark.sources import log
from tidemark.streaming.state import Snapshots, Statistics, latest_versions, progress, windowed


def serial(entries):
    """One mutation after another."""
    rows = {}
    for e in entries:
        if e["kind"] == "write":
            key = (e["table_id"], e["partition_key"], e["secondary_key"])
            new = (e["timestamp"], e["deleted"], b"" if e["deleted"] else e["data"])
            old = rows.get(key)
            label = e["partition_id"] if e["partition_id"] is not None else old and old[1]
            rows[key] = (max(new, old[0]) if old else new, label)
        else:
            hit = {
                "delete_table": lambda k: True,
                "delete_partition_key": lambda k: k[1] == e["partition_key"],
                "delete_range": lambda k: e["lower_bound"] <= k[1] < e["upper_bound"],
            }[e["kind"]]
            rows = {k: v for k, v in rows.items() if k[0] != e["table_id"] or not hit(k)}
    return {(*k, *v[0], v[1]) for k, v in rows.items()}


def state(df):
    return {(r.table_id, r.partition_key, r.secondary_key, r.timestamp, r.deleted, bytes(r.data), r.partition_id) for r in df.collect()}


def applied(spark, entries):
    return state(lww.apply_mutations(log.mutations(spark, entries)))


def w(key, at, data=b"", deleted=False, label=None):
    return log.write(1, key, 0, data, at, deleted=deleted, partition_id=label)


def test_order_of_arrival_does_not_matter(spark):
    entries = [w(1, 20, b"new"), w(1, 10, b"old"), w(1, 20, b"new"), w(2, 10, b"old"), w(2, 20, b"new"), w(3, 30, b"a"), w(3, 30, b"z"), w(4, 30, b"z"), w(4, 30, b"a")]
    got = {(r[1], r[3], r[5]) for r in applied(spark, entries)}
    assert got == {(1, 20, b"new"), (2, 20, b"new"), (3, 30, b"z"), (4, 30, b"z")}


def test_payloads_compare_as_unsigned_bytes(spark):
    got = {r[5] for r in applied(spark, [w(1, 1, b"\x7f"), w(1, 1, b"\x80\xff"), w(1, 1, b"\x80")])}
    assert got == {b"\x80\xff"}


def test_tombstone_wins_ties_until_a_newer_write(spark):
    entries = [w(1, 20, deleted=True), w(1, 10, b"x"), w(1, 20, b"x")]
    assert applied(spark, entries) == {(1, 1, 0, 20, True, b"", None)}
    entries += [w(1, 30, b"y"), w(1, 29, deleted=True)]
    assert applied(spark, entries) == {(1, 1, 0, 30, False, b"y", None)}
    entries += [w(1, 30, deleted=True), w(1, 30, b"z")]
    assert applied(spark, entries) == {(1, 1, 0, 30, True, b"", None)}


def test_labels_follow_arrival_not_time(spark):
    entries = [w(1, 20, b"n", label="source"), w(1, 10, b"o", label="destination"), w(1, 21, b"m")]
    assert applied(spark, entries) == {(1, 1, 0, 21, False, b"m", "destination")}
    assert applied(spark, [w(1, 1, label="a"), w(1, 0, label="")]) == {(1, 1, 0, 1, False, b"", "")}


def test_a_delete_lets_an_older_write_be_seen(spark):
    entries = [w(1, 20, b"new"), log.delete_range(1, 1, 2), w(1, 10, b"old")]
    assert applied(spark, entries) == {(1, 1, 0, 10, False, b"old", None)}


def grouped():
    out = []
    for i in range(775):
        out.append(log.write(1 + i % 2, i % 3, i % 19, b'{"value":%d}' % (i % 5), i % 7, deleted=i % 11 == 0))
        out += [log.delete_partition_key(1, 0)] if i == 259 else [log.delete_range(2, 0, 2), log.delete_table(1)] if i == 515 else []
    return out


def test_a_long_log_equals_serial_application(spark):
    assert applied(spark, grouped()) == serial(grouped())


def random_log(seed, n=300):
    r = random.Random(seed)
    keys = [LONG_MIN, -5, -1, 0, 1, 7, LONG_MAX]
    out = []
    for _ in range(n):
        t, k = r.choice([1, 2]), r.choice(keys)
        kind = r.random()
        if kind < 0.9:
            out.append(log.write(t, k, r.choice(keys[:3]), bytes(r.randrange(256) for _ in range(r.randrange(3))), r.randrange(5), deleted=r.random() < 0.2, partition_id=r.choice([None, "", "a", "b"])))
        else:
            lo, hi = sorted(r.sample(keys, 2))
            out.append(r.choice([log.delete_table(t), log.delete_partition_key(t, k), log.delete_range(t, lo, hi)]))
    return out


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize(("joined", "block"), [(128, 1000), (0, 1000), (0, 3)])
def test_random_logs_equal_serial_application(spark, monkeypatch, seed, joined, block):
    monkeypatch.setattr(lww, "JOINED_SEGMENTS", joined)  # 0: segments are searched
    monkeypatch.setattr(lww, "BROADCAST_DELETES", block)  # 3: many blocks of deletes
    assert applied(spark, random_log(seed)) == serial(random_log(seed))


def test_very_many_range_deletes(spark):
    """A hundred thousand ranges, some within others, in a few seconds, against a scan of all of them for a few keys."""
    import time

    r = random.Random(1)
    n = 100_000
    dels = [(1_000 + i, "delete_range", 1 + i % 2, None, lo := r.randrange(10**6), lo + 1 + r.choice([3, 50, 10**5 if i < 20 else 9])) for i in range(n)]
    d = spark.createDataFrame([(q, k, t, p, a, b) for q, k, t, p, a, b in dels], "seq long, kind string, table_id long, partition_key long, lower_bound long, upper_bound long")
    writes = [(r.randrange(110_000), 1 + i % 3, r.randrange(-5, 10**6 + 9)) for i in range(400)]
    w = spark.createDataFrame(writes, "seq long, table_id long, partition_key long")
    begin = time.time()
    got = {tuple(x) for x in lww.surviving(w, d).collect()}
    assert time.time() - begin < 30
    assert got == {(q, t, k) for q, t, k in writes if not any(t == u and a <= k < b and x > q for x, _, u, _, a, b in dels)}
    counts = {x.seq: x.n_records for x in lww.would_delete(w, d).collect()}
    assert len(counts) == n and all(counts[x] == sum(t == u and a <= k < b for _, t, k in writes) for x, _, u, _, a, b in dels[:300])


def test_deletes_do_not_shuffle_writes(spark):
    entries = [log.write(1, k, 0, b"", 1) for k in range(9)] + [log.delete_table(2), log.delete_partition_key(1, 3), log.delete_range(1, 5, 7)]
    m = log.mutations(spark, entries)
    plan = lww.surviving(m.where("kind = 'write'"), m.where("kind <> 'write'"))._jdf.queryExecution().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_batches_equal_the_whole(spark):
    entries = random_log(9)
    mutations = log.mutations(spark, entries)
    snapshot = lww.compact(mutations.where("false"))
    for lo in (0, 100, 200):
        snapshot = lww.apply_batch(snapshot, mutations.where(f"seq >= {lo} AND seq < {lo + 100}"))
    assert state(snapshot) == serial(entries)


def test_stream_of_segments(spark, tmp_path):
    entries = random_log(11)
    snapshots = Snapshots(spark, f"{tmp_path}/s")
    for n, lo in enumerate((0, 150)):
        log.append(log.mutations(spark, entries[lo : lo + 150], lo).coalesce(1), f"{tmp_path}/log")
        q = snapshots.follow(log.read_stream(spark, f"{tmp_path}/log"), f"{tmp_path}/c")
        q.awaitTermination()
        assert state(snapshots.read()) == serial(entries[: lo + 150])
        assert progress(q)["rows"] >= 150 and progress(q)["batch"] == n
    number = snapshots.current()
    snapshots.apply(log.mutations(spark, [log.delete_table(1), log.delete_table(2)]), number)  # a batch again
    assert state(snapshots.read()) == serial(entries)
    assert {r.seq for r in log.read(spark, f"{tmp_path}/log", 290).collect()} == set(range(290, 300))


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    s = Snapshots(spark, f"{tmp_path}/s", buckets=16)
    first = [log.write(1, k, 0, b"a", 1) for k in range(200)]
    second = [log.write(1, k, 0, b"b", 2) for k in (3, 4)] + [log.delete_partition_key(1, 5)]
    s.apply(log.mutations(spark, first), 0)
    before = s._line()[1]
    s.apply(log.mutations(spark, second, 200), 1)
    after = s._line()[1]
    assert len(before) == 16 and {b for b in after if after[b] == 1} == {b for b in after if before[b] != after[b]} and 1 <= sum(n == 1 for n in after.values()) <= 3
    assert state(s.read()) == serial(first + second) and state(s.read(0)) == serial(first)
    assert {r.partition_key for r in s.read_key(1, 3).collect()} >= {3} and s.read_key(1, 3).count() < 60
    assert s.vacuum() == sum(n == 1 for n in after.values()) and state(s.read()) == serial(first + second)
    s.apply(log.mutations(spark, [log.delete_range(1, 0, 150)], 300), 2)
    assert s.read().count() == 50 and s.vacuum() > 0 and s.read().count() == 50


def test_a_log_loses_its_applied_segments(spark, tmp_path):
    for lo in (0, 10, 20):
        log.append(log.mutations(spark, [log.write(1, k, 0, b"", 1) for k in range(10)], lo).coalesce(1), f"{tmp_path}/log")
    assert log.truncate(spark, f"{tmp_path}/log", 15) == 1
    assert {r.seq for r in log.read(spark, f"{tmp_path}/log").collect()} == set(range(10, 30))


def test_a_restart_finds_what_waits(spark, tmp_path):
    from tidemark.plans.api import Store

    store = Store(spark, str(tmp_path))
    store.submit([log.write(1, k, 0, b"", 1) for k in range(5)])
    store.apply()
    store.submit([log.write(1, 9, 0, b"", 1)])
    again = Store(spark, str(tmp_path))
    assert (again.next_seq, again.applied_seq) == (6, 5)
    again.apply()
    assert again.truncate() == 1 and Store(spark, str(tmp_path)).applied_seq == 6
    assert {r.partition_key for r in again.records().collect()} == {0, 1, 2, 3, 4, 9}


def test_statistics_are_pruned(spark, tmp_path):
    columns = "seq long, table_id long, partition_key long, is_write boolean, partition_id string, time_ms long"
    s = Statistics(spark, f"{tmp_path}/stats", retention_ms=1000)
    assert s.checkpoint() == 0
    s.flush(spark.createDataFrame([(0, 1, 1, True, "p", 100), (1, 1, 1, True, "p", 200)], columns), 0)
    s.flush(spark.createDataFrame([(2, 1, 1, True, "p", 1500)], columns), 1)
    assert s.checkpoint() == 3 and [r.end_ms for r in s.read().collect()] == [1500]
    assert s.prune(1500) == 1 and s.prune(1500) == 0 and s.read().count() == 1


def test_running_aggregate_equals_batch(spark, tmp_path):
    entries = [e for e in random_log(12) if e["kind"] == "write"]
    log.append(log.mutations(spark, entries), f"{tmp_path}/log")
    stream = latest_versions(log.read_stream(spark, f"{tmp_path}/log"))
    stream.writeStream.format("memory").queryName("latest").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert state(spark.table("latest")) == serial(entries)


def test_statistics_stream_counts_a_batch_once(spark, tmp_path):
    rows = [(i, 1, i, i % 2 == 0, "p", 60_000 + i) for i in range(10)]
    df = spark.createDataFrame(rows, "seq long, table_id long, partition_key long, is_write boolean, partition_id string, time_ms long")
    s = Statistics(spark, f"{tmp_path}/stats")
    s.flush(df, 0), s.flush(df, 0)
    assert [(r.read_count, r.write_count) for r in s.read().collect()] == [(5, 5)]
    df.write.parquet(f"{tmp_path}/in")
    stream = windowed(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.table("w").select("window_start_ms", "read_count", "write_count").collect()] == [(60_000, 5, 5)]


def test_reads(spark):
    entries = [log.write(1, 10, -1, b"\x00\xff\x80\x07\r\x01\n", 0), log.write(1, 10, 2, "café".encode(), 0), log.write(1, 20, 3, b"", 0, deleted=True), log.write(2, 10, -1, b"x", 0)]
    records = lww.apply_mutations(log.mutations(spark, entries))
    assert bytes(reads.found(reads.point(records, 1, 10, -1)).first().data) == entries[0]["data"]
    assert [r.secondary_key for r in reads.partition_key_scan(records, 1, 10).collect()] == [-1, 2]
    assert reads.range_scan(records, 1, 9, 20).count() == reads.range_scan(records, 1, 10, 20).count() == 2
    assert reads.range_scan(records, 1, 10, 21, include_deleted=True).count() == 3
    assert reads.range_size(records, 1, 10, 21).first().payload_bytes == 7 + 5
    assert reads.count_range(records, 1, 10, 21).first().n_records == 2
    for lo, hi in ((20, 10), (10, 10)):
        with pytest.raises(InvalidArgument):
            reads.range_scan(records, 1, lo, hi)
    with pytest.raises(NotFound):
        reads.found(reads.point(records, 1, 20, 3))
    assert [(r.seq, r.n_records) for r in lww.would_delete(records, log.mutations(spark, [log.delete_table(1), log.delete_range(1, 10, 11), log.delete_partition_key(3, 0)])).orderBy("seq").collect()] == [(0, 3), (1, 2), (2, 0)]


def test_arguments():
    log.write(1, 1, 1, b"", 0)
    for bad in (lambda: log.write(1, 1, 1, b"", -1), lambda: log.write(1, 1 << 63, 1, b"", 0), lambda: log.delete_range(1, 5, 5)):
        with pytest.raises(InvalidArgument):
            bad()
    log.admit(65_535)
    with pytest.raises(ResourceExhausted):
        log.admit(65_536)


def test_reconciled_replicas(spark):
    schema = "node_id long, table_id long, partition_key long, secondary_key long, timestamp long, deleted boolean, data binary, partition_id string"
    copies = spark.createDataFrame([(1, 1, 1, 1, 1, False, b"a", None), (2, 1, 1, 1, 2, False, b"b", None)], schema)
    assert bytes(lww.reconcile(copies).first().data) == b"b"
    gone = copies.unionByName(spark.createDataFrame([(3, 1, 1, 1, 3, True, b"", None)], schema))
    assert reads.live(lww.reconcile(gone)).count() == 0
