import threading

import pytest
from pyspark.sql import functions as F

from tidemark.errors import Conflict, InvalidArgument, NotFound, NotReady
from tidemark.operators import replicas, ring
from tidemark.plans import cluster, topology
from tidemark.plans.jobs import Executor
from tidemark.plans.topology import Cluster, Leases, Partition, Table
from tidemark.schema import LONG_MAX, LONG_MIN, PARTITIONS, TABLES
from tidemark.sources import catalog

COPIES = "node_id long, table_id long, partition_key long, secondary_key long, timestamp long, deleted boolean, data binary, partition_id string"


def rows(df):
    return {(r.node_id, r.partition_key, r.timestamp, r.deleted, bytes(r.data), r.partition_id) for r in df.collect()}


def test_thirds_of_the_ring():
    parts = topology.thirds([7, 11, 19], ["a", "b", "c"])
    assert [p.hash_start for p in parts] == [-9223372036854775808, -3074457345618258603, 3074457345618258602]
    assert [p.replicas for p in parts] == [(7, 11, 19), (11, 19, 7), (19, 7, 11)]


def test_neighbours():
    parts = tuple(Partition(s, str(s), (1,)) for s in (10, 20, 30))
    assert [p.hash_start for p in topology.around(parts, 10)] == [30, 10, 20]
    with pytest.raises(InvalidArgument):
        topology.around(parts[:1], 10)
    with pytest.raises(NotFound):
        topology.around(parts, 15)


def test_retained(spark):
    df = spark.createDataFrame([(1, 0, "p", None, [1, 2, 3])], PARTITIONS)
    assert [replicas.retained(df, n).first().kept for n in (1, 2, 3)] == [[1], [1, 2], [1, 2, 3]]
    assert replicas.distinct_replicas(df).first().is_distinct


def test_copy_range(spark):
    own = [(0, 1, 10, 0, 2, False, b"a", "s"), (1, 1, 11, 0, 2, False, b"b", "s"), (0, 1, 12, 0, 3, True, b"", "s"), (1, 1, 10, 0, 10, False, b"newer", "d"), (0, 1, 20, 0, 1, False, b"out", "s"), (0, 2, 10, 0, 1, False, b"other", "s")]
    got = replicas.copy_range(spark.createDataFrame(own, COPIES), 1, 10, 20, [0, 1], [1, 2, 3], "new")
    for n in (2, 3):
        assert {r[1:] for r in rows(got) if r[0] == n} == {(10, 10, False, b"newer", "new"), (11, 2, False, b"b", "new"), (12, 3, True, b"", "new")}
    assert (1, 10, 10, False, b"newer", "new") in rows(got) and (0, 20, 1, False, b"out", "s") in rows(got)


@pytest.mark.parametrize("joined", [1000, 0])
def test_routing(spark, monkeypatch, joined):
    monkeypatch.setattr(ring, "JOINED_STARTS", joined)  # 0: starts are searched
    parts = spark.createDataFrame([(t, s, f"p{s}", None, [1]) for t in (1, 2) for s in (-20, 0, 30)] + [(3, 5, "q", None, [1])], PARTITIONS)
    keys = spark.createDataFrame([(1, LONG_MIN), (1, -20), (2, -1), (2, 0), (2, LONG_MAX), (3, 4), (4, 0)], "table_id long, partition_key long")
    told = {(r.table_id, r.partition_key): r.owner for r in ring.route(keys, parts, "wrap").collect()}
    assert told == {(1, LONG_MIN): "p30", (1, -20): "p-20", (2, -1): "p-20", (2, 0): "p0", (2, LONG_MAX): "p30", (3, 4): "q"}
    assert {(r.table_id, r.partition_key) for r in ring.route(keys, parts).collect()} == {(1, -20), (2, -1), (2, 0), (2, LONG_MAX)}


def test_segments_below_across_and_above_the_first_start(spark):
    parts = spark.createDataFrame([(1, s, f"p{s}", None, [1]) for s in (-20, 0, 30)], PARTITIONS)
    cut = lambda lo, hi: [(r.lo, r.hi, r.partition_id) for r in ring.segments(parts, lo, hi).collect()]
    assert cut(-50, -30) == [(-50, -30, "p30")]
    assert cut(-50, 10) == [(-50, -20, "p30"), (-20, 0, "p-20"), (0, 10, "p0")]
    assert cut(5, 50) == [(5, 30, "p0"), (30, 50, "p30")]


def test_a_source_that_is_not_there_fails(spark):
    parts = spark.createDataFrame([(1, 0, "p", 99, [1])], PARTITIONS)
    with pytest.raises(Exception, match="forward_to names no partition"):
        ring.forwarded(parts).collect()


@pytest.fixture
def made(spark):
    c = Cluster((1, 2, 3, 4), replicas.empty_copies(spark))
    c = topology.make_table(c, Table(1, "t", 1, "pk", "sk"), [2, 3, 4])
    data = [(n, 1, k, 0, 5, k == 7, b"" if k == 7 else b"x", "old") for n in (2, 3, 4) for k in (-5, 0, 7, 50)]
    from dataclasses import replace

    return replace(c, copies=spark.createDataFrame(data, COPIES))


def live(c, spark, keys=(-5, 0, 7, 50)):
    asked = spark.createDataFrame([(1, k, 0) for k in keys], "table_id long, partition_key long, secondary_key long")
    return {r.partition_key for r in cluster.get_consistent(asked, c.copies, c.partitions(spark)).collect()}


def test_split_in_all_four_states(spark, made):
    first = {-5, 0, 50}
    assert live(made, spark) == first
    published = topology.split_published(made, 1, 0)
    new = next(p for p in published.ring(1) if p.hash_start == 0)
    assert new.forward_to == -3074457345618258603 and new.replicas == (1, 2, 3)
    assert live(published, spark) == first
    told = {r.hash_start: r for r in ring.forwarded(published.partitions(spark)).collect()}
    assert told[0].read_replicas == [3, 4, 2] and told[0].write_replicas == [1, 2, 3, 4]
    with pytest.raises(Conflict):
        topology.split_published(published, 1, 5)
    done = topology.split_activated(published, 1, 0)
    assert live(done, spark) == first
    assert {(r[0], r[5]) for r in rows(done.copies) if r[1] == 7} == {(n, new.partition_id) for n in (1, 2, 3)}
    assert not made.leases.held
    for bad in (0, 1 << 63):
        with pytest.raises(InvalidArgument):
            topology.split_partition(done, 1, bad)


def test_merge_undoes_a_split(spark, made):
    split = topology.split_partition(made, 1, 0)
    merged = topology.merge_partition(split, 1, 0)
    assert [p.hash_start for p in merged.ring(1)] == [p.hash_start for p in made.ring(1)]
    assert live(merged, spark) == {-5, 0, 50}
    assert 1 not in {r[0] for r in rows(merged.copies)}
    for edge in (LONG_MIN, 3074457345618258602):
        with pytest.raises(InvalidArgument):
            topology.merge_partition(made, 1, edge)


def test_replication(spark, made):
    start = -3074457345618258603
    more = topology.increase_replication(made, 1, start, 4)
    assert next(p for p in more.ring(1) if p.hash_start == start).replicas == (3, 4, 2, 1)
    assert live(more, spark) == {-5, 0, 50} and 1 in {r[0] for r in rows(more.copies)}
    less = topology.decrease_replication(more, 1, start, 1)
    assert {r[0] for r in rows(less.copies)} == {3} and live(less, spark) == {-5, 0, 50}
    with pytest.raises(InvalidArgument):
        topology.increase_replication(made, 1, start, 5)


def test_tables(spark, made):
    with pytest.raises(InvalidArgument):
        topology.make_table(made, Table(2, " ", 1, "pk", "sk"), [1, 2, 3])
    with pytest.raises(InvalidArgument):
        topology.make_table(made, Table(2, "t", 1, "pk", "sk"), [1, 2, 2])
    gone = topology.delete_table(made, 1)
    assert gone.copies.count() == 0 and 1 not in gone.tables and topology.delete_table(gone, 1) is gone
    assert replicas.table_nodes(made.partitions(spark)).count() == 3


def test_leases_expire_and_are_given_back():
    now = [0.0]
    leases = Leases(clock=lambda: now[0])
    leases.acquire(1, 0, "a")
    with pytest.raises(Conflict):
        leases.acquire(1, 0, "b")
    assert not leases.release(1, 0, "b")
    now[0] = 300
    leases.acquire(1, 0, "b")
    with pytest.raises(Conflict):
        leases.check(1, 0, "a")
    with pytest.raises(Conflict), leases.all(1, [-1, 0]):
        pass
    assert (1, -1) not in leases.held


def test_catalog(spark):
    tables = catalog.create(spark.createDataFrame([], TABLES), table_id=1, table_name="t", owner=1, is_ready=False)
    with pytest.raises(NotReady):
        cluster.ready(tables, 1)
    tables = catalog.update(tables, {"table_id": 1}, is_ready=True)
    cluster.ready(tables, 1)
    assert catalog.random_ready_table(tables).count() == 1
    with pytest.raises(NotFound):
        catalog.update(tables, {"table_id": 2}, is_ready=True)
    with pytest.raises(InvalidArgument):
        cluster.ready(catalog.update(tables, {"table_id": 1}, secret_key_id=1), 1)
    assert [catalog.delete(tables, table_id=t)[1] for t in (1, 2)] == [1, 0]
    nodes = spark.createDataFrame([(i, f"u{i}/") for i in range(1, 6)], "node_id long, url string")
    assert len({r.node_id for r in catalog.random_nodes(nodes, 3, 1).collect()}) == 3
    assert '"table_id":"1"' in catalog.as_json(tables).first().json
    with pytest.raises(Exception, match="node doesn't exist"):
        replicas.replica_urls(spark.createDataFrame([(1, [9])], "k long, replicas array<long>"), nodes).collect()


def test_jobs():
    jobs, gate, ran = Executor(running=2), threading.Event(), []
    first = jobs.submit("a", 1, lambda: (gate.wait(5), ran.append("a")))
    assert jobs.submit("a", 1, lambda: ran.append("again")) is first
    second = jobs.submit("b", 1, lambda: ran.append("b"))  # the table is busy
    third = jobs.submit("c", 2, lambda: ran.append("c"))
    third.result(5)
    assert ran == ["c"] and jobs.status("a") == "running" and jobs.status("b") == "queued"
    gate.set()
    second.result(5)
    assert ran == ["c", "a", "b"]
    failed = jobs.submit("d", 3, lambda: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        failed.result(5)
    assert jobs.status("d") == "failed" and jobs.status("b") == "succeeded"
    with pytest.raises(NotFound):
        jobs.status("x")
    jobs.close()


def test_scale(spark, made):
    s = spark.createDataFrame([(1, made.ring(1)[0].partition_id, 4000.0, 0.0, 1, 10, 0, "0", 1.0, None)], "table_id long, partition_id string, reads_per_second double, writes_per_second double, contributing_nodes long, read_count long, write_count long, write_position_sum string, window_seconds double, median_write_position long")
    got = topology.check_scale(s, made.partitions(spark), 1).first()
    assert (got.read_action, got.write_action) == ("replicate", "merge")
    assert F is not None


def test_calls(spark, tmp_path):
    import json

    from tidemark.plans.api import Store, call

    store = Store(spark, str(tmp_path))
    say = lambda **x: json.loads(call(store, json.dumps(x)))
    assert say(call="write", table_id=1, partition_key=10, secondary_key=0, data={"text": "café"}, timestamp=5) == {"waiting": 1}
    assert say(call="get", table_id=1, partition_key=10, secondary_key=0)["error"] == "NotFound"
    store.apply()
    row = {"table_id": 1, "partition_key": 10, "secondary_key": 0, "data": {"text": "café"}, "timestamp": 5}
    assert say(call="get", table_id=1, partition_key=10, secondary_key=0) == {"rows": [row]}
    assert say(call="range_size", table_id=1, lower=10, upper=11) == {"rows": [{"payload_bytes": len('{"text":"caf\\u00e9"}')}]}
    say(call="delete_record", table_id=1, partition_key=10, secondary_key=0, timestamp=5)
    store.apply()
    assert say(call="range", table_id=1, lower=0, upper=99) == {"rows": []}
    assert say(call="range", table_id=1, lower=0, upper=99, include_deleted=True)["rows"][0]["data"] is None
    assert say(call="count_range", table_id=1, lower=9, upper=3)["error"] == "InvalidArgument"
    assert say(call="write", table_id=1, partition_key=1, secondary_key=1, data=1)["error"] == "InvalidArgument"
    assert say(call="nothing")["error"] == "InvalidArgument"


def test_some_table_is_checked(spark, made):
    s = spark.createDataFrame([(1, made.ring(1)[0].partition_id, 0.0, 0.0, 1, 0, 0, "0", 1.0, None)], "table_id long, partition_id string, reads_per_second double, writes_per_second double, contributing_nodes long, read_count long, write_count long, write_position_sum string, window_seconds double, median_write_position long")
    assert topology.check_some_table(made, s, 0).first().write_action == "merge"
    assert topology.check_some_table(topology.delete_table(made, 1), s, 0) is None


def test_a_split_keeps_the_number_of_replicas(spark, made):
    """A partition of four replicas is split into two of four."""
    start = made.ring(1)[1].hash_start
    four = topology.increase_replication(made, 1, start, 4)
    done = topology.split_partition(four, 1, start + 1000)
    assert [len(p.replicas) for p in done.ring(1) if p.hash_start in (start, start + 1000)] == [4, 4]
