import base64
import gzip
import hashlib
import math

import numpy as np
import pytest
from oracle import same
from pyspark.sql import functions as F

from tidemark.llm import components, embeddings, queries, warc
from tidemark.llm.common import skew_join
from tidemark.llm.shards import filesystem

PAGES = "page_id long, url string, html string"


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_archives_of_all_pages(spark, sf_dir):
    pages = [(r.page_id, r.html or "") for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    first = {}
    for i, h in sorted(pages):
        first.setdefault(h, i)
    got = queries.op5_warc(spark, sf_dir).collect()
    assert sorted(map(tuple, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got])) == sorted((i, len(h.encode()), sha(h), "response" if first[h] == i else "revisit", None if first[h] == i else first[h]) for i, h in pages)


def test_archives_of_odd_rows(spark, tmp_path):
    rows = [(2, "u", "a"), (1, "v", "a"), (1, "v", "a"), (None, None, "b"), (3, None, None), (4, "x", ""), (5, "x\n y", "q\r\n\r\nz"), (5, "x", "other"), (6, "x", "é" * 100_000), (7, "x", "long enough"), (8, "x", "long enough")]
    df = spark.createDataFrame(rows, PAGES).withColumn("sha1", F.lit("own"))
    got = {(r.id, r.record_type, r.refers_to, r.payload_digest) for r in warc.round_trip(df).collect()}
    assert got == {(1, "response", None, sha("a")), (1, "revisit", 1, sha("a")), (2, "revisit", 1, sha("a")), (None, "response", None, sha("b")), (3, "response", None, sha("")), (4, "revisit", 3, sha("")), (5, "response", None, sha("q\r\n\r\nz")), (5, "response", None, sha("other")), (6, "response", None, sha("é" * 100_000)), (7, "response", None, sha("long enough")), (8, "revisit", 7, sha("long enough"))}
    few = warc.read_archives(warc.write_archives(df, f"{tmp_path}/few", least_bytes=5), with_payload=True).collect()
    assert {(r.id, r.record_type) for r in few if r.record_type == "revisit"} == {(8, "revisit")}
    assert {bytes(r.payload) for r in few if r.id == 5} == {b"q\r\n\r\nz", b"other"}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_files_roll_and_are_the_same_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 2000)
    df = spark.createDataFrame([(i, f"http://h/{i}", "".join(chr(97 + (i * j) % 26) for j in range(700))) for i in range(60)], PAGES)
    seen = []
    for k, dealt in enumerate((df.coalesce(1), df.repartition(7), df.repartition(3, "url"))):
        spark.conf.set("spark.sql.shuffle.partitions", 2 + 3 * k)
        manifest = warc.write_archives(dealt, f"{tmp_path}/{k}")
        fs, place = filesystem(f"{tmp_path}/{k}")
        names = sorted(r.path.rsplit("/", 1)[1] for r in manifest.collect())
        data = [open(f"{place}/{n}", "rb").read() for n in names]
        assert all(gzip.decompress(d).startswith(b"WARC/1.1\r\n") for d in data)
        seen.append((names, data))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert seen[0] == seen[1] == seen[2]
    assert manifest.agg(F.sum("records")).first()[0] == 60 and manifest.count() > 4


def test_shards_are_the_same_from_any_partitions(spark, tmp_path, monkeypatch):
    """Many shards, rows that repeat, hot rows written in runs: names and bytes don't depend on how rows are dealt out."""
    monkeypatch.setattr(warc, "LEAST_SHARD", 4000)
    monkeypatch.setattr(warc, "COPIES", 5)
    rows = [(i % 90, f"http://h/{i}", f"text {i % 70} " * (1 + i % 9)) for i in range(300)] + [(None, None, None)] * 23 + [(7, "u", "same")] * 17 + [(8, "u", "same")] * 2
    df = spark.createDataFrame(rows, PAGES)
    seen = []
    for k, dealt in enumerate((df.coalesce(1), df.repartition(9), df.repartition(4, "html"))):
        spark.conf.set("spark.sql.shuffle.partitions", 3 + 4 * k)
        manifest = warc.write_archives(dealt, f"{tmp_path}/{k}").collect()
        seen.append(sorted((r.path.rsplit("/", 1)[1], open(filesystem(r.path)[1], "rb").read()) for r in manifest))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 8
    ids = [line for _, data in seen[0] for line in gzip.decompress(data).split(b"\r\n") if line.startswith(b"WARC-Record-ID")]
    assert len(ids) == len(set(ids)) == len(rows)
    got = warc.round_trip(df).collect()
    first = {}
    for i, u, h in sorted(rows, key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1])):
        first.setdefault(h or "", (i, u))
    used, expected = set(), []
    for i, u, h in rows:
        is_first = first[h or ""] == (i, u) and (h or "") not in used
        used |= {h or ""} if is_first else set()
        expected.append((i, u, sha(h or ""), "response" if is_first else "revisit", None if is_first else first[h or ""][0]))
    assert sorted(map(str, [(r.id, r.url, r.payload_digest, r.record_type, r.refers_to) for r in got])) == sorted(map(str, expected))
    assert {r.record_type for r in warc.read_archives(warc.write_archives(df, f"{tmp_path}/all", least_bytes=1000)).collect()} == {"response"}


def test_a_damaged_record_is_seen():
    data = bytearray(warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), 7))
    data[-8] ^= 1
    with pytest.raises(ValueError):
        warc.parse(bytes(data))


def brute(rows, least=0.93):
    fine = lambda v: v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links = [[] for _ in rows]
    for i, (_, v, l) in enumerate(rows):
        for j, (_, w, m) in enumerate(rows[:i]):
            if l is not None and l == m and fine(v) and fine(w) and len(v) == len(w):
                a, b = np.array(v, float), np.array(w, float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    links[i].append(j), links[j].append(i)
    out = []
    for i, (k, _, _) in enumerate(rows):
        seen, stack = {i}, [i]
        while stack:
            new = set(links[stack.pop()]) - seen
            seen |= new
            stack += new
        out.append((k, len(links[i]), min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)))
    return sorted(out, key=str)


def near(df):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicates(df).collect()), key=str)


def test_vectors_of_odd_rows(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.1], 1), (2, [1.0, 0.1], 1), (3, [1.0, 0.1], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1), (None, [2.0, 0.0], 1), (8, [1.0, 0.0, 0.0], 1), (9, [], 1), (10, [1.0, 0.0], None), (11, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("class", F.lit("own"))
    assert near(df) == brute(rows)
    assert near(df.limit(0)) == []


def test_vectors_equal_brute_force(spark, monkeypatch):
    """Groups larger than window and chunk, chains, copies and scaled copies."""
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    monkeypatch.setattr(embeddings, "CHUNKS", 2)
    monkeypatch.setattr(embeddings, "MOST", 24)
    r = np.random.default_rng(4)
    rows = []
    for g in range(12):
        centre = r.standard_normal(16)
        for _ in range(2 + 12 * g // 2):
            rows.append((centre + r.standard_normal(16) * r.choice([0.02, 0.2, 0.3])).tolist())
    rows += rows[:5] + [(np.array(x) * 2).tolist() for x in rows[:5]] + r.standard_normal((100, 16)).tolist()
    rows = [(i, [float(np.float32(x)) for x in v], i % 7 % 3) for i, v in enumerate(rows)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert near(df) == brute(rows)


def test_more_vectors_take_more_passes():
    assert embeddings.passes_for(10, 0.93) == embeddings.LEAST_PASSES
    assert embeddings.passes_for(10**6, 0.93) < embeddings.passes_for(10**9, 0.93)


def test_vectors_with_a_common_direction_are_found(spark):
    """Passes go on until they find nothing new, so a direction that all vectors have in common loses no pair."""
    r = np.random.default_rng(8)
    common = r.standard_normal(32)
    common /= np.linalg.norm(common)

    def unit(x):
        return x / np.linalg.norm(x)

    def own():
        x = r.standard_normal(32)
        return unit(x - (x @ common) * common)

    rows = []
    for i in range(4000):
        x = np.sqrt(0.7) * common + np.sqrt(0.3) * own()
        rows.append(x)
        if i % 20 == 0:
            y = r.standard_normal(32)
            rows.append(0.94 * x + np.sqrt(1 - 0.94**2) * unit(y - (y @ x) * x))
    units = np.array([[float(np.float32(v)) for v in x] for x in rows])
    units /= np.linalg.norm(units, axis=1, keepdims=True)
    n_links = (units @ units.T >= 0.93).sum(axis=1) - 1
    assert (n_links > 0).sum() >= 400
    df = spark.createDataFrame([(i, [float(v) for v in x], 1) for i, x in enumerate(rows)], "vec_id long, embedding array<float>, label int")
    got = {i: n for i, n, _ in near(df)}
    assert sum(got[i] != n for i, n in enumerate(n_links.tolist())) <= 2


def test_vectors_of_very_large_and_small_numbers(spark):
    rows = [(1, [1e200, 0.0], 1), (2, [1e200, 1e199], 1), (3, [1e-200, 1e-201], 1), (4, [0.0, 1e300], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert near(df) == [(1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 0, 4)]


def test_vectors_equal_their_sql(spark, sf_dir):
    same(spark, sf_dir, queries.op7_embeddings, embeddings.ORACLE_SQL)


def test_components(spark):
    import random

    r = random.Random(6)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(500 + i, 501 + i) for i in range(40)] + [(9, 9), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_skew_join_splits_heavy_keys(spark):
    big = spark.range(5000).selectExpr("CASE WHEN id % 2 = 0 THEN 7 ELSE id END AS k", "id")
    keyed = big.groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", F.col("k") + 1)
    got = skew_join(big, keyed, ["k"], "n")
    assert got.count() == 5000 and got.where("v <> k + 1").count() == 0
