"""WARC archives: a sharded writer whose files depend on the records alone, and a reader."""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import HEAVY_SHARE, scratch_path, skew_join, stored
from tidemark.llm.shards import committed, file_rows, filesystem, make_folder, save_manifest

#: A file is closed at so many compressed bytes.
FILE_BYTES = 32 << 20
#: Shards are SHARDS equal parts of the records' bytes, or of so many bytes at least and at most; their first rows (16 bytes a shard) are broadcast, of MOST_SHARDS at most.
SHARDS, LEAST_SHARD, MOST_SHARD, MOST_SHARDS = 256, 4 << 20, 256 << 20, 1 << 20
#: Shards are written by a task each, or by so many tasks.
MOST_TASKS = 32_768
HEADER_BYTES = 512
#: Rows that are the same in all columns, and over a thousandth of the table, are written in runs of so many.
COPIES = 10_000
LEVEL = 6
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"  # records carry no time of capture
#: Own header fields: the row's id, and that of the record a revisit refers to.
ID_FIELD = "X-Page-ID"
REFERS_FIELD = "X-Refers-To-Page-ID"


def digest(data: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, sha1: str, copy: int = 0) -> str:
    """Another one for each row; ``copy`` numbers the rows that agree in all three."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {sha1} {copy} {url}')}>"


def _field(value: str) -> str:
    """A header value on one line."""
    return " ".join(value.split())


def record(page_id: int | None, url: str | None, payload: bytes | None, sha1: str, size: int, copy: int = 0, to: tuple[int | None, str | None] | None = None) -> bytes:
    """A record with its headers and digests made anew; a revisit (of ``to``) keeps the payload's HTTP headers only and has no need of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if to else http + payload
    stated = base64.b32encode(bytes.fromhex(sha1)).decode() if to else digest(payload)
    fields = [("WARC-Type", "revisit" if to else "response"), ("WARC-Record-ID", record_id(page_id, url, sha1, copy)), ("WARC-Date", DATE)]
    fields += [("WARC-Target-URI", _field(url))] if url else []
    fields += [(ID_FIELD, str(page_id))] if page_id is not None else []
    if to:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(*to, sha1))]
        fields += [(REFERS_FIELD, str(to[0]))] if to[0] is not None else []
    fields += [("WARC-Payload-Digest", f"sha1:{stated}"), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """The record as a gzip member without a time stamp."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(stream) -> Iterator[bytes]:  # noqa: ANN001
    """The gzip members of a file, one after another; a member is held at a time."""
    unpack, parts, data = zlib.decompressobj(31), [], b""
    while True:
        if not data and not (data := stream.read(1 << 20)):
            if parts or not unpack.eof and unpack.unconsumed_tail:
                raise ValueError("the file ends within a record")
            return
        parts.append(unpack.decompress(data))
        data = unpack.unused_data
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []


def parse(data: bytes) -> dict:
    """A record's row; digests are checked against what the record holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if first != VERSION:
        raise ValueError(f"not a record: {first[:20]!r}")
    fields = dict(line.decode("utf-8", "surrogatepass").split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError("the block's digest is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    n = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and (len(payload) != n or digest(payload) != stated):
        raise ValueError("the payload isn't what the headers say")
    whole = lambda x: None if x is None else int(x)
    return {"id": whole(fields.get(ID_FIELD)), "url": fields.get("WARC-Target-URI"), "payload_bytes": n, "payload_digest": stated, "record_type": fields["WARC-Type"], "refers_to": whole(fields.get(REFERS_FIELD)), "payload": None if revisit else payload}


def _bounds(light: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """First (key, h) of each shard, by exact running sums of sizes over the sorted rows.

    Rows are sorted in whatever ranges Spark's sampling gives; running sums within ranges and
    the ranges' totals together give each row's place in the whole, which no sampling changes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
        for batch in batches:
            ends = total + np.cumsum(batch.column(2).to_numpy())
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.full(len(ends), part)), pa.array(ends), pa.array(ends - batch.column(2).to_numpy())], names=["key", "h", "part", "end", "begin"])

    placed = stored(light.repartitionByRange("key", "h").sortWithinPartitions("key", "h").mapInArrow(run, "key long, h long, part long, end long, begin long"), "record_places")
    totals = {r.part: r.end for r in placed.groupBy("part").agg(F.max("end").alias("end")).collect()}  # a row a partition
    if not totals:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    whole, before, at = sum(totals.values()), [], 0
    for part in sorted(totals):
        before.append((part, at))
        at += totals[part]
    step = max(min(max(whole // SHARDS, LEAST_SHARD), MOST_SHARD), whole // MOST_SHARDS + 1)
    starts = placed.sparkSession.createDataFrame(before, "part long, before long")
    shard = ((F.col("begin") + F.col("before")) / step).cast("long")
    first = placed.join(F.broadcast(starts), "part").groupBy(shard.alias("shard")).agg(F.min(F.struct("key", "h")).alias("first")).orderBy("shard").select("first.*").toPandas()
    return first["key"].to_numpy(np.int64), first["h"].to_numpy(np.int64)


def write_archives(pages: DataFrame, folder: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row in ascending order of the (integer) id; returns the manifest (part, seq, path, records, bytes).

    Of rows with equal payloads of ``least_bytes`` or more, that with the smallest id (then
    url) is a response and the others are revisits that refer to it.  Minima are aggregated
    by digest before they are shuffled, and a digest that very many rows share is looked up
    by broadcast (``skew_join``).  What rows refer to then travels beside the records: both
    are dealt out by shard together, so payloads are shuffled once and never joined.

    The archives depend on the rows alone, not on the session, its cores, partitions or
    samples: shards are cut from exact running sums of sizes (``_bounds``), at most
    MOST_SHARDS of them, records are sorted, gzip members have no time stamp, names, ids and
    digests come from shard and record.  Files are rolled at FILE_BYTES and written under
    temporary names; only those that the manifest lists count.

    Null html: an empty payload.  Null ids come first, without the id field.  Null urls: no
    target field.  Rows that are the same in all three columns: the first is the response.
    Of such rows that are over a thousandth of the table, the first goes with its shard and
    the others are written as runs of COPIES in shards of their own.  An empty table gives no
    files.
    """
    make_folder(folder)
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("sha1"))
    rows = rows.withColumns({"key": F.coalesce("id", F.lit(-(1 << 63))), "h": F.xxhash64("url", "sha1"), "size": F.octet_length("payload").cast("long")})
    same = ["id", "url", "sha1"]
    counted = stored(rows.groupBy(*same, "key", "h", "size").agg(F.count("*").alias("copies")), "records")
    first = stored(counted.where(F.col("size") >= least_bytes).groupBy("sha1").agg(F.min(F.struct("id", "url")).alias("to"), F.sum("copies").alias("n")).where("n > 1"), "first_payloads")
    named = skew_join(counted.where(F.col("size") >= least_bytes), first, ["sha1"], "n").select(*same, "key", "h", "size", F.col("to.id").alias("to_id"), F.col("to.url").alias("to_url"))

    limit = max(COPIES, (counted.agg(F.sum("copies")).first()[0] or 0) // HEAVY_SHARE)
    hot = counted.where(F.col("copies") > limit).orderBy(*same).collect()  # fewer than HEAVY_SHARE
    keys, hs = _bounds(counted.select("key", "h", ((F.col("size") + HEADER_BYTES) * F.when(F.col("copies") > limit, 1).otherwise(F.col("copies"))).alias("size")))
    if hot:
        many = F.broadcast(spark.createDataFrame([(r.id, r.url, r.sha1) for r in hot], "hot_id long, hot_url string, hot_sha1 string"))
        is_hot = F.col("id").eqNullSafe(F.col("hot_id")) & F.col("url").eqNullSafe(F.col("hot_url")) & (F.col("sha1") == F.col("hot_sha1"))
        rows = rows.join(many, is_hot, "left_anti").unionByName(rows.join(many, is_hot, "left_semi").dropDuplicates(same))
    table = spark.sparkContext.broadcast((keys, hs))

    @F.pandas_udf("long")
    def shard_of(key: pd.Series, h: pd.Series) -> pd.Series:
        keys, hs = table.value
        key, h = key.to_numpy(), h.to_numpy()
        lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        out = hi - 1  # the last shard that begins at this key or below, if it begins with this h or below
        for i in np.flatnonzero(lo < hi):
            out[i] = lo[i] + np.searchsorted(hs[lo[i] : hi[i]], h[i], "right") - 1
        return pd.Series(np.maximum(out, 0))

    none = {"to_id": F.lit(None).cast("long"), "to_url": F.lit(None).cast("string")}
    both = rows.withColumns(none | {"copy": F.lit(0).cast("long"), "run": F.lit(1).cast("long")}).unionByName(named.withColumns({"payload": F.lit(None).cast("binary"), "copy": F.lit(-1).cast("long"), "run": F.lit(0).cast("long")}))
    both, at = both.withColumn("shard", shard_of("key", "h")), len(keys)
    if hot:
        begins = []
        for r in hot:
            begins.append((r.id, r.url, r.sha1, r.copies, at))
            at += -(-(r.copies - 1) // COPIES)
        runs = spark.createDataFrame(begins, "id long, url string, sha1 string, copies long, at long").withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), ((F.col("copies") - 2) / COPIES).cast("long"))))
        runs = runs.select(F.col("id").alias("hot_id"), F.col("url").alias("hot_url"), F.col("sha1").alias("hot_sha1"), (F.col("c") * COPIES + 1).alias("copy"), F.least(F.lit(COPIES), F.col("copies") - 1 - F.col("c") * COPIES).alias("run"), (F.col("at") + F.col("c")).alias("shard"))
        once = rows.join(many, is_hot, "left_semi")
        told = once.join(F.broadcast(named.join(many, is_hot, "left_semi").select(F.col("id").alias("n_id"), F.col("url").alias("n_url"), F.col("sha1").alias("n_sha1"), "to_id", "to_url")), F.col("id").eqNullSafe(F.col("n_id")) & F.col("url").eqNullSafe(F.col("n_url")) & (F.col("sha1") == F.col("n_sha1")), "left")
        told = told.withColumn("payload", F.when(F.col("size") < least_bytes, F.col("payload"))).join(F.broadcast(runs), is_hot)
        both = both.unionByName(told.select(*both.columns))
    tasks = min(max(at, 1), MOST_TASKS)
    ordered = both.repartitionById(tasks, F.floor(F.col("shard") * tasks / max(at, 1)).cast("int")).sortWithinPartitions("shard", *same, "copy")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, place = filesystem(folder)

        def records() -> Iterator[tuple[int, bytes]]:
            key, to, copies = None, None, 0
            for batch in batches:
                for shard, page_id, url, payload, sha1, size, to_id, to_url, copy, run in zip(*(c.to_pylist() if c.type != pa.binary() else c for c in batch.columns)):
                    if key != (shard, page_id, url, sha1):
                        key, to, copies = (shard, page_id, url, sha1), None, 0
                    if copy < 0:  # what the records after it refer to
                        to = (to_id, to_url)
                    elif copy:  # a run of copies of a record that is in another shard
                        of = (to_id, to_url) if not payload.is_valid else None
                        for i in range(run):
                            yield shard, record(page_id, url, payload.as_py(), sha1, size, copy + i, of)
                    else:
                        revisit = to is not None and (copies > 0 or to != (page_id, url))
                        yield shard, record(page_id, url, None if revisit else payload.as_py(), sha1, size, copies, to if revisit else None)
                        copies += 1

        found = records()
        item, seq, last = next(found, None), 0, None
        while item is not None:
            shard = item[0]
            seq, last = seq + 1 if shard == last else 0, shard
            name, n, size = f"part-{shard:06d}-{seq:06d}.warc.gz", 0, 0
            with committed(fs, posixpath.join(place, name)) as out:
                while item is not None and item[0] == shard and size < FILE_BYTES:
                    packed = member(item[1])
                    out.write(packed)
                    n, size = n + 1, size + len(packed)
                    item = next(found, None)
            yield pa.RecordBatch.from_pylist([{"part": shard, "seq": seq, "path": posixpath.join(folder, name), "records": n, "bytes": size}])

    return save_manifest(ordered.select("shard", *same[:2], "payload", "sha1", "size", "to_id", "to_url", "copy", "run").mapInArrow(write, "part long, seq long, path string, records long, bytes long"), folder)


def read_archives(manifest: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives: id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload (null for revisits) if asked for."""
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * with_payload)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, place = filesystem(path)
                with fs.open_input_stream(place, compression=None) as stream:
                    held, size = [], 0
                    for data in members(stream):
                        held.append({k: v for k, v in parse(data).items() if with_payload or k != "payload"})
                        size += len(data)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    yield pa.RecordBatch.from_pylist(held, schema=schema)

    dealt = file_rows(manifest, manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return dealt.select("path").mapInArrow(read, "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)


def round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:  # noqa: ANN003
    """Writes the archives (by default to a new place in the shared folder) and reads them back."""
    return read_archives(write_archives(pages, folder or scratch_path(pages.sparkSession, "warc"), **options))
