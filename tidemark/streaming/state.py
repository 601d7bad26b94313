"""Records and statistics kept up to date as the log grows."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.lww import apply_batch
from tidemark.operators.telemetry import GROUP, access_stats, pruned
from tidemark.functions.checks import sampled
from tidemark.schema import KEYS, RETENTION_MS
from tidemark.sources.log import remove


class Snapshots:
    """Records in a folder, in buckets of keys; a batch rewrites the buckets that it touches.

    Each batch writes its buckets under its own number, then a line of the pointer file that
    says which batch each bucket is of now.  Readers go by the last line, so they see a batch
    as a whole or not at all.  A batch that runs again finds its line there and does nothing:
    each batch counts once.  Versions that no line needs any more go with ``vacuum``.
    """

    SCHEMA = "table_id long, partition_key long, secondary_key long, timestamp long, deleted boolean, data binary, partition_id string"

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    def _bucket(self) -> Column:
        """Records of a partition key are together."""
        return F.pmod(F.xxhash64("table_id", "partition_key"), F.lit(self.buckets)).cast("int")

    def _line(self, batch: int | None = None) -> tuple[int, dict[int, int]]:
        """A batch (by default the last) and the batch that each bucket is of."""
        try:
            lines = self.spark.read.schema("batch long, buckets array<int>, batches array<long>").json(posixpath.join(self.folder, "current"))
            found = (lines if batch is None else lines.where(F.col("batch") == batch)).orderBy(F.desc("batch")).first()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            found = None
        return (-1, {}) if found is None else (found.batch, dict(zip(found.buckets, found.batches)))

    def current(self) -> int:
        return self._line()[0]

    def _read(self, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/batch={n}/bucket={b}" for b, n in sorted(held.items())]
        return self.spark.read.schema(self.SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], self.SCHEMA)

    def read(self, batch: int | None = None) -> DataFrame:
        return self._read(self._line(batch)[1])

    def read_key(self, table_id: int, partition_key: int) -> DataFrame:
        """The records of the bucket that holds a partition key."""
        _, held = self._line()
        own = self.spark.range(1).select(F.lit(table_id).cast("long").alias("table_id"), F.lit(partition_key).cast("long").alias("partition_key")).select(self._bucket()).first()[0]
        return self._read({b: n for b, n in held.items() if b == own})

    def apply(self, batch: DataFrame, number: int) -> None:
        """Writes the buckets that a batch touches, sorted by key so that reads skip row groups; a delete of a table or range touches all."""
        before, held = self._line()
        if number <= before:
            return
        batch = batch.persist()  # it is read for its buckets, its writes and its deletes
        whole = not batch.where("kind IN ('delete_table', 'delete_range')").isEmpty()
        keyed = {r.b for r in batch.where("partition_key IS NOT NULL").select(self._bucket().alias("b")).distinct().collect()}  # at most ``buckets`` rows
        touched = keyed | set(held) if whole else keyed
        after = apply_batch(self._read({b: n for b, n in held.items() if b in touched}), batch).withColumn("bucket", self._bucket())
        after.repartition("bucket").sortWithinPartitions("bucket", *KEYS).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/batch={number}")
        batch.unpersist()
        written = self.spark.read.schema(f"{self.SCHEMA}, bucket int").parquet(f"{self.folder}/batch={number}").select("bucket").distinct().collect()
        now = {b: n for b, n in held.items() if b not in touched} | {r.bucket: number for r in written}
        self.spark.createDataFrame([(number, list(now), list(now.values()))], "batch long, buckets array<int>, batches array<long>").coalesce(1).write.mode("append").json(posixpath.join(self.folder, "current"))

    def vacuum(self) -> int:
        """Removes buckets that a later batch has replaced; returns how many."""
        last, held = self._line()
        lines = self.spark.read.schema("batch long, buckets array<int>, batches array<long>").json(posixpath.join(self.folder, "current"))
        old = lines.select(F.explode(F.arrays_zip("buckets", "batches")).alias("x")).select("x.buckets", "x.batches").distinct().collect()
        return remove(self.spark, [f"{self.folder}/batch={r.batches}/bucket={r.buckets}" for r in old if held.get(r.buckets) != r.batches])

    def follow(self, log: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Applies a log's stream: all that is there, or forever with ``every``.  There is no watermark: a late write counts as any other."""
        out = log.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


class Statistics:
    """Statistics of accesses as samples in a folder, by batch; replaying a batch overwrites its own samples.

    A checkpoint says up to which place in the log the samples go; accesses from there on are
    what a restart has to replay.  Samples older than the retention aren't read, and ``prune``
    removes the batches that have no others.
    """

    def __init__(self, spark: SparkSession, folder: str, retention_ms: int = RETENTION_MS) -> None:
        self.spark, self.folder, self.retention_ms = spark, folder.rstrip("/"), retention_ms

    def flush(self, accesses: DataFrame, number: int) -> None:
        """Adds a batch's samples; accesses older than the retention, counted back from the batch's newest, are left out."""
        said = accesses.agg(F.max("time_ms").alias("now"), F.max("seq").alias("seq")).first()
        if said.now is None:
            return
        kept = accesses.where(F.col("time_ms") >= said.now - self.retention_ms)
        access_stats(kept, said.now).write.mode("overwrite").parquet(f"{self.folder}/samples/batch={number}")
        self.spark.createDataFrame([(number, said.seq + 1, said.now)], "batch long, next_seq long, now_ms long").coalesce(1).write.mode("overwrite").json(f"{self.folder}/checkpoint/batch={number}")

    def _checkpoints(self) -> DataFrame:
        try:
            return self.spark.read.schema("batch long, next_seq long, now_ms long").json(f"{self.folder}/checkpoint")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "batch long, next_seq long, now_ms long")

    def checkpoint(self) -> int:
        """The first place in the log that no sample holds."""
        return self._checkpoints().agg(F.max("next_seq")).first()[0] or 0

    def read(self) -> DataFrame:
        newest = self._checkpoints().agg(F.max("now_ms")).first()[0] or 0
        return pruned(self.spark.read.parquet(f"{self.folder}/samples").drop("batch"), newest, self.retention_ms)

    def prune(self, now_ms: int) -> int:
        """Removes batches whose samples have all ended before the retention; returns how many."""
        ended = self._checkpoints().where(F.col("now_ms") < now_ms - self.retention_ms).select("batch").collect()
        gone = remove(self.spark, [f"{self.folder}/samples/batch={r.batch}" for r in ended])
        return gone

    def follow(self, accesses: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        out = accesses.writeStream.foreachBatch(self.flush).option("checkpointLocation", checkpoint)
        return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def windowed(accesses: DataFrame, width: str = "60 seconds", retention: str = "30 days") -> DataFrame:
    """Reads and writes by tumbling window of a stream's ``time_ms``; what is later than the retention is dropped."""
    timed = accesses.where(sampled()).withColumn("time", F.timestamp_millis("time_ms")).withWatermark("time", retention)
    counted = timed.groupBy(*GROUP, F.window("time", width)).agg(F.count_if(~F.col("is_write")).alias("read_count"), F.count_if("is_write").alias("write_count"))
    return counted.select(*GROUP, F.unix_millis("window.start").alias("window_start_ms"), "read_count", "write_count")


def latest_versions(writes: DataFrame) -> DataFrame:
    """Winning versions by key of a stream of writes, as a running aggregate without a watermark (for logs without physical deletes)."""
    best = F.max(F.struct("timestamp", "deleted", F.when(F.col("deleted"), F.lit(b"")).otherwise(F.col("data")).alias("data"))).alias("v")
    label = F.expr("max_by(partition_id, seq) FILTER (WHERE partition_id IS NOT NULL)").alias("partition_id")
    return writes.groupBy(*KEYS).agg(best, label).select(*KEYS, "v.timestamp", "v.deleted", "v.data", "partition_id")


def progress(query: StreamingQuery) -> dict:
    """Rows of the last batch and where the source stands."""
    last = query.lastProgress
    return {} if last is None else {"batch": last["batchId"], "rows": last["numInputRows"], "offsets": json.dumps(last["sources"][0].get("endOffset"))}
