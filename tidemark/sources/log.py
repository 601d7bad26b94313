"""The mutation log: building entries, writing and reading segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import ResourceExhausted
from tidemark.functions.checks import bounds, timestamp, whole
from tidemark.schema import BACKLOG_LIMIT, MUTATIONS

Entry = dict


def write(table_id: int, partition_key: int, secondary_key: int, data: bytes, at: int, *, deleted: bool = False, partition_id: str | None = None) -> Entry:
    """A write; a deleted one is a tombstone and carries no payload."""
    keys = {k: whole(v, k) for k, v in (("table_id", table_id), ("partition_key", partition_key), ("secondary_key", secondary_key))}
    return {"kind": "write", **keys, "data": b"" if deleted else bytes(data), "timestamp": timestamp(at), "deleted": deleted, "partition_id": partition_id}


def delete_record(table_id: int, partition_key: int, secondary_key: int, at: int) -> Entry:
    return write(table_id, partition_key, secondary_key, b"", at, deleted=True)


def delete_table(table_id: int) -> Entry:
    return {"kind": "delete_table", "table_id": whole(table_id, "table_id")}


def delete_partition_key(table_id: int, partition_key: int) -> Entry:
    return {"kind": "delete_partition_key", "table_id": whole(table_id, "table_id"), "partition_key": whole(partition_key, "partition_key")}


def delete_range(table_id: int, lower: int, upper: int) -> Entry:
    bounds(lower, upper)
    return {"kind": "delete_range", "table_id": whole(table_id, "table_id"), "lower_bound": lower, "upper_bound": upper}


def mutations(spark: SparkSession, entries: list[Entry], first_seq: int = 0) -> DataFrame:
    """Entries as a log, in this order."""
    names = [f.name for f in MUTATIONS]
    return spark.createDataFrame([tuple({"seq": first_seq + i, **e}.get(n) for n in names) for i, e in enumerate(entries)], MUTATIONS)


def admit(waiting: int, limit: int = BACKLOG_LIMIT) -> None:
    """Refuses a write before it is logged if too many wait."""
    if waiting >= limit:
        raise ResourceExhausted(f"{waiting} mutations wait to be applied")


def append(log: DataFrame, path: str) -> None:
    """Adds a segment; payloads are Base64 text in JSON lines."""
    log.withColumn("data", F.base64("data")).write.mode("append").json(path)


def _decoded(raw: DataFrame) -> DataFrame:
    return raw.withColumn("data", F.unbase64("data")).select(*[f.name for f in MUTATIONS])


def _json_schema() -> str:
    return ", ".join(f"{f.name} {'string' if f.name == 'data' else f.dataType.simpleString()}" for f in MUTATIONS)


def read(spark: SparkSession, path: str, from_seq: int | None = None) -> DataFrame:
    """The log from a sequence number on; fields that older entries lack are null."""
    log = _decoded(spark.read.schema(_json_schema()).json(path))
    return log if from_seq is None else log.where(F.col("seq") >= from_seq)


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The log as a stream; a checkpoint remembers how far it was read."""
    return _decoded(spark.readStream.schema(_json_schema()).option("maxFilesPerTrigger", files_per_batch).json(path))


def truncated(log: DataFrame, committed_seq: int) -> DataFrame:
    """What must be kept once everything below a sequence number is applied."""
    return log.where(F.col("seq") >= committed_seq)


def truncate(spark: SparkSession, path: str, committed_seq: int) -> int:
    """Removes the segment files of which every entry is below a sequence number, as all of these are applied; returns how many went."""
    last = spark.read.schema(_json_schema()).json(path).groupBy(F.input_file_name().alias("file")).agg(F.max("seq").alias("last"))
    return remove(spark, [r.file for r in last.where(F.col("last") < committed_seq).collect()])  # a row a segment


def remove(spark: SparkSession, places: list[str]) -> int:
    """Deletes files or folders by way of Spark's file systems."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(p) for p in places]
    return sum(bool(p.getFileSystem(conf).delete(p, True)) for p in paths)
