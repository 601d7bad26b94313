"""The public calls on a store of snapshots: one request in, rows or a typed error out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import EngineError, InvalidArgument
from tidemark.functions.values import record_json
from tidemark.operators import reads
from tidemark.sources import log
from tidemark.streaming.state import Snapshots


class Store:
    """Records in a folder: writes are appended to a log and applied in batches, reads see the last snapshot.

    A write is acknowledged when it is logged; ``apply`` makes what is logged visible.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.snapshots = Snapshots(spark, f"{self.folder}/snapshots")
        self.next_seq = self._logged()
        self.applied_seq = self._applied()

    def _applied(self) -> int:
        """Up to where the log was applied before a restart: what comes after it waits."""
        try:
            last = self.spark.read.schema("next_seq long").json(f"{self.folder}/applied").agg(F.max("next_seq")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        return last or 0

    def _logged(self) -> int:
        """Where the log of the folder ends."""
        try:
            last = log.read(self.spark, f"{self.folder}/log").agg(F.max("seq")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            last = None
        return 0 if last is None else last + 1

    def submit(self, entries: list[log.Entry]) -> int:
        """Logs mutations in order; returns how many are waiting."""
        log.admit(self.next_seq - self.applied_seq)
        log.append(log.mutations(self.spark, entries, self.next_seq).coalesce(1), f"{self.folder}/log")
        self.next_seq += len(entries)
        return self.next_seq - self.applied_seq

    def apply(self) -> None:
        """Applies what is logged and not yet visible."""
        self.snapshots.follow(log.read_stream(self.spark, f"{self.folder}/log", 1000), f"{self.folder}/checkpoint").awaitTermination()
        self.applied_seq = self.next_seq
        self.spark.createDataFrame([(self.applied_seq,)], "next_seq long").coalesce(1).write.mode("append").json(f"{self.folder}/applied")

    def truncate(self) -> int:
        """Removes segments of the log that are applied, but the last, by which a restart knows the next place; and versions that were replaced."""
        self.snapshots.vacuum()
        return log.truncate(self.spark, f"{self.folder}/log", self.applied_seq - 1)

    def records(self) -> DataFrame:
        return self.snapshots.read()

    def get(self, table_id: int, partition_key: int, secondary_key: int, include_deleted: bool = False) -> DataFrame:
        return reads.found(reads.point(self.records(), table_id, partition_key, secondary_key, include_deleted))

    def range(self, table_id: int, lower: int, upper: int, include_deleted: bool = False) -> DataFrame:
        return reads.range_scan(self.records(), table_id, lower, upper, include_deleted)


def call(store: Store, request: str) -> str:
    """A call as JSON, answered as JSON: ``{"call": name, ...}`` to ``{"rows": [...]}`` or ``{"error": category, "message": text}``.  Payloads are JSON documents."""
    try:
        said = json.loads(request)
        name = said.pop("call", None)
        if name == "write":
            payload = json.dumps(said.pop("data", None), separators=(",", ":")).encode()
            return json.dumps({"waiting": store.submit([log.write(data=payload, at=said.pop("timestamp", -1), **said)])})
        if name in ("delete_record", "delete_table", "delete_partition_key", "delete_range"):
            at = {"at": said.pop("timestamp", -1)} if name == "delete_record" else {}
            return json.dumps({"waiting": store.submit([getattr(log, name)(**said, **at)])})
        if name in ("get", "range"):
            found = getattr(store, name)(**said).withColumn("data", F.when(F.col("deleted"), F.lit(b"null")).otherwise(F.col("data")))
            return json.dumps({"rows": [json.loads(r.j) for r in found.select(record_json().alias("j")).toLocalIterator()]})
        if name in ("count_range", "range_size"):
            return json.dumps({"rows": [getattr(reads, name)(store.records(), **said).first().asDict()]})
        raise InvalidArgument(f"unknown call {name!r}")
    except EngineError as e:
        return json.dumps({"error": type(e).__name__, "message": str(e)})
    except (TypeError, json.JSONDecodeError) as e:
        return json.dumps({"error": "InvalidArgument", "message": str(e)})
