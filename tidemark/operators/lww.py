"""Last-writer-wins state of records, from logs with ordered deletes and from replicas.

Of several versions of a key the one with the largest (timestamp, deleted, payload) wins;
payloads compare as unsigned bytes.  A label outlives the payload it came with: a key has the
last non-null label in order of arrival.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import KEYS, LONG_MAX, LONG_MIN

#: Physical deletes that are broadcast to the writes at once, as sorted segments of keys (16 bytes a bound); more are taken in blocks of about so many.
BROADCAST_DELETES = 500_000
#: Segments of a table up to which writes are compared with all of them in a join; beyond it they are looked up by binary search.
JOINED_SEGMENTS = 128


def version() -> Column:
    """What versions are ordered by; deletes carry no payload."""
    return F.struct("timestamp", "deleted", F.when(F.col("deleted"), F.lit(b"")).otherwise(F.col("data")).alias("data"))


def compact(writes: DataFrame, keys: list[str] | None = None, arrival: str = "seq") -> DataFrame:
    """One record for each key: the winning version and the last label; tombstones stay.

    A single aggregation with partial maxima: each map task sends at most one row per key,
    so keys that are written very often are no hot spots.
    """
    keys = keys or KEYS
    label = F.expr(f"max_by(partition_id, {arrival}) FILTER (WHERE partition_id IS NOT NULL)")
    best = writes.groupBy(*keys).agg(F.max(version()).alias("v"), label.alias("partition_id"))
    return best.select(*keys, "v.timestamp", "v.deleted", "v.data", "partition_id")


def reconcile(copies: DataFrame) -> DataFrame:
    """The records that replicas agree on: the best version of all copies; tombstones stay."""
    best = copies.groupBy(*KEYS).agg(F.max(F.struct("timestamp", "deleted", "data", "partition_id")).alias("v"))
    return best.select(*KEYS, "v.timestamp", "v.deleted", "v.data", "v.partition_id")


def scopes(deletes: DataFrame) -> DataFrame:
    """Physical deletes as ranges of keys, both ends included (table_id, lo, hi, seq): a table's are all keys, a partition key's that key."""
    kind = F.col("kind")
    ranges = deletes.select(
        "table_id", "seq",
        F.when(kind == "delete_table", F.lit(LONG_MIN)).when(kind == "delete_partition_key", F.col("partition_key")).otherwise(F.col("lower_bound")).alias("lo"),
        F.when(kind == "delete_table", F.lit(LONG_MAX)).when(kind == "delete_partition_key", F.col("partition_key")).otherwise(F.col("upper_bound") - 1).alias("hi"),
    )
    return ranges.where("lo <= hi")


def _blocks(rows: DataFrame, keys: list[str]) -> list[pd.DataFrame]:
    """The rows on the driver, about BROADCAST_DELETES at a time: deletes of whole scopes are few beside the writes they are applied to."""
    first = rows.limit(BROADCAST_DELETES + 1).toPandas()
    if len(first) <= BROADCAST_DELETES:
        return [first] if len(first) else []
    n = -(-rows.count() // BROADCAST_DELETES)
    blocks = (rows.where(F.pmod(F.xxhash64(*keys), F.lit(n)) == i).toPandas() for i in range(n))
    return [b for b in blocks if len(b)]


def segments(ranges: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """First keys of disjoint segments of one table, in order, and the last seq of the ranges over each (-1: none).

    Ranges are painted from the last to the first, and each segment once: what is painted is
    skipped by a pointer to the next one that isn't.
    """
    lo, hi, seq = (ranges[c].to_numpy(np.int64) for c in ("lo", "hi", "seq"))
    starts = np.unique(np.concatenate([lo, hi[hi < LONG_MAX] + 1]))
    first, end = np.searchsorted(starts, lo), np.searchsorted(starts, hi, side="right")
    gone, following = np.full(len(starts), -1, dtype=np.int64), list(range(len(starts) + 1))
    for i in np.argsort(-seq, kind="stable").tolist():
        trail, at = [], int(first[i])
        while at < end[i]:
            trail.append(at)
            if following[at] == at:
                gone[at] = seq[i]
                following[at] = at + 1
            at = following[at]
        for t in trail:
            following[t] = at
    return starts, gone


def _without(writes: DataFrame, block: pd.DataFrame) -> DataFrame:
    """Writes that no delete of the block follows: a lookup of each write's segment, without a shuffle."""
    found = {int(t): segments(rows) for t, rows in block.groupby("table_id")}
    if max(len(starts) for starts, _ in found.values()) <= JOINED_SEGMENTS:
        rows = [(t, int(s), int(starts[i + 1]) - 1 if i + 1 < len(starts) else LONG_MAX, int(g)) for t, (starts, gone) in found.items() for i, (s, g) in enumerate(zip(starts, gone)) if g >= 0]
        gone = writes.sparkSession.createDataFrame(rows, "gone_table long, gone_lo long, gone_hi long, gone_seq long")
        hit = (F.col("table_id") == F.col("gone_table")) & F.col("partition_key").between(F.col("gone_lo"), F.col("gone_hi")) & (F.col("gone_seq") > F.col("seq"))
        return writes.join(F.broadcast(gone), hit, "left_anti")  # at most BROADCAST_DELETES rows
    shared = writes.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("boolean")
    def stays(table: pd.Series, key: pd.Series, seq: pd.Series) -> pd.Series:
        out = np.ones(len(table), dtype=bool)
        for t, at in table.groupby(table).indices.items():
            starts, gone = shared.value.get(int(t), (None, None))
            if starts is not None:
                place = np.searchsorted(starts, key.to_numpy()[at], side="right") - 1
                out[at] = (place < 0) | (gone[place] <= seq.to_numpy()[at])
        return pd.Series(out)

    return writes.where(stays("table_id", "partition_key", "seq"))


def surviving(writes: DataFrame, deletes: DataFrame) -> DataFrame:
    """Writes that no physical delete of their scope follows in the log.

    Deletes of tables and partition keys are ranges of keys like any other.  The last one of
    each range is kept; the ranges of a table are cut into disjoint segments with a last
    delete each, and a write looks its segment up in these.  Writes are not shuffled, however
    many of them one table has; deletes are broadcast a bounded block at a time.
    """
    ranges = scopes(deletes).groupBy("table_id", "lo", "hi").agg(F.max("seq").alias("seq"))
    return reduce(_without, _blocks(ranges, ["table_id", "lo", "hi"]), writes)


def apply_mutations(mutations: DataFrame) -> DataFrame:
    """The records that a log leaves: surviving writes, compacted."""
    return compact(surviving(mutations.where("kind = 'write'"), mutations.where("kind <> 'write'")))


def apply_batch(snapshot: DataFrame, batch: DataFrame) -> DataFrame:
    """The next snapshot: the last one's records stand before everything in the batch."""
    before = snapshot.select(F.lit(-1).cast("long").alias("seq"), F.lit("write").alias("kind"), *KEYS, "data", "timestamp", "deleted", "partition_id", F.lit(None).cast("long").alias("lower_bound"), F.lit(None).cast("long").alias("upper_bound"))
    return apply_mutations(before.unionByName(batch.select(*before.columns)))


def _segment_of(cuts):  # noqa: ANN001, ANN202  a broadcast dictionary of sorted first keys by table; a UDF
    @F.pandas_udf("long")
    def segment(table: pd.Series, key: pd.Series) -> pd.Series:
        place = np.full(len(table), -1, dtype=np.int64)
        for t, at in table.groupby(table).indices.items():
            if int(t) in cuts.value:
                place[at] = np.searchsorted(cuts.value[int(t)], key.to_numpy()[at], side="right") - 1
        return pd.Series(place)

    return segment


def would_delete(records: DataFrame, deletes: DataFrame) -> DataFrame:
    """How many records each physical delete would remove, by its place in the log; the deletes themselves say nothing.

    Records are counted once by the segments that the deletes' bounds cut the keys into; a
    delete's count is the difference of two running sums.
    """
    spark = records.sparkSession
    out = []
    for block in _blocks(scopes(deletes), ["seq"]):
        cuts = {int(t): np.unique(np.concatenate([rows["lo"].to_numpy(np.int64), rows["hi"].to_numpy(np.int64)[rows["hi"].to_numpy() < LONG_MAX] + 1])) for t, rows in block.groupby("table_id")}
        segment = _segment_of(spark.sparkContext.broadcast(cuts))
        counted = records.groupBy("table_id", segment("table_id", "partition_key").alias("place")).agg(F.count("*").alias("n")).where("place >= 0").toPandas()
        before = {t: np.zeros(len(c) + 1, dtype=np.int64) for t, c in cuts.items()}
        for t, rows in counted.groupby("table_id"):
            np.add.at(before[int(t)], rows["place"].to_numpy() + 1, rows["n"].to_numpy())
        before = {t: np.cumsum(n) for t, n in before.items()}
        rows = [(int(q), int(before[t][np.searchsorted(cuts[t], hi, side="right")] - before[t][np.searchsorted(cuts[t], lo)])) for q, t, lo, hi in block[["seq", "table_id", "lo", "hi"]].itertuples(index=False)]
        out.append(spark.createDataFrame(rows, "seq long, n_records long"))
    return reduce(DataFrame.unionByName, out, spark.createDataFrame([], "seq long, n_records long"))
