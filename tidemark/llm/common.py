"""What the operators of this subpackage share: scratch tables, null-safe keys, skew-proof joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is heavy if it holds over a 1/HEAVY_SHARE part of the rows; so fewer than HEAVY_SHARE keys are, whatever the input's size.
HEAVY_SHARE = 1000
_KEPT: dict[str, Any] = {}


def worker_keeps(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task, made when it isn't there.

    A worker serves one stage after another; it keeps the last thing asked for alone, so the
    caches of several operators don't add up in its memory.
    """
    if name not in _KEPT:
        _KEPT.clear()
        pa.default_memory_pool().release_unused()
        _KEPT[name] = make()
    return _KEPT[name]


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; a temporary one, set for the session, only where none is configured (tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            return found.get()
        place = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(place)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return place


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes the rows to the shared folder and reads them back, which cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of the table has (compared without case), one for each name asked for."""
    taken = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def skew_join(big: DataFrame, keyed: DataFrame, keys: list[str], rows: str, how: str = "inner") -> DataFrame:
    """Joins ``big`` with ``keyed`` (unique in ``keys``; ``rows`` counts a key's rows in ``big``).

    Keys with more than a thousandth of all rows are looked up by broadcast: they are fewer
    than HEAVY_SHARE whatever the input's size.  The rest goes through a shuffle in which no
    key holds more than that share.  ``keyed`` is read several times, so it should be stored.
    """
    total = keyed.agg(F.sum(rows)).first()[0] or 0
    limit = max(HEAVY_SHARE, total // HEAVY_SHARE)
    heavy = keyed.where(F.col(rows) > limit)
    if total <= limit or heavy.isEmpty():
        return big.join(keyed.drop(rows), keys, how)
    (flag,) = fresh(big, "is_heavy")
    seen = big.join(F.broadcast(heavy.drop(rows).withColumn(flag, F.lit(True))), keys, "left")
    light = seen.where(F.col(flag).isNull()).select(*big.columns).join(keyed.where(F.col(rows) <= limit).drop(rows), keys, how)
    return light.unionByName(seen.where(F.col(flag)).drop(flag).select(*light.columns))
