"""Metadata: tables, partitions, nodes and leases as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import NotFound
from tidemark.schema import NODES, PARTITIONS, TABLES


def get(rows: DataFrame, **key: object) -> DataFrame:
    """The row with a key, or none."""
    return rows.where(_is(key))


def _is(key: dict[str, object]) -> Column:
    out = F.lit(True)
    for k, v in key.items():
        out &= F.col(k) == F.lit(v)
    return out


def create(rows: DataFrame, **values: object) -> DataFrame:
    return rows.unionByName(rows.sparkSession.createDataFrame([tuple(values.get(f.name) for f in rows.schema)], rows.schema))


def update(rows: DataFrame, key: dict[str, object], **values: object) -> DataFrame:
    """The table with a row changed; it has to be there."""
    if get(rows, **key).isEmpty():
        raise NotFound(f"nothing to update at {key}")
    return rows.withColumns({k: F.when(_is(key), F.lit(v).cast(rows.schema[k].dataType)).otherwise(F.col(k)) for k, v in values.items()})


def delete(rows: DataFrame, **key: object) -> tuple[DataFrame, int]:
    """The table without a row, and how many rows went."""
    return rows.where(~_is(key)), get(rows, **key).count()


def ring(partitions: DataFrame, table_id: int) -> DataFrame:
    return partitions.where(F.col("table_id") == table_id).orderBy("hash_start")


def random_nodes(nodes: DataFrame, n: int, seed: int | None = None) -> DataFrame:
    return nodes.orderBy(F.rand(seed)).limit(n)


def random_ready_table(tables: DataFrame, seed: int | None = None) -> DataFrame:
    return tables.where("is_ready").orderBy(F.rand(seed)).limit(1)


def next_nodes(nodes: DataFrame, excluded: list[int], n: int = 1) -> DataFrame:
    """The first nodes by id that aren't excluded."""
    return nodes.where(~F.col("node_id").isin(excluded)).orderBy("node_id").limit(n)


def as_json(rows: DataFrame) -> DataFrame:
    """Rows as JSON, with 64-bit integers as text."""
    wide = [F.col(f.name).cast("string").alias(f.name) if f.dataType.simpleString() == "bigint" else F.col(f.name).cast("array<string>").alias(f.name) if f.dataType.simpleString() == "array<bigint>" else F.col(f.name) for f in rows.schema]
    return rows.select(F.to_json(F.struct(*wide), {"ignoreNullFields": "false"}).alias("json"))


def empty(spark: SparkSession) -> dict[str, DataFrame]:
    return {"tables": spark.createDataFrame([], TABLES), "partitions": spark.createDataFrame([], PARTITIONS), "nodes": spark.createDataFrame([], NODES)}
