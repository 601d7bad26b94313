"""Connected components of a graph given by its edges, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import skew_join, stored


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """A row (node, root) for each end of an edge; root is the smallest node of the component.

    Alternates two steps on edges (hi, lo), hi > lo, until nothing changes: every hi is
    linked to the smallest neighbour of its lo, then everything below a hi to the smallest
    node below it.  The edges of any graph become stars in a logarithmic number of rounds.
    Minima are aggregated before they are shuffled, nodes with very many edges are joined by
    broadcast (``skew_join``), and each round is written to the shared folder.

    Null ends, loops and repeated edges are left out.  No edges give no rows.
    """
    e = stored(_edges(edges.select(F.col(a).alias("x"), F.col(b).alias("y"))), "edges")
    mark = _mark(e)
    while mark[0]:
        least = stored(_both(e).groupBy("lo").agg(F.least(F.min("nb"), F.first("lo")).alias("m"), F.sum("one").alias("n")), "least")
        large = stored(_edges(skew_join(e, least, ["lo"], "n").select(F.col("hi").alias("x"), F.col("m").alias("y"))), "large")
        below = stored(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")), "below")
        star = below.select(F.col("hi").alias("x"), F.col("m").alias("y"))
        many = below.where("n > 1")
        if not many.isEmpty():
            star = star.unionByName(skew_join(large, many, ["hi"], "n").select(F.col("lo").alias("x"), F.col("m").alias("y")))
        e = stored(_edges(star), "edges")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _edges(pairs: DataFrame) -> DataFrame:
    return pairs.where("x <> y").select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).distinct()


def _both(e: DataFrame) -> DataFrame:
    """Each node (as lo) with each neighbour; ``one`` is 1 for the edges in which it is the lower end."""
    return e.select("lo", F.col("hi").alias("nb"), F.lit(1).alias("one")).unionByName(e.select(F.col("hi").alias("lo"), F.col("lo").alias("nb"), F.lit(0).alias("one")))


def _mark(e: DataFrame) -> tuple[int, int]:
    """Tells two sets of edges apart."""
    row = e.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)
