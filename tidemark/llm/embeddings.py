"""Near-duplicate vectors by sorted projection passes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import skew_join, stored
from tidemark.llm.components import components

SEED = 7
#: Sign bits of a pass's hash, neighbours that a vector is compared with on either side, and the least number of passes.
BITS = 62
WINDOW = 64
LEAST_PASSES = 8
#: A pair at the threshold meets with this probability in some pass if directions are spread evenly; passes go on until a round of them brings no larger share of new links between components than 1 - RECALL.
RECALL = 0.999
#: Rows compared at once.
BLOCK = 256
#: Components are cut into chunks of about so many rows, which are compared pair by pair: of 128 in up to 16 chunks, then 16 chunks, then of 4096.
CHUNK, CHUNKS, MOST = 128, 16, 4096


def passes_for(vectors: int, cosine: float, window: int = WINDOW) -> int:
    """Passes in which a pair at the threshold is met with probability RECALL.

    Vectors at an angle a agree in a bit with probability 1 - a/pi; those that agree in the
    log2(n / window) first bits stand within a window of each other, where directions are
    spread evenly.
    """
    agree = 1 - math.acos(cosine) / math.pi
    met = agree ** max(0.0, math.log2(max(1, vectors) / window))
    return max(LEAST_PASSES, math.ceil(math.log(1 - RECALL) / math.log(1 - met))) if met < 1 else LEAST_PASSES


def _units(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows of unit length, in double precision; scaled by powers of two first, so that no square overflows."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True, initial=0.0))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _begins(columns: list[pa.Array]) -> list[int]:
    """Where the values of the columns change from one row to the next, and the end."""
    n = len(columns[0])
    if not n:
        return [0]
    changed = np.zeros(n - 1, dtype=bool)
    for c in columns:
        changed |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(changed) + 1).tolist(), n]


def _stars(links: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges from each place to the first of its component, for a symmetric matrix of links."""
    todo = links.any(axis=1)
    for first in np.flatnonzero(todo).tolist():
        if not todo[first]:
            continue
        todo[first], stack = False, [first]
        while stack:
            new = np.flatnonzero(links[stack.pop()] & todo).tolist()
            todo[new] = False
            stack += new
            yield from ((first, i) for i in new)


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """A row (id, n_links, component_id, kept) for each vector.

    Vectors with equal labels are linked if their cosine, in double precision, is at least
    ``cosine``.  n_links counts the other vectors linked directly; component_id is the
    smallest id that links reach; kept marks the vectors with that id.

    1. Equal vectors are one class; classes are what is searched.
    2. In each pass, classes are hashed to the signs of random projections, ordered by these
       (within label and dimension) and compared with their neighbours in the order; the
       pairs that pass verification are united over all passes.  The least number of passes
       follows from the size of the largest label (``passes_for``), as if directions were
       spread evenly.  Passes are made in rounds of half that number, and rounds go on until
       the last united hardly any components (a share of 1 - RECALL): what a round of
       passes finds that those before it missed is the measure of what is still missed,
       whatever the directions are, and so of pairs at the borders of ranges too.
    3. All links lie within components, so those of each component are counted exactly,
       in blocks: the window bounds which pairs are searched, not the links of a vector.

    Ranges of the order are dealt out, whatever labels they have, and a large component's
    blocks are spread: no label or group of copies is worked on by one task.

    Null labels, and null, empty or zero vectors and those with null or non-finite parts link
    with nothing, not even with themselves (n_links 0, component_id the own id).  Vectors of
    different lengths don't link.  Rows that repeat are vectors like others.  Null ids: kept
    null unless a component has null ids alone.  An empty table gives no rows; other columns
    are left out.
    """
    vector = F.col(vector_col)
    fine = (
        F.col(label_col).isNotNull()
        & F.coalesce(F.size(vector) > 0, F.lit(False))
        & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(vector, lambda x: x != 0), F.lit(False))
    )
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), vector.alias("vector"), fine.alias("fine"))
    good = rows.where("fine").drop("fine")
    classes = stored(good.groupBy("label", "vector").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).withColumn("class", F.monotonically_increasing_id()), "classes")
    largest = classes.groupBy("label", F.size("vector")).count().agg(F.max("count")).first()[0] or 0
    passes = passes_for(largest, cosine, window)
    step = -(-passes // 2)
    label = classes.schema["label"].dataType.simpleString()
    item = classes.schema["vector"].dataType.simpleString()

    def hashed(at: int):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            planes: dict[int, np.ndarray] = {}
            for batch in batches:
                sizes = pc.list_value_length(batch.column(2))
                for dim in pc.unique(sizes).to_pylist():
                    part = batch.filter(pc.equal(sizes, dim))
                    units = _units(part.column(2))
                    if dim not in planes:
                        planes[dim] = np.stack([np.random.default_rng([seed, dim, k]).standard_normal((BITS, dim)) for k in range(at, at + step)])
                    for k in range(step):
                        signs = (units @ planes[dim][k].T > 0).astype(np.int64)
                        names = signs @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                        n = len(part)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, at + k, np.int32)), pa.array(np.full(n, dim, np.int32)), part.column(0), pa.array(names), part.column(1), part.column(2)], names=["pass", "dim", "label", "hash", "class", "vector"])

        return run

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ids, units = None, np.empty(0, np.int64), None
        for batch in batches:
            keyed = [batch.column(c) for c in ("pass", "dim", "label")]
            begins = _begins(keyed)
            edges: list[tuple[int, int]] = []
            for a, b in zip(begins, begins[1:]):
                own, x = batch.column("class")[a:b].to_numpy(), _units(batch.column("vector")[a:b])
                group = tuple(c[a].as_py() for c in keyed)
                if group == last:  # the order goes on from the batch before
                    own, x = np.append(ids, own), np.concatenate([units, x])
                for at in range(0, len(own), BLOCK):
                    block = x[at : at + BLOCK + window]
                    near = np.abs(np.subtract.outer(np.arange(len(block)), np.arange(len(block)))) <= window
                    links = (block @ block.T >= cosine) & near
                    np.fill_diagonal(links, False)
                    edges += [(int(own[at + i]), int(own[at + j])) for i, j in _stars(links)]
                last, ids, units = group, own[-window:], x[-window:]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    roots, at, united = None, 0, 0
    while True:
        listed = classes.select("label", "class", "vector").mapInArrow(hashed(at), f"pass int, dim int, label {label}, hash long, class long, vector {item}")
        ordered = listed.repartitionByRange("pass", "dim", "label", "hash", "class").sortWithinPartitions("pass", "dim", "label", "hash", "class")
        edges = ordered.mapInArrow(compared, "a long, b long")
        if roots is not None:  # components so far, as stars
            edges = edges.unionByName(roots.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
        roots = stored(components(edges), "components")
        at, before, united = at + step, united, roots.where("node <> root").count()
        if at >= passes and united - before <= (1 - RECALL) * united:
            break

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links within a chunk or between two, for each block; rows are sorted by block."""
        held: list[pa.RecordBatch] = []

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, n, chunk = (t.column(c).to_numpy() for c in ("class", "n", "chunk"))
            units = _units(t.column("vector").chunk(0))
            lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
            links = np.zeros(len(ids), dtype=np.int64)
            ours, theirs = np.flatnonzero(chunk == lo), np.flatnonzero(chunk == hi)
            for at in range(0, len(ours), BLOCK):
                some = ours[at : at + BLOCK]
                near = units[some] @ units[theirs].T >= cosine
                if lo == hi:
                    near[np.arange(len(some)), np.arange(at, at + len(some))] = False
                else:
                    links[theirs] += n[some] @ near
                links[some] += near @ n[theirs]
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], names=["class", "links"])

        last = None
        for batch in batches:
            keyed = [batch.column(c) for c in ("root", "lo", "hi")]
            begins = _begins(keyed)
            for a, b in zip(begins, begins[1:]):
                key = tuple(c[a].as_py() for c in keyed)
                if key != last and held:
                    yield done()
                    held.clear()
                last = key
                held.append(batch.slice(a, b - a))
        if held:
            yield done()

    members = stored(roots.join(classes.withColumnRenamed("class", "node"), "node").select(F.col("node").alias("class"), "root", "vector", "n", "first_id"), "members")
    sizes = stored(members.groupBy("root").agg(F.count("*").alias("m"), F.min("first_id").alias("component_id")).withColumn("k", F.least(F.ceil(F.col("m") / CHUNK), F.greatest(F.lit(CHUNKS), F.ceil(F.col("m") / MOST)))), "component_sizes")
    own = F.pmod(F.xxhash64("class"), F.col("k"))
    placed = skew_join(members, sizes.drop("component_id"), ["root"], "m").withColumn("chunk", own)
    spread = placed.select("root", "class", "vector", "n", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("other"))
    blocks = spread.select("root", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "class", "n", "chunk", "vector")
    links = blocks.repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi", "class").mapInArrow(counted, "class long, links long").groupBy("class").agg(F.sum("links").alias("links"))
    named = skew_join(members.select("class", "root"), sizes.select("root", "component_id", "m"), ["root"], "m").join(links, "class")
    told = classes.join(named, "class", "left").select("label", "vector", "n", F.coalesce("component_id", "first_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    linked = skew_join(good, stored(told, "told"), ["label", "vector"], "n").select("id", "n_links", "component_id")
    alone = rows.where(~F.col("fine")).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


#: The same, compared pair by pair, in DuckDB's SQL.
ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_id AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN least_id m ON v.vec_id = m.x LEFT JOIN counted c ON v.vec_id = c.x
"""
