"""SimHash near-duplicates: fingerprints, and an exact search for those that differ in few bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import skew_join, stored, text_or_empty, worker_keeps
from tidemark.llm.components import components
from tidemark.llm.tokens import text_parts

SEED = 42
#: Fingerprints are cut into 32 segments of two bits; a cell key holds the 32 bit counts (0 to 2), two bits each.
SEGMENTS = 32
ODD = np.uint64(0x5555555555555555)
#: Fingerprints of a cell that are compared as a whole matrix.
DENSE = 1024


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text (see ``fingerprints``)."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= shingle:
        parts = [b" ".join(words)] if words else []
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, SEED) for p in parts], dtype="<u8")
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """A row (id, fp) for each document, without a shuffle.

    Words are runs of other than ASCII white space, with A-Z in lower case; shingles are
    ``shingle`` words joined by spaces, repeats included (fewer words: all of them).  A bit
    of fp is set if it is set in over half of the shingles' XXH64 (seed 42).  Null text and
    text without words give zero.  Repeated rows stay; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, shingle) for _, _, part in text_parts(batch.column(1)) for t in part]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), text_or_empty(text_col)).mapInArrow(run, f"id {kind}, fp long")


def counts_key(fp: Column) -> Column:
    """Bit counts of the 32 segments, as one long."""
    odd = F.lit(int(ODD))
    up = F.shiftrightunsigned(fp, 1)
    return F.shiftleft(up.bitwiseAND(fp).bitwiseAND(odd), 1).bitwiseOR(up.bitwiseXOR(fp).bitwiseAND(odd))


def cells(key: Column) -> Column:
    """The cell of a fingerprint's bit counts, and all cells one step away.

    Two points of the grid within Manhattan distance two have a cell in common that is at
    most one step from either.  A count of 0 or 1 turns into its successor and one of 1 or
    2 into its predecessor by flipping one or both of its bits.
    """

    def at(i: int) -> list[Column]:
        count = F.shiftrightunsigned(key, 2 * i).bitwiseAND(F.lit(3))
        return [F.when(count < 2, key.bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), 2 * i))), F.when(count > 0, key.bitwiseXOR(F.shiftleft(F.lit(3).cast("long"), 2 * i)))]

    return F.array_compact(F.array(key, *(c for i in range(SEGMENTS) for c in at(i))))


def _key(fps: np.ndarray) -> np.ndarray:
    one, up = np.uint64(1), fps >> np.uint64(1)
    return ((up & fps & ODD) << one) | ((up ^ fps) & ODD)


def _stars(n: int, near) -> list[tuple[int, int]]:
    """Edges from each place to the first of its component; near(i) gives the mask of places linked to i."""
    todo, out = np.ones(n, dtype=bool), []
    for first in range(n):
        if not todo[first]:
            continue
        todo[first] = False
        stack = [first]
        while stack:
            new = np.flatnonzero(near(stack.pop()) & todo)
            todo[new] = False
            stack += new.tolist()
            out += [(first, int(i)) for i in new]
    return out


def link_cell(fps: np.ndarray, cell: int, bits: int = 2) -> list[tuple[int, int]]:
    """Star edges of a cell's fingerprints that differ in at most ``bits`` bits.

    Fingerprints with equal counts share all their cells and are linked in their own only.
    A large cell is not compared pair by pair: fingerprints within two bits have a
    neighbour at one bit in common, so each is listed under itself and its 64 neighbours,
    and those listed together are linked.
    """
    if len(fps) <= DENSE or bits != 2:
        key = _key(fps)
        own = key == np.uint64(cell)
        edges = _stars(len(fps), lambda i: (np.bitwise_count(fps ^ fps[i]) <= bits) & ((key != key[i]) | own))
        return [(int(fps[i]), int(fps[j])) for i, j in edges]
    flips = np.append(np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64))
    parent = np.arange(len(fps))
    while True:  # labels fall until all that are listed together agree
        before = parent.copy()
        for part in range(8):  # an eighth of the lists in memory at once
            listed, who = [], []
            for f in flips:
                names = fps ^ f
                here = np.flatnonzero((names * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(61) == np.uint64(part))
                listed.append(names[here])
                who.append(here)
            owner = np.concatenate(who)
            names, at = np.unique(np.concatenate(listed), return_inverse=True)
            least = np.full(len(names), len(fps))
            np.minimum.at(least, at, parent[owner])
            np.minimum.at(parent, owner, least[at])
        if (parent == before).all():
            break
    return [(int(fps[p]), int(fps[i])) for i, p in enumerate(parent.tolist()) if p != i]


def linked(fps: DataFrame, bits: int = 2) -> DataFrame:
    """A row (node, root) for each of the distinct fingerprints in column ``fp`` that differs from another in at most ``bits`` bits.

    Fingerprints are mapped to the bit counts of 32 segments, whose Manhattan distance is at
    most the number of differing bits; those within two steps meet in a cell of the grid
    (``cells``), where they are compared exactly.
    """

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def found() -> pa.RecordBatch:
            cell, fps = np.concatenate(cells), np.concatenate(held)
            begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
            sizes = np.diff(np.append(begins, len(cell)))
            edges = [e for b, n in zip(begins[sizes > 1].tolist(), sizes[sizes > 1].tolist()) for e in link_cell(fps[b : b + n], int(cell[b].view(np.uint64)), bits)]
            a, b = np.array(edges, dtype=np.uint64).reshape(-1, 2).view(np.int64).T
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            cell, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if not len(cell):
                continue
            done = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if done or cells and cells[-1][-1] != cell[-1]:
                cells.append(cell[:done])
                held.append(fps[:done])
                yield found()
                cells, held = [], []
            cells.append(cell[done:])
            held.append(fps[done:])
        if cells:
            yield found()

    keyed = fps.select("fp", counts_key(F.col("fp")).alias("key"))
    grid = keyed.select(F.explode(cells(F.col("key"))).alias("cell"), "fp")
    return components(grid.repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(link, "a long, b long"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 2) -> DataFrame:
    """A row (id, fingerprint, component_id) for each document.

    Fingerprints that differ in at most ``bits`` (up to 2) bits are linked; component_id is
    the smallest id that links reach, its own included.  Copies share a fingerprint, so the
    search (``linked``) runs over distinct fingerprints.  The result has every link, not a
    sample.

    Null text or no words: fingerprint zero, linked like any other.  Null ids: linked, and
    never a component's id unless all its ids are null.  Repeated rows: one row each.  An
    empty table gives no rows.  Other columns are left out.
    """
    if not 0 <= bits <= 2:
        raise ValueError("bits must be 0, 1 or 2")
    fps = stored(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("n")), "classes")
    roots = linked(classes, bits)
    named = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    first = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    looked = stored(named.join(first, "root").select("fp", "component_id", "n"), "fingerprint_components")
    return skew_join(fps, looked, ["fp"], "n").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near copies by similarity: candidates by fingerprints of whole texts and of samples of them, then an exact check.

#: Samples of a text: the shingles that come first in so many orders, so many of them each; short texts have smaller ones too.
SAMPLES, SAMPLE = 32, 6
SHORT, SHORT_SAMPLES, SHORT_SAMPLE = 12, 8, 2
_ORDERS = np.array([pow(0x9E3779B97F4A7C15, i + 3, 1 << 64) | 1 for i in range(SAMPLES + SHORT_SAMPLES)], dtype=np.uint64)
#: Least Jaccard similarity of near copies as a fraction, and that with the first text of a bucket which its texts need to be compared with one another.
OVER, UNDER = 4, 5
NEAR_FIRST = 0.6
#: Texts of a bucket that are paired at once, and texts compared with one text in a task.
CHUNK = 256
SALT = 4096
#: Longs of the parities of a set's shingles, at most; up to that they hold four bits or more for a shingle.
PARITIES = 64


def shingle_set(text: str, shingle: int = 5) -> np.ndarray:
    """Sorted XXH64 of the distinct shingles; words as in ``fingerprint``, fewer words than a shingle are one."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if len(words) <= shingle:
        parts = [b" ".join(words)] if words else []
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(p, SEED) for p in parts], dtype=np.uint64))


def _majority(hashes: np.ndarray) -> np.ndarray:
    """SimHash of each row of hashes."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(*hashes.shape, 8), axis=-1, bitorder="little")
    return np.packbits(bits.sum(axis=1, dtype=np.int32) * 2 > hashes.shape[1], axis=-1, bitorder="little").view("<u8")[:, 0].view(np.int64)


def sample_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """Fingerprints of a set's samples, mixed with the sample's number: what two texts have in common is likely a whole sample of both."""
    if not len(hashes):
        return np.empty(0, np.int64)
    out = []
    for first, many, size in [(0, SAMPLES, SAMPLE), (SAMPLES, SHORT_SAMPLES, SHORT_SAMPLE)][: 1 + (len(hashes) <= SHORT)]:
        step = max(1, 200_000 // len(hashes))  # orders in memory at once
        for at in range(first, first + many, step):
            orders = _ORDERS[at : min(at + step, first + many)]
            mixed = (hashes[None, :] ^ (hashes[None, :] >> np.uint64(29))) * orders[:, None]
            if len(hashes) > size:
                mixed = np.partition(mixed, size - 1, axis=1)[:, :size]
            out.append(_majority(mixed) ^ orders.view(np.int64))
    return np.concatenate(out)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *parts])))


def parity(hashes: np.ndarray) -> np.ndarray:
    """Parities of how many hashes of a set fall on each of a power of two of bits; halves folded by XOR are those on half as many bits."""
    longs = min(PARITIES, 1 << max(0, (len(hashes) - 1).bit_length() - 4))
    ones = np.bincount((hashes & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").view("<i8")


def may_be_near(size: Column, parities: Column, other_size: Column, other_parities: Column) -> Column:
    """False only for two sets whose similarity is below OVER / UNDER.

    Near sets have at most (UNDER - OVER) / (UNDER + OVER) of both sizes' sum in one of them
    alone, which is as much as their sizes or their parities differ at least.
    """

    def folded(p: Column, other: Column) -> Column:  # sizes of near sets are within one doubling
        half = F.floor(F.size(p) / 2).cast("int")
        return F.when(F.size(p) > F.size(other), F.zip_with(F.slice(p, 1, half), F.slice(p, half + 1, half), lambda x, y: x.bitwiseXOR(y))).otherwise(p)

    bits = F.zip_with(folded(parities, other_parities), folded(other_parities, parities), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    alone = (size + other_size) * (UNDER - OVER)
    return (F.abs(size - other_size) * (UNDER + OVER) <= alone) & (F.aggregate(bits, F.lit(0), lambda total, n: total + n) * (UNDER + OVER) <= alone)


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes with their Jaccard similarity, from their whole sets; a class with very many pairs is spread."""
    for end in ("a", "b"):
        counts = stored(pairs.groupBy(end).agg(F.count("*").alias("n")).withColumn("salts", F.ceil(F.col("n") / SALT)), "compared")
        salted = skew_join(pairs, counts, [end], "n").withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.col("salts"))).drop("salts")
        looked = counts.join(sets.select(F.col("sig").alias(end), F.col("shingles").alias(f"{end}_set")), end).select(end, f"{end}_set", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        pairs = salted.join(looked, [end, "salt"]).drop("salt")
    both = F.size(F.array_intersect("a_set", "b_set"))
    return pairs.select("a", "b", (both / (F.size("a_set") + F.size("b_set") - both)).alias("similarity"))


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, bits: int = 2) -> DataFrame:
    """A row (id, component_id) for each document; component_id is the smallest id that links of near copies reach.

    Near copies are texts whose sets of ``shingle``-word shingles have a Jaccard similarity of
    OVER / UNDER at least, checked on the whole sets.  Two such texts' fingerprints differ in
    ten bits on average, which no search in a grid finds, so texts have more fingerprints:

    1. Texts with equal sets are one class; classes are what is searched.
    2. Buckets of candidates are the components of whole texts' fingerprints (``linked``, as
       in ``near_duplicates``), and the texts that have a sample in common: SAMPLE shingles
       that come first in one of SAMPLES orders, by their fingerprint.  Two texts of
       similarity 0.8 share some sample with a probability of 1 - (1 - 0.8^6)^32 = 0.9999.
    3. Each class is compared exactly with the first of each of its buckets, in an order of
       the bucket's own; this makes most of a large group one component.
    4. Those of a bucket that are not in one component yet are compared with one another, in
       chunks that are spread, if they have NEAR_FIRST in common with the bucket's first: so
       a passage that many texts hold doesn't bring them all together.  Pairs that can't be
       near (``may_be_near``, no estimate) are left out before their sets are fetched.  Near copies that
       fall below it have other shingles in common, and with these other samples: at worst,
       for texts of which three quarters are such a passage, they are found with 0.997.

    Null text or no words: one class.  Null ids: never a component's id unless all are null.
    Repeated rows: one row each.  An empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_keeps("no cache", dict)
        for batch in batches:
            for a, b, part in text_parts(batch.column(1)):
                sets = [shingle_set(t, shingle) for t in part]
                sig = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64)
                whole = np.array([fingerprint(t, shingle) for t in part], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(sig), pa.array(whole), _lists([sample_fingerprints(s) for s in sets])], names=["id", "sig", "fp", "samples"])

    made = stored(texts.mapInArrow(marks, f"id {kind}, sig long, fp long, samples array<long>"), "text_marks")
    classes = stored(made.groupBy("sig").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.min("fp").alias("fp"), F.first("samples").alias("samples")), "text_classes")
    roots = stored(linked(classes.select("fp").distinct(), bits), "fingerprint_roots")
    near = skew_join(classes.select("sig", "fp"), stored(classes.groupBy("fp").agg(F.count("*").alias("n")).join(roots.withColumnRenamed("node", "fp"), "fp", "left"), "fingerprint_classes"), ["fp"], "n")
    whole = near.select(F.xxhash64(F.coalesce("root", "fp"), F.lit("whole")).alias("bucket"), "sig")
    placed = classes.select(F.explode("samples").alias("bucket"), "sig").unionByName(whole)
    first = stored(placed.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "sig").alias("place"), "sig")).alias("first"), F.count("*").alias("n")).where("n > 1").select("bucket", F.col("first.sig").alias("first"), "n"), "buckets")
    shared = stored(skew_join(placed, first, ["bucket"], "n").where("sig <> first"), "shared_buckets")
    pairs = stored(shared.select(F.col("first").alias("a"), F.col("sig").alias("b")).distinct(), "first_pairs")

    wanted = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    wanted = stored(classes.join(wanted, "sig", "left_semi").select("sig", F.col("first_id").alias("wanted_id"), "n"), "wanted_texts")

    def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, part in text_parts(batch.column(1)):
                made = [shingle_set(t, shingle) for t in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), _lists([m.view(np.int64) for m in made]), _lists([parity(m) for m in made])], names=["sig", "shingles", "parities"])

    read = texts.join(wanted, texts["id"].eqNullSafe(wanted["wanted_id"])).select("sig", "text", "n")
    once = read.where("n = 1").drop("n").unionByName(read.where("n > 1").drop("n").dropDuplicates(["sig"]))  # a row may repeat as it is
    sets = stored(once.mapInArrow(whole_sets, "sig long, shingles array<long>, parities array<long>"), "shingle_sets")
    compared = stored(_compared(pairs, sets), "compared_pairs")
    edges = compared.where(F.col("similarity") >= OVER / UNDER).select("a", "b")

    united = stored(components(edges), "first_components")
    close = compared.where(F.col("similarity") >= NEAR_FIRST).withColumnsRenamed({"a": "first", "b": "sig"}).select("first", "sig")
    open_ = shared.join(close, ["first", "sig"]).join(united.withColumnRenamed("node", "sig"), "sig", "left").select("bucket", "sig", F.coalesce("root", "sig").alias("root"))
    open_ = stored(open_, "near_first")
    split = stored(open_.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n")).where("least <> most").select("bucket", F.ceil(F.col("n") / CHUNK).alias("k"), "n"), "split_buckets")
    left = stored(skew_join(open_, split, ["bucket"], "n").withColumn("chunk", F.pmod(F.xxhash64("sig"), F.col("k"))).join(sets.select("sig", F.size("shingles").alias("size"), "parities"), "sig"), "split_classes")
    spread = left.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("chunk"), F.col("sig").alias("b"), F.col("root").alias("b_root"), F.col("size").alias("b_size"), F.col("parities").alias("b_parities"))
    may = may_be_near(F.col("size"), F.col("parities"), F.col("b_size"), F.col("b_parities"))
    across = stored(left.join(spread, ["bucket", "chunk"]).where(F.col("root") < F.col("b_root")).where(may).select(F.col("sig").alias("a"), "b").distinct(), "open_pairs")
    more = _compared(across, sets).where(F.col("similarity") >= OVER / UNDER).select("a", "b")
    roots = components(edges.unionByName(more))

    told = classes.select("sig", "first_id", "n").join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    least = told.groupBy("root").agg(F.min("first_id").alias("component_id"))
    looked = stored(told.join(least, "root").select("sig", "component_id", "n"), "text_components")
    return skew_join(made.select("id", "sig"), looked, ["sig"], "n").select(F.col("id").alias(id_col), "component_id")
