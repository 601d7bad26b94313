"""Packing of token sequences into windows by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty
from tidemark.llm.tokens import encoder, pack_ids, text_parts, tokenizer_path


def differencing(sizes: Sequence[int], k: int) -> list[list[int]]:
    """Splits items into k sets of near-equal sums; returns the items' positions by set.

    Every item starts as a partial partition of its own.  The two partial partitions with
    the largest spread (largest minus smallest sum) are merged, the largest set of one with
    the smallest of the other, so that their imbalances cancel, until one is left.
    Ties go by position: the result depends on the sizes alone.
    """
    if not sizes:
        return [[] for _ in range(k)]
    # A partial partition lists its sets above the smallest, by falling sum; "base" members are those of sets at the smallest sum.
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = k - len(a)
        merged = a + b[:free] if len(b) > free else a + b
        if len(b) > free:
            # b's smallest sets meet a's smallest sets from the other end: b's j-th stands at place k-1-j.
            merged = list(a)
            merged += [b[j] for j in range(free)][::-1]
            for j in range(free, len(b)):
                s, items = merged[k - 1 - j]
                merged[k - 1 - j] = (s + b[j][0], items + b[j][1])
        merged.sort(key=lambda x: -x[0])
        low = merged[-1][0] if len(merged) == k else 0
        if low:
            merged = [(s - low, items) for s, items in merged]
        heapq.heappush(heap, (-(merged[0][0] - (merged[-1][0] if len(merged) == k else 0)), serial, merged))
        serial += 1
    sets = [items for _, items in heap[0][2]]
    return sets + [[] for _ in range(k - len(sets))]


def pack_group(sizes: Sequence[int], window: int) -> list[list[int]]:
    """Windows of at most ``window`` for items that are no larger; their count rises as long as a window exceeds it."""
    k = max(1, -(-sum(sizes) // window))
    while True:
        sets = differencing(sizes, k)
        over = sum(max(0, sum(sizes[i] for i in s) - window) for s in sets)
        if not over:
            return [s for s in sets if s]
        k += max(1, over // window)


SCHEMA = "{id} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 2,
    window: int = 4096,
    piece: int = 1024,
    group_windows: int = 256,
    with_ids: bool = False,
) -> DataFrame:
    """Packs the ids of all documents into sequences of at most ``window`` ids.

    A document's ids (its text's, and ``end_id``) are cut into whole windows, which are
    sequences as they stand, and a rest, which is cut into pieces of ``piece`` at most.
    The pieces of ``group_windows`` windows at a time are spread by differencing.

    Returns a row per piece: the id, start (in its document), length, ids_crc32 (unsigned,
    of little-endian 32-bit ids), doc_tokens, sequence_id, offset (in its sequence), and the
    packed ids if ``with_ids``.

    Groups are runs of rows within a partition of the input, so nothing is shuffled and
    memory is bounded by a group and a document; a key or source of any size is no
    obstacle.  A task that runs again reads the same split and gives the same windows; the
    input's partitions should be read from storage, not from an unsorted shuffle.

    Null or empty text: one piece with ``end_id`` alone.  Repeated rows are packed each for
    itself.  An empty table gives no rows.  Other columns are left out, whatever their names.
    """
    path = tokenizer_path(tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = SCHEMA.format(id=f"`{id_col}`", kind=kind) + (", ids binary" if with_ids else "")
    end = pack_ids([end_id])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        kept: list[tuple[object, bytes]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, kept, total
            rows: list[tuple] = []
            items: list[tuple[int, int, int]] = []
            for d, (_, ids) in enumerate(kept):
                n = len(ids) // 4
                at = 0
                while n - at >= window:
                    rows.append((d, at, window, sequence, 0))
                    sequence += 1
                    at += window
                parts = -(-(n - at) // piece)
                for j in range(parts):  # near-equal pieces
                    size = (n - at) // (parts - j)
                    items.append((d, at, size))
                    at += size
            for members in pack_group([x[2] for x in items], window):
                at = 0
                for i in sorted(members):
                    d, start, size = items[i]
                    rows.append((d, start, size, sequence, at))
                    at += size
                sequence += 1
            rows.sort()
            ids = [kept[d][1][4 * s : 4 * (s + n)] for d, s, n, _, _ in rows]
            out = [
                pa.array([kept[r[0]][0] for r in rows], key_type),
                *(pa.array(x, pa.int64()) for x in ([r[1] for r in rows], [r[2] for r in rows], [zlib.crc32(x) for x in ids], [len(kept[r[0]][1]) // 4 for r in rows], [r[3] for r in rows], [r[4] for r in rows])),
            ]
            kept, total = [], 0
            return pa.RecordBatch.from_arrays(out + ([pa.array(ids, pa.binary())] if with_ids else []), names=names)

        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b, part in text_parts(texts):
                for key, ids in zip(keys[a:b], encode(part)):
                    kept.append((key, ids + end))
                    total += len(ids) // 4 + 1
                    if total >= group_windows * window:
                        yield flush()
        if kept:
            yield flush()

    return docs.select(F.col(id_col), text_or_empty(text_col)).mapInArrow(pack, schema)

