"""Token ids in Simple-8b files, in document order, and back."""

from __future__ import annotations

import json
import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import scratch_path, text_or_empty
from tidemark.llm.shards import committed, file_rows, filesystem, make_folder, save_manifest
from tidemark.llm.tokens import encoder, pack_ids, text_parts, tokenizer_path

# Fixed values of the code: for each selector, how many values a word holds, and their bits.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: The last selector's largest value says that the next word is a value of 64 bits as it is.
ESCAPE = (1 << 60) - 1
ESCAPED = np.uint64((15 << 60) | ESCAPE)
#: Bits of each 16-bit value.
_SHORT = np.frexp(np.arange(1 << 16))[1].astype(np.uint8)
#: Ids in a block; blocks are decoded each for itself, from its word offset.
BLOCK_IDS = 1 << 16
#: A file is closed at so many bytes of words.
FILE_BYTES = 64 << 20
MAGIC = b"S8BTOK01"


def encode_block(values: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned 64-bit values: each word takes as many of the next values as fit."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return np.empty(0, dtype=np.uint64)
    large = values >= np.uint64(ESCAPE)
    top = int(values[~large].max()).bit_length() if not large.all() else 0
    if top <= 16 and not large.any():
        bits = _SHORT[values.astype(np.uint16)]
    else:
        bits = np.zeros(n, dtype=np.uint8)
        for b in range(top):
            bits += values >= np.uint64(1 << b)
        bits[large] = 61
    best = np.full(n, 15, dtype=np.uint8)  # selector by position
    # widest[c][i] is the bits of the widest of the c values from i on; those that reach past the end don't count.
    widest, size = bits, 1
    levels = {1: bits}
    while size * 2 <= min(n, 240):
        widest = np.maximum(widest[: len(widest) - size], widest[size:])
        size *= 2
        levels[size] = widest
    for selector in range(14, -1, -1):
        c = int(COUNTS[selector])
        if c > n:
            continue
        half = 1 << (c.bit_length() - 1)
        level = levels[half]
        window = level[: n - c + 1] if half == c else np.maximum(level[: n - c + 1], level[c - half : c - half + n - c + 1])
        if window.min() <= BITS[selector]:
            np.minimum(best[: n - c + 1], np.where(window <= BITS[selector], np.uint8(selector), np.uint8(15)), out=best[: n - c + 1])
    step = COUNTS[best].tolist()
    at, i = [], 0
    while i < n:
        at.append(i)
        i += step[i]
    at = np.array(at)
    selectors = best[at]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in np.unique(selectors).tolist():
        c, b = int(COUNTS[selector]), int(BITS[selector])
        if not b:
            continue
        here = np.flatnonzero(selectors == selector)
        first = at[here]
        word = words[here]
        for j in range(c):
            word |= np.minimum(values[first + j], np.uint64(ESCAPE)) << np.uint64(j * b)
        words[here] = word
    escapes = np.flatnonzero(large[at])
    return np.insert(words, escapes + 1, values[at[escapes]]) if len(escapes) else words


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of a block's words, all words of a selector at a time."""
    words = np.ascontiguousarray(words, dtype=np.uint64)
    raw = None
    if (words == ESCAPED).any():
        keep, i = np.ones(len(words), dtype=bool), 0
        marks = np.flatnonzero(words == ESCAPED).tolist()
        for m in marks:  # the word after an escape isn't code, whatever it looks like
            if m >= i:
                keep[m + 1] = False
                i = m + 2
        raw = words[~keep]
        words = words[keep]
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    begins = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype=np.uint64)
    for selector in np.unique(selectors).tolist():
        c, b = int(COUNTS[selector]), int(BITS[selector])
        if not b:
            continue
        here = selectors == selector
        word, first, mask = words[here], begins[here], np.uint64((1 << b) - 1)
        for j in range(c):
            out[first + j] = (word >> np.uint64(j * b)) & mask
    if raw is not None:
        out[begins[words == ESCAPED]] = raw
    return out[:n]


class _FileWriter:
    """A file: magic, blocks of words, then as footer the block table and the document table, its length, and magic."""

    def __init__(self, out):  # noqa: ANN001
        self.out = out
        self.held: list[np.ndarray] = []
        self.n_held = 0
        self.blocks: list[tuple[int, int]] = []  # word offset, ids
        self.docs: list[tuple[int | None, int]] = []
        self.words = self.ids = 0
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.ids += len(ids)
        while self.n_held >= BLOCK_IDS:
            self._block()

    def _block(self) -> None:
        ids = np.concatenate(self.held)
        words = encode_block(ids[:BLOCK_IDS])
        self.blocks.append((self.words, min(len(ids), BLOCK_IDS)))
        self.out.write(words.astype("<u8").tobytes())
        self.words += len(words)
        self.held, self.n_held = [ids[BLOCK_IDS:]], max(0, len(ids) - BLOCK_IDS)

    def finish(self) -> None:
        if self.n_held:
            self._block()
        blocks = np.array(self.blocks, dtype="<i8").reshape(-1, 2)
        known = np.array([d is not None for d, _ in self.docs], dtype=np.uint8)
        docs = np.array([(d or 0, n) for d, n in self.docs], dtype="<i8").reshape(-1, 2)
        head = json.dumps({"blocks": len(blocks), "docs": len(docs), "words": self.words}).encode()
        footer = blocks.tobytes() + docs.tobytes() + known.tobytes() + head + struct.pack("<q", len(head))
        self.out.write(footer + struct.pack("<q", len(footer)) + MAGIC)


def read_documents(fs, place: str) -> Iterator[tuple[int | None, np.ndarray]]:  # noqa: ANN001
    """(id, ids) of a file's documents, decoding a block at a time."""
    with fs.open_input_file(place) as f:
        size = f.size()
        tail = f.read_at(16, size - 16)
        if tail[8:] != MAGIC or f.read_at(8, 0) != MAGIC:
            raise ValueError(f"{place}: not a token file")
        (length,) = struct.unpack("<q", tail[:8])
        footer = f.read_at(length, size - 16 - length)
        (n,) = struct.unpack("<q", footer[-8:])
        head = json.loads(footer[-8 - n : -8])
        blocks = np.frombuffer(footer, "<i8", 2 * head["blocks"]).reshape(-1, 2)
        docs = np.frombuffer(footer, "<i8", 2 * head["docs"], blocks.nbytes).reshape(-1, 2)
        known = np.frombuffer(footer, np.uint8, head["docs"], blocks.nbytes + docs.nbytes)
        held = np.empty(0, dtype="<u4")
        ends = np.append(blocks[1:, 0], head["words"])
        at = 0
        for doc, n_ids, there in zip(docs[:, 0].tolist(), docs[:, 1].tolist(), known.tolist()):
            parts = [held]
            have = len(held)
            while have < n_ids:
                words = np.frombuffer(f.read_at(int(ends[at] - blocks[at, 0]) * 8, 8 + int(blocks[at, 0]) * 8), "<u8")
                parts.append(decode_block(words, int(blocks[at, 1])).astype("<u4"))
                have += len(parts[-1])
                at += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield (doc if there else None), held[:n_ids]
            held = held[n_ids:]


def write_token_files(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Writes all documents' ids, each with ``end_id`` after it, in ascending order of the (integer) id; returns the manifest.

    Rows are range-partitioned and sorted by id (then by the text's hash, so that rows of
    one id can be split over tasks); a task encodes its texts and writes a run of files of
    about FILE_BYTES, whose names follow the order.  The manifest has for each file its
    part, seq, path, n_docs, n_ids and start, the ids in all files before it.

    Null text: the end id alone.  Null ids come first.  Repeated rows are written each.  An
    empty table gives no files.
    """
    path = tokenizer_path(tokenizer)
    end = pack_ids([end_id])
    make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        fs, place = filesystem(folder)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        rows = ((key, ids) for batch in batches for a, b, texts in text_parts(batch.column(1)) for key, ids in zip(batch.column(0).slice(a, b - a).to_pylist(), encode(texts)))
        row, seq = next(rows, None), 0
        while row is not None:
            name = f"part-{part:06d}-{seq:06d}.s8b"
            with committed(fs, posixpath.join(place, name)) as out:
                writer = _FileWriter(out)
                while row is not None and writer.words * 8 < FILE_BYTES:
                    writer.add(row[0], np.frombuffer(row[1] + end, dtype="<u4"))
                    row = next(rows, None)
                writer.finish()
            yield pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": posixpath.join(folder, name), "n_docs": len(writer.docs), "n_ids": writer.ids}])
            seq += 1

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    ordered = ordered.repartitionByRange(F.col("id"), F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    files = save_manifest(ordered.mapInArrow(write, "part long, seq long, path string, n_docs long, n_ids long"), folder)
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """A row (id, start, n_tokens, ids_crc32) for each document of the files, decoded from them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, place = filesystem(row["path"])
                start, out = row["start"], []
                for doc, ids in read_documents(fs, place):
                    out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(4)], names=["id", "start", "n_tokens", "ids_crc32"])

    dealt = file_rows(manifest, manifest.sparkSession.sparkContext.defaultParallelism * 4)
    return dealt.select("path", "start").mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:  # noqa: ANN003
    """Writes the files (by default to a new place in the shared folder) and reads them back."""
    return read_token_files(write_token_files(docs, folder or scratch_path(docs.sparkSession, "tokens"), **options))
