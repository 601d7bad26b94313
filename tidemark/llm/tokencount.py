"""Token counts of documents from counts of their distinct pre-tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.tokens import encoder, text_parts, tokenizer_path

#: Documents are numbered within blocks of at most so many characters and documents.
BLOCK_CHARS = 32_000_000
BLOCK_DOCS = 1 << 18
#: An entry of a list is a document's number times 2^12 plus an occurrence count; more occurrences take more entries.
COUNT_BITS = 12
#: A pre-token in over an eighth of a block's documents is spread over so many keys; its pieces are then counted up to so many times.
SPREAD = 16
COMMON = 8
#: Words given on at once, and entries summed at once.
WORDS = 50_000
ENTRIES = 2_000_000


class _Block:
    """The distinct pre-tokens of some documents, and the documents that have them."""

    def __init__(self) -> None:
        self.names: dict = {}
        self.codes: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.ids: list = []
        self.n_bytes: list[int] = []
        self.known: list[int] = []
        self.chars = 0

    def add(self, key: object, text: str, cut: list | None, known: int) -> None:
        self.ids.append(key)
        self.n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
        self.known.append(known)
        cut = cut or []
        names = self.names
        self.codes.append(np.array([names.setdefault(p, len(names)) for p in cut], dtype=np.int32))
        self.sizes.append(len(cut))
        self.chars += len(text)

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """Entries sorted by pre-token, and where each pre-token's begin (and the end)."""
        doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        both = np.concatenate(self.codes).astype(np.int64) << 18 | doc if self.codes else doc
        both.sort()
        begins = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else both
        n = np.diff(np.append(begins, len(both)))
        both, most = both[begins], (1 << COUNT_BITS) - 1
        times = -(-n // most)
        both, n = np.repeat(both, times), np.repeat(n, times)
        last = np.cumsum(times) - 1
        full = np.ones(len(n), dtype=bool)
        full[last] = False
        n = np.where(full, most, n - (np.repeat(times, times) - 1) * most)
        code = both >> 18
        starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else code
        return ((both & (BLOCK_DOCS - 1)) << COUNT_BITS | n).astype(np.int32), np.append(starts, len(code))


def _to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """A row (id, n_bytes, n_tokens, over_limit) for each document, without its ids.

    1. Blocks of documents are cut into pre-tokens (``PieceEncoder``: runs of text that the
       tokenizer never joins); a row is made for each distinct pre-token of a block, with
       the block's documents that have it and how often.
    2. These rows are dealt out and sorted by pre-token.  A task counts the pieces of each
       of its distinct pre-tokens once, joins the count to the rows and sums by document.
    3. The sums of all tasks are added up by block.

    A pre-token has one row a block, whose size is bounded by the block, and one that many
    of a block's documents have is spread over SPREAD keys: no frequent word is a hot key.
    Lists travel as packed 32-bit integers.  Vocabularies whose
    pre-tokens aren't known are used on whole texts where these are read.

    Null text counts as empty: 0 bytes, 0 tokens.  Repeated rows are counted each for itself
    (rows are told apart by their place, not by id); null ids stay.  An empty table gives no
    rows.  Other columns are left out.
    """
    path = tokenizer_path(tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()
    packed = "docs binary, block long, head binary"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path)
        number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 22
        columns = ["word", "spread", "docs", "block", "head"]

        def rows(block: _Block, number: int, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            n = len(block.ids)
            entries, bounds = block.lists()
            words = pieces.spelled(block.names)
            spread = np.where(np.diff(bounds) > n / COMMON, number % SPREAD if n > COMMON else 0, 0).astype(np.int32)
            for at in range(0, len(words), WORDS):
                own = bounds[at : at + WORDS + 1]
                m = len(own) - 1
                lists = pa.BinaryArray.from_buffers(pa.binary(), m, [None, pa.py_buffer(((own - own[0]) * 4).astype(np.int32)), pa.py_buffer(entries[own[0] : own[-1]])])
                yield pa.RecordBatch.from_arrays([pa.array(words[at : at + WORDS], pa.string()), pa.array(spread[at : at + WORDS]), lists, pa.array(np.full(m, number)), pa.nulls(m, pa.binary())], names=columns)
            head = _to_bytes(pa.RecordBatch.from_arrays([pa.array(block.ids, id_type), pa.array(block.n_bytes, pa.int64()), pa.array(block.known, pa.int64())], names=["id", "n_bytes", "n_tokens"]))
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([number % (1 << 30)], pa.int32()), pa.nulls(1, pa.binary()), pa.array([number]), pa.array([head], pa.binary())], names=columns)

        block, id_type = _Block(), pa.null()
        for batch in batches:
            id_type = batch.schema.field(0).type
            keys = batch.column(0).to_pylist()
            for a, b, part in text_parts(batch.column(1)):
                for key, text in zip(keys[a:b], part):
                    cut = pieces.pre_tokens(text)
                    block.add(key, text, cut, len(pieces.whole([text])[0]) // 4 if cut is None else 0)
                    if block.chars >= BLOCK_CHARS or len(block.ids) >= BLOCK_DOCS:
                        yield from rows(block, number, id_type)
                        block, number = _Block(), number + 1
        if block.ids:
            yield from rows(block, number, id_type)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = encoder(path)
        last, last_n = None, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def sums() -> Iterator[pa.RecordBatch]:
            """Sums by document, a row for each block."""
            if not held:
                return
            block, entry, n = map(np.concatenate, zip(*held))
            held.clear()
            # one sort by block and document, whatever number of blocks there is
            names, at = np.unique(block, return_inverse=True)
            place = at << 18 | entry >> COUNT_BITS
            order = np.argsort(place, kind="stable")
            place = place[order]
            begins = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
            total = np.add.reduceat(n[order].astype(np.int64), begins)
            place = place[begins]
            some = total > 0
            place, total = place[some], total[some]
            ends = np.searchsorted(place >> 18, np.arange(len(names)), "right")
            begin = 0
            for name, end in zip(names.tolist(), ends.tolist()):
                sums = np.stack([place[begin:end] & (BLOCK_DOCS - 1), total[begin:end]]).tobytes()
                begin = end
                yield pa.RecordBatch.from_arrays([pa.array([sums], pa.binary()), pa.array([name], pa.int64()), pa.nulls(1, pa.binary())], names=["docs", "block", "head"])

        for batch in batches:
            word = batch.column("word")
            head = batch.filter(pc.is_null(word))
            if head.num_rows:
                yield head.select(["docs", "block", "head"])
            batch = batch.filter(pc.is_valid(word))
            if not batch.num_rows:
                continue
            runs = pc.run_end_encode(batch.column("word"))
            words = runs.values.to_pylist()
            new = words[1:] if words[0] == last else words
            n = ([last_n] if words[0] == last else []) + pieces.count(new)
            last, last_n = words[-1], n[-1]
            n = np.repeat(n, np.diff(np.append(0, runs.run_ends.to_numpy())))
            many = pc.binary_length(batch.column("docs")).to_numpy() // 4
            entry = np.frombuffer(b"".join(batch.column("docs").to_pylist()), np.int32)
            held.append((np.repeat(batch.column("block").to_numpy(), many), entry, np.repeat(n, many) * (entry & ((1 << COUNT_BITS) - 1))))
            if sum(len(x[1]) for x in held) >= ENTRIES:
                yield from sums()
        yield from sums()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block: one with its documents, the others with sums."""
        number, head, total = None, None, np.zeros(BLOCK_DOCS, dtype=np.int64)

        def done() -> Iterator[pa.RecordBatch]:
            if head is not None:
                own = pa.ipc.open_stream(head).read_next_batch()
                yield pa.RecordBatch.from_arrays([own.column("id"), own.column("n_bytes"), pa.array(total[: len(own)] + own.column("n_tokens").to_numpy())], names=["id", "n_bytes", "n_tokens"])

        for batch in batches:
            for sums, name, said in zip(*(c.to_pylist() for c in batch.columns)):
                if name != number:
                    yield from done()
                    number, head = name, None
                    total[:] = 0
                if said is not None:
                    head = said
                else:
                    some, more = np.frombuffer(sums, np.int64).reshape(2, -1)
                    total[some] += more
        yield from done()

    words = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(listed, f"word string, spread int, {packed}")
    sums = words.repartition("word", "spread").sortWithinPartitions("word").mapInArrow(counted, packed)
    total = sums.repartition("block").sortWithinPartitions("block").mapInArrow(added, f"id {kind}, n_bytes long, n_tokens long")
    return total.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
