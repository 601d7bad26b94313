"""Benchmark decontamination by templates: questions are found even if numbers, names and units are changed."""

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, stored, worker_keeps
from tidemark.llm.tokens import text_parts

#: Words in a window, and the share of an item's windows that a contaminated document holds.
WINDOW = 5
SIMILARITY = 0.8
#: A window of a template needs so many words that are no placeholders.
LEAST_WORDS = 2
#: Items of fewer words than a window are windows of their own length, down to so many words; shorter ones have to be the whole text.
LEAST_ITEM = 3
#: Bits of the filter that windows of texts have to pass before they are joined with the benchmark's: 8 MB, whatever the benchmark's size.
FILTER_BITS = 26
#: Distinct words that a worker keeps.
CACHE_WORDS = 300_000
#: Units that a number may have.
UNITS = frozenset(
    "mm cm dm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces ml cl l liter liters litre litres gallon gallons "
    "s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years "
    "kb mb gb tb byte bytes bit bits hz khz mhz ghz w kw v a k c f degree degrees percent euro euros dollar dollars cent cents usd eur gbp".split()
)
_NUMBER = re.compile(r"[-+]?([$€£¥]?)(\d[\d.,:/]*)(%|[a-zµ°]{1,3})?")
_EDGES = re.compile(r"^[^\w$€£¥+-]+|[^\w%°]+$")
WORD, NUMBER, UNIT, TITLE, ENDS, EMPTY = 0, 1, 2, 4, 8, 16
#: Readings of a text: words as they are; names within sentences as slots; title case at a sentence's start too.
PLAIN, INNER, ALL = 0, 1, 2
_PLACE = np.array([xxhash.xxh64_intdigest(x) for x in (b"<number>", b"<unit>", b"<name>")], dtype=np.uint64)
_POWERS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(WINDOW)], dtype=np.uint64)


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def canonical(raw: str) -> tuple[int, int, int]:
    """Hash of a word in lower case without signs around it, what it can be, and the hash of a unit that is part of it (0: none)."""
    core = raw if raw.isalnum() else _EDGES.sub("", raw)
    ends = ENDS if raw.rstrip("\"')]»”’").endswith((".", "!", "?", ":", ";")) else 0
    if not any(map(str.isalnum, core)):
        return 0, EMPTY | ends, 0
    lower = core.lower()
    number = _NUMBER.fullmatch(lower)
    if number:
        unit = number[1] or number[3] or ""
        return _hash(number[2].rstrip(".,:/")), NUMBER | ends, _hash(unit) if unit else 0
    return _hash(lower), (UNIT if lower in UNITS else TITLE if len(core) > 1 and core.istitle() else WORD) | ends, 0


class Words:
    """Canonical words by spelling, as arrays; bounded."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.hashes = np.empty(1 << 16, dtype=np.uint64)
        self.units = np.empty(1 << 16, dtype=np.uint64)
        self.kinds = np.empty(1 << 16, dtype=np.uint8)

    def of(self, raw: list[str]) -> np.ndarray:
        """Places of the words in the arrays."""
        codes = self.codes
        new = set(raw).difference(codes)
        if new:
            if len(codes) + len(new) > CACHE_WORDS and codes:
                codes.clear()
                new = set(raw)
            if len(codes) + len(new) > len(self.hashes):
                size = 2 * (len(codes) + len(new))
                self.hashes, self.units, self.kinds = (np.resize(x, size) for x in (self.hashes, self.units, self.kinds))
            for w in new:
                at = len(codes)
                self.hashes[at], self.kinds[at], self.units[at] = canonical(w)
                codes[w] = at
        return np.fromiter(map(codes.__getitem__, raw), np.int64, len(raw))


def readings(text: str, words: Words) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """A text's words as values, and by reading their codes (slots have a placeholder's) and which are slots (0: none, 1: number or unit, 2: name)."""
    at = words.of(text.split())
    hashes, kinds, units = words.hashes[at], words.kinds[at], words.units[at]
    ended = np.append(True, (kinds[:-1] & ENDS) > 0) if len(kinds) else np.empty(0, dtype=bool)
    place = np.flatnonzero((kinds & EMPTY) == 0)
    hashes, kinds, units, ended = hashes[place], kinds[place], units[place], ended[place]
    if units.any():  # a number with its unit is two words
        fused = units != 0
        begins = np.repeat(np.arange(len(hashes)), 1 + fused)
        second = np.append(False, begins[1:] == begins[:-1])
        hashes = np.where(second, units[begins], hashes[begins])
        kinds = np.where(second, np.uint8(UNIT), kinds[begins])
        ended = ended[begins] & ~second
    number = (kinds & NUMBER) > 0
    unit = ((kinds & UNIT) > 0) & np.append(False, number[:-1]) if len(kinds) else number
    title = (kinds & TITLE) > 0
    inner = title & ~ended
    quantities = np.where(number, _PLACE[0], np.where(unit, _PLACE[1], hashes))
    slots = (number | unit).astype(np.uint8)
    out = {PLAIN: (hashes, np.zeros(len(hashes), dtype=np.uint8))}
    for reading, name in ((INNER, inner), (ALL, title)):
        out[reading] = np.where(name, _PLACE[2], quantities), slots | (name.astype(np.uint8) << 1)
    return hashes, out


def windows(codes: np.ndarray, size: int, reading: int) -> np.ndarray:
    """Hashes of the runs of so many words."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(n, (reading * (WINDOW + 1) + size) * 0xD6E8FEB86659FD93 % (1 << 64), dtype=np.uint64)
    for i in range(size):
        out += codes[i : n + i] * _POWERS[i]
    return out ^ (out >> np.uint64(32))


def strong(slots: np.ndarray, size: int) -> np.ndarray:
    """Which runs have enough words that are no slots."""
    n = max(0, len(slots) - size + 1)
    return sum(((slots[i : n + i] == 0).astype(np.int64) for i in range(size)), np.zeros(n, dtype=np.int64)) >= LEAST_WORDS


def consistent(hits: list[tuple[int, int, list[int], list[int], list[int]]]) -> int:
    """Most windows of an item that a text holds with slots filled consistently; hits are (place in the text, in the item, slots, values in the item, in the text).

    A value of the item has to be the same value of the text everywhere, and two names can't
    be one.  Windows with one shift between item and text stand or fall together; the shift
    with most windows is taken first, and others that agree with those taken are added.
    """
    shifts: dict[int, list] = defaultdict(list)
    for hit in hits:
        shifts[hit[0] - hit[1]].append(hit)
    groups: list[tuple[dict, dict, set[int]]] = []  # item's value to text's, text's name to item's, windows
    for shift in sorted(shifts, key=lambda s: (-len(shifts[s]), s)):
        said: dict[int, int] = {}
        back: dict[int, int] = {}
        fine = True
        for _, _, slots, ours, theirs in shifts[shift]:
            for slot, a, b in zip(slots, ours, theirs):
                if slot and said.setdefault(a, b) != b or slot == 2 and back.setdefault(b, a) != a:
                    fine = False
        if not fine:
            continue
        own = {hit[1] for hit in shifts[shift]}
        for values, names, found in groups:
            if all(values.get(a, b) == b for a, b in said.items()) and all(names.get(b, a) == a for b, a in back.items()):
                values.update(said)
                names.update(back)
                found |= own
                break
        else:
            groups.append((said, back, own))
    return max((len(found) for _, _, found in groups), default=0)


_ITEMS = "hash long, item {}, reading int, at int, size int, total int, slots array<int>, vals array<long>"


def _listed(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [[] for _ in schema], schema)], schema=schema)


def item_windows(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """A row for each distinct window of each reading of each item; ``total`` counts the item's.

    Every window of five words counts; those of templates only if they have LEAST_WORDS words
    that are no slots.  Shorter items have one window: the whole item.
    """
    item_type = benchmark.schema[item_col].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            schema = pa.schema([("hash", pa.int64()), ("item", batch.schema.field(0).type), ("reading", pa.int32()), ("at", pa.int32()), ("size", pa.int32()), ("total", pa.int32()), ("slots", pa.list_(pa.int32())), ("vals", pa.list_(pa.int64()))])
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values, read = readings(text, words)
                size = min(WINDOW, len(values))
                values = values.view(np.int64)
                for reading, (codes, slots) in read.items() if size else ():
                    hashes = windows(codes, size, reading)
                    keep = np.flatnonzero(strong(slots, size)) if reading != PLAIN else np.arange(len(hashes))
                    first = {int(hashes[i]): i for i in keep[::-1].tolist()}
                    rows += [(int(np.uint64(h).view(np.int64)), item, reading, i, size, len(first), slots[i : i + size].tolist(), values[i : i + size].tolist()) for h, i in first.items()]
            yield _listed(rows, schema)

    items = benchmark.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    return items.mapInArrow(made, _ITEMS.format(item_type)).distinct()


def _filter(items: DataFrame) -> np.ndarray:
    """A bit for each first part of a hash that some window has; made by Spark in pieces of 4 KB, of which there are at most 2048."""
    bit = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    rows = items.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("piece")).agg(F.expr("bitmap_construct_agg(bit & 32767)").alias("bits")).toLocalIterator()
    out = np.zeros((1 << FILTER_BITS) // 8, dtype=np.uint8)
    for r in rows:
        out[r.piece * 4096 : (r.piece + 1) * 4096] = np.frombuffer(r.bits, np.uint8)
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", item_out: str = "item_id", share_out: str = "coverage") -> DataFrame:
    """The table with the benchmark item that each text holds (null: none) and the share of the item's windows.

    Words are canonical (lower case, no signs around them, a number's unit a word of its own).
    Texts and items are read in three ways: as they are; with numbers, units after numbers and
    names (title case within a sentence) as slots; and with title case at a sentence's start
    as a name too.  A text holds an item if in one of the readings it has SIMILARITY or more of
    the item's distinct five-word windows, with slots filled consistently (``consistent``): a
    re-parameterised question has the windows of the original, and slots can add matches but
    never lose one that is there word for word.  Items of three or four words are one window;
    shorter ones have to be the whole text.

    Every window of every whole text is looked up in a filter of the benchmark's windows, a
    table of bits of one size; those that pass are joined with the benchmark by hash.  Equal
    texts are joined once, and texts without such windows are not shuffled.

    Null and empty texts and items: no match.  Ties go to the item with the smaller id.  Rows
    stay as they are, repeated ones too; columns named as the new ones are replaced.  An empty
    benchmark or table: no matches.
    """
    spark = docs.sparkSession
    item_type = benchmark.schema[item_col].dataType.simpleString()
    spare = docs.drop(*(c for c in docs.columns if c.lower() in (item_out.lower(), share_out.lower())))
    items = stored(item_windows(benchmark, item_col, item_text), "benchmark_windows")
    sizes = sorted(r.size for r in items.select("size").distinct().collect())  # one to five
    table = spark.sparkContext.broadcast(_filter(items))
    key = [F.xxhash64(text_col), F.xxhash64(F.lit(1), F.col(text_col))]

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The windows of texts that pass the filter."""
        words, bits, shift = worker_keeps("words", Words), table.value, np.uint64(64 - FILTER_BITS)
        names = ["k1", "k2", "hash", "at", "theirs"]
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, _, part in text_parts(batch.column(2)):
                found: list[list] = [[], [], [], []]
                values_of: list[np.ndarray] = []
                for i, text in enumerate(part, a):
                    values, read = readings(text, words)
                    for reading, (codes, _) in read.items():
                        for size in sizes:
                            if len(codes) < size or size < LEAST_ITEM and len(codes) != size:
                                continue
                            hashes = windows(codes, size, reading)
                            bit = hashes >> shift
                            hits = np.flatnonzero((bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                            if len(hits):
                                found[0].append(np.full(len(hits), k1[i]))
                                found[1].append(np.full(len(hits), k2[i]))
                                found[2].append(hashes[hits].view(np.int64))
                                found[3].append(hits.astype(np.int32))
                                values_of += [values[h : h + size].view(np.int64) for h in hits.tolist()]
                if values_of:
                    ends = np.cumsum([0, *map(len, values_of)])
                    theirs = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values_of)))
                    yield pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in found), theirs], names=names)

    hits = docs.where(F.col(text_col) != "").select(*key, text_col).mapInArrow(passed, "k1 long, k2 long, hash long, at int, theirs array<long>")
    joined = hits.join(items.withColumnRenamed("at", "item_at"), "hash").distinct()
    held = joined.groupBy("k1", "k2", "item", "reading", "total").agg(F.countDistinct("hash").alias("n"), F.collect_list(F.struct("at", "item_at", "slots", "vals", "theirs")).alias("hits"))
    held = held.where(F.col("n") >= F.col("total") * SIMILARITY)

    @F.pandas_udf("int")
    def checked(reading: pd.Series, n: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([int(m) if r == PLAIN else consistent([tuple(h.values()) for h in found]) for r, m, found in zip(reading, n, hits)], dtype="int32")

    share = (checked.asNondeterministic()("reading", "n", "hits") / F.col("total")).alias("share")
    best = held.select("k1", "k2", "item", share).where(F.col("share") >= SIMILARITY).groupBy("k1", "k2").agg(F.min(F.struct((-F.col("share")).alias("less"), "item")).alias("best"))
    k1, k2, item, less = fresh(spare, "k1", "k2", "held_item", "held_less")
    best = stored(best.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("best.item").alias(item), F.col("best.less").alias(less)), "leaks")
    told = spare.withColumns({k1: key[0], k2: key[1]}).join(best, [k1, k2], "left")
    return told.withColumns({item_out: F.col(item).cast(item_type), share_out: -F.col(less)}).select(*spare.columns, item_out, share_out)
