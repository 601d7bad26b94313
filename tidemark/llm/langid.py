"""Language identification: multinomial naive Bayes over hashed character n-grams."""

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import worker_keeps
from tidemark.llm.tokens import text_parts

UNDETERMINED = "und"
#: n-grams of 1 to 3 characters, in 2^16 buckets.
ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Languages that a model may hold: its matrix takes at most 512 x 65,536 x 4 bytes, 128 MB, on the driver and in each executor.
MAX_LANGUAGES = 512
#: Characters hashed at a time.
BLOCK = 1 << 20
#: Entries of the matrix that are gathered at a time.
GATHER = 1 << 22
_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def _letters() -> np.ndarray:
    """By code point, whether it is a letter or a mark that belongs to one."""
    return worker_keeps("letters", lambda: np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)), bool, 0x110000))


def _hashed(points: np.ndarray, owner: np.ndarray, new: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, owner) of the n-grams within one text that end at place ``new`` or after."""
    hashed = np.zeros(len(points), dtype=np.uint32)
    for n in ORDERS:
        if len(points) < n:
            return
        hashed = (hashed[: len(points) - n + 1] + points[n - 1 :]) * _MIX[n - 1]
        hashed ^= hashed >> np.uint32(15)
        ends = owner[n - 1 :]
        within = ends == owner[: len(ends)]
        within[: max(0, new - n + 1)] = False
        yield ((hashed >> np.uint32(7)) & np.uint32(BUCKETS - 1))[within], ends[within]


def batch_grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of the n-grams of texts and the place of the text that each belongs to, about BLOCK characters at a time.

    Characters are taken in lower case, runs of other than letters as one space each.  A text
    that is longer than a block goes on in the next one with its last characters: every
    n-gram counts once, wherever blocks end.
    """
    letters = _letters()
    held: list[str] = []
    names: list[int] = []
    size = 0
    before, letter_before = np.empty(0, np.uint32), True  # what a long text goes on with

    def block(parts: list[str], names: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal before, letter_before
        points = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint32)
        sizes = np.array([len(p) for p in parts])
        owner = np.repeat(np.array(names), sizes)
        letter = letters[points]
        follows = np.append(True, letter[:-1]) if len(letter) else letter
        begins = np.cumsum(np.append(0, sizes[:-1]))
        follows[begins[sizes > 0]] = True
        if len(follows):
            follows[0] = letter_before
        keep = letter | follows
        codes, owner = np.where(letter, points, np.uint32(32))[keep], owner[keep]
        n = len(before)
        letter_before = bool(letter[-1]) if len(letter) else letter_before
        codes, owner = np.append(before, codes), np.append(np.full(n, names[0]), owner)
        before = codes[-(max(ORDERS) - 1) :]
        yield from _hashed(codes, owner, n)

    def fresh_start() -> None:
        nonlocal before, letter_before
        before, letter_before = np.empty(0, np.uint32), True

    for i, text in enumerate(texts):
        text = text.lower()
        if len(text) >= BLOCK:
            if held:
                yield from block(held, names)
                held, names, size = [], [], 0
            fresh_start()
            for at in range(0, len(text), BLOCK):
                yield from block([text[at : at + BLOCK]], [i])
            fresh_start()
            continue
        held.append(text)
        names.append(i)
        size += len(text)
        if size >= BLOCK:
            yield from block(held, names)
            fresh_start()
            held, names, size = [], [], 0
    if held:
        yield from block(held, names)


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of one text's n-grams."""
    return (buckets for buckets, _ in batch_grams([text]))


@dataclass(frozen=True)
class Model:
    """Log-probabilities by bucket and language, and the languages' logarithmic shares of the training text."""

    languages: tuple[str, ...]
    weights: np.ndarray = field(repr=False)
    prior: np.ndarray = field(repr=False)

    def predict_all(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The likeliest language of each text, its posterior probability, and how well it fits; ``und`` and 0 without a letter.

        Rows of the matrix are gathered for the n-grams of all texts together and summed by
        text.  The fit is the mean logarithm by which the language makes the text's n-grams
        likelier than buckets drawn evenly would be: below 0 it is none of the languages.
        """
        lettered = [self.languages != () and has_letter(t) for t in texts]
        many = np.zeros(len(texts))
        total = np.tile(self.prior.astype(np.float64), (len(texts), 1))
        step = max(1, GATHER // max(1, len(self.languages)))
        for buckets, owner in batch_grams([t if fine else "" for t, fine in zip(texts, lettered)]):
            many += np.bincount(owner, minlength=len(texts))
            for at in range(0, len(buckets), step):
                own = owner[at : at + step]
                begins = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                total[own[begins]] += np.add.reduceat(self.weights[buckets[at : at + step]], begins, axis=0, dtype=np.float64)
        if not self.languages or not texts:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        best = total.argmax(axis=1)  # ties go to the language that sorts first
        score = 1.0 / np.exp(np.clip(total - total[np.arange(len(texts)), best][:, None], -700, 0)).sum(axis=1)
        fit = (total.max(axis=1) - self.prior[best]) / np.maximum(many, 1) + np.log(BUCKETS)
        return [self.languages[b] if fine else UNDETERMINED for b, fine in zip(best.tolist(), lettered)], np.where(lettered, score, 0.0), np.where(lettered, fit, 0.0)

    def predict(self, text: str | None) -> tuple[str, float]:
        said, score, _ = self.predict_all([text])
        return said[0], float(score[0])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3


def train(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model:
    """Fits a model to all rows with text and language.

    Each task counts buckets by language for its rows; the counts of all tasks are summed
    by (language, bucket) and turned into a row of log-probabilities for each language, so
    what reaches the driver is at most MAX_LANGUAGES rows of 256 KB.  More languages are an
    error, found before anything is counted.  Null text or language: left out.  No rows: a
    model without languages.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    languages = tuple(sorted(r.lang for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect()))
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(languages), BUCKETS), dtype=np.int64)
        place = {lang: i for i, lang in enumerate(languages)}
        for batch in batches:
            of = np.array([place[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
            for a, b, part in text_parts(batch.column(0)):
                for buckets, owner in batch_grams(part):
                    own = of[a:b][owner]
                    for i in np.unique(own).tolist():
                        counts[i] += np.bincount(buckets[own == i], minlength=BUCKETS)
        for i in np.flatnonzero(counts.any(axis=1)).tolist():
            at = np.flatnonzero(counts[i])
            yield pa.RecordBatch.from_arrays([pa.array([languages[i]] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[i, at])], names=["lang", "bucket", "n"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, own in zip(batch.column(0).to_pylist(), batch.column(1)):
                n = np.zeros(BUCKETS)
                n[own.values.field("bucket").to_numpy()] = own.values.field("n").to_numpy()
                weights = np.log(n + smoothing) - np.log(n.sum() + smoothing * BUCKETS)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([float(n.sum())]), pa.array([weights.astype("<f4").tobytes()], pa.binary())], names=["lang", "share", "weights"])

    counted = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    weighed = counted.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts")).mapInArrow(weigh, "lang string, share double, weights binary")
    found = {r.lang: r for r in weighed.toLocalIterator()}  # a language may have no n-gram at all
    languages = tuple(x for x in languages if x in found)
    share = np.array([found[x].share for x in languages])
    weights = np.array([np.frombuffer(found[x].weights, "<f4") for x in languages]).reshape(len(languages), BUCKETS)
    return Model(languages, np.ascontiguousarray(weights.T), np.log(share / share.sum()) if languages else share)


def identify(docs: DataFrame, model: Model, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", fit_out: str | None = None) -> DataFrame:
    """The table with a predicted language and the score of it (posterior probability), and if asked for the fit (``Model.predict_all``).

    The matrix of log-probabilities (buckets by languages, 4 bytes each: a bound that the
    input's size doesn't touch) is broadcast; each text is scored whole from its own
    n-grams, those of a batch of texts together, and nothing else of the row is looked at.  Null text and text without a letter:
    ``und`` with score 0.  Columns of the table named as the new ones are replaced; rows,
    repeated ones too, stay as they are.
    """
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang string, score double, fit double>")
    def scored(texts: pd.Series) -> pd.DataFrame:
        said, score, fit = shared.value.predict_all(texts.tolist())
        return pd.DataFrame({"lang": said, "score": score, "fit": fit})

    said = scored.asNondeterministic()(F.col(text_col))  # or a filter on what it says scores texts a second time
    return docs.withColumns({lang_out: said["lang"], score_out: said["score"]} | ({fit_out: said["fit"]} if fit_out else {}))

