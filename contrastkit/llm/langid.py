"""Language ID (operator 10): multinomial naive Bayes over hashed character n-grams.

The matrix of log-probabilities is broadcast by languages, TOGETHER at a time; texts go by one such part after another,
and carry the best language so far and the sum of all probabilities. So neither a task nor the driver holds more than a
part, however many languages there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from contrastkit.llm.common import cut, own_names

#: Hash buckets of n-grams, and languages whose log-probabilities are sent together: 16 MB.
BUCKETS, TOGETHER = 1 << 15, 64
#: Labelled documents learned from in each language, in expectation: all of a rarer language, a hashed sample of others.
PER_LANGUAGE = 2000
#: Most languages; a column with more values is taken for something else than languages.
MOST_LANGUAGES = 10_000
UNDETERMINED = "und"
_BLOCK = 1 << 19
_ODD = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917, 668265263)]


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for k in range(0x110000):
        c = chr(k)
        if c.isalpha():
            low = c.lower()
            out[k] = ord(low) if len(low) == 1 else k
    return out


def _codes(text: str) -> np.ndarray:
    return _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]


def _grams(c: np.ndarray, buckets: int) -> list[np.ndarray]:
    """For n = 1, 2, 3 the bucket of the n-gram that starts at each place; `buckets` where there is none.

    Words are their letters between two blanks; no n-gram holds a blank between letters or two blanks.
    """
    shift = np.uint32(32 - buckets.bit_length() + 1)
    one = c * _ODD[0]
    two, three = np.zeros_like(c), np.zeros_like(c)
    two[:-1] = one[:-1] ^ (c[1:] * _ODD[1] + _ODD[3])
    three[:-2] = two[:-2] ^ (c[2:] * _ODD[2] + _ODD[1])
    solid = c > 0
    has_two, has_three = np.zeros(len(c), bool), np.zeros(len(c), bool)
    has_two[:-1] = solid[:-1] | solid[1:]
    has_three[:-2] = solid[1:-1]
    return [np.where(has, ((h ^ (h >> np.uint32(15))) * _ODD[1]) >> shift, np.uint32(buckets)) for h, has in ((one, solid), (two, has_two), (three, has_three))]


def _blocks(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(letters, first place of each text, number of each text, places that count) for blocks of texts.

    Each text stands between two blanks; one longer than a block comes in parts that share two places.
    """
    def block(parts: list[str], numbers: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        starts = np.cumsum([0, *(len(x) + 2 for x in parts[:-1])])
        codes = _codes("\0" + "\0\0".join(parts) + "\0")
        return codes, starts, np.array(numbers), len(codes)

    held, numbers, size = [], [], 0
    for k, text in enumerate(texts):
        if len(text) > _BLOCK:
            whole = "\0" + text + "\0"
            for a in range(0, len(whole), _BLOCK):
                codes = _codes(whole[a : a + _BLOCK + 2])
                yield codes, np.zeros(1, np.int64), np.array([k]), min(_BLOCK, len(codes))
            continue
        if held and size + len(text) > _BLOCK:
            yield block(held, numbers)
            held, numbers, size = [], [], 0
        held.append(text)
        numbers.append(k)
        size += len(text)
    if held:
        yield block(held, numbers)


def _sample(labelled: DataFrame, per_language: int) -> DataFrame:
    """All rows of a language with at most per_language of them, else those with the lowest hashes."""
    share = cut(labelled.groupBy("lang").count().select("lang", (F.lit(float(per_language)) / F.col("count")).alias("share")), "shares")
    if share.count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    return labelled.join(F.broadcast(share), "lang").where(place < F.col("share"))  # texts stay where they are


class Part:
    """Log-probabilities of some languages: a row for each, a column for each bucket and one of zeros for no n-gram."""

    def __init__(self, languages: list[str], counts: np.ndarray, prior: np.ndarray, smoothing: float) -> None:
        self.languages, self.prior, self.buckets = languages, prior, counts.shape[1]
        self.table = np.zeros((len(languages), self.buckets + 1))
        smooth = counts + smoothing
        self.table[:, :-1] = np.log(smooth / smooth.sum(axis=1, keepdims=True))

    def totals(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-probability of each text and language, and the letters of each text."""
        n = len(self.languages)
        total, letters = np.zeros((len(texts), n)), np.zeros(len(texts), np.int64)
        for codes, starts, numbers, used in _blocks([x or "" for x in texts]):
            grams = [g[:used] for g in _grams(codes, self.buckets)]
            np.add.at(letters, numbers, np.add.reduceat((codes[:used] > 0).astype(np.int64), starts))
            for k in range(n):
                values = self.table[k][grams[0]]
                for g in grams[1:]:
                    values += self.table[k][g]
                np.add.at(total[:, k], numbers, np.add.reduceat(values, starts))
        return total + self.prior, letters


class Model:
    """Parts of a naive Bayes model: their languages are in order."""

    def __init__(self, languages: list[str], counts: np.ndarray, documents: np.ndarray, smoothing: float, together: int = TOGETHER) -> None:
        prior = np.log((documents + 1.0) / (documents.sum() + len(languages))) if len(languages) else np.zeros(0)
        self.languages = languages
        self.parts = [Part(languages[a : a + together], counts[a : a + together], prior[a : a + together], smoothing) for a in range(0, len(languages), together)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability of each text."""
        state = [None] * len(texts), np.full(len(texts), -np.inf), np.zeros(len(texts))
        for part in self.parts:
            state = _onward(part, texts, *state)
        return _settled(*state)


def _onward(part: Part, texts: list[str | None], best: list[str | None], most: np.ndarray, rest: np.ndarray) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """The best language so far of each text (none if it has no letter), its log-probability, and the sum of all
    probabilities so far over the best one's, after one more part."""
    total, letters = part.totals(texts)
    high = total.max(axis=1)
    own = np.exp(total - high[:, None]).sum(axis=1)
    ahead = high > most
    top = np.where(ahead, high, most)
    with np.errstate(invalid="ignore"):
        rest = rest * np.exp(np.where(np.isneginf(most), 0.0, most - top)) + own * np.exp(high - top)
    place = total.argmax(axis=1).tolist()
    found = [(part.languages[p] if up else b) if n else None for p, up, b, n in zip(place, ahead.tolist(), best, letters.tolist())]
    return found, top, rest


def _settled(best: list[str | None], most: np.ndarray, rest: np.ndarray) -> tuple[list[str], np.ndarray]:
    known = np.array([b is not None for b in best], bool)
    return [UNDETERMINED if b is None else b for b in best], np.where(known, 1 / np.maximum(rest, 1.0), 0.0)


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE, buckets: int = BUCKETS, smoothing: float = 0.5) -> Model:
    """A model of the languages of (doc_id, text, lang); rows with null text or lang are not learned from."""
    labelled = labelled.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    rows = _sample(labelled, per_language)

    # a language and bucket: one row for each batch that holds it; bucket -1 counts documents
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                counts = np.zeros(buckets + 1, np.int64)
                for codes, _, _, used in _blocks(texts):
                    for g in _grams(codes, buckets):
                        counts += np.bincount(g[:used], minlength=buckets + 1)
                met = np.flatnonzero(counts[:-1])
                columns = [pa.array([lang] * (len(met) + 1)), pa.array(np.append(met, -1)), pa.array(np.append(counts[met], len(texts)))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counted = cut(counted, "n-grams")
    met = {r["lang"]: r["n"] for r in counted.where("bucket = -1").select("lang", "n").collect()}  # MOST_LANGUAGES at most
    names = sorted(met)
    model = Model([], np.zeros((0, buckets)), np.zeros(0), smoothing)
    model.languages = names
    whole = sum(met.values()) + len(names)
    for a in range(0, len(names), TOGETHER):
        own = names[a : a + TOGETHER]
        found = counted.where((F.col("bucket") >= 0) & F.col("lang").isin(own)).toArrow()  # buckets rows for each language
        counts = np.zeros((len(own), buckets))
        place = pc.index_in(found.column("lang"), pa.array(own)).to_numpy()
        counts[place, found.column("bucket").to_numpy()] = found.column("n").to_numpy()
        model.parts.append(Part(own, counts, np.log((np.array([met[x] for x in own]) + 1.0) / whole), smoothing))
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs with lang_pred and score: the likeliest language and its posterior probability.

    UNDETERMINED and 0 where text is null or has no letter, or where nothing was learned. Columns of docs by those
    names are replaced.
    """
    spark = docs.sparkSession
    best, most, rest = own_names(docs, "best_lang", "best_log", "all_chances")
    kept = docs.drop("lang_pred", "score")
    state = [StructField(best, StringType()), StructField(most, DoubleType()), StructField(rest, DoubleType())]
    end = [StructField("lang_pred", StringType()), StructField("score", DoubleType())]

    def step(part: Part | None, first: bool, last: bool):
        sent = spark.sparkContext.broadcast(part)

        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                texts, n = batch.column("text").to_pylist(), batch.num_rows
                now = ([None] * n, np.full(n, -np.inf), np.zeros(n)) if first else (batch.column(best).to_pylist(), batch.column(most).to_numpy(), batch.column(rest).to_numpy())
                if sent.value is not None:
                    now = _onward(sent.value, texts, *now)
                names = [x for x in batch.schema.names if x not in (best, most, rest)]
                if last:
                    named, score = _settled(*now)
                    more = {"lang_pred": pa.array(named, pa.string()), "score": pa.array(score, pa.float64())}
                else:
                    more = {best: pa.array(now[0], pa.string()), most: pa.array(now[1], pa.float64()), rest: pa.array(now[2], pa.float64())}
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), *more.values()], names=[*names, *more])

        return run

    parts, out = model.parts or [None], kept
    for k, part in enumerate(parts):
        last = k + 1 == len(parts)
        out = out.mapInArrow(step(part, k == 0, last), StructType([*kept.schema.fields, *(end if last else state)]))
    return out


def held_out() -> Column:
    """Documents that are never learned from: crc32 of the doc_id as text leaves 2 when divided by 4. Null: false."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify_languages(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """All columns of docs with held_out, lang_pred and score, learned from the documents that are not held out.

    lang, source and doc_id are no inputs of a prediction. A null doc_id is neither held out nor learned from. Rows
    that repeat are learned from and predicted each for itself. Columns by the three names are replaced. No rows in: no
    rows out; with nothing to learn from, all are undetermined.
    """
    model = train(docs.where(~held_out() & F.col("doc_id").isNotNull()), per_language)
    return predict(docs.drop("held_out").withColumn("held_out", held_out()), model)
