"""Filter interaction audit (operator 11): what five filters remove in every order, from one scan of the texts.

Texts are scanned as Arrow buffers: byte classes and their prefix sums count words, capitals, symbols and code points of
all texts of a slice at once; distinct words are runs of equal hashes sorted within a document, verified byte by byte.
A document is then a mask of the filters it fails. Masks are counted by part, and the counts of a part, one number for
each mask, give all orders and steps by products with 0-1 matrices. No text is shuffled, nor any row of a document
twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrastkit.llm.common import cut, text_slices, word_spans

#: Filters in the order of their bits in a mask.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
_MASKS = 1 << len(FILTERS)
#: Symbols that fail filter D.
SYMBOLS = "#$%&*|"
_CAPITAL, _SYMBOL, _STARTS = np.zeros(256, np.int64), np.zeros(256, np.int64), np.ones(256, np.int64)
_CAPITAL[ord("A") : ord("Z") + 1] = 1
_SYMBOL[list(SYMBOLS.encode())] = 1
_STARTS[0x80:0xC0] = 0  # bytes that go on with a code point
#: Bytes of a word that are hashed and compared eight at a time; what is left of longer ones is taken as a whole.
_WORD_BYTES = 64


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between neighbouring offsets."""
    before = np.concatenate([[0], np.cumsum(values)])
    return before[offsets[1:]] - before[offsets[:-1]]


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))


def _taken(eights: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The first `left` bytes, eight at most, from each place `at` on."""
    over = np.minimum(left, 8).astype(np.uint64)
    return eights[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((np.uint64(8) - over) * np.uint64(8)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word."""
    eights, size = _eights(data), end - start
    out = _mixed(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    open_, k = np.arange(len(start)), 0
    while len(open_) and k < _WORD_BYTES:
        out[open_] = _mixed(out[open_] ^ _taken(eights, start[open_] + k, size[open_] - k))
        k += 8
        open_ = open_[size[open_] > k]
    for w in open_.tolist():
        out[w] ^= np.uint64(xxhash.xxh3_64_intdigest(data[start[w] + k : end[w]].data))
    return out


def _same(data: np.ndarray, a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether the words at a and b are equal."""
    eights, out = _eights(data), size_a == size_b
    open_, k = np.flatnonzero(out), 0
    while len(open_) and k < _WORD_BYTES:
        left = size_a[open_] - k
        alike = _taken(eights, a[open_] + k, left) == _taken(eights, b[open_] + k, left)
        out[open_[~alike]] = False
        k += 8
        open_ = open_[alike & (size_a[open_] > k)]
    for w in open_.tolist():
        out[w] = np.array_equal(data[a[w] + k : a[w] + size_a[w]], data[b[w] + k : b[w] + size_a[w]])
    return out


def distinct_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How many different words each row has. Words that share a hash are compared; a row in which two of those differ
    is counted from its words."""
    hashes = word_hashes(data, start, end)
    order = np.lexsort((hashes, row))
    by_hash, by_row = hashes[order], row[order]
    again = np.flatnonzero((by_hash[1:] == by_hash[:-1]) & (by_row[1:] == by_row[:-1])) + 1
    out = np.bincount(row, minlength=rows) - np.bincount(by_row[again], minlength=rows)
    one, two = order[again - 1], order[again]
    size = end - start
    unlike = ~_same(data, start[one], start[two], size[one], size[two])
    for r in np.unique(row[two[unlike]]).tolist():
        own = np.flatnonzero(row == r)
        out[r] = len({data[a:b].tobytes() for a, b in zip(start[own].tolist(), end[own].tolist())})
    return out


def text_signals(docs: DataFrame) -> DataFrame:
    """The columns doc_id and part with n_words, n_distinct, n_capitals, n_symbols, n_chars and a 128-bit hash (h, h2) of the text."""
    names = ["n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars", "h", "h2"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            texts = batch.column(2)
            for a, b, data, offsets in text_slices(texts):
                start, end, row = word_spans(data, offsets)
                edges = zip(offsets[:-1].tolist(), offsets[1:].tolist())
                whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[x:y].data) for x, y in edges), dtype=np.int64).reshape(-1, 2)
                made = [np.bincount(row, minlength=b - a), distinct_words(data, start, end, row, b - a)]
                made += [_sums(kind[data], offsets) for kind in (_CAPITAL, _SYMBOL, _STARTS)]
                made += [whole[:, 0], whole[:, 1]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), *(pa.array(x, pa.int64()) for x in made)], names=["doc_id", "part", *names])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return own.mapInArrow(run, "doc_id long, part string, " + ", ".join(f"{n} long" for n in names))


def failed_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, rows): the filters that documents fail, as bits in the order of FILTERS, and how many rows
    of docs share all three and the text.

    E fails where an equal text has a smaller doc_id. A null doc_id is smaller than none and none is smaller than it.
    """
    words, n = F.col("n_words"), F.lit(100)
    fails = [words < LEAST_WORDS, n * F.col("n_distinct") < LEAST_DISTINCT * words, n * F.col("n_capitals") > MOST_CAPITALS * F.col("n_chars"), F.col("n_symbols") > 0]
    own = sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0)).cast("int")
    scanned = text_signals(docs).select("doc_id", "part", own.alias("own"), "h", "h2")
    scanned = cut(scanned.groupBy("doc_id", "part", "own", "h", "h2").agg(F.count(F.lit(1)).alias("rows")), "scanned")
    first = scanned.where("doc_id is not null").groupBy("h", "h2").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    # met by doc_id as well: the copies of a text are never in one task
    met = scanned.where("doc_id is not null").join(first, ["doc_id", "h", "h2"], "left")
    mask = F.col("own") + F.when(F.col("first"), F.lit(0)).otherwise(F.lit(1 << FILTERS.index("E")))
    return met.select("doc_id", "part", mask.alias("mask"), "rows").unionByName(scanned.where("doc_id is null").select("doc_id", "part", F.col("own").alias("mask"), "rows"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows by part and mask, and how many of them have a label quality 1, or toxic 1.

    Of several labels of a doc_id any counts; labels without doc_id or value say nothing.
    """
    one = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias(name)
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality"), one("toxic")).where("quality or toxic")
    joined = masks.where("doc_id is not null").join(marked, "doc_id", "left")
    all_rows = joined.unionByName(masks.where("doc_id is null"), allowMissingColumns=True)
    counted = lambda name: F.sum(F.when(F.col(name), F.col("rows")).otherwise(0))
    return all_rows.groupBy("part", "mask").agg(F.sum("rows").alias("n"), counted("quality").alias("good"), counted("toxic").alias("toxic"))


def _orders() -> tuple[list[str], list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each order and step: its name, its number, the filter's bit; and which masks are kept, removed, redundant there."""
    names, steps, bits, kept, removed, redundant = [], [], [], [], [], []
    mask = np.arange(_MASKS)
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            own = 1 << k
            names.append("".join(FILTERS[i] for i in order))
            steps.append(step)
            bits.append(own)
            removed.append((mask & own > 0) & (mask & before == 0))
            redundant.append((mask & own > 0) & (mask & before > 0))
            before |= own
            kept.append(mask & before == 0)
    return names, steps, np.array(bits), *(np.array(x, dtype=np.int64).T for x in (kept, removed, redundant))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each source
    of docs (null: empty string), all orders of FILTERS, and all steps of an order.

    Rows count each for itself, also if they are alike or have no doc_id. Null texts are empty. No rows: no rows out.
    Of labels, doc_id, quality and toxic are read; of docs, doc_id, text and source.
    """
    names, steps, bits, kept, removed, redundant = _orders()
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part, cells in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.zeros((3, _MASKS), np.int64)
                for cell in cells:
                    counts[:, cell["mask"]] = cell["n"], cell["good"], cell["toxic"]
                gone = counts @ removed
                made = [counts[0] @ kept, gone[0], counts[0] @ redundant, counts[0][bits], gone[1], gone[2], np.bincount(bits, weights=gone[0])[bits].astype(np.int64)]
                if gone[0].sum() > 1 << 52:  # beyond what doubles add exactly
                    made[-1] = np.array([sum(gone[0][bits == b].tolist()) for b in bits.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(names)), pa.array(names), pa.array(steps, pa.int32()), *(pa.array(x) for x in made)], names=["part", "filter_order", "step", *columns])

    counts = mask_counts(failed_masks(docs), labels)
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    return cells.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in columns))
