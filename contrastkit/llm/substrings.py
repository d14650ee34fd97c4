"""Repeated passages (operator 4): difference-cover anchors find them, whole windows confirm them.

D is a perfect difference set modulo PERIOD: for any two positions i and j some shift below PERIOD takes both into D.
So two equal windows share an anchor (the words from a position in D on, window - PERIOD + 1 of them) at the same
place in both. Anchors are hashed at positions in D only; those found more than once are extended to every window
that holds them, and a window counts as repeated when its own 128-bit hash is found more than once.

Hashes are counted by a shuffle, in which a passage of very many texts would be a hot key. Those are known beforehand:
what is found more than once in a sample of the texts is repeated in all of them, so it need not be counted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contrastkit.llm.common import cut, row_key, text_slices, word_spans

#: Perfect difference sets (fixed values): every residue is the difference of two members.
COVERS = {21: (0, 1, 4, 14, 16), 13: (0, 1, 3, 9), 7: (0, 1, 3)}
WINDOW = 35
_ODD = 6364136223846793005
_WRAP = (1 << 64) - 1


def _tables(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, 256, dtype=np.uint64)


_BYTES = (_tables(1), _tables(2))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & _WRAP, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Rolling:
    """Hashes of word sequences of any length, from prefix sums of word hashes modulo 2 ** 64."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int) -> None:
        size = end - start
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        place = np.repeat(start, size) + inner
        values = _BYTES[which][data[place]] * _powers(_ODD + 2 * which, int(size.max()))[inner]
        words = _mixed(np.add.reduceat(values, np.cumsum(size) - size))
        base = _ODD ^ (2 + 4 * which)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(base, len(words)), dtype=np.uint64)])
        self.back = _powers(pow(base, -1, 1 << 64), len(words))

    def at(self, first: np.ndarray, length: int) -> np.ndarray:
        return _mixed((self.sums[first + length] - self.sums[first]) * self.back[first] + np.uint64(length))


def _rows_of(row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Words of each row, and the first word of each row."""
    count = np.bincount(row, minlength=rows)
    return count, np.concatenate([[0], np.cumsum(count)[:-1]])


def _once(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each value: is it the first of its kind here, and is there more than one."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    group = np.cumsum(fresh) - 1
    first, many = np.empty(len(hashes), bool), np.empty(len(hashes), bool)
    first[order] = fresh
    many[order] = np.bincount(group)[group] > 1
    return first, many


def _emit(keys: np.ndarray, at: np.ndarray, hashes: np.ndarray, other: np.ndarray, known: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    """Rows to be counted by hash. What is known to be repeated is sent once under its hash and otherwise, or if it is hot,
    under a hash of its own place, so that no hash brings more than one row from a slice to a task, nor a hot one any."""
    first, many = _once(hashes)
    spread = ~first | hot
    sent = hashes.copy()
    sent[spread] = _mixed(keys[spread].astype(np.uint64) * np.uint64(_ODD) + at[spread].astype(np.uint64) * np.uint64(2) + np.uint64(1))
    note = at.astype(np.int64) * 2 + (many | known | hot)
    columns = [pa.array(sent.view(np.int64)), pa.array(keys), pa.array(note), pa.array(np.where(spread, np.uint64(0), other).view(np.int64))]
    return pa.RecordBatch.from_arrays(columns, names=["h", "key", "note", "h2"])


class _Hot:
    """Hashes known to be repeated, sorted, and for whole texts the key of the copy that speaks for all."""

    def __init__(self, h: np.ndarray, h2: np.ndarray, lead: np.ndarray) -> None:
        order = np.argsort(h)
        self.h, self.h2, self.lead = h[order], h2[order], lead[order]

    def find(self, h: np.ndarray, h2: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Which hashes are hot, and the lead of each that is."""
        if not len(self.h):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        place = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        found = self.h[place] == h
        if h2 is not None:
            found &= self.h2[place] == h2
        return found, self.lead[place]


#: One in SAMPLED texts is looked at for hot hashes; hot are those in OFTEN of its rows, and in more than one in SHARE.
SAMPLED, OFTEN, SHARE = 64, 32, 50_000
_NONE = _Hot(*(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64)))


def _hot(rows: DataFrame) -> _Hot:
    """The hot hashes of rows (h, key, note, h2) of a sample: under SHARE of them. They only spare counting; what is
    repeated is the same without them."""
    counted = rows.groupBy("h", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lead"))
    counted = cut(counted, "sample")
    total = counted.agg(F.sum("n")).first()[0] or 0
    found = counted.where(F.col("n") >= max(OFTEN, total // SHARE)).toArrow()
    h, h2, lead = (found.column(c).to_numpy().astype(np.int64) for c in ("h", "h2", "lead"))
    return _Hot(h.view(np.uint64), h2.view(np.uint64), lead)


def _sample(rows: DataFrame) -> DataFrame:
    return rows.where(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(SAMPLED)) == 0)


#: Places that stand for a whole text: a copy known from its slice, one to be counted, and the copy that speaks for all.
COPY, WHOLE, LEAD = (1 << 40) - 3, (1 << 40) - 2, (1 << 40) - 1


def _anchors(texts: DataFrame, window: int, period: int, hot: _Hot = _NONE) -> DataFrame:
    sent = texts.sparkSession.sparkContext.broadcast(hot)
    cover = np.zeros(period, bool)
    cover[list(COVERS[period])] = True
    length = window - period + 1

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, data, offsets in text_slices(batch.column("text")):
                start, end, row = word_spans(data, offsets)
                if not len(start):
                    continue
                count, begin = _rows_of(row, b - a)
                roll = _Rolling(data, start, end, 0)
                own = keys[a:b]
                # a whole text is one more anchor: copies known from this slice send nothing else
                long = np.flatnonzero(count >= window)
                if not len(long):
                    continue
                spans = (roll.sums[begin[long] + count[long]] - roll.sums[begin[long]]) * roll.back[begin[long]]
                whole = _mixed(spans ^ count[long].astype(np.uint64) * np.uint64(_ODD))
                raw = data.tobytes()  # the spans as they are written, so that no two texts are one by a hash of 64 bits
                written = np.array([xxhash.xxh64_intdigest(raw[x:y], 7) for x, y in zip(start[begin[long]].tolist(), end[begin[long] + count[long] - 1].tolist())], np.uint64)
                first, _ = _once(whole)
                known, lead = sent.value.find(whole, written)
                speaks = known & (own[long] == lead)
                at = np.where(known, np.where(speaks, LEAD, COPY), np.where(first, WHOLE, COPY))
                yield _emit(own[long], at, whole, written, np.zeros(len(long), bool), known)
                sends = np.zeros(b - a, bool)
                sends[long[np.where(known, speaks, first)]] = True
                position = np.arange(len(row)) - begin[row]
                take = np.flatnonzero(sends[row] & cover[position % period] & (position + length <= count[row]))
                if len(take):
                    hashes, none = roll.at(take, length), np.zeros(len(take), bool)
                    yield _emit(own[row[take]], position[take], hashes, np.zeros(len(take), np.uint64), none, sent.value.find(hashes)[0])

    return texts.mapInArrow(run, "h long, key long, note long, h2 long")


def _repeated_anchors(anchors: DataFrame) -> DataFrame:
    """(key, at): per row, the places of its repeated anchors; COPY or WHOLE for a copied text, LEAD for the copy that speaks for all."""
    same = Window.partitionBy("h", "h2")
    place = F.shiftright("note", 1)
    return (
        anchors.withColumn("n", F.count(F.lit(1)).over(same) + F.max(F.col("note").bitwiseAND(1)).over(same))
        .withColumn("lead", F.min(F.when(place == WHOLE, F.col("key"))).over(same))
        .where((F.col("n") > 1) | (F.col("note").bitwiseAND(1) == 1))
        .select("key", F.when((place == WHOLE) & (F.col("key") == F.col("lead")), F.lit(LEAD)).otherwise(place).alias("at"))
        .groupBy("key")
        .agg(F.collect_list("at").alias("at"))
    )


def _spread(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of a list column; null lists hold nothing."""
    lists = batch.column(name)
    row = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    return row.astype(np.int64), pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _windows(joined: DataFrame, window: int, period: int, hot: _Hot = _NONE) -> DataFrame:
    sent = joined.sparkSession.sparkContext.broadcast(hot)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            keys = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
            of, at = _spread(batch, "at")
            for a, b, data, offsets in text_slices(batch.column("text")):
                start, end, row = word_spans(data, offsets)
                if not len(start):
                    continue
                count, begin = _rows_of(row, b - a)
                here = (of >= a) & (of < b)
                which, where = of[here] - a, at[here]
                copied, speaks = np.zeros(b - a, bool), np.zeros(b - a, bool)
                copied[which[where >= COPY]] = True
                speaks[which[where == LEAD]] = True
                single = (where < COPY) & ~copied[which]
                which, where = which[single], where[single]
                steps = np.zeros(len(row) + 1, dtype=np.int32)
                low = np.maximum(where - period + 1, 0)
                high = np.minimum(where, count[which] - window)  # last start
                fine = high >= low
                np.add.at(steps, begin[which[fine]] + low[fine], 1)
                np.add.at(steps, begin[which[fine]] + high[fine] + 1, -1)
                position = np.arange(len(row)) - begin[row]
                wanted = (np.cumsum(steps[:-1]) > 0) | (speaks[row] & (position + window <= count[row]))
                take = np.flatnonzero(wanted)
                if not len(take):
                    continue
                h, h2 = (_Rolling(data, start, end, k).at(take, window) for k in (0, 1))
                yield _emit(keys[a:b][row[take]], position[take], h, h2, speaks[row[take]], sent.value.find(h, h2)[0])

    return joined.mapInArrow(run, "h long, key long, note long, h2 long")


def _repeated_windows(windows: DataFrame) -> DataFrame:
    same = Window.partitionBy("h", "h2")
    return (
        windows.withColumn("n", F.count(F.lit(1)).over(same) + F.max(F.col("note").bitwiseAND(1)).over(same))
        .where((F.col("n") > 1) | (F.col("note").bitwiseAND(1) == 1))
        .groupBy("key")
        .agg(F.collect_list(F.shiftright("note", 1).cast("int")).alias("starts"))
    )


def removed_repeats(docs: DataFrame, window: int = WINDOW, period: int = 21, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]): one row per row of docs.

    A word goes if some window of `window` consecutive words that covers it also starts anywhere else, in the same
    text or another; windows are judged on the input. A text whose copy is in the table goes whole if it holds a
    window. Null text has no words. Words are compared as they are. Rows that agree in doc_id and text are two rows;
    a null doc_id is an id like others. Other columns of docs are not read. No rows in: no rows out.
    """
    texts = docs.select(row_key(docs).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    # each step is written, so that its shuffle is gone before the next
    hot = _hot(_anchors(_sample(texts), window, period))
    repeated = cut(_repeated_anchors(_anchors(texts, window, period, hot)), "anchors")
    hot = _hot(_windows(_sample(texts).join(_sample(repeated).hint("shuffle_hash"), "key"), window, period))
    joined = texts.join(repeated.hint("shuffle_hash"), "key")
    repeated_windows = cut(_repeated_windows(_windows(joined, window, period, hot)), "windows")
    marks = repeated.select("key", F.array_max("at").alias("mark")).where(F.col("mark") >= COPY)
    final = texts.join(repeated_windows.hint("shuffle_hash"), "key", "left").join(marks.hint("shuffle_hash"), "key", "left")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            of, at = _spread(batch, "starts")
            whole = batch.column("mark").is_valid().to_numpy(zero_copy_only=False)
            for a, b, data, offsets in text_slices(batch.column("text")):
                start, end, row = word_spans(data, offsets)
                count, begin = _rows_of(row, b - a)
                here = (of >= a) & (of < b)
                steps = np.zeros(len(row) + 1, dtype=np.int32)
                first = begin[of[here] - a] + at[here]
                np.add.at(steps, first, 1)
                np.add.at(steps, first + window, -1)
                gone = (np.cumsum(steps[:-1]) > 0) | (whole[a:b][row] & (count[row] >= window))
                lost = np.bincount(row[gone], minlength=b - a)
                kept = np.flatnonzero(~gone)
                ends = np.searchsorted(row[kept], np.arange(b - a + 1))
                raw = data.tobytes()
                spans = list(zip(start[kept].tolist(), end[kept].tolist()))
                out = [b" ".join([raw[x:y] for x, y in spans[p:q]]) for p, q in zip(ends[:-1].tolist(), ends[1:].tolist())]
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(count.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in out], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    columns.append(pa.array([x.decode() for x in out], pa.string()))
                    names.append("kept_text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return final.mapInArrow(run, schema)
