"""BPE encoding and decoding (operator 13): a pair occurrence index over the different pre-tokens of a partition.

The bytes of all different pre-tokens lie in one row of symbols with links to their neighbours. The index maps each
mergeable pair to its positions. Ranks that have positions are applied in ascending order, each to all of its positions
at once: a merge joins two symbols and puts the pairs it makes with its neighbours into the index. A position whose
symbols have changed since is passed over. Merges only make pairs of higher rank, which is checked when a vocabulary is
read, so this is the order of merges that each pre-token would see alone.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from tokenizers import Tokenizer

from contrastkit.llm.bpe import pre_tokens, segments

#: Bytes of text whose pre-tokens are indexed together, and different pre-tokens and pieces of texts that a task remembers.
INDEXED, REMEMBERED = 8 << 20, 800_000

#: Ranks below this, and below the number of symbols by _FEW, have many positions.
_FREQUENT, _FEW = 6000, 50
#: Spaces beside other white space, or in front.
_RUNS = re.compile(r"\s | \s|^ ")


class Vocabulary:
    """Ids, merges and added tokens of a byte-level BPE tokenizers file without normalizer, dropout or prefix space."""

    def __init__(self, path: str) -> None:
        spec = json.load(open(path, encoding="utf-8"))
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
        if model["type"] != "BPE" or spec["normalizer"] or model.get("dropout") or model.get("ignore_merges") or not plain:
            raise ValueError("not a plain byte-level BPE vocabulary")
        self.path = path
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves; others follow 255
        hidden = sorted(set(range(256)) - set(shown))
        sign = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        back = {c: b for b, c in sign.items()}
        vocab = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec["added_tokens"]):
            raise ValueError("added tokens that look at their surroundings")
        names = sorted(self.added, key=lambda x: (-len(x), x))
        self.parts = regex.compile("|".join(regex.escape(x) for x in names)) if names else None
        self.bytes = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for token, i in (vocab | self.added).items():
            self.bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        self.of_byte = np.array([vocab[sign[b]] for b in range(256)], dtype=np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left, self.right, self.made = ([vocab[f(m)] for m in merges] for f in (lambda m: m[0], lambda m: m[1], lambda m: m[0] + m[1]))
        self.rank = {(a << 32) | b: r for r, (a, b) in enumerate(zip(self.left, self.right))}
        self._keys = np.array(sorted(self.rank), dtype=np.int64)
        self._ranks = np.array([self.rank[k] for k in self._keys.tolist()], dtype=np.int64)
        last = {}
        for r, c in enumerate(self.made):
            last[c] = r
        if any(max(last.get(a, -1), last.get(b, -1)) >= r for r, (a, b) in enumerate(zip(self.left, self.right))):
            raise ValueError("a merge comes before what it joins")
        self._alike: dict[str, bool] = {}

    def ranks_of(self, pairs: np.ndarray) -> np.ndarray:
        """Ranks of pairs (left << 32) | right; -1 of those that do not merge."""
        at = np.minimum(np.searchsorted(self._keys, pairs), len(self._keys) - 1)
        return np.where(self._keys[at] == pairs, self._ranks[at], -1)

    @cached_property
    def _library(self):
        """The library's own rule for pre-tokens."""
        return Tokenizer.from_file(self.path).pre_tokenizer

    def _classed_alike(self, c: str) -> bool:
        """Whether the library takes a character for the same kind (letter, number, other sign or white space)."""
        ours = [len(pre_tokens().findall(x + c)) for x in "a1!"]
        return ours == [len(self._library.pre_tokenize_str(x + c)) for x in "a1!"]

    def _alike_in(self, text: str) -> bool:
        found = set(text)
        for c in found.difference(self._alike):
            self._alike[c] = self._classed_alike(c)
        return all(map(self._alike.__getitem__, found))

    def split(self, text: str) -> list[str]:
        """The pre-tokens of a text without added tokens."""
        if self._alike_in(text):
            return [w for part in segments(text) for w in pre_tokens().findall(part)]
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def chunks(self, text: str) -> Iterator[tuple[bool, list[str]]]:
        """The text in pieces that no pre-token crosses: (False, pieces), or (True, pieces) where each but the first has lost
        the space before it. Single spaces part; added tokens are pieces of their own."""
        at = 0
        for found in self.parts.finditer(text) if self.parts else ():
            if found.start() > at:
                yield self._spaced(text[at : found.start()])
            yield False, [found[0]]
            at = found.end()
        if at < len(text):
            yield self._spaced(text[at:])

    def _spaced(self, text: str) -> tuple[bool, list[str]]:
        if not self._alike_in(text):
            return False, [text]
        pieces = text.split(" ")
        if not _RUNS.search(text):
            return True, pieces
        out = [pieces[0]]
        for p in pieces[1:]:
            last = out[-1]
            if not last or not p or last[-1].isspace() or p[0].isspace():
                out[-1] = f"{last} {p}"
            else:
                out.append(p)
        return True, out

    def words(self, chunk: str) -> list[str | tuple[int]]:
        """The pre-tokens of a piece; (id,) if it is an added token."""
        return [(self.added[chunk],)] if chunk in self.added else self.split(chunk)


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _pairs_in_order(own: Vocabulary, sym: np.ndarray, ahead: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(rank, positions) of the mergeable pairs that begin at some places."""
    ranks = own.ranks_of((sym[places] << 32) | sym[ahead[places]])
    places, ranks = places[ranks >= 0], ranks[ranks >= 0]
    order = np.argsort(ranks, kind="stable")
    active, first = np.unique(ranks[order], return_index=True)
    yield from zip(active.tolist(), np.split(places[order], first[1:]) if len(active) else ())


def merged(own: Vocabulary, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): the ids of each word, one word behind another.

    The first ranks have many positions each, which are merged together in numpy; from a rank on that depends on the
    number of symbols, positions are merged one by one.
    """
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    sym = own.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
    total = len(sym)
    ahead, behind = np.arange(1, total + 1), np.arange(-1, total - 1)
    ahead[starts[1:][sizes > 0] - 1] = -1
    behind[starts[:-1][sizes > 0]] = -1
    index: dict[int, list] = {}
    heap: list[int] = []

    def note(rank: int, places: np.ndarray) -> None:
        if rank not in index:
            index[rank] = []
            heapq.heappush(heap, rank)
        index[rank].append(places)

    for found in _pairs_in_order(own, sym, ahead, np.flatnonzero(ahead >= 0)):
        note(*found)
    while heap and heap[0] < min(_FREQUENT, total // _FEW):
        r = heapq.heappop(heap)
        a, b, c = own.left[r], own.right[r], own.made[r]
        p = np.unique(np.concatenate(index.pop(r)))
        p = p[(sym[p] == a) & (ahead[p] >= 0)]
        p = p[sym[ahead[p]] == b]
        if a == b and len(p):  # of a run of equal symbols the first two are joined first
            begins = np.concatenate([[True], ahead[p[:-1]] != p[1:]])
            place = np.arange(len(p))
            p = p[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
        q = ahead[p]
        n = ahead[q]
        sym[p], sym[q], ahead[p] = c, -1, n
        behind[n[n >= 0]] = p[n >= 0]
        m = behind[p]
        for found in _pairs_in_order(own, sym, ahead, np.concatenate([m[m >= 0], p[n >= 0]])):
            note(*found)
    rank = own.rank.get
    index = {r: np.concatenate(places).tolist() for r, places in index.items()}
    sym, ahead, behind = (array("q", x.tobytes()) for x in (sym, ahead, behind))
    while heap:
        r = heapq.heappop(heap)
        places, a, b, c = index.pop(r), own.left[r], own.right[r], own.made[r]
        if a == b:
            places.sort()
        for p in places:
            q = ahead[p]
            if q < 0 or sym[p] != a or sym[q] != b:
                continue
            sym[p], sym[q] = c, -1
            n = ahead[p] = ahead[q]
            if n >= 0:
                behind[n] = p
                new = rank((c << 32) | sym[n])
                if new is not None:
                    if new in index:
                        index[new].append(p)
                    else:
                        index[new] = [p]
                        heapq.heappush(heap, new)
            m = behind[p]
            if m >= 0:
                new = rank((sym[m] << 32) | c)
                if new is not None:
                    if new in index:
                        index[new].append(m)
                    else:
                        index[new] = [m]
                        heapq.heappush(heap, new)
    ids = np.array(sym, dtype=np.int64)
    left = ids >= 0
    return ids[left].astype(np.int32), np.concatenate([[0], np.cumsum(left)])[starts]


class _Numbered(dict):
    """Numbers by key, from 0; keys that are new are listed."""

    def __init__(self) -> None:
        self.fresh: list = []

    def __missing__(self, key) -> int:
        self.fresh.append(key)
        self[key] = k = len(self)
        return k


class _Lists:
    """Lists of whole numbers, one behind another."""

    def __init__(self) -> None:
        self.flat, self.offsets = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def add(self, flat: np.ndarray, offsets: np.ndarray) -> None:
        self.offsets = np.concatenate([self.offsets, offsets[1:] + len(self.flat)])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers, one behind another, and the length of each."""
        first, n = self.offsets[numbers], self.offsets[numbers + 1] - self.offsets[numbers]
        return self.flat[np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], n


class _Known:
    """What a task has met: pieces of texts, the pre-tokens in them, and the ids of both. A piece is known by what follows
    its space, or by (text,) if it has none."""

    def __init__(self, own: Vocabulary) -> None:
        self.own, self.pieces, self.words = own, _Numbered(), _Numbered()
        self.piece_ids, self.word_ids = _Lists(), _Lists()

    def numbers(self, text: str) -> np.ndarray:
        out: list[int] = []
        number = self.pieces.__getitem__
        for spaced, pieces in self.own.chunks(text):
            if spaced:
                if pieces[0]:
                    out.append(number((pieces[0],)))
                out.extend(map(number, pieces[1:]))
            else:
                out.extend(number((p,)) for p in pieces)
        return np.array(out, dtype=np.int64)

    def settle(self) -> None:
        """Encode what has been met since the last time: the new pre-tokens of new pieces."""
        simple = np.array([isinstance(p, str) and p != "" and not (p[0].isspace() or p[-1].isspace()) for p in self.pieces.fresh], dtype=bool)
        plain, other = ([p for p, x in zip(self.pieces.fresh, simple.tolist()) if x is kind] for kind in (True, False))
        # those that neither begin nor end with white space are split as one text, where they stay apart
        tokens = [w for part in segments(" " + " ".join(plain)) for w in pre_tokens().findall(part)] if plain else []
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)))
        at = np.searchsorted(ends, np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)) + 1)) + 1
        last = []
        for p in other:
            tokens.extend(self.own.words(p[0] if isinstance(p, tuple) else f" {p}"))
            last.append(len(tokens))
        at = np.concatenate([[0], at, last]).astype(np.int64)
        numbers = np.array(list(map(self.words.__getitem__, tokens)), dtype=np.int64)
        fresh = self.words.fresh
        ids, offsets = merged(self.own, [w.encode() if isinstance(w, str) else b"" for w in fresh])
        if any(isinstance(w, tuple) for w in fresh):
            each = [np.array(w, np.int32) if isinstance(w, tuple) else ids[a:b] for w, a, b in zip(fresh, offsets[:-1], offsets[1:])]
            ids, offsets = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
        self.word_ids.add(ids, offsets)
        flat, n = self.word_ids.of(numbers)
        made = _Lists()
        made.add(flat, np.concatenate([[0], np.cumsum(n)])[at])
        flat, n = made.of(np.argsort(np.argsort(~simple, kind="stable")))  # back in the order of their numbers
        self.piece_ids.add(flat, np.concatenate([[0], np.cumsum(n)]))
        self.pieces.fresh, self.words.fresh = [], []

    def lists(self, texts: list[np.ndarray]) -> pa.ListArray:
        """The ids of texts given by the numbers of their pieces."""
        found = [self.piece_ids.of(numbers)[0] for numbers in texts]
        at = np.concatenate([[0], np.cumsum([len(x) for x in found])])
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *found]), pa.int32()))


def _with(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n.lower() != name.lower()]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), column], names=[*keep, name])


def _schema(df: DataFrame, field: StructField) -> StructType:
    return StructType([*[f for f in df.schema.fields if f.name.lower() != field.name.lower()], field])


def encoded(docs: DataFrame, tokenizer: str, text: str = "text", into: str = "token_ids") -> DataFrame:
    """docs with a column of token ids, those that the tokenizers library gives without added special tokens, truncation
    or padding. Text that is null or empty has none. Special tokens written out in a text are those tokens.

    tokenizer: path of a byte-level BPE file of that library. A column of docs called as `into` is replaced; others stay.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = _Known(vocabulary(tokenizer)), [], 0

        def settled() -> Iterator[pa.RecordBatch]:
            nonlocal known
            known.settle()
            for batch, texts in held:
                yield _with(batch, into, known.lists(texts))
            held.clear()
            if len(known.pieces) + len(known.words) > REMEMBERED:
                known = _Known(vocabulary(tokenizer))

        for whole in rows:
            first = 0
            sizes = np.cumsum([0, *(0 if x is None else x for x in pc.binary_length(whole.column(text)).to_pylist())])
            while first < whole.num_rows:  # an index spans INDEXED bytes, or one longer text
                end = max(first + 1, int(np.searchsorted(sizes, sizes[first] + INDEXED - size, side="right")) - 1)
                batch = whole.slice(first, end - first)
                held.append((batch, [known.numbers(x or "") for x in batch.column(text).to_pylist()]))
                size += int(sizes[end] - sizes[first])
                first = end
                if size >= INDEXED or first < whole.num_rows:
                    yield from settled()
                    size = 0
        yield from settled()

    return docs.mapInArrow(run, _schema(docs, StructField(into, ArrayType(IntegerType()))))


def decoded(rows: DataFrame, tokenizer: str, ids: str = "token_ids", into: str = "decoded") -> DataFrame:
    """rows with the text of a column of token ids, special tokens included. Bytes that are no UTF-8 become U+FFFD, null
    ids and ids that the vocabulary lacks are left out, null lists are null. A column called as `into` is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary(tokenizer).bytes
        n = len(table)
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                batch = whole.slice(first, 256)
                made = []
                for own in batch.column(ids):
                    found = own.values
                    if found is None:
                        made.append(None)
                        continue
                    numbers = found.drop_null().to_numpy(zero_copy_only=False)
                    numbers = numbers[(numbers >= 0) & (numbers < n)]
                    made.append(b"".join(map(table.__getitem__, numbers.tolist())).decode("utf-8", "replace"))
                yield _with(batch, into, pa.array(made, pa.string()))

    return rows.mapInArrow(run, _schema(rows, StructField(into, StringType())))
