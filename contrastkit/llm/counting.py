"""Token counts (operator 5): a segment tree per document, updated by edits without encoding the document again.

A leaf is a run of whole pre-tokens. Leaves part only where white space follows another character, or where a letter,
a digit and another sign meet and neither is part of a sign that the vocabulary's rules look across: no pre-token crosses
such a place, whatever stands further off, so the counts of leaves add up to the document's. An edit touches the leaves
of the characters before and behind it; what they hold after the edit goes into the first of them, is encoded, and the
sums on its path to the root are updated. A leaf that has grown past twice its size is parted anew, and only its own
text is encoded for that.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from contrastkit.llm.bpe import token_ids
from contrastkit.llm.common import cut

LEAF_CHARS = 256
EDITS = "array<struct<at: long, removed: long, inserted: string>>"
_TREE = "struct<chars: array<long>, tokens: array<long>>"


#: Where leaves may part. Apostrophes begin contractions, and <, | and > are in the special token.
_PARTS = regex.compile(
    r"(?<=\S)(?= )|(?<=\p{L})(?=[^\s\p{L}'<|>])|(?<=\p{N})(?=[^\s\p{N}'<|>])|(?<=[^\s\p{L}\p{N}'<|>])(?=[\p{L}\p{N}])"
)


def leaves_of(text: str, size: int) -> list[str]:
    """The text in leaves of size characters or a little more. A run of letters is never parted, however long."""
    out, at = [], 0
    while len(text) - at > size:
        place = _PARTS.search(text, at + size)
        if place is None or place.start() >= len(text):
            break
        out.append(text[at : place.start()])
        at = place.start()
    out.append(text[at:])
    return out


class TokenTree:
    """Sums of characters and tokens in heap order: node k has children 2k and 2k + 1, and leaves come last."""

    def __init__(self, chars: list[int], tokens: list[int]) -> None:
        self.chars, self.tokens, self.width = chars, tokens, len(chars) // 2

    @classmethod
    def build(cls, path: str, text: str, size: int) -> TokenTree:
        leaves = leaves_of(text, size)
        return cls.of([len(x) for x in leaves], [len(token_ids(path, x)) for x in leaves])

    @classmethod
    def of(cls, chars: list[int], tokens: list[int]) -> TokenTree:
        """The tree over leaves of these sizes."""
        width = 1 << max(0, len(chars) - 1).bit_length()
        rest = [0] * (width - len(chars))
        chars, tokens = [0] * width + chars + rest, [0] * width + tokens + rest
        for k in range(width - 1, 0, -1):
            chars[k], tokens[k] = chars[2 * k] + chars[2 * k + 1], tokens[2 * k] + tokens[2 * k + 1]
        return cls(chars, tokens)

    def part(self, leaf: int, sizes: list[tuple[int, int]]) -> None:
        """Put leaves of these (characters, tokens) in the place of one."""
        every = [(c, t) for c, t in zip(self.chars[self.width :], self.tokens[self.width :])]
        place = leaf - self.width
        kept = [x for x in every[:place] if x[0]] + sizes + [x for x in every[place + 1 :] if x[0]]
        new = TokenTree.of([c for c, _ in kept] or [0], [t for _, t in kept] or [0])
        self.chars, self.tokens, self.width = new.chars, new.tokens, new.width

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character at (the last that holds any, if at is the end), and its first character."""
        node, first = 1, 0
        at = min(at, self.chars[1] - 1) if self.chars[1] else 0
        while node < self.width:
            node *= 2
            if at >= first + self.chars[node] and self.chars[node + 1]:
                first += self.chars[node]
                node += 1
        return node, first

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        more_chars, more_tokens = chars - self.chars[leaf], tokens - self.tokens[leaf]
        while leaf:
            self.chars[leaf] += more_chars
            self.tokens[leaf] += more_tokens
            leaf //= 2

    def edit(self, path: str, text: str, at: int, removed: int, inserted: str, size: int = LEAF_CHARS) -> tuple[str, int]:
        """The text after the edit, and how many characters were encoded for it."""
        at = min(max(at, 0), len(text))
        removed = min(max(removed, 0), len(text) - at)
        left, first = self.find(max(at - 1, 0))
        right, begin = self.find(at + removed)
        end = begin + self.chars[right]
        region = text[first:at] + inserted + text[at + removed : end]
        leaves = leaves_of(region, size) if len(region) > 2 * size else [region]
        sizes = [(len(x), len(token_ids(path, x))) for x in leaves]
        self.put(left, len(region), sum(t for _, t in sizes))
        for leaf in range(left + 1, right + 1):
            if self.chars[leaf]:
                self.put(leaf, 0, 0)
        if len(sizes) > 1:
            self.part(left, sizes)
        return text[:first] + region + text[end:], len(region)


def _mapped(df: DataFrame, more: str, make: Callable[[pa.RecordBatch], dict[str, pa.Array]]) -> DataFrame:
    """df's columns with those of the schema `more` added or replaced by what make gives for each batch."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            made = make(batch)
            names = [n for n in batch.schema.names if n not in made]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *made.values()], names=[*names, *made])

    new = StructType.fromDDL(more)
    return df.mapInArrow(run, StructType([f for f in df.schema.fields if f.name not in new.names] + new.fields))


_TREE_ARROW = pa.struct([("chars", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])


def token_trees(docs: DataFrame, tokenizer: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """docs with n_tokens and tree, the sums of a document's segment tree. Null text counts as empty: no token.

    Columns of docs by those names are replaced; all others stay as they are. Rows count each for itself, whatever their
    doc_id. No rows in: no rows out.
    """

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        trees = [TokenTree.build(tokenizer, x or "", leaf_chars) for x in batch.column("text").to_pylist()]
        return {
            "n_tokens": pa.array([t.tokens[1] for t in trees], pa.int64()),
            "tree": pa.array([{"chars": t.chars, "tokens": t.tokens} for t in trees], _TREE_ARROW),
        }

    return _mapped(docs, f"n_tokens long, tree {_TREE}", make)


def edited(trees: DataFrame, tokenizer: str, edits: str = "edits", leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """trees after the edits in a column of type EDITS: text, tree and n_tokens are those behind the last edit.

    A document's edits apply in order; at counts characters of the text as it then is, and is taken to the nearest end
    if it lies outside; null numbers are 0 and null insertions empty. No edits leave a row as it is. encoded_chars is
    how many characters were encoded. No rows in: no rows out.
    """

    def make(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts, counts, kept, encoded = [], [], [], []
        for text, tree, changes in zip(*(batch.column(n).to_pylist() for n in ("text", "tree", edits))):
            own, done = TokenTree(tree["chars"], tree["tokens"]), 0
            for x in changes or ():
                text, n = own.edit(tokenizer, text or "", x["at"] or 0, x["removed"] or 0, x["inserted"] or "", leaf_chars)
                done += n
            texts.append(text)
            counts.append(own.tokens[1])
            kept.append({"chars": own.chars, "tokens": own.tokens})
            encoded.append(done)
        return {
            "text": pa.array(texts, pa.string()),
            "n_tokens": pa.array(counts, pa.int64()),
            "tree": pa.array(kept, _TREE_ARROW),
            "encoded_chars": pa.array(encoded, pa.int64()),
        }

    return _mapped(trees, f"text string, n_tokens long, tree {_TREE}, encoded_chars long", make)


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """trees with the column edits, gathered from a table (doc_id, seq, at, removed, inserted) in the order of seq.

    Edits of documents that are not there, or of null doc_id, have no effect; a document without edits has null.
    """
    own = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "at", "removed", "inserted"))).alias("edits"))
    own = own.withColumn("edits", F.transform("edits", lambda x: F.struct(x["at"].cast("long").alias("at"), x["removed"].cast("long").alias("removed"), x["inserted"].alias("inserted"))))
    return trees.drop("edits").join(own, "doc_id", "left")


def stored(trees: DataFrame) -> DataFrame:
    """The trees as a table in the shared scratch folder, for later batches of edits."""
    return cut(trees, "trees")

