"""Token ids of a public byte-level BPE vocabulary, read from a tokenizers file whose path is a parameter."""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache

import regex
import tiktoken
from tokenizers import Tokenizer

#: Text of the vocabulary's one special token (a fixed value).
SPECIAL = "<|endoftext|>"
#: The vocabulary's rule for pre-tokens (a fixed value of the format).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space by the Unicode property, which the rule's \s stands for; Python's \s has four characters more.
_SPACE = r"\t-\r \x85\xa0  -     　"
#: Characters that all Unicode versions class alike; other texts take the slower library.
_COMMON = regex.compile(r"[\x00-ɏ‐-‧‰-⁞€]*+")
#: Characters encoded at once; longer texts are cut where pre-tokens part.
_SEGMENT = 1 << 20


@lru_cache(1)
def pre_tokens() -> regex.Pattern:
    """The rule as a Python pattern."""
    rule = PRE_TOKEN.replace(r"[^\s\p{L}\p{N}]", rf"[^{_SPACE}\p{{L}}\p{{N}}]")
    return regex.compile(rule.replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))


@lru_cache(4)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@lru_cache(4)
def _byte_pairs(path: str):
    """The vocabulary's ids as merge ranks."""
    vocab = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves
    other = [b for b in range(256) if b not in set(shown)]
    back = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(other)}
    ranks = {bytes(back[c] for c in word): rank for word, rank in vocab.items() if word != SPECIAL}
    return tiktoken.Encoding("own", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})


def segments(text: str, size: int = _SEGMENT) -> Iterator[str]:
    """The text in parts of about size characters, cut before a single space between other characters."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        while cut > 0 and (text[cut - 1].isspace() or text[cut + 1 : cut + 2].isspace() or cut + 1 == len(text)):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_ids(path: str, text: str) -> array:
    """The ids that the tokenizers library gives without added special tokens, as unsigned 32-bit integers."""
    out = array("I")
    plain = SPECIAL not in text and _COMMON.fullmatch(text) is not None
    for part in segments(text) if plain else [text]:
        out.extend(_byte_pairs(path).encode_ordinary(part) if plain else _tokenizer(path).encode(part, add_special_tokens=False).ids)
    return out
