"""Token ids of whole texts by the tokenizers library, at a speed that suits a corpus.

A byte-level BPE splits a text into pre-tokens before it merges anything, and a space before a visible character always
starts a pre-token. So a text can be cut there and each unit encoded on its own, with the same ids; units recur, and a
worker keeps the ids of those it has seen, and of their pre-tokens. The library's model therefore runs once per distinct
pre-token of a worker's texts, not once per occurrence. A text that holds the string of an added token is left to the
library as a whole, and so is every text if the tokenizer is of another kind than this byte-level BPE. The tests hold the
result against the library's own ``encode``.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import regex

UNIT_START = re.compile(r"(?= \S)")
#: Fixed value: the pre-token pattern of this byte-level BPE.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Units and pre-tokens kept per worker; a table starts anew beyond it. Bounds memory to some 300 MB.
KEPT = 600_000
#: Longer ones are encoded without being kept.
LONGEST_KEPT = 48


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=2)
def _encoder(path: str) -> UnitEncoder:
    return UnitEncoder(path)


def _byte_characters() -> dict[int, int]:
    """The character that stands for each byte in this vocabulary: itself if it is visible, else the next from 256."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(rest)}


class _Spaces(Exception):
    """A space of the text is followed by white space, or ends it."""


class _Words(dict):
    """The ids of words with the space before them, worked out when first asked for."""

    def __init__(self, code):
        super().__init__()
        self.code = code

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise _Spaces
        ids = self.code(f" {word}")
        if len(word) <= LONGEST_KEPT:
            self[word] = ids
        return ids


def splits_at_spaces(tokenizer) -> bool:
    """Whether a tokenizer is a byte-level BPE as above: no normalizer, the usual pre-tokens, no options of its model."""
    spec = json.loads(tokenizer.to_str())
    before, model = spec["pre_tokenizer"] or {}, spec["model"]
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    options = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    return plain and spec["normalizer"] is None and model["type"] == "BPE" and not any(model.get(o) for o in options)


class UnitEncoder:
    """Encodes texts to unsigned 32-bit ids by way of their units."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_units = splits_at_spaces(self.tokenizer)
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.characters = _byte_characters()
        self.words = _Words(self._unit)
        self.pieces: dict[str, bytes] = {}

    def _unit(self, unit: str) -> bytes:
        pieces = [unit] if unit[:1] == " " and unit[1:].isalpha() else PRE_TOKEN.findall(unit)
        out = []
        for p in pieces:
            ids = self.pieces.get(p)
            if ids is None:
                found = self.model.tokenize(p.encode("utf-8").decode("latin-1").translate(self.characters))
                ids = array("I", [t.id for t in found]).tobytes()
                if len(p) <= LONGEST_KEPT:
                    if len(self.pieces) >= KEPT:
                        self.pieces.clear()
                    self.pieces[p] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if not self.by_units or (self.added and self.added.search(text)):  # added tokens are found before a text is split
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self.words) >= KEPT:
            self.words.clear()
        first, *words = text.split(" ")
        try:
            return self._unit(first) + b"".join(map(self.words.__getitem__, words))
        except _Spaces:
            return b"".join(map(self._unit, UNIT_START.split(text)))


def vocabulary_size(path: str) -> int:
    """One more than the largest id of a tokenizer, added tokens included."""
    return max(_encoder(path).tokenizer.get_vocab(with_added_tokens=True).values()) + 1


def encoded(path: str, texts: Iterable[str | None], end_id: int | None = None) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit integers, ``end_id`` appended; a null text is empty."""
    end = b"" if end_id is None else array("I", [end_id]).tobytes()
    one = _encoder(path).encode
    for text in texts:
        yield one(text or "") + end


def encode(path: str, texts: Iterable[str | None], end_id: int | None = None) -> list[bytes]:
    return list(encoded(path, texts, end_id))
