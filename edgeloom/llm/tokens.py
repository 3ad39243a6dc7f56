"""Token ids by the tokenizers library, with a cache of short units.

A text whose words are parted by single blanks or line breaks is cut there. Byte-level BPE of the GPT-2
kind always starts a new pre-token at such a place, so the ids of the units, joined, are the ids of the
text. The library encodes each unit that the cache lacks: its model alone where a unit is letters and marks,
whose pre-tokens are plain, else the whole tokenizer. Other texts, and texts that hold the
string of a special token, are encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

#: Units that a worker's cache keeps; later ones are encoded anew for each batch, so memory is bounded.
CACHE_ENTRIES = 600_000

DEFAULT_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

#: Stands before a text's first unit, which has no blank before it; not printable, so no such text has it.
FIRST = "\x01"
#: Letters and a run of ASCII marks, maybe after a line break: each of the three is a pre-token of its own.
_SIMPLE = re.compile("(\n?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Gives a text's ids, without special tokens being added, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str = DEFAULT_TOKENIZER):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.specials = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.cache: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, pre_token: str) -> list[int]:
        if pre_token.isascii() and pre_token != "\n":  # printable characters stand for themselves
            mapped = self.letters[32] + pre_token[1:] if pre_token[0] == " " else pre_token
        else:
            mapped = pre_token.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(mapped)]

    def _unit(self, unit: str) -> bytes:
        """A unit begins with its line break, or with FIRST, or stands for a blank and itself."""
        if unit.isascii() and unit.isalpha():
            return array("I", [t.id for t in self.model.tokenize(self.letters[32] + unit)]).tobytes()
        if unit[0] == FIRST:
            return self._whole(unit[1:])
        simple = _SIMPLE.fullmatch(unit)
        if simple is None:
            return self._whole(unit if unit[0] == "\n" else f" {unit}")
        line, word, marks = simple.groups()
        ids = array("I", self._model(word if line else f" {word}")).tobytes()
        return (self._piece(line) if line else b"") + ids + (self._piece(marks) if marks else b"")

    def _piece(self, pre_token: str) -> bytes:
        """A line break or a run of marks; there are few different ones."""
        ids = self.pieces.get(pre_token)
        if ids is None:
            ids = array("I", self._model(pre_token)).tobytes()
            if len(self.pieces) < 10_000:
                self.pieces[pre_token] = ids
        return ids

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null has none."""
        flat = [text.replace("\n", " ") if text else "" for text in texts]
        # of all white space only the blank is printable
        even = [bool(x) and x.isprintable() and "  " not in x and x[0] != " " != x[-1] and not any(s in t for s in self.specials) for x, t in zip(flat, texts, strict=True)]
        cut = iter(self._cut([t for t, known in zip(texts, even, strict=True) if known]))
        return [next(cut) if known else self._whole(text) if text else b"" for text, known in zip(texts, even, strict=True)]

    def _cut(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that can be cut."""
        if not texts:
            return []
        column = pa.array([f"{FIRST}{t}" for t in texts], pa.large_string())
        lists = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        units = lists.values.dictionary_encode()
        cache, look, known = self.cache, self.cache.get, []
        for unit in units.dictionary.to_pylist():
            ids = look(unit)
            if ids is None:
                ids = self._unit(unit)
                if len(cache) < CACHE_ENTRIES:
                    cache[unit] = ids
            known.append(ids)
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        every = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(sizes)), np.frombuffer(b"".join(known), "<u4"))
        which = units.indices
        data = np.asarray(every.take(which).values).tobytes()
        ends = 4 * np.append(0, np.cumsum(sizes[np.asarray(which)]))[np.asarray(lists.offsets)]
        return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker and tokenizer file."""
    return Encoder(path)


def forget(path: str) -> None:
    """Empty the worker's cache of a tokenizer file's units."""
    encoder(path).cache.clear()


def in_bytes(texts: list[str | None], limit: int = 4_000_000):
    """Slices of about ``limit`` characters, as (first index, texts)."""
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text or "")
        if held >= limit:
            yield start, texts[start : i + 1]
            start, held = i + 1, 0
    if start < len(texts):
        yield start, texts[start:]
