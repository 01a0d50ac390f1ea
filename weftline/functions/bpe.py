"""Byte-pair encoding by the ranks of a public vocabulary: pieces, merges, decoding.

The vocabulary file is a parameter; it is read once a process and not part of this repository.
"""

from __future__ import annotations

import base64
import os
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

VOCABULARY = os.environ.get("WEFTLINE_BPE", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
# Fixed value: how a text is cut into pieces before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_signs() -> dict[int, str]:
    """A printable sign for each byte: its own character if that is printable, else the next one from code point 256 on."""
    own = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
    free = iter(range(256, 512))
    return {b: chr(b if b in own else next(free)) for b in range(256)}


class Merges:
    """Ranks of byte strings: a smaller rank is merged first."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        self.bytes = {i: x for x, i in self.rank.items()}
        self.cut = regex.compile(PIECES)
        self.known: dict[str, list[int]] = {}

    def piece(self, data: bytes) -> list[int]:
        """Merge the neighbours of the lowest rank, the leftmost of equal ones, until none has a rank."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b) for a, b in zip(parts, parts[1:])]
            least = min((r for r in ranks if r is not None), default=None)
            if least is None:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.cut.findall(unicodedata.normalize("NFC", text)):
            if (ids := self.known.get(p)) is None:
                if len(self.known) > 200_000:
                    self.known.clear()
                ids = self.known[p] = self.piece(p.encode())
            out.extend(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of token ids; unknown ids give nothing, broken sequences the replacement character."""
        return b"".join(self.bytes.get(i, b"") for i in ids).decode("utf-8", "replace")


_read: dict[str, Merges] = {}


def merges(path: str = VOCABULARY) -> Merges:
    if path not in _read:
        _read[path] = Merges(path)
    return _read[path]


def encode(text: Column, path: str = VOCABULARY) -> Column:
    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        m = merges(path)
        return pa.array([None if x is None else m.encode(x) for x in texts.to_pylist()], pa.list_(pa.int32()))

    return run(text)


def decode(ids: Column, path: str = VOCABULARY) -> Column:
    @F.arrow_udf("string")
    def run(rows: pa.Array) -> pa.Array:
        m = merges(path)
        return pa.array([None if x is None else m.decode(x) for x in rows.to_pylist()], pa.string())

    return run(ids)


def library_encode(text: Column, path: str = VOCABULARY) -> Column:
    """The same ids by a tokenizer library, to compare with."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        lib = _library(path)
        return pa.array([None if x is None else lib.encode_ordinary(unicodedata.normalize("NFC", x)) for x in texts.to_pylist()], pa.list_(pa.int32()))

    return run(text)


@lru_cache(maxsize=4)
def _library(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=merges(path).rank, special_tokens={})
