"""Functions that have no built-in form, as Arrow UDFs over whole batches."""

from __future__ import annotations

import hashlib
import html
import unicodedata
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType

from weftline.functions import text as T


@F.arrow_udf(StringType())
def nfkc_unescape(texts: pa.Array) -> pa.Array:
    """Entities resolved, compatibility forms composed."""
    return pa.array([None if x is None else unicodedata.normalize("NFKC", html.unescape(x)) for x in texts.to_pylist()], pa.string())


def clean_text(text: Column) -> Column:
    """The full cleaning: entities and forms, then the built-in rules; null when empty or deleted."""
    return T.clean(nfkc_unescape(text))


def blake2_bucket(buckets: int):
    @F.arrow_udf(LongType())
    def bucket(keys: pa.Array) -> pa.Array:
        digest = lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
        return pa.array([None if x is None else digest(x) % buckets for x in keys.to_pylist()], pa.int64())

    return bucket


@F.arrow_udf(StringType())
def blake2_id(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else hashlib.blake2b(x.encode(), digest_size=16).hexdigest() for x in texts.to_pylist()], pa.string())


@F.arrow_udf(DoubleType())
def similarity(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp ratio of two texts, the first as the pattern."""
    pairs = zip(a.to_pylist(), b.to_pylist())
    return pa.array([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in pairs], pa.float64())


@F.arrow_udf(IntegerType())
def longest_run(a: pa.Array, b: pa.Array) -> pa.Array:
    """Length of the longest run of neighbouring items that two lists share."""

    def one(x: list, y: list) -> int:
        best, last = 0, {}
        at: dict = {}
        for j, w in enumerate(y):
            at.setdefault(w, []).append(j)
        for w in x:
            now = {}
            for j in at.get(w, ()):
                now[j] = n = last.get(j - 1, 0) + 1
                best = max(best, n)
            last = now
        return best

    return pa.array([None if x is None or y is None else one(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def prompt_copy(prompt: Column, response: Column, words: int = 5, run: int = 5, share: float = 0.8) -> Column:
    """Whether a response copies its prompt: equal, begins with it (two words or more), or shares a long run of its words."""
    p = T.words(prompt)
    n = F.size(p)
    longest = longest_run(p, T.words(response))
    return T.exact_echo(prompt, response) | (T.prefix_echo(prompt, response) & (n >= 2)) | ((n >= words) & (longest >= run) & (longest / F.greatest(n, F.lit(1)) >= share))
