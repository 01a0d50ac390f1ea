"""P1: the same or nearly the same records across splits, by winnowing.

Both sides are folded (one character form, lower case, letters and digits only) and collapsed to
distinct texts, so that copies cost nothing. Each text gives the rolling hashes of its k-grams;
of every `window` neighbours the smallest is selected, so any common run of window + k - 1
characters shares a selected hash. Selected hashes are joined across the sides, training rows of
hot hashes spread by their measured counts. The seeds of a pair of texts are chained: the longest
collinear chain is kept, and the pair is dropped unless the chain holds `seeds` of all hashes
selected in the evaluation text. The alignment starts from the chain: its seeds stand, and the gaps
between them and beyond its ends are aligned by their longest common subsequences. A pair counts
when twice the aligned characters make up `least` of both texts, or when the evaluation text is
covered to 95 % by a training text at most `longer` times as long (None: of any length).

Null, empty and purely punctuational texts pair with nothing. Repeated rows each pair. Texts
shorter than k pair by equality. Texts of any length are read whole. Empty tables give no pairs.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.llm.canon import canonical
from weftline.plans.runtime import cut, hot_keys, salted_join

_OUT = re.compile(r"[\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def fold(text: str | None) -> str | None:
    """Letters and digits of the one character form, in lower case; entities resolved."""
    return None if text is None else _OUT.sub("", canonical(html.unescape(text)).casefold().replace("ё", "е"))


@F.arrow_udf(StringType())
def fold_udf(texts: pa.Array) -> pa.Array:
    return pa.array([fold(x) for x in texts.to_pylist()], pa.string())


def winnowed(texts: list[str], k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Selected hashes of all texts at once: number of the text, hash, position."""
    gap = k + window
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + gap) - sizes
    codes = np.frombuffer("\0".join(["", *("\0" * (gap - 1) + t for t in texts), "\0" * (gap - 1)]).encode("utf-32-le"), np.uint32).astype(np.uint64)
    if not len(texts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (codes + np.uint64(1)) * _BASE
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes) - k + 1, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + mixed[j : len(codes) - k + 1 + j]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    inside = codes != 0
    run = np.cumsum(np.concatenate([[0], inside]))
    valid = run[k:] - run[:-k] == k
    h[~valid] = np.uint64(0xFFFFFFFFFFFFFFFF)
    views = np.lib.stride_tricks.sliding_window_view(h, window)
    at = np.unique(np.arange(len(views)) + (window - 1 - views[:, ::-1].argmin(1)))
    at = at[valid[at]]
    text = np.searchsorted(starts, at, "right") - 1
    hashes, places = h[at].view(np.int64), at - starts[text]
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        whole = np.array([hash_short(texts[i]) for i in short], np.int64)
        text, hashes, places = np.concatenate([text, short]), np.concatenate([hashes, whole]), np.concatenate([places, np.zeros(len(short), np.int64)])
    return text, hashes, places


def hash_short(text: str) -> int:
    x = 0
    for ch in text:
        x = (x * 1099511628211 + ord(ch) + 1) & 0x7FFFFFFFFFFFFFFF
    return x


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest collinear chain of seeds (place in one text, place in the other), both places rising."""
    # of seeds at one place the later partner comes first, so that a chain takes one of them
    seeds = sorted(seeds, key=lambda x: (x[0], -x[1]))
    back, tails, ends = [-1] * len(seeds), [], []
    for i, (_, b) in enumerate(seeds):
        j = bisect_left(ends, b)
        back[i] = tails[j - 1] if j else -1
        if j == len(ends):
            ends.append(b)
            tails.append(i)
        else:
            ends[j], tails[j] = b, i
    out, i = [], tails[-1] if tails else -1
    while i >= 0:
        out.append(seeds[i])
        i = back[i]
    return out[::-1]


def extended(e: str, t: str, links: list[tuple[int, int]], k: int) -> tuple[int, int]:
    """Characters aligned by a chain of seeds of `k` characters and by extension into its gaps and beyond its ends, and those of the seeds alone."""
    total = seeded = at_e = at_t = 0
    for a, b in links:
        # seeds that overlap in one text but not alike in the other leave a gap in one only
        skip = max(0, at_e - a, at_t - b)
        if skip >= k:
            continue
        total += aligned(e[at_e : a + skip], t[at_t : b + skip])
        size = min(k - skip, len(e) - a - skip, len(t) - b - skip)
        total, seeded = total + size, seeded + size
        at_e, at_t = a + skip + size, b + skip + size
    return total + aligned(e[at_e:], t[at_t:]), seeded


def aligned(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & where.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def fingerprints(texts: DataFrame, name: str, k: int, window: int) -> DataFrame:
    """(id, h, pos) of a table (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            t, h, p = winnowed(b.column(1).to_pylist(), k, window)
            yield pa.RecordBatch.from_arrays([pa.array(ids[t], b.schema.field(0).type), pa.array(h), pa.array(p.astype(np.int32))], [name, "h", f"pos_{name}"])

    kind = dict(texts.dtypes)["id"]
    return texts.select("id", "text").mapInArrow(run, f"{name} {kind}, h long, pos_{name} int")


#: Hashes of the evaluation side that are broadcast at most: 8 MB.
BROADCAST_HASHES = 1_000_000


def overlaps(train: DataFrame, train_id: str, train_text: str, evals: DataFrame, eval_id: str, eval_text: str, k: int = 5, window: int = 4, least: float = 0.8, longer: float | None = 1.5, seeds: float = 0.1) -> DataFrame:
    """(train_id, eval_id, similarity, coverage, chained) for every pair of rows that overlap.

    `coverage` is the aligned share of the evaluation text, `chained` the share covered by the chain's seeds alone.
    """
    t = cut(train.select(F.col(train_id).alias("id"), fold_udf(F.col(train_text)).alias("text")).filter("length(text) > 0").withColumn("m", F.md5("text")))
    e = cut(evals.select(F.col(eval_id).alias("id"), fold_udf(F.col(eval_text)).alias("text")).filter("length(text) > 0").withColumn("m", F.md5("text")))
    texts = cut(t.groupBy("m").agg(F.min("id").alias("id"), F.first("text").alias("text"), F.count("*").alias("n")))
    sides = cut(e.groupBy("m").agg(F.min("id").alias("id"), F.first("text").alias("text")))
    right = cut(fingerprints(sides, "e", k, window))
    known = right.select("h").distinct()
    if known.count() <= BROADCAST_HASHES:
        known = F.broadcast(known)
    left = cut(fingerprints(texts, "t", k, window).join(known, "h", "left_semi"))
    hot = hot_keys(left.groupBy("h").agg(F.count("*").alias("n")), "h", "n")
    selected = right.groupBy("e").agg(F.count("*").alias("selected"))
    met = salted_join(left, right, "h", F.col("t"), hot).groupBy("t", "e").agg(F.collect_list(F.struct("pos_e", "pos_t")).alias("seeds")).join(selected, "e")
    met = met.filter(F.size("seeds") >= F.lit(seeds) * F.col("selected"))
    kinds = dict(t.dtypes)["id"], dict(e.dtypes)["id"]

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [chain([(x["pos_e"], x["pos_t"]) for x in s]) for s in batch.column(2).to_pylist()]
            keep = [i for i, (c, n) in enumerate(zip(links, batch.column(3).to_pylist())) if len(c) >= seeds * n]
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([[x for p in links[i] for x in p] for i in keep], pa.list_(pa.int32()))], ["t", "e", "links"])

    met = cut(met.select("t", "e", "seeds", "selected").mapInArrow(chained, f"t {kinds[0]}, e {kinds[1]}, links array<int>"))
    pairs = met.join(texts.select(F.col("id").alias("t"), F.col("text").alias("a")), "t")
    pairs = salted_join(pairs, sides.select(F.col("id").alias("e"), F.col("text").alias("b")), "e", F.col("t"), hot_keys(met.groupBy("e").agg(F.count("*").alias("n")), "e", "n"))
    la, lb = F.length("a"), F.length("b")
    # an alignment is no longer than the shorter text
    whole = la >= lb if longer is None else (la >= lb) & (la <= F.lit(longer) * lb)
    pairs = pairs.filter((2 * F.least(la, lb) >= F.lit(least) * (la + lb)) | whole)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ts, es, links, texts_a, texts_b = (batch.column(i).to_pylist() for i in range(5))
            rows = []
            for t_, e_, s, a, b in zip(ts, es, links, texts_a, texts_b):
                n, seeded = extended(b, a, list(zip(s[::2], s[1::2])), k)
                similar, cover = 2 * n / (len(a) + len(b)), n / len(b)
                if similar >= least or (cover >= 0.95 and len(b) <= len(a) and (longer is None or len(a) <= longer * len(b))):
                    rows.append((t_, e_, similar, cover, seeded / len(b)))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), pa.array(cols[1], batch.schema.field(1).type), *[pa.array(c, pa.float64()) for c in cols[2:]]], ["t", "e", "similarity", "coverage", "chained"])

    hits = cut(pairs.select("t", "e", "links", "a", "b").mapInArrow(align, f"t {kinds[0]}, e {kinds[1]}, similarity double, coverage double, chained double"))
    # back to rows: every copy of a training text, every copy of an evaluation text
    found = cut(hits.select("t").distinct().join(texts.select(F.col("id").alias("t"), "m", "n"), "t"))
    members = salted_join(t.select("id", "m"), found.select("m", "t"), "m", F.col("id"), hot_keys(found, "m", "n")).select(F.col("id").alias("train_id"), "t")
    both = salted_join(members, hits, "t", F.col("train_id"), hot_keys(found.select("t", "n"), "t", "n"))
    names = e.select("m", F.col("id").alias("eval_id")).join(sides.select("m", F.col("id").alias("e")), "m").select("e", "eval_id")
    matched = hits.join(found.select("t", "n"), "t").groupBy("e").agg(F.sum("n").alias("n"))
    return salted_join(both, names, "e", F.col("train_id"), hot_keys(matched, "e", "n")).select("train_id", "eval_id", "similarity", "coverage", "chained")


def records(pairs: DataFrame) -> DataFrame:
    """(train_id, n_evals, coverage) of overlaps(): for each training record how many evaluation records it overlaps and the most of one that it covers."""
    return pairs.groupBy("train_id").agg(F.count("*").alias("n_evals"), F.max("coverage").alias("coverage"))
