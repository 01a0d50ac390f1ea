"""P8: evaluation passages inside corpus documents, found by latent semantic retrieval.

Texts are read as words in one character form. Inverse document frequencies of the passages' words
are counted over all documents; other words count nowhere. The TF-IDF matrix of the passages' word windows is factored by a randomised SVD whose
products are sums over rows, taken in Spark; only matrices of vocabulary x rank, of a size set by
the evaluation material, come to the driver. Windows of every document are projected into the
latent space; a window whose cosine with one of a passage's windows reaches `near` makes the pair
a candidate, and so does a seed, a run of neighbouring words so short that every quote with at most
one odd word in seven has one whole (4 words for quotes of 12): common words among rare ones have
a low cosine at any corpus size. Around the candidate windows the words of both are then aligned: the pair counts when
at least `least` consecutive words of the passage stand there, with an odd word changed, lost or
added (and, where answers are given, is marked when the answer stands in the document too).

Windows overlap so that any run of `least` words lies whole in one window of either side.
Null or empty texts hold nothing and leak nothing; passages of fewer than `least` words count
nowhere. Repeated documents are each reported. Documents of any length are read whole. Empty
tables give no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.canon import canonical
from weftline.plans.runtime import cut

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")


def words_of(text: str | None) -> list[str]:
    """Words in one character form, lower case; entities resolved, tags left out."""
    if not text:
        return []
    if "&" in text or "<" in text:
        text = _TAG.sub(" ", html.unescape(text))
    return _WORD.findall(canonical(text).lower().replace("ё", "е"))


def _starts(n: int, width: int, step: int) -> range:
    return range(0, max(1, n - width + step), step)


def document_frequencies(docs: DataFrame, text: str, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all documents each word of the vocabulary stands, and the number of documents."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sums, n = shared.value, Counter(), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                n += 1
                sums.update(known.keys() & set(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *[known[w] for w in sums]], pa.int64()), pa.array([n, *sums.values()], pa.int64())], ["word", "n"])

    out, total = np.zeros(len(vocabulary)), 0
    for word, n in docs.select(text).mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect():  # a row for each word of the passages
        if word < 0:
            total = n
        else:
            out[word] = n
    return out, total


class Space:
    """The latent space: word vectors, and the windows of the passages in it."""

    def __init__(self, spark, passages: list[tuple], df: np.ndarray, n_docs: int, vocabulary: dict[str, int], width: int, step: int, rank: int, rounds: int = 2, seed: int = 5) -> None:
        self.vocabulary, self.width, self.step = vocabulary, width, step
        self.idf = (np.log((n_docs + 1) / (df + 0.5)) + 0.1).astype(np.float32)
        self.idf = np.maximum(self.idf, 0.1)
        self.ids = [p[0] for p in passages]
        self.words = [p[1] for p in passages]
        windows = [(i, w[s : s + width]) for i, w in enumerate(self.words) for s in _starts(len(w), width, step)]
        self.owner = np.array([i for i, _ in windows], np.int64)
        v = len(vocabulary)
        rows = [np.array([vocabulary[x] for x in w], np.int64) for _, w in windows]
        rank = max(1, min(rank, len(rows), v))
        basis = np.random.default_rng(seed).standard_normal((v, rank)).astype(np.float32)
        for _ in range(rounds + 1):
            # one round of subspace iteration: A^T (A basis), then an orthonormal basis of it
            basis = np.linalg.qr(_gram_product(spark, rows, self.idf, basis))[0].astype(np.float32)
        # rotate the basis to the singular vectors, largest first
        small = basis.T @ _gram_product(spark, rows, self.idf, basis)
        _, turn = np.linalg.eigh((small + small.T) / 2)
        self.vectors = (basis @ turn[:, ::-1].astype(np.float32)) * self.idf[:, None]
        latent = np.array([self.vectors[r].sum(0) for r in rows], np.float32).reshape(len(rows), rank)
        self.latent = latent / np.maximum(1e-9, np.linalg.norm(latent, axis=1, keepdims=True))


def _gram_product(spark, rows: list[np.ndarray], idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """A^T A basis for the unit-length TF-IDF rows, summed over partitions of rows."""
    shared = spark.sparkContext.broadcast((idf, basis))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, base = shared.value
        out = np.zeros(base.shape, np.float64)
        for b in batches:
            for r in b.column(0).to_pylist():
                at, n = np.unique(np.array(r, np.int64), return_counts=True)
                x = weights[at] * n
                x = x / np.linalg.norm(x)
                out[at] += np.outer(x, x @ base[at])
        used = np.flatnonzero(np.abs(out).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(list(out[used]), pa.list_(pa.float64()))], ["word", "row"])

    total = np.zeros(basis.shape, np.float64)
    zeros = F.array_repeat(F.lit(0.0), basis.shape[1])
    df = spark.createDataFrame([([int(x) for x in r],) for r in rows], "row array<long>").repartition(max(1, min(8, len(rows) // 500)))
    # a word has one partial row from each of at most eight partitions; their sums are the vocabulary's size
    parts = df.mapInArrow(part, "word long, row array<double>").groupBy("word").agg(F.aggregate(F.collect_list("row"), zeros, lambda s, x: F.zip_with(s, x, lambda a, b: a + b)).alias("row"))
    got = parts.toArrow()
    if got.num_rows:
        total[got.column("word").to_numpy()] = got.column("row").combine_chunks().flatten().to_numpy().reshape(got.num_rows, -1)
    shared.unpersist()
    return total.astype(np.float32)


def longest_quote(words: list[str], passage: list[str], least: int) -> int:
    """Words of the passage that the longest good local alignment spans: a match counts 1, a word with one slip 0.5, an odd word -1.5.

    Of the words spanned, at most one in seven may be odd, and one in any case. 0 if fewer than `least` words are spanned.
    """
    where: dict[str, list[int]] = {}
    for j, w in enumerate(passage):
        where.setdefault(w, []).append(j)
    m = len(passage)
    best = 0
    score, start, hits = [0.0] * (m + 1), list(range(m + 1)), [0] * (m + 1)
    for w in words:
        new, begin, count = [0.0] * (m + 1), list(range(m + 1)), [0] * (m + 1)
        same = where.get(w)
        if same is None and not any(score):
            continue
        for j in range(1, m + 1):
            # from the left: a word of the passage is lost; from above: one is added; across: kept or changed
            s, b, c = 0.0, j, 0
            if same and passage[j - 1] == w:
                s, b, c = score[j - 1] + 1, start[j - 1] if score[j - 1] > 0 else j - 1, hits[j - 1] + 1 if score[j - 1] > 0 else 1
            elif score[j - 1] > 1.5:
                near = alike(w, passage[j - 1])
                s, b, c = score[j - 1] + (0.5 if near else -1.5), start[j - 1], hits[j - 1] + near
            if score[j] - 1.5 > s:
                s, b, c = score[j] - 1.5, start[j], hits[j]
            if new[j - 1] - 1.5 > s:
                s, b, c = new[j - 1] - 1.5, begin[j - 1], count[j - 1]
            new[j], begin[j], count[j] = s, b, c
            # a span ends at a word that both have
            if same and passage[j - 1] == w and j - b >= least and s > 0 and j - b - c <= max(1, (j - b) // 7):
                best = max(best, j - b)
        score, start, hits = new, begin, count
    return best


def alike(a: str, b: str) -> bool:
    """One slip apart: a letter changed, lost, added or swapped with the next."""
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y or x == y[1:] or x[1:] == y[1:] or (x[2:] == y[2:] and x[:2] == y[1::-1])


#: Characters of passages that one space holds: their windows in 128 dimensions take some 20 bytes for each.
BLOCK_CHARS = 10_000_000


def build(docs: DataFrame, text: str, passages: DataFrame, passage_id: str, passage_text: str, width: int = 16, step: int = 4, rank: int = 128) -> Space:
    """Fit the space of at most BLOCK_CHARS characters of passages; found() takes any number of them, block by block."""
    size = passages.agg(F.coalesce(F.sum(F.length(passage_text)), F.lit(0))).first()[0]
    if size > 2 * BLOCK_CHARS:
        raise ValueError("too many passages for one space; found() takes them in blocks")
    kept = [(r[0], words_of(r[1])) for r in passages.select(passage_id, passage_text).orderBy(passage_id).collect()]
    kept = [p for p in kept if p[1]]
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in kept for w in ws}))}
    df, n = document_frequencies(docs, text, vocabulary)
    return Space(docs.sparkSession, kept, df, n, vocabulary, width, step, rank)


def found(docs: DataFrame, doc_id: str, text: str, passages: DataFrame, passage_id: str, passage_text: str, **options) -> DataFrame:
    """leaks() of any number of passages: blocks of about BLOCK_CHARS characters, dealt by a hash of the id, each with a space of its own.

    A pair of a document and a passage doesn't depend on other passages but for the latent space; of several blocks
    each is searched and written before the next one is broadcast.
    """
    size = passages.agg(F.coalesce(F.sum(F.length(passage_text)), F.lit(0))).first()[0]
    blocks = max(1, -(-size // BLOCK_CHARS))
    if blocks == 1:
        return leaks(docs, doc_id, text, build(docs, text, passages, passage_id, passage_text), **options)
    out = None
    for k in range(blocks):
        block = passages.filter(F.pmod(F.xxhash64(F.col(passage_id).cast("string")), F.lit(blocks)) == k)
        part = cut(leaks(docs, doc_id, text, build(docs, text, block, passage_id, passage_text), **options))
        out = part if out is None else out.union(part)
    return out


def seed_size(least: int) -> int:
    """Neighbouring words that any quote of `least` words or more, with at most one odd word in seven and one in any case, holds unbroken."""
    odd = lambda n: max(1, n // 7)
    return max(1, min(-(-(n - odd(n)) // (odd(n) + 1)) for n in range(least, least + 15)))


def _seed_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for k in range(size):
        out = (out ^ (ids[k : k + len(out)].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class Seeds:
    """Hashes of the passages' runs of `size` words, sorted, with their passages (by number)."""

    def __init__(self, space: Space, least: int) -> None:
        self.size = seed_size(least)
        each = [np.unique(_seed_hashes(np.array([space.vocabulary[x] for x in w], np.int64), self.size)) for w in space.words]
        hashes = np.concatenate([np.zeros(0, np.uint64), *each])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owner = hashes[order], np.repeat(np.arange(len(each)), [len(x) for x in each])[order]

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """(passage, place in the document) of each seed found; a hash that meets by chance is refuted by the alignment."""
        h = _seed_hashes(ids, self.size)
        outside = np.concatenate([[0], np.cumsum(ids < 0)])
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        for i in np.flatnonzero((high > low) & (outside[self.size :] == outside[: -self.size])) if len(h) else ():
            for j in range(low[i], high[i]):
                yield int(self.owner[j]), int(i)


def candidates(words: list[str], space: Space, near: float, least: int, seeds: Seeds) -> dict[int, list[int]]:
    """For each passage (by number) the starts of the document's windows that come near it, and the places of seeds."""
    ids = np.fromiter((space.vocabulary.get(w, -1) for w in words), np.int64, len(words))
    n, width = len(ids), space.width
    known = np.concatenate([[0], np.cumsum(ids >= 0)])
    starts = np.array(_starts(n, width, space.step))
    ends = np.minimum(starts + width, n)
    # a window with a quoted run holds that many words of the passages, save the odd ones
    starts = starts[known[ends] - known[starts] >= max(1, least - 4)]
    if not len(starts) or not len(space.owner):
        return {}
    out: dict[int, list[int]] = {}
    # sums of word vectors and of squared weights over any window, by differences of running sums
    known_ids = np.maximum(ids, 0)
    outside = ids < 0
    weight = np.where(outside, 0, space.idf[known_ids]) ** 2
    norms = np.concatenate([[0], np.cumsum(weight)])
    for at in range(0, len(starts), 512):
        part = starts[at : at + 512]
        low, high = int(part[0]), min(int(part[-1]) + width, n)
        rows = space.vectors[known_ids[low:high]]
        rows[outside[low:high]] = 0
        sums = np.concatenate([np.zeros((1, rows.shape[1]), np.float32), np.cumsum(rows, axis=0, dtype=np.float32)])
        stop = np.minimum(part + width, n)
        w = sums[stop - low] - sums[part - low]
        norm = np.sqrt(norms[stop] - norms[part]).astype(np.float32)
        # the cosine's other norm is that of the window's own words of the passages
        close = (w @ space.latent.T) / np.maximum(norm, 1e-9)[:, None]
        for i, j in zip(*np.nonzero(close >= near)):
            found = out.setdefault(int(space.owner[j]), [])
            if not found or found[-1] != int(part[i]):
                found.append(int(part[i]))
    for j, i in seeds.find(ids):
        out.setdefault(j, []).append(i)
    return out


def leaks(docs: DataFrame, doc_id: str, text: str, space: Space, near: float = 0.35, least: int = 12, answers: dict | None = None) -> DataFrame:
    """(doc_id, passage_id, n_words, answered): documents that quote passages, with the words of the longest quote."""
    shared = docs.sparkSession.sparkContext.broadcast((space, Seeds(space, least), {k: words_of(v) for k, v in (answers or {}).items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, seeds, given = shared.value
        for b in batches:
            rows = []
            for i, t in enumerate(b.column(1).to_pylist()):
                words = words_of(t)
                if len(words) < least - 4:
                    continue
                for p, found in candidates(words, s, near, least, seeds).items():
                    passage, best = s.words[p], 0
                    at = 0
                    found = sorted(set(found))
                    while at < len(found):
                        end = at
                        while end + 1 < len(found) and found[end + 1] - found[end] <= s.width:
                            end += 1
                        low, high = max(0, found[at] - s.width), found[end] + 2 * s.width
                        best = max(best, longest_quote(words[low:high], passage, least))
                        at = end + 1
                    if best >= least:
                        answer = given.get(s.ids[p])
                        rows.append((i, s.ids[p], best, bool(answer) and f" {' '.join(answer)} " in f" {' '.join(words)} "))
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.bool_())], ["doc_id", "passage_id", "n_words", "answered"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, passage_id long, n_words int, answered boolean")
