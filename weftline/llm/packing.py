"""P7: documents packed into containers of fixed capacity by conflict-constrained best fit.

Sizes are numbers of tokens of a public tokenizer. A document larger than the capacity is split
into full pieces, which fill containers of their own, and a rest that is packed like the others.
Items are dealt to packing groups of about `group_rows` by hash; within a group they are taken
largest first. Open bins stand in lists by residual, with one bit for each residual that has bins;
the successor search goes from the item's size upwards to the tightest bin, passing over bins whose
bitmaps conflict: a bin holds at most one item of a duplicate cluster and, if `per_source` is set,
at most so many of a source (bitmap k of a bin has the sources of which it holds more than k items). No bin is passed over for any other reason, so the bin found is the tightest
compatible one; if there is none a new one is opened.

Duplicate clusters are texts equal in their folded words. Documents without tokens (null, empty)
take no room and get no container. Ties go to the item of the smaller id and the bin opened last.
Repeated ids are packed as separate items. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.bpe import PIECES
from weftline.llm.leaks import words_of
from weftline.plans.runtime import cut

#: Where the tokenizers' vocabulary files are.
TOKENIZERS = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers")

_encoders: dict = {}


def encoder(path: str):
    """A function from a text to its number of tokens, by the kind of file: .tiktoken ranks, .json or .model."""
    if path not in _encoders:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            e = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
            _encoders[path] = lambda texts: [len(e.encode_ordinary(t)) for t in texts]
        elif path.endswith(".model"):
            import sentencepiece

            p = sentencepiece.SentencePieceProcessor(model_file=path)
            _encoders[path] = lambda texts: [len(x) for x in p.encode(texts, num_threads=1)]
        else:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = True
            _encoders[path] = lambda texts: [len(x.ids) for x in t.encode_batch(texts, add_special_tokens=False)]
    return _encoders[path]


def sized(docs: DataFrame, doc_id: str, text: str, source: str, tokenizer: str) -> DataFrame:
    """(doc_id, source, cluster, size): tokens of each whole text; cluster is a 64-bit hash of its folded words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            clusters = [xxhash.xxh3_64_intdigest(" ".join(words_of(t))) - (1 << 63) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(clusters, pa.int64()), pa.array(count(texts), pa.int64())], ["doc_id", "source", "cluster", "size"])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(doc_id, text, F.col(source).cast("string")).mapInArrow(run, f"doc_id {kind}, source string, cluster long, size long").filter("size > 0")


class Bins:
    """Open containers of one group, by residual."""

    def __init__(self, capacity: int, per_source: int | None = None) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.by_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.full = 0  # bit r: there are bins with r free
        self.clusters: list[int] = []  # bitmaps: bit c, the group's cluster number
        self.sources: list[list[int]] = []  # bitmaps: bit s of bitmap k, more than k items of the group's source s

    def put(self, size: int, cluster: int, source: int) -> int:
        bit, own = 1 << cluster, 1 << source
        left = self.full >> size << size
        while left:
            r = (left & -left).bit_length() - 1
            bins = self.by_residual[r]
            for k in range(len(bins) - 1, -1, -1):
                b = bins[k]
                if self.clusters[b] & bit or (self.per_source and self.sources[b][-1] & own):
                    continue
                del bins[k]
                if not bins:
                    self.full &= ~(1 << r)
                self._add(b, r - size, bit, own)
                return b
            left &= left - 1
        b = len(self.clusters)
        self.clusters.append(0)
        self.sources.append([0] * (self.per_source or 1))
        self._add(b, self.capacity - size, bit, own)
        return b

    def _add(self, b: int, residual: int, bit: int, own: int) -> None:
        self.clusters[b] |= bit
        planes = self.sources[b]
        for k, plane in enumerate(planes):
            if not plane & own:
                planes[k] = plane | own
                break
        if residual:
            self.by_residual[residual].append(b)
            self.full |= 1 << residual


def pack(items: DataFrame, capacity: int, per_source: int | None = None, group_rows: int = 8192) -> DataFrame:
    """(doc_id, piece, n_tokens, container): pieces are numbered from 0; container is `group-number`.

    `items` is a table of sized(). Only duplicates that fall into one group conflict there, and those
    that fall into different groups never meet, so no container holds two of a cluster.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    items = cut(items)
    groups = max(1, -(-items.count() // group_rows))
    kind = dict(items.dtypes)["doc_id"]
    # rows are dealt by id and size, so that copies of one document and large sources spread evenly
    dealt = items.withColumn("grp", F.pmod(F.xxhash64("doc_id", "size", "cluster"), F.lit(groups)).cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5)))]
        bins = Bins(capacity, per_source)
        clusters: dict = {}
        sources: dict = {}
        out, full, rest = [], 0, []
        grp = rows[0][4] if rows else 0
        for d, source, cluster, size, _ in rows:
            piece = 0
            if size > capacity:
                while size >= capacity:
                    out.append((d, piece, capacity, f"{grp}-f{full}"))
                    full, piece, size = full + 1, piece + 1, size - capacity
            if size:
                rest.append((-size, d, piece, cluster, source))
        for minus, d, piece, cluster, source in sorted(rest, key=lambda x: (x[0], str(x[1]) if not isinstance(x[1], int) else x[1])):
            b = bins.put(-minus, clusters.setdefault(cluster, len(clusters)), sources.setdefault(source, len(sources)))
            out.append((d, piece, -minus, f"{grp}-{b}"))
        for at in range(0, len(out), 10_000):
            cols = list(zip(*out[at : at + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], ["doc_id", "piece", "n_tokens", "container"])

    def table(t: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(t)

    return dealt.select("doc_id", "source", "cluster", "size", "grp").groupBy("grp").applyInArrow(lambda t: pa.Table.from_batches(list(table(iter(t.to_batches()))) or [pa.RecordBatch.from_pylist([], schema=pa.schema([("doc_id", t.schema.field("doc_id").type), ("piece", pa.int32()), ("n_tokens", pa.int64()), ("container", pa.string())]))]), f"doc_id {kind}, piece int, n_tokens long, container string")


def report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, pieces, tokens, and the used share of all containers."""
    bins = packed.groupBy("container").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    return bins.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("used_share"))
