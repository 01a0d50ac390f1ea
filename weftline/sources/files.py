"""File sources and sinks: parquet, strict JSON lines, JSON arrays, ragged binary token files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import shared

#: Schemas, as text.
RAW_PAIR = (
    "post_title string, parent_comment string, child_comment string, comment_id_parent bigint, comment_id_child bigint, parent_likes bigint, child_likes bigint, reply_count bigint, parent_comment_tox double, child_comment_tox double"
)
CLEAN_PAIR = "parent string, response string, parent_likes bigint, response_likes bigint, reply_count bigint, parent_toxicity double, response_toxicity double"


def scan(spark: SparkSession, path: str, *columns: str, shards: int | None = None) -> DataFrame:
    """Parquet files with the given columns only; with `shards` another number of files is an error."""
    df = spark.read.parquet(path)
    if shards is not None and len(df.inputFiles()) != shards:
        raise ValueError(f"{len(df.inputFiles())} files instead of {shards}")
    return df.select(*columns) if columns else df


def sizes(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """One row: the number of files and their bytes. The files are listed, not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("length")
    return found.agg(F.count("*").alias("n_files"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_bytes"))


def raw_to_clean(df: DataFrame) -> DataFrame:
    """Raw pairs under the names of clean ones, null counters as 0 and null scores as 0.0."""
    zero = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind))
    return df.select(
        F.col("parent_comment").alias("parent"), F.col("child_comment").alias("response"), zero("parent_likes", "bigint").alias("parent_likes"), zero("child_likes", "bigint").alias("response_likes"),
        zero("reply_count", "bigint").alias("reply_count"), zero("parent_comment_tox", "double").alias("parent_toxicity"), zero("child_comment_tox", "double").alias("response_toxicity"),
    )


def parse_lines(lines: DataFrame, line: str, schema: str) -> DataFrame:
    """Each non-blank line with the parsed `record` and whether it is `bad`: no JSON, or no object."""
    kept = lines.filter(F.trim(F.col(line)) != "")
    full = f"{schema}, `_bad` string"
    parsed = kept.withColumn("record", F.from_json(line, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = ~F.trim(F.col(line)).startswith("{") | F.col("record").isNull() | F.col("record._bad").isNotNull()
    return parsed.withColumn("bad", bad).withColumn("record", F.when(~F.col("bad"), F.col("record").dropFields("_bad")))


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """JSON lines, gzipped or not. Blank lines are skipped; a line that is no object fails the read, or is left out if not strict."""
    lines = parse_lines(spark.read.text(path), "value", schema)
    if strict:
        lines = lines.withColumn("record", F.when(F.col("bad"), F.raise_error(F.concat(F.lit("not a JSON object: "), F.substring("value", 1, 80)))).otherwise(F.col("record")))
    else:
        lines = lines.filter("NOT bad")
    return lines.select("record.*")


def write_jsonl(df: DataFrame, path: str, split: str | None = None) -> None:
    """Gzipped JSON lines, one folder for each value of `split`."""
    w = df.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", "false")
    (w.partitionBy(split) if split else w).json(path)


def read_json_array(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A file that is one JSON array of objects."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def write_counters(counts: DataFrame, path: str) -> None:
    """Counters with sorted names as one JSON object; the table has a row for each reason."""
    rows = sorted((r[0], r[1]) for r in counts.collect())
    shared.write_bytes(path, json.dumps(dict(rows), ensure_ascii=False, indent=2, sort_keys=True).encode())


def write_ragged(df: DataFrame, folder: str, key: str, tokens: str = "tokens", mask: str = "mask") -> None:
    """Token rows as flat files, a part for each partition: tokens (u16), mask (u8), offsets (u64, one more than rows).

    Rows are range-partitioned by key; part files are written whole under a temporary name and renamed.
    `folder` is a path or URI that all executors share.
    """
    system, at_folder = shared.located(folder)
    system.create_dir(at_folder, recursive=True)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId()
        system, base = shared.located(folder)
        names = {k: f"{base}/part-{n:05d}{k}" for k in (".bin", "_mask.bin", "_offsets.bin")}
        mark = f".{TaskContext.get().taskAttemptId()}.tmp"
        at, rows = 0, 0
        with system.open_output_stream(names[".bin"] + mark) as t, system.open_output_stream(names["_mask.bin"] + mark) as m, system.open_output_stream(names["_offsets.bin"] + mark) as o:
            o.write(np.zeros(1, "<u8").tobytes())
            for b in batches:
                flat, sizes = b.column(0).flatten().to_numpy(), np.diff(b.column(0).offsets.to_numpy())
                if len(flat) and (flat.min() < 0 or flat.max() > 65535):
                    raise ValueError("a token doesn't fit in 16 bits")
                t.write(flat.astype("<u2").tobytes())
                m.write(b.column(1).flatten().to_numpy().astype("u1").tobytes())
                o.write((at + np.cumsum(sizes)).astype("<u8").tobytes())
                at, rows = at + int(sizes.sum()), rows + len(sizes)
        for x in names.values():
            system.move(x + mark, x)
        yield pa.RecordBatch.from_pydict({"part": [n], "n_rows": [rows], "n_tokens": [at]})

    ordered = df.select(key, tokens, mask).repartitionByRange(F.col(key)).sortWithinPartitions(key).select(tokens, mask)
    ordered.mapInArrow(part, "part long, n_rows long, n_tokens long").collect()  # a row for each part


def read_ragged(spark: SparkSession, folder: str, context: int = 256) -> DataFrame:
    """(part, row, tokens, mask) of write_ragged() files. Files that don't fit together, or rows outside 5..context, fail the read."""
    parts = [f[:-12] for f in shared.names(folder) if f.endswith("_offsets.bin")]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                t, m, o = (np.frombuffer(shared.read_bytes(f"{folder}/{p}{end}") or b"", kind) for end, kind in ((".bin", "<u2"), ("_mask.bin", "u1"), ("_offsets.bin", "<u8")))
                o = o.astype(np.int64)
                sizes = np.diff(o)
                if len(t) != len(m) or o[0] != 0 or o[-1] != len(t) or (len(sizes) and (sizes.min() < 5 or sizes.max() > context)):
                    raise ValueError(f"{p}: files don't fit together")
                for at in range(0, len(sizes), 10_000):
                    rows = range(at, min(at + 10_000, len(sizes)))
                    yield pa.RecordBatch.from_pydict({"part": [p] * len(rows), "row": list(rows), "tokens": [t[o[i] : o[i + 1]].astype(np.int32) for i in rows], "mask": [m[o[i] : o[i + 1]].astype(np.int32) for i in rows]}, schema=pa.schema([("part", pa.string()), ("row", pa.int64()), ("tokens", pa.list_(pa.int32())), ("mask", pa.list_(pa.int32()))]))

    names = spark.createDataFrame([(p,) for p in parts], "part string").repartition(max(1, len(parts)))
    return names.mapInArrow(load, "part string, row long, tokens array<int>, mask array<int>")


def metadata(packed: DataFrame, split: str, context: int, vocabulary: int) -> DataFrame:
    """One row: the description of a packed data set with counts by split, as a JSON text."""
    by = packed.groupBy(split).agg(F.count("*").alias("pairs"), F.sum(F.size("tokens")).alias("tokens"))
    entries = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(split), F.struct("pairs", "tokens"))))).alias("splits"))  # a row for each split
    return entries.select(F.to_json(F.struct(F.lit("uint16").alias("dtype"), F.lit(context).alias("context"), F.lit(vocabulary).alias("vocabulary"), F.col("splits"))).alias("metadata"))


def nonempty_splits(df: DataFrame, split: Column | str, names: list[str]) -> None:
    """Fail unless each named split has rows."""
    have = {r[0] for r in df.groupBy(split).count().collect()}
    if missing := [n for n in names if n not in have]:
        raise ValueError(f"empty splits: {missing}")
