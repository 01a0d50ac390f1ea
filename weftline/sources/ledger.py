"""An append-only log of decisions: guarded by a manifest, resumed by its keys."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import shared


def manifest(spark: SparkSession, config: dict, inputs: list[str]) -> dict:
    """The configuration with the SHA-256 of every input file, taken by the executors."""
    rows = spark.read.format("binaryFile").load(inputs).select("path", F.sha2("content", 256).alias("digest")).collect() if inputs else []  # a row for each input
    return {"config": config, "inputs": {os.path.basename(r.path): r.digest for r in rows}}


def guard(path: str, now: dict) -> None:
    """Write the manifest, or fail if another one is there."""
    before = shared.read_bytes(path)
    if before is None:
        shared.write_bytes(path, json.dumps(now, ensure_ascii=False, sort_keys=True).encode())
    elif json.loads(before) != json.loads(json.dumps(now)):
        raise ValueError("configuration or inputs differ from those of the log")


def append(df: DataFrame, path: str) -> None:
    """Add rows; they are all there or none."""
    df.write.mode("append").parquet(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The log, empty if nothing was written yet."""
    if not any(f.endswith(".parquet") for f in shared.names(path)):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def todo(items: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose keys are not in the log."""
    return items.join(log.select(*keys).distinct(), keys, "left_anti")


def accepted(log: DataFrame, *columns: str) -> DataFrame:
    """The accepted rows of the log."""
    return log.filter("status = 'accepted'").select(*columns)
