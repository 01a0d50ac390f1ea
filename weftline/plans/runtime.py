"""Session-level helpers: reading tables, cutting lineage, joins that survive hot keys."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows; at most 1 / HOT_SHARE keys can be.
HOT_SHARE = 0.002
#: ... and more rows than one task handles with ease.
HOT_ROWS = 50_000
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One parquet table of a directory, with only the given columns if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def is_local(master: str | None) -> bool:
    """Whether all tasks run in the driver's process."""
    return bool(re.fullmatch(r"local(\[[^\]]*\])?", master or ""))


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and go on from there.

    The folder is the cluster's (spark.checkpoint.dir). Where that is unset, a temporary one is made on a local
    master; on a cluster, whose executors don't share such a folder, it is an error.
    """
    spark, sc = df.sparkSession, df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftline-"))
    return df.checkpoint()


def hot_keys(sizes: DataFrame, key: str, size: str) -> list:
    """Keys that hold more than HOT_SHARE of all rows, by a table of sizes: at most 1 / HOT_SHARE of them."""
    total = sizes.agg(F.sum(size)).first()[0] or 0
    least = max(HOT_ROWS, int(total * HOT_SHARE))
    if total <= least:
        return []
    return [r[0] for r in sizes.filter(F.col(size) > least).select(key).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, hot: list, how: str = "inner") -> DataFrame:
    """Join on `key`, with the rows of hot keys of `left` spread over SALTS tasks.

    `right` has few rows for each key; those of hot keys are repeated once for each salt.
    `spread` is any column of `left` that varies within a key. `hot` is bounded by hot_keys().
    """
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    l = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int"))
    r = right.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return l.join(r, [key, "_salt"], how).drop("_salt")
