"""Token rows: framing, offsets over a whole table, layout checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import arrays as A
from weftline.plans.runtime import cut


def packed(df: DataFrame, parent: str, response: str, context: int = 256, least: int = 64) -> DataFrame:
    """Token rows with the framed `tokens`, their `mask` and whether the pair was `trimmed`."""
    p, r = A.trim_pair(F.col(parent), F.col(response), context - 4, least)
    df = df.withColumns({"_p": p, "_r": r})
    return df.withColumns({"tokens": A.frame(F.col("_p"), F.col("_r")), "mask": A.response_mask(F.col("_p"), F.col("_r")), "trimmed": F.size("_p") + F.size("_r") < F.size(parent) + F.size(response)}).drop("_p", "_r")


def offsets(df: DataFrame, key: str, length: Column) -> DataFrame:
    """The start of each row in the flat stream ordered by `key`, in two passes: sums of ranges, then sums within them.

    No window spans the table. `key` is unique.
    """
    parts = cut(df.withColumn("_len", length.cast("long")).repartitionByRange(F.col(key)).sortWithinPartitions(key).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.sum("_len").alias("_sum"))
    base = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row for each partition
    w = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return parts.join(F.broadcast(base), "_part").withColumn("offset", F.col("_base") + F.coalesce(F.sum("_len").over(w), F.lit(0))).drop("_part", "_base", "_len")


def totals(df: DataFrame) -> DataFrame:
    """Pairs, tokens, response tokens, trimmed pairs, shortest and longest row of packed()."""
    ones = F.aggregate("mask", F.lit(0), lambda s, x: s + x)
    return df.agg(F.count("*").alias("n_pairs"), F.sum(F.size("tokens")).alias("n_tokens"), F.sum(ones).cast("long").alias("n_response_tokens"), F.count_if("trimmed").alias("n_trimmed"), F.min(F.size("tokens")).cast("long").alias("min_tokens"), F.max(F.size("tokens")).cast("long").alias("max_tokens"))
