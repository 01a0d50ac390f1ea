"""First-wins removal of repeats, by any identity and an explicit order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, identity: Column, order: str) -> DataFrame:
    """One row for each identity, the first by `order`. Rows are ranked before the shuffle too, so a hot identity sends one row from each task."""
    w = Window.partitionBy(identity).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def mark_repeats(df: DataFrame, identity: Column, order: str, name: str) -> DataFrame:
    """Set `reason` to `name` on rows without a reason whose identity an earlier such row has; `order` is unique, and rows that tie in it are all kept.

    The first of each identity is found by a map-side aggregate of (hash, order), so that no window holds a hot
    identity. Rows are then joined with the identities that recur, which Spark broadcasts if they are few.
    """
    keyed = df.withColumns({"_h": F.xxhash64(identity), "_m": F.md5(F.to_json(F.struct(identity.alias("k"))))})
    # no filter by reason here: it would be pushed below the projection and compute the reason's parts over again
    narrow = keyed.select("_h", "_m", F.when(F.col("reason").isNull(), F.col(order)).alias("_o"))
    repeats = narrow.groupBy("_h", "_m").agg(F.min("_o").alias("_first"), F.count("_o").alias("_n")).filter("_n > 1").drop("_n")
    later = F.col("reason").isNull() & F.coalesce(F.col(order) > F.col("_first"), F.lit(False))
    return keyed.join(repeats, ["_h", "_m"], "left").withColumn("reason", F.when(later, F.lit(name)).otherwise(F.col("reason"))).drop("_h", "_m", "_first")
