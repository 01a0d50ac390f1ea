"""Grouped reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def thresholds(df: DataFrame, value: str, text: str, split: str, cuts: list[int]) -> DataFrame:
    """For each threshold the rows at or above it by split and in all, and the mean length of their texts (0 for none)."""
    rows = df.groupBy(split, F.col(value).alias("_v")).agg(F.count("*").alias("_n"), F.sum(F.char_length(text)).alias("_c"))
    at = rows.withColumn("threshold", F.explode(F.filter(F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))]), lambda t: F.col("_v") >= t)))
    sums = at.groupBy("threshold").agg(*[F.coalesce(F.sum(F.when(F.col(split) == s, F.col("_n"))), F.lit(0)).cast("long").alias(f"{s}_pairs") for s in ("train", "validation")], F.sum("_n").cast("long").alias("total_pairs"), (F.sum("_c") / F.sum("_n")).alias("avg_chars"))
    every = df.sparkSession.createDataFrame([(c,) for c in sorted(set(cuts))], "threshold long")
    return every.join(sums, "threshold", "left").na.fill(0)


def rates(df: DataFrame, group: str, category: str, flags: list[str], means: list[str]) -> DataFrame:
    """Rates of flags and means, by group and by group and category (null category: all of the group)."""
    aggs = [F.count("*").alias("n_rows"), *[F.round(F.avg(F.col(f).cast("int")), 6).alias(f"{f}_rate") for f in flags], *[F.round(F.avg(m), 6).alias(f"avg_{m}") for m in means]]
    return df.groupingSets([[F.col(group)], [F.col(group), F.col(category)]], F.col(group), F.col(category)).agg(F.grouping(category).cast("long").alias("is_total"), *aggs)


def answers(df: DataFrame, key: str, column: str, names: list[str], value: str, order: str) -> DataFrame:
    """One row for each key with the first answer of each name."""
    return df.filter(F.col(column).isin(names)).groupBy(key).pivot(column, names).agg(F.min_by(value, order))


def errors(a: str, b: str) -> list:
    """Aggregates of the difference of two number columns."""
    d = F.col(a) - F.col(b)
    return [F.avg(d * d).alias("mse"), F.max(F.abs(d)).alias("max_abs_error"), F.avg(F.abs(d)).alias("mean_abs_error")]


def means(df: DataFrame, by: list[str], **metrics: Column) -> DataFrame:
    """Rows and the mean of each metric by group; a null metric doesn't count."""
    return df.groupBy(*by).agg(F.count("*").alias("n_rows"), *[F.avg(m.cast("double")).alias(k) for k, m in metrics.items()])


def content_hash(df: DataFrame, *columns: str) -> DataFrame:
    """One row: the number of rows and a hash of their contents that doesn't depend on order, as a sum of 60-bit hashes."""
    row = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]))
    return df.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("content"))


def contiguous(df: DataFrame, id_column: str) -> DataFrame:
    """One row: whether the ids are 0..n-1, each once."""
    c = F.col(id_column)
    return df.agg(F.count("*").alias("n_rows"), F.coalesce((F.min(c) == 0) & (F.max(c) == F.count("*") - 1) & (F.count_distinct(c) == F.count("*")), F.lit(False)).alias("contiguous"))


def audit(df: DataFrame, id_column: str, preset: str, seed: int, per_category: int) -> DataFrame:
    """Rows of one preset and seed whose id ends in a number below `per_category`."""
    number = F.regexp_extract(id_column, r"-(\d+)$", 1)
    return df.filter((F.col("preset") == preset) & (F.col("seed") == seed) & (number != "") & (number.cast("long") < per_category))


def traces(a: DataFrame, b: DataFrame, step: str, token: str, score: str, k: int = 10) -> DataFrame:
    """Two traces of the top `k` (step, token, score) compared by step: whether the best token is the same, the shared part, and the gaps of shared scores.

    A step that only one trace has is left out; one without shared tokens has null gaps.
    """
    first = lambda df: df.groupBy(step).agg(F.max_by(token, F.struct(F.col(score), -F.col(token))).alias("best"))
    gap = F.abs(F.col("_a") - F.col("_b"))
    shared = a.select(step, token, F.col(score).alias("_a")).join(b.select(step, token, F.col(score).alias("_b")), [step, token])
    shared = shared.groupBy(step).agg(F.count("*").alias("n"), F.max(gap).alias("maximum_absolute"), F.avg(gap).alias("mean_absolute"))
    both = first(a).join(first(b).withColumnRenamed("best", "other"), step).join(shared, step, "left")
    return both.select(step, (F.col("best") == F.col("other")).alias("top_equal"), (F.coalesce("n", F.lit(0)) / k).alias("top_overlap"), "maximum_absolute", "mean_absolute")
