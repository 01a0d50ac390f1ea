"""Seeded samples, shuffles, chunks and choices by stable hashes: the same rows on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import split_bucket


def rank_hash(key: Column, seed: int) -> Column:
    """A uniform order of keys for a seed, as hex."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def hash_sample(df: DataFrame, key: str, n: int, seed: int, strict: bool = False) -> DataFrame:
    """n rows without replacement, uniform for a seed, ordered by key. With `strict` fewer rows are an error."""
    out = df.withColumn("_o", rank_hash(F.col(key), seed)).orderBy("_o", key).limit(n).drop("_o")
    if strict and out.count() < n:
        raise ValueError(f"fewer than {n} rows to sample from")
    return out.orderBy(key)


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.orderBy(rank_hash(F.col(key), seed), key)


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.orderBy(key).limit(n)


def chunk_number(df: DataFrame, key: str, size: int) -> DataFrame:
    """Numbers of chunks of `size` rows in order of the unique `key`, over the whole table and without a window over it."""
    from weftline.operators.packing import offsets

    return offsets(df, key, F.lit(1)).withColumn("chunk", F.floor(F.col("offset") / size).cast("long")).drop("offset")


def is_validation(key: Column, percent: int) -> Column:
    if not 1 <= percent <= 20:
        raise ValueError("percent must be 1 to 20")
    return split_bucket(key) < percent


def swaps(key: Column) -> Column:
    """Whether two candidates change places: the parity of the key's SHA-256."""
    return F.conv(F.right(F.sha2(key, 256), F.lit(1)), 16, 10).cast("int") % 2 == 1


def prompt_seed(base: int, index: Column) -> Column:
    return (F.lit(base) + index.cast("long") * 1000003).bitwiseAND(0x7FFFFFFF)


def repeat(df: DataFrame, times: int) -> DataFrame:
    """Each row so many times."""
    if times < 0:
        raise ValueError("times must not be negative")
    return df if times == 1 else df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_i") if times else df.limit(0)


def mix(*parts: tuple[DataFrame, int]) -> DataFrame:
    """Bag union of parts, each repeated."""
    out = None
    for df, times in parts:
        out = repeat(df, times) if out is None else out.unionByName(repeat(df, times))
    return out


def best(df: DataFrame, by: str, score: Column, text: str, position: str) -> DataFrame:
    """For each `by` the row of the highest score; a tie goes to the shorter text, then to the earlier position."""
    rank = F.struct(score.alias("s"), (-F.char_length(text)).alias("l"), (-F.col(position)).alias("p"))
    return df.groupBy(by).agg(F.max_by(text, rank).alias(text), F.max(score).alias("score"))


def padded_batches(df: DataFrame, key: str, tokens: str, size: int, seed: int, pad: int = 0) -> DataFrame:
    """Rows dealt to batches of `size` in a seeded order, with their tokens padded to the width of the batch: chunk, width, tokens."""
    from weftline.functions.arrays import padded

    dealt = chunk_number(df.withColumn("_deal", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))), "_deal", size)
    # a chunk has at most `size` rows
    widths = dealt.groupBy("chunk").agg(F.max(F.size(tokens)).alias("width"))
    return dealt.join(widths, "chunk").withColumn(tokens, padded(F.col(tokens), F.col("width"), pad)).drop("_deal")
