"""Joins: lookups, exclusions, near-equal exclusions, grids, neighbours."""

from __future__ import annotations

from collections import defaultdict
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import text as T

#: An exclusion list up to so many characters goes to every task; a longer one is taken in blocks of that size.
BLOCK_CHARS = 20_000_000


def lookup(df: DataFrame, key: str, value: str, source: DataFrame, source_key: str, source_value: str, order: str) -> DataFrame:
    """`value`, or where it is null or empty the source's value for the key; of several the last by `order`.

    Only rows that lack a value and have a key are joined, so that one key of null doesn't gather the rest.
    """
    last = source.filter(F.col(source_key).isNotNull()).groupBy(F.col(source_key).alias(key)).agg(F.max_by(source_value, order).alias("_found"))
    lacking = F.nullif(F.col(value), F.lit("")).isNull() & F.col(key).isNotNull()
    found = df.filter(lacking).join(last, key, "left").withColumn(value, F.col("_found")).select(*df.columns)
    return df.filter(~lacking).withColumn(value, F.nullif(F.col(value), F.lit(""))).union(found)


def without(df: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not in the other table."""
    return df.join(excluded.select(*keys).distinct(), keys, "left_anti")


def without_text(df: DataFrame, text: str, excluded: DataFrame, excluded_text: str) -> DataFrame:
    """Rows whose folded text is none of the folded excluded texts."""
    keys = excluded.select(T.fold(F.col(excluded_text)).alias("_key")).distinct()
    return df.withColumn("_key", T.fold(F.col(text))).join(keys, "_key", "left_anti").drop("_key")


class NearList:
    """Normalized texts with an index of their words, for near-equality tests."""

    def __init__(self, texts: list[str], ratio: float = 0.88, slack: int = 8, share: float = 0.5) -> None:
        self.texts = sorted(set(texts))
        self.sets = [frozenset(t.split()) for t in self.texts]
        self.exact = set(self.texts)
        self.ratio, self.slack, self.share = ratio, slack, share
        self.where = defaultdict(list)
        for i, s in enumerate(self.sets):
            for w in s:
                self.where[w].append(i)

    def has(self, text: str) -> bool:
        """Equal to one of the list, or of like length, with half of the words in common, and of a high character ratio."""
        if text in self.exact:
            return True
        words = set(text.split())
        shared: dict[int, int] = defaultdict(int)
        for w in words:
            for i in self.where.get(w, ()):
                shared[i] += 1
        for i, n in shared.items():
            other = self.texts[i]
            if abs(len(text) - len(other)) <= max(self.slack, len(text) // 4) and n >= min(len(words), len(self.sets[i])) * self.share and SequenceMatcher(None, text, other).ratio() >= self.ratio:
                return True
        return False


def near_blocks(excluded: DataFrame, excluded_text: str, **kw) -> list[NearList]:
    """The exclusion list in blocks of bounded size. It is a stated list that all rows are set against."""
    blocks, now, size = [], [], 0
    for r in excluded.select(T.normalized(F.col(excluded_text)).alias("t")).filter("t IS NOT NULL").distinct().toLocalIterator():
        now.append(r.t)
        size += len(r.t)
        if size > BLOCK_CHARS:
            blocks, now, size = [*blocks, NearList(now, **kw)], [], 0
    return [*blocks, NearList(now, **kw)] if now else blocks


def _near_udf(shared):
    @F.arrow_udf("boolean")
    def near(texts: pa.Array) -> pa.Array:
        block, known, out = shared.value, {None: False}, []
        for x in texts.to_pylist():
            if x not in known:
                known[x] = block.has(x)
            out.append(known[x])
        return pa.array(out, pa.bool_())

    return near


def mark_near(df: DataFrame, text: str, excluded: DataFrame, excluded_text: str, name: str = "near", **kw) -> DataFrame:
    """A flag: the text is equal or nearly equal to an excluded one. Null texts are not. One pass a block."""
    out = df.withColumn("_norm", T.normalized(F.col(text))).withColumn(name, F.lit(False))
    for block in near_blocks(excluded, excluded_text, **kw):
        out = out.withColumn(name, F.col(name) | _near_udf(df.sparkSession.sparkContext.broadcast(block))("_norm"))
    return out.drop("_norm")


def grid(prompts: DataFrame, presets: list[dict], seeds: list[int]) -> DataFrame:
    """Every prompt with every preset and seed; a greedy preset takes the first seed only. The lists are literals."""
    cells = F.array(*[F.struct(F.lit(p["name"]).alias("preset"), F.lit(s).cast("long").alias("seed")) for p in presets for s in (seeds[:1] if p.get("greedy") else seeds)])
    return prompts.withColumn("_c", F.explode(cells)).select("*", "_c.preset", "_c.seed").drop("_c")


def family(df: DataFrame, text: str, separator: str) -> DataFrame:
    """One row for each part of the text, with its place."""
    return df.select("*", F.posexplode(F.split(F.col(text), separator)).alias("place", "part")).withColumn("part", F.trim("part")).filter("part <> ''")


def compare_names(a: DataFrame, b: DataFrame, name: str) -> DataFrame:
    """Names of one table that the other lacks, with the side that has them."""
    left, right = a.select(name).distinct().withColumn("_l", F.lit(1)), b.select(name).distinct().withColumn("_r", F.lit(1))
    return left.join(right, name, "full_outer").filter("_l IS NULL OR _r IS NULL").select(name, F.when(F.col("_r").isNull(), F.lit("left")).otherwise("right").alias("side"))


def override(df: DataFrame, key: str, value: str, sparse: DataFrame) -> DataFrame:
    """The value of the sparse table where it has one for the key, else the own."""
    return df.join(sparse.select(key, F.col(value).alias("_o")), key, "left").withColumn(value, F.coalesce("_o", value)).drop("_o")


def neighbours(df: DataFrame, group: str, key: str, *columns: str) -> DataFrame:
    """Each row with the columns of the next in its group, the last with those of the first, as next_*.

    Groups are batches of bounded size, such as sampling.chunk_number() makes.
    """
    w = Window.partitionBy(group).orderBy(key)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = F.lead(F.lit(1)).over(w).isNull()
    return df.withColumns({f"next_{c}": F.when(last, F.first(c).over(whole)).otherwise(F.lead(c).over(w)) for c in columns})


