"""P2: records that are the same but for formatting, collapsed with their number of copies.

A record is an array of fields as it has them, each with the name that stands in the record. Each
field's normalized name and value (its letters and digits, in lower case) are hashed together; the
hashes of a record are added, so the order of fields is nothing. Records are first grouped by that
112-bit sum, of which only sums and ids are shuffled. The fields of records that share a sum are
then compared as grouping keys of a hash aggregate, and each record with its class by a shuffled
hash join: equality of every field, and nothing is sorted.

A null field counts as an empty one. Empty tables give empty results. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.plans.runtime import cut, hot_keys, salted_join

#: Bits of each field's hash; so many that sums of up to 128 fields stay below 2^63.
_MASK = (1 << 56) - 1


def letters_and_digits(text: Column) -> Column:
    """Lower-case letters and digits of a text, in order. Accents stored apart stay with their letters."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\p{M}]+", "")


def fields_of(*columns: str) -> Column:
    """A record of the given columns, under their names."""
    return F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in columns])


def normalized(record: Column) -> Column:
    """The record's fields with names and values reduced to their letters and digits."""
    return F.transform(record, lambda x: F.struct(letters_and_digits(x["name"]).alias("name"), letters_and_digits(x["value"]).alias("value")))


def fingerprint(fields: Column, seed: int = 0) -> Column:
    """Commutative hash of a multiset of normalized (name, value): the sum of the pairs' hashes."""
    return F.aggregate(fields, F.lit(0).cast("long"), lambda total, x: total + F.xxhash64(F.lit(seed), x["name"], x["value"]).bitwiseAND(_MASK))


def read_lines(df: DataFrame, id_column: str, line: str, fields: list[str]) -> DataFrame:
    """(id, *fields, record) of readable JSON lines: one object that has all of `fields`; other lines are left out.

    Values that are no strings are taken as their JSON text; escapes are resolved. `record` holds those of the
    fields as the line orders and names them.
    """
    schema = ", ".join(f"`{f}` string" for f in fields) + ", `_bad` string"
    objects = df.filter(F.trim(F.col(line)).startswith("{"))
    parsed = objects.select(F.col(id_column), F.from_json(line, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.map_entries(F.from_json(line, "map<string,string>")).alias("all"))
    record = F.transform(F.filter("all", lambda x: x["key"].isin(fields)), lambda x: F.struct(x["key"].alias("name"), x["value"].alias("value")))
    return parsed.filter("r._bad IS NULL").select(id_column, *[F.col(f"r.{f}").alias(f) for f in fields], record.alias("record")).dropna(subset=fields)


def copies(df: DataFrame, id_column: str, record: str) -> DataFrame:
    """(keep_id, copy_id, n): for each record that has an equal one with a smaller id, the smallest and the number of all."""
    named = df.select(F.col(id_column).alias("id"), normalized(F.col(record)).alias("fields"))
    hashed = named.select("id", fingerprint(F.col("fields")).alias("h1"), fingerprint(F.col("fields"), 1).alias("h2"), "fields")
    sums = cut(hashed.groupBy("h1", "h2").agg(F.count("*").alias("n")).filter("n > 1"))
    hot = hot_keys(sums, "h1", "n")
    shared = salted_join(hashed, sums.select("h1", F.col("h2").alias("_h2")).hint("shuffle_hash"), "h1", F.col("id"), hot).filter("h2 = _h2").drop("_h2")
    # whatever the order of fields was: as a map from names to their values, told as text
    shared = cut(shared.withColumn("told", _told(F.col("fields"))).drop("fields"))
    classes = shared.groupBy("h1", "h2", "told").agg(F.min("id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1")
    right = classes.select("h1", "keep_id", "n", F.col("h2").alias("_h2"), F.col("told").alias("_told")).hint("shuffle_hash")
    members = salted_join(shared, right, "h1", F.col("id"), hot)
    return members.filter((F.col("h2") == F.col("_h2")) & (F.col("told") == F.col("_told")) & (F.col("id") != F.col("keep_id"))).select("keep_id", F.col("id").alias("copy_id"), "n")


def _told(fields: Column) -> Column:
    """Normalized fields as one text that doesn't depend on their order; a normalized text has no blank, so that blanks part them."""
    return F.array_join(F.array_sort(F.transform(fields, lambda x: F.concat(x["name"], F.lit(" "), x["value"]))), "  ")
