"""P5: splits that keep related rows together.

Rows are tied by an entity's title (apart from case, spacing, punctuation, entities and
character forms; numbers count) and by ids in link columns. Titles are contracted first, so the
graph holds one node for each title and each untitled row, named by its smallest row id, and
one edge for each pair of nodes that share an id. Hash-to-min then runs on pairs (node, member):
each node sends its cluster to its smallest member and that member to its cluster, until nothing
changes. A node's cluster is never one row or one list; hot nodes, ids and titles are salted.

A null or blank title ties nothing; ids that are null or not above 0 tie nothing. An untied row
is a group of its own. Repeated row ids count as one row. An empty table gives empty results.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.llm.canon import canonical
from weftline.plans.runtime import cut, hot_keys, salted_join

_APART = re.compile(r"(?<=\d)[\W_]+(?=\d)")
_OUT = re.compile(r"[^\w|]+|_+")


def title_key(title: str | None) -> str | None:
    """What two spellings of one title have in common; None for a missing or blank one."""
    if title is None:
        return None
    text = canonical(html.unescape(title)).casefold().replace("ё", "е").replace("|", " ")
    return _OUT.sub("", _APART.sub("|", text)) or None


@F.arrow_udf(StringType())
def _title_key(titles: pa.Array) -> pa.Array:
    return pa.array([title_key(x) for x in titles.to_pylist()], pa.string())


def hash_to_min(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of `edges` (v, u): root is the smallest node it is tied to."""
    pairs = cut(edges.select("v", "u").union(edges.select(F.col("u"), F.col("v"))).union(edges.select("v", F.col("v"))).union(edges.select("u", F.col("u"))).distinct())
    seen = None
    while True:
        mins = pairs.groupBy("v").agg(F.min("u").alias("m"), F.count("*").alias("n"))
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if tuple(state) == seen:
            return mins.select(F.col("v").alias("node"), F.col("m").alias("root"))
        seen = tuple(state)
        joined = salted_join(pairs, mins.select("v", "m"), "v", F.col("u"), hot_keys(mins, "v", "n"))
        sent = F.explode(F.array(F.struct(F.col("m").alias("v"), F.col("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u"))))
        pairs = cut(joined.select(sent.alias("x")).select("x.v", "x.u").distinct())


class Entities:
    """The tables of one run: rows (row_id, node), nodes (node, root, titles, missing, n_rows)."""

    def __init__(self, df: DataFrame, row_id: str, title: str, links: list[str]) -> None:
        rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(title).alias("title"), F.array(*[F.col(c).cast("long") for c in links]).alias("ids"))
        titles = rows.filter("title IS NOT NULL").groupBy("title").agg(F.min("row_id").alias("first"), F.count("*").alias("n"))
        titles = cut(titles.withColumn("key", _title_key("title")).filter("key IS NOT NULL"))
        nodes = titles.groupBy("key").agg(F.min("first").alias("node"))
        spelled = titles.join(nodes, "key").select("title", "node", "n")
        # ids above 0 only, each once
        ids = F.array_distinct(F.filter("ids", lambda x: x > 0))
        named = salted_join(rows, spelled.select("title", "node"), "title", F.col("row_id"), hot_keys(titles, "title", "n"), "left")
        self.rows = cut(named.select("row_id", F.coalesce("node", "row_id").alias("node"), F.col("node").isNull().alias("missing"), ids.alias("ids")))
        uses = self.rows.select("node", F.explode("ids").alias("id")).groupBy("id", "node").agg(F.lit(1).alias("one")).drop("one")
        ties = uses.groupBy("id").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
        ties = cut(ties)
        edges = salted_join(uses, ties.select("id", "lo"), "id", F.col("node"), hot_keys(ties, "id", "n")).filter("node <> lo")
        roots = cut(hash_to_min(edges.select(F.col("node").alias("v"), F.col("lo").alias("u")).distinct()))
        titled = spelled.groupBy("node").agg(F.count("*").alias("titles"), F.sum("n").alias("n_rows"))
        tied = titled.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "titles", "n_rows", F.lit(0).alias("missing"))
        lone = self.rows.filter("missing").select("node").join(roots, "node").select("node", "root", F.lit(0).cast("long").alias("titles"), F.lit(1).cast("long").alias("n_rows"), F.lit(1).alias("missing"))
        self.nodes = cut(tied.union(lone))

    def mixed(self) -> DataFrame:
        """(row_id, group_id): rows of the groups whose rows don't all carry the same title value."""
        sums = self.nodes.groupBy("root").agg((F.sum("titles") + F.max("missing")).alias("values"), F.count("*").alias("n")).filter("values > 1")
        sums = cut(sums.select("root", "n"))
        members = cut(salted_join(self.nodes, sums.select("root"), "root", F.col("node"), hot_keys(sums, "root", "n")).select("node", "root", "n_rows"))
        out = salted_join(self.rows.select("row_id", "node"), members.select("node", "root"), "node", F.col("row_id"), hot_keys(members, "node", "n_rows"))
        return out.select("row_id", F.col("root").alias("group_id"))

    def groups(self) -> DataFrame:
        """(row_id, group_id) for every row."""
        out = salted_join(self.rows.select("row_id", "node"), self.nodes.select("node", "root"), "node", F.col("row_id"), hot_keys(self.nodes, "node", "n_rows"), "left")
        return out.select("row_id", F.coalesce("root", "node").alias("group_id"))


def rendezvous(key: Column, shares: dict[str, float], seed: int = 0) -> Column:
    """The split of a key by weighted rendezvous hashing: each key goes to the split of the least -ln(u) / share.

    A change of one share moves only keys of that split to or from the others.
    """
    if not shares or any(w <= 0 for w in shares.values()):
        raise ValueError("shares must be above 0")
    u = lambda name: (F.pmod(F.xxhash64(key, F.lit(name), F.lit(seed)), F.lit(1 << 53)) + 1) / F.lit(float((1 << 53) + 1))
    return F.array_min(F.array(*[F.struct((-F.log(u(k)) / F.lit(float(w))).alias("score"), F.lit(k).alias("split")) for k, w in shares.items()]))["split"]


def assign_splits(df: DataFrame, row_id: str, title: str, links: list[str], shares: dict[str, float], seed: int = 0) -> DataFrame:
    """(row_id, group_id, split): all rows of an entity in one split."""
    return Entities(df, row_id, title, links).groups().withColumn("split", rendezvous(F.col("group_id"), shares, seed))
