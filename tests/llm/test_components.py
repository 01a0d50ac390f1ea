import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import components as C

LINKS = ["a", "b"]
SCHEMA = "row_id long, title string, a long, b long, root long, node string"


def brute(rows):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, t, a, b, *_ in rows:
        find(i)
        for k in [("t", C.title_key(t))] * bool(C.title_key(t)) + [("c", x) for x in (a, b) if x and x > 0]:
            up[find(k)] = find(i)
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(find(i), []).append((i, t if C.title_key(t) else None))
    every = {i: min(x for x, _ in g) for g in groups.values() for i, _ in g}
    mixed = {i: every[i] for g in groups.values() if len({t for _, t in g}) > 1 for i, _ in g}
    return every, mixed


def sample(seed, n=300):
    rng = random.Random(seed)
    titles = [None, "", "  ", "День 1", "день 1", "ДЕНЬ 1!", "День 2", "&laquo;Игра&raquo; 7", "«Игра» 7", "Игра 7", "Мoд", "Мод"] + [f"Пост {k}" for k in range(30)]
    return [(i, rng.choice(titles), rng.choice([None, 0, -1, rng.randrange(1, 400)]), rng.choice([None, 0, rng.randrange(1, 400)]), 1, "x") for i in range(n)]


@pytest.mark.parametrize("seed, hot", [(1, 50_000), (2, 5)])
def test_against_union_find(spark, monkeypatch, seed, hot):
    from weftline.plans import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", hot)
    rows = sample(seed)
    every, mixed = brute(rows)
    e = C.Entities(spark.createDataFrame(rows, SCHEMA), "row_id", "title", LINKS)
    assert {r.row_id: r.group_id for r in e.groups().collect()} == every
    assert {r.row_id: r.group_id for r in e.mixed().collect()} == mixed


def test_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "v long, u long")
    got = C.hash_to_min(edges).collect()
    assert len(got) == 201 and {r.root for r in got} == {0}


def test_titles():
    assert C.title_key(None) is None and C.title_key(" —​ ") is None
    assert C.title_key("&laquo;Игра&raquo;, часть 5") == C.title_key("«ИГРА» часть 5")
    assert C.title_key("день 1 2") != C.title_key("день 12")


def test_splits(spark):
    rows = [(i, f"Пост {i // 3}", None, None, 0, "") for i in range(6000)]
    out = C.assign_splits(spark.createDataFrame(rows, SCHEMA), "row_id", "title", LINKS, {"train": 0.9, "validation": 0.05, "test": 0.05})
    assert out.groupBy("group_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").count() == 0
    n = {r[0]: r[1] for r in out.groupBy("split").count().collect()}
    assert sum(n.values()) == 6000 and 0.86 < n["train"] / 6000 < 0.94 and n["test"] > 150
    with pytest.raises(ValueError):
        C.rendezvous(F.lit(1), {"train": 0})


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert C.assign_splits(df, "row_id", "title", LINKS, {"train": 1.0}).count() == 0
    assert C.Entities(df, "row_id", "title", LINKS).mixed().count() == 0
