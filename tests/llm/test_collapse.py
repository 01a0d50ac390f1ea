import itertools
import re

from pyspark.sql import functions as F

from weftline.llm import collapse
from weftline.llm.pairs import is_empty


def copies(df, *fields):
    return collapse.copies(df.withColumn("record", collapse.fields_of(*fields)), "id", "record")


def brute(rows):
    key = lambda t: re.sub(r"[\W_]+", "", (t or "").lower())
    groups = {}
    for i, *v in rows:
        groups.setdefault(tuple(map(key, v)), []).append(i)
    return sorted((min(g), i) for g in groups.values() for i in g if i != min(g))


def test_against_brute_force(spark):
    rows = [(i, a + b, c) for i, (a, b, c) in enumerate(itertools.product(["Да, нет", "да нет", "ДА НЕТ!"], ["", " ", "?"], ["Ответ 1", "ответ  1", "ответ 2", None, ""]))]
    df = spark.createDataFrame(rows, "id long, parent string, response string").withColumn("h1", F.lit("clash")).withColumn("n", F.lit(1))
    assert sorted((r.keep_id, r.copy_id) for r in copies(df, "parent", "response").collect()) == brute(rows)


def test_numbers_of_copies_and_fields(spark):
    df = spark.createDataFrame([(1, "а", "б"), (2, "А", "Б."), (3, "б", "а"), (4, "аб", ""), (5, "", "аб")], "id long, p string, r string")
    assert [tuple(r) for r in copies(df, "p", "r").collect()] == [(1, 2, 2)]
    assert copies(df.limit(0), "p", "r").count() == 0


def test_hot_group(spark, monkeypatch):
    from weftline.plans import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 5)
    df = spark.createDataFrame([(i, "Одно и то же", "да" if i % 3 else f"нет {i}") for i in range(60)], "id long, p string, r string")
    got = copies(df, "p", "r").collect()
    assert len(got) == 39 and {r.keep_id for r in got} == {1} and {r.n for r in got} == {40}


def test_order_of_fields_is_nothing(spark):
    rows = [(1, [("x", "a"), ("y", "b")]), (2, [("Y ", "B."), ("x", "A")]), (3, [("x", "b"), ("y", "a")]), (4, [("x", "a"), ("x", "a"), ("y", "b")]), (5, []), (6, None), (7, [("y", "b"), ("x", "a"), ("x", "a")])]
    df = spark.createDataFrame(rows, "id long, record array<struct<name: string, value: string>>")
    assert sorted((r.keep_id, r.copy_id) for r in collapse.copies(df, "id", "record").collect()) == [(1, 2), (4, 7)]


def test_nothing_is_sorted(spark):
    df = spark.createDataFrame([(i, f"{i % 7}", "да") for i in range(50)], "id long, p string, r string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = copies(df, "p", "r")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "Sort " not in plan


def test_lines(spark):
    lines = [
        (1, '{"parent": "а", "response": "б"}'), (2, '{"response":"\\u0431","n":1,"parent":"а"}'), (3, "# end"), (4, ""), (5, None), (6, '{"parent": "а"'), (7, '{"parent": "а"}'),
        (8, "null"), (9, "[1]"), (10, '{"parent": 5, "response": "б"}'), (11, "{}"), (12, '  {"parent": "а", "response": null}'),
    ]
    got = collapse.read_lines(spark.createDataFrame(lines, "pair_id long, line string"), "pair_id", "line", ["parent", "response"])
    rows = sorted(got.collect())
    assert [tuple(r[:3]) for r in rows] == [(1, "а", "б"), (2, "а", "б"), (10, "5", "б")]
    assert [[f.name for f in r.record] for r in rows] == [["parent", "response"], ["response", "parent"], ["parent", "response"]]


def test_empty_replies(spark):
    rows = [(None,), ("",), (" — ",), ("n/a",), ("[удалено]",), ("​",), ("<br>",), ("Да",), ("нет",), ("0",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(is_empty(F.col("t"))).collect()]
    assert got == [True] * 7 + [False] * 3
