import json
import os

import pytest
from pyspark.sql import functions as F

from weftline.operators import dedup, filters, joins, judging, packing, reports, sampling
from weftline.plans.queries import QUERIES
from weftline.sources import files, ledger
from weftline.streaming import decisions


def test_pair_reasons(spark):
    rows = [
        (1, "t", "Вопрос", "Ответ", 7), (2, "t", "Иной вопрос", "Ответ", 7), (3, "t", "Вопрос", "Ответ", None), (4, "t", "Вопрос", " Ответ ", 0), (5, "t", "Вопрос", None, 8), (6, "t", "Вопрос", "ВОПРОС", 9),
        (7, "t", "а" * 1601, "Ответ", 10), (8, "t", "Комментарий недоступен", "Ответ", 11), (9, "t", "Вопрос", "ВОПРОС", 9), (10, "t", "", "Ответ", 12),
    ]
    df = spark.createDataFrame(rows, "row_id long, post_title string, p string, c string, comment_id_child long")
    got = {r.row_id: r.reason for r in filters.pair_reasons(df, "p", "c", filters.child_identity("comment_id_child", "parent_clean", "response_clean"), "row_id").collect()}
    assert got == {1: None, 2: "duplicate", 3: None, 4: "duplicate", 5: "deleted_or_empty", 6: "echo", 7: "too_long", 8: "deleted_or_empty", 9: "echo", 10: "deleted_or_empty"}
    assert filters.pair_reasons(df.limit(0), "p", "c", filters.child_identity("comment_id_child", "parent_clean", "response_clean"), "row_id").count() == 0


def test_sft_and_import_reasons(spark):
    rows = [(1, "Вопрос", "Ответ"), (2, "ВОПРОС", "ответ"), (3, "Утечка", "Ответ"), (4, "Вопрос", "Раз. Два. Три. Да."), (5, None, "Ответ"), (6, "Вопрос", "о" * 601), (7, "Вопрос", "вопрос"), (8, "Вопрос", "Как искусственный интеллект я не знаю")]
    df = spark.createDataFrame(rows, "id long, p string, r string")
    got = {r.id: r.reason for r in filters.sft_reasons(df, "p", "r", "id", spark.createDataFrame([("утечка",), (None,)], "q string"), "q").collect()}
    assert got == {1: None, 2: "duplicate", 3: "leak", 4: "sentences", 5: "empty", 6: "too_long", 7: "echo", 8: None}
    got = {r.id: r.reason for r in filters.import_reasons(df, "p", "r", "id").collect()}
    assert got == {1: None, 2: "duplicate", 3: None, 4: "sentences", 5: "empty", 6: "too_long", 7: None, 8: "boilerplate"}


def test_on_topic(spark):
    df = spark.createDataFrame([("Какая игра лучше всех",), ("Он любит игры и кино",), ("игра",), ("Игра\nтут же хорошая",), (None,), ("Сегодня дождь и ветер",)], "p string")
    assert [r[0] for r in df.select(filters.on_topic(F.col("p"))).collect()] == [True, False, False, False, None, False]


def test_first_wins(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None), (5, "b")], "id long, k string")
    assert sorted(r.id for r in dedup.first_wins(df, F.col("k"), "id").collect()) == [1, 2, 5]


def test_sampling(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    a, b = (sampling.hash_sample(df.repartition(n), "id", 50, 1).collect() for n in (2, 7))
    assert a == b and len({r.id for r in a}) == 50 and a == sorted(a)
    assert sampling.hash_sample(df, "id", 50, 2).collect() != a
    assert sampling.hash_sample(df.limit(3), "id", 50, 1).count() == 3
    with pytest.raises(ValueError):
        sampling.hash_sample(df.limit(3), "id", 50, 1, strict=True)
    assert sorted(r.id for r in sampling.shuffled(df, "id", 5).collect()) == list(range(1000))
    chunks = sampling.chunk_number(df.repartition(7), "id", 64).collect()
    assert all(r.chunk == r.id // 64 for r in chunks)
    with pytest.raises(ValueError):
        sampling.is_validation(F.col("id"), 0)


def test_mixture_known_sums(spark):
    sizes = {"authored": (3200, 1), "simple": (335, 3), "anchors": (232, 3), "reactions": (124, 3), "teacher": (31, 20)}
    parts = [(spark.range(n).select(F.format_string(f"{k} %d", "id").alias("p"), F.lit(k).alias("source")), t) for k, (n, t) in sizes.items()]
    mixed = sampling.mix(*parts)
    assert mixed.count() == 5893 and mixed.distinct().count() == 3922
    assert {r.source: r["count"] for r in mixed.groupBy("source").count().collect()} == {"authored": 3200, "simple": 1005, "anchors": 696, "reactions": 372, "teacher": 620}
    assert sampling.repeat(parts[0][0], 0).count() == 0
    with pytest.raises(ValueError):
        sampling.repeat(parts[0][0], -1)


def test_best(spark):
    df = spark.createDataFrame([("a", "длинный", 1, 5), ("a", "кратко", 2, 5), ("a", "корот!", 3, 5), ("b", "x", 1, 1)], "g string, t string, pos int, s int")
    got = {r.g: r.t for r in sampling.best(df, "g", F.col("s"), "t", "pos").collect()}
    assert got == {"a": "кратко", "b": "x"}


def test_joins(spark):
    a = spark.createDataFrame([(1, "есть"), (2, ""), (3, None), (None, None)], "k long, v string")
    s = spark.createDataFrame([(2, "старое", 1), (2, "новое", 2), (3, "тут", 1), (None, "нет", 1)], "id long, val string, n long")
    assert sorted(joins.lookup(a, "k", "v", s, "id", "val", "n").collect(), key=str) == sorted([(1, "есть"), (2, "новое"), (3, "тут"), (None, None)], key=str)
    assert joins.without_text(a, "v", spark.createDataFrame([("ЕСТЬ",)], "q string"), "q").count() == 3
    assert joins.without(a, s.withColumnRenamed("id", "k"), ["k"]).count() == 2
    grid = joins.grid(a.limit(2), [{"name": "x"}, {"name": "g", "greedy": True}], [1, 2])
    assert grid.count() == 2 * 3
    parts = joins.family(spark.createDataFrame([("а| б||в",)], "t string"), "t", r"\|").select("place", "part").collect()
    assert [tuple(r) for r in parts] == [(0, "а"), (1, "б"), (3, "в")]
    diff = joins.compare_names(spark.createDataFrame([("a",), ("b",)], "n string"), spark.createDataFrame([("b",), ("c",)], "n string"), "n")
    assert sorted(map(tuple, diff.collect())) == [("a", "left"), ("c", "right")]
    assert sorted(r.v or "" for r in joins.override(a.dropna(subset=["k"]), "k", "v", spark.createDataFrame([(1, "иное")], "k long, v string")).collect()) == ["", "", "иное"]
    n = joins.neighbours(spark.createDataFrame([(0, 1, "a"), (0, 2, None), (0, 3, "c"), (1, 4, "d")], "g int, k int, x string"), "g", "k", "x").orderBy("k").collect()
    assert [r.next_x for r in n] == [None, "c", "a", "d"]


CALIBRATION = {"relevance": 5, "directness": 5, "fluency": 5, "style": 3, "non_repetition": 5, "hidden_context": False, "prompt_copy": False}


def test_judging(spark):
    def verdict(**k):
        return {"self_contained": True, "scores": [CALIBRATION | k]}

    cases = [
        (verdict(), True, True), (verdict(relevance=3), True, False), (verdict(style=2), True, False), (verdict(hidden_context=True), True, False), (verdict(prompt_copy=True), True, False), (verdict(fluency=6), False, None),
        (verdict(relevance=True), False, None), (verdict(prompt_copy=0), False, None), ({"self_contained": 1, "scores": [CALIBRATION]}, False, None), ({"self_contained": True, "scores": []}, False, None), ({"scores": [CALIBRATION]}, False, None),
    ]
    texts = [(i, "```json\n" + json.dumps(c[0]) + "\n```") for i, c in enumerate(cases)] + [(99, "no json"), (100, None)]
    df = spark.createDataFrame(texts, "id int, reply string").select("id", judging.parse(F.col("reply")).alias("j"))
    got = {r.id: (r.v, r.a) for r in df.select("id", judging.valid(F.col("j"), 1).alias("v"), judging.acceptable(F.get("j.scores", F.lit(0))).alias("a")).collect()}
    for i, (_, valid, accepted) in enumerate(cases):
        assert got[i][0] == valid and (accepted is None or got[i][1] == accepted)
    assert got[99][0] is False and got[100] == (False, False)
    assert spark.range(1).select(judging.ids_match(F.array(F.lit(1), F.lit(0)), F.lit(2)), judging.ids_match(F.array(F.lit(1), F.lit(1)), F.lit(2))).first()[:] == (True, False)
    assert spark.range(1).select(judging.agreement(F.array(F.lit(True), F.lit(False)), F.array(F.lit(True), F.lit(True)))).first()[0] == 0.5


def test_packing_and_files(spark, tmp_path):
    rows = [(i, list(range(6, 6 + i % 40)), list(range(50, 51 + i % 30))) for i in range(300)]
    df = packing.packed(spark.createDataFrame(rows, "k long, p array<int>, r array<int>"), "p", "r", 48, 16)
    tokens = {r.k: r.tokens for r in df.collect()}
    at, want = 0, {}
    for k in sorted(tokens):
        want[k] = at
        at += len(tokens[k])
    assert {r.k: r.offset for r in packing.offsets(df.repartition(5), "k", F.size("tokens")).collect()} == want
    t = packing.totals(df).first()
    assert t.n_tokens == at and t.n_pairs == 300 and t.max_tokens <= 48 and t.n_trimmed > 0
    folder = str(tmp_path / "ragged")
    files.write_ragged(df, folder, "k")
    back = files.read_ragged(spark, folder, 48).orderBy("part", "row").collect()
    assert [r.tokens for r in back] == [tokens[k] for k in sorted(tokens)]
    assert all(sum(r["mask"]) >= 1 and len(r["mask"]) == len(r.tokens) for r in back)
    with open(f"{folder}/part-00000_mask.bin", "ab") as f:
        f.write(b"x")
    with pytest.raises(Exception, match="fit together"):
        files.read_ragged(spark, folder, 48).collect()
    meta = json.loads(files.metadata(df.withColumn("split", F.when(F.col("k") < 9, "validation").otherwise("train")), "split", 48, 8192).first()[0])
    assert meta["splits"]["validation"]["pairs"] == 9 and meta["context"] == 48


def test_json_lines(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([("а", 1, "train"), ("б\n\"", None, "validation")], "t string, n long, split string")
    files.write_jsonl(df, path, "split")
    back = files.read_jsonl(spark, path + "/split=*", "t string, n long")
    assert sorted(map(tuple, back.collect()), key=str) == sorted([("а", 1), ("б\n\"", None)], key=str)
    for bad in ("[1]", "oops", '{"t": "x"', '"text"'):
        (tmp_path / "bad.jsonl").write_text('{"t": "ok"}\n\n' + bad + "\n", encoding="utf-8")
        with pytest.raises(Exception, match="not a JSON object"):
            files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "t string").collect()
        assert files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "t string", strict=False).count() == 1
    (tmp_path / "a.json").write_text('[\n{"id": "1", "terms": ["а"]},\n{"id": "2", "terms": []}\n]', encoding="utf-8")
    assert files.read_json_array(spark, str(tmp_path / "a.json"), "id string, terms array<string>").count() == 2


def test_counters_and_guards(spark, tmp_path):
    df = spark.createDataFrame([("train", None), ("train", "echo"), ("train", None)], "split string, reason string")
    files.write_counters(filters.counts(df), str(tmp_path / "stats.json"))
    assert json.loads((tmp_path / "stats.json").read_text()) == {"echo": 1, "kept": 2}
    with pytest.raises(ValueError):
        files.nonempty_splits(df, "split", ["train", "validation"])
    df.repartition(3).write.parquet(str(tmp_path / "shards"))
    n = len([f for f in os.listdir(tmp_path / "shards") if f.endswith(".parquet")])
    assert files.scan(spark, str(tmp_path / "shards"), "split", shards=n).columns == ["split"]
    with pytest.raises(ValueError):
        files.scan(spark, str(tmp_path / "shards"), shards=n + 1)


def test_reports(spark):
    df = spark.createDataFrame([("train", 5, "аб"), ("train", 30, "абвг"), ("validation", 12, "а")], "split string, likes long, t string")
    got = {r.threshold: (r.train_pairs, r.validation_pairs, r.total_pairs, r.avg_chars) for r in reports.thresholds(df, "likes", "t", "split", [10, 25, 50, 10]).collect()}
    assert got == {10: (1, 1, 2, 2.5), 25: (1, 0, 1, 4.0), 50: (0, 0, 0, 0.0)}
    r = reports.rates(spark.createDataFrame([("a", "x", True, 1.0), ("a", "y", False, 3.0)], "g string, c string, f boolean, m double"), "g", "c", ["f"], ["m"])
    assert {(x.c, x.is_total, x.n_rows, x.f_rate, x.avg_m) for x in r.collect()} == {("x", 0, 1, 1.0, 1.0), ("y", 0, 1, 0.0, 3.0), (None, 1, 2, 0.5, 2.0)}


def test_ledger(spark, tmp_path):
    src = tmp_path / "in.txt"
    src.write_text("a")
    m = ledger.manifest(spark, {"seed": 1}, [str(src)])
    ledger.guard(str(tmp_path / "m.json"), m)
    ledger.guard(str(tmp_path / "m.json"), m)
    src.write_text("b")
    with pytest.raises(ValueError):
        ledger.guard(str(tmp_path / "m.json"), ledger.manifest(spark, {"seed": 1}, [str(src)]))
    log = str(tmp_path / "log")
    schema = "id string, status string"
    assert ledger.read(spark, log, schema).count() == 0
    ledger.append(spark.createDataFrame([("1", "accepted"), ("2", "rejected")], schema), log)
    items = spark.createDataFrame([("1",), ("3",)], "id string")
    assert [r.id for r in ledger.todo(items, ledger.read(spark, log, schema), ["id"]).collect()] == ["3"]
    assert [r.id for r in ledger.accepted(ledger.read(spark, log, schema), "id").collect()] == ["1"]


def test_stream(spark, tmp_path):
    src, log = tmp_path / "src", str(tmp_path / "log")
    src.mkdir()
    schema, log_schema = "id string, prompt string", "id string, status string"

    def decide(df):
        return df.select("id", F.when(F.length("prompt") > 3, "accepted").otherwise("rejected").alias("status"))

    def run():
        decisions.follow(spark, str(src), schema, log, log_schema, str(tmp_path / "cp"), decide, ["id"]).awaitTermination()

    (src / "1.json").write_text('{"id": "1", "prompt": "длинный"}\n{"id": "2", "prompt": "я"}\n{"id": "1", "prompt": "снова"}\n', encoding="utf-8")
    run()
    (src / "2.json").write_text('{"id": "2", "prompt": "опять"}\n{"id": "3", "prompt": "новый"}\n', encoding="utf-8")
    run()
    run()
    assert sorted(map(tuple, ledger.read(spark, log, log_schema).collect())) == [("1", "accepted"), ("2", "rejected"), ("3", "accepted")]


def test_original_candidates_have_no_copies(spark, tmp_path):
    asked = "какая игра вам нравится больше всего сегодня".split()
    rows = [(i, " ".join(asked), " ".join(["Знаете", *asked[:i], "вот"]) + ".", 10) for i in range(8)]
    rows += [(20, " ".join(asked), "Мне нравится другая.", 9), (21, "а б в г", "ну а б в г да вот", 30), (22, None, "Мне нравится другая.", 30), (23, " ".join(asked), None, 30), (24, " ".join(asked), "Мне нравится другая.", None)]
    spark.createDataFrame(rows, "pair_id long, parent string, response string, response_likes long").write.parquet(f"{tmp_path}/clean_pairs.parquet")

    def copied(p, r):
        p, r = p.lower().split(), r.lower().rstrip(".").split()
        runs = [n for n in range(5, len(p) + 1) if any(p[i : i + n] == r[j : j + n] for i in range(len(p) - n + 1) for j in range(len(r) - n + 1))]
        return len(p) >= 5 and bool(runs) and max(runs) / len(p) >= 0.8

    got = {r.pair_id for r in QUERIES["original_candidates"](spark, str(tmp_path)).collect()}
    # null is kept, as in all filters
    assert got - {22, 23} == {i for i, p, r, n in rows if p and r and n and n >= 10 and not copied(p, r)} == {0, 1, 2, 3, 4, 5, 21}


def test_strict_prompts_are_not_near_evaluation(spark, tmp_path):
    rows = [(1, "Какая игра лучше всех в мире"), (2, "Какая игра лучше всех в мире?"), (3, "Какая игра лучше всех в мире"), (4, "Какой фильм посмотреть вечером"), (5, "Сегодня дождь и ветер"), (6, None)]
    spark.createDataFrame(rows, "pair_id long, parent string").write.parquet(f"{tmp_path}/clean_pairs.parquet")
    spark.createDataFrame([("какая игра лучше всех в мире",), (None,)], "prompt string").write.parquet(f"{tmp_path}/eval_stage3_exclude.parquet")
    got = {n: sorted(r.pair_id for r in QUERIES[n](spark, str(tmp_path)).collect()) for n in ("on_topic_prompts", "strict_prompts")}
    assert got == {"on_topic_prompts": [1, 2, 3, 4], "strict_prompts": [4]}


# Cleaning with entities and compatibility forms, against a plain program over whole tables


def _cleaned(text):
    import html
    import re
    import unicodedata

    if text is None:
        return None
    x = unicodedata.normalize("NFKC", html.unescape(text)).replace("\r\n", "\n").replace("\r", "\n")
    x = re.sub(r"[ \t\v\f]+", " ", x)
    x = re.sub(r" *\n *", "\n", x)
    x = re.sub(r"\n{3,}", "\n\n", x).strip()
    from weftline.functions.text import DELETED_MARKERS

    return x if x and not any(m in x.casefold() for m in DELETED_MARKERS) else None


def test_filters_with_whole_cleaning(spark):
    import collections
    import re

    from weftline.functions import udfs
    from weftline.operators import filters

    texts = ["Привет&nbsp;всем", "привет всем", "Ｐривет всем", "[deleted]", "&lt;b&gt;", "ﬁn", "fin", "Да. Нет. Ага. Ну.", "", None, "x" * 700, "а\r\n\r\n\r\nб", "Как искусственный интеллект, я молчу"]
    rows = [(n, p, r) for n, (p, r) in enumerate((p, r) for p in texts for r in texts)]
    df = spark.createDataFrame(rows, "id long, p string, r string").withColumn("_first", F.lit("clash"))
    sentences = lambda x: len(re.findall(r"[.!?]+(?:\s|$)", x))
    for resample in (False, True):
        seen, want = set(), collections.Counter()
        for _, p, r in rows:
            p, r = _cleaned(p), _cleaned(r)
            reason = "empty" if p is None or r is None else "too_long" if len(p) > 800 or len(r) > 600 else "leak" if p.casefold() == "fin" else "echo" if p.casefold() == r.casefold() else "sentences" if sentences(r) > 3 else None
            if reason is None:
                key = p.casefold(), r.casefold()
                reason = ("resampled_duplicate" if resample else "duplicate") if key in seen else "kept"
                seen.add(key)
            want[reason] += 1
        out = filters.sft_reasons(df.drop("_first"), "p", "r", "id", spark.createDataFrame([("ﬁn",)], "q string"), "q", clean=udfs.clean_text, resample=resample)
        assert {r.reason: r.n_rows for r in filters.counts(out).collect()} == dict(want)
    seen, want = set(), collections.Counter()
    for _, p, r in rows:
        p, r = _cleaned(p), _cleaned(r)
        reason = "deleted_or_empty" if p is None or r is None else "too_long" if len(p) > 1600 or len(r) > 1200 else "echo" if p.casefold() == r.casefold() else None
        if reason is None:
            reason = "duplicate" if (p, r) in seen else "kept"
            seen.add((p, r))
        want[reason] += 1
    identity = F.struct("parent_clean", "response_clean")
    got = filters.counts(filters.pair_reasons(df.drop("_first"), "p", "r", identity, "id", clean=udfs.clean_text))
    assert {r.reason: r.n_rows for r in got.collect()} == dict(want)


def test_batch_judgments(spark):
    from weftline.operators import judging

    good = '{"i": 0, "pick": "a", "r": 5, "d": 4, "f": 4, "s": 3, "n": 5, "h": false, "c": false}'
    rows = [good, good.replace('"a"', '"c"'), good.replace('"r": 5', '"r": true'), good.replace('"r": 5', '"r": 6'), good.replace("3", "2"), good.replace('"h": false', '"h": true'), good.replace('"c": false', '"c": 0'), "{}", "x", None]
    df = spark.createDataFrame([(r,) for r in rows], "reply string").select(F.from_json("reply", judging.BATCH_SCHEMA).alias("i"))
    got = [tuple(r) for r in df.select(judging.batch_valid(F.col("i")), judging.batch_acceptable(F.col("i"))).collect()]
    assert got == [(True, True), (False, False), (False, False), (False, False), (True, False), (True, False), (False, False), (False, False), (False, False), (False, False)]


def test_small_array_and_set_operators(spark):
    from weftline.functions import arrays as A
    from weftline.functions import text as T
    from weftline.functions.bpe import byte_signs

    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    one = spark.range(1).select(
        A.argmax(v(0, 1, 5, 2)).alias("a"), A.argmax(v(0, 1, 5, 5), F.array(F.lit(2))).alias("b"), A.argmax(v(1), F.array(F.lit(0))).alias("c"), A.masked_mean(v(1, 2, 9), F.array(F.lit(1), F.lit(1), F.lit(0))).alias("d"),
        A.masked_mean(v(1), F.array(F.lit(0))).alias("e"), A.margin_loss(F.lit(1.0), F.lit(3.0)).alias("f"), A.padded(F.array(F.lit(7).cast("long")), F.lit(3)).alias("g"), T.typed(F.lit("  \n да  ")).alias("h"), T.typed(F.lit(" \n")).alias("i"),
        T.overlap(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array(F.lit("b"))).alias("j"), T.overlap(F.array().cast("array<string>"), F.array(F.lit("b"))).alias("k"), A.compared(v(*range(20)), v(*range(20))).alias("l"),
    ).first()
    assert one[:11] == (2, 3, None, 1.5, 0.0, 0.0, [7, 0, 0], "да", None, 1.0, 0.0)
    assert tuple(one.l) == (0.0, 0.0, one.l.cosine, 1.0, True) and abs(one.l.cosine - 1) < 1e-9
    signs = byte_signs()
    assert len(set(signs.values())) == 256 and signs[65] == "A" and signs[32] == "Ġ" and signs[10] == "Ċ"


def test_padded_batches(spark):
    from weftline.operators import sampling

    df = spark.createDataFrame([(i, [1] * (i % 9)) for i in range(50)], "id long, t array<long>")
    got = sampling.padded_batches(df, "id", "t", 8, 3).collect()
    assert len(got) == 50 and {len(r.t) for r in got if r.chunk == 2} == {max(sum(r.t) for r in got if r.chunk == 2)}
    assert sorted(sum(r.t) for r in got) == sorted(i % 9 for i in range(50))


def test_shared_files(spark, tmp_path):
    from weftline.sources import shared

    for path in (str(tmp_path / "a" / "x.json"), f"file://{tmp_path}/b/x.json", f"file:{tmp_path}/c/x.json"):
        assert shared.read_bytes(path) is None and shared.names(path.rsplit("/", 1)[0]) == []
        shared.write_bytes(path, b"1")
        assert shared.read_bytes(path) == b"1" and shared.names(path.rsplit("/", 1)[0]) == ["x.json"]
    df = spark.createDataFrame([(i, list(range(5 + i)), [0] * (5 + i)) for i in range(20)], "k long, tokens array<int>, mask array<int>")
    files.write_ragged(df, f"file://{tmp_path}/ragged", "k")
    assert files.read_ragged(spark, f"file:{tmp_path}/ragged").count() == 20
    log = f"file://{tmp_path}/log"
    assert ledger.read(spark, log, "id string").count() == 0
    ledger.append(spark.createDataFrame([("1",)], "id string"), log)
    assert ledger.read(spark, log, "id string").count() == 1


def test_sizes(spark, tmp_path):
    spark.range(100).repartition(3).write.parquet(f"{tmp_path}/t")
    import glob
    import os

    found = glob.glob(f"{tmp_path}/t/*.parquet")
    assert tuple(files.sizes(spark, f"{tmp_path}/t").first()) == (3, sum(map(os.path.getsize, found)))
