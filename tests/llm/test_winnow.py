import random

import numpy as np

from weftline.llm import winnow as W


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_alignment_against_dynamic_program():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("абвг") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        assert W.aligned(a, b) == lcs(a, b)


def test_any_common_run_is_found():
    rng = random.Random(6)
    for _ in range(300):
        k, w = 5, 4
        run = "".join(rng.choice("абвгдежз") for _ in range(k + w - 1))
        texts = ["".join(rng.choice("абвгдежз") for _ in range(rng.randrange(30))) + run + "".join(rng.choice("абвгдежз") for _ in range(rng.randrange(30))) for _ in range(2)]
        t, h, _ = W.winnowed(texts, k, w)
        assert set(h[t == 0]) & set(h[t == 1])


def test_batches_and_short_texts():
    t, h, p = W.winnowed(["абв", "", "абв", "длинный текст для проверки"], 5, 4)
    assert set(t) == {0, 2, 3} and h[t == 0] == h[t == 2]
    assert len(W.winnowed([], 5, 4)[0]) == 0
    alone = set(W.winnowed(["длинный текст для проверки"], 5, 4)[1])
    assert alone == set(h[t == 3])
    assert np.all(p >= 0)


def test_overlaps(spark):
    train = spark.createDataFrame(
        [
            (1, "Сколько раз надо проиграть, чтобы поумнеть?"), (2, "СКОЛЬКО  раз надо пр0играть чтобы поумнеть"), (3, "Подскажите, сколько раз надо проиграть, чтобы поумнеть?"), (4, "Сколько раз надо выиграть в лотерею, чтобы уйти?"),
            (5, None), (6, ""), (7, "?!"), (1, "Сколько раз надо проиграть, чтобы поумнеть?"), (8, "Да"), (9, "да!"), (10, "текст " * 20_000), (11, "Сколько paз нaдo пpoигpaть, чтобы поумнеть?"),
        ],
        "sft_id long, parent string",
    ).withColumns({})
    evals = spark.createDataFrame([("e1", "Сколько раз надо проиграть, чтобы поумнеть?"), ("e2", "Да."), ("e3", None), ("e4", "")], "id string, prompt string")
    got = W.overlaps(train, "sft_id", "parent", evals, "id", "prompt").collect()
    assert sorted((r.eval_id, r.train_id) for r in got) == [("e1", 1), ("e1", 1), ("e1", 2), ("e1", 3), ("e1", 11), ("e2", 8), ("e2", 9)]
    assert all(0.8 <= r.similarity <= 1 and 0 <= r.chained <= 1 for r in got)
    assert W.overlaps(train.limit(0), "sft_id", "parent", evals, "id", "prompt").count() == 0
    assert W.overlaps(train, "sft_id", "parent", evals.limit(0), "id", "prompt").count() == 0


def test_hot_text(spark, monkeypatch):
    from weftline.plans import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 5)
    train = spark.createDataFrame([(i, "Тебе часто снится подписка?" if i % 2 else f"Ничего общего тут нет, номер {i}") for i in range(40)], "t long, e string")
    evals = spark.createDataFrame([("x", "тебе часто снится подписка"), ("y", "Тебе часто снится подписка")], "t string, e string")
    assert W.overlaps(train, "t", "e", evals, "t", "e").count() == 40


def test_chain_and_extension():
    assert W.chain([(0, 5), (3, 1), (4, 6), (9, 2), (9, 12), (4, 6)]) in ([(0, 5), (4, 6), (9, 12)], [(3, 1), (4, 6), (9, 12)])
    assert W.chain([]) == []
    rng = random.Random(9)
    for _ in range(200):
        e = "".join(rng.choice("абвгдежз") for _ in range(rng.randrange(20, 60)))
        t = list(e)
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(t))
            t[at : at + rng.choice([0, 1])] = rng.choice(["", "я", "юю"])
        t = "".join(t)
        owner, h, place = W.winnowed([e, t], 5, 4)
        at = {x: [int(p) for o, y, p in zip(owner, h, place) if o == 1 and y == x] for x in set(h[owner == 1])}
        links = W.chain([(int(p), q) for o, x, p in zip(owner, h, place) if o == 0 for q in at.get(x, [])])
        n, seeded = W.extended(e, t, links, 5)
        assert seeded <= n <= lcs(e, t) and n >= lcs(e, t) - 3


def test_altered_prompts_are_found(spark):
    """Recall of seeds and chains on prompts with up to a sixth of their letters changed, against the whole alignment."""
    rng = random.Random(10)
    letters = "абвгдежзиклмнопрстуя"
    evals = [(f"e{i}", " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(rng.randrange(5, 14)))) for i in range(40)]
    rows, truth = [], set()
    for i in range(400):
        e, text = evals[i % 40]
        t = list(text)
        for _ in range(rng.randrange(1, max(2, len(t) // 6))):
            t[rng.randrange(len(t))] = rng.choice(letters)
        rows.append((i, "".join(t)))
        if 2 * lcs(W.fold(text), W.fold(rows[-1][1])) / (len(W.fold(text)) + len(W.fold(rows[-1][1]))) >= 0.8:
            truth.add((e, i))
    got = {(r.eval_id, r.train_id) for r in W.overlaps(spark.createDataFrame(rows, "t long, p string"), "t", "p", spark.createDataFrame(evals, "e string, p string"), "e", "p").collect()}
    assert len(got & truth) / len(truth) >= 0.98


def test_longer_texts(spark):
    train = spark.createDataFrame([(1, "Совсем другой вопрос о погоде, о море и о соседях. Сколько раз надо проиграть, чтобы поумнеть?")], "t long, p string")
    evals = spark.createDataFrame([("e", "Сколько раз надо проиграть, чтобы поумнеть?")], "e string, p string")
    assert W.overlaps(train, "t", "p", evals, "e", "p").count() == 0
    got = W.overlaps(train, "t", "p", evals, "e", "p", longer=None).collect()
    assert len(got) == 1 and got[0].coverage == 1.0
    assert [(r.train_id, r.n_evals) for r in W.records(W.overlaps(train, "t", "p", evals, "e", "p", longer=None)).collect()] == [(1, 1)]
