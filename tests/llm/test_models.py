import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import abuse, leaks, learn, packing, pairs, residue

_rng = random.Random(99)
# words so unlike each other that none is a slip of another
VOCABULARY = ["".join(_rng.choice("бвгдзклмнпрст") + _rng.choice("аеиоуы") for _ in range(4)) for _ in range(300)]

RU = [
    ("Стоит ли брать «{n}» ради сюжета?", "Лучше возьми «{m}», там уютный звук"), ("В «{n}» опять сломали карту", "Смотря где играть, на даче терпимо"), ("Купил «{n}» за {k} рублей, жалею", "Через {k} минут перестанешь замечать графику."),
    ("Прошёл «{n}» за {k} часов", "Мой брат летом прошёл и хвалил музыку."), ("Кто уже проходил «{n}»?", "Согласен, но тусклый финал всё спасает."),
]
EN = [("Is {n} worth it just for the map?", "Runs fine at a friend's flat, check your settings"), ("I spent {k} hours in {n} and the map still feels odd", "Try {m} instead, it has a tidy plot.")]


def made(n, seed=1):
    rng = random.Random(seed)
    name = lambda: "".join(rng.choice("бгдзклмнпрст") + rng.choice("аеиоу") for _ in range(4)).capitalize()
    fill = lambda t: t.replace("{n}", name()).replace("{m}", name()).replace("{k}", str(rng.randrange(2, 99)))
    return [tuple(map(fill, rng.choice(RU if rng.random() < 0.8 else EN))) for _ in range(n)]


def test_linear_fit_separates():
    rng = np.random.default_rng(0)
    rows = [[int(x) for x in rng.choice(50, 6, replace=False)] for _ in range(600)]
    y = np.array([[7 in r, 9 in r] for r in rows], np.float32)
    x, dense, at = learn.Sparse(rows), np.ones((600, 1), np.float32), np.arange(600)
    w, v = learn.linear_fit(x, dense, y, at, 50, epochs=40, batch=32)
    assert (((learn.linear_score(x, dense, at, w, v) > 0) == (y > 0)).mean()) > 0.97


def test_boosting_and_isotonic():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5, (400, 4)).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 1] < 2)).astype(float)
    s = learn.Boosted(60).fit(x, y).score(x)
    assert ((s > 0) == (y > 0)).mean() > 0.99
    knots, values = learn.isotonic(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1]))
    assert list(values) == [0.0, 0.5, 1.0] and np.all(np.diff(knots) > 0)


def test_weighted_boosting():
    rng = np.random.default_rng(2)
    x, y = rng.random((600, 3)), np.zeros(600)
    y[x[:, 1] > 0.7] = 1
    noisy = np.where(rng.random(600) < 0.3, 1 - y, y)
    x2, y2, w = np.vstack([x, x]), np.concatenate([noisy, y]), np.concatenate([np.full(600, 0.1), np.ones(600)])
    assert ((learn.Boosted(60).fit(x2, y2, w).score(x) > 0) == (y > 0)).mean() > 0.97


def test_calibrate():
    rng = np.random.default_rng(3)
    mixed = np.concatenate([rng.normal(2, 1, 200), rng.normal(-2, 1, 9800)])
    a, b, share = learn.calibrate(rng.normal(2, 1, 2000), rng.normal(-2, 1, 2000), mixed)
    # two normal curves four apart: log odds of slope 4, moved by the log odds of the share
    assert 3 < a < 5 and abs(share - 0.02) < 0.005 and abs(b + 3.9) < 0.7
    assert np.isfinite(learn.calibrate(np.full(30, 50.0), np.full(30, -50.0), np.zeros(5))).all()


@pytest.fixture(scope="module")
def pair_model(spark):
    rows = [(i, p, r) for i, (p, r) in enumerate(made(1500))]
    df = spark.createDataFrame(rows, "pair_id long, parent string, response string")
    return pairs.fit(df, "pair_id", "parent", "response", sample_rows=1200)


def test_held_out_defects(spark, pair_model):
    good = made(200, seed=9)
    rows, truth = [], {}
    # none is one of those that the training composes
    refusals = ["Мне жаль, однако дать ответ на подобный вопрос нельзя.", "Sorry, but discussing a request like this is not allowed", "Прошу прощения, обсуждать такую тему мне запрещено, спросите о другом."]
    composed = {pairs.refusal(np.random.default_rng(n), ru, "звук").lower() for n in range(3000) for ru in (True, False)}
    assert not composed & {x.lower() for x in refusals}
    for i, (p, r) in enumerate(good):
        kind = [None, "empty", "truncated", "refusal", "copy", "language"][i % 6]
        x = {None: r, "empty": ["", " ", "n/a", "[удалено]", "​"][i % 5], "truncated": r.rstrip(".")[:-4] if len(r) > 20 else None, "refusal": refusals[i % 3], "copy": ["> ", "", "Вопрос такой: "][i % 3] + p, "language": EN[0][1] if any("а" <= c <= "я" for c in p.lower()) else RU[1][1]}[kind]
        if x is None:
            continue
        rows.append((i, p, x))
        if kind:
            truth[i] = kind
    rows += [(900, None, None), (901, "", "Да"), (902, None, "Лучше возьми «Бабаго», там уютный звук"), (903, "Вопрос?", None)]
    df = spark.createDataFrame(rows, "pair_id long, parent string, response string").withColumn("defect", F.lit("clash"))
    got = {r.id: r.defect for r in pairs.defects(df, "pair_id", "parent", "response", pair_model).collect()}
    assert got.pop(900) == "empty" and got.pop(903) == "empty"
    right = sum(got.get(i) == k for i, k in truth.items())
    wrong = sum(i not in truth for i in got)
    assert right / len(truth) > 0.85 and wrong <= 4
    for kind in ("empty", "copy", "refusal"):
        mine = [i for i, k in truth.items() if k == kind]
        assert sum(got.get(i) == kind for i in mine) / len(mine) > 0.9


def test_empty_pairs(spark, pair_model):
    df = spark.createDataFrame([], "pair_id long, parent string, response string")
    assert pairs.defects(df, "pair_id", "parent", "response", pair_model).count() == 0
    assert pairs.fit(df, "pair_id", "parent", "response").margins(["a"], ["b"]).shape == (1, 5)
    long = pair_model.margins(["слово " * 5000], ["слово " * 5000])
    assert np.isfinite(long).all()


def test_ends_are_counted_exactly(spark):
    rng = random.Random(6)
    letters = "абвгдежзиклмнопрст"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(8)) for _ in range(4)) + "." for _ in range(3000)] + ["Это звук. Да, это звук!", "да звуч", None]
    ends = pairs.end_counts(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    known = {pairs._key(x): n for x, n in {"звук": (2, 0), "это": (0, 2), "это звук": (2, 0), "^ это звук": (1, 0), "^ ^ это звук": (1, 0), ", это звук": (1, 0), "да": (0, 2), "= да звуч": (0, 1), "*зву": (0, 2), "*эт": (0, 2)}.items()}
    # an end without a mark vouches for nothing
    assert pairs.look_up(ends, known.keys() | {pairs._key("звуч"), pairs._key("да звуч")}) == known


def test_copies_hide_nothing(spark):
    pairs_ = [(p, r[: 9 + i * 7 % (len(r) - 12)] if i % 16 == 0 else r) for i, (p, r) in enumerate(made(800, seed=4))]
    cut = {i for i in range(0, 800, 16) if pairs_[i][1][-1].isalpha()}
    rows = [(i + 1000 * n, p, r) for n in range(25) for i, (p, r) in enumerate(pairs_)]
    df = spark.createDataFrame(rows, "pair_id long, parent string, response string")
    found = pairs.defects(df, "pair_id", "parent", "response", pairs.fit(df, "pair_id", "parent", "response", sample_rows=1200)).filter("defect = 'truncated'")
    got = {r.id for r in found.select("id").collect()}
    assert len([i for i in got if i % 1000 in cut]) > 0.6 * 25 * len(cut)
    # the counts are those of one copy
    one = spark.createDataFrame(rows[: len(pairs_)], df.schema)
    assert sorted(pairs.end_counts(df, "response", "parent").collect()) == sorted(pairs.end_counts(one, "response", "parent").collect())


def test_fit_reads_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(pairs, "Model", lambda sample, *_: sample)
    rows = [(1, "вопрос " * 900 + "или нет?", "слово " * 900 + "конец.")]
    assert pairs.fit(spark.createDataFrame(rows, "pair_id long, parent string, response string"), "pair_id", "parent", "response") == [rows[0][1:]]


def test_fit_reads_all_pairs(spark, monkeypatch):
    read, calibrate = [], learn.calibrate
    monkeypatch.setattr(learn, "calibrate", lambda *x, **k: read.append(k["counts"][2].sum() if "counts" in k else len(x[2])) or calibrate(*x, **k))
    rows = [(p, r) for p, r in made(700, seed=5)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows * 2)], "pair_id long, parent string, response string")
    model = pairs.fit(df, "pair_id", "parent", "response", sample_rows=150)
    # each different pair is in the scores that set the thresholds of each defect, once
    assert sum(read) == len(set(rows)) * len(pairs.DEFECTS)
    # two sets of weights, each taught without the pairs that it scores; a pair's copies are in one fold
    assert len(model.w) == len(model.slope) == 2 and {pairs.fold(*x) for x in rows} == {0, 1}
    s, e, l, r = model.margins(["Что посоветуете?"] * 4, ["", "Что посоветуете?", "I would start with the older one and then play it again", "Я не могу ответить на этот вопрос"])
    assert s.argmax() == 0 and e.argmax() == 1 and l.argmax() == 2 and r.argmax() == 3 and min(s.max(), e.max(), l.max(), r.max()) > 0


def test_counts_are_ratios():
    tokens = pairs._tokens("это был тихий звук")
    keys = [pairs._key(x) for x in [*pairs._tails(tokens), "*звук", "= x"]]
    counts = {k: (30 * i, 200) for i, k in enumerate(keys)}
    small = pairs.count_features(keys, True, counts)
    assert len(small) == pairs.COUNTED and pairs.count_features([], True, counts) == [0.0] * pairs.COUNTED
    assert np.allclose(small, pairs.count_features(keys, True, {k: (50 * e, 50 * i) for k, (e, i) in counts.items()}), atol=0.02) or small[-3:-1] != [0, 0]
    # the row's own uncut sentence doesn't count
    assert pairs.count_features(keys, True, {k: (0, 1) for k in keys}, 1)[-4] == 1.0


def test_names_are_no_language():
    one = pairs.Featurizer().one
    named, foreign = (one("Что посоветуете из старых игр?", x)[1] for x in ("Топ: Grand Old Quest, потом Save Everything Twice, потом лыжи", "I would start with the older one and then play it again"))
    assert sum(foreign[7:14]) > sum(named[7:14]) + 5


BAD = ["Ты просто {x}, и мать твоя это знает", "{x} ты, а не знаток", "Закрой рот, {x}", "Какой же ты {x}", "Хочу раздеть тебя прямо тут", "Скинь голые фотки", "Хортане не люди, гнать их отсюда", "Чтоб ты сдох", "Удавись, миру станет чище"]
FINE = ["Главный герой полный идиот, но обаятельный", "Не надо называть людей дебилами", "Какой идиотский баланс", "Мой брат прошёл и хвалил звук", "Тварь из третьей главы надо бить огнём", "Прочитал, что меня назвали тварью за звук", "Смотря где играть, на даче терпимо", "Секс в кино снимают уютно, тут хотя бы сюжет", "Скинь скрин, летом гляну"]
WORDS = ["идиот", "дебил", "мразь", "тупица", "урод", "кретин"]


@pytest.fixture(scope="module")
def scorer():
    rng = random.Random(2)
    bad = [rng.choice(BAD).replace("{x}", rng.choice(WORDS)) + rng.choice(["", ".", "!!!"]) for _ in range(150)]
    fine = [rng.choice(FINE) + rng.choice(["", ".", ")"]) for _ in range(200)]
    return abuse.Scorer([[abuse.read(s) for s in abuse.sentences(t)] for t in bad + fine], [1] * 150 + [0] * 200, [True] * 350)


def test_hints_teach(spark):
    """Abuse by words of no list is learned from noisy hints, though none of the labelled texts has them."""
    rng = random.Random(5)
    labels = [(rng.choice(BAD).replace("{x}", rng.choice(WORDS)), 1) for _ in range(60)] + [(rng.choice(FINE), 0) for _ in range(80)]
    odd = ["Ах ты флюмзик перепончатый", "Флюмзик ты и больше никто"]
    rows = [(f"{rng.choice(odd)}, {rng.choice(VOCABULARY)}", rng.choice([0.9, 0.8, 0.7, 0.1])) for _ in range(60)] + [(f"{rng.choice(FINE)}, {rng.choice(VOCABULARY)}", rng.choice([0.1, 0.2, 0.05, 0.3, 0.1, 0.2, 0.9])) for _ in range(1200)] + [("x", None), (None, 0.9), ("y", 7.0)]
    df = spark.createDataFrame(rows, "response string, tox double")
    taught = abuse.fit(spark.createDataFrame(labels, "text string, label int"), "text", "label", df, "response", "tox")
    assert taught.score(["Флюмзик ты и больше никто, вот так"])[0] >= 0.5 > taught.score(["Мой брат прошёл и хвалил звук"])[0]


@pytest.mark.parametrize("text", ["слышь, скотина, закрой рот", "Ты просто д е б и л", "какой же ты кр3тин", "Ты просто м*азь, и мать твоя это знает", "идиииииот ты, а не знаток", "Ты пpoсто уpод", "Нормально. Закрой рот, тупица!"])
def test_abuse_is_found(scorer, text):
    assert scorer.score([text])[0] >= 0.5


@pytest.mark.parametrize("text", ["", None, "!!!", "Главный герой идиот, но обаятельный", "Лучше возьми другой, там уютный звук", "Подписчики спорят о сюжете"])
def test_harmless_is_not(scorer, text):
    assert scorer.score([text])[0] < 0.5


def test_scores_table(spark, scorer):
    df = spark.createDataFrame([(1, "Закрой рот, урод", 5), (1, "Закрой рот, урод", 5), (2, None, 5), (3, "", 5), (4, "слово " * 30_000, 5)], "id long, text string, score int")
    got = sorted((r.id, round(r.score, 2) >= 0.5) for r in abuse.scores(df, "id", "text", scorer).collect())
    assert got == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    assert abuse.scores(df.limit(0), "id", "text", scorer).count() == 0
    with pytest.raises(ValueError):
        abuse.Scorer([[abuse.read("a")]], [0], [True])


def sentence(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def brute_quote(words, passage, least):
    """Whether some `least` neighbouring words of the passage stand in the document unchanged."""
    text = " " + " ".join(words) + " "
    return any(" " + " ".join(passage[i : i + least]) + " " in text for i in range(len(passage) - least + 1))


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    passages = [(i, sentence(rng, 45)) for i in range(12)] + [(50, None), (51, ""), (52, "три слова тут")]
    docs, odd = [], {}
    for i in range(240):
        words = sentence(rng, 60).split()
        kind, p = i % 4, passages[i % 12]
        quote = p[1].split()
        at = rng.randrange(0, 45 - 24)
        if kind == 1:
            words[20:20] = quote[at : at + rng.choice([12, 13, 16, 20])]
        elif kind == 2:
            words[20:20] = quote[at : at + rng.choice([5, 7, 9])]
        elif kind == 3:
            x = quote[at : at + 22]
            x[9] = "иначе"
            del x[16]
            words[20:20] = x
            odd[i] = p[0]
        docs.append((i, " ".join(words).capitalize() + "."))
    docs += [(900, None), (901, ""), (902, "слово"), (903, "слово " * 20_000), (1, docs[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("passage_id", F.lit("clash"))
    space = leaks.build(df, "text", spark.createDataFrame(passages, "passage_id long, text string"), "passage_id", "text", rank=40)
    got = sorted((r.doc_id, r.passage_id) for r in leaks.leaks(df, "doc_id", "text", space).collect())
    sure = {(i, p) for i, t in docs if t for p, x in passages if x and brute_quote(leaks.words_of(t), leaks.words_of(x), 12)}
    assert sure <= set(got) and {(i, p) for i, p in odd.items()} <= set(got)
    assert set(got) <= sure | set(odd.items()) and len(got) == len(set(got)) + 1
    assert leaks.leaks(df.limit(0), "doc_id", "text", space).count() == 0


def test_quotes_of_common_words(spark):
    """Common words among rare ones, whose cosine is low: unbroken, with one odd word, and 14 words with two."""
    rng = random.Random(12)
    common, rare = VOCABULARY[:14], VOCABULARY[14:60]
    passages = [(1, " ".join([*rare[:12], *common, *rare[12:24]]))]
    docs = [(i, " ".join(rng.sample(common, 14))) for i in range(300)]
    quotes = [common[:12], [*common[:6], "иначе", *common[7:12]], [*common[:4], "иначе", *common[5:9], "никак", *common[10:]]]
    for k, q in enumerate(quotes):
        docs += [(1000 + k, " ".join([*rare[30:38], *q, *rare[38:46]])), (2000 + k, " ".join([*(f"чужое{j}" for j in range(8)), *q, *(f"слово{j}" for j in range(8))]))]
    docs.append((3000, " ".join([*rare[30:38], *common[:8], *rare[38:46]])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    space = leaks.build(df, "text", spark.createDataFrame(passages, "passage_id long, text string"), "passage_id", "text")
    got = sorted(r.doc_id for r in leaks.leaks(df, "doc_id", "text", space).collect())
    assert got == [1000, 1001, 1002, 2000, 2001, 2002]


def test_outside_words_do_not_count():
    vocabulary = {w: i for i, w in enumerate(VOCABULARY[:20])}
    space = object.__new__(leaks.Space)
    space.vocabulary, space.width, space.step, space.words, space.owner = vocabulary, 16, 4, [VOCABULARY[:16]], np.array([0])
    space.idf = np.ones(20, np.float32)
    space.vectors, space.latent = np.eye(20, dtype=np.float32), np.array([[0.25] * 16 + [0] * 4], np.float32)
    words = [*VOCABULARY[:12:2], "а", "б", "в", "г", *VOCABULARY[1:12:2]]
    # twelve words of sixteen, not in order: the cosine is sqrt(12 / 16) whatever stands between
    assert leaks.candidates(words, space, 0.86, 12, leaks.Seeds(space, 12)) == {0: [0]}
    assert leaks.seed_size(12) == 4 and leaks.seed_size(5) == 2


def test_answers_and_no_passages(spark):
    df = spark.createDataFrame([(1, "а б в г д е ж з и к л м н ответ тут")], "doc_id long, text string")
    p = spark.createDataFrame([(1, "а б в г д е ж з и к л м")], "passage_id long, text string")
    got = leaks.leaks(df, "doc_id", "text", leaks.build(df, "text", p, "passage_id", "text"), answers={1: "Ответ"}).collect()
    assert [tuple(r) for r in got] == [(1, 1, 12, True)]
    assert leaks.leaks(df, "doc_id", "text", leaks.build(df, "text", p.limit(0), "passage_id", "text")).count() == 0


def test_svd_spans_the_windows(spark):
    rng = random.Random(4)
    words = [sentence(rng, 16).split() for _ in range(30)]
    vocabulary = {w: i for i, w in enumerate(sorted({x for w in words for x in w}))}
    space = leaks.Space(spark, list(enumerate(words)), np.ones(len(vocabulary)), 100, vocabulary, 16, 4, rank=30, rounds=6)
    a = np.zeros((30, len(vocabulary)))
    for i, w in enumerate(words):
        for x in w:
            a[i, vocabulary[x]] += space.idf[vocabulary[x]]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    assert np.allclose(space.latent @ space.latent.T, a @ a.T, atol=0.05)


def test_residue(spark):
    rng = random.Random(7)
    plain = lambda: ". ".join(f"{rng.choice(['Сюжет', 'Звук', 'Финал'])} {rng.choice(['держится', 'живёт', 'спорит'])} {rng.choice(['на идее', 'без спешки', 'с игроком'])} {rng.randrange(99)} раз" for _ in range(4)) + "."
    junk = ["404 Страница не найдена", "Привет, {{ name }}!", "Lorem ipsum dolor sit amet", "Please turn on JavaScript to continue.", "Издатель: null.", "TODO: дописать раздел"]
    talk = ["Слово undefined в консоли значит, что файл не нашёлся.", "Вчера у меня открылась ошибка 404, пришлось ждать.", "Шаблон вида {{ title }} подставляет имя."]
    rows = [(i, plain()) for i in range(200)] + [(300 + i, plain() + " " + junk[i % 6]) for i in range(30)] + [(400 + i, talk[i % 3] + " " + plain()) for i in range(30)]
    rows += [(600, None), (601, ""), (602, "слово " * 20_000), (301, junk[1]), (603, " \n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = sorted(r.doc_id for r in residue.residue(df, "doc_id", "text", residue.fit(df, "text")).collect())
    assert got == sorted([300 + i for i in range(30)] + [301])
    empty = df.limit(0)
    assert residue.residue(empty, "doc_id", "text", residue.fit(empty, "text")).count() == 0


TALK = ["Про ошибку 404 у нас шутят каждый вторник.", "На прошлой неделе сервер лежал, и друзья пошли гулять.", "В письме слово null стояло вместо фамилии, это насмешило деда.", "Дизайнер вставил Lorem ipsum, а заказчик его похвалил.", "I disabled JavaScript and the forum became faster for me."]


@pytest.mark.parametrize("text", TALK)
def test_talk_is_not_trusted(text):
    assert not residue.is_trusted(text)


@pytest.mark.parametrize("text", ["Доступ запрещён.", "Your session has expired, please log in again", "Ждём вас, {{ first_name }}!", "Цена: undefined", "Lorem ipsum dolor sit amet", "zxcvb asdfg qwerty", "Скрипты отключены, включите JavaScript"])
def test_residue_is_trusted(text):
    assert residue.is_trusted(text)


def test_unseen_residue(spark):
    """Messages that are not trusted by themselves are found by what they share with trusted ones; talk in the same words is not."""
    rng = random.Random(17)
    plain = lambda: ". ".join(f"{rng.choice(['Сюжет', 'Звук', 'Финал'])} {rng.choice(['держится', 'живёт', 'спорит'])} {rng.choice(['на идее', 'без спешки', 'с игроком'])} {rng.randrange(99)} раз" for _ in range(4)) + "."
    junk = ["Страница не найдена.", "Доступ к странице ограничен.", "Сервер временно недоступен, попробуйте позже.", "Включите JavaScript для просмотра.", "Привет, {{ name }}!"]
    rows = [(i, plain() + " " + TALK[i % 5]) for i in range(200)] + [(1000 + i, plain() + " " + junk[i % 5]) for i in range(60)] + [(2000 + i, plain() + " Страница временно недоступна для гостей.") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in residue.residue(df, "doc_id", "text", residue.fit(df, "text")).collect()}
    assert {1000 + i for i in range(60)} <= got and not got & set(range(200))
    assert got & set(range(2000, 2005))


def test_best_fit_is_the_tightest():
    rng = random.Random(3)
    for per_source in (None, 2):
        bins, mine = packing.Bins(50, per_source), []
        for _ in range(400):
            size, cluster, source = rng.randrange(1, 51), rng.randrange(60), rng.randrange(3)
            fits = [b for b in mine if b["left"] >= size and cluster not in b["clusters"] and (per_source is None or b["sources"].count(source) < per_source)]
            got = bins.put(size, cluster, source)
            if fits:
                assert mine[got]["left"] == min(b["left"] for b in fits) and mine[got] in fits
            else:
                assert got == len(mine)
                mine.append({"left": 50, "clusters": set(), "sources": []})
            b = mine[got]
            b["left"] -= size
            b["clusters"].add(cluster)
            b["sources"].append(source)
            assert b["left"] >= 0


def test_packing(spark):
    rng = random.Random(5)
    rows = [(i, "слово " * rng.randrange(1, 60) + str(i), "a" if i % 3 else None) for i in range(400)]
    rows += [(1000 + i, "одно и то же " * 5, "b") for i in range(40)] + [(2000, "длинный текст " * 3000, "b"), (2001, None, "b"), (2002, "", None), (5, rows[5][1], "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    items = packing.sized(df, "doc_id", "text", "source", f"{packing.TOKENIZERS}/byte_bpe_multi_50k.tiktoken")
    sizes = {}
    for r in items.collect():
        sizes.setdefault(r.doc_id, []).append((r.size, r.cluster))
    assert 2001 not in sizes and 2002 not in sizes
    for group_rows in (8192, 100):
        got = packing.pack(items, 256, group_rows=group_rows).collect()
        bins, docs = {}, {}
        for r in got:
            bins.setdefault(r.container, []).append(r)
            docs[r.doc_id] = docs.get(r.doc_id, 0) + r.n_tokens
        assert docs == {d: sum(s for s, _ in v) for d, v in sizes.items()}
        assert all(sum(r.n_tokens for r in b) <= 256 for b in bins.values())
        split = {r.doc_id for r in got if r.piece > 0}
        assert split == {d for d, v in sizes.items() if v[0][0] > 256}
        for b in bins.values():
            same = [sizes[r.doc_id][0][1] for r in b]
            assert len(same) == len(set(same))
    # forty copies can't share containers; the others leave hardly any room
    used = packing.report(packing.pack(items.filter("doc_id < 1000"), 256), 256).first().used_share
    assert used > 0.97
    assert packing.pack(items.limit(0), 256).count() == 0
    with pytest.raises(ValueError):
        packing.pack(items, 0)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_tokenizers(name):
    count = packing.encoder(f"{packing.TOKENIZERS}/{name}")
    assert count(["", "слово и слово"])[0] == 0 and count(["слово и слово"])[0] > 2


def test_tokenizer_kinds_agree():
    a, b = (packing.encoder(f"{packing.TOKENIZERS}/{n}") for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken"))
    texts = ["It's a tidy map, isn't it?  Да.\n", "Привет 123 мир"]
    assert a(texts) == b(texts)


def test_sources_in_containers(spark):
    rng = random.Random(8)
    items = [(i, f"s{i % 3}", i, rng.randrange(1, 30)) for i in range(300)]
    df = spark.createDataFrame(items, "doc_id long, source string, cluster long, size long")
    of = {i: s for i, s, _, _ in items}
    for per_source in (1, 4):
        bins = {}
        for r in packing.pack(df, 100, per_source=per_source).collect():
            bins.setdefault(r.container, []).append(of[r.doc_id])
        assert max(max(map(b.count, b)) for b in bins.values()) == per_source


def test_recall_of_candidates(spark):
    """Quotes with odd words and slips: what retrieval and seeds find of what aligning every pair finds."""
    rng = random.Random(21)
    passages = [(i, sentence(rng, 40)) for i in range(15)]
    docs = []
    for i in range(300):
        quote = passages[i % 15][1].split()[rng.randrange(14) :][: rng.randrange(12, 26)]
        for _ in range(rng.randrange(4)):
            at, how = rng.randrange(len(quote)), rng.random()
            if how < 0.5:
                quote[at] = quote[at][:-1] + "эюя"[rng.randrange(3)]
            elif how < 0.8:
                quote[at] = rng.choice(VOCABULARY)
            else:
                del quote[at]
        words = sentence(rng, 50).split()
        words[25:25] = quote
        docs.append((i, " ".join(words)))
    cut = {p: leaks.words_of(t) for p, t in passages}
    truth = {(i, p) for i, t in docs for p, w in cut.items() if leaks.longest_quote(leaks.words_of(t), w, 12) >= 12}
    got = {(r.doc_id, r.passage_id) for r in leaks.found(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(passages, "passage_id long, text string"), "passage_id", "text").collect()}
    assert len(truth) > 150 and len(got & truth) / len(truth) >= 0.97 and got <= truth


def test_blocks_of_passages(spark, monkeypatch):
    rng = random.Random(22)
    passages = [(i, sentence(rng, 30)) for i in range(12)]
    docs = [(i, sentence(rng, 10) + " " + passages[i % 12][1] + " " + sentence(rng, 10)) for i in range(36)]
    args = spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(passages, "passage_id long, text string"), "passage_id", "text"
    whole = sorted(map(tuple, leaks.found(*args).collect()))
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 1000)
    assert sorted(map(tuple, leaks.found(*args).collect())) == whole and len(whole) == 36
