import difflib
import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from weftline.functions import bpe
from weftline.functions import text as T
from weftline.functions import udfs
from weftline.operators import filters, joins

EDGE = [None, "", " ", "a", "Ёлка вечен? a_b 42", "е́ ё", "x y", "a\r\nb\rc", "\n\n\n\na\n\n\n\nb\t\tc \x0b d\x0c", "Straße ß", "İstanbul", "😀 ok!", "&lt;b&gt; &amp;amp; &nbsp;x", "ﬁne ①", "Комментарий недоступен.", "тут КОММЕНТАРИЙ УДАЛЕН АВТОРОМ ПОСТА вот", "  a  \n  b  ", "слово " * 3000]
MARKERS = T.DELETED_MARKERS


def tidy(x):
    if x is None:
        return None
    x = x.replace("\r\n", "\n").replace("\r", "\n")
    x = "\n".join(re.sub(r"[ \t\v\f]+", " ", line).strip(" ") for line in x.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", x).strip(" \n") or None


def full(x):
    if x is None:
        return None
    x = tidy(unicodedata.normalize("NFKC", html.unescape(x)))
    return None if x is None or any(m in x.casefold() for m in MARKERS) else x


def words(x):
    return re.findall(r"\w+", x.casefold().replace("ё", "е"))


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(EDGE)), "id int, x string").cache()


def values(df, column):
    return [r[0] for r in df.orderBy("id").select(column).collect()]


def test_tidy_and_clean(rows):
    assert values(rows, T.tidy(F.col("x"))) == [tidy(x) for x in EDGE]
    want = [None if x is None or tidy(x) is None or any(m in tidy(x).casefold() for m in MARKERS) else tidy(x) for x in EDGE]
    assert values(rows, T.clean(F.col("x"))) == want
    assert values(rows, udfs.clean_text(F.col("x"))) == [full(x) for x in EDGE]


def test_clean_random(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("aб \n\t\r\x0bё&;.!") for _ in range(rng.randrange(40))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, x string")
    assert values(df, T.tidy(F.col("x"))) == [tidy(x) for x in texts]
    assert values(df, udfs.clean_text(F.col("x"))) == [full(x) for x in texts]


def test_words(rows):
    plain = [(i, x) for i, x in enumerate(EDGE) if x is not None and "İ" not in x and "́" not in x and "ﬁ" not in x]
    got = values(rows, T.words(F.col("x")))
    assert got[0] is None and all(got[i] == words(x) for i, x in plain)
    assert values(rows, T.normalized(F.col("x")))[4] == "елка вечен a_b 42"


def test_counts(rows, spark):
    df = spark.createDataFrame([(0, "Да. Нет!! Что?\nТут 3.5 балла"), (1, ""), (2, None)], "id int, x string")
    assert values(df, T.sentence_count(F.col("x"))) == [3, 0, None]
    assert values(df, T.letter_count(F.col("x"))) == [16, 0, None]


def test_ids(spark):
    df = spark.createDataFrame([(0, "Да", ""), (1, "Да", "given"), (2, "Да", None)], "id int, x string, g string")
    import hashlib

    digest = hashlib.sha256("Да".encode()).hexdigest()
    assert values(df, T.coalesce_id(F.col("g"), F.col("x"))) == [digest, "given", digest]
    assert values(df, T.content_id(F.col("x"), "p-")) == ["p-" + digest[:24]] * 3
    assert values(df, udfs.blake2_id(F.col("x")))[0] == hashlib.blake2b("Да".encode(), digest_size=16).hexdigest()
    assert values(df, udfs.blake2_bucket(100)("x"))[0] == int.from_bytes(hashlib.blake2b("Да".encode(), digest_size=8).digest(), "little") % 100


def test_small_forms(spark):
    df = spark.createDataFrame([(0, "```json\n{\"a\": 1}\n```"), (1, "{}"), (2, None)], "id int, x string")
    assert values(df, T.strip_fence(F.col("x"))) == ['{"a": 1}', "{}", None]
    one = spark.range(1)
    assert one.select(T.fill(F.lit("{g} и {w}"), g=F.lit("а"), w=F.lit("б"))).first()[0] == "а и б"
    assert one.select(T.lower_first(F.lit("Давай"))).first()[0] == "давай"
    assert one.select(T.serialize(F.lit("а"), F.lit("б"))).first()[0] == "<user>а<assistant>б"
    assert one.select(T.topic_hit(F.lit("Ёлка тут"), F.array(F.lit("елк"), F.lit("нет")))).first()[0]


def test_repeats(spark):
    lists = [[], ["a"], ["a", "b", "c"], list("abcabc"), list("aaaaaa"), None]
    df = spark.createDataFrame(list(enumerate(lists)), "id int, x array<string>")

    def rate(x):
        g = [tuple(x[i : i + 3]) for i in range(len(x) - 2)]
        return 1 - len(set(g)) / len(g) if g else 0.0

    assert values(df, T.repeat_rate(F.col("x"))) == [None if x is None else rate(x) for x in lists]


def longest(a, b):
    return difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size


def test_copies(spark):
    rng = random.Random(2)
    pairs = [(" ".join(rng.choice("абвг") for _ in range(rng.randrange(12))), " ".join(rng.choice("абвг") for _ in range(rng.randrange(12)))) for _ in range(300)]
    pairs += [("Скайрим", "Скайрим"), ("Во что играть вечером", "Во что играть вечером? В шахматы"), ("Скайрим", "скайрим лучше всех"), ("Какая игра лучше всех на свете", "Какая игра лучше всех в мире"), ("", ""), ("а б", "а б")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, p string, r string")
    got = values(df, udfs.prompt_copy(F.col("p"), F.col("r")))
    for (p, r), g in zip(pairs, got):
        pw, rw = words(p), words(r)
        exact, prefix, run = bool(pw) and pw == rw, bool(pw) and rw[: len(pw)] == pw, longest(pw, rw)
        assert g == (exact or (prefix and len(pw) >= 2) or (len(pw) >= 5 and run >= 5 and run / len(pw) >= 0.8))


def test_rejections(spark):
    cases = [
        ("Что?", "length"), ("What is the best game ever", "not_russian"), ("Смотри https://x.ru и скажи", "link_or_markup"), ("Что на фото у этого парня", "hidden_context"),
        ("Вот именно так и надо делать", "deictic_fragment"), ("Он хороший или плохой", "short_reference"), ("Во что поиграть вечером с другом?", None), (None, None),
    ]
    df = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "id int, p string")
    assert values(df, filters.prompt_rejection(F.col("p"))) == [r for _, r in cases]
    cases = [
        ("Вопрос про игру", "Да", "response_length"), ("Вопрос про игру", "It is fine there", "not_russian"), ("Вопрос про игру", "Конечно, давайте обсудим", "boilerplate"), ("Во что играть вечером", "Во что играть вечером", "prompt_copy"),
        ("Вопрос", "да да да да да да да да", "repetition"), ("Вопрос", "Раз тут. Два тут. Три вот. Четыре же.", "too_many_sentences"), ("Вопрос", "Лучше в шахматы", None),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "id int, p string, r string")
    assert values(df, filters.response_rejection(F.col("p"), F.col("r"))) == [c[2] for c in cases]


def test_near_equal(spark):
    near = joins.NearList(["во что поиграть вечером", "какой фильм посмотреть с другом"])
    assert near.has("во что поиграть вечером") and near.has("во что поиграть вечерком") and not near.has("во что сыграть утром") and not near.has("")
    rng = random.Random(3)
    vocabulary = "что как где игра фильм вечером утром лучше хуже вот".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 8))) for _ in range(150)]
    listed = texts[:30]

    def brute(value):
        w = set(value.split())
        for other in listed:
            if value == other:
                return True
            o = set(other.split())
            if abs(len(value) - len(other)) <= max(8, len(value) // 4) and len(w & o) >= min(len(w), len(o)) * 0.5 and difflib.SequenceMatcher(None, value, other).ratio() >= 0.88:
                return True
        return False

    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, p string")
    ex = spark.createDataFrame([(t,) for t in listed], "q string")
    assert values(joins.mark_near(df, "p", ex, "q"), "near") == [brute(t) for t in texts] + [False]
    assert values(joins.mark_near(df, "p", ex.limit(0), "q"), "near") == [False] * 151


def test_encoding(spark):
    import base64

    import tiktoken

    with open(bpe.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", "Привет, мир! It's 42  ok\n\n", "й и й", "😀" * 3, "аб" * 2000]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, x string").withColumn("ids", bpe.encode(F.col("x")))
    nfc = [None if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert values(df, "ids") == [None if t is None else lib.encode_ordinary(t) for t in nfc]
    assert values(df, bpe.decode(F.col("ids"))) == nfc
    assert bpe.merges().decode([10**9]) == ""
