import random
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import canon
from weftline.llm.canon import canonical


@pytest.mark.parametrize(
    "a, b",
    [
        ("Мой брат", "Moй бpaт"),
        ("Согласен, но", "Согласен, но"),
        ("музыку", "муз‌ы­ку"),
        ("ёлка йод", unicodedata.normalize("NFD", "ёлка йод")),
        ("Runs fine 12!", "Ｒｕｎｓ　ｆｉｎｅ １２！"),
        ("из-за", "из‑за"),
        ("Жанр рока", "Жанρ ροка"),
        ("ПК", "ΠК".replace("Π", "П")),
        ("й", "и‍̆"),
    ],
)
def test_look_alikes_become_equal(a, b):
    assert canonical(a) == canonical(b)


@pytest.mark.parametrize("a, b", [("а б", "а  б"), ("А", "а"), ("а.", "а!"), ("a\nb", "a\r\nb"), ("&amp;", "&"), ("a\tb", "a b"), ("е", "ё"), ("3", "З"), ("…", "...")])
def test_seen_differences_stay(a, b):
    assert canonical(a) != canonical(b)


def test_script_of_words():
    assert canonical("cыр") == "сыр" and canonical("mоon") == "moon"
    assert canonical("It is а tidy map.") == "It is a tidy map."
    assert canonical("Нy и концовка. It is а map.") == "Ну и концовка. It is a map."
    assert canonical("а") == canonical("a") == "а"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="абвеёйорсaeopcxyBHKM .-12​ ̆̈ο", max_size=30))
def test_applying_twice_changes_nothing(text):
    assert canonical(canonical(text)) == canonical(text)


def test_random_disguise():
    rng = random.Random(3)
    swap = {"а": "aα", "е": "e", "о": "oο", "р": "pρ", "с": "c", "х": "x", "у": "y", " ": "   "}
    plain = "Спроси у соседа, он в обед разбирался в графике и музыке"
    for _ in range(200):
        out = "".join(rng.choice(swap[c]) if c in swap and rng.random() < 0.5 else c for c in plain)
        out = "".join(c + (rng.choice("​⁠­") if rng.random() < 0.1 else "") for c in out)
        assert canonical(out) == plain


def test_conflicts_are_refused():
    t = canon.Transducer()
    with pytest.raises(ValueError):
        t._put(" ", "x")


def test_pairs(spark):
    rows = [
        (1, "один два", "три", "x"), (2, "один два", "три", "y"), (3, "один два", "три", None), (4, "один два", "тpи", "z"),
        (5, None, "три", ""), (6, "один два", "", ""), (7, "", "", ""), (8, "ж" * 50_000, "о", ""), (9, "ж" * 50_000, "o", ""), (2, "один два", "три", "y"),
    ]
    df = spark.createDataFrame(rows, "row_id long, parent_comment string, child_comment string, form string")
    got = sorted(map(tuple, canon.look_alike_pairs(df, "row_id", "parent_comment", "child_comment").collect()))
    assert got == sorted([(1, 2), (1, 2), (2, 3), (2, 3), (1, 4), (2, 4), (2, 4), (3, 4), (8, 9)])
    assert canon.look_alike_pairs(df.limit(0), "row_id", "parent_comment", "child_comment").count() == 0


def test_hot_form_is_salted(spark, monkeypatch):
    from weftline.plans import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 5)
    df = spark.createDataFrame([(i, "он и она", "да" if i % 2 else "дa") for i in range(30)], "row_id long, a string, b string")
    assert canon.look_alike_pairs(df, "row_id", "a", "b").distinct().count() == 15 * 15


def test_columns(spark):
    df = spark.createDataFrame([("cыр", None, 1)], "a string, b string, form int")
    assert tuple(canon.canonical_text(df, "a", "b").first()) == ("сыр", None, 1)


def test_classes(spark, monkeypatch):
    from weftline.plans import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 5)
    rows = [(i, "он и она", "да" if i % 2 else "дa") for i in range(30)] + [(40, "сам", "ок"), (41, "сам", "ок"), (42, None, "ок")]
    got = canon.look_alike_classes(spark.createDataFrame(rows, "row_id long, a string, b string"), "row_id", "a", "b").collect()
    assert len(got) == 30 and {(r.class_id, r.n_rows, r.n_spellings) for r in got} == {(0, 30, 2)} and len({r.spelling for r in got}) == 2
