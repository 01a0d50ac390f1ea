"""Row filters with counted reasons. Of several rules the first that fails gives the reason; null is kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.functions import udfs

# Phrases by which a prompt leans on something that isn't in it.
HIDDEN_CONTEXT = "(?:на|в) (?:фото|картинке|скрине|скриншоте)|слева|справа|выше (?:же|напис)|ниже (?:же|напис)|автор (?:поста|статьи)|в (?:посте|статье)|этот коммент|на второй|на первой|тот случай"
DEICTIC = "^(вот именно|и этот|и эта|и он|и она|он опять|она опять|это после|ну выше|тот самый)( |$)"
SHORT_REFERENCE = "^(он|она|они|этот|эта|эти|там|тут|это тоже|так и)( |$)"
# Links and markup, stock phrases, topics, and words that point outside.
LINK = r"https?://|@|<\|"
BOILERPLATE_START = "^(конечно|давайте разберемся|как ии|как искусственный интеллект|в качестве ии)"
BOILERPLATE = ("как искусственный интеллект", "не могу ответить без контекста")
TOPIC = "игр|гейм|скайрим|ведьмак|киберпанк|дота|doom|skyrim|фильм|кино|сериал|консол|айфон|телефон|наушник|видеокарт|ремейк|график|сюжет|steam|ps5|ps4|xbox|мультик|аниме|персонаж|компьютер|ноутбук"
POINTING = "он|она|они|эти|эта|этот|этого|этой|этом|этим|такое|такие|там|тут|выше|ниже|слева|справа|написано|писал|пост|автор|спойлернул"


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule whose condition holds, else null. A null condition doesn't hold."""
    out = None
    for name, when in rules:
        out = F.when(when, F.lit(name)) if out is None else out.when(when, F.lit(name))
    return out


def counts(df: DataFrame, reason: str = "reason", *by: str) -> DataFrame:
    return df.groupBy(*by, F.coalesce(F.col(reason), F.lit("kept")).alias(reason)).agg(F.count("*").alias("n_rows"))


def pair_reasons(df: DataFrame, parent: str, response: str, identity: Column, order: str, clean: Callable[[Column], Column] = T.clean, max_parent: int = 1600, max_response: int = 1200) -> DataFrame:
    """Raw pairs with cleaned texts and a reason: deleted_or_empty, too_long, echo, duplicate. udfs.clean_text cleans entities and forms too."""
    from weftline.operators.dedup import mark_repeats

    df = df.withColumns({"parent_clean": clean(F.col(parent)), "response_clean": clean(F.col(response))})
    p, r = F.col("parent_clean"), F.col("response_clean")
    df = df.withColumn("reason", first_reason(
        ("deleted_or_empty", p.isNull() | r.isNull()),
        ("too_long", (F.char_length(p) > max_parent) | (F.char_length(r) > max_response)),
        ("echo", T.fold(p) == T.fold(r)),
    ))
    return mark_repeats(df, identity, order, "duplicate")


def child_identity(child_id: str, parent: str, response: str) -> Column:
    """What makes two pairs one: the child's id if above 0, else both texts."""
    has = F.coalesce(F.col(child_id) > 0, F.lit(False))
    return F.struct(has.alias("by_id"), F.when(has, F.col(child_id)).alias("id"), F.when(~has, F.col(parent)).alias("p"), F.when(~has, F.col(response)).alias("r"))


def sft_reasons(df: DataFrame, prompt: str, response: str, order: str, excluded: DataFrame, excluded_prompt: str, max_prompt: int = 800, max_response: int = 600, max_sentences: int = 3, clean: Callable[[Column], Column] = T.clean, resample: bool = False) -> DataFrame:
    """Training pairs with a reason: empty, too_long, leak (an excluded prompt in any case), echo, sentences, duplicate.

    With `resample` repeated pairs stay, under the reason resampled_duplicate.
    """
    from weftline.operators.dedup import mark_repeats

    p, r = F.col("prompt_clean"), F.col("response_clean")
    df = df.withColumns({"prompt_clean": clean(F.col(prompt)), "response_clean": clean(F.col(response))}).withColumn("_key", T.fold(p))
    out = excluded.select(T.fold(clean(F.col(excluded_prompt))).alias("_key")).filter("_key IS NOT NULL").distinct().withColumn("_leak", F.lit(True))
    df = df.join(out, "_key", "left").withColumn("reason", first_reason(
        ("empty", p.isNull() | r.isNull()),
        ("too_long", (F.char_length(p) > max_prompt) | (F.char_length(r) > max_response)),
        ("leak", F.col("_leak")),
        ("echo", T.fold(p) == T.fold(r)),
        ("sentences", T.sentence_count(r) > max_sentences),
    ))
    return mark_repeats(df, F.struct(F.col("_key"), T.fold(r)), order, "resampled_duplicate" if resample else "duplicate").drop("_key", "_leak")


def import_reasons(df: DataFrame, prompt: str, response: str, order: str, max_response: int = 350, max_sentences: int = 3, clean: Callable[[Column], Column] = T.clean) -> DataFrame:
    """Generated replies with a reason: empty, too_long, sentences, boilerplate, duplicate."""
    from weftline.operators.dedup import mark_repeats

    p, r = F.col("prompt_clean"), F.col("response_clean")
    df = df.withColumns({"prompt_clean": clean(F.col(prompt)), "response_clean": clean(F.col(response))})
    stock = F.lit(False)
    for x in BOILERPLATE:
        stock = stock | T.fold(r).contains(x)
    df = df.withColumn("reason", first_reason(
        ("empty", p.isNull() | r.isNull()),
        ("too_long", F.char_length(r) > max_response),
        ("sentences", T.sentence_count(r) > max_sentences),
        ("boilerplate", stock),
    ))
    return mark_repeats(df, F.struct(T.fold(p), T.fold(r)), order, "duplicate")


def prompt_rejection(prompt: Column, chars: tuple = (8, 420), words: tuple = (2, 75), letters: int = 4, alphabet: str = "а-яё") -> Column:
    """Why a prompt can't stand alone, or null."""
    text, n = T.normalized(prompt), F.size(T.words(prompt))
    return first_reason(
        ("length", ~F.char_length(prompt).between(*chars) | ~n.between(*words)),
        ("not_russian", T.letter_count(prompt, alphabet) < letters),
        ("link_or_markup", F.regexp_like(prompt, F.lit(LINK))),
        ("hidden_context", F.regexp_like(text, F.lit(HIDDEN_CONTEXT))),
        ("deictic_fragment", F.regexp_like(text, F.lit(DEICTIC))),
        ("short_reference", (n <= 7) & F.regexp_like(text, F.lit(SHORT_REFERENCE))),
    )


def response_rejection(prompt: Column, response: Column, chars: tuple = (5, 320), letters: int = 4, alphabet: str = "а-яё", repeats: float = 0.1, sentences: int = 3, copies: bool = True) -> Column:
    """Why a response can't be used, or null. With `copies` the longest shared run is measured too (an Arrow UDF)."""
    text = T.normalized(response)
    copy = udfs.prompt_copy(prompt, response) if copies else T.exact_echo(prompt, response) | (T.prefix_echo(prompt, response) & (F.size(T.words(prompt)) >= 2))
    return first_reason(
        ("response_length", ~F.char_length(response).between(*chars)),
        ("not_russian", T.letter_count(response, alphabet) < letters),
        ("boilerplate", F.regexp_like(text, F.lit(BOILERPLATE_START))),
        ("prompt_copy", copy),
        ("repetition", T.repeat_rate(T.words(response)) > repeats),
        ("too_many_sentences", T.sentence_count(response) > sentences),
    )


def on_topic(prompt: Column, chars: tuple = (12, 150), topic: str = TOPIC, pointing: str = POINTING) -> Column:
    """A short prompt of one line that names its topic and points at nothing outside."""
    x = F.lower(prompt)
    return F.char_length(prompt).between(*chars) & ~prompt.contains("\n") & F.regexp_like(x, F.lit(topic)) & ~F.regexp_like(x, F.lit(rf"(^|[^\p{{L}}\p{{N}}_])({pointing})([^\p{{L}}\p{{N}}_]|$)"))
