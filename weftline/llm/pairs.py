"""P3: broken prompt and response pairs, found by a multi-label linear classifier.

Features of a pair are hashed n-grams of the response and dense pair features: how much of the
prompt the response repeats, how the languages of the two differ, whether its last words end a
sentence elsewhere or its last word is the beginning of others, and whether anything readable
stands there. The classifier is trained on responses broken on purpose: cut off, copied from the
prompt, swapped with a response in another language, replaced by a composed refusal, emptied.

Scores are calibrated: a logistic curve is fitted to cross-fitted scores of the broken against the
real rows, the share of each defect among the real rows is estimated by expectation-maximization,
and a row is flagged when its posterior is above one half; of several defects the surest counts.

All different pairs are broken and learned from. Where they are more than one block, each block
(by hash of the pair) is broken by itself and goes on from the common weights; what the blocks
learned is averaged, each weight by how much a block had to say of it, and handed out again. A pair
is scored by weights that were fitted without its fold, so no pair vouches for itself; calibration
reads the scores of all pairs, as histograms. The counts of sentence ends are taken over all different pairs and kept exactly, in a Spark table by
64-bit key that the rows' own ends are joined to. Only places inside sentences and ends with a mark
are counted, and a pair counts once however many rows hold it, so neither a cut response nor a copy
of it vouches for it, however large the table is.

A null response is empty. A null prompt is taken as an empty one: it can't be copied and has no
language. Texts of any length are read whole. Ties go to the defect named first in DEFECTS. An
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm import learn
from weftline.llm.canon import canonical
from weftline.plans.runtime import cut, hot_keys, salted_join

DEFECTS = ["empty", "copy", "language", "refusal", "truncated"]

# What stands for an empty text, by its letters and digits in lower case.
STAND_INS = """
null none nil nan na undefined br nbsp amp удалено удален удалена deleted removed empty пусто нетданных нетответа безответа noanswer noresponse nodata notavailable
комментарийудален сообщениеудалено commentdeleted commentremoved
""".split()

# The most frequent function words of some languages.
COMMON = {
    "ru": "и в не на что с по как это то все она так его но да ты к у же вы за бы только мне было вот от меня еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас там потом себя ничего ей может они тут где есть надо для мы тебя их чем была сам чтоб без будто чего раз тоже себе под будет ж тогда кто этот потому какой про при об над под через между после перед ради кроме вместо такой такие эта эти это себя чтобы который будет где здесь",
    "uk": "і в не на що з як це то та але так ти до у ж ви за б тільки мені було від мене ще ні про із йому тепер коли навіть чи якщо вже або бути був він вона вони там потім себе нічого може тут де є треба для ми тебе їх ніж бо хоча дуже якраз зараз надто",
    "be": "і ў не на што з як гэта але так ты да у ж вы за б толькі мне было ад мяне яшчэ не пра яму цяпер калі нават ці калі ўжо або быць быў ён яна яны там потым нічога можа тут дзе ёсць трэба для мы цябе іх чым бо вельмі",
    "en": "the of and to in is it you that was for on are with as they be at one have this from or had by but not what all were when your can said there use an each which she do how their if will up other about out many then them these so some her would make like him into has look more write go see no way could my than been call who its now find down did get come made may part a i me just really only",
    "de": "der die das und ist nicht ich es ein eine zu in den mit auf für von dem sich des auch an als hat er sie wie bei nur noch nach man aber so wenn über mir mich dort etwas ohne war haben wird sind oder aus kann schon dann doch mehr sehr immer",
    "pl": "nie się na w z i do że jest to jak ale co za po tak od był była było bardzo mi teraz bo tam może już tylko przez dla przy ich jego czy zbyt można są ma być lub kiedy jeszcze więcej który która mnie",
    "fr": "le la les de des et est un une je tu il elle nous vous que qui dans pour pas sur avec plus ce cette mais ou très au aux ne se son sa ses en on par comme être avoir fait si tout bien aussi",
    "es": "el la los las de y es un una yo que en por para no con más pero muy se lo como su esta este está al del si ya me le ha son ser hay todo también cuando sin sobre",
    "it": "il lo la gli le di e è un una che in per non con più ma molto si come su questo questa al del della se mi ha sono essere anche tutto quando senza alla",
    "pt": "o a os as de e é um uma que em por para não com mais mas muito se como seu sua este esta ao do da no na já me foi são ser também quando sem isso você",
}
COMMON = {k: frozenset(v.split()) for k, v in COMMON.items()}

# Parts that refusals are composed of; {} stands for what it is about.
REFUSAL_PARTS = {
    "ru": {
        "opening": "||||Извините, |Простите, |К сожалению, |Увы, |Сожалею, но |Боюсь, |Прошу прощения, |Мне очень жаль, но |Нет, |Извините, но |Простите, но ",
        "act": """я не могу ответить на этот вопрос|я не могу обсуждать {}|я не могу говорить о {}|не могу помочь с этим|не могу выполнить эту просьбу|я не смогу помочь|не смогу ответить на такой вопрос|ответить на это невозможно|ответить не получится|я отказываюсь отвечать|вынужден отказаться отвечать|вынужден отказать|я не стану отвечать на это|не буду это комментировать|я не комментирую {}|я не отвечаю на подобные вопросы|на такие темы я не разговариваю|подобные темы я не обсуждаю|я не даю советов про {}|я не имею права обсуждать {}|мне не разрешено говорить о {}|мне запрещено обсуждать {}|у меня нет возможности ответить про {}|у меня нет права отвечать на это|я не вправе высказываться о {}|я воздержусь от ответа|предпочитаю не отвечать|предпочту не обсуждать {}|такие просьбы мне не по силам|это вне моей компетенции|такой вопрос за пределами того, что я умею|эта тема за рамками моих задач|отвечать на такое не в моих правилах|этот запрос нарушает правила, отвечать я не стану|такой запрос противоречит правилам|я не располагаю такой информацией и ответить не могу|такая информация мне недоступна""",
        "self": "как языковая модель, я не имею мнения о {}|я языковая модель и не могу иметь мнения о {}|я всего лишь программа и не могу судить о {}|как искусственный интеллект, я не высказываю мнений про {}|будучи ботом, я не могу оценивать {}|как виртуальный помощник, я не обсуждаю {}|у программы не бывает мнения о {}",
        "redirect": "||||||. Лучше спросите специалиста|. Давайте поговорим о другом|. Давайте сменим тему|. Задайте другой вопрос|. Спросите что-нибудь другое|. Могу помочь с другой темой|, это против правил|, это запрещено правилами|, это не входит в мои задачи|. Спасибо за понимание|. Всего доброго",
    },
    "en": {
        "opening": "||||I'm sorry, but |Sorry, |Unfortunately, |I apologize, but |I'm afraid |My apologies, but |No, ",
        "act": """I can't help with that|I cannot answer this question|I can't discuss the {}|I'm unable to talk about the {}|I am not able to assist with this request|I won't answer that|I will not comment on the {}|I have to decline this request|I must decline to answer|I refuse to answer|I'd rather not talk about the {}|I would prefer not to discuss the {}|I am not allowed to discuss the {}|I'm not permitted to give advice on the {}|I don't have an answer for that|I do not give advice about the {}|this request is against the rules and I won't answer it|this is not something I can help with|that is beyond what I am able to do|I can't comply with this request""",
        "self": "as a language model I have no opinion on the {}|as an AI I cannot have opinions about the {}|I'm just a language model and cannot judge the {}|as an assistant I do not comment on the {}|I am only a bot and can't evaluate the {}",
        "redirect": "||||||. Please consult a professional|. Please ask about something else|. Let's change the subject|. Ask me another question|, it is against the rules|, it violates the policy|. Thank you for understanding|. Is there anything else I can help with?",
    },
}
REFUSAL_PARTS = {lang: {k: [x.strip("\n") for x in v.split("|")] for k, v in parts.items()} for lang, parts in REFUSAL_PARTS.items()}

# Beginnings of words that refusals are made of, in lower case with е for ё.
REFUSAL_STEMS = """
извин простите прости сожален увы боюсь жаль могу смог возможност невозможн получит отказ вынужден запре запрещ разреш нельзя вправе права имею воздерж предпоч стану буду ответ отвеч обсужд говор рассужд коммент помо совет высказ мнени судить оцен запрос просьб вопрос тема тему темы темам правил огранич рамк задач информац данны доступ недоступ языков модел искусствен интеллект ассистент помощник бот программ специалист обратит смен друго спрос задай общаю выполн разгов личн отношени подобн политик этик безопасн нейтральн понимани противореч наруш расскаж располага даю
sorry unfortunately apolog afraid can cannot unable able help assist answer discuss talk comment declin refus allow permit request question rule polic opinion language model assistant bot advice professional subject information provid comply rather else something ask violat guideline understand prefer respond
""".split()
# Words of denial and of answering; a refusal denies an answer.
DENIALS = re.compile(r"(?<![а-яa-z])(?:не|нет|нельзя|невозможно|отказ\w*|запре\w*|воздерж\w*|недоступ\w*|вне|пределам\w*|рамк\w*|beyond|outside|not|no|never|cannot|can.?t|won.?t|don.?t|unable|declin\w*|refus\w*|rather|against)(?![а-яa-z])")
ANSWERS = re.compile(r"(?<![а-яa-z])(?:ответ\w*|отвеч\w*|обсужд\w*|говор\w*|рассужд\w*|коммент\w*|помо\w*|совет\w*|высказ\w*|мнени\w*|общаюсь|общаться|суди\w*|просьб\w*|запрос\w*|answer\w*|discuss\w*|talk\w*|comment\w*|help|assist|advi\w*|opinion\w*|respond|request)(?![а-яa-z])")
MACHINES = re.compile(r"(?<![а-яa-z])(?:языков\w+ модел\w+|искусственн\w+ интеллект\w*|я (?:всего лишь )?(?:бот|программа|модель|ассистент)|language model|as an ai|an? (?:ai )?assistant)(?![а-яa-z])")

# Function words that no sentence ends with.
NON_FINAL = {
    "ru": "и а но что чтобы если хотя потому который которая которое которые когда пока или либо в на с к у о об от до из за под над при про для без через между из-за как так чем ни ведь лишь чтоб со во ко будто то раз зато однако например причём поскольку",
    "en": "and or but because so that which who if when while although though the a an of in on at to for with from by as than into about over under between without is are was were be my your his her its our their very such like just",
}
NON_FINAL = {k: v.split() for k, v in NON_FINAL.items()}
_HANGING = frozenset(w for v in NON_FINAL.values() for w in v)

# What may stand before a repeated prompt.
BEFORE_COPIES = ["", "", "", "> ", "«", "Вопрос: ", "Вы написали: ", "Цитирую: ", "You wrote: ", "— "]

SIZE = 1 << 16
#: Parts of the pairs; each is scored by weights that the others taught.
FOLDS = 2
#: How often the blocks' weights are averaged in a fit, and how often a block is read between.
SYNCS, EPOCHS = 4, 3
#: Bins of the histograms of scores, and the largest score that they tell.
BINS, SPAN = 4096, 32.0
#: Different keys that a task counts before it passes them on.
HELD_KEYS = 200_000
#: Tokens of the longest context whose ends are counted.
CONTEXT = 6
#: More than this part of the texts that pass a place are not cut there.
CUT_HERE = 0.002
#: Features that count_features() gives.
COUNTED = 2 * CONTEXT + 12
_WORD = re.compile(r"[^\W\d_]+|\d+")
_TOKEN = re.compile(r"«[^«»\n]*»|[^\W\d_]+|\d+|[,:;«—–-]")
_LETTERS = re.compile(r"[^\W\d_]")
_ENDED = re.compile(r"[.!?…)][\s»\"”’]*$|[\U0001F300-\U0001FAFF☀-➿]\s*$")
_SENTENCE = re.compile(r"[.!?…)]+(?=[\s»\"”’]|$)|\n+")
_QUOTED = re.compile(r"«[^«»\n]*»|\"[^\"\n]*\"")
_SHAPES = {"en_only": re.compile(r"[a-z]"), "ru_only": re.compile(r"[а-яё]"), "uk_only": re.compile(r"[іїєґў]"), "marked": re.compile(r"[ąćęłńśźżäöüßéèêàçñ]")}


def is_empty(text: Column) -> Column:
    """Nothing readable, or only a stand-in for nothing. Null is empty."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")
    return (bare == "") | bare.isin(STAND_INS)


@lru_cache(maxsize=1 << 18)
def _h(x: str, size: int) -> int:
    return xxhash.xxh3_64_intdigest(x) % size


def _key(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x) - (1 << 63)


def _tokens(piece: str) -> list[str]:
    """Words, numbers and inner marks of a piece of a sentence, in lower case; numbers and quoted names are each one token."""
    return ["«»" if len(t) > 1 and t[0] == "«" else "0" if t.isdigit() else t for t in _TOKEN.findall(piece.lower())]


def _tails(tokens: list[str]) -> list[str]:
    """Keys of the end of a piece of a sentence: its last token, its last two, and so on; the beginning of the sentence is a token too."""
    full = ["^"] * (CONTEXT - len(tokens)) + tokens[-CONTEXT:]
    return [" ".join(full[-n:]) for n in range(1, CONTEXT + 1)] if tokens else []


def end_counts(df: DataFrame, text: str, parent: str | None = None) -> DataFrame:
    """(key, ends, inside) over all different pairs of parent and text: how often each tail ends a sentence with a mark and how often it stands inside one;
    for keys of word beginnings how often longer words begin so, for those of whole texts how many different parents they answer (both as `inside`)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends, inside = Counter(), Counter()

        def held() -> pa.RecordBatch:
            sums: dict[int, list[int]] = {}
            for at, counter in enumerate((ends, inside)):
                for x, n in counter.items():
                    sums.setdefault(_key(x), [0, 0])[at] += n
                    if " " not in x and x[0].isalpha():
                        for k in range(1, len(x)):
                            sums.setdefault(_key("*" + x[:k]), [0, 0])[1] += n
            ends.clear()
            inside.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([a for a, _ in sums.values()], pa.int64()), pa.array([b for _, b in sums.values()], pa.int64())], ["key", "ends", "inside"])

        for b in batches:
            for x, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                inside["= " + " ".join(_WORD.findall(x.lower()))] += n
                within, ending = [], []
                at, marks = 0, [(m.start(), m.end()) for m in _SENTENCE.finditer(x)]
                for start, end in [*marks, (len(x), len(x))]:
                    tokens = _tokens(x[at:start])
                    for i in range(1, len(tokens)):
                        within += _tails(tokens[:i]) if i < CONTEXT else _tails(tokens[i - CONTEXT : i])
                    if end > start:
                        ending += _tails(tokens)
                    at = end
                for counter, tails in ((inside, within), (ends, ending)):
                    for t in tails:
                        counter[t] += n
                if len(ends) + len(inside) > HELD_KEYS:
                    yield held()
        yield held()

    # copies of a row are no evidence
    parents = F.count_distinct(F.xxhash64(F.coalesce(F.col(parent), F.lit("")))) if parent else F.lit(1).cast("long")
    texts = df.filter(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(parents.alias("n"))
    counted = texts.mapInArrow(count, "key long, ends long, inside long")
    return counted.groupBy("key").agg(F.sum("ends").alias("ends"), F.sum("inside").alias("inside"))


def look_up(ends: DataFrame, keys: set[int]) -> dict[int, tuple[int, int]]:
    """The counts of the given keys, which are those of a bounded number of rows."""
    wanted = ends.sparkSession.createDataFrame(pa.table({"key": pa.array(sorted(keys), pa.int64())}))
    got = ends.join(wanted, "key").select("key", "ends", "inside").toArrow()
    return {k: (e, i) for k, e, i in zip(*(c.to_pylist() for c in got.columns))}


def count_features(keys: list[int], word: bool, counts: dict[int, tuple[int, int]], own: int = 0) -> list[float]:
    """What the counts say of a response's open end: `keys` are its tails, its last token as a beginning, and its whole text; none if it isn't open.

    `word` says that the last token is a word in lower case; `own` is how often the row's own uncut sentence was counted.
    All features are ratios of counts, which a larger table leaves as they are.
    """
    if not keys:
        return [0.0] * COUNTED
    found = [counts.get(k, (0, 0)) for k in keys]
    tails = [(e, max(0, i - own)) for e, i in found[:CONTEXT]]
    longer, whole = max(0, found[CONTEXT][1] - own), found[CONTEXT + 1][1]
    odds = [max(-4.0, min(4.0, log((e + 0.3) / (i + 0.3)))) if e + i >= 2 else 0.0 for e, i in tails]
    known = [float(e + i >= 2) for e, i in tails]
    sure = [n for n, (e, i) in enumerate(tails) if e + i >= 4]
    best = odds[sure[-1]] if sure else 0.0
    seen = sum(tails[0])
    part = max(-4.0, min(4.0, log((longer + 0.3) / (seen + 0.3)))) * word
    # answers to other parents against a small part of the texts that go on from here: a cut text recurs too as the table
    # grows, but more seldom than that
    going = tails[-1][1] if seen else longer
    usual = max(0.0, min(3.0, log((whole - 0.5) / (CUT_HERE * going + 1)))) if whole > 1 else 0.0
    return [*odds, *known, best, 3.0 * (best < -2), 3.0 * (best < -1), 3.0 * (best > 0.5), (sure[-1] + 1) / CONTEXT if sure else 0.0, part, 3.0 * (part > 1), 3.0 * (part > 3), float(not seen), usual, 3.0 * (usual > 1), min(odds)]


#: The languages, by number, of each frequent word.
_LANGUAGES: dict[str, list[int]] = {}
for _n, _c in enumerate(COMMON.values()):
    for _w in _c:
        _LANGUAGES.setdefault(_w, []).append(_n)


def _language(words: list[str], letters: str) -> np.ndarray:
    n, counts = max(1, len(words)), [0] * len(COMMON)
    for w in words:
        for k in _LANGUAGES.get(w, ()):
            counts[k] += 1
    return np.array([c / n for c in counts] + [len(r.findall(letters)) / max(1, len(letters)) for r in _SHAPES.values()], np.float32)


def _plain(text: str) -> list[str]:
    """Words that say which language a text is in: no quoted names, no words with a capital inside a sentence."""
    text = _QUOTED.sub(" ", text)
    return [m.group() for m in _WORD.finditer(text) if not m.group()[0].isupper() or not text[: m.start()].rstrip() or text[: m.start()].rstrip()[-1] in ".!?…)>"]


_STEM = re.compile(r"(?:" + "|".join(sorted(REFUSAL_STEMS, key=len, reverse=True)) + ")")
_SMALL = frozenset().union(*COMMON.values())


def refusing(response: str) -> list[float]:
    """How much of a sentence of the response is made of the words of refusals, whether it denies an answer, and whether a machine speaks."""
    response, best = response.replace("ё", "е"), [0.0] * 6
    for piece in _SENTENCE.split(response):
        words = [w for w in _WORD.findall(piece) if len(w) > 1]
        # small words say nothing, but for those that refusals are made of
        told = [bool(_STEM.match(w)) for w in words if w not in _SMALL or _STEM.match(w)]
        if len(words) < 3 or not told:
            continue
        share, denies = sum(told) / len(told), float(bool(DENIALS.search(piece)) and bool(ANSWERS.search(piece)))
        found = [share, 3.0 * (share >= 0.6), 3.0 * (share >= 0.75), share * denies, 3.0 * denies * (share >= 0.6), 3.0 * bool(MACHINES.search(piece))]
        best = [max(a, b) for a, b in zip(best, found)]
    return best


class Featurizer:
    """Features of a pair that need no counts, and the keys of those to count."""

    def one(self, parent: str | None, response: str | None) -> tuple[list[int], list[float], tuple[list[int], bool]]:
        response, parent = canonical(response or ""), canonical(parent or "")
        own_words, other_words = ([w.lower() for w in _plain(t)] for t in (response, parent))
        last = _WORD.findall(response)[-1:]
        parent, response = parent.lower(), response.lower()
        words, asked = _WORD.findall(response), _WORD.findall(parent)
        letters, asked_letters = "".join(_LETTERS.findall(response)), "".join(_LETTERS.findall(parent))
        bare = "".join(words)
        empty = not bare or bare in STAND_INS
        # repeated part
        share = run = 0.0
        if words and asked:
            common = set(words) & set(asked)
            if len(common) * 2 >= min(len(set(words)), len(set(asked))):
                m = SequenceMatcher(None, asked, words, autojunk=False)
                size = sum(x.size for x in m.get_matching_blocks())
                share = size / len(asked)
                run = size / len(words)
        n = len(COMMON)
        own, other = _language(own_words, "".join(own_words)), _language(other_words, "".join(other_words))
        enough = float(len(letters) >= 8 and len(asked_letters) >= 8 and len(own_words) >= 2)
        cyr, cyr_asked = own[n + 1], other[n + 1]
        best, best_asked = own[:n].argmax(), other[:n].argmax()
        foreign = enough * float(best != best_asked and own[best] > 0.15 and own[best] >= own[best_asked] + 0.1 and other[best_asked] > 0.1)
        # a function word of the prompt's language that the other language hasn't
        lists = list(COMMON.values())
        at_home = any(w in lists[best_asked] and (best == best_asked or w not in lists[best]) for w in own_words)
        known = float(own[:n].max())
        ended = float(bool(_ENDED.search(response)))
        open_ = 1.0 - ended
        pieces = _SENTENCE.split(response)
        tail = _tokens(pieces[-1]) if pieces else []
        keys = [_key(x) for x in _tails(tail)] + [_key("*" + tail[-1]), _key("= " + " ".join(words))] if tail and not ended else []
        hanging = open_ * float(bool(tail) and tail[-1] in _HANGING)
        dense = [
            1.0, 8.0 * empty, 3.0 * float(share > 0.7 and run > 0.6), share, run, 3.0 * float(share > 0.9), float(run > 0.9),
            3.0 * foreign, 3.0 * foreign * float(not at_home), enough * float(at_home), enough * abs(cyr - cyr_asked), 3.0 * enough * float(abs(cyr - cyr_asked) > 0.85), 3.0 * enough * float(cyr_asked > 0.5 and cyr < 0.1), 3.0 * enough * float(cyr_asked < 0.3 and cyr > 0.6),
            enough * 5 * float(own[n + 2]) * float(cyr_asked > 0), enough * 5 * float(own[n + 3]), 3.0 * enough * float(own[n + 2] > 0.02 and other[n + 2] == 0), enough * float(cyr < 0.1 and known < 0.1), known,
            open_, 3.0 * open_ * float(bool(tail) and tail[-1] in ",:;«—–-"), 3.0 * hanging, open_ * float("«" in tail), float(len(tail) <= 1) * open_, min(len(words), 12) / 12,
            *refusing(response),
        ]
        grams = {_h(w, SIZE) for w in words} | {_h(f"{a} {b}", SIZE) for a, b in zip(words, words[1:])} | {_h(f"{a} {b} {c}", SIZE) for a, b, c in zip(words, words[1:], words[2:])}
        stems = [w[:5] for w in words]
        grams |= {_h(f"{a}- {b}-", SIZE) for a, b in zip(stems, stems[1:])} | {_h(f"{a}-", SIZE) for a in stems}
        return sorted(grams), dense, (keys, bool(last) and bool(tail) and last[0].islower() and tail[-1].isalpha())

    def many(self, parents: list, responses: list) -> tuple[list[list[int]], np.ndarray, list[tuple[list[int], bool]]]:
        rows = [self.one(p, r) for p, r in zip(parents, responses)]
        return [r[0] for r in rows], np.array([r[1] for r in rows], np.float32).reshape(len(rows), -1), [r[2] for r in rows]


def refusal(rng: np.random.Generator, russian: bool, topic: str) -> str:
    """A refusal composed of an opening, a speech act and what may follow."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    parts = REFUSAL_PARTS["ru" if russian else "en"]
    if rng.random() < 0.2:
        text = pick(parts["self"])
    else:
        text = pick(parts["opening"])
        act = pick(parts["act"])
        text += act if act[:2] in ("I ", "I'") else act[0].lower() + act[1:]
    text = (text + pick(parts["redirect"])).replace("{}", topic)
    if rng.random() < 0.15:
        text = pick(["Ну, ", "Эм, ", "Ой, "] if russian else ["Well, ", "Hm, "]) + text
    return text[0].upper() + text[1:] + ("." if rng.random() < 0.6 and text[-1].isalpha() else "")


def broken(pairs: list[tuple[str, str]], seed: int = 11) -> list[tuple[str, str, int, int]]:
    """(parent, response, defect, own): pairs left alone (-1) and pairs with the number of their defect, made from good and mixed real ones.

    `own` is 1 where the table holds the uncut sentence of a cut response.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    is_ru = lambda t: len(re.findall("[а-яё]", t.lower())) > 0.5 * len(_LETTERS.findall(t))
    ru, other = [p for p in pairs if is_ru(p[1])], [p for p in pairs if not is_ru(p[1])]
    topics = {k: [w for p in part for w in _WORD.findall(p[1].lower()) if len(w) > 4] or ["это"] for k, part in ((True, ru), (False, other))}
    blanks = ["", " ", "\n", "\t", ".", "-", "—", "...", "​", "null", "None", "n/a", "[удалено]", "<br>", "&nbsp;", "﻿ ", "нет ответа", "no answer", "[deleted]"]
    # sentences in languages that the rows may lack, made of their frequent words
    made = lambda k: " ".join(pick(sorted(COMMON[k])) + (pick(["", "a", "en", "o"]) if rng.random() < 0.3 else "") for _ in range(int(rng.integers(6, 16))))
    out = []
    for i, (p, r) in enumerate(pairs):
        out.append((p, r, -1, 0))
        if not p.strip() or not r.strip():
            continue
        kind = i % 8
        if kind in (0, 1, 2):
            cut = int(rng.integers(max(2, len(r) // 8), max(3, len(r) - 2)))
            x, how, own = r[:cut], rng.random(), 1
            if how < 0.4:
                x = x.rsplit(None, 1)[0] if len(x.split()) > 1 else x  # at a word's end
            elif how < 0.55:
                x, own = r.rstrip().rstrip(".!?)…") + pick([" ", ", ", " — "]) + pick(NON_FINAL["ru" if is_ru(r) else "en"]), 0
            # neither at an end of a sentence nor where only the mark is lost
            if _LETTERS.search(x) and not _ENDED.search(x) and _WORD.search((_SENTENCE.split(r[len(x) :]) or [""])[0] if own else "x"):
                out.append((p, x, 4, own))
        elif kind in (3, 4):
            x = pick(BEFORE_COPIES) + p
            if rng.random() < 0.35 and len(p.split()) > 4:
                x = " ".join(x.split()[: -int(rng.integers(1, 1 + max(1, len(p.split()) // 4)))])
            out.append((p, x + pick(["", "", "»", " ?", ")", " +1"]), 1, 0))
        elif kind == 5:
            pool = other if is_ru(p) else ru
            x = pick(pool)[1] if pool and rng.random() < 0.6 else made(pick(sorted(COMMON.keys() - {"ru", "en"})))
            if len(_LETTERS.findall(x)) >= 10:
                out.append((p, x, 2, 0))
        elif kind == 6:
            out.append((p, refusal(rng, is_ru(p) or rng.random() < 0.1, pick(topics[is_ru(p)])), 3, 0))
        else:
            out.append((p, pick(blanks), 0, 0))
    return out


#: Labels that n-grams may speak for: which words stand in a text doesn't tell where it is cut. Against a label none speaks
#: where all pairs teach, or the phrases of broken pairs that were not left out would pass for sound.
SPOKEN = np.array([d != "truncated" for d in DEFECTS], np.float32)


def _allowed(columns: int) -> np.ndarray:
    # made texts stand in no table: what is counted may speak for cut responses only
    allowed = np.ones((columns, len(DEFECTS)), np.float32)
    allowed[-COUNTED:, [d != "truncated" for d in DEFECTS]] = 0
    return allowed


def fold(parent: str | None, response: str | None) -> int:
    """The fold of a pair, by its texts, so that copies are in one."""
    return xxhash.xxh3_64_intdigest(f"{parent or ''}\0{response or ''}") % FOLDS


class Model:
    """Weights and calibration, some 3 MB whatever the input; the table of end_counts() stays in Spark.

    Fitted in memory, on the different pairs of one block.
    """

    def __init__(self, pairs: list[tuple[str, str]], ends: DataFrame) -> None:
        self.features, self.ends = Featurizer(), ends
        rows = broken(pairs)
        if not rows:
            rows = [("", "", 0, 0)]
        grams, dense, tails = self.features.many([r[0] for r in rows], [r[1] for r in rows])
        dense = np.hstack([dense, self.counted(tails, [r[3] for r in rows])])
        y = np.array([[float(r[2] == k) for k in range(len(DEFECTS))] for r in rows], np.float32)
        x = learn.Sparse(grams)
        # real rows may be broken too: those that a fit on the other half takes for broken are left out, twice over;
        # the first fit sees no n-grams, by which it could learn broken rows by heart
        blind = learn.Sparse([[]] * len(rows))
        allowed = _allowed(dense.shape[1])
        keep, half = np.ones(len(rows), bool), np.arange(len(rows)) // 7 % 2 == 0
        untouched = y.sum(1) == 0
        scores = np.zeros_like(y)
        for again in range(3):
            drop = np.zeros(len(rows), bool)
            for part in (half, ~half):
                seen, own = x if again else blind, np.flatnonzero(part)
                w, v = learn.linear_fit(seen, dense, y, np.flatnonzero(~part & keep), SIZE, epochs=6 if again else 12, allowed=allowed)
                scores[own] = learn.linear_score(seen, dense, own, w, v)
                drop[own] = untouched[own] & (scores[own].max(1) > 0)
            if again < 2:
                keep = ~drop
        self.left_out = int(drop.sum())
        w, v = learn.linear_fit(x, dense, y, np.flatnonzero(keep), SIZE, epochs=6, allowed=allowed)
        #: Weights for the pairs of each fold; here the same for all.
        self.w, self.v = w[None], v[None]
        self._uncalibrated(1)
        for k in range(len(DEFECTS)):
            made, real = scores[y[:, k] > 0, k].astype(float), scores[untouched, k].astype(float)
            if len(made) and len(real):
                self.slope[0, k], self.offset[0, k], self.share[0, k] = learn.calibrate(made, scores[untouched & keep, k].astype(float), real)
        margin = scores * self.slope[0] + self.offset[0]
        hit = margin > 0
        #: By defect: share found of the broken pairs held out by halves, share of the real rows taken for it.
        self.report = {d: (float((hit[:, k] & (y[:, k] > 0)).sum() / max(1, (y[:, k] > 0).sum())), float((hit[:, k] & untouched).sum() / max(1, untouched.sum()))) for k, d in enumerate(DEFECTS)}

    def _uncalibrated(self, folds: int) -> None:
        #: By fold and defect: slope and offset of the posterior's log odds, share of the real rows.
        self.slope, self.offset, self.share = np.ones((folds, len(DEFECTS))), np.zeros((folds, len(DEFECTS))), np.zeros((folds, len(DEFECTS)))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "ends"}

    def counted(self, tails: list[tuple[list[int], bool]], own: list[int] | None = None) -> np.ndarray:
        """The features from counts of a bounded number of rows, looked up in Spark."""
        counts = look_up(self.ends, {k for keys, _ in tails for k in keys})
        return np.array([count_features(*t, counts, o) for t, o in zip(tails, own or [0] * len(tails))], np.float32).reshape(len(tails), COUNTED)

    def base(self, parents: list, responses: list) -> tuple[np.ndarray, list[tuple[list[int], bool]], np.ndarray]:
        """Scores without what the counts add, what to count, and the number of each row's weights."""
        grams, dense, tails = self.features.many(parents, responses)
        own = np.array([fold(p, r) for p, r in zip(parents, responses)], np.int64) % len(self.w)
        x, scores = learn.Sparse(grams), np.zeros((len(grams), len(DEFECTS)), np.float32)
        for k in range(len(self.w)):
            at = np.flatnonzero(own == k)
            scores[at] = learn.linear_score(x, dense, at, self.w[k], self.v[k][:-COUNTED])
        return scores, tails, own

    def decided(self, base: np.ndarray, counted: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Log odds of each defect."""
        return (base + np.einsum("nc,ncd->nd", counted, self.v[own][:, -COUNTED:])) * self.slope[own] + self.offset[own]

    def margins(self, parents: list, responses: list) -> np.ndarray:
        s, tails, own = self.base(parents, responses)
        return self.decided(s, self.counted(tails), own)


def _summed(parts: DataFrame, tasks: int) -> dict[int, np.ndarray]:
    """Sums of the float arrays of (part, data) by part; summed in Spark, so that as many come here as there are parts."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1)):
                x = np.frombuffer(data.as_buffer(), np.float32)
                sums[part] = sums[part] + x if part in sums else x.astype(float)
        for part, x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([x.tobytes()], pa.binary())], ["part", "data"])

    got = parts.repartition(tasks, "part").mapInArrow(add, "part int, data binary").toArrow()
    return {k: np.frombuffer(x, np.float64) for k, x in zip(got.column(0).to_pylist(), got.column(1).to_pylist())}


def _split(arrays: list[np.ndarray], size: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    flat = np.concatenate([np.asarray(a, np.float32).ravel() for a in arrays])
    for part, at in enumerate(range(0, len(flat), size)):
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([flat[at : at + size].tobytes()], pa.binary())], ["part", "data"])


class Block:
    """The rows of one block, with all features."""

    def __init__(self, columns: dict[str, list]) -> None:
        self.no = columns["block"][0]
        grams = [np.frombuffer(x, np.uint16) for x in columns["grams"]]
        self.x, self.blind = learn.Sparse(grams), learn.Sparse([[]] * len(grams))
        counted = [count_features(k, w, {c["key"]: (c["ends"], c["inside"]) for c in n or ()}, o) for k, w, n, o in zip(columns["keys"], columns["word"], columns["counts"], columns["own"])]
        self.dense = np.hstack([np.stack([np.frombuffer(x, np.float32) for x in columns["dense"]]), np.array(counted, np.float32)])
        kind = np.array(columns["kind"])
        self.y = (kind[:, None] == np.arange(len(DEFECTS))).astype(np.float32)
        self.untouched, self.fold = kind < 0, np.array(columns["fold"])

    def scores(self, weights: list[list[np.ndarray]], blind: bool) -> np.ndarray:
        """Each row's by the weights of its fold."""
        out = np.zeros_like(self.y)
        for k, (w, v, *_) in enumerate(weights):
            at = np.flatnonzero(self.fold == k)
            out[at] = learn.linear_score(self.blind if blind else self.x, self.dense, at, w, v)
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Blocks of rows that come in order of the block."""
    held: list[pa.RecordBatch] = []

    def block() -> Block:
        t = pa.Table.from_batches(held).sort_by([("seq", "ascending")])
        return Block({n: t.column(n).to_pylist() for n in t.column_names})

    for b in batches:
        numbers = b.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1), len(numbers)]
        for start, end in zip(edges, edges[1:]):
            if held and end > start and held[-1].column(0)[0].as_py() != numbers[start]:
                yield block()
                held = []
            if end > start:
                held.append(b.slice(start, end - start))
    if held:
        yield block()


class WholeModel(Model):
    """Fitted on the different pairs (p, r) of a table of any size, in blocks of about `block` pairs."""

    def __init__(self, pairs: DataFrame, n: int, block: int, ends: DataFrame) -> None:
        self.features, self.ends = Featurizer(), ends
        spark = pairs.sparkSession
        n_blocks = -(-n // block)
        tasks = min(n_blocks, 2 * spark.sparkContext.defaultParallelism)
        rows = self._rows(pairs, n_blocks)
        # what the earlier fit takes for broken is left out, as in Model
        weights, earlier = self._fitted(rows, tasks, None, True), None
        for again in range(2):
            earlier, weights = weights, self._fitted(rows, tasks, (weights, not again), False)
        self.w, self.v = (np.stack([x[i] for x in weights]) for i in (0, 1))
        self._calibrate(rows, tasks, weights, earlier)

    def _rows(self, pairs: DataFrame, n_blocks: int) -> DataFrame:
        """The rows of broken() for all pairs, with features and counts, in order of the block."""
        features = self.features

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def made(no: int, mine: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
                rows = broken(mine, seed=11 + no)
                own: list[int] = []
                for p, r, kind, _ in rows:  # a broken pair follows the one that it was made from
                    own.append(fold(p, r) if kind < 0 else own[-1])
                for at in range(0, len(rows), 1000):
                    part = rows[at : at + 1000]
                    grams, dense, tails = features.many([r[0] for r in part], [r[1] for r in part])
                    ints = [[no] * len(part), range(at, at + len(part)), own[at : at + 1000], [r[2] for r in part], [r[3] for r in part]]
                    yield pa.RecordBatch.from_arrays([
                        *(pa.array(x, pa.int32()) for x in ints),
                        pa.array([np.array(g, np.uint16).tobytes() for g in grams], pa.binary()), pa.array([d.tobytes() for d in dense], pa.binary()), pa.array([t[0] for t in tails], pa.list_(pa.int64())), pa.array([t[1] for t in tails]),
                    ], ["block", "seq", "fold", "kind", "own", "grams", "dense", "keys", "word"])

            last, mine = None, []
            for b in batches:
                for no, p, r in zip(*(b.column(i).to_pylist() for i in range(3))):
                    if no != last:
                        if mine:
                            yield from made(last, mine)
                        last, mine = no, []
                    mine.append((p, r))
            if mine:
                yield from made(last, mine)

        hashed = pairs.select(F.pmod(F.xxhash64("p", "r"), F.lit(n_blocks)).cast("int").alias("block"), "p", "r")
        blocks = hashed.repartitionByRange(n_blocks, "block").sortWithinPartitions("block", F.xxhash64("p", "r"), "p", "r")
        rows = blocks.mapInArrow(read, "block int, seq int, fold int, kind int, own int, grams binary, dense binary, keys array<long>, word boolean")
        rows = with_counts(rows, self.ends, F.col("seq"))
        return cut(rows.repartitionByRange(n_blocks, "block").sortWithinPartitions("block"))

    def _fitted(self, rows: DataFrame, tasks: int, earlier: tuple[list, bool] | None, blind: bool) -> list[list[np.ndarray]]:
        """Weights for each fold, learned from the other folds. `earlier`: weights that tell which real rows to leave out, and whether they are blind."""
        sc = rows.sparkSession.sparkContext
        columns = len(self.features.one("", "")[1]) + COUNTED
        states = [learn.linear_start(SIZE, columns, len(DEFECTS)) for _ in range(FOLDS)]
        told = sc.broadcast(earlier)
        for sync in range(SYNCS):
            begun = sc.broadcast(states)

            def learned(batches: Iterator[pa.RecordBatch], sync: int = sync, begun=begun) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
                sums = None
                for b in _blocks(batches):
                    keep = ~b.untouched | (b.scores(*told.value).max(1) <= 0) if told.value else np.ones(len(b.fold), bool)
                    found = []
                    for k, start in enumerate(begun.value):
                        state = [x.copy() for x in start]
                        learn.linear_fit(b.blind if blind else b.x, b.dense, b.y, np.flatnonzero(keep & (b.fold != k)), SIZE, epochs=EPOCHS * (1 + blind), seed=7 + sync, allowed=_allowed(columns), may=SPOKEN, state=state)
                        for i in (0, 1):
                            d = state[2 + i] - start[2 + i]
                            found += [d * state[i], d, d * d]
                    sums = [a + x for a, x in zip(sums, found)] if sums else found
                if sums:
                    yield from _split(sums)

            got = _summed(rows.coalesce(tasks).mapInArrow(learned, "part int, data binary"), tasks)
            flat, at, after = np.concatenate([got[i] for i in range(len(got))]), 0, []
            for start in states:
                state = list(start)
                for i in (0, 1):
                    n, shape = start[i].size, start[i].shape
                    dw, d, dd = (flat[at + j * n : at + (j + 1) * n].reshape(shape) for j in range(3))
                    at += 3 * n
                    # a weight's mean by how much each block had to say of it
                    some = d > 0
                    state[i] = np.where(some, dw / np.where(some, d, 1), start[i]).astype(np.float32)
                    state[2 + i] = (start[2 + i] + np.where(some, dd / np.where(some, d, 1), 0)).astype(np.float32)
                after.append(state)
            states = after
            begun.unpersist()
        return [s[:2] for s in states]

    def _calibrate(self, rows: DataFrame, tasks: int, weights: list, earlier: list) -> None:
        shared = rows.sparkSession.sparkContext.broadcast((weights, earlier))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((FOLDS, 3, len(DEFECTS), BINS))
            for b in _blocks(batches):
                new, old = (b.scores(w, False) for w in shared.value)
                kept = b.untouched & (old.max(1) <= 0)
                bins = np.clip(np.floor((new + SPAN) * (BINS / 2 / SPAN)), 0, BINS - 1).astype(int)
                for f, k in np.ndindex(FOLDS, len(DEFECTS)):
                    for i, who in enumerate((b.y[:, k] > 0, kept, b.untouched)):
                        sums[f, i, k] += np.bincount(bins[who & (b.fold == f), k], minlength=BINS)
            yield from _split([sums])

        got = _summed(rows.coalesce(tasks).mapInArrow(count, "part int, data binary"), tasks)
        sums = np.concatenate([got[i] for i in range(len(got))]).reshape(FOLDS, 3, len(DEFECTS), BINS)
        at = (np.arange(BINS) + 0.5) * (2 * SPAN / BINS) - SPAN
        self._uncalibrated(FOLDS)
        hits = np.zeros((2, len(DEFECTS)))
        for f, k in np.ndindex(FOLDS, len(DEFECTS)):
            made, kept, real = sums[f, :, k]
            if made.sum() and kept.sum():
                m, n, r = made > 0, kept > 0, real > 0
                self.slope[f, k], self.offset[f, k], self.share[f, k] = learn.calibrate(at[m], at[n], at[r], counts=(made[m], kept[n], real[r]))
            hit = at * self.slope[f, k] + self.offset[f, k] > 0
            hits[:, k] += made[hit].sum(), real[hit].sum()
        made, kept, real = sums.sum((0, 3))
        self.left_out = int(real[0] - kept[0])
        self.report = {d: (float(hits[0, k] / max(1, made[k])), float(hits[1, k] / max(1, real[k]))) for k, d in enumerate(DEFECTS)}


def fit(df: DataFrame, id_column: str, parent: str, response: str, sample_rows: int = 6000) -> Model:
    """Fit on all different pairs; those of a table of more than `sample_rows` in blocks of about so many."""
    pairs = cut(df.select(F.col(parent).alias("p"), F.col(response).alias("r")).filter("p IS NOT NULL AND r IS NOT NULL").distinct())
    ends, n = cut(end_counts(df, response, parent)), pairs.count()
    if n > sample_rows:
        return WholeModel(pairs, n, sample_rows, ends)
    return Model([(r.p, r.r) for r in pairs.orderBy(F.xxhash64("p", "r"), "p", "r").collect()], ends)


def with_counts(rows: DataFrame, ends: DataFrame, spread: Column) -> DataFrame:
    """`rows` and a column `counts` of what `ends` has for their `keys`; null where there are none. `spread` varies between rows of one end."""
    columns = rows.columns
    rows = cut(rows.withColumn("end", F.when(F.size("keys") > 0, F.xxhash64("keys"))))
    # each different end is looked up once; the texts themselves are not shuffled
    looked = rows.filter("end IS NOT NULL")
    sizes = cut(looked.groupBy("end").agg(F.first("keys").alias("keys"), F.count("*").alias("n")))
    each = sizes.select("end", F.explode("keys").alias("key"))
    found = salted_join(each, ends, "key", F.col("end"), hot_keys(each.groupBy("key").agg(F.count("*").alias("n")), "key", "n"))
    counts = found.groupBy("end").agg(F.collect_list(F.struct("key", "ends", "inside")).alias("counts"))
    looked = salted_join(looked, counts, "end", spread, hot_keys(sizes, "end", "n"), "left")
    whole = rows.filter("end IS NULL").select(*columns, F.lit(None).cast(counts.schema["counts"].dataType).alias("counts"))
    return looked.select(*columns, "counts").union(whole)


def defects(df: DataFrame, id_column: str, parent: str, response: str, model: Model) -> DataFrame:
    """(id, defect, margin) of every row with a defect; `margin` is the log odds of it."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                s, tails, own = shared.value.base(part.column(1).to_pylist(), part.column(2).to_pylist())
                keys, word = zip(*tails)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(s.astype(float)), pa.list_(pa.float64())), pa.array(keys, pa.list_(pa.int64())), pa.array(word), pa.array(own, pa.int32())], ["id", "base", "keys", "word", "own"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            s, keys, word, own, counts = (b.column(i).to_pylist() for i in range(1, 6))
            found = [{c["key"]: (c["ends"], c["inside"]) for c in x or ()} for x in counts]
            s = m.decided(np.array(s), np.array([count_features(*x) for x in zip(keys, word, found)]), np.array(own))
            best = s.argmax(1)
            hit = np.flatnonzero(s.max(1) > 0)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit)), pa.array([DEFECTS[best[i]] for i in hit], pa.string()), pa.array(s[hit, best[hit]].astype(float))], ["id", "defect", "margin"])

    kind = dict(df.dtypes)[id_column]
    rows = df.select(id_column, parent, response).mapInArrow(score, f"id {kind}, base array<double>, keys array<long>, word boolean, own int")
    return with_counts(rows, model.ends, F.col("id")).mapInArrow(decide, f"id {kind}, defect string, margin double")
