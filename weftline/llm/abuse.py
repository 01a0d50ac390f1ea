"""P6: abusive, hateful or sexual content, scored by gradient-boosted trees over dense features.

Each sentence of a text is read in one character form and with obfuscation undone (letters set apart
or drawn out, digits and stars for letters). Its features are counts and densities of a general
lexicon by kind, how near its words stand to a second person, capitals, exclamation marks,
obfuscation rates, signs that words are quoted or said of a thing, and densities of a learned
lexicon: the log odds of the stems and neighbouring stems of the labelled texts. The trees score
sentences; a text's score is that of the sentence that they find worst.

Labelled texts teach. A column of unreliable hints (a score of another tool) may teach too, as noisy
labels of a bounded sample: no row is judged by its own hint, and none is needed when scoring. A
labelled text of several sentences teaches by the sentence that the model itself finds worst, chosen
again after each fit. Scores of held-out trusted labels are calibrated by isotonic regression.

Null, empty and purely punctuational texts score 0. Texts are read whole. Repeated rows are each
scored. With no labelled rows of one kind fit() raises ValueError. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import learn
from weftline.llm.canon import canonical

# Beginnings of words by kind, in lower case with е for ё. A word belongs to the longest beginning it has.
LEXICON = {
    "insult": """идиот дебил кретин придур тупиц недоум дегенерат урод мраз твар скотин ублюд гнид ничтожеств клоун чмо мудак мудил мудозвон сволоч подонок подонк подлец мерзав негодя
        олух болван козел козл баран осел лох лошар отброс шваль выродок выродк быдл дурак дурач дура дуре дуры дурой имбецил даун олигофрен шизик психопат псих гад гадин паскуд стерв падл падаль
        гопник алкаш нищеброд неудачник слабак трус тряпк свинь свинот хам хамло жлоб позорищ идиотк дебилк
        moron idiot imbecile retard clown scum loser trash garbage fool dumbass jerk asshole bastard freak creep coward pig swine prick""",
    "demean": "туп тупой тупая тупые тупор безмозгл жалк никчемн убог бестолоч мерзк отвратн гнус поган безголов слабоумн ущербн stupid dumb pathetic worthless braindead brainless filthy disgusting ugly useless",
    "profane": "хуй хуе хуя хуи пизд ебан ебат ебал ебуч ебну еблан заеб уеб наеб въеб бля бляд блят говн дерьм жоп сран пидор пидар педик гондон шлюх шалав проститут потаскух сука суки суку сучк сучар курв fuck shit bitch whore slut cunt faggot nigger dick cock",
    "violence": """убей убью убит убил убивать убьют убейся удави удавит задуш придуш повеси повесь вешать повесить топить утопи утопить сдохн сдох подохн умри умрешь умереть зареж зарез прирез пристрел застрел расстрел избить изобью побью
        бить бьют сломаю сломать переломаю ломать сжечь сожгу сгор гореть взорв закопаю закопать порву разорву раздавлю размажу прибью урою уничтож истреб казнить кулак топор пуля ножом самоуби
        kill kills die dies dead hang burn burns burned beat punch break shoot stab choke strangle drown rape murder suicide bury jump bleed""",
    "wish": "надеюсь чтоб чтобы желаю жаль пусть мечтаю лучше hope wish deserve should",
    "silence": "заткн закрой вали валите сгинь исчезни проваливай пошел пошла убирайся убирайтесь отвали катись вякай тявкай гавкай лечись shut quit nobody leave lost",
    "sexual": """трах секс сосать соси сосеш отсос минет куни сиськ титьк грудь попк задниц трусы трусик трусах лифчик бель раздет раздень раздев голы голая голую голой голых нагой нагая стриптиз кончил кончу кончи кончать дроч мастурб оргазм возбуд
        постел эрот порно интим член вагин анал вылиз лизать облиз отыме поимел поиме ласка постон стонать изнасил развра похот сексуал фигур ляжк
        nude nudes naked sex sexy porn boob tits ass suck lick undress clothes strip moan orgasm horny bed cum blowjob masturbat aroused thighs""",
    "group": """бабы баб бабам бабье мигрант понаех гастарбайтер чурк хач жид евре негр черномаз узкоглаз цыган хохл кацап москал мусульман геи геев гей лесби транс инвалид старики старик старух пенсионер деревенщин нищие национал народ нация раса кавказ азиат
        women immigrants migrants jews muslims blacks gays foreigners race folk people kind breed tribe""",
    "dehumanize": """крыс собак скот скоты животн зверь звери паразит насеком зараз тарак обезьян гнил грязн воня вонюч вонь сорт раб рабы воры вор ворье лжец лживы клетк выселить выслать выгнать изгнать депорт истребить запрет запрещать кровь кров
        animals vermin rats cockroach parasite disease thieves liars cage ban subhuman inferior savages deport dirty blood breeding""",
    "mention": """слово слова словом слов назва называ обозв оскорбл оскорбит цитат бан забан модератор удалил жалоб обид ругат выражен термин грубост персонаж герой героин злоде босс враг монстр сцен сериал фильм кино роман глав книг уровен движок юмор актер роль песн мем насили ненавист
        word called quote quoted banned moderator insult character hero villain boss enemy scene movie film series chapter book level humor joke actor role song""",
}
KINDS = list(LEXICON)
STEMS: dict[str, int] = {}
for _n, _k in enumerate(KINDS):
    for _s in LEXICON[_k].split():
        STEMS.setdefault(_s, _n)
_SHORT, _LONG = min(map(len, STEMS)), max(map(len, STEMS))
# Second persons.
YOU = frozenset("ты тебя тебе тобой твой твоя твое твои твою твоей твоего твоим твоих твоем вы вас вам вами ваш ваша ваше ваши вашу вашей вашего you your yours u ur youre yourself".split())
# Words by which a sentence lumps people together.
LUMPED = frozenset("таких такие таким все всех эти этих этим they them those whole вообще всегда".split())
#: Words shaped like names of peoples.
_PEOPLE = re.compile(r"[а-я]{2,}(?:ане|яне|анам|янам|йцы|нцы|йцев|нцев|аки|яки|чане)$")
_IMPERATIVE = re.compile(r"[а-я]{2,}(?:ись|йся|йте|ите|айся|ай|уй|ей)$")

_SENTENCE = re.compile(r"(?<=[.!?…)])\s+|[\r\n]+")
_WORD = re.compile(r"[^\W_]+")
_APART = re.compile(r"(?<![^\W_])(?:[^\W\d_]([ .\-_*])(?:[^\W\d_]\1){1,}[^\W\d_])(?![^\W_])")
_DRAWN = re.compile(r"([^\W\d_])\1{2,}")
_MIXED = re.compile(r"(?=\S*[а-яё]{2})(?=\S*[0-9@$uw])[а-яё0-9@$uw]+", re.I)
_STARRED = re.compile(r"[а-яёa-z]+(?:\*+[а-яёa-z]+)+|[а-яёa-z]+\*+", re.I)
_LEET = str.maketrans({"0": "о", "3": "е", "@": "а", "1": "и", "4": "ч", "6": "б", "$": "с", "u": "и", "w": "ш"})
_HIDEABLE = sorted((s for s, n in STEMS.items() if KINDS[n] in ("insult", "demean", "profane", "sexual") and len(s) >= 4), key=len, reverse=True)
#: Slots of the learned lexicon.
SLOTS = 1 << 18


def undisguised(sentence: str) -> tuple[str, int, int, int, int]:
    """The sentence in lower case with obfuscation undone, and how often letters were apart, drawn out, swapped, starred."""
    low = sentence.lower().replace("ё", "е")
    apart = drawn = swapped = starred = 0

    def join(m: re.Match) -> str:
        nonlocal apart
        x = m.group().replace(m.group(1), "")
        if len(x) < 4:
            return m.group()
        apart += 1
        # a one-letter word before letters set apart by blanks goes its own way
        for s in _HIDEABLE:
            if x[1:].startswith(s):
                return f"{x[0]} {x[1:]}"
        return x

    low = _APART.sub(join, low)

    def shrink(m: re.Match) -> str:
        nonlocal drawn
        drawn += 1
        return m.group(1)

    low = _DRAWN.sub(shrink, low)

    def swap(m: re.Match) -> str:
        nonlocal swapped
        swapped += 1
        return m.group().translate(_LEET)

    low = _MIXED.sub(swap, low)

    def fill(m: re.Match) -> str:
        nonlocal starred
        x = m.group()
        for s in _HIDEABLE:
            if len(x) >= 4 and all(a == b or a == "*" for a, b in zip(x, s)) and min(len(x), len(s)) >= 4:
                starred += 1
                return s + x[len(s) :]
        return x

    if "*" in low:
        low = _STARRED.sub(fill, low)
    return low, apart, drawn, swapped, starred


def _kind(word: str) -> int:
    """The kind of a word by its longest beginning in the lexicon, -1 for none; an ending has at most five letters."""
    for n in range(min(len(word), _LONG), max(_SHORT, len(word) - 5) - 1, -1):
        if (k := STEMS.get(word[:n])) is not None and (n > 3 or len(word) - n <= 3):
            return k
    return -1


@lru_cache(maxsize=1 << 18)
def _word(word: str) -> tuple[int, bool, bool, bool, bool]:
    """Of a word its kind, whether it is a second person, lumps together, is is shaped like a people's name or an order."""
    return _kind(word), word in YOU, word in LUMPED, bool(_PEOPLE.match(word)), bool(_IMPERATIVE.match(word))


@lru_cache(maxsize=1 << 18)
def _slot(key: str) -> int:
    return xxhash.xxh3_64_intdigest(key) % SLOTS


def read(sentence: str) -> tuple[list[float], list[int]]:
    """Dense features of a sentence, and the slots of its stems and neighbouring stems."""
    raw = canonical(sentence)
    low, apart, drawn, swapped, starred = undisguised(raw)
    words = _WORD.findall(low)
    n = max(1, len(words))
    known = [_word(w) for w in words]
    kinds = [k[0] for k in known]
    you = [i for i, k in enumerate(known) if k[1]]
    at: dict[str, list[int]] = {k: [] for k in KINDS}
    for i, k in enumerate(kinds):
        if k >= 0:
            at[KINDS[k]].append(i)
    count = {k: len(v) for k, v in at.items()}
    near = lambda kind, d: float(sum(any(abs(i - y) <= d for y in you) for i in at[kind]))
    people, lumped, orders = (sum(k[j] for k in known) for j in (3, 2, 4))
    people += count["group"]
    plain = set(_WORD.findall(raw.lower().replace("ё", "е")))
    hidden = sum(w not in plain for w, k in zip(words, kinds) if k >= 0 and KINDS[k] in ("insult", "demean", "profane", "sexual"))
    names = count["insult"] + count["profane"]
    first = float(bool(kinds) and kinds[0] >= 0 and KINDS[kinds[0]] in ("insult", "profane"))
    letters = sum(map(str.isalpha, raw))
    long_words = re.findall(r"[^\W\d_]{4,}", raw)
    dense = [
        *(float(count[k]) for k in KINDS), *(count[k] / n for k in KINDS),
        near("insult", 3) + near("profane", 3), near("insult", 6) + near("demean", 4), near("violence", 4), near("sexual", 6), near("silence", 5), float(len(you)), len(you) / n,
        float(people), float(people > 0) * (count["dehumanize"] + count["violence"] + count["demean"]), float(lumped), float(orders), float(orders > 0) * (names + count["violence"] + count["sexual"]), float(count["wish"] > 0) * count["violence"],
        first, float(hidden), float(names > 0 and count["mention"] == 0), float(names + count["demean"] + count["violence"] + count["sexual"] + count["dehumanize"] + count["silence"]),
        sum(map(str.isupper, raw)) / max(1, letters), float(sum(w.isupper() for w in long_words)), float(raw.count("!")), float(apart + drawn + swapped + starred), float("«" in raw and names > 0), n / 20,
    ]
    stems = ["^", *(w[:6] for w in words if not w.isdigit())]
    keys = {*stems[1:], *(f"{a} {b}" for a, b in zip(stems, stems[1:])), *(f"{a} . {b}" for a, b in zip(stems, stems[2:]))}
    return dense, list(map(_slot, keys))


class Learned:
    """Log odds of stems and neighbouring stems, by hashed slot; slots without evidence stand at 0."""

    def __init__(self, texts: list[list[int]], y: np.ndarray, weight: np.ndarray, smooth: float = 12.0) -> None:
        flat = np.fromiter((s for t in texts for s in t), np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        yes, all_ = np.bincount(flat, (weight * y)[owner], SLOTS), np.bincount(flat, weight[owner], SLOTS)
        share = float(np.clip((weight * y).sum() / max(1e-9, weight.sum()), 1e-4, 1 - 1e-4))
        odds = np.log((yes + smooth * share) / (all_ - yes + smooth * (1 - share))) - np.log(share / (1 - share))
        self.slots = np.flatnonzero(np.abs(odds) > 0.05)
        self.odds = odds[self.slots].astype(np.float32)

    def features(self, rows: list[list[int]]) -> np.ndarray:
        """Of each sentence: the largest, the mean, the sum of what speaks for and against abuse, and how many speak for it."""
        table = self.__dict__.get("table")
        if table is None:
            table = self.__dict__["table"] = np.zeros(SLOTS, np.float32)
            table[self.slots] = self.odds
        out = np.zeros((len(rows), 6), np.float32)
        for i, r in enumerate(rows):
            if r:
                x = np.sort(table[r])
                out[i] = x[-1], x.mean(), x[x > 0].sum(), x[x < 0].sum(), (x > 1).sum(), x[-5:].mean()
        return out

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "table"}


def sentences(text: str | None) -> list[str]:
    return [s for s in _SENTENCE.split(text or "") if _WORD.search(s)]


class Scorer:
    """Learned lexicon, trees and calibration; of a size set by the sample."""

    def __init__(self, texts: list[list[tuple[list[float], list[int]]]], labels: list[float], trusted: list[bool], faith: float = 8.0) -> None:
        y, sure = np.array(labels, float), np.array(trusted, bool)
        if not 0 < y[sure].sum() < sure.sum():
            raise ValueError("labels of both kinds are needed")
        weight = np.where(sure, faith, 1.0)
        texts = [t or [([0.0] * len(read("")[0]), [])] for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        dense = np.array([s[0] for t in texts for s in t], np.float32)
        slots = [s[1] for t in texts for s in t]
        whole = [sorted({k for s in t for k in s[1]}) for t in texts]
        half = np.arange(len(texts)) % 2 == 0
        x = np.hstack([dense, np.zeros((len(dense), 6), np.float32)])
        for part in (half, ~half):
            # a text's learned features come from the other half
            at = np.flatnonzero(~part)
            learned = Learned([whole[i] for i in at], y[at], weight[at])
            own = np.flatnonzero(part[owner])
            x[own, -6:] = learned.features([slots[i] for i in own])
        out = np.zeros(len(texts))
        for part in (half, ~half):
            own, others = np.flatnonzero(part[owner]), np.flatnonzero(~part[owner])
            trees = self._fit(x[others], owner[others], y, weight)
            np.maximum.at(scores := np.full(len(texts), -50.0), owner[own], trees.score(x[own]))
            out[part] = scores[part]
        self.knots, self.values = self._calibration(out, y, sure)
        #: Share of the trusted labels told right by the model of the other half.
        self.accuracy = float(((np.interp(out[sure], self.knots, self.values) >= 0.5) == (y[sure] > 0.5)).mean())
        self.trees = self._fit(x, owner, y, weight)
        self.learned = Learned(whole, y, weight)

    @staticmethod
    def _calibration(scores: np.ndarray, y: np.ndarray, sure: np.ndarray, anchors: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
        """Isotonic curve of held-out scores: of the trusted labels, or, where there are hints, of those freed of their noise.

        The trusted labels hold far more abuse than a table does, so that a curve of theirs flags too much of it. How
        often a hint is wrong is read off the surest rows, of which the `anchors` share at the top is taken for abuse.
        """
        order = np.argsort(scores[~sure])
        n = int(len(order) * anchors)
        if n < 30:
            return learn.isotonic(scores[sure], y[sure])
        noisy = y[~sure]
        low, high = noisy[order[: len(order) // 2]].mean(), noisy[order[-n:]].mean()
        if high - low < 0.1:
            return learn.isotonic(scores[sure], y[sure])
        knots, values = learn.isotonic(scores[~sure], (noisy - low) / (high - low))
        return knots, np.clip(values, 0.0, 1.0)

    @staticmethod
    def _fit(x: np.ndarray, owner: np.ndarray, y: np.ndarray, weight: np.ndarray) -> learn.Boosted:
        """Trees on one sentence of each text: first the one with most learned evidence, then the one that the trees find worst."""
        score, trees = x[:, -1] + x[:, -4] / 4, None
        for rounds in (20, 80):
            order = np.lexsort((-score, owner))
            worst = order[np.unique(owner[order], return_index=True)[1]]
            trees = learn.Boosted(rounds).fit(x[worst], y[owner[worst]], weight[owner[worst]])
            score = trees.score(x)
        return trees

    def raw(self, texts: list) -> np.ndarray:
        cut = [sentences(t) for t in texts]
        out = np.full(len(texts), -50.0)
        flat = [read(s) for c in cut for s in c]
        if flat:
            x = np.hstack([np.array([f[0] for f in flat], np.float32), self.learned.features([f[1] for f in flat])])
            np.maximum.at(out, np.repeat(np.arange(len(texts)), [len(c) for c in cut]), self.trees.score(x))
        return out

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.where(raw <= -50, 0.0, np.interp(raw, self.knots, self.values))

    def score(self, texts: list) -> np.ndarray:
        """Calibrated probability: 0 for texts without words."""
        return self.calibrated(self.raw(texts))


def _read(df: DataFrame) -> tuple[list, list, list]:
    """The sentences' features of a bounded table (text, y, trusted), read by the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[read(s) for s in sentences(t)] for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([[s[0] for s in t] for t in found], pa.list_(pa.list_(pa.float32()))), pa.array([[s[1] for s in t] for t in found], pa.list_(pa.list_(pa.int32()))), b.column(1), b.column(2)], ["dense", "slots", "y", "trusted"])

    got = df.mapInArrow(run, "dense array<array<float>>, slots array<array<int>>, y double, trusted boolean").toArrow()
    dense, slots, y, trusted = (c.to_pylist() for c in got.columns)
    return [list(zip(d, s)) for d, s in zip(dense, slots)], y, trusted


def fit(labels: DataFrame, text: str, label: str, hinted: DataFrame | None = None, hinted_text: str = "text", hint: str = "hint", sample_rows: int = 20_000, hint_rows: int = 20_000, hint_least: float = 0.5) -> Scorer:
    """Fit on at most `sample_rows` labelled rows and at most `hint_rows` rows with a hint, each the first by hash of the text.

    A hint from `hint_least` up is taken as a noisy label of abuse; hints outside of 0 to 1 are no hints.
    """
    first = lambda df, n: df.filter("t IS NOT NULL AND y IS NOT NULL").orderBy(F.xxhash64("t"), "t", "y").limit(n)
    rows = first(labels.select(F.col(text).alias("t"), F.col(label).cast("double").alias("y")), sample_rows).withColumn("trusted", F.lit(True))
    if hinted is not None:
        noisy = hinted.filter(F.col(hint).between(0, 1)).select(F.col(hinted_text).alias("t"), (F.col(hint) >= hint_least).cast("double").alias("y"))
        rows = rows.union(first(noisy, hint_rows).withColumn("trusted", F.lit(False)).repartition(8))
    return Scorer(*_read(rows))


def scores(df: DataFrame, id_column: str, text: str, scorer: Scorer) -> DataFrame:
    """(id, score, raw) for every row."""
    shared = df.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                raw = s.raw(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s.calibrated(raw)), pa.array(raw)], ["id", "score", "raw"])

    kind = dict(df.dtypes)[id_column]
    return df.select(id_column, text).mapInArrow(run, f"id {kind}, score double, raw double")
