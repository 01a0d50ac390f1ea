"""P4: text that looks alike, brought to one form by a compiled transducer.

The mapping is built once from the Unicode database (widths, blanks, invisible characters,
base-and-accent clusters) and from a short table of look-alike letters. It is checked for
conflicts when compiled: a character belongs to one class, and no output is itself an input.
Applying it is one longest-match pass over grapheme clusters, then each word is written in the
one script that its unmistakable letters show (a word without any takes the script of its
sentence, a sentence without any that of the text, a text without any is written in Cyrillic).

Seen differences stay: case, punctuation, number of spaces, tabs, line ends, entities.

Null stays null, empty stays empty, text of any length is mapped whole.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from weftline.plans.runtime import cut, hot_keys, salted_join

# Letters that look the same, Latin, Cyrillic and (any number of) others.
LOOK_ALIKES = """
a а α
c с ϲ
e е
i і ι
j ј ϳ
o о ο օ
p р ρ
s ѕ
x х
y у
h һ
d ԁ
q ԛ
w ԝ
A А Α
B В Β
C С Ϲ
E Е Ε
H Н Η
I І Ι
J Ј
K К Κ
M М Μ
O О Ο Օ
P Р Ρ
S Ѕ
T Т Τ
X Х Χ
Y У Υ
N - Ν
Z - Ζ
g - ɡ
l - ӏ
v - ν
u - υ
"""
# Letters of other scripts that look like Latin capitals, each after the capital.
CAPITALS = "AꓮᎪ BꓐᏴ CꓚᏟ DꓓᎠ EꓰᎬ FꓝꞘ GꓖᏀ HꓧᎻ Iꓲ JꓙᎫ KꓗᏦ LꓡᏞ MꓟᎷ Nꓠ Oꓳ PꓑᏢ RꓣᎡ SꓢᏚ TꓔᎢ Uꓴ VꓦᏙ WꓪᎳ Xꓫ Yꓬ ZꓜᏃ".replace("Ꞙ", "")
#: Hyphens that cannot be told from the common one.
HYPHENS = "‐‑"
#: Invisible characters outside the category Cf.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍ㅤﾠ" + "".join(map(chr, range(0xFE00, 0xFE10)))
#: Letters that a reader doesn't tell from a base and an accent are composed; others stay clusters.
MARKS = "̀-ͯ"


class Transducer:
    """The compiled mapping. Build it once; apply() is pure."""

    def __init__(self) -> None:
        self.single: dict[str, str] = {}
        for cp in range(0x80, sys.maxunicode + 1):
            ch = chr(cp)
            kind = unicodedata.category(ch)
            if kind == "Zs":
                self._put(ch, " ")
            elif kind == "Cf" or ch in INVISIBLE:
                self._put(ch, "")
            else:
                parts = unicodedata.decomposition(ch).split()
                if parts and parts[0] in ("<wide>", "<narrow>"):
                    self._put(ch, "".join(chr(int(x, 16)) for x in parts[1:]))
        for ch in HYPHENS:
            self._put(ch, "-")
        self.to_latin: dict[str, str] = {}
        self.to_cyrillic: dict[str, str] = {}
        for line in LOOK_ALIKES.split("\n"):
            if not line:
                continue
            latin, cyrillic, *others = line.split()
            for ch in (latin, cyrillic, *others):
                if ch == "-":
                    continue
                if ch in self.to_latin:
                    raise ValueError(f"{ch!r} is in two classes")
                self.to_latin[ch] = latin
                if cyrillic != "-":
                    self.to_cyrillic[ch] = cyrillic
        for latin, *others in CAPITALS.split():
            for ch in (latin, *others):
                if self.to_latin.setdefault(ch, latin) != latin:
                    raise ValueError(f"{ch!r} is in two classes")
                if ch != latin and latin in self.to_cyrillic:
                    self.to_cyrillic[ch] = self.to_cyrillic[latin]
        # precomposed letters follow their bases: Latin e with diaeresis and Cyrillic io
        for cp in range(0xC0, 0x500):
            ch = chr(cp)
            base, *marks = unicodedata.normalize("NFD", ch)
            if not marks or ch in self.to_latin or base not in self.to_latin:
                continue
            for to, of in ((self.to_latin, self.to_latin), (self.to_cyrillic, self.to_cyrillic)):
                if base in of:
                    x = unicodedata.normalize("NFC", of[base] + "".join(marks))
                    if len(x) == 1:
                        to[ch] = x
        for to in (self.to_latin, self.to_cyrillic):
            for x in set(to.values()):
                if to.get(x, x) != x:
                    raise ValueError(f"{x!r} is mapped on")
        for x in self.single.values():
            if any(ch in self.single for ch in x):
                raise ValueError(f"{x!r} is mapped on")
        gone = "".join(k for k, v in self.single.items() if not v)
        cls = lambda chars: "[" + "".join(re.escape(x) for x in chars) + "]"
        self.cluster = re.compile(rf"\w(?:{cls(gone)}*[{MARKS}])+|{cls(self.single)}")
        self.suspect = re.compile(r"[^\t\n\r\x20-\x7eа-яёА-ЯЁ«»—–№…“”„]")
        self.word = re.compile(r"[^\W\d_]+")
        self.sentence = re.compile(r"[^.!?\n]+")
        both = self.to_latin.keys() & self.to_cyrillic.keys()
        latin = "".join(x for x in map(chr, range(0x41, 0x7B)) if x.isalpha() and x not in both)
        cyrillic = "".join(x for x in map(chr, range(0x400, 0x530)) if x.isalpha() and x not in both)
        self.sure = {"latin": re.compile(f"[{latin}]"), "cyrillic": re.compile(f"[{cyrillic}]")}
        self.any = {"latin": re.compile("[A-Za-z]"), "cyrillic": re.compile("[а-яёА-ЯЁ]")}
        self.tables = {"latin": str.maketrans(self.to_latin), "cyrillic": str.maketrans(self.to_cyrillic)}
        self.words: dict[tuple[str, str], str] = {}

    def _put(self, ch: str, out: str) -> None:
        if self.single.setdefault(ch, out) != out:
            raise ValueError(f"{ch!r} is mapped twice")

    def _script(self, text: str, default: str) -> str:
        latin, cyrillic = (len(self.sure[k].findall(text)) for k in ("latin", "cyrillic"))
        return default if latin == cyrillic else "latin" if latin > cyrillic else "cyrillic"

    def _cluster(self, m: re.Match) -> str:
        x = m.group()
        if len(x) == 1:
            return self.single[x]
        return unicodedata.normalize("NFC", "".join(self.single.get(ch, ch) for ch in x))

    def apply(self, text: str) -> str:
        latin, cyrillic = self.any["latin"].search(text), self.any["cyrillic"].search(text)
        if not (latin and cyrillic) and not self.suspect.search(text) and (not (latin or cyrillic) or self.sure["latin" if latin else "cyrillic"].search(text)):
            return text  # one script, unmistakably, and nothing unusual: the form is the text
        text = self.cluster.sub(self._cluster, text)
        whole = self._script(text, "cyrillic")
        return unicodedata.normalize("NFC", self.sentence.sub(lambda m: self._sentence(m.group(), whole), text))

    def _sentence(self, text: str, whole: str) -> str:
        script, cache = self._script(text, whole), self.words

        def resolve(m: re.Match) -> str:
            w = m.group()
            if (x := cache.get((w, script))) is None:
                x = unicodedata.normalize("NFC", w)
                x = x.translate(self.tables[self._script(x, script)])
                if len(cache) > 200_000:
                    cache.clear()
                cache[w, script] = x
            return x

        return self.word.sub(resolve, text)


_built: Transducer | None = None


def transducer() -> Transducer:
    """The process's transducer, compiled at first use."""
    global _built
    if _built is None:
        _built = Transducer()
    return _built


def canonical(text: str | None) -> str | None:
    return None if text is None else transducer().apply(text)


@F.arrow_udf(StringType())
def canonical_udf(texts: pa.Array) -> pa.Array:
    f = transducer().apply
    return pa.array([None if x is None else f(x) for x in texts.to_pylist()], pa.string())


def canonical_text(df: DataFrame, *columns: str) -> DataFrame:
    """Replace each column by its one form; all other columns stay."""
    return df.withColumns({c: canonical_udf(F.col(c)) for c in columns})


_KEYED = pa.schema([("row_id", pa.int64()), ("form", pa.binary(16)), ("raw", pa.binary(16))])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    f, h = transducer().apply, xxhash.xxh3_128_digest
    for b in batches:
        ids, forms, raws = b.column(0), [], []
        for p, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            raw = h(f"{len(p)}:{p}{c}")
            x, y = f(p), f(c)
            raws.append(raw)
            forms.append(raw if x is p and y is c else h(f"{len(x)}:{x}{y}"))
        yield pa.RecordBatch.from_arrays([ids, pa.array(forms, pa.binary()), pa.array(raws, pa.binary())], ["row_id", "form", "raw"])


def look_alike_keys(df: DataFrame, row_id: str, first: str, second: str) -> DataFrame:
    """(row_id, form, raw): 128-bit digests of the one form and of the stored characters of two texts.

    Rows with a null or empty text have no key.
    """
    named = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(first).alias("a"), F.col(second).alias("b"))
    return named.filter("length(a) > 0 AND length(b) > 0").mapInArrow(_keyed, "row_id long, form binary, raw binary")


def _spelled(df: DataFrame, row_id: str, first: str, second: str) -> tuple[DataFrame, list]:
    """Keys of the rows whose form has two or more spellings, with the form's smallest row and its sizes; and the hot forms."""
    keys = cut(look_alike_keys(df, row_id, first, second))
    forms = keys.groupBy("form").agg(F.min("row_id").alias("class_id"), F.count("*").alias("n_rows"), F.count_distinct("raw").alias("n_spellings")).filter("n_spellings > 1")
    forms = cut(forms)
    hot = hot_keys(forms, "form", "n_rows")
    return salted_join(keys, forms, "form", F.col("row_id"), hot), hot


def look_alike_classes(df: DataFrame, row_id: str, first: str, second: str) -> DataFrame:
    """(row_id, class_id, spelling, n_rows, n_spellings): the rows of each form that has two or more spellings, one row for each.

    `class_id` is the smallest row of the class, `spelling` a digest that rows equal in every character share. However
    hot a form is, it gives as many rows as it has.
    """
    return _spelled(df, row_id, first, second)[0].select("row_id", "class_id", F.hex("raw").alias("spelling"), "n_rows", "n_spellings")


def look_alike_pairs(df: DataFrame, row_id: str, first: str, second: str) -> DataFrame:
    """(row_a, row_b), row_a < row_b: rows whose two texts look the same but differ in some character.

    Rows with a null or empty text, and pairs equal in every character, are no pairs. The key table (40 bytes a row) is
    written once; only forms with two or more spellings are joined, rows of hot forms spread over salts. A form of many
    rows has many pairs; look_alike_classes() tells the same without them.
    """
    rows, hot = _spelled(df, row_id, first, second)
    rows = cut(rows.select("form", "row_id", "raw"))
    a = rows.withColumnsRenamed({"row_id": "row_a", "raw": "raw_a"})
    b = rows.withColumnsRenamed({"row_id": "row_b", "raw": "raw_b"})
    return salted_join(a, b, "form", F.col("row_a"), hot).filter("row_a < row_b AND raw_a <> raw_b").select("row_a", "row_b")
