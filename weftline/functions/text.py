"""Text functions as columns. All are null-in, null-out unless they say otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.binding import let

# What the site writes in place of a deleted comment, in lower case.
DELETED_MARKERS = (
    "этот материал был удален по просьбе автора",
    "этот материал был удалн по просьбе автора",
    "комментарий недоступен",
    "комментарий удален автором поста",
)
#: A word: letters, digits and underscores (Java's \\w is ASCII only, and (?U) means another thing elsewhere).
WORD = r"[\p{L}\p{N}_]+"
SENTENCE_END = r"[.!?]+(?:\s|$)"


def fold(text: Column) -> Column:
    """Case folding: lower case, sharp s written out (ligatures and the like stay)."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def tidy(text: Column) -> Column:
    """Line ends as LF, runs of blanks as one blank, lines trimmed, at most one empty line in a row; empty becomes null."""
    x = F.regexp_replace(text, "\r\n?", "\n")
    x = F.regexp_replace(x, r"[ \t\x0B\f]{2,}|[\t\x0B\f]", " ")
    x = F.regexp_replace(x, " *\n *", "\n")
    x = F.regexp_replace(x, "\n{3,}", "\n\n")
    x = F.btrim(x, F.lit(" \n"))
    return F.nullif(x, F.lit(""))


def is_deleted(text: Column) -> Column:
    """Whether a text holds one of the deleted markers, in any case."""
    return F.regexp_like(fold(text), F.lit("|".join(DELETED_MARKERS)))


def clean(text: Column) -> Column:
    """tidy(), and null where the comment is deleted."""
    # one expression over the tidied text, so that its rules run once
    marked = F.regexp_replace(tidy(text), f"(?isu)^.*?(?:{'|'.join(DELETED_MARKERS)}).*$", "")
    return F.nullif(marked, F.lit(""))


def words(text: Column) -> Column:
    """Folded words in order, io written as ie."""
    return F.regexp_extract_all(F.replace(fold(text), F.lit("ё"), F.lit("е")), F.lit(f"({WORD})"), 1)


def normalized(text: Column) -> Column:
    """The folded words joined by blanks."""
    return F.array_join(words(text), " ")


def sentence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SENTENCE_END)).cast("long")


def letter_count(text: Column, alphabet: str = "а-яё") -> Column:
    return F.regexp_count(F.lower(text), F.lit(f"[{alphabet}]")).cast("long")


def content_id(text: Column, prefix: str = "", length: int = 24) -> Column:
    """A stable id: a prefix and the beginning of the SHA-256 of the text."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, length))


def coalesce_id(given: Column, text: Column) -> Column:
    """The given id, or the SHA-256 of the text where it is null or empty."""
    return F.coalesce(F.nullif(given, F.lit("")), F.sha2(text, 256))


def serialize(prompt: Column, response: Column) -> Column:
    return F.concat(F.lit("<user>"), prompt, F.lit("<assistant>"), response)


def fill(template: Column, **values: Column) -> Column:
    """The template with each {name} replaced."""
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), v)
    return template


def lower_first(text: Column) -> Column:
    return F.concat(F.lower(F.left(text, F.lit(1))), F.substr(text, F.lit(2)))


def strip_fence(text: Column) -> Column:
    """A reply without the code fence around it."""
    bare = lambda c: F.btrim(c, F.lit(" \t\r\n"))
    x = bare(text)
    return F.when(x.startswith("```"), bare(F.regexp_replace(F.regexp_replace(x, r"^[^\n]*\n", ""), r"```[^`]*$", ""))).otherwise(x)


def topic_hit(text: Column, terms: Column) -> Column:
    """Whether the folded text holds any of the folded terms."""
    plain = lambda c: F.replace(fold(c), F.lit("ё"), F.lit("е"))
    return let(plain(text), lambda x: F.exists(terms, lambda t: F.contains(x, plain(t))))


def ngrams(items: Column, order: int = 3) -> Column:
    """All runs of `order` neighbouring items."""
    return let(items, lambda a: F.when(F.size(a) >= order, F.transform(F.sequence(F.lit(0), F.size(a) - order), lambda i: F.slice(a, i + 1, order))).when(a.isNotNull(), F.array().cast("array<array<string>>")))


def repeat_rate(items: Column, order: int = 3) -> Column:
    """Share of n-grams that repeat another; 0 for fewer items than an n-gram has."""
    # joined grams are told apart by hash, lists only by comparing all pairs
    joined = F.transform(ngrams(items, order), lambda g: F.array_join(g.cast("array<string>"), "\x01"))
    return let(joined, lambda g: F.when(F.size(g) > 0, 1 - F.size(F.array_distinct(g)) / F.size(g)).otherwise(F.when(g.isNotNull(), F.lit(0.0))))


def exact_echo(prompt: Column, response: Column) -> Column:
    p, r = normalized(prompt), normalized(response)
    return (p != "") & (p == r)


def prefix_echo(prompt: Column, response: Column) -> Column:
    p, r = normalized(prompt), normalized(response)
    return (p != "") & ((p == r) | r.startswith(F.concat(p, F.lit(" "))))


def split_bucket(key: Column, buckets: int = 100) -> Column:
    """A stable bucket of a key, by the first 60 bits of its MD5."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % buckets


#: Blanks and line ends of any script.
BLANKS = r"[\p{Z}\t\n\x0B\f\r\x{85}]+"


def typed(text: Column) -> Column:
    """What a user typed, without blanks and line ends around it; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(text, "^" + BLANKS, ""), BLANKS + "$", ""), F.lit(""))


def overlap(a: Column, b: Column) -> Column:
    """Shared different items of two arrays, as a share of the smaller; 0 where one is empty."""
    least = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))
