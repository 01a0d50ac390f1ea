"""Scores of a judge: typed parsing, validity, acceptance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORES = ("relevance", "directness", "fluency", "style", "non_repetition")
FLAGS = ("hidden_context", "prompt_copy")
SCHEMA = "self_contained boolean, scores array<struct<" + ", ".join([f"{s}: int" for s in SCORES] + [f"{f}: boolean" for f in FLAGS]) + ">>"


def parse(reply: Column) -> Column:
    """The judgment as a struct; a field of another JSON type is null (a true is no number, a number no flag)."""
    from weftline.functions.text import strip_fence

    return F.from_json(strip_fence(reply), SCHEMA)


def valid(judgment: Column, count: Column | int) -> Column:
    """Whether the judgment has a verdict on the prompt and `count` scores, all within 0..5, with both flags."""
    n = F.lit(count) if isinstance(count, int) else count
    whole = F.forall(judgment["scores"], lambda s: F.coalesce(_all([s[k].between(0, 5) for k in SCORES] + [s[k].isNotNull() for k in FLAGS]), F.lit(False)))
    return F.coalesce(judgment["self_contained"].isNotNull() & (F.size(judgment["scores"]) == n) & whole, F.lit(False))


def acceptable(score: Column, core: int = 4, style: int = 3) -> Column:
    return F.coalesce(_all([score[k] >= core for k in SCORES if k != "style"]) & (score["style"] >= style) & ~score["hidden_context"] & ~score["prompt_copy"], F.lit(False))


def rank_score(score: Column) -> Column:
    return 5 * score["relevance"] + 3 * score["directness"] + score["fluency"] + score["style"]


def ids_match(ids: Column, count: Column) -> Column:
    """Whether the ids are 0..count-1, each once."""
    return F.coalesce(F.array_sort(ids) == F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), F.lit(False))


def agreement(expected: Column, predicted: Column) -> Column:
    """Share of places where two lists of decisions agree."""
    return F.aggregate(F.zip_with(expected, predicted, lambda a, b: (a == b).cast("double")), F.lit(0.0), lambda s, x: s + x) / F.size(expected)


#: An item of a reply about many candidates: scores from 0 to 5, flags, and the candidate picked.
BATCH_SCHEMA = "struct<i: int, pick: string, r: int, d: int, f: int, s: int, n: int, h: boolean, c: boolean>"


def batch_valid(item: Column) -> Column:
    """Whether an item has all scores within 0..5, both flags and a pick of a or b."""
    return F.coalesce(_all([item[k].between(0, 5) for k in "rdfsn"] + [item[k].isNotNull() for k in "hc"] + [item["pick"].isin("a", "b")]), F.lit(False))


def batch_acceptable(item: Column, core: int = 4, style: int = 3) -> Column:
    """Whether a valid item's scores and flags let its pick pass; the text itself is judged by filters.response_rejection."""
    return batch_valid(item) & F.coalesce((F.least(*[item[k] for k in "rdfn"]) >= core) & (item["s"] >= style) & ~item["h"] & ~item["c"], F.lit(False))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out
