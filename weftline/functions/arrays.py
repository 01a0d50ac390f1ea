"""Functions of number arrays as columns: quantization, products, sampling, packing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.binding import let

TINY = 1.1754943508222875e-38
PAD, BOS, EOS, USER, ASSISTANT, UNKNOWN = range(6)


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def scale(v: Column) -> Column:
    """Scale of a symmetric 8-bit quantization: greatest magnitude / 127, at least the least normal float."""
    return F.greatest(F.array_max(F.transform(v, lambda x: F.abs(x))) / 127, F.lit(TINY))


def quantize(v: Column, s: Column) -> Column:
    """Values / scale, rounded half to even, within -127..127."""
    return let(s, lambda s: F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x / s).cast("int")))))


def activation_scale(v: Column) -> Column:
    """As scale(), but 1 for a zero vector."""
    m = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.when(m > 0, m / 127).otherwise(F.lit(1.0))


def dequantize(q: Column, s: Column) -> Column:
    return let(s, lambda s: F.transform(q, lambda x: x * s))


def int_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("long") * y), F.lit(0).cast("long"), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is zero."""
    n = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def rms_norm(v: Column, eps: float = 1e-5) -> Column:
    return let(F.sqrt(dot(v, v) / F.size(v) + eps), lambda r: F.transform(v, lambda x: x / r))


def top_k(v: Column, k: int) -> Column:
    """(score, token) of the k greatest, greatest first; the smaller token wins a tie. k outside 1..64 means 64."""
    k = k if 1 <= k <= 64 else 64
    pairs = F.transform(v, lambda x, i: F.struct((-x).alias("minus"), i.alias("token")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda p: F.struct((-p["minus"]).alias("score"), p["token"].alias("token")))


def repetition_penalty(v: Column, history: Column, penalty: float, window: int = 64) -> Column:
    """Scores of tokens in the last `window` of the history: divided by the penalty if not negative, else multiplied."""
    if penalty <= 0:
        raise ValueError("repetition penalty must be positive")
    recent = F.when(F.size(history) > window, F.slice(history, -window, window)).otherwise(history)
    return let(recent, lambda h: F.transform(v, lambda x, i: F.when(F.array_contains(h, i), F.when(x >= 0, x / penalty).otherwise(x * penalty)).otherwise(x)))


def softmax(v: Column, temperature: float = 1.0) -> Column:
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    powers = let(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp((x - m) / temperature)))
    return let(powers, lambda e: let(total(e), lambda t: F.transform(e, lambda x: x / t)))


def draw(p: Column, u: Column) -> Column:
    """Index at which the cumulative probability first reaches u."""
    sums = F.transform(p, lambda x, i: total(F.slice(p, 1, i + 1)))
    found = F.filter(F.transform(sums, lambda s, i: F.when(s >= u, i)), lambda i: i.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.size(p) - 1)


def xorshift(x: Column) -> Column:
    """One step of the 32-bit xorshift generator on longs 0..2^32-1; a zero state is replaced first."""
    mask = F.lit(0xFFFFFFFF)
    x = F.when(x == 0, F.lit(0x6D2B79F5).cast("long")).otherwise(x.cast("long"))
    x = x.bitwiseXOR(F.shiftleft(x, 13)).bitwiseAND(mask)
    x = x.bitwiseXOR(F.shiftright(x, 17))
    return x.bitwiseXOR(F.shiftleft(x, 5)).bitwiseAND(mask)


def trim_pair(parent: Column, response: Column, payload: int, least: int = 64) -> tuple[Column, Column]:
    """Token lists cut to a payload together: `least` tokens are kept for the response, the parent keeps its end, the response its beginning."""
    n, m = F.size(parent), F.size(response)
    reserved = F.least(m, F.lit(least), F.lit(payload))
    room = F.least(n, F.lit(payload) - reserved)
    left = F.least(m, F.lit(payload) - room)
    fits = n + m <= payload
    return (
        F.when(fits, parent).when(room > 0, F.slice(parent, -F.greatest(room, F.lit(1)), room)).otherwise(F.slice(parent, 1, 0)),
        F.when(fits, response).otherwise(F.slice(response, 1, left)),
    )


def frame(parent: Column, response: Column) -> Column:
    return F.concat(F.array(F.lit(BOS), F.lit(USER)), parent, F.array(F.lit(ASSISTANT)), response, F.array(F.lit(EOS)))


def response_mask(parent: Column, response: Column) -> Column:
    """0 for the frame and the parent, 1 for the response and its end."""
    return F.concat(F.array_repeat(F.lit(0), F.size(parent) + 3), F.array_repeat(F.lit(1), F.size(response) + 1))


def prefix_weights(mask: Column, targets: Column, n: int, weight: float) -> Column:
    """Loss weights: the first n masked targets weigh more, the end mark never does."""
    sums = let(mask, lambda a: F.transform(a, lambda m, i: F.aggregate(F.slice(a, 1, i + 1), F.lit(0), lambda s, x: s + x)))
    return F.zip_with(F.arrays_zip(mask.alias("m"), sums.alias("d")), targets, lambda a, t: a["m"] * F.when((a["d"] <= n) & (a["m"] == 1) & (t != EOS), F.lit(float(weight))).otherwise(F.lit(1.0)))


def learning_rate(step: Column, warmup: int, steps: int, top: float, low: float) -> Column:
    """Linear warm-up, then a cosine down to `low`."""
    progress = (step - warmup) / float(max(1, steps - warmup))
    return F.when(step <= warmup, top * step / float(max(1, warmup))).otherwise(low + 0.5 * (1 + F.cos(F.pi() * progress)) * (top - low))


def argmax(v: Column, banned: Column | None = None) -> Column:
    """The place of the greatest value, the first of equals; banned places don't count. Null if none is left."""
    pairs = F.transform(v, lambda x, i: F.struct((-x).alias("minus"), i.alias("at")))
    if banned is not None:
        pairs = F.filter(pairs, lambda p: ~F.array_contains(banned, p["at"]))
    return F.array_min(pairs)["at"]


def masked_mean(values: Column, mask: Column) -> Column:
    """Mean of the values whose mask is not 0; 0 where there is none."""
    kept = F.filter(F.arrays_zip(values.alias("v"), mask.alias("m")), lambda x: x["m"] != 0)
    return let(F.transform(kept, lambda x: x["v"].cast("double")), lambda a: total(a) / F.greatest(F.size(a), F.lit(1)))


def margin_loss(positive: Column, negative: Column, margin: float = 0.25) -> Column:
    """How far the loss of the right answer fails to be `margin` below that of a wrong one."""
    return F.greatest(F.lit(0.0), F.lit(margin) + positive - negative)


def padded(v: Column, width: Column, pad: int = 0) -> Column:
    """The array brought to `width` by a padding value."""
    return F.concat(v, F.array_repeat(F.lit(pad).cast("long"), (width - F.size(v)).cast("int")))


def compared(a: Column, b: Column, k: int = 10) -> Column:
    """How two vectors differ: largest and mean absolute difference, cosine, and the shared part of their k greatest places."""
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y))
    places = lambda v: F.transform(top_k(v, k), lambda p: p["token"])
    return F.struct(
        F.array_max(gaps).alias("maximum_absolute"), (total(gaps) / F.size(gaps)).alias("mean_absolute"), cosine(a, b).alias("cosine"),
        (F.size(F.array_intersect(places(a), places(b))) / F.lit(float(k))).alias("top_overlap"), (F.get(places(a), F.lit(0)) == F.get(places(b), F.lit(0))).alias("top_equal"),
    )
