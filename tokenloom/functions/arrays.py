"""Arithmetic on arrays of numbers, as columns: what small neural layers are made of.

Null arrays give null, empty ones an empty array.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def doubles(a: Column) -> Column:
    return a.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def linear(weights: Column, x: Column) -> Column:
    """Each row of ``weights`` times ``x``."""
    return F.transform(weights, lambda row: dot(row, x))


def silu_of(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def silu(a: Column) -> Column:
    return F.transform(doubles(a), silu_of)


def swiglu(w1: Column, w2: Column, w3: Column, x: Column) -> Column:
    gated = F.zip_with(silu(linear(w1, x)), linear(w3, x), lambda a, b: a * b)
    return linear(w2, gated)


def rmsnorm(a: Column, weight: Column | None = None, eps: float = 1e-5) -> Column:
    a = doubles(a)
    root = F.sqrt(_sum(F.transform(a, lambda x: x * x)) / F.size(a) + F.lit(eps))
    out = F.transform(a, lambda x: x / root)
    return out if weight is None else F.zip_with(out, doubles(weight), lambda x, w: x * w)


def softmax(a: Column) -> Column:
    """The greatest number is taken off first, so that nothing overflows."""
    a = doubles(a)
    most = F.array_max(a)
    e = F.transform(a, lambda x: F.exp(x - most))
    # An array of one element binds the sum, which is else taken anew for each number.
    held = F.array(F.struct(e.alias("e"), _sum(e).alias("total")))
    return F.flatten(F.transform(held, lambda h: F.transform(h["e"], lambda x: x / h["total"])))


def log_sum_exp(a: Column) -> Column:
    a = doubles(a)
    most = F.array_max(a)
    return most + F.log(_sum(F.transform(a, lambda x: F.exp(x - most))))


def cross_entropy(logits: Column, target: Column) -> Column:
    """Of one row; ``target`` counts from 0. Average it over the rows."""
    return log_sum_exp(logits) - F.element_at(doubles(logits), target + 1)


def rope(a: Column, position: Column, theta: float = 10_000.0) -> Column:
    """Pairs of neighbours turned by an angle that falls with their place."""
    a = doubles(a)
    n = F.size(a)
    places = F.sequence(F.lit(0), n - 1)

    def turned(i: Column) -> Column:
        even = (i % 2) == 0
        angle = position / F.pow(F.lit(theta), (i - i % 2).cast("double") / n)
        mine, other = F.element_at(a, i + 1), F.element_at(a, F.when(even, i + 2).otherwise(i))
        return mine * F.cos(angle) + F.when(even, -other).otherwise(other) * F.sin(angle)

    return F.when(n > 0, F.transform(places, turned)).when(a.isNotNull(), a)


def attention(query: Column, keys: Column, values: Column, mask: Column | None = None) -> Column:
    """One query against arrays of keys and values; masked-out places count for nothing."""
    scale = F.sqrt(F.size(query).cast("double"))
    scores = F.transform(keys, lambda k: dot(query, k) / scale)
    if mask is not None:
        scores = F.zip_with(scores, mask, lambda s, m: F.when(m, s).otherwise(F.lit(float("-inf"))))
    weights = softmax(scores)
    width = F.size(F.element_at(values, 1))
    return F.transform(
        F.sequence(F.lit(1), width),
        lambda j: _sum(F.zip_with(weights, values, lambda w, v: w * F.element_at(doubles(v), j))),
    )


def clip_factor(total_square: Column, most: float, eps: float = 1e-6) -> Column:
    """By what all gradients are multiplied, given the sum of their squares."""
    norm = F.sqrt(total_square)
    return F.when(norm > most, F.lit(most) / (norm + eps)).otherwise(F.lit(1.0))


def cosine_rate(step: Column, most: float, least: float, warmup: int, cycle: int) -> Column:
    """Learning rate: a straight rise, half a cosine, then the least."""
    part = (step - warmup) / (cycle - warmup)
    return (
        F.when(step < warmup, step / warmup * most)
        .when(step <= cycle, least + 0.5 * (1 + F.cos(F.pi() * part)) * (most - least))
        .otherwise(F.lit(least))
    )


def windows(tokens: Column, length: int) -> Column:
    """All ``struct(x, y)`` of ``length`` tokens and the same shifted by one."""
    last = F.size(tokens) - length
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        starts,
        lambda i: F.struct(
            F.slice(tokens, i, F.lit(length)).alias("x"), F.slice(tokens, i + 1, F.lit(length)).alias("y")
        ),
    )


def sample_starts(key: Column, places: Column, many: int, seed: int) -> Column:
    """``many`` numbers from 0 to ``places`` - 1, each as likely as the others and the same
    for the same ``key`` and ``seed``: steps of a multiplicative generator modulo a prime."""
    # The modulus 2^31 - 1 and a public multiplier for it.
    prime, factor = 2_147_483_647, 48_271
    first = F.pmod(key.cast("long") * 1_000_003 + seed, F.lit(prime - 1)) + 1
    drawn = lambda i: ((first * (i + 1) % prime) * factor % prime) * factor % prime
    return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")), lambda i: drawn(i) % places)


def sample_batch(tokens: Column, key: Column, many: int, length: int, seed: int) -> Column:
    """``many`` windows ``struct(x, y)`` drawn from all that ``windows`` gives, with
    repetition; none where there is no window."""
    places = F.size(tokens) - length
    each = F.transform(
        sample_starts(key, F.greatest(places, F.lit(1)), many, seed),
        lambda i: F.struct(
            F.slice(tokens, (i + 1).cast("int"), F.lit(length)).alias("x"),
            F.slice(tokens, (i + 2).cast("int"), F.lit(length)).alias("y"),
        ),
    )
    return F.when(places > 0, each).when(tokens.isNotNull(), F.slice(each, 1, 0))
