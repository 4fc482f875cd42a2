"""Small numeric expressions: classes, transforms, ranges and hash-based draws."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from punctual.settings import LATE_AFTER_MINUTES, MAX_PLAUSIBLE_DELAY, MIN_PLAUSIBLE_DELAY

# Offset of the log transform, cap of the clipped one, bounds of a probability in a logit
LOG_OFFSET = 61.0
CLIP_MINUTES = 300.0
LOGIT_EPSILON = 1e-6


def plausible(delay: Column) -> Column:
    return F.when(delay.between(MIN_PLAUSIBLE_DELAY, MAX_PLAUSIBLE_DELAY), delay)


def late_flag(delay: Column, after: float = LATE_AFTER_MINUTES) -> Column:
    return (delay > after).cast("int")


def delay_class(delay: Column) -> Column:
    return F.when(delay <= -0.001, "Early").when(delay <= 15, "On Time").when(delay > 15, "Late")


def delay_class_long(delay: Column) -> Column:
    return F.when(delay <= 15, "On time").when(delay <= 60, "Late").when(delay > 60, "Very late")


TARGET_TRANSFORMS = {
    "none": (lambda y: y.cast("double"), lambda z: z),
    "log": (lambda y: F.log(y + LOG_OFFSET), lambda z: F.exp(z) - LOG_OFFSET),
    "clip_300": (lambda y: F.least(y, F.lit(CLIP_MINUTES)), lambda z: z),
}


def logit(p: Column) -> Column:
    safe = F.greatest(F.least(p, F.lit(1 - LOGIT_EPSILON)), F.lit(LOGIT_EPSILON))
    return F.log(safe / (1 - safe))


def ordered_range(low: Column, mid: Column, high: Column, margin: float | Column = 0.0) -> list[Column]:
    """The three values in order, the outer two moved out by `margin` but never past the middle one."""
    ranked = F.array_sort(F.array(low, mid, high))
    a, b, c = (F.element_at(ranked, i) for i in (1, 2, 3))
    m = F.lit(margin) if isinstance(margin, (int, float)) else margin
    return [F.least(a - m, b), b, F.greatest(c + m, b)]


def right_closed_bin(value: Column, edges: list[float]) -> Column:
    """Index of the (lower, upper] interval holding `value`, null outside."""
    chain = F.when(value <= edges[0], F.lit(None).cast("int"))
    for i, upper in enumerate(edges[1:]):
        chain = chain.when(value <= upper, i)
    return chain


def bounded_bucket(value: Column, low: float, high: float, count: int) -> Column:
    """Equal-width bucket 0..count-1 of the value clipped to [low, high]."""
    clipped = F.greatest(F.least(value, F.lit(float(high))), F.lit(float(low)))
    return F.least(F.floor((clipped - low) * count / (high - low)), F.lit(count - 1)).cast("int")


# ------------------------------------------------------------------ draws from hashes


def hash_hex(seed: int, *columns: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def hash_uniform(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends only on the seed and the values."""
    return F.conv(F.substring(hash_hex(seed, *columns), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def poisson_limits() -> list[str]:
    """Upper hash prefixes of the Poisson(1) counts 0, 1, 2, ...: eight hex digits compare like numbers."""
    limits, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        if total * 2**32 > 2**32 - 1:
            return limits
        limits.append(f"{math.ceil(total * 2**32):08x}")
        k += 1


def poisson_weight(prefix: Column) -> Column:
    """Poisson(1) draw from eight hex digits of a hash."""
    limits = poisson_limits()
    chain = F.when(prefix < limits[0], 0)
    for k, limit in enumerate(limits[1:], 1):
        chain = chain.when(prefix < limit, k)
    return chain.otherwise(len(limits))
