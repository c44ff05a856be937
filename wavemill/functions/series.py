"""Scalar functions on series held as arrays of doubles (survey 2.10): higher-order functions, JVM only; those on digits are in `digits`."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .digits import COMPACT, SPACED, DigitFormat, decimals, digits, undigits  # noqa: F401 (F32, F33)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def mean(v: Column) -> Column:
    """A01, A02; null for an empty series."""
    return F.when(F.size(v) > 0, total(v) / F.size(v))


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x evaluated once: a lambda's body that reads it is run for one element."""
    return F.element_at(F.transform(F.array(x), f), 1)


def _spread(v: Column, centre: Column, ddof: int) -> Column:
    """The deviation around a centre that is a lambda's variable, so that nothing is evaluated again for each point."""
    squares = F.aggregate(v, F.lit(0.0), lambda s, x: s + (x - centre) * (x - centre))
    return F.when(F.size(v) > ddof, F.sqrt(squares / (F.size(v) - ddof)))


def deviation(v: Column, ddof: int = 1) -> Column:
    """A01 (ddof 1), A02 (ddof 0); null where too few points are left."""
    return bound(mean(v), lambda m: _spread(v, m, ddof))


#: Variants N1 to N7 of the survey: (ddof, how a small deviation is treated, eps).
VARIANTS = {"N1": (1, "add", 1e-8), "N2": (1, "centre", 0.0), "N3": (1, "clamp", 1e-6), "N4": (0, "clamp", 1e-6), "N5": (0, "centre", 1e-6), "N6": (1, "clamp", 1e-6), "N7": (1, "centre", 1e-8)}


def guarded(sd: Column, guard: str, eps: float) -> Column:
    """the divisor. `add`: sd + eps; `clamp`: at least eps; `centre`: 1 unless sd is above eps."""
    if guard == "add":
        return sd + eps
    return F.greatest(sd, F.lit(eps)) if guard == "clamp" else F.when(sd > eps, sd).otherwise(1.0)


def znorm(v: Column, ddof: int = 1, guard: str = "clamp", eps: float = 1e-6) -> Column:
    """null where the deviation is undefined. Three passes over a series: mean, deviation, points."""
    scaled = lambda m, sd: F.when(sd.isNotNull(), F.transform(v, lambda x: (x - m) / guarded(sd, guard, eps)))
    return bound(mean(v), lambda m: bound(_spread(v, m, ddof), lambda sd: scaled(m, sd)))


def finite(v: Column) -> Column:
    """A non-empty series without null, NaN or infinity."""
    return (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def padded(v: Column, length: Column) -> Column:
    """zeros up to a length."""
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(length - F.size(v), F.lit(0))))


def padded_together(series: Column, patch: int = 4) -> Column:
    """all series of a record as long as the longest, rounded up to whole patches."""
    longest = F.array_max(F.transform(series, F.size))
    length = (F.ceil(longest / F.lit(patch)) * patch).cast("int")
    return F.transform(series, lambda v: padded(v, length))


def every_nth(v: Column, n: int | Column) -> Column:
    """points 0, n, 2n, ..."""
    return F.filter(v, lambda x, i: i % n == 0)


def resampled_lead(v: Column) -> Column:
    """every fifth point if there are over 1000."""
    return F.when(F.size(v) > 1000, every_nth(v, 5)).otherwise(v)


def transposed(m: Column, width: int) -> Column:
    """rows of `width` numbers to `width` series."""
    return F.transform(F.sequence(F.lit(1), F.lit(width)), lambda j: F.transform(m, lambda r: F.element_at(r, j)))


# Names of the twelve leads in the order of a recording.
LEADS = ["I", "II", "III", "aVR", "aVL", "aVF", "V1", "V2", "V3", "V4", "V5", "V6"]


def lead_name(index: Column) -> Column:
    """name by index from 0."""
    return F.try_element_at(F.array(*[F.lit(x) for x in LEADS]), index + 1)


def labelled(labels: list[str], series: list[Column]) -> Column:
    """array of (text, values)."""
    return F.array(*[F.struct(F.lit(a).alias("text"), b.alias("values")) for a, b in zip(labels, series, strict=True)])


def patches(v: Column, size: int = 4) -> Column:
    """Whole patches, in order; a rest that fills none is left out."""
    n = (F.size(v) / F.lit(size)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.slice(v, i * size + 1, size))).otherwise(F.expr("cast(array() as array<array<double>>)"))


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed and keys alone."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / 2**32


def simulated(id_: Column, series: int, length: int, seed: int) -> Column:
    """So many random series for an id, the same ones whenever they are made."""
    points = lambda k: F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: uniform(seed, id_, k, i))
    return F.transform(F.sequence(F.lit(0), F.lit(series - 1)), points)


def noise(v: Column, mode: str, seed: int, *keys: Column) -> Column:
    """as many points of noise. gaussian, uniform [-1, 1), zero, or the series' own points shuffled."""
    if mode == "zero":
        return F.transform(v, lambda x: F.lit(0.0))
    if mode == "uniform":
        return F.transform(v, lambda x, i: uniform(seed, *keys, i) * 2 - 1)
    if mode == "gaussian":
        return F.transform(v, lambda x, i: F.sqrt(-2 * F.log(1 - uniform(seed, *keys, F.lit("r"), i))) * F.cos(2 * math.pi * uniform(seed, *keys, F.lit("a"), i)))
    if mode == "shuffle":
        keyed = F.transform(v, lambda x, i: F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys], i.cast("string"))).alias("k"), i.alias("i"), x.alias("x")))
        return F.transform(F.array_sort(keyed), lambda s: s["x"])
    raise ValueError(f"noise mode: {mode}")


def norm(v: Column) -> Column:
    """L2."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def contribution(gate: Column, attention: Column, residual: Column) -> Column:
    """Percent that a gated branch adds; 0 without a residual."""
    return F.when(residual == 0, 0.0).otherwise(F.abs(gate) * attention / residual * 100)


def axis_limits(v: Column) -> tuple[Column, Column]:
    """the half-unit grid lines around a series, at least from -2.5 to 2.5."""
    return F.least(F.floor(F.array_min(v) * 2) / 2, F.lit(-2.5)), F.greatest(F.ceil(F.array_max(v) * 2) / 2, F.lit(2.5))


def caption(name: Column, v: Column, ddof: int = 1, decimals: int = 4) -> Column:
    """a caption with the series' statistics."""
    f = f"%.{decimals}f"
    return F.format_string(f"%s, it has mean {f} and std {f}:", name, mean(v), deviation(v, ddof))


def parsed(c: Column) -> Column:
    """JSON or list-literal text to a series; malformed is null."""
    return F.from_json(c, "array<double>")


def as_json(v: Column) -> Column:
    """F40."""
    return F.to_json(v)


def schedule(epochs: int, batches: Column, share: float = 0.03) -> tuple[Column, Column]:
    """steps and warm-up steps."""
    return batches * epochs, F.floor(batches * epochs * share).cast("long")
