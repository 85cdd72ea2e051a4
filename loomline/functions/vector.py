"""Vector functions as built-in expressions; they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column) -> Column:
    return F.transform(c, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_d(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; null for a zero vector."""
    n = norm(a) * norm(b)
    return F.when(n > 0, F.lit(1.0) - dot(a, b) / n)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def negative_dot(a: Column, b: Column) -> Column:
    return -dot(a, b)


METRICS = {"cosine": cosine_distance, "squared_l2": squared_l2, "negative_dot": negative_dot}


def scaled_cosine(a: Column, b: Column) -> Column:
    """Cosine with both vectors scaled by their largest element first, clamped to -1..1."""

    def scaled(v: Column) -> Column:
        top = F.array_max(F.transform(_d(v), F.abs))
        return F.transform(_d(v), lambda x: x / top)

    x, y = scaled(a), scaled(b)
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(x, y) / (norm(x) * norm(y))))


def q15(a: Column) -> Column:
    """Elements of -1..1 as 15-bit integers, halves away from zero."""
    return F.transform(_d(a), lambda x: F.round(x * 32767).cast("bigint"))


def _integer_root(x: Column) -> Column:
    """The floored square root of a whole DECIMAL: the double's, put right by one where rounding went astray."""
    about = F.floor(F.sqrt(x.cast("double"))).cast("decimal(18,0)")
    one = F.lit(1).cast("decimal(1,0)")
    return F.when(about * about > x, about - one).when((about + one) * (about + one) <= x, about + one).otherwise(about)


def q15_cosine_nanos(a: Column, b: Column) -> Column:
    """Cosine of integer vectors in billionths by whole numbers only: floored root, halves away from zero; null for a zero vector."""
    part = lambda u, v: F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0).cast("bigint"), lambda s, x: s + x)
    norms = part(a, a).cast("decimal(18,0)") * part(b, b).cast("decimal(18,0)")
    root, dot = _integer_root(norms).cast("decimal(19,0)"), part(a, b)
    half = F.floor(root / 2).cast("decimal(19,0)")
    # the dividend has up to 28 digits; the quotient of whole numbers is cut, not rounded
    above = F.abs(dot).cast("decimal(18,0)") * F.lit(1_000_000_000).cast("decimal(10,0)") + half
    nanos = F.least(((above - above % root) / root).cast("bigint"), F.lit(1_000_000_000))
    return F.when(root > 0, F.when(dot < 0, -nanos).otherwise(nanos))


def sq8_range(values: list[tuple[float, float]]) -> tuple[float, float]:
    """The global range of training vectors from their least and greatest elements; a range of 0, or one that is not finite, is refused."""
    low, high = min((v[0] for v in values), default=0.0), max((v[1] for v in values), default=0.0)
    if not 0 < high - low < float("inf"):
        raise ValueError("no range to quantize over")
    return low, high


def sq8(a: Column, low: float, high: float) -> Column:
    """8-bit codes over the global range."""
    return F.transform(_d(a), lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.round((x - low) / (high - low) * 255).cast("int"))))


def sq8_squared_l2(a: Column, b: Column, low: float, high: float) -> Column:
    step = (high - low) / 255
    return squared_l2(a, b) * F.lit(step * step)


def normalized(a: Column, size: int, epsilon: float = 1e-12) -> Column:
    """The first ``size`` elements at unit length."""
    cut = F.slice(a, 1, size)
    n = F.greatest(norm(cut), F.lit(epsilon))
    return F.transform(_d(cut), lambda x: x / n)
