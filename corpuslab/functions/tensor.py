"""Vector math on array columns, in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: inside a lambda a column is computed anew for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def matrix_vector(rows: Column, x: Column) -> Column:
    """One product for each row of an array of arrays."""
    return F.transform(rows, lambda r: dot(r, x))


def layer_norm(a: Column, weight: float = 1.0, bias: float = 0.0, eps: float = 1e-5) -> Column:
    """Mean and deviation are taken once a vector, so that the work grows with its length and not with a power of it.
    A null entry stays null and adds nothing to either; the length counts it."""
    n = F.greatest(F.size(a), F.lit(1))

    def scaled(mean: Column) -> Column:
        var = F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce((x - mean) * (x - mean), F.lit(0.0))) / n
        return _once(F.sqrt(var + eps), lambda dev: F.transform(a, lambda x: (x - mean) / dev * weight + bias))

    return _once(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0))) / n, scaled)


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26."""
    z = F.abs(x)
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = t * (0.2548296 + t * (-0.28449674 + t * (1.4214137 + t * (-1.453152 + t * 1.0614054))))
    y = 1.0 - poly * F.exp(-z * z)
    return F.when(x < 0, -y).otherwise(y)


def gelu(x: Column) -> Column:
    x = x.cast("double")
    return 0.5 * x * (1.0 + erf(x * 0.7071067811865476))


def quantize_int8(a: Column) -> Column:
    """Symmetric: struct of values (-127..127, half to even) and their scale."""
    scale = F.greatest(F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))), F.lit(1e-8)) / 127.0
    values = F.transform(a, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.bround(x.cast("double") / scale, 0).cast("int"))).cast("tinyint"))
    return F.struct(values.alias("values"), scale.alias("scale"))


def dequantize_int8(q: Column) -> Column:
    return F.transform(q["values"], lambda v: v * q["scale"])


def log_normalizer(a: Column) -> Column:
    """Log of the sum of exponentials, shifted by the largest."""
    top = F.array_max(doubles(a))
    return top + F.log(_sum(F.transform(a, lambda x: F.exp(x.cast("double") - top))))


def softmax(a: Column) -> Column:
    z = log_normalizer(a)
    return F.transform(a, lambda x: F.exp(x.cast("double") - z))


def interpolate(base: Column, tuned: Column, alpha: float) -> Column:
    return F.zip_with(base, tuned, lambda b, t: b.cast("double") + alpha * (t.cast("double") - b.cast("double")))
