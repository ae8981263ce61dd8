"""Vector arithmetic on ARRAY<FLOAT|DOUBLE> columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def let(value: Column, body) -> Column:
    """Evaluate `value` once per row and hand it to `body`; a plain reference inside a lambda
    would be computed again for every element."""
    return F.transform(F.array(value), body)[0]


def unit(a: Column) -> Column:
    """Vector of length one; NULL for a zero vector."""
    wide = doubles(a)
    return let(norm(wide), lambda length: F.when(length > 0, F.transform(wide, lambda x: x / length)))


def cosine(a: Column, b: Column) -> Column:
    x, y = doubles(a), doubles(b)
    return F.try_divide(dot(x, y), norm(x) * norm(y))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def has_dimension(v: Column, size: int) -> Column:
    return F.size(v) == size


def row_shares(v: Column) -> Column:
    """Values scaled to sum one; a row of zeros becomes uniform."""
    whole = F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    uniform = F.try_divide(F.lit(1.0), F.size(v))
    return F.when(whole == 0, F.array_repeat(uniform, F.size(v))).otherwise(
        let(F.nullif(whole, F.lit(0.0)), lambda w: F.transform(v, lambda x: x / w))
    )
