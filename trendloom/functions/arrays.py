"""Dense-vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def dot(a: str | Column, b: str | Column) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def euclidean(a: str | Column, b: str | Column) -> Column:
    def gap(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.sqrt(total(F.zip_with(_c(a), _c(b), gap)))


def zeros(n: int) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def left_pad(values: Column, n: int, fill: Column) -> Column:
    """Exactly n entries, short arrays filled on the left."""
    return F.concat(F.array_repeat(fill, F.lit(n) - F.size(values)), values)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def code_rates(dim: int) -> list[float]:
    """10^(-9 j / (dim - 1)), j = 0 .. dim-1: the rates of the cosine time code."""
    step = 9.0 / max(dim - 1, 1)
    return [10.0 ** (-step * j) for j in range(dim)]


def time_encode(t: str | Column, dim: int) -> Column:
    """The cosine of a time span at each rate of the weight-free time code."""
    x = _c(t).cast("double")
    return F.array(*[F.cos(x * F.lit(w)) for w in code_rates(dim)])


def element_means(column: str, size: int) -> list[Column]:
    """One average per place of a fixed-length array, so that the mean vector needs no collected list."""
    return [F.avg(F.col(column)[j]).alias(f"_{column}_{j}") for j in range(size)]


def element_sums(column: str, size: int) -> list[Column]:
    return [F.sum(F.col(column)[j]).alias(f"_{column}_{j}") for j in range(size)]


def gather(column: str, size: int) -> Column:
    return F.array(*[F.col(f"_{column}_{j}") for j in range(size)])
