"""Column expressions over numeric arrays (JVM-side higher-order functions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double_array(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.transform(c, lambda x: x.cast("double"))


def array_sum(col: Column) -> Column:
    return F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x)


# Divisors that are zero only for degenerate rows (empty or one-element arrays,
# all-zero vectors) use try_divide: such a row gets null instead of failing the
# job under ANSI mode.

def array_mean(col: Column) -> Column:
    return F.try_divide(array_sum(col), F.size(col))


def array_std(col: Column, mean: Column) -> Column:
    """Sample standard deviation (n - 1) of an array."""
    ss = F.aggregate(col, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.sqrt(F.try_divide(ss, F.size(col) - 1))


def array_norm(col: Column) -> Column:
    return F.sqrt(F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x * x))


def array_mean_square(col: Column) -> Column:
    return F.try_divide(F.aggregate(col, F.lit(0.0), lambda acc, x: acc + x * x), F.size(col))


def array_sq_error(a: Column, b: Column) -> Column:
    """Mean squared difference of two equally long arrays."""
    return F.try_divide(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)),
                                    F.lit(0.0), lambda acc, x: acc + x), F.size(a))


def softplus(z: Column) -> Column:
    """log(1 + exp(z)) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def round6(col: Column | str) -> Column:
    """Round to 6 decimals and fold -0.0 into 0.0 (stable value hashes)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), 6) + F.lit(0.0)


def explode_indexed(col: Column | str) -> Column:
    """``posexplode`` for arrays built by higher-order functions.

    A plain ``posexplode`` makes the optimizer infer ``size(arr) > 0`` and push
    it below the projections by inlining the whole array expression, which
    turns an O(d) row into O(d^3) work. The outer form gets no inferred filter;
    callers drop the null row it emits for an empty array with
    ``filter(pos is not null)`` when empty arrays can occur.
    """
    c = F.col(col) if isinstance(col, str) else col
    return F.posexplode_outer(c)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body``.

    The optimizer inlines a projected column into every expression that uses
    it; for an expensive value used per array element (a split text used by
    every chunk, a token array used by every position) that repeats the whole
    computation. Binding it to a lambda variable keeps it computed once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
