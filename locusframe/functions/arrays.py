"""Reductions and masks over the arrays of a row, and a hook for functions over Arrow batches.

A missing number is NULL here. Reductions skip NULLs where their name begins with nan, and give
NULL when there is one otherwise. Logic has two values: NULL counts as false.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COLUMN = Column


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def minimum(array: Column) -> Column:
    return F.when(~has_missing(array), F.array_min(array))


def maximum(array: Column) -> Column:
    return F.when(~has_missing(array), F.array_max(array))


def has_missing(array: Column) -> Column:
    return F.exists(array, lambda x: x.isNull())


def is_missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def is_infinite(x: Column) -> Column:
    return F.coalesce(F.abs(x) == float("inf"), F.lit(False))


def is_finite(x: Column) -> Column:
    return ~is_missing(x) & ~is_infinite(x)


def count_nonzero(array: Column) -> Column:
    return F.size(F.filter(array, lambda x: F.coalesce(x.cast("double") != 0, F.lit(False))))


def nansum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def nanmean(array: Column) -> Column:
    return F.try_divide(nansum(array), F.size(F.filter(array, lambda x: x.isNotNull())).cast("double"))


def stack(*columns: Column) -> Column:
    return F.array(*columns)


def full(n: int | Column, value) -> Column:
    return F.array_repeat(F.lit(value), n if isinstance(n, _COLUMN) else F.lit(n))


def ones(n: int | Column) -> Column:
    return full(n, 1)


def _truth(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def logical_and(a: Column, b: Column) -> Column:
    return _truth(a) & _truth(b)


def logical_or(a: Column, b: Column) -> Column:
    return _truth(a) | _truth(b)


def logical_not(a: Column) -> Column:
    return ~_truth(a)


def any_of(array: Column) -> Column:
    return F.exists(array, _truth)


def all_of(array: Column) -> Column:
    return F.forall(array, _truth)


def add(a: Column, b: Column) -> Column:
    """Place by place; arrays of one size."""
    return F.zip_with(a, b, lambda x, y: x + y)


def assign_with_mask(array: Column, using: Column, mask: Column) -> Column:
    """array with using where mask, an array of booleans, is true."""
    return F.zip_with(array, mask, lambda x, m: F.when(_truth(m), using).otherwise(x))


def map_blocks(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """f over batches of rows, for what columns can't express."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield f(b)

    return df.mapInArrow(run, schema)
