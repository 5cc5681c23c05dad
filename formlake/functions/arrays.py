"""Array helpers that stay inside one row, so no operator built on them shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once per row and use it in `body`.

    Without this, collapsing projections may move a costly expression into a
    lambda, where it is computed again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def each(df: DataFrame, keep: list, array: Column, value: str, position: str = "_at") -> DataFrame:
    """One row per element of `array`, with its position.

    The outer form is used because the plain one makes the optimizer add a filter on
    the array's size, which computes a costly array twice; empty arrays are dropped after.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(position, value)).filter(F.col(position).isNotNull())
    return rows.drop("_at")


def indexes(n: Column) -> Column:
    """[0, 1, ..., n-1]; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n.cast("int") - 1)).otherwise(
        F.array().cast("array<int>")
    )


SUM_BLOCK = 256


def running_sums(values: Column) -> Column:
    """Sum of the elements before each one. Blocks of 256 keep the work in proportion to the
    length, where a fold that appends to its result would copy it at every step."""

    def total(some: Column) -> Column:
        return F.aggregate(some, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def before(some: Column, base: Column) -> Column:
        return F.transform(some, lambda x, i: base + total(F.slice(some, F.lit(1), i)))

    def blocks(array: Column) -> Column:
        return F.transform(indexes(F.ceil(F.size(array) / SUM_BLOCK)), lambda b: F.slice(array, b * SUM_BLOCK + 1, SUM_BLOCK))

    def summed(parts: Column) -> Column:
        bases = before(F.transform(parts, total), F.lit(0).cast("long"))
        return bind(bases, lambda b: F.flatten(F.transform(parts, lambda part, i: before(part, F.get(b, i)))))

    return bind(F.transform(values, lambda x: x.cast("long")), lambda v: bind(blocks(v), summed))


def mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return total / F.greatest(F.size(values), F.lit(1))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def hash_ranks(n: Column, key: Column) -> Column:
    """md5 of `key:i` for each index i: a reproducible random order of n elements."""
    return F.transform(indexes(n), lambda i: F.md5(F.concat(key, F.lit(":"), i.cast("string"))))


def hash_number(text: Column) -> Column:
    """Non-negative integer below 2**32 taken from the md5 of `text`."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def hash_pick(bank: Column, size: Column, text: Column) -> Column:
    """Element of `bank` chosen by the hash of `text`."""
    return F.element_at(bank, (hash_number(text) % size + 1).cast("int"))
