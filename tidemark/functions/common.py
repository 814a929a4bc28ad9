"""Small expression helpers shared by all modules."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F


def col(value) -> Column:
    """A column, given a name or a column."""
    return F.col(value) if isinstance(value, str) else value


def missing(value) -> Column:
    """True for null and for NaN."""
    value = col(value)
    return value.isNull() | F.isnan(value.cast("double"))


def finite(value) -> Column:
    """The number, with NaN and the infinities turned to null."""
    value = col(value).cast("double")
    bad = F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(~bad, value)


def first_match(rules: Iterable[tuple[Column, Column]], otherwise=None) -> Column:
    """The value of the first rule that holds."""
    rules = list(rules)
    chain = F.when(*rules[0])
    for condition, value in rules[1:]:
        chain = chain.when(condition, value)
    return chain if otherwise is None else chain.otherwise(otherwise)


def all_of(conditions: Iterable[Column]) -> Column:
    """Conjunction; true for no conditions."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    """Disjunction; false for no conditions."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def tally(condition: Column) -> Column:
    """Number of rows for which the condition holds."""
    return F.count(F.when(condition, 1))


def uniform(seed: int, *keys) -> Column:
    """A repeatable number in [0, 1) out of row keys, the same on every run."""
    mixed = F.xxhash64(F.lit(seed), *[col(k) for k in keys])
    return F.pmod(mixed, F.lit(1 << 53)) / F.lit(float(1 << 53))
