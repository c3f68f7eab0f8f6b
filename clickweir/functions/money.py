"""Exact sums of amounts.

Amounts are summed as whole cents in 64-bit integers: the sum does not depend on the order of addition, the
aggregate buffer is a single long, and an overflow raises instead of wrapping. Decimal sums are as exact but
several times slower, because Spark keeps wide decimals as objects.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import MONEY


def cents(amount: Column) -> Column:
    """Whole cents of an amount, which is rounded to two decimals: exact for all sixteen whole digits of the declared
    type, and an error beyond them."""
    return (amount.cast(MONEY) * 100).cast("bigint")


def dollars(cents: Column) -> Column:
    """Cents to a double amount; missing is 0."""
    return F.coalesce(cents, F.lit(0)).cast("double") / 100


def amount_sum(column: str, where: Column | None = None) -> Column:
    """Sum of amounts, optionally of some rows only; 0 when there are none."""
    value = cents(F.col(column))
    return dollars(F.sum(value if where is None else F.when(where, value)))
