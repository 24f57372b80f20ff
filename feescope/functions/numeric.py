"""Money, ratios and exact weighted means as Column expressions.

``try_cast`` is used throughout: unparsable or overflowing values become NULL
whether ANSI mode is on or off.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..schemas import MONEY, RATIO


def to_money(value: Column) -> Column:
    """Round half up to cents."""
    return value.try_cast(MONEY)


def to_ratio(value: Column) -> Column:
    """Round half up to six decimals."""
    return value.try_cast(RATIO)


def whole_number(text: Column, kind: str) -> Column:
    """Parse ``12``, ``12.0`` or ``1e3`` and truncate toward zero."""
    return text.try_cast("double").try_cast(kind)


def guarded_ratio(num: Column, den: Column) -> Column:
    """``num / den`` as a ratio where ``den`` is positive, else NULL."""
    return F.when(den > 0, to_ratio(num / den))


def guarded_money(num: Column, den: Column) -> Column:
    """``num / den`` in cents where ``den`` is positive, else NULL."""
    return F.when(den > 0, to_money(num / den))


def money_total(avg: Column, n: Column) -> Column:
    """Row total of an average amount over ``n`` units, in cents."""
    return to_money(avg * n)


def sum_money(value: Column) -> Column:
    """Sum in cents; one beyond ``decimal(18,2)`` fails the query rather than become NULL."""
    total = F.sum(value)
    money = to_money(total)
    overflow = F.raise_error(F.lit("money total beyond decimal(18,2)")).cast(MONEY)
    return F.when(total.isNotNull() & money.isNull(), overflow).otherwise(money)


def weighted_sum(value: Column, weight: Column) -> Column:
    """Sum of ``value * weight`` added in decimal.

    A sum of doubles depends on the order in which tasks finish. Decimal
    products make it associative: (22,10) x (15,0) is (38,10), exactly as wide as
    a decimal can be, and its sum keeps all ten decimals.
    """
    return F.sum(value.try_cast("decimal(22,10)") * weight.try_cast("decimal(15,0)"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Weighted mean in cents; numerator rounded to cents before dividing.

    The weight of a row counts even where its value is NULL.
    """
    return guarded_money(to_money(weighted_sum(value, weight)), F.sum(weight))
