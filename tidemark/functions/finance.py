"""Discounting."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.common import col


def discount_factor(months, annual_rate) -> Column:
    """``1 / (1 + r) ** (months / 12)``; null for negative months or a rate <= -1."""
    months = col(months).cast("double")
    rate = annual_rate if isinstance(annual_rate, Column) else F.lit(float(annual_rate))
    return F.when((months >= 0) & (rate > -1), 1 / F.pow(1 + rate, months / 12))


def safe_ratio(top, bottom) -> Column:
    """Ratio, null when the divisor is zero or either side is null."""
    return F.try_divide(col(top).cast("double"), col(bottom).cast("double"))


def relative_premium(price, reference) -> Column:
    """Price over reference, minus one; null unless the reference is positive."""
    reference = col(reference)
    return F.when(reference > 0, col(price) / reference - 1)
