"""SQL aggregates for sample moments.

A constant is told by its extremes: merged partial variances of equal values can
differ from zero in the last bit.
"""

from __future__ import annotations


def sample_deviation(sql: str) -> str:
    """Standard deviation (n - 1), null below two values, 0 for a constant."""
    return f"if(min({sql}) = max({sql}) and count({sql}) > 1, 0D, stddev_samp({sql}))"


def sample_skewness(sql: str) -> str:
    """Bias-corrected skewness; null below three values, 0 for a constant."""
    n = f"cast(count({sql}) as double)"
    corrected = f"skewness({sql}) * try_divide(sqrt({n} * ({n} - 1)), {n} - 2)"
    return f"case when {n} < 3 then null when min({sql}) = max({sql}) then 0D else {corrected} end"


def sample_kurtosis(sql: str) -> str:
    """Bias-corrected excess kurtosis; null below four values, 0 for a constant."""
    n = f"cast(count({sql}) as double)"
    corrected = f"try_divide({n} - 1, ({n} - 2) * ({n} - 3)) * (({n} + 1) * kurtosis({sql}) + 6)"
    return f"case when {n} < 4 then null when min({sql}) = max({sql}) then 0D else {corrected} end"
