"""Rates, means, correlations and other statistics as Columns.

ANSI mode raises on division by zero, so ratios go through ``try_divide``; NaN counts as missing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def no_nan(c: str | Column) -> Column:
    """The value, NULL for NaN (Spark's aggregates skip NULL but spread NaN)."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c), c)


def to_number(c: str | Column) -> Column:
    """Text to double, NULL where it is no number."""
    return no_nan(col(c).try_cast("double"))


def safe_ratio(a: str | Column, b: str | Column, digits: int = 3) -> Column:
    """Ratio rounded half to even; NULL on a zero denominator."""
    return F.bround(F.try_divide(col(a).cast("double"), col(b).cast("double")), digits)


def rate_or_zero(a: str | Column, b: str | Column, digits: int = 6) -> Column:
    """Ratio, 0.0 on a zero denominator."""
    return F.coalesce(F.bround(F.try_divide(col(a).cast("double"), col(b).cast("double")), digits), F.lit(0.0))


def rate_or_blank(a: str | Column, b: str | Column, digits: int = 6) -> Column:
    """Ratio, NULL on a zero denominator."""
    return F.bround(F.try_divide(col(a).cast("double"), col(b).cast("double")), digits)


def mean_or_null(c: str | Column, digits: int = 3) -> Column:
    """Mean of what is there, NULL of nothing."""
    return F.bround(F.avg(no_nan(c)), digits)


def median_present(c: str | Column) -> Column:
    """Median of the values that are neither NULL nor NaN."""
    return F.median(no_nan(c))


def is_success(reward: str | Column, tolerance: float = 1e-6) -> Column:
    """Whether a reward counts as full (F15); NULL rewards don't."""
    return F.coalesce(col(reward).between(1 - tolerance, 1 + tolerance), F.lit(False))


def pass_hat(n: str | Column, c: str | Column, k: int, short: str = "null") -> Column:
    """C(c, k) / C(n, k) as a product (A01): factorials overflow above 20.

    ``short``: what fewer than ``k`` trials give, ``null`` or ``raise``.
    """
    n, c = col(n), col(c)
    value = reduce(lambda a, i: a * F.try_divide((c - i).cast("double"), (n - i).cast("double")), range(1, k), F.try_divide(c.cast("double"), n.cast("double")))
    found = F.when(c < k, F.lit(0.0)).otherwise(value)
    missing = F.raise_error(F.lit(f"fewer than {k} trials")).cast("double") if short == "raise" else F.lit(None).cast("double")
    return F.when(n < k, missing).otherwise(found)


def consistency(pass_3: str | Column, pass_1: str | Column) -> Column:
    """pass^3 over pass^1, NULL where that is 0 or NULL."""
    return F.try_divide(col(pass_3), F.nullif(col(pass_1), F.lit(0.0)))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Pearson's r over complete pairs; NULL for fewer than two or a constant side."""
    both = no_nan(x).isNotNull() & no_nan(y).isNotNull()
    a, b = F.when(both, no_nan(x)), F.when(both, no_nan(y))
    # Tiny variances of constant columns are rounding noise, not spread.
    spread = F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.sqrt(F.var_pop(a) * F.var_pop(b)))
    return F.try_divide(F.covar_pop(a, b), F.nullif(spread, F.lit(0.0)))


def line_fit(x: str | Column, y: str | Column) -> tuple[Column, Column, Column]:
    """Slope, intercept and R^2 of least squares over complete pairs, NULL for fewer than three."""
    both = no_nan(x).isNotNull() & no_nan(y).isNotNull()
    a, b = F.when(both, no_nan(x)), F.when(both, no_nan(y))
    enough = (F.count(a) >= 3) & (F.min(a) < F.max(a))
    slope = F.when(enough, F.try_divide(F.covar_pop(a, b), F.nullif(F.var_pop(a), F.lit(0.0))))
    r = correlation(x, y)
    return slope, F.when(enough, F.avg(b) - slope * F.avg(a)), F.when(enough, r * r)


def standard_error(c: str | Column) -> Column:
    """Sample deviation over the root of the count, which is 1 at least."""
    return F.stddev_samp(no_nan(c)) / F.sqrt(F.greatest(F.count(no_nan(c)), F.lit(1)))


def quartiles(c: str | Column) -> Column:
    """The three quartiles with linear interpolation."""
    return F.percentile(no_nan(c), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))


def histogram_bin(c: str | Column, low: float, high: float, bins: int) -> Column:
    """Bin number from 0; the last bin holds its upper edge; outside NULL."""
    c = col(c)
    at = F.floor((c - low) / ((high - low) / bins)).cast("int")
    return F.when((c >= low) & (c <= high), F.least(at, F.lit(bins - 1)))


def root_mean_square(c: str | Column) -> Column:
    """X34."""
    return F.sqrt(F.avg(col(c) * col(c)))


def decibels_to_scale(snr: str | Column) -> Column:
    """X35."""
    return F.pow(F.lit(10.0), -col(snr) / 20)


def event_probability(rate: str | Column, seconds: str | Column) -> Column:
    """Chance of an event within a time at a rate (X36); draw with ``rand(seed) < ...``."""
    return 1 - F.exp(-col(rate) * col(seconds))
