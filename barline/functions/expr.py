"""Column helpers shared by the operators.

Division never raises and never gives infinity: a zero denominator gives NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BAR_FIELDS = ["open", "high", "low", "close", "volume", "amount"]
PRICE_FIELDS = ["open", "high", "low", "close"]


def as_col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num: Column | str, den: Column | str) -> Column:
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def change(num: Column | str, den: Column | str) -> Column:
    """num / den - 1, NULL where den is 0."""
    return ratio(num, den) - F.lit(1.0)


def nan_to_null(x: Column | str) -> Column:
    return F.when(~F.isnan(as_col(x)), as_col(x))


def is_finite(x: Column | str) -> Column:
    """False for NULL, NaN (which sorts above everything) and infinities, once used as a filter."""
    return F.abs(as_col(x)) < F.lit(float("inf"))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def std(x: Column | str, ddof: int) -> Column:
    return F.stddev_pop(as_col(x)) if ddof == 0 else F.stddev_samp(as_col(x))


def pearson(x: Column | str, y: Column | str, min_n: int = 3) -> Column:
    """Aggregate: correlation over rows where both are present.

    NULL below ``min_n`` pairs or without variance, where ``corr`` would raise. Rounding noise around an
    exact 0 counts as 0, so its sign means something.
    """
    x, y = as_col(x), as_col(y)
    both = x.isNotNull() & y.isNotNull()
    sx = F.stddev_pop(F.when(both, x))
    sy = F.stddev_pop(F.when(both, y))
    ok = (count_if(both) >= min_n) & (sx >= 1e-9) & (sy >= 1e-9)
    r = F.try_divide(F.covar_pop(x, y), sx * sy)
    return F.when(ok, F.when(F.abs(r) < 1e-12, F.lit(0.0)).otherwise(r))


def drawdown(curve: Column, peak: Column) -> Column:
    return ratio(peak - curve, peak)
