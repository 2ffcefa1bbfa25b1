"""Scalar expressions: transforms, finite tests, tolerances, Monte-Carlo p-values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x with NaN and infinities turned into NULL."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), None).otherwise(x)


def billionths(x: Column) -> Column:
    """x in whole billionths: sums of them are the same in any order. For values below 9e6 in size."""
    return F.floor(x * F.lit(1e9) + F.lit(0.5)).cast("bigint")


def to_number(x: Column) -> Column:
    """Text to a finite double; bad text becomes NULL instead of failing the job."""
    return finite(x.try_cast("double"))


def cpm(count: Column, library: Column) -> Column:
    return F.try_divide(count.cast("double"), library.cast("double")) * F.lit(1e6)


def log2_cpm(count: Column, library: Column) -> Column:
    return F.log2(cpm(count, library) + F.lit(1.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def inverse_z(z: Column, mean: Column, scale: Column) -> Column:
    """Undo a z-score; NULL where the stored scale is not positive."""
    return F.when(scale > 0, z * scale + mean)


def is_close(a: Column, b: Column, rtol: float = 1e-9, atol: float = 1e-12) -> Column:
    """|a-b| <= atol + rtol*|b|; two NULLs agree, one NULL does not."""
    near = F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(near)


def spearman_brown(rho: Column) -> Column:
    return F.when(F.abs(1 + rho) > 1e-8, F.try_divide(2 * rho, 1 + rho))


def reliability_ratio(r2: Column, reliability: Column) -> Column:
    return F.when(reliability > 0, F.try_divide(r2, reliability))


def plus_one_p(extreme: Column, draws: Column) -> Column:
    """(1 + k) / (n + 1): a Monte-Carlo p-value that is never zero."""
    return (extreme.cast("double") + 1) / (draws.cast("double") + 1)


def sign_tail_p(n_above: Column, n_below: Column, n: Column) -> Column:
    """Two-sided bootstrap sign-tail p; n_above counts draws > 0 and n_below draws < 0."""
    low = plus_one_p(n - n_above, n)
    high = plus_one_p(n - n_below, n)
    return F.least(F.lit(1.0), 2 * F.least(low, high))


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation that is NULL for a constant column (plain corr raises under ANSI)."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_samp(x, y), F.stddev_samp(x) * F.stddev_samp(y))


def log_choose(n: Column, k: Column) -> Column:
    """log of the binomial coefficient, for any n."""
    terms = F.sequence(F.lit(1), F.greatest(k, F.lit(1)))
    total = F.aggregate(
        terms, F.lit(0.0), lambda acc, i: acc + F.log((n - k + i).cast("double")) - F.log(i.cast("double"))
    )
    return F.when(k == 0, F.lit(0.0)).otherwise(total)


def choose(n: Column, k: Column) -> Column:
    """Binomial coefficient as an exact integer while it fits a bigint, else NULL."""
    terms = F.sequence(F.lit(1), F.greatest(k, F.lit(1)))
    total = F.aggregate(
        terms,
        F.lit(1).cast("decimal(38,0)"),
        lambda acc, i: F.floor(acc * (n - k + i).cast("decimal(10,0)") / i.cast("decimal(10,0)")).cast("decimal(38,0)"),
    )
    return F.when(k == 0, F.lit(1).cast("bigint")).when(log_choose(n, k) < 43.0, total.cast("bigint"))
