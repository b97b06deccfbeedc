"""Statistical functions: corrected moments as columns, distributions and Sharpe-ratio statistics on the driver."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

N = NormalDist()


def skew_corrected(x: str) -> Column:
    """Sample skewness G1 from the population form; NULL below 3 values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x))


def kurtosis_corrected(x: str) -> Column:
    """Sample excess kurtosis G2; NULL below 4 values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation of rows with both values as an aggregate; NULL without variance, where ANSI mode would raise."""
    x, y = (F.col(v) if isinstance(v, str) else v for v in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    # Extremes tell a constant exactly; a deviation merged from parts can be off by its last digit.
    varies = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return F.when(varies, F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))))


def corr_t(rho: Column, n: Column) -> Column:
    """t of a correlation: r sqrt(n-2) / sqrt(1-r^2)."""
    return F.try_divide(rho * F.sqrt(F.greatest(n - 2, F.lit(0))), F.sqrt(F.nullif(1 - rho * rho, F.lit(0.0))))


def sharpe(mean: float, sd: float, per_year: float = 1095.0) -> float:
    return mean / sd * math.sqrt(per_year) if sd else float("nan")


def probabilistic_sharpe(sr: float, sr0: float, n: int, skew: float, kurt: float) -> float:
    """P(true Sharpe > sr0), per-period ratios, population skewness and (not excess) kurtosis."""
    return N.cdf((sr - sr0) * math.sqrt(n - 1) / math.sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr))


def expected_max_sharpe(var_trials: float, trials: int) -> float:
    """Expected best of ``trials`` ratios without skill, by the extreme-value approximation."""
    if trials < 2:
        return 0.0
    g = 0.5772156649015329
    return math.sqrt(var_trials) * ((1 - g) * N.inv_cdf(1 - 1 / trials) + g * N.inv_cdf(1 - 1 / (trials * math.e)))


def min_track_record(sr: float, sr0: float, skew: float, kurt: float, confidence: float = 0.95) -> float:
    """Periods needed to reject sr0 at the confidence; infinite unless sr > sr0."""
    if sr <= sr0:
        return math.inf
    return 1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * (N.inv_cdf(confidence) / (sr - sr0)) ** 2


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    return min(1.0, math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))


def binomial_two_sided(k: int, n: int, p: float = 0.5) -> float:
    """Exact two-sided test: outcomes no likelier than the one seen."""
    pmf = [math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
    return min(1.0, math.fsum(x for x in pmf if x <= pmf[k] * (1 + 1e-9)))
