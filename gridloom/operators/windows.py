"""Window functions along time. Row frames count rows of a dense grid: densify first where gaps matter."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rows(key: list[str], t: str, n: int, end: int = 0) -> WindowSpec:
    """The n rows that end ``end`` rows away (0: at the current one, -1: at the one before)."""
    return W.partitionBy(*key).orderBy(t).rowsBetween(end - n + 1, end)


def along(key: list[str], t: str) -> WindowSpec:
    return W.partitionBy(*key).orderBy(t)


def at_least(x: str | Column, w: WindowSpec, m: int, value: Column) -> Column:
    """``value`` where the frame has at least m values, else NULL."""
    return F.when(F.count(c(x)).over(w) >= m, value)


def rolling(fn: str, x: str | Column, w: WindowSpec, m: int) -> Column:
    """mean, sum, std, var, min, max, std_pop of the frame's values, NULL below m of them."""
    f = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "var": F.var_samp, "min": F.min, "max": F.max, "std_pop": F.stddev_pop}[fn]
    return at_least(x, w, m, f(c(x)).over(w))


def zscore(x: str | Column, w: WindowSpec, m: int) -> Column:
    """(x - mean) / std of the frame; NULL where std is 0."""
    return F.try_divide(c(x) - rolling("mean", x, w, m), F.nullif(rolling("std", x, w, m), F.lit(0.0)))


def in_order(df: DataFrame, key: list[str], t: str, x: str, f: Callable[[np.ndarray], np.ndarray], out: str) -> DataFrame:
    """Add ``out`` = f(values of x in order of t) per key, for what no window function can say; NULLs are NaN in ``f`` and back.

    A key's rows are one Arrow batch: for panels, whose rows per key are the
    bars of a calendar, not for raw readings.
    """
    kinds = dict(df.dtypes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(t, "ascending")])
        values = table[x].cast(pa.float64()).to_numpy()
        return table.append_column(out, pa.array(f(values), pa.float64(), from_pandas=True))

    return df.groupBy(*key).applyInArrow(run, ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + f", `{out}` double")


def rolling_pct_rank(df: DataFrame, key: list[str], t: str, x: str, n: int, m: int, out: str) -> DataFrame:
    """Average-tie percentile rank of the current value among the last n rows' values: (less + (equal + 1) / 2) / n; NULL below m."""

    def f(v: np.ndarray) -> np.ndarray:
        less, same, seen = (np.zeros(len(v)) for _ in range(3))
        for k in range(min(n, len(v))):
            now, past = v[k:], v[: len(v) - k]
            less[k:] += past < now
            same[k:] += past == now
            seen[k:] += past == past
        return np.where((seen >= m) & (v == v), (less + (same + 1) / 2) / np.maximum(seen, 1), np.nan)

    return in_order(df, key, t, x, f, out)


def smaller_before(v: np.ndarray, block: int = 256) -> np.ndarray:
    """How many earlier values are strictly less: within blocks by comparison, then by merging sorted blocks pairwise. NaN counts nothing."""
    n = len(v)
    out = np.zeros(n, np.int64)
    for a in range(0, n, block):
        x = v[a : a + block]
        out[a : a + len(x)] = np.tril(x[None, :] < x[:, None], -1).sum(axis=1)
    size = block
    while size < n:
        for a in range(0, n - size, 2 * size):
            left, right = v[a : a + size], v[a + size : a + 2 * size]
            left = np.sort(left[left == left])
            out[a + size : a + size + len(right)] += np.where(right == right, np.searchsorted(left, right, "left"), 0)
        size *= 2
    return out


def past_share_below(df: DataFrame, key: list[str], t: str, x: str, m: int, out: str) -> DataFrame:
    """Share of past rows (NULL ones stay in the denominator) whose value is strictly less; NULL below m past rows."""

    def f(v: np.ndarray) -> np.ndarray:
        past = np.arange(len(v))
        return np.where((past >= m) & (v == v), smaller_before(v) / np.maximum(past, 1), np.nan)

    return in_order(df, key, t, x, f, out)


def rolling_corr(x: str | Column, y: str | Column, w: WindowSpec, m: int) -> Column:
    """Pearson correlation over rows with both values."""
    both = c(x).isNotNull() & c(y).isNotNull()
    a, b = F.when(both, c(x)), F.when(both, c(y))
    sd = F.stddev_pop(a).over(w) * F.stddev_pop(b).over(w)
    return F.when(F.count(a).over(w) >= m, F.try_divide(F.covar_pop(a, b).over(w), F.nullif(sd, F.lit(0.0))))


def shrink_to_bar(x: str | Column, bar: list[str], lam: float) -> Column:
    return lam * c(x) + (1 - lam) * F.avg(c(x)).over(W.partitionBy(*bar))


def vasicek(x: str | Column, se2: str | Column, bar: list[str]) -> Column:
    """Shrink to the bar's mean by the precision of the estimate: w = var / (var + se2)."""
    w = W.partitionBy(*bar)
    var, mean = F.var_samp(c(x)).over(w), F.avg(c(x)).over(w)
    share = F.try_divide(var, var + c(se2))
    return share * c(x) + (1 - share) * mean


def gap_return(px: str | Column, t: str, key: list[str], step: int) -> Column:
    """px / previous px - 1, NULL unless the previous row is exactly one step back."""
    w = along(key, t)
    return F.when(c(t) - F.lag(c(t)).over(w) == step, F.try_divide(c(px), F.lag(c(px)).over(w)) - 1)


def signed_run(df: DataFrame, x: str, key: list[str], t: str, out: str) -> DataFrame:
    """Length of the run of equal signs that ends here, with its sign; a NULL ends runs and has none; zeros count 0."""
    s = F.signum(c(x))
    w = along(key, t)
    fresh = F.when(s.eqNullSafe(F.lag(s).over(w)) & s.isNotNull(), 0).otherwise(1)
    df = df.withColumn("__run", F.sum(fresh.cast("bigint")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    n = F.row_number().over(W.partitionBy(*key, "__run").orderBy(t))
    return df.withColumn(out, F.when(s.isNotNull(), (n * s).cast("bigint"))).drop("__run")


def longest_losing_run(df: DataFrame, x: str, key: list[str], t: str) -> DataFrame:
    """Per key: longest run of negative values, and pairs of successive negative values."""
    runs = signed_run(df.filter(c(x).isNotNull()), x, key, t, "__n")
    return runs.groupBy(*key).agg(F.coalesce(F.max(F.when(F.col("__n") < 0, -F.col("__n"))), F.lit(0)).alias("longest"), F.count(F.when(F.col("__n") < -1, 1)).alias("pairs"))


def compound_forward(x: str | Column, key: list[str], t: str, k: int) -> Column:
    """Compound return of this and the next k-1 rows, NULL unless all are there."""
    w = W.partitionBy(*key).orderBy(t).rowsBetween(0, k - 1)
    return F.when(F.count(c(x)).over(w) == k, F.expm1(F.sum(F.log1p(c(x))).over(w)))


def variance_ratio(df: DataFrame, x: str, key: list[str], t: str, step: int, n: int, m: int, out: str) -> DataFrame:
    """Var(sum of ``step`` rows) / (step * Var(1 row)) over n rows."""
    w1 = rows(key, t, step)
    df = df.withColumn("__s", at_least(x, w1, step, F.sum(c(x)).over(w1)))
    w = rows(key, t, n)
    return df.withColumn(out, F.try_divide(rolling("var", "__s", w, m), step * rolling("var", x, w, m))).drop("__s")


def hurst(df: DataFrame, x: str, key: list[str], t: str, n: int, m: int, out: str, lags: tuple[int, ...] = (1, 2, 4, 8, 16)) -> DataFrame:
    """Half the slope of log mean squared displacement of the running sum of x on log lag, over n rows."""
    w = along(key, t)
    run = F.sum(F.coalesce(c(x), F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, 0))
    df = df.withColumn("__y", F.when(c(x).isNotNull(), run))
    df = df.withColumns({f"__d{k}": F.pow(F.col("__y") - F.lag("__y", k).over(w), 2) for k in lags})
    logs = [math.log(k) for k in lags]
    mid = sum(logs) / len(logs)
    den = sum((v - mid) ** 2 for v in logs)
    slope = None
    for k, v in zip(lags, logs):
        mean = rolling("mean", f"__d{k}", rows(key, t, n), m)
        part = F.when(mean > 0, F.log(mean)) * ((v - mid) / den)
        slope = part if slope is None else slope + part
    return df.withColumn(out, slope / 2).drop("__y", *[f"__d{k}" for k in lags])


def session_relative(df: DataFrame, x: str, key: list[str], t: str, n: int, m: int, out: str) -> DataFrame:
    """ln x minus the mean ln x of the last n rows at the same UTC hour."""
    df = df.withColumn("__l", F.when(c(x) > 0, F.log(c(x)))).withColumn("__h", F.floor(c(t) / F.lit(3_600_000)) % 24)
    w = rows([*key, "__h"], t, n)
    return df.withColumn(out, F.col("__l") - rolling("mean", "__l", w, m)).drop("__l", "__h")


def hedge_ratio(y: str, x: str, key: list[str], t: str, n: int | None, warm: int, consistent: bool = False) -> Column:
    """Past-only covariance over variance of the last n rows (all past rows if None); NULL within the first ``warm`` rows.

    The covariance divides by n-1 and the variance by n, as the published
    results do; ``consistent`` divides both by n-1.
    """
    w = W.partitionBy(*key).orderBy(t).rowsBetween(W.unboundedPreceding if n is None else -n, -1) if key else W.orderBy(t).rowsBetween(W.unboundedPreceding if n is None else -n, -1)
    order = W.partitionBy(*key).orderBy(t) if key else W.orderBy(t)
    var = F.var_samp(c(x)) if consistent else F.var_pop(c(x))
    return F.when(F.row_number().over(order) > warm, F.try_divide(F.covar_samp(c(y), c(x)).over(w), F.nullif(var.over(w), F.lit(0.0))))


def ewm(df: DataFrame, key: list[str], t: str, x: str, alpha: float, out: str) -> DataFrame:
    """Exponentially weighted mean, recursive: y = alpha * x + (1 - alpha) * previous y; a NULL keeps the previous."""

    def f(v: np.ndarray) -> np.ndarray:
        got, y = np.empty(len(v)), math.nan
        for i, x in enumerate(v.tolist()):
            y = y if x != x else (x if y != y else alpha * x + (1 - alpha) * y)
            got[i] = y
        return got

    return in_order(df, key, t, x, f, out)


def no_trade_band(df: DataFrame, key: list[str], t: str, x: str, band: float, out: str) -> DataFrame:
    """Hold the previous value unless the new one is more than ``band`` away; a NULL holds it too."""

    def f(v: np.ndarray) -> np.ndarray:
        got, y = np.empty(len(v)), math.nan
        for i, x in enumerate(v.tolist()):
            if y != y or abs(x - y) > band:
                y = x
            got[i] = y
        return got

    return in_order(df, key, t, x, f, out)


def equity(x: str | Column, key: list[str], t: str) -> Column:
    """Compound growth of 1 through the returns x, in order."""
    return F.exp(F.sum(F.log1p(c(x))).over(W.partitionBy(*key).orderBy(t).rowsBetween(W.unboundedPreceding, 0)))


def drawdown(value: str | Column, key: list[str], t: str) -> Column:
    """A running value over its running peak (at least 1), minus 1."""
    peak = F.max(c(value)).over(W.partitionBy(*key).orderBy(t).rowsBetween(W.unboundedPreceding, 0))
    return c(value) / F.greatest(peak, F.lit(1.0)) - 1
