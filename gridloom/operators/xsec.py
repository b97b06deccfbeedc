"""Window functions across the rows of a bar (a cross-section)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.stats import corr
from gridloom.operators.skew import lookup_join


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def mean_rank(x: str | Column, bar: list[str], descending: bool = False) -> Column:
    """Average-tie rank from 1 among the bar's non-NULL values."""
    has = c(x).isNotNull().alias("has")
    order = W.partitionBy(*bar, has).orderBy(c(x).desc() if descending else c(x))
    ties = F.count(F.lit(1)).over(W.partitionBy(*bar, c(x)))
    return F.when(c(x).isNotNull(), F.rank().over(order) + (ties - 1) / 2)


SPLITS = 64


def counted_ranks(df: DataFrame, x: str, bar: list[str], block_rows: int = 32_768) -> DataFrame:
    """Add ``{x}_below`` (values of the bar strictly less), ``{x}_ties`` (equal ones, itself too) and ``{x}_n``; NULL for NULL.

    For bars of any size: values are counted first, so that ties combine on
    the map side; a bar of over ``block_rows`` distinct values is cut at
    quantiles into up to ``SPLITS`` ranges that are ordered apart; what lies in
    the ranges before is a sum of counts. No task orders such a bar.
    The average-tie rank is below + (ties + 1) / 2.
    """
    values = df.filter(c(x).isNotNull()).groupBy(*bar, x).agg(F.count(F.lit(1)).alias(f"{x}_ties"))
    cuts = F.percentile_approx(x, [i / SPLITS for i in range(1, SPLITS)], 1000)
    bars = values.groupBy(*bar).agg(F.sum(f"{x}_ties").alias(f"{x}_n"), F.when(F.count(F.lit(1)) > block_rows, cuts).alias(f"{x}_cuts"))
    values = lookup_join(values, bars, bar, [f"{x}_n", f"{x}_cuts"], f"{x}_n")
    part = F.coalesce(F.size(F.filter(f"{x}_cuts", lambda v: v < c(x))), F.lit(0))
    values = values.withColumn(f"{x}_part", F.when(F.col(f"{x}_cuts").isNull(), 0).otherwise(part)).drop(f"{x}_cuts")
    parts = values.groupBy(*bar, f"{x}_part").agg(F.sum(f"{x}_ties").alias(f"{x}_held"))
    before = W.partitionBy(*bar).orderBy(f"{x}_part").rowsBetween(W.unboundedPreceding, -1)  # at most SPLITS rows a bar
    parts = parts.select(*bar, f"{x}_part", F.coalesce(F.sum(f"{x}_held").over(before), F.lit(0)).alias(f"{x}_first"))
    values = values.join(parts, [*bar, f"{x}_part"])
    inside = W.partitionBy(*bar, f"{x}_part").orderBy(x).rowsBetween(W.unboundedPreceding, -1)
    below = F.col(f"{x}_first") + F.coalesce(F.sum(f"{x}_ties").over(inside), F.lit(0))
    return df.join(values.select(*bar, x, below.alias(f"{x}_below"), f"{x}_ties", f"{x}_n"), [*bar, x], "left")


def counted_mean_rank(x: str) -> Column:
    return F.col(f"{x}_below") + (F.col(f"{x}_ties") + 1) / 2


def counted_ordinals(df: DataFrame, x: str, bar: list[str], tie: list[str]) -> DataFrame:
    """Add ``{x}_up`` (1 for the largest) and ``{x}_down`` (1 for the smallest), both by ``tie`` among equals, and ``{x}_n``.

    For bars of any size: only equal values of a bar are ordered together. NULL values have none.
    """
    df = counted_ranks(df, x, bar)
    place = F.when(c(x).isNotNull(), F.row_number().over(W.partitionBy(*bar, x).orderBy(*tie)))
    below, ties, n = F.col(f"{x}_below"), F.col(f"{x}_ties"), F.col(f"{x}_n")
    return df.withColumn("__place", place).withColumns({f"{x}_up": n - below - ties + F.col("__place"), f"{x}_down": below + F.col("__place")}).drop("__place", f"{x}_below", f"{x}_ties")


def quantile_of(place: Column, n: Column, q: int) -> Column:
    """Bucket 0..q-1 of an ordinal among n, with edges at the q-quantiles of the ordinals (an edge belongs below)."""
    return F.when(n > 1, F.greatest(F.ceil((place - 1) * q / (n - 1)) - 1, F.lit(0)).cast("int")).otherwise(0)


def pct_rank(x: str | Column, bar: list[str]) -> Column:
    """Average-tie rank over the number of non-NULL values."""
    return mean_rank(x, bar) / F.count(c(x)).over(W.partitionBy(*bar))


def ordinal(x: str | Column, bar: list[str], tie: list[str], descending: bool = False) -> Column:
    """1, 2, 3 ... by value, then by ``tie``."""
    return F.row_number().over(W.partitionBy(*bar).orderBy(c(x).desc_nulls_last() if descending else c(x).asc_nulls_last(), *tie))


def demean(x: str | Column, bar: list[str]) -> Column:
    return c(x) - F.avg(c(x)).over(W.partitionBy(*bar))


def gross_one(x: str | Column, bar: list[str]) -> Column:
    """x over the bar's sum of absolute values; NULL where that is 0."""
    return F.try_divide(c(x), F.nullif(F.sum(F.abs(c(x))).over(W.partitionBy(*bar)), F.lit(0.0)))


def neutralise(x: str | Column, beta: str | Column, bar: list[str]) -> Column:
    """Residual of x on beta with intercept within the bar; x - mean where beta is constant."""
    w = W.partitionBy(*bar)
    slope = F.coalesce(F.try_divide(F.covar_pop(c(x), c(beta)).over(w), F.nullif(F.var_pop(c(beta)).over(w), F.lit(0.0))), F.lit(0.0))
    return demean(x, bar) - slope * demean(beta, bar)


def peer_mean(x: str | Column, group: list[str]) -> Column:
    """Mean of the other members of the group (leave one out); NULL for a single member."""
    w = W.partitionBy(*group)
    n = F.count(c(x)).over(w)
    return F.when(n >= 2, F.try_divide(F.sum(c(x)).over(w) - c(x), n - 1))


def outside_mean(x: str | Column, bar: list[str], group: list[str]) -> Column:
    """Mean of the bar's members outside the group."""
    b, g = W.partitionBy(*bar), W.partitionBy(*bar, *group)
    n = F.count(c(x)).over(b) - F.count(c(x)).over(g)
    return F.try_divide(F.sum(c(x)).over(b) - F.coalesce(F.sum(c(x)).over(g), F.lit(0.0)), F.nullif(n, F.lit(0)))


def quantile_bucket(x: str | Column, bar: list[str], tie: list[str], q: int) -> Column:
    """``quantile_of`` the ordinal rank, as a window over the bar."""
    return quantile_of(ordinal(x, bar, tie), F.count(F.lit(1)).over(W.partitionBy(*bar)), q)


def tail_spread(df: DataFrame, score: str, y: str, bar: list[str], tie: list[str], k: int) -> DataFrame:
    """Per bar: mean y of the k highest scores minus that of the k lowest, for bars of at least 2k rows."""
    rows = df.filter(c(score).isNotNull() & c(y).isNotNull()).select(*bar, *tie, c(score).alias("s"), c(y).alias("y"))
    rows = counted_ordinals(rows, "s", bar, tie)
    out = rows.groupBy(*bar).agg(F.avg(F.when(F.col("s_up") <= k, F.col("y"))).alias("top"), F.avg(F.when(F.col("s_down") <= k, F.col("y"))).alias("bottom"), F.count(F.lit(1)).alias("n"))
    return out.filter(F.col("n") >= 2 * k).withColumn("spread", F.col("top") - F.col("bottom"))


def bar_ic(df: DataFrame, score: str, y: str, bar: list[str], least: int) -> DataFrame:
    """Rank correlation of score and y per bar, over rows with both: bar, ic, n."""
    rows = df.filter(c(score).isNotNull() & c(y).isNotNull())
    rows = counted_ranks(counted_ranks(rows.select(*bar, c(score).alias("a"), c(y).alias("b")), "a", bar), "b", bar)
    return rows.groupBy(*bar).agg(corr(counted_mean_rank("a"), counted_mean_rank("b")).alias("ic"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def shuffle_in_bar(df: DataFrame, x: str, bar: list[str], member: str, seed: int, out: str) -> DataFrame:
    """Permute x within each bar: the i-th member gets the value of the member that a seeded hash puts i-th."""
    a = df.withColumn("__i", F.row_number().over(W.partitionBy(*bar).orderBy(member)))
    b = df.select(*bar, F.row_number().over(W.partitionBy(*bar).orderBy(F.xxhash64(*bar, member, F.lit(seed)), member)).alias("__i"), c(x).alias(out))
    return a.join(b, [*bar, "__i"]).drop("__i")
