"""Decision instants, buckets, dense grids and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def instants(spark: SparkSession, start: int, end: int, step: int, name: str = "t") -> DataFrame:
    """Multiples of ``step`` from the epoch in [start, end)."""
    return spark.range(-(-start // step), -(-end // step)).select((F.col("id") * step).alias(name))


def floor_to(t: Column, step: int) -> Column:
    return F.floor(t / F.lit(step)).cast("bigint") * step


def ceil_to(t: Column, step: int) -> Column:
    return F.ceil(t / F.lit(step)).cast("bigint") * step


def densify(rows: DataFrame, key: list[str], t: str, step: int) -> DataFrame:
    """Every step of each key between its first and last row; missing ones with NULLs. ``rows`` hold multiples of step."""
    spans = rows.groupBy(*key).agg(F.min(t).alias("__a"), F.max(t).alias("__z"))
    grid = spans.select(*key, F.explode(F.sequence("__a", "__z", F.lit(step).cast("bigint"))).alias(t))
    return grid.hint("merge").join(rows, [*key, t], "left")  # exploded: larger than the optimizer takes it for


def densify_cross(rows: DataFrame, members: DataFrame, times: DataFrame, key: str, t: str) -> DataFrame:
    """Every (member, time) of two distinct lists, with NULLs where ``rows`` has none."""
    calendar = times.agg(F.collect_set(t).alias("__ts"))  # one row: a calendar's instants, not the rows'
    grid = members.select(key).distinct().crossJoin(F.broadcast(calendar)).select(key, F.explode("__ts").alias(t))
    return grid.hint("merge").join(rows, [key, t], "left")


def bucket_sums(tape: DataFrame, key: list[str], t: str, values: list[str], step: int, closed: str = "right") -> DataFrame:
    """Tumbling sums and counts stamped with the bucket's end: (end-step, end] if closed right, [end-step, end) if left."""
    end = ceil_to(F.col(t), step) if closed == "right" else floor_to(F.col(t), step) + step
    return tape.groupBy(*key, end.alias("bar")).agg(*[F.sum(v).alias(f"sum_{v}") for v in values], *[F.count(v).alias(f"n_{v}") for v in values])


def range_window(key: list[str], t: str, low: int, high: int):
    """Window over [t+low, t+high] in time; BIGINT bounds make half-open ranges exact: (t-span, t] is (-span+1, 0)."""
    return W.partitionBy(*key).orderBy(t).rangeBetween(low, high)


def range_blocks(rows: DataFrame, t: str, low: int, high: int, width: int = 86_400_000) -> DataFrame:
    """Rows cut into blocks of ``width`` in time, each with the neighbours that a window over [t+low, t+high] can reach.

    Adds ``__block`` and ``__home``: a window by (key, ``__block``) is right for
    the rows at home, and no task holds a key. A row is a guest where it is in reach, so nothing is copied but
    along the borders. NULL times are left out.
    """
    at = lambda d: F.floor((F.col(t) + F.lit(d)) / F.lit(width)).cast("bigint")
    own = rows.filter(F.col(t).isNotNull()).withColumn("__own", at(0))
    own = own.withColumn("__block", F.explode(F.sequence(at(min(-high, 0)), at(max(-low, 0)))))
    return own.withColumn("__home", F.col("__block") == F.col("__own")).drop("__own")


def contiguous_runs(rows: DataFrame, key: list[str], t: str, step: int) -> DataFrame:
    """Collapse instants to runs of successive steps: key, first, last, n."""
    island = F.col(t) - F.row_number().over(W.partitionBy(*key).orderBy(t)).cast("bigint") * F.lit(step)
    return rows.select(*key, t).distinct().withColumn("__i", island).groupBy(*key, "__i").agg(F.min(t).alias("first"), F.max(t).alias("last"), F.count(F.lit(1)).alias("n")).drop("__i")


def census_of_gaps(rows: DataFrame, key: list[str], t: str, step: int) -> DataFrame:
    """Gaps between successive instants: key, after, before, missing."""
    nxt = F.lead(t).over(W.partitionBy(*key).orderBy(t))
    gaps = rows.select(*key, t).distinct().withColumn("__n", nxt).filter(F.col("__n") > F.col(t) + step)
    return gaps.select(*key, F.col(t).alias("after"), F.col("__n").alias("before"), (F.floor((F.col("__n") - F.col(t)) / F.lit(step)) - 1).cast("bigint").alias("missing"))
