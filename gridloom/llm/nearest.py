"""Matching records by nearest time: tick expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_within(left: DataFrame, entity: str, at: str, right: DataFrame, r_entity: str, r_at: str, tolerance: int, tick: int | None = None) -> DataFrame:
    """For each distinct (entity, at) of ``left``, the nearest ``r_at`` of ``right`` within ``tolerance``: entity, at, r_at.

    Of two equally near ones the earlier. ``tick`` defaults to the tolerance.

    Method: every right record is exploded to the ticks [k*tick, (k+1)*tick)
    it can serve, those within tolerance of it. Of those before and after a
    tick only the nearest is kept, by an aggregate that combines on the map
    side; those in the tick, since a tick is coarser than the times, are kept
    as distinct times. Left and right times of an entity-tick are then put in
    one order, in which each left time sees the last right one before it and
    the first one after it: n log n work, no pairs. An entity-tick holds at
    most 2 * (tick + 1) rows, for its times are distinct whole numbers, so that
    no task holds more of an entity than that, however many records it has.

    Defined cases: NULL entities and times take no part; repeated rows count
    once; ``tolerance`` is inclusive; equal times match at distance 0. Other
    columns, of whatever name, are ignored. Empty input gives an empty result.
    """
    w = tick or max(1, tolerance)
    lk, lt, rk, rt = (F.col(f"`{c}`") for c in (entity, at, r_entity, r_at))
    ls = left.select(lk.alias("k"), lt.cast("bigint").alias("t")).filter("k is not null and t is not null")
    ls = ls.select("k", F.floor(F.col("t") / F.lit(w)).cast("bigint").alias("q"), "t", F.lit(1).alias("side"))
    rs = right.select(rk.alias("k"), rt.cast("bigint").alias("r")).filter("k is not null and r is not null")
    first, last = (F.floor((F.col("r") + F.lit(d)) / F.lit(w)).cast("bigint") for d in (-tolerance, tolerance))
    ticks = rs.select("k", "r", F.explode(F.sequence(first, last)).alias("q"))
    r, lo = F.col("r"), F.col("q") * w
    # Right times sort before equal left ones. Times before the tick share one key, and so do those after it.
    where = F.when(r < lo, lo - 1).when(r >= lo + w, lo + w).otherwise(r)
    rows = ticks.select("k", "q", where.alias("t"), F.lit(0).alias("side"), "r").unionByName(ls.withColumn("r", F.lit(None).cast("bigint")))
    rows = rows.groupBy("k", "q", "t", "side").agg(F.max("r").alias("hi"), F.min("r").alias("lo"))
    up, down = W.partitionBy("k", "q").orderBy("t", "side"), W.partitionBy("k", "q").orderBy(F.col("t").desc(), F.col("side").desc())
    past = lambda o: o.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn("before", F.last("hi", ignorenulls=True).over(past(up))).withColumn("after", F.last("lo", ignorenulls=True).over(past(down)))
    t = F.col("t")
    near = [F.struct(F.abs(F.col(c) - t).alias("d"), F.col(c).alias("r")) for c in ("before", "after")]
    best = F.least(*[F.when(F.col(c).isNotNull(), s) for c, s in zip(("before", "after"), near)])
    out = rows.filter("side = 1").select("k", "t", best.alias("n")).filter(F.col("n.d") <= tolerance)
    return out.select(F.col("k").alias(entity), t.alias(at), F.col("n.r").alias(r_at))
