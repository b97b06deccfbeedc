"""As-of joins: strict or inclusive, with or without a staleness limit, last row or last value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def asof_join(
    probes: DataFrame,
    facts: DataFrame,
    by: list[str],
    probe_time: str,
    fact_time: str,
    values: list[str],
    strict: bool = False,
    tolerance: int | None = None,
    skip_null: bool = False,
    bucket: int = DAY_MS,
) -> DataFrame:
    """Add to each probe the latest fact at or before it (before it, if ``strict``).

    Adds ``values`` and ``asof_time``; both are NULL where there is no such fact
    or it is more than ``tolerance`` old. The latest fact is the last row, even
    if its value is NULL; with ``skip_null`` rows whose first value is NULL or
    NaN are passed over. Of facts at one time the one with the largest values
    counts. NULL keys or times match nothing and keep their probes.

    Both sides meet by (key, time bucket). What earlier buckets hand over is
    one row per bucket, found in a window over buckets, so no task sees a whole key.
    """
    keys = [f"__k{i}" for i in range(len(by))]
    at = F.floor(F.col("__t") / F.lit(bucket)).cast("bigint")
    val = F.struct(F.col(f"`{fact_time}`").cast("bigint").alias("t"), *[F.col(f"`{v}`").alias(f"v{i}") for i, v in enumerate(values)])
    fs = facts.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys)], F.col(f"`{fact_time}`").cast("bigint").alias("__t"), val.alias("__f")).filter("__t is not null")
    if skip_null:
        first = F.col("__f.v0")
        fs = fs.filter(first.isNotNull() & (~F.isnan(first) if dict(facts.dtypes)[values[0]] in ("double", "float") else F.lit(True)))
    fs = fs.withColumn("__b", at)
    row = F.struct(*[F.col(f"`{c}`") for c in probes.columns])
    ps = probes.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys)], F.col(f"`{probe_time}`").cast("bigint").alias("__t"), row.alias("__p")).withColumn("__b", at)

    last = fs.groupBy(*keys, "__b").agg(F.max("__f").alias("__f")).withColumn("__own", F.lit(True))
    wanted = ps.filter("__t is not null").select(*keys, "__b").distinct()
    along = W.partitionBy(*keys).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    handed = wanted.join(last, [*keys, "__b"], "full_outer").withColumn("__c", F.last("__f", ignorenulls=True).over(along))
    handed = handed.filter("__c is not null").select(*keys, "__b", F.col("__c").alias("__f"), F.lit(0).alias("__o"), F.lit(None).cast("bigint").alias("__t"))

    none = F.lit(None)
    tag = {True: (3, 2), False: (2, 3)}[strict]  # order of facts and probes at equal times
    rows = fs.select(*keys, "__b", "__f", F.lit(tag[0]).alias("__o"), "__t").unionByName(handed).withColumn("__p", none.cast(dict(ps.dtypes)["__p"]))
    rows = rows.unionByName(ps.select(*keys, "__b", none.cast(dict(fs.dtypes)["__f"]).alias("__f"), F.lit(tag[1]).alias("__o"), "__t", "__p"))
    inside = W.partitionBy(*keys, "__b").orderBy(F.col("__t").asc_nulls_first(), "__o", "__f").rowsBetween(W.unboundedPreceding, 0)
    seen = rows.withColumn("__s", F.last("__f", ignorenulls=True).over(inside)).filter("__p is not null")
    ok = F.col("__t").isNotNull()
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    if tolerance is not None:
        ok = ok & (F.col("__t") - F.col("__s.t") <= tolerance)
    got = seen.withColumn("__s", F.when(ok, F.col("__s")))
    return got.select("__p.*", *[F.col(f"__s.v{i}").alias(v) for i, v in enumerate(values)], F.col("__s.t").alias("asof_time"))
