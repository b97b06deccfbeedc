"""Attributes as known at event time: validity intervals, exploded into time buckets and equi-joined."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def validity_pieces(versions: DataFrame, until: DataFrame, bucket_ms: int = DAY_MS) -> DataFrame:
    """Half-open validity intervals of the best known version, cut at bucket borders.

    ``versions``: k (entity), known (BIGINT), v (struct that orders versions,
    larger is better). ``until``: k, last (the entity's last event bucket).
    Returns k, b, from, to, v. A version is valid from the time it is known
    until a better one is known. The running best before each bucket comes
    from one row per (entity, bucket), so no task orders an entity's versions.
    """
    rows = versions.withColumn("b", F.floor(F.col("known") / F.lit(bucket_ms)).cast("long"))
    best = rows.groupBy("k", "b").agg(F.max("v").alias("v"))
    along = W.partitionBy("k").orderBy("b")
    best = best.withColumn("v", F.max("v").over(along.rowsBetween(W.unboundedPreceding, 0))).withColumn("nb", F.lead("b").over(along))
    best = best.join(until, "k", "inner").withColumn("nb", F.coalesce("nb", "last"))
    carried = best.filter(F.col("nb") > F.col("b")).select("k", F.explode(F.sequence(F.col("b") + 1, F.col("nb"))).alias("b"), "v")
    carried = carried.select("k", "b", (F.col("b") * bucket_ms).alias("known"), F.lit(0).alias("own"), "v")
    every = rows.select("k", "b", "known", F.lit(1).alias("own"), "v").unionByName(carried)
    inside = W.partitionBy("k", "b").orderBy("known", "own", "v")
    every = every.withColumn("past", F.max("v").over(inside.rowsBetween(W.unboundedPreceding, -1)))
    changes = every.filter(F.col("past").isNull() | (F.col("v") > F.col("past")))
    return changes.select("k", "b", F.col("known").alias("from"), F.coalesce(F.lead("known").over(inside), (F.col("b") + 1) * bucket_ms).alias("to"), "v").filter(F.col("from") < F.col("to"))


def as_known_at(events: DataFrame, entity: str, at: str, versions: DataFrame, v_entity: str, v_known: str, v_order: list[str], v_values: list[str], bucket_ms: int = DAY_MS) -> DataFrame:
    """For each distinct (entity, at) of ``events``: the best version known at or before ``at``.

    The best version has the largest ``v_order`` columns; ``v_values`` further
    columns come with it. ``v_order`` need not contain ``v_known``.
    Returns entity, at, v_order and v_values columns; events without a known
    version are left out.

    Defined cases: NULL entity, time, known time or order column take no part.
    Repeated rows count once. Versions equal in ``v_order`` but with different
    values: the largest values win. Other columns, of whatever name, are ignored.
    Neither an entity's events nor its versions ever meet in one task: the
    join key is (entity, bucket).
    """
    ev = events.select(F.col(f"`{entity}`").alias("k"), F.col(f"`{at}`").cast("long").alias("t")).filter("k is not null and t is not null")
    ev = ev.withColumn("b", F.floor(F.col("t") / F.lit(bucket_ms)).cast("long"))
    v = F.struct(*[F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(v_order)], *[F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(v_values)])
    ve = versions.select(F.col(f"`{v_entity}`").alias("k"), F.col(f"`{v_known}`").cast("long").alias("known"), v.alias("v")).filter("k is not null and known is not null")
    for i in range(len(v_order)):
        ve = ve.filter(F.col(f"v.o{i}").isNotNull())
    until = ev.groupBy("k").agg(F.max("b").alias("last"))
    pieces = validity_pieces(ve, until, bucket_ms)
    ev = ev.repartition("k", "b").dropDuplicates(["k", "b", "t"])  # partitioned as the join needs it; an event meets one interval
    hit = ev.join(pieces.hint("merge"), ["k", "b"]).filter((F.col("from") <= F.col("t")) & (F.col("t") < F.col("to")))
    out = hit.select(F.col("k").alias(entity), F.col("t").alias(at), *[F.col(f"v.o{i}").alias(f"version_{c}") for i, c in enumerate(v_order)], *[F.col(f"v.x{i}").alias(f"version_{c}") for i, c in enumerate(v_values)])
    return out
