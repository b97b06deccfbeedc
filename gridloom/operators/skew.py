"""Joins and orderings that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOT_KEYS = 10_000
SALTS = 256


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    values: list[str],
    weight: str,
    keep: Callable[[dict[str, Column]], Column] | None = None,
    hot_keys: int = HOT_KEYS,
    derive: Callable[[DataFrame], DataFrame] = lambda df: df,
) -> DataFrame:
    """Left-join ``right`` (one row per key) onto ``left`` without a hot reducer.

    The ``hot_keys`` heaviest keys of ``right`` by ``weight`` are broadcast: a
    table of fixed size whatever the input. Any key above 1/hot_keys of the
    rows is among them. The other keys go through a shuffle join in which the
    rows already answered by the broadcast are spread over ``SALTS`` salts.
    ``keep`` filters rows once their values are known; for the hot keys that
    happens before the shuffle. ``derive`` adds costly values to rows of
    ``right`` once the hot ones are chosen.

    NULL keys match nothing and keep their rows. Names of ``left`` may not
    begin with two underscores.
    """
    hot = derive(right.orderBy(F.col(weight).desc(), *on).limit(hot_keys)).select(*on, *[F.col(v).alias(f"__h_{v}") for v in values], F.lit(True).alias("__hot"))
    rows = left.join(F.broadcast(hot), on, "left")
    is_hot = F.col("__hot").isNotNull()
    if keep is not None:
        rows = rows.filter(~is_hot | F.coalesce(keep({v: F.col(f"__h_{v}") for v in values}), F.lit(False)))
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int") + 1
    rows = rows.withColumn("__salt", F.when(is_hot | F.coalesce(*[F.col(c).isNull() for c in on], F.lit(False)), spread).otherwise(F.lit(0)))
    # The weight is asked for here too, so that both reads of ``right`` are one exchange with the same columns.
    cold = derive(right.filter(F.col(weight).isNotNull())).select(*on, *[F.col(v).alias(f"__c_{v}") for v in values], F.lit(0).alias("__salt"))
    out = rows.join(cold, [*on, "__salt"], "left")
    out = out.select(*left.columns, "__hot", *[F.when(is_hot, F.col(f"__h_{v}")).otherwise(F.col(f"__c_{v}")).alias(v) for v in values])
    if keep is not None:
        out = out.filter(F.col("__hot").isNotNull() | F.coalesce(keep({v: F.col(v) for v in values}), F.lit(False)))
    return out.select(*left.columns, *values)


def time_buckets(rows: DataFrame, source: list[str], t: str, width: int, block_rows: int, name: str, busy_buckets: int = HOT_KEYS) -> DataFrame:
    """Add ``name``, the begin of each row's time bucket: ``width`` long, or shorter where a source has many rows in it.

    A bucket of over ``block_rows`` rows is cut into pieces of equal length, about
    four to a block. The ``busy_buckets`` busiest ones, a list of fixed size
    whatever the input, are broadcast for that; one beyond them holds less than
    1/busy_buckets of the rows.
    """
    begin = F.floor(F.col(t) / F.lit(width)).cast("long") * width
    counts = rows.groupBy(*source, begin.alias("__day")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > block_rows)
    piece = F.greatest(F.lit(1), F.floor(F.lit(width) / F.ceil(4 * F.col("__n") / F.lit(block_rows)))).cast("long")
    busy = counts.orderBy(F.col("__n").desc(), *source, "__day").limit(busy_buckets).select(*source, "__day", piece.alias("__piece"))
    out = rows.withColumn("__day", begin).join(F.broadcast(busy), [*source, "__day"], "left")
    long = F.coalesce("__piece", F.lit(width).cast("long"))
    return out.withColumn(name, F.col("__day") + F.floor((F.col(t) - F.col("__day")) / long).cast("long") * long).select(*rows.columns, name)


def ordered_blocks(rows: DataFrame, source: list[str], bucket: str, block_rows: int, halo_rows: int, about: DataFrame | None = None) -> DataFrame:
    """Cut each source's time order into blocks of about ``block_rows`` rows, each led by a halo.

    ``rows`` must be hash-partitioned by (source, bucket), where ``bucket`` is
    a time bucket (``time_buckets``). Returns the rows with ``__block`` and ``__home``: a
    row is home in one block and may also come, with ``__home`` false, as part
    of the ``halo_rows`` or more rows before another block. Only counts per
    (source, bucket) are ordered within a source, so no task holds a source.
    ``about`` (a row per source) is left-joined to those counts, so that its
    columns reach the rows without a join by source.
    """
    counts = rows.groupBy(*source, bucket).agg(F.count(F.lit(1)).alias("__n"))
    by_time = W.partitionBy(*source).orderBy(bucket)
    plan = counts.withColumn("__end", F.sum("__n").over(by_time)).withColumn("__block", ((F.col("__end") - F.col("__n")) / block_rows).cast("long"))
    plan = plan.withColumn("__next", F.lead("__block").over(by_time))
    before = W.partitionBy(*source).orderBy("__end").rangeBetween(-(halo_rows - 1), 0)
    plan = plan.withColumn("__halo", F.when(F.col("__next") != F.col("__block"), F.collect_list(bucket).over(before)))
    none = F.array().cast("array<struct<b:bigint,k:bigint,home:boolean>>")
    here = F.array(F.struct(F.col(bucket).cast("long").alias("b"), F.col("__block").alias("k"), F.lit(True).alias("home")))
    halo = F.transform("__halo", lambda b: F.struct(b.cast("long").alias("b"), F.col("__next").alias("k"), F.lit(False).alias("home")))
    more = [c for c in about.columns if c not in source] if about is not None else []
    if about is not None:
        plan = plan.join(about, source, "left")
    place = plan.select(*source, *more, F.explode(F.concat(here, F.coalesce(halo, none))).alias("__p"))
    place = place.select(*source, *more, F.col("__p.b").alias(bucket), F.col("__p.k").alias("__block"), F.col("__p.home").alias("__home"))
    return rows.join(place, [*source, bucket], "inner")
