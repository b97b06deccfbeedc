"""Rolling totals over trailing days by binary doubling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def daily_in_ranges(readings: DataFrame, ranges: DataFrame, scale: int = 1_000_000) -> DataFrame:
    """Dense daily totals of each live range.

    ``readings``: k, t (ms), x. ``ranges``: k, live_from, live_to.
    Returns k, live_from, live_to, day (days since 1970), total (BIGINT, in
    1/scale) and n, with a row for every day the range touches.
    Readings and ranges meet by (k, day), so a hot key is spread over days.
    """
    live = ranges.filter("k is not null and live_from is not null and live_to > live_from").distinct()
    first, last = F.floor(F.col("live_from") / DAY_MS).cast("long"), F.floor((F.col("live_to") - 1) / DAY_MS).cast("long")
    days = live.select("k", "live_from", "live_to", F.explode(F.sequence(first, last)).alias("day"))
    rows = readings.filter("k is not null and t is not null and x is not null").filter(~F.isnan("x"))
    rows = rows.select("k", F.floor(F.col("t") / DAY_MS).cast("long").alias("day"), "t", "x").repartition("k", "day").dropDuplicates(["k", "day", "t", "x"])
    rows = rows.filter(F.abs("x") < 1).select("k", "day", "t", F.round(F.round("x", 6) * scale).cast("long").alias("u"))
    # The optimizer takes exploded days for as few as the ranges and would broadcast them: ask for a merge.
    hit = rows.join(days.hint("merge"), ["k", "day"]).filter((F.col("t") >= F.col("live_from")) & (F.col("t") < F.col("live_to")))
    hit = hit.groupBy("k", "day", "live_from", "live_to").agg(F.sum("u").alias("total"), F.count("u").alias("n"))
    dense = days.hint("merge").join(hit, ["k", "day", "live_from", "live_to"], "left")
    return dense.select("k", "live_from", "live_to", "day", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("n", F.lit(0)).alias("n"))


def doubled_windows(dense: DataFrame, series: list[str], order: str, values: list[str], spans: list[int]) -> DataFrame:
    """Trailing sums of any lengths over dense rows, from block sums of 1, 2, 4, 8, ... rows.

    The sum of 2m rows is the sum of m rows plus the same shifted by m; a span
    is put together from the blocks of its binary digits, each shifted past
    those before it. Every layer is a ``lag`` over the same partitioning and
    order: one shuffle and one sort, and work per row that grows with the
    logarithm of the span. Adds ``<value>_<span>`` columns.
    """
    along = W.partitionBy(*series).orderBy(order)
    # The last row of the block sum of m rows, m rows earlier, is 0 before the series begins.
    shift = lambda c, k: F.coalesce(F.lag(c, k).over(along), F.lit(0)) if k else F.col(c)
    top = max(spans).bit_length()
    out = dense.withColumns({f"__{v}_1": F.col(v) for v in values})
    for i in range(1, top):
        m = 1 << (i - 1)
        out = out.withColumns({f"__{v}_{2 * m}": F.col(f"__{v}_{m}") + shift(f"__{v}_{m}", m) for v in values})
    made: dict[str, Column] = {}
    for span in spans:
        for v in values:
            parts, past = [], 0
            for i in reversed(range(top)):
                if span >> i & 1:
                    parts.append(shift(f"__{v}_{1 << i}", past))
                    past += 1 << i
            total = parts[0]
            for p in parts[1:]:
                total = total + p
            made[f"{v}_{span}"] = total
    return out.withColumns(made).drop(*[c for c in out.columns if c.startswith("__")])


def trailing_totals(readings: DataFrame, ranges: DataFrame, spans: list[int], scale: int = 1_000_000) -> DataFrame:
    """Totals and averages over the trailing ``spans`` days of every day wholly inside a live range.

    Returns k, live_from, day, and for each span ``total_<span>`` (BIGINT, in
    1/scale: sums are exact and don't depend on the order of rows),
    ``n_<span>`` and ``mean_<span>`` (over readings; NULL without any).

    Defined cases: NULL or NaN values, NULL keys and times are no readings;
    values of absolute size 1 or more don't count; repeated rows count once;
    days without readings count 0; readings before the range are not used.
    Empty input gives an empty result. Other columns are ignored.
    """
    dense = daily_in_ranges(readings, ranges, scale)
    out = doubled_windows(dense, ["k", "live_from", "live_to"], "day", ["total", "n"], spans)
    out = out.filter((F.col("day") * DAY_MS >= F.col("live_from")) & ((F.col("day") + 1) * DAY_MS <= F.col("live_to")))
    return out.withColumns({f"mean_{s}": F.try_divide(F.col(f"total_{s}").cast("double") / scale, F.col(f"n_{s}")) for s in spans}).select("k", "live_from", "day", *[f"{v}_{s}" for s in spans for v in ("total", "n", "mean")])
