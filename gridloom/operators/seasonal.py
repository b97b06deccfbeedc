"""Irregular readings onto a regular grid: harmonic regression by distributed normal equations, with residual bridges."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_MS = 86_400_000


def _solve(p: int, ridge: float):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def solve(xtx: pd.Series, xty: pd.Series) -> pd.Series:
        a = np.zeros((len(xtx), p, p))
        iu = np.triu_indices(p)
        if len(xtx):
            a[:, iu[0], iu[1]] = np.stack([np.asarray(v, float) for v in xtx])
            a[:, iu[1], iu[0]] = a[:, iu[0], iu[1]]
            y = np.stack([np.asarray(v, float) for v in xty])
            a += ridge * np.eye(p) * (1 + np.trace(a, axis1=1, axis2=2) / p)[:, None, None]
            return pd.Series(list(np.linalg.solve(a, y[:, :, None])[:, :, 0]))
        return pd.Series([], dtype=object)

    return solve


def basis(at: Column, origin: Column, periods_ms: list[int], trend_ms: int) -> list[Column]:
    """1, a trend in units of ``trend_ms`` since ``origin``, and a sine and cosine for each period."""
    out = [F.lit(1.0), (at - origin) / F.lit(float(trend_ms))]
    for p in periods_ms:
        phase = F.pmod(at, F.lit(p)) / F.lit(float(p)) * (2 * math.pi)
        out += [F.sin(phase), F.cos(phase)]
    return out


def regular_grid(
    readings: DataFrame,
    ranges: DataFrame,
    step_ms: int,
    periods_ms: tuple[int, ...] = (DAY_MS, 7 * DAY_MS, 7 * DAY_MS // 2),
    trend_ms: int = 90 * DAY_MS,
    ridge: float = 1e-9,
    beside: int = 3,
    tune: float = 6.0,
) -> DataFrame:
    """Bring readings onto slots [s, s+step) that lie wholly in a live range of their source.

    ``readings``: src, k, t (ms), x; only rows with a usable x. ``ranges``: src, k, live_from, live_to.
    Returns src, k, live_from, slot, observed (mean of the slot's distinct readings, or
    NULL), n (their number), fitted, filled (observed, else fitted plus the bridged
    residual; NULL for a source without any reading in its ranges), and
    state: 'observed', 'filled' or 'empty' (nothing to fill from).

    Method: the sums of products of a basis (constant, trend, harmonics) are
    aggregated per source with map-side combining; each source's small system
    is solved in an Arrow batch; missing slots get the prediction plus the
    residual interpolated linearly between the nearest observed slots of the
    same range, or that of the only one. Spikes don't pull the fit: a slot's weight falls
    (bisquare) with its distance from the median of the observed slots among the
    ``beside`` on either side, to nothing at ``tune`` of the source's
    robust scales of that distance; slots without weight end no bridge.

    Defined cases: NULL or NaN x, NULL time or key are no readings; infinite x
    is none here. Repeated (src, k, t, x) rows count once. Readings outside a whole slot of
    a live range are ignored; ranges without a whole slot give no rows; equal
    ranges count once. Windows over a source or range hold its slots (time over step), never its readings.
    """
    live = ranges.filter("k is not null and live_from is not null and live_to is not null").select("src", "k", "live_from", "live_to").distinct()
    first = F.ceil(F.col("live_from") / F.lit(step_ms)).cast("long")
    last = F.floor(F.col("live_to") / F.lit(step_ms)).cast("long") - 1
    grid = live.filter(last >= first).select("src", "k", "live_from", F.explode(F.sequence(first, last)).alias("i"))
    grid = grid.select("src", "k", "live_from", (F.col("i") * step_ms).alias("slot"))
    ok = readings.filter(F.col("k").isNotNull() & F.col("t").isNotNull() & F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < F.lit(float("inf"))))
    once = ok.groupBy("src", "k", F.col("t").cast("long").alias("t"), F.col("x").cast("double").alias("x")).agg(F.lit(1).alias("one"))
    seen = once.groupBy("src", "k", (F.floor(F.col("t") / F.lit(step_ms)).cast("long") * step_ms).alias("slot")).agg(F.avg("x").alias("observed"), F.count("x").alias("n"))
    # The optimizer takes an exploded table for as small as its source and would broadcast it: ask for a merge.
    rows = grid.hint("merge").join(seen, ["src", "k", "slot"], "left")

    # How far each slot lies from its neighbours, and how far the source's slots usually do.
    order = W.partitionBy("src", "k").orderBy("slot")
    around = F.array_sort(F.array_compact(F.array(*[g("observed", i).over(order) for g in (F.lag, F.lead) for i in range(1, beside + 1)])))
    size = F.size(around)
    middle = F.when(size > 0, (F.get(around, F.floor((size - 1) / 2).cast("int")) + F.get(around, F.floor(size / 2).cast("int"))) / 2)
    rows = rows.withColumn("off", F.abs(F.col("observed") - middle))
    rows = rows.withColumn("scale", 1.4826 * F.percentile_approx("off", 0.5, 1000).over(W.partitionBy("src", "k")))
    share = F.try_divide(F.col("off"), tune * F.col("scale"))
    # Without neighbours, or where they usually are equal, there is no telling.
    trust = F.when(F.col("off").isNull() | (F.col("scale") <= 0), 1.0).when(share < 1, F.pow(1 - share * share, 2)).otherwise(0.0)
    rows = rows.withColumn("w", F.when(F.col("observed").isNotNull(), trust)).drop("off", "scale")

    cols = basis(F.col("slot").cast("double"), F.col("live_from").cast("double"), list(periods_ms), trend_ms)
    p = len(cols)
    rows = rows.withColumn("f", F.array(*cols))
    f = [F.col("f")[i] for i in range(p)]
    w = F.col("w")
    sums = rows.filter("observed is not null").groupBy("src", "k").agg(
        F.array(*[F.sum(w * f[i] * f[j]) for i in range(p) for j in range(i, p)]).alias("xtx"), F.array(*[F.sum(w * f[i] * F.col("observed")) for i in range(p)]).alias("xty")
    )
    fit = sums.select("src", "k", _solve(p, ridge)("xtx", "xty").alias("beta"))
    rows = rows.join(fit, ["src", "k"], "left")
    fitted = f[0] * F.col("beta")[0]
    for i in range(1, p):
        fitted = fitted + f[i] * F.col("beta")[i]
    rows = rows.withColumn("fitted", fitted).withColumn("r", F.when(w > 0, F.col("observed") - F.col("fitted"))).drop("f", "beta", "w")

    along = W.partitionBy("src", "k", "live_from").orderBy("slot")
    mark = F.when(F.col("r").isNotNull(), F.struct("slot", "r"))
    rows = rows.withColumns({
        "lo": F.last(mark, ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0)),
        "hi": F.first(mark, ignorenulls=True).over(along.rowsBetween(0, W.unboundedFollowing)),
    })
    lo, hi = F.col("lo.r"), F.col("hi.r")
    share = F.try_divide((F.col("slot") - F.col("lo.slot")).cast("double"), (F.col("hi.slot") - F.col("lo.slot")).cast("double"))
    bridge = F.coalesce(lo + (hi - lo) * share, lo, hi)
    filled = F.coalesce("observed", F.col("fitted") + bridge)
    state = F.when(F.col("observed").isNotNull(), "observed").when(filled.isNotNull(), "filled").otherwise("empty")
    return rows.select("src", "k", "live_from", "slot", "observed", F.coalesce("n", F.lit(0)).alias("n"), "fitted", filled.alias("filled"), state.alias("state"))
