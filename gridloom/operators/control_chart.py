"""Robust exponentially weighted control charts per source: spikes, impossible and frozen readings."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.skew import ordered_blocks, time_buckets

DAY_MS = 86_400_000


@dataclass(frozen=True)
class ChartSpec:
    """Parameters of the chart.

    weight: share of a new reading in the moving level and variance.
    clip: readings move the state as if they lay at most this many scales off.
    suspect: scales off at which a reading is suspected and left out of the
        source's normal level and spread.
    anchor: the moving scale stays within this factor of the source's robust
        scale and the moving level within one robust scale of its median, so
        ``suspect * anchor + 1 < limit`` suspects whatever the limit can flag.
        None lets the chart follow a source that drifts, without that promise.
    limit: normal spreads off the normal level beyond which a reading is a spike.
    run, run_tol: members of a run of equal readings that make it frozen, and
        the relative tolerance of equality.
    block_rows, halo_rows, bucket_ms: how the time order of a source is cut
        into tasks; a bucket of more rows than a block is cut finer.
    """

    weight: float = 0.05
    clip: float = 3.0
    suspect: float = 5.5
    anchor: float | None = 1.4
    limit: float = 10.0
    run: int = 6
    run_tol: float = 1e-9
    block_rows: int = 32_768
    halo_rows: int = 96
    bucket_ms: int = DAY_MS


def _gain(clip: float) -> float:
    """E[min(z^2, clip^2)] of a standard normal z, by which the clipped variance falls short."""
    tail = math.erfc(clip / math.sqrt(2))
    return 1 - tail - 2 * clip * math.exp(-clip * clip / 2) / math.sqrt(2 * math.pi) + clip * clip * tail


def _chart(x: list[float], home: list[bool], m0: float, s0: float, p: ChartSpec) -> tuple[list[int], int, float, float]:
    """Run one block in time order: indices of suspected home readings, and n, sum and sum of squares (about m0) of the rest."""
    lam, c, k, gain = p.weight, p.clip, p.suspect, _gain(p.clip)
    lo_v, hi_v, lo_m, hi_m = 0.0, math.inf, -math.inf, math.inf
    if p.anchor is not None:
        lo_v, hi_v, lo_m, hi_m = (s0 / p.anchor) ** 2, (s0 * p.anchor) ** 2, m0 - s0, m0 + s0
    m, v, s = m0, s0 * s0, s0
    bad: list[int] = []
    n, a, b = 0, 0.0, 0.0
    for i, y in enumerate(x):
        e = y - m
        if home[i]:
            if e > k * s or e < -k * s:
                bad.append(i)
            else:
                d = y - m0
                n += 1
                a += d
                b += d * d
        top = c * s
        e = top if e > top else (-top if e < -top else e)
        m += lam * e
        m = lo_m if m < lo_m else (hi_m if m > hi_m else m)
        v += lam * (e * e / gain - v)
        v = lo_v if v < lo_v else (hi_v if v > hi_v else v)
        s = math.sqrt(v)
    return bad, n, a, b


def _frozen(x: np.ndarray, run: int, tol: float) -> np.ndarray:
    """Members of runs of at least ``run`` successive finite readings, each equal to the next."""
    n = len(x)
    if n < run:
        return np.zeros(n, bool)
    with np.errstate(invalid="ignore"):
        eq = np.abs(x[1:] - x[:-1]) <= tol * np.maximum(np.abs(x[1:]), np.abs(x[:-1]))
    eq &= np.isfinite(x[1:]) & np.isfinite(x[:-1])
    first = np.flatnonzero(np.r_[True, ~eq])
    length = np.diff(np.r_[first, n])
    return np.repeat(length >= run, length)


def chart_readings(readings: DataFrame, source: list[str], time: str, value: str, spec: ChartSpec = ChartSpec()) -> DataFrame:
    """Flag readings that lie far out of their source's normal behaviour or belong to a frozen run.

    Returns source columns, ``time``, ``value`` and BOOLEAN ``infinite``,
    ``spike``, ``frozen``, one row for each reading with any flag set.

    Method: per source an exponentially weighted chart of level and scale,
    whose updates clip suspected values, is run over the time order, cut into
    blocks of bounded size led by a halo of earlier readings. It starts from,
    and stays near, robust quantiles of the source. Readings it does not
    suspect make up the source's normal level and spread; suspects further
    than ``limit`` spreads off are spikes. Run lengths are counted in the same
    pass; a run that crosses a block's start is seen whole through the halo.

    Defined cases: NULL or NaN values, times or source columns are no
    readings. Repeated (source, time, value) rows count once; equal times order
    by value. A source whose readings are all equal has spread 0 and no spike.
    A zero scale of the inner quantiles falls back to that of the outer ones.
    Empty input gives an empty result. Other columns are ignored.
    """
    names = [f"k{i}" for i in range(len(source))]
    col = lambda c: F.col(f"`{c}`")
    raw = readings.select(*[col(c).alias(n) for c, n in zip(source, names)], col(time).cast("long").alias("t"), col(value).cast("double").alias("x"))
    raw = raw.filter(F.col("x").isNotNull() & ~F.isnan("x") & F.col("t").isNotNull())
    for n in names:
        raw = raw.filter(F.col(n).isNotNull())
    finite = F.abs("x") < F.lit(float("inf"))

    q = F.percentile_approx("x", [0.005, 0.025, 0.16, 0.5, 0.84, 0.975, 0.995], 500)
    base = raw.filter(finite).groupBy(*names).agg(q.alias("q")).withColumns({f"q{i}": F.col("q")[i] for i in range(7)})
    s0, w0 = F.greatest((F.col("q4") - F.col("q2")) / 2, (F.col("q5") - F.col("q1")) / 3.92), (F.col("q6") - F.col("q0")) / 5.15
    base = base.select(*names, F.col("q3").alias("m0"), F.when(s0 > 0, s0).otherwise(w0).alias("s0"))

    # That b is known is said here, so that counts and readings read one exchange: only one side would infer it from the join.
    rows = time_buckets(raw, names, "t", spec.bucket_ms, spec.block_rows, "b").filter("b is not null").repartition(*names, "b").dropDuplicates([*names, "b", "t", "x"])
    blocks = ordered_blocks(rows, names, "b", spec.block_rows, spec.halo_rows, base)

    out_schema = ", ".join(f"{n} {dict(raw.dtypes)[n]}" for n in names) + ", t bigint, x double, frozen boolean, suspect boolean, n bigint, a double, b double, m0 double"

    def run(table: pa.Table) -> pa.Table:
        t, x = table["t"].to_numpy(), table["x"].to_numpy()
        order = np.lexsort((x, t))
        t, x, home = t[order], x[order], table["__home"].to_numpy(zero_copy_only=False)[order]
        m0, s0 = table["m0"][0].as_py(), table["s0"][0].as_py()
        inf = ~np.isfinite(x)
        frozen = _frozen(x, spec.run, spec.run_tol)
        suspect = inf & home
        n, a, b = 0, 0.0, 0.0
        if m0 is not None:
            at = np.flatnonzero(~inf)
            bad, n, a, b = _chart(x[at].tolist(), home[at].tolist(), m0, s0, spec)
            suspect[at[bad]] = True
        pick = np.flatnonzero(frozen | suspect)
        k = len(pick)
        cols = {c: pa.concat_arrays([pa.repeat(table[c][0], k + 1)]) for c in names}
        none = lambda size, kind: pa.nulls(size, kind)
        cols["t"] = pa.concat_arrays([pa.array(t[pick], pa.int64()), none(1, pa.int64())])
        cols["x"] = pa.concat_arrays([pa.array(x[pick], pa.float64(), from_pandas=False), none(1, pa.float64())])
        cols["frozen"] = pa.concat_arrays([pa.array(frozen[pick]), none(1, pa.bool_())])
        cols["suspect"] = pa.concat_arrays([pa.array(suspect[pick]), none(1, pa.bool_())])
        cols["n"] = pa.concat_arrays([none(k, pa.int64()), pa.array([n], pa.int64())])
        cols["a"] = pa.concat_arrays([none(k, pa.float64()), pa.array([a], pa.float64())])
        cols["b"] = pa.concat_arrays([none(k, pa.float64()), pa.array([b], pa.float64())])
        cols["m0"] = pa.concat_arrays([none(k, pa.float64()), pa.array([m0], pa.float64())])
        return pa.table(cols)

    charted = blocks.groupBy(*names, "__block").applyInArrow(run, out_schema)
    # One aggregate holds the picked readings and, with a NULL time, the sums of each source. Both sides of the join
    # keep all its aggregates alive (the filters), so that the charts run once and both read one exchange.
    both = charted.groupBy(*names, "t", "x").agg(*[F.max(c).alias(c) for c in ("frozen", "suspect")], *[F.sum(c).alias(c) for c in ("n", "a", "b")], F.max("m0").alias("m0"))
    picked = both.filter("n is null and a is null and b is null and m0 is null").select(*names, "t", "x", "frozen", "suspect")
    sums = both.filter("frozen is null and suspect is null").select(*names, "n", "a", "b", "m0")
    mean = F.try_divide(F.col("a"), F.col("n"))
    normal = sums.select(*names, (F.col("m0") + mean).alias("level"), F.sqrt(F.greatest(F.try_divide(F.col("b"), F.col("n")) - mean * mean, F.lit(0.0))).alias("spread"))
    out = picked.join(normal, names)  # inner: a left join would filter one side only and part the two
    infinite = F.abs("x") == F.lit(float("inf"))
    far = F.col("suspect") & ~infinite & F.coalesce(F.abs(F.col("x") - F.col("level")) > spec.limit * F.col("spread"), F.lit(False))
    out = out.select(*[F.col(n).alias(c) for c, n in zip(source, names)], F.col("t").alias(time), F.col("x").alias(value), infinite.alias("infinite"), far.alias("spike"), F.col("frozen"))
    return out.filter(F.col("infinite") | F.col("spike") | F.col("frozen"))


def physical_limits(readings: DataFrame, value: str, low_excl: dict[str, float], field: str) -> DataFrame:
    """Readings at or below the physical floor of their field: ``low_excl`` maps a field to the value that can't be reached."""
    rule = F.lit(False)
    for name, floor in low_excl.items():
        rule = rule | ((F.col(field) == name) & (F.col(value) <= floor))
    return readings.filter(rule & F.col(value).isNotNull() & ~F.isnan(value))
