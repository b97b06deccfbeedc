"""Spikes, frozen runs and impossible readings against a plain reading of the rule."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators.control_chart import ChartSpec, _frozen, chart_readings, physical_limits

SCHEMA = "src string, t bigint, x double, note string, k0 string"
HOUR = 3_600_000


def series(name, values, start=0):
    return [(name, start + i * HOUR, v, "n", "clash") for i, v in enumerate(values)]


def flags(spark, rows, spec=ChartSpec()):
    out = chart_readings(spark.createDataFrame(rows, SCHEMA), ["src"], "t", "x", spec)
    return {(r.src, r.t // HOUR): (r.infinite, r.spike, r.frozen) for r in out.collect()}


def noise(n, seed, sd=0.01):
    return np.random.default_rng(seed).normal(0, sd, n).tolist()


def test_spikes_frozen_and_infinite_are_flagged_and_order_does_not_matter(spark):
    a = noise(400, 1)
    a[50], a[120], a[200], a[399] = 0.5, -0.4, math.inf, 0.3
    a[300:307] = [0.004] * 7
    a[350:355] = [0.002] * 5
    rows = series("a", a)
    want = {("a", 50): (False, True, False), ("a", 120): (False, True, False), ("a", 200): (True, False, False), ("a", 399): (False, True, False)}
    want |= {("a", i): (False, False, True) for i in range(300, 307)}
    assert flags(spark, rows) == want
    assert flags(spark, rows[::-1] + rows[:40]) == want  # repeated rows count once


def test_small_blocks_give_the_same_as_one(spark):
    a = noise(900, 2)
    for i in (10, 333, 334, 700):
        a[i] = 0.4
    a[445:455] = [0.001] * 10
    small = ChartSpec(block_rows=48, halo_rows=30, bucket_ms=6 * HOUR)
    assert flags(spark, series("a", a), small) == flags(spark, series("a", a))


def test_each_source_has_its_own_normal(spark):
    rows = series("calm", noise(300, 3, 0.001)) + series("wild", noise(300, 4, 0.1))
    rows[100] = ("calm", 100 * HOUR, 0.05, "n", "c")  # ordinary for the other source
    assert flags(spark, rows) == {("calm", 100): (False, True, False)}


def test_many_zeros_are_honest(spark):
    a = noise(600, 5)
    a = [0.0 if i % 3 == 0 else v for i, v in enumerate(a)]
    assert flags(spark, series("a", a)) == {}


def test_nulls_nans_constant_and_empty(spark):
    rows = [("a", 0, None, "n", "c"), ("a", 1, math.nan, "n", "c"), (None, 2, 1.0, "n", "c"), ("a", None, 1.0, "n", "c"), ("b", 3, math.inf, "n", "c")]
    assert list(flags(spark, rows).values()) == [(True, False, False)]
    assert flags(spark, series("c", [1.0] * 5)) == {}
    assert set(flags(spark, series("c", [1.0] * 6)).values()) == {(False, False, True)}
    assert chart_readings(spark.createDataFrame([], SCHEMA), ["src"], "t", "x").count() == 0


@pytest.mark.parametrize("values, run", [([1, 1, 1, 2, 1, 1], 3), ([5.0] * 4 + [math.inf] * 3, 3), ([0.0, 0.0, -0.0], 3), ([1.0, 1.0 + 1e-10, 1.0 + 2e-10], 3), ([1.0, 1.0 + 1e-8, 1.0], 3), ([1.0], 2)])
def test_frozen_runs_by_brute_force(values, run):
    x = np.array(values, float)
    same = lambda a, b: math.isfinite(a) and math.isfinite(b) and abs(a - b) <= 1e-9 * max(abs(a), abs(b))
    want = []
    for i in range(len(x)):
        lo = hi = i
        while lo and same(x[lo - 1], x[lo]):
            lo -= 1
        while hi + 1 < len(x) and same(x[hi], x[hi + 1]):
            hi += 1
        want.append(hi - lo + 1 >= run)
    assert _frozen(x, run, 1e-9).tolist() == want


def test_physical_limits(spark):
    df = spark.createDataFrame([("ret", -1.0), ("ret", -0.99), ("y", -5.0), ("ret", None), ("ret", math.nan)], "field string, x double")
    assert [(r.field, r.x) for r in physical_limits(df, "x", {"ret": -1.0}, "field").collect()] == [("ret", -1.0)]


def test_hot_source_is_cut_into_blocks(spark):
    from gridloom.operators.skew import ordered_blocks

    rows = spark.range(5000).select(F.lit("hot").alias("s"), F.col("id").alias("t"), F.floor(F.col("id") / 10).alias("b")).repartition("s", "b")
    got = ordered_blocks(rows, ["s"], "b", 500, 20)
    sizes = {r["__block"]: (r.home, r.halo) for r in got.groupBy("__block").agg(F.sum(F.col("__home").cast("int")).alias("home"), F.sum((~F.col("__home")).cast("int")).alias("halo")).collect()}
    assert sum(h for h, _ in sizes.values()) == 5000 and max(h for h, _ in sizes.values()) <= 510
    assert sizes[0][1] == 0 and all(20 <= halo <= 40 for k, (_, halo) in sizes.items() if k)
