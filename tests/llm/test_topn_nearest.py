"""Top N and nearest time against brute force, with ties, nulls, repeats and clashing names."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.llm.nearest import nearest_within
from gridloom.llm.topn import top_n
from gridloom.operators.skew import lookup_join


def brute_top(rows, n):
    best = {}
    for g, i, s in rows:
        if g is not None and i is not None and s is not None and not math.isnan(s):
            best[g, i] = max(best.get((g, i), -math.inf), s + 0.0)
    out = []
    for g in {g for g, _ in best}:
        ranked = sorted(((-s, i.encode()) for (gg, i), s in best.items() if gg == g))
        out += [(g, i.decode(), k + 1) for k, (_, i) in enumerate(ranked[:n])]
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 3, 9])
@pytest.mark.parametrize("n", [1, 5])
def test_top_n(spark, parts, n):
    rng = random.Random(parts)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.choice(["a", "B", "é", "zz", "c1", "c2", "c3", "😀", "￿", None]), rng.choice([None, math.nan, math.inf, -math.inf, 0.0, -0.0, 1.0, 1.0, 2.5, rng.random()])) for _ in range(400)]
    rows += rows[:50] + [(7, "only", 1.0), (8, "x", None)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "g bigint, item string, score double, s string, rank string").repartition(parts)
    got = top_n(df, "g", "item", "score", n).collect()
    assert sorted((r.g, r.item, r.rank) for r in got) == brute_top(rows, n)


def test_top_n_of_one_huge_group_and_of_ties(spark):
    df = spark.range(60_000).select(F.lit(1).alias("g"), F.format_string("i%06d", "id").alias("item"), F.lit(1.0).alias("score")).repartition(6)
    assert [r.item for r in top_n(df, "g", "item", "score", 3).orderBy("rank").collect()] == ["i000000", "i000001", "i000002"]
    assert top_n(df.limit(0), "g", "item", "score", 3).count() == 0


def test_nearest(spark):
    rng = random.Random(4)
    left = [(rng.choice("abc"), rng.randrange(0, 3000)) for _ in range(300)] + [("a", None), (None, 4)]
    right = [(rng.choice("abd"), rng.randrange(-100, 3100)) for _ in range(120)] + [("a", None), (None, 4)]
    right += right[:10]
    want = []
    for k, t in sorted({x for x in left if None not in x}):
        near = sorted((abs(r - t), r) for kk, r in right if kk == k and r is not None and abs(r - t) <= 40)
        if near:
            want.append((k, t, near[0][1]))
    a = spark.createDataFrame([(*x, 1, 2) for x in left + left[:9]], "k string, t bigint, q int, r int")
    b = spark.createDataFrame([(*x, 1, 2) for x in right], "k string, r bigint, q int, t int")
    for tick in (None, 1, 7, 40, 1000):
        assert sorted(tuple(r) for r in nearest_within(a, "k", "t", b, "k", "r", 40, tick).toDF("k", "t", "r").collect()) == want
    assert nearest_within(a.limit(0), "k", "t", b, "k", "r", 40).count() == 0 and nearest_within(a, "k", "t", b.limit(0), "k", "r", 40).count() == 0


def test_lookup_join_keeps_every_row(spark):
    left = spark.range(1000).select(F.when(F.col("id") % 10 < 3, F.lit(1)).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v"))
    left = left.union(spark.createDataFrame([(None, 5)], "k bigint, v bigint"))
    right = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("x"), F.col("id").alias("w"))
    for hot in (1, 5, 100):
        got = lookup_join(left, right, ["k"], ["x"], "w", hot_keys=hot)
        assert got.count() == 1001 and got.filter("x is not null and x <> k * 2").count() == 0
        assert got.filter("x is null").count() == left.filter("k is null or k >= 40").count()
        kept = lookup_join(left, right, ["k"], ["x"], "w", keep=lambda v: v["x"] >= 20, hot_keys=hot)
        assert kept.count() == left.filter("k >= 10 and k < 40").count()


def test_nearest_of_many_records_within_one_tolerance(spark):
    """One entity, all times within one tick: the work grows with n log n, and equal times are matched."""
    n = 60_000
    a = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 4 + 1).alias("t"))
    b = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 4).alias("r"))
    got = nearest_within(a, "k", "t", b, "k", "r", 300_000)
    assert got.count() == n and got.filter("r <> t - 1").count() == 0
    same = nearest_within(b, "k", "r", b.withColumnRenamed("r", "s"), "k", "s", 300_000)
    assert same.count() == n and same.filter("r <> s").count() == 0
