"""As-of joins, time windows and cross-sections against pandas and plain loops."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators import rolling
from gridloom.operators import windows as wn
from gridloom.operators import xsec as xs
from gridloom.operators.asof import asof_join
from gridloom.operators.grid import census_of_gaps, contiguous_runs, densify, instants

K = ["k"]


@pytest.mark.parametrize("strict", [True, False])
@pytest.mark.parametrize("tol", [None, 7])
@pytest.mark.parametrize("skip", [True, False])
def test_asof_by_brute_force(spark, strict, tol, skip):
    rng = random.Random(7)
    facts = [(rng.choice("ab"), rng.randrange(0, 200), rng.choice([None, float(i)])) for i in range(60)] + [("a", None, 1.0), (None, 5, 1.0)]
    probes = [(rng.choice("abc"), rng.randrange(0, 220), i) for i in range(120)] + [("a", None, 900), (None, 5, 901)]
    ps, fs = spark.createDataFrame(probes, "k string, t bigint, id bigint"), spark.createDataFrame(facts, "k string, t bigint, v double")
    got = {r.id: (r.v, r.asof_time) for r in asof_join(ps, fs, K, "t", "t", ["v"], strict, tol, skip, bucket=16).collect()}
    assert len(got) == len(probes)
    for k, t, i in probes:
        c = [(ft, -math.inf if v is None else v, v) for fk, ft, v in facts if k is not None and t is not None and fk == k and ft is not None and (ft < t or ft == t and not strict) and not (skip and v is None)]
        best = max(c) if c else None
        if best is None or tol is not None and t - best[0] > tol:
            assert got[i] == (None, None)
        else:
            assert got[i] == (best[2], best[0])


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = [(k, i, None if rng.random() < 0.1 else float(np.round(rng.normal(), 2)), float(rng.normal())) for k in "abcde" for i in range(60)]
    pdf = pd.DataFrame(rows, columns=["k", "t", "x", "y"])
    return pdf, spark.createDataFrame(rows, "k string, t bigint, x double, y double")


def compare(df, pdf, col, want, tol=1e-9):
    got = df.select("k", "t", col).toPandas().set_index(["k", "t"])[col].sort_index().astype(float)
    want = pd.Series(np.asarray(want, float), index=pd.MultiIndex.from_frame(pdf[["k", "t"]])).sort_index()
    np.testing.assert_allclose(got.values, want.values, atol=tol, rtol=tol)


@pytest.mark.parametrize("fn", ["mean", "sum", "std", "min", "max"])
def test_rolling(panel, fn):
    pdf, df = panel
    want = pdf.groupby("k").x.transform(lambda s: getattr(s.rolling(10, min_periods=6), fn)())
    compare(df.withColumn("o", wn.rolling(fn, "x", wn.rows(K, "t", 10), 6)), pdf, "o", want)


def test_rolling_corr_z_and_rank(panel):
    pdf, df = panel
    w = wn.rows(K, "t", 15)
    roll = lambda s: s.rolling(15, min_periods=8)
    compare(df.withColumn("o", wn.zscore("x", w, 8)), pdf, "o", pdf.groupby("k").x.transform(lambda s: (s - roll(s).mean()) / roll(s).std()))
    compare(wn.rolling_pct_rank(df, K, "t", "x", 15, 8, "o"), pdf, "o", pdf.groupby("k").x.transform(lambda s: roll(s).rank(pct=True)))
    want = pdf.groupby("k")[["x", "y"]].apply(lambda g: g.x.rolling(15, min_periods=8).corr(g.y)).droplevel(0)
    compare(df.withColumn("o", wn.rolling_corr("x", "y", w, 8)), pdf, "o", want.reindex(pdf.index), 1e-7)


def test_folds_in_order(panel):
    pdf, df = panel
    full = df.fillna(0.0)
    f = pdf.fillna(0.0)
    compare(wn.ewm(full, K, "t", "x", 0.3, "o"), f, "o", f.groupby("k").x.transform(lambda s: s.ewm(alpha=0.3, adjust=False).mean()))

    def band(s):
        out, held = [], None
        for v in s:
            held = v if held is None or abs(v - held) > 0.8 else held
            out.append(held)
        return pd.Series(out, s.index)

    compare(wn.no_trade_band(full, K, "t", "x", 0.8, "o"), f, "o", f.groupby("k").x.transform(band))


def test_past_share_below(panel):
    pdf, df = panel
    v = np.random.default_rng(2).integers(0, 90, 1500).astype(float)
    v[::13] = np.nan
    assert wn.smaller_before(v, 16).tolist() == [int((v[:i] < v[i]).sum()) for i in range(len(v))]
    want = pdf.groupby("k").x.transform(lambda s: pd.Series([(s.values[:i] < x).sum() / i if i >= 5 and x == x else np.nan for i, x in enumerate(s.values)], s.index))
    compare(wn.past_share_below(df, K, "t", "x", 5, "o"), pdf, "o", want)


@pytest.mark.parametrize("fn", ["mean", "sum", "std", "var", "min", "max", "z"])
def test_rolled_equals_pandas(panel, fn):
    pdf, df = panel
    z = lambda s: (s - s.rolling(7, min_periods=4).mean()) / s.rolling(7, min_periods=4).std()
    want = pdf.groupby("k").x.transform(z if fn == "z" else lambda s: getattr(s.rolling(7, min_periods=4), fn)())
    compare(rolling.rolled(df, K, "t", {"o": (fn, "x", 7, 4)}), pdf, "o", want, 1e-9)
    blocks = rolling.home(rolling.rolled(rolling.in_blocks(df.withColumn("t", F.col("t") * 40_000_000), K, "t", 7, 10), [*K, "__block"], "t", {"o": (fn, "x", 7, 4)}))
    compare(blocks.withColumn("t", (F.col("t") / 40_000_000).cast("bigint")), pdf, "o", want, 1e-9)


def test_constant_windows_have_no_variance(spark):
    df = spark.createDataFrame([("a", i, 0.1) for i in range(50)], "k string, t bigint, x double")
    got = rolling.rolled(df, K, "t", {"s": ("std", "x", 10, 2), "z": ("z", "x", 10, 2)}).collect()
    assert all(r.z is None and (r.s == 0 or r.t == 0) for r in got)


def test_no_task_holds_a_hot_symbol(spark):
    """One symbol holds half of the rows; its blocks, halo included, stay small, and lags across their borders are right."""
    day = 86_400_000
    hot = spark.range(20_000).select(F.lit("hot").alias("k"), (F.col("id") * (day // 500)).alias("t"), F.col("id").cast("double").alias("x"))
    rest = spark.range(20_000).select(F.concat(F.lit("c"), F.col("id") % 50).alias("k"), (F.col("id") * (day // 100)).alias("t"), F.col("id").cast("double").alias("x"))
    b = rolling.in_blocks(hot.union(rest), K, "t", 3, 2_000)
    assert b.groupBy("k", "__block").count().agg(F.max("count")).first()[0] <= 2_000 + 2 * 500 + 3
    out = rolling.home(b.withColumn("d", F.col("x") - F.lag("x", 3).over(W.partitionBy("k", "__block").orderBy("t")))).filter("k = 'hot'")
    assert out.count() == 20_000 and out.filter("d = 3").count() == 19_997


def test_a_busy_day_is_cut(spark):
    """All rows of a symbol within one day, half of them in an hour: pieces stay within bounds, and lags hold across them."""
    n, day = 40_000, 86_400_000
    t = F.when(F.col("id") < n // 2, F.col("id") * 180).otherwise((F.col("id") - n // 2) * 4_000 + 3_600_000)
    df = spark.range(n).select(F.lit("hot").alias("k"), t.cast("bigint").alias("t"), F.col("id").alias("x"))
    b = rolling.in_blocks(df, K, "t", 3, 1_000)
    assert b.groupBy("k", "__bucket").count().agg(F.max("count")).first()[0] < 8_000 and b.agg(F.max("t")).first()[0] < day
    out = rolling.home(b.withColumn("d", F.col("x") - F.lag("x", 3).over(W.partitionBy("k", "__block").orderBy("t"))))
    assert out.count() == n and out.filter("d = 3").count() == n - 3


def test_runs_and_gaps(spark):
    rows = [("a", t, v) for t, v in ((0, 1.0), (1, 2.0), (2, -1.0), (3, -2.0), (4, None), (5, -1.0), (8, 0.0))]
    df = spark.createDataFrame(rows, "k string, t bigint, x double")
    assert [r.n for r in wn.signed_run(df, "x", K, "t", "n").orderBy("t").collect()] == [1, 2, -1, -2, None, -1, 0]
    assert [(r["first"], r["last"], r.n) for r in contiguous_runs(df, K, "t", 1).orderBy("first").collect()] == [(0, 5, 6), (8, 8, 1)]
    assert [(r.after, r.before, r.missing) for r in census_of_gaps(df, K, "t", 1).collect()] == [(5, 8, 2)]
    assert densify(df, K, "t", 1).count() == 9
    assert wn.longest_losing_run(df, "x", K, "t").first()[1:] == (3, 2)
    assert [r.t for r in instants(spark, 5, 21, 5).collect()] == [5, 10, 15, 20]


def test_gap_return_and_ols(panel, spark):
    df = spark.createDataFrame([("a", 0, 2.0), ("a", 1, 3.0), ("a", 3, 6.0), ("a", 4, 0.0), ("a", 5, 1.0)], "k string, t bigint, p double")
    got = [r.o for r in df.withColumn("o", wn.gap_return("p", "t", K, 1)).orderBy("t").collect()]
    assert got == [None, 0.5, None, -1.0, None]
    pdf, frame = panel
    got = rolling.rolling_regression(frame, K, "t", "x", "y", 20, 10).selectExpr("k", "t", "beta", "resid_var as rv", "n_obs as n").filter("k = 'a' and t = 40").first()
    g = pdf[(pdf.k == "a") & (pdf.t > 20) & (pdf.t <= 40)].dropna()
    beta, a = np.polyfit(g.y, g.x, 1)
    assert got.n == len(g) and abs(got.beta - beta) < 1e-9
    assert abs(got.rv - ((g.x - a - beta * g.y) ** 2).sum() / (len(g) - 2)) < 1e-9


def test_cross_sections(panel):
    pdf, df = panel
    by = pdf.groupby("t")
    compare(df.withColumn("o", xs.pct_rank("x", ["t"])), pdf, "o", by.x.rank(pct=True))
    compare(df.withColumn("o", xs.demean("x", ["t"])), pdf, "o", pdf.x - by.x.transform("mean"))
    compare(df.withColumn("d", xs.demean("x", ["t"])).withColumn("o", xs.gross_one("d", ["t"])), pdf, "o", (pdf.x - by.x.transform("mean")) / (pdf.x - by.x.transform("mean")).abs().groupby(pdf.t).transform("sum"))
    n = by.x.transform("count")
    compare(df.withColumn("o", xs.peer_mean("x", ["t"])), pdf, "o", ((by.x.transform("sum") - pdf.x) / (n - 1)).where((n >= 2) & pdf.x.notna()))
    ic = xs.bar_ic(df, "x", "y", ["t"], 3).toPandas().set_index("t").ic
    want = pdf.dropna().groupby("t").apply(lambda g: g.x.rank().corr(g.y.rank()) if len(g) >= 3 else np.nan).dropna()
    np.testing.assert_allclose(ic.sort_index().astype(float), want.sort_index(), atol=1e-9)


@pytest.mark.parametrize("n", [1, 2, 5, 17, 18, 19, 30])
def test_quintiles_equal_those_of_pandas(spark, n):
    df = spark.range(n).select(F.lit(0).alias("t"), F.col("id").alias("k"), F.rand(3).alias("x"))
    pdf = df.withColumn("o", xs.quantile_bucket("x", ["t"], ["k"], 5)).toPandas()
    if n >= 5:
        assert (pdf.o.values == pd.qcut(pdf.x.rank(method="first"), 5, labels=False).values).all()
    else:
        assert pdf.o.min() >= 0 and pdf.o.max() <= 4


def test_shuffle_permutes_within_bars(spark):
    df = spark.range(200).select((F.col("id") % 5).alias("t"), F.col("id").cast("string").alias("m"), F.col("id").cast("double").alias("x"))
    a, b = (xs.shuffle_in_bar(df, "x", ["t"], "m", s, "z").toPandas() for s in (1, 2))
    assert a.groupby("t").z.apply(sorted).tolist() == a.groupby("t").x.apply(sorted).tolist()
    assert (a.sort_values("m").z.values != b.sort_values("m").z.values).any()


@pytest.mark.parametrize("block", [10, 32_768])
def test_counted_ranks_of_a_hot_bar(spark, block):
    """A bar that holds half of the rows, with ties and NULLs, cut into ranges; the same as pandas."""
    rng = np.random.default_rng(6)
    t = np.where(np.arange(4000) % 2 == 0, 7, rng.integers(0, 6, 4000))
    x = np.round(rng.normal(size=4000), rng.integers(1, 4, 4000)[0])
    pdf = pd.DataFrame({"t": t, "x": np.where(rng.random(4000) < 0.05, np.nan, x), "i": np.arange(4000)})
    df = spark.createDataFrame([(int(a), None if b != b else float(b), int(c)) for a, b, c in pdf.itertuples(index=False)], "t bigint, x double, i int")
    got = xs.counted_ranks(df, "x", ["t"], block).withColumn("o", xs.counted_mean_rank("x")).toPandas().sort_values("i")
    np.testing.assert_allclose(got.o.astype(float).values, pdf.groupby("t").x.rank().values)
    n = pdf.groupby("t").x.transform("count")
    assert (got.x_n.dropna().astype(int).values == n[pdf.x.notna()].values).all() and len(got) == 4000

    places = xs.counted_ordinals(df.filter("x is not null"), "x", ["t"], ["i"]).toPandas().sort_values("i")
    order = pdf.dropna().sort_values(["t", "x", "i"])
    want = (order.groupby("t").cumcount() + 1).sort_index()
    assert places.x_down.astype(int).tolist() == want.tolist()
    down = (pdf.dropna().sort_values(["t", "x", "i"], ascending=[True, False, True]).groupby("t").cumcount() + 1).sort_index()
    assert places.x_up.astype(int).tolist() == down.tolist()
