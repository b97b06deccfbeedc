"""Every family builds its features on the panel's keys, ahead of nothing it may not see."""

import numpy as np
import pandas as pd
import pytest

from gridloom.plans.features import FAMILIES, Context
from gridloom.operators.rolling import rolling_pair_corr

H8 = 28_800_000
T0 = 1_609_459_200_000


@pytest.fixture(scope="module")
def ctx(spark):
    rng = np.random.default_rng(4)
    names, n = ["aa", "ab", "ba", "bb"], 160
    steps = T0 + np.arange(1, n + 1) * H8
    panel = [(s, int(t), 100 * float(np.exp(rng.normal(0, 0.01))), 1e6 + 1e5 * float(rng.random())) for s in names for t in steps]
    tape, hourly = [], []
    for s in names:
        p = 100.0
        for i in range(n * 16):
            q = p * float(np.exp(rng.normal(0, 0.002)))
            tape.append((s, int(T0 + (i + 1) * H8 // 16), p, max(p, q) * 1.001, min(p, q) * 0.999, q, 10.0 + float(rng.random()), 1000.0 + 50 * float(rng.random()), int(rng.integers(5, 50)), 500.0))
            p = q
        hourly += [(s, int(T0 + (i + 1) * 3_600_000), float(rng.normal(0, 0.01)), float(rng.normal(0, 0.01))) for i in range(n * 8)]
    f = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    t = f(tape, "symbol string, t bigint, open double, high double, low double, close double, volume double, quote_volume double, trade_count bigint, taker_buy_quote_volume double")
    u = t.selectExpr("symbol", "t + 17000 as t", "open", "high", "low", "open * 1.0001 as close", "volume", "quote_volume * (0.5 + pmod(hash(t), 7) / 10) as quote_volume", "trade_count + pmod(hash(t), 9) as trade_count", "taker_buy_quote_volume * 0.4 as taker_buy_quote_volume")
    data = {
        "panel": f(panel, "symbol string, t bigint, px double, qv double"), "tape": t, "spot": u,
        "hourly": f(hourly, "symbol string, t bigint, r double, r_m double"), "index": f([(int(x), float(rng.normal(0, 0.01))) for x in steps], "t bigint, r_m double"),
        "betas": f([(s, int(x), 1.0 + 0.1 * float(rng.random()), 0.01 + 0.001 * float(rng.random())) for s in names for x in steps], "symbol string, t bigint, beta double, sigma double"),
        "premium": t.selectExpr("symbol", "t", "close / open - 1 as close", "greatest(close / open - 1, 0) as high", "least(close / open - 1, 0) as low"),
        "funding": f([(s, int(x), 1e-4 * float(rng.normal())) for s in names for x in steps], "symbol string, t bigint, rate double"), "oi": t.selectExpr("symbol", "t", "volume as oi", "quote_volume as oi_value"),
        "weights": f([(s, int(x), 0.25) for s in names for x in steps], "symbol string, t bigint, weight double"),
        "sectors": f([(s, s[0]) for s in names], "symbol string, g string"), "delivery": f([("x", int(x), T0 + 200 * H8, 101.0, 100.0) for x in steps], "contract string, t bigint, expiry bigint, px double, ref double"),
    }
    return Context(data, lead=("aa", "ab"))


@pytest.mark.parametrize("name", sorted(FAMILIES))
def test_family(ctx, name):
    fam = type(FAMILIES[name])(0.08)
    full = fam.build(ctx).toPandas().set_index(["symbol", "t"]).sort_index()
    assert full.index.is_unique and len(full) == 640 and list(full.columns) == list(fam.features)
    assert (full.notna().mean() > 0.25).all(), full.notna().mean()
    assert not np.isinf(full.values.astype(float)).any()
    cut = T0 + 120 * H8
    early = fam.build(Context(ctx.data, cutoff=cut, lead=ctx.lead)).toPandas().set_index(["symbol", "t"]).sort_index()
    both = full[full.index.get_level_values("t") < cut]
    pd.testing.assert_frame_equal(both, early, check_exact=False, rtol=1e-7, atol=1e-9)


def test_the_catalogue_is_whole_and_the_target_is_sealed(ctx):
    assert sum(len(f.features) for f in FAMILIES.values()) == 72
    with pytest.raises(PermissionError):
        Context(ctx.data).scan("target")


def test_prefix_correlation_equals_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"symbol": "a", "t": range(200), "x": rng.normal(size=200), "y": rng.normal(size=200)})
    pdf.loc[pdf.t % 17 == 0, "x"] = None
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)], "symbol string, t bigint, x double, y double")
    got = rolling_pair_corr(df, ["symbol"], "t", "x", "y", 40, 20, "c").toPandas().sort_values("t").c.astype(float)
    np.testing.assert_allclose(got.values, pdf.x.rolling(40, min_periods=20).corr(pdf.y).values, atol=1e-9)


def asof(times, values, at):
    i = np.searchsorted(times, at, side="right") - 1
    return np.where(i >= 0, values[np.maximum(i, 0)], np.nan)


def test_lead_lag_equals_the_filled_minute_grid(spark):
    """Two uneven tapes with gaps, against every minute of a grid filled as of it."""
    rng = np.random.default_rng(3)
    minute, bars = 60_000, 40
    fam = type(FAMILIES["G"])(0.2)
    tapes = {}
    for name, late in (("tape", 0), ("spot", 5 * minute + 17)):
        t = T0 + late + np.sort(rng.choice(np.arange(3_000, bars * H8, 777), 600, replace=False)).astype(np.int64)
        tapes[name] = (t, 100 * np.exp(np.cumsum(rng.normal(0, 0.001, 600))))
    frame = lambda k: spark.createDataFrame([("a", int(t), float(c)) for t, c in zip(*tapes[k])], "symbol string, t bigint, close double")
    panel = spark.createDataFrame([("a", int(T0 + i * H8), 1.0, 1.0) for i in range(1, bars)], "symbol string, t bigint, px double, qv double")
    got = fam.lead_lag(Context({"panel": panel, "tape": frame("tape"), "spot": frame("spot")})).toPandas().set_index("t").perp_spot_leadlag.sort_index()
    grid = np.arange(tapes["tape"][0].min(), T0 + bars * H8, minute)
    pp, ss = (pd.Series(asof(*tapes[k], grid), grid).pct_change(fill_method=None) for k in ("tape", "spot"))
    least = fam.m(3_360)
    want = pp.rolling(10_080, min_periods=least).corr(ss.shift(1)) - pp.shift(1).rolling(10_080, min_periods=least).corr(ss)
    want = pd.Series(asof(grid, want.to_numpy(), got.index.to_numpy()), got.index)
    np.testing.assert_allclose(got.astype(float).values, want.values, atol=1e-8)
    assert got.notna().sum() > 30


def test_ranges_equal_pandas_rows(spark):
    """Extremes of the last rows of a tape, whatever time they span, across block borders."""
    from gridloom.plans.features import tape_range

    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"symbol": "a", "t": np.sort(rng.choice(10**9, 900, replace=False)), "high": rng.normal(size=900), "low": rng.normal(size=900)})
    got = tape_range(spark.createDataFrame(pdf), 50, 12).toPandas().sort_values("t")
    np.testing.assert_allclose(got.hi.astype(float).values, pdf.high.rolling(50, min_periods=12).max().values)
    np.testing.assert_allclose(got.lo.astype(float).values, pdf.low.rolling(50, min_periods=12).min().values)


def test_availability_counts_after_the_warm_up(ctx):
    fam = type(FAMILIES["A"])(0.08)
    got = {r.feature: (r.rows, r.usable) for r in fam.availability(ctx).collect()}
    assert set(got) == set(fam.features) and all(n == 4 * (160 - 90) for n, _ in got.values())
    assert all(0 < u <= n for n, u in got.values())
