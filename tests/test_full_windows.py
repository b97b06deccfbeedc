"""The registered feature queries take the full windows, whatever the length of the data."""

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from gridloom.plans import chain_queries
from gridloom.plans.features import Context

H8 = 28_800_000
N = 120


@pytest.fixture(scope="module")
def bars():
    rng = np.random.default_rng(5)
    t = np.arange(1, N + 1) * H8
    r = rng.normal(0, 0.01, N)
    pdf = pd.DataFrame({"t": t, "px": 100 * np.cumprod(1 + r), "qv": 1e6, "r_m": rng.normal(0, 0.01, N), "beta": 1 + 0.1 * rng.random(N), "sigma": 0.01, "rate": 1e-4 * rng.normal(size=N)})
    return pdf.assign(symbol="a", e8=(pdf.px.pct_change() - pdf.beta * pdf.r_m) / pdf.sigma)


def run(spark, monkeypatch, bars, name):
    f = lambda *c: spark.createDataFrame(bars[list(c)])
    ctx = Context({"panel": f("symbol", "t", "px", "qv"), "index": f("t", "r_m"), "betas": f("symbol", "t", "beta", "sigma"), "funding": f("symbol", "t", "rate")})
    monkeypatch.setattr(chain_queries, "feature_context", lambda spark, sf: ctx)
    return entry.queries()[name](spark, "unused").toPandas().sort_values("t").reset_index(drop=True)


def same(got, want):
    np.testing.assert_allclose(got.astype(float).values, want.values, atol=2e-6)


def test_residual_sums(spark, monkeypatch, bars):
    got = run(spark, monkeypatch, bars, "features_h")
    same(got.resid_sum_5, bars.e8.rolling(5, min_periods=3).sum())
    same(got.resid_sum_20, bars.e8.rolling(20, min_periods=12).sum())


def test_beta_instability(spark, monkeypatch, bars):
    same(run(spark, monkeypatch, bars, "features_e").beta_instability, bars.beta.rolling(90, min_periods=54).std())


def test_funding_of_seven_days(spark, monkeypatch, bars):
    same(run(spark, monkeypatch, bars, "features_a").funding_cum_7d, bars.rate.rolling(21, min_periods=12).sum())
