"""The build chain: weights, index, forward legs, targets, and the scored book with its metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators import windows as wn
from gridloom.operators import xsec as xs
from gridloom.operators.grid import range_window
from gridloom.operators.rolling import rolling_regression

DAY_MS = 86_400_000


def volume_weights(panel: DataFrame, days: int = 30, least: int = 30) -> DataFrame:
    """symbol, t, adv, n_obs, weight: trailing mean volume over days and its share of the bar."""
    w = range_window(["symbol"], "t", -days * DAY_MS + 1, 0)
    out = panel.select("symbol", "t", wn.rolling("mean", "qv", w, least).alias("adv"), F.count("qv").over(w).alias("n_obs")).filter("adv is not null")
    return out.withColumn("weight", F.try_divide(F.col("adv"), F.sum("adv").over(W.partitionBy("t"))))


def weighted_index(returns: DataFrame, weights: DataFrame, step: int, least: int = 10, coverage: float = 0.0) -> DataFrame:
    """t, t_weight, r_m, n, coverage: returns weighted by the weights of one step before, renormalised over those present."""
    lagged = weights.select("symbol", (F.col("t") + step).alias("t"), F.col("t").alias("t_weight"), "weight")
    j = lagged.join(returns.select("symbol", "t", "r"), ["symbol", "t"], "left")
    got = F.when(F.col("r").isNotNull(), F.col("weight"))
    out = j.groupBy("t").agg(F.max("t_weight").alias("t_weight"), F.try_divide(F.sum(F.col("weight") * F.col("r")), F.nullif(F.sum(got), F.lit(0.0))).alias("r_m"), F.count("r").alias("n"), (F.coalesce(F.sum(got), F.lit(0.0)) / F.sum("weight")).alias("coverage"))
    return out.withColumn("r_m", F.when(F.col("n") >= least, F.col("r_m"))).filter(F.col("coverage") >= coverage)


def beta_idiovol(returns: DataFrame, index: DataFrame, n: int, least: int, lam: float = 1.0) -> DataFrame:
    """symbol, t, beta_raw, beta, sigma_eps, sigma_total, ratio, n_obs from rolling regression on the index."""
    x = returns.join(index.select("t", "r_m"), "t", "left")
    x = rolling_regression(x.select("symbol", "t", "r", "r_m"), ["symbol"], "t", "r", "r_m", n, least)
    x = x.select("symbol", "t", F.col("beta").alias("beta_raw"), F.sqrt(F.greatest("resid_var", F.lit(0.0))).alias("sigma_eps"), F.sqrt("var_y").alias("sigma_total"), "n_obs").filter("beta_raw is not null")
    return x.withColumns({"beta": wn.shrink_to_bar("beta_raw", ["t"], lam), "ratio": F.try_divide(F.col("sigma_eps"), F.nullif(F.col("sigma_total"), F.lit(0.0)))})


def forward_legs(panel: DataFrame, weights: DataFrame, step: int, least: int = 10) -> DataFrame:
    """symbol, t, fwd_ret, fwd_rm: return from this fill to the next one, and of the index with this bar's weights."""
    w = wn.along(["symbol"], "t")
    fwd = F.when(F.lead("t").over(w) - F.col("t") == step, F.try_divide(F.lead("fill").over(w), F.nullif(F.col("fill"), F.lit(0.0))) - 1)
    legs = panel.withColumn("fwd_ret", fwd).select("symbol", "t", "fwd_ret").filter("fwd_ret is not null")
    j = legs.join(weights.select("symbol", "t", "weight"), ["symbol", "t"])
    rm = j.groupBy("t").agg(F.try_divide(F.sum(F.col("weight") * F.col("fwd_ret")), F.nullif(F.sum("weight"), F.lit(0.0))).alias("fwd_rm"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    return legs.join(rm.select("t", "fwd_rm"), "t", "left")


def target(legs: DataFrame, betas: DataFrame) -> DataFrame:
    """(fwd_ret - beta * fwd_rm) / sigma for keys with all of them."""
    j = legs.join(betas.select("symbol", "t", "beta", "sigma"), ["symbol", "t"]).filter("fwd_rm is not null")
    return j.withColumn("target", F.try_divide(F.col("fwd_ret") - F.col("beta") * F.col("fwd_rm"), F.nullif(F.col("sigma"), F.lit(0.0))))


@dataclass(frozen=True)
class BookConfig:
    """How scores become weights: least members of a bar, division by sigma, neutrality to beta, smoothing and hedge."""

    least: int = 8
    by_sigma: bool = True
    beta_neutral: bool = False
    hedge_rows: int | None = 90
    hedge_warm: int = 200
    per_year: float = 1095.0


def book_weights(scored: DataFrame, cfg: BookConfig = BookConfig()) -> DataFrame:
    """Rank, demean, divide by sigma, demean, scale to gross one: adds ``w`` to bars of enough members."""
    rows = scored.filter(F.col("score").isNotNull()).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("t"))).filter(F.col("__n") >= cfg.least).drop("__n")
    rows = rows.withColumn("__p", xs.pct_rank("score", ["t"])).withColumn("__w", xs.demean("__p", ["t"]))
    if cfg.by_sigma:
        rows = rows.withColumn("__w", F.try_divide(F.col("__w"), F.nullif(F.col("sigma"), F.lit(0.0)))).withColumn("__w", xs.demean("__w", ["t"]))
    if cfg.beta_neutral:
        rows = rows.withColumn("__w", xs.neutralise("__w", "beta", ["t"]))
    return rows.withColumn("w", xs.gross_one("__w", ["t"])).drop("__p", "__w")


def turnover(weights: DataFrame) -> DataFrame:
    """t, turnover: sum of absolute changes from the bar before; absent members weigh 0, the first bar moves its whole gross."""
    order = weights.select("t").distinct().withColumn("nxt", F.lead("t").over(W.orderBy("t")))
    past = weights.join(order, "t").filter("nxt is not null").select(F.col("nxt").alias("t"), "symbol", (-F.col("w")).alias("w"))
    return weights.select("t", "symbol", "w").unionByName(past).groupBy("t", "symbol").agg(F.sum("w").alias("d")).groupBy("t").agg(F.sum(F.abs("d")).alias("turnover"))


def book_returns(weighted: DataFrame, cfg: BookConfig = BookConfig(), history: DataFrame | None = None) -> DataFrame:
    """t, gross, funding, hedge, ret: P&L per bar and, beyond the warm-up, hedged by the past-only ratio to the index.

    ``history`` (t, pnl, r_m) holds bars before the first one, so that state
    carries over a boundary. The series of bars is ordered by one task.
    """
    bars = weighted.groupBy("t").agg(F.sum(F.col("w") * F.col("fwd_ret")).alias("gross"), F.sum(F.col("w") * F.col("funding")).alias("funding"), F.avg("fwd_rm").alias("r_m"))
    bars = bars.withColumn("pnl", F.col("gross") - F.col("funding"))
    series = bars.select("t", "gross", "funding", "pnl", "r_m", F.lit(True).alias("own"))
    if history is not None:
        null = F.lit(None).cast("double")
        series = series.unionByName(history.select("t", null.alias("gross"), null.alias("funding"), "pnl", "r_m", F.lit(False).alias("own")))
    h = wn.hedge_ratio("pnl", "r_m", [], "t", cfg.hedge_rows, cfg.hedge_warm)
    series = series.withColumn("hedge", h).filter("own")
    return series.select("t", "gross", "funding", "hedge", "r_m", (F.col("pnl") - F.coalesce(F.col("hedge"), F.lit(0.0)) * F.col("r_m")).alias("ret"))


def metrics(series: DataFrame, ret: str = "ret", per_year: float = 1095.0, costs_bps: tuple[float, ...] = ()) -> DataFrame:
    """One row: bars, ann_return, vol, sharpe, hit, max_drawdown, and with a turnover column break-even and net Sharpe by cost."""
    one = series.withColumn("__one", F.lit(1)).withColumn("__e", wn.equity(ret, ["__one"], "t"))
    one = one.withColumn("__d", wn.drawdown("__e", ["__one"], "t"))
    mean, sd = F.avg(ret), F.stddev_samp(ret)
    out: dict[str, Column] = {
        "bars": F.count(ret), "ann_return": F.pow(1 + mean, per_year) - 1, "vol": sd * per_year**0.5,
        "sharpe": F.try_divide(mean, F.nullif(sd, F.lit(0.0))) * per_year**0.5, "hit": F.avg(F.when(F.col(ret) > 0, 1.0).otherwise(0.0)), "max_drawdown": F.min("__d"),
    }
    if "turnover" in series.columns:
        out["break_even_bps"] = F.try_divide(mean, F.nullif(F.avg("turnover"), F.lit(0.0))) * 1e4
        for c in costs_bps:
            net = F.col(ret) - F.col("turnover") * c / 1e4
            out[f"sharpe_at_{c:g}bps"] = F.try_divide(F.avg(net), F.nullif(F.stddev_samp(net), F.lit(0.0))) * per_year**0.5
    return one.agg(*[v.alias(k) for k, v in out.items()])
