"""Clean views of the test tables that the panel queries share, as DataFrames and as the same in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEP = 28_800_000
# Readings of this size or more are no plausible values, and the views that other queries build on leave them out: the
# tables hold planted spikes, which p1_found looks for in all rows.
PLAUSIBLE = {"target": 30, "fwd_ret": 0.9, "ret": 0.5}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usable(x: str) -> Column:
    return F.col(x).isNotNull() & ~F.isnan(x)


def clean(x: str) -> Column:
    """NULL for NaN and infinities: in a window one NaN poisons every frame it is in, a NULL is passed over."""
    return F.when(usable(x) & (F.abs(F.col(x)) < F.lit(float("inf"))), F.col(x))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (symbol, 8-hour bar): t, px, fill, qv."""
    d = read(spark, sf_dir, "decision_grid_8h").filter(usable("px_obs"))
    return d.groupBy("symbol", (F.floor(F.col("t_obs") / F.lit(STEP)).cast("bigint") * STEP).alias("t")).agg(F.max("px_obs").alias("px"), F.max(clean("px_fill")).alias("fill"), F.max(clean("qv_window")).alias("qv"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market's bars: t, r_m."""
    return read(spark, sf_dir, "market_index_8h").filter((F.col("index_id") == "IDX_ALL") & usable("r_m")).select(F.col("t_obs").alias("t"), "r_m").distinct()


def betas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last word on each (symbol, t): beta, sigma."""
    d = read(spark, sf_dir, "beta_idiovol_8h").filter(usable("beta") & usable("sigma_eps"))
    return d.groupBy("symbol", F.col("t_obs").alias("t")).agg(F.max(F.struct("t_known", "beta", "sigma_eps")).alias("v")).select("symbol", "t", "v.beta", F.col("v.sigma_eps").alias("sigma"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (symbol, bar) with plausible labels: t, y, fwd_ret, fwd_rm, beta, sigma."""
    d = read(spark, sf_dir, "target_8h_lag60").filter((F.abs("target") < PLAUSIBLE["target"]) & (F.abs("fwd_ret") < PLAUSIBLE["fwd_ret"]))
    v = F.max(F.struct("t_obs", "target", "fwd_ret", "fwd_rm", "beta", "sigma_eps")).alias("v")
    d = d.groupBy("symbol", (F.floor(F.col("t_obs") / F.lit(STEP)).cast("bigint") * STEP).alias("t")).agg(v)
    return d.select("symbol", "t", F.col("v.target").alias("y"), "v.fwd_ret", "v.fwd_rm", "v.beta", F.col("v.sigma_eps").alias("sigma"))


def book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored cross-sections, one row per (t, symbol): score, fwd_ret, fwd_rm, beta, sigma, funding."""
    d = read(spark, sf_dir, "oof_book_inputs").filter(F.col("symbol").isNotNull() & (F.abs("score") < F.lit(float("inf"))))
    v = F.max(F.struct((F.lit(0.0) + F.col("score")).alias("score"), *[F.coalesce(clean(x), F.lit(0.0)).alias(x) for x in ("fwd_ret", "fwd_rm", "beta", "sigma_eps", "funding")])).alias("v")
    d = d.groupBy(F.col("t_obs").alias("t"), "symbol").agg(v)
    return d.select("t", "symbol", "v.score", "v.fwd_ret", "v.fwd_rm", "v.beta", F.col("v.sigma_eps").alias("sigma"), "v.funding")


def tape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly readings as a tape: symbol, t, r; equal rows once, implausible values dropped."""
    return read(spark, sf_dir, "returns_1h").filter(F.abs("ret") < PLAUSIBLE["ret"]).select("symbol", "t", F.col("ret").alias("r")).distinct()


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the perp tape: symbol, t (close time), close and the flows; equal rows once."""
    return read(spark, sf_dir, "perp_klines").filter(usable("close")).select("symbol", F.col("close_time").alias("t"), "open", "high", "low", "close", "volume", "quote_volume", "trade_count", "taker_buy_quote_volume").distinct()


VIEWS = {
    "panel": "select symbol, t_obs // 28800000 * 28800000 as t, max(px_obs) as px, max(case when not isnan(px_fill) and not isinf(px_fill) then px_fill end) as fill, max(case when not isnan(qv_window) and not isinf(qv_window) then qv_window end) as qv from decision_grid_8h where px_obs is not null and not isnan(px_obs) group by all",
    "idx": "select distinct t_obs as t, r_m from market_index_8h where index_id = 'IDX_ALL' and r_m is not null and not isnan(r_m)",
    "betas": "select symbol, t, beta, sigma from (select symbol, t_obs as t, beta, sigma_eps as sigma, row_number() over (partition by symbol, t_obs order by t_known desc, beta desc, sigma_eps desc) as rn from beta_idiovol_8h where beta is not null and not isnan(beta) and sigma_eps is not null and not isnan(sigma_eps)) where rn = 1",
    "labels": "select symbol, t, y, fwd_ret, fwd_rm, beta, sigma from (select symbol, t_obs // 28800000 * 28800000 as t, target as y, fwd_ret, fwd_rm, beta, sigma_eps as sigma, row_number() over (partition by symbol, t_obs // 28800000 order by t_obs desc, target desc, fwd_ret desc) as rn from target_8h_lag60 where abs(target) < " + str(PLAUSIBLE["target"]) + " and abs(fwd_ret) < " + str(PLAUSIBLE["fwd_ret"]) + ") where rn = 1",
    "book": "select t, symbol, score, fwd_ret, fwd_rm, beta, sigma, funding from (select *, row_number() over (partition by t, symbol order by score desc, fwd_ret desc, fwd_rm desc, beta desc, sigma desc, funding desc) as rn from (select t_obs as t, symbol, 0.0 + score as score, coalesce(case when not isnan(fwd_ret) and not isinf(fwd_ret) then fwd_ret end, 0) as fwd_ret, coalesce(case when not isnan(fwd_rm) and not isinf(fwd_rm) then fwd_rm end, 0) as fwd_rm, coalesce(case when not isnan(beta) and not isinf(beta) then beta end, 0) as beta, coalesce(case when not isnan(sigma_eps) and not isinf(sigma_eps) then sigma_eps end, 0) as sigma, coalesce(case when not isnan(funding) and not isinf(funding) then funding end, 0) as funding from oof_book_inputs where symbol is not null and abs(score) < 'infinity'::double)) where rn = 1",
    "tape": "select distinct symbol, t, ret as r from returns_1h where abs(ret) < " + str(PLAUSIBLE["ret"]),
    "bars": "select distinct symbol, close_time as t, open, high, low, close, volume, quote_volume, trade_count, taker_buy_quote_volume from perp_klines where close is not null and not isnan(close)",
}


def sql(body: str, **more: str) -> str:
    """``body`` behind the views it names; ``more`` are further common table expressions."""
    head = {k: v for k, v in VIEWS.items() if any(f" {k}" in x or f"({k}" in x for x in (body, *more.values()))} | more
    return "with " + ",\n".join(f"{k} as ({v})" for k, v in head.items()) + "\n" + body if head else body
