"""Queries for splits, the build chain, the book, screening, features, and manifest handling, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.stats import corr, probabilistic_sharpe
from gridloom.operators import windows as wn
from gridloom.operators.containers import instant_ms, latest_record, period_parts
from gridloom.plans import gates, market, selection, splits
from gridloom.plans.base import PLAUSIBLE, STEP, bars, betas, book, clean, index, labels, panel, read, sql
from gridloom.plans.features import KINDS, Context, Family
from gridloom.plans.panel_queries import RET, bar_returns, r
from gridloom.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None, **more: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE[f.__name__] = sql(text, **more)
        return f

    return add



FEB, MAR = 1_612_137_600_000, 1_614_556_800_000
SCHEME = splits.SplitScheme((splits.Split("train", 0, FEB), splits.Split("holdout1", FEB, MAR), splits.Split("holdout2", MAR, None)))

# ---- splits and folds ---------------------------------------------------------------------------------------------


@query(f"select symbol, t, case when t < {FEB} then 'train' when t < {MAR} then 'holdout1' else 'holdout2' end as split from panel")
def split_assign(spark, sf):
    return panel(spark, sf).select("symbol", "t", SCHEME.assign(F.col("t")).alias("split"))


@query(f"select symbol, t, 'train' as split from panel where t < {FEB} - 432000000 union all select symbol, t, 'holdout1' from panel where t >= {FEB} and t < {MAR} - 432000000 union all select symbol, t, 'holdout2' from panel where t >= {MAR} and t < (select max(t) from panel) - 432000000")
def split_purge(spark, sf):
    p = panel(spark, sf).select("symbol", "t")
    train, first, second = (SCHEME.take(p, name, "t").withColumn("split", F.lit(name)) for name in ("train", "holdout1", "holdout2"))
    return train.unionByName(first).unionByName(second)


_BARS = "select t, row_number() over (order by t) - 1 as n from (select distinct t from panel)"


@query("select f.fold, case when b.n < 120 + f.fold * 30 - 2 then 'train' else 'test' end as role, b.t from b, (select unnest(range(4)) as fold) f where b.n < 120 + f.fold * 30 - 2 or (b.n >= 120 + f.fold * 30 and b.n < 150 + f.fold * 30)", b=_BARS)
def fold_membership(spark, sf):
    return splits.walk_forward(panel(spark, sf), "t", 120, 30, 4, 2)


_PAIRS = "select row_number() over (order by a.x, b.x) - 1 as fit, a.x as a, b.x as b from (select unnest(range(6)) as x) a join (select unnest(range(6)) as x) b on a.x < b.x"


@query("select cast(p.fit as int) as fit, case when g in (p.a, p.b) then 'test' else 'train' end as role, cast(g as int) as grp, t from (select *, case when n < m // 6 then 0 when n < m * 2 // 6 then 1 when n < m * 3 // 6 then 2 when n < m * 4 // 6 then 3 when n < m * 5 // 6 then 4 else 5 end as g from (select *, count(*) over () as m from b)) x, p where g in (p.a, p.b) or not ((n >= m * p.a // 6 - 2 and n < m * (p.a + 1) // 6 + 4) or (n >= m * p.b // 6 - 2 and n < m * (p.b + 1) // 6 + 4))", b=_BARS, p=_PAIRS)
def cpcv_members(spark, sf):
    times = panel(spark, sf).select("t").distinct()
    return splits.combinatorial(times, "t", times.count())


@query("select cast(path as int) as path, cast(grp as int) as grp, cast(fit as int) as fit from (select g as grp, fit, row_number() over (partition by g order by fit) - 1 as path from (select fit, unnest([a, b]) as g from p))", p=_PAIRS)
def cpcv_paths(spark, sf):
    """The stitched paths: which fit tests which group."""
    rows = [(p, g, f) for p, path in enumerate(splits.stitched_paths()) for g, f in path.items()]
    return spark.createDataFrame(rows, "path int, grp int, fit int")


# ---- build chain ----------------------------------------------------------------------------------------------------

_W = "select symbol, t, adv, n_obs, adv / nullif(sum(adv) over (partition by t), 0) as weight from (select symbol, t, case when count(qv) over w >= 10 then avg(qv) over w end as adv, count(qv) over w as n_obs from panel window w as (partition by symbol order by t range between 2591999999 preceding and current row)) where adv is not null"


def weights(spark, sf):
    return market.volume_weights(panel(spark, sf), 30, 10)


@query("select symbol, t, n_obs, round(weight, 8) as weight from wts", wts=_W)
def volume_weights_30d(spark, sf):
    return weights(spark, sf).select("symbol", "t", "n_obs", r("weight", 8).alias("weight"))


@query("select t, round(sum(weight * weight), 8) as hhi, round(1 / sum(weight * weight), 4) as effective_n from wts group by t", wts=_W)
def weight_concentration(spark, sf):
    h = F.sum(F.col("weight") * F.col("weight"))
    return weights(spark, sf).groupBy("t").agg(r(h, 8).alias("hhi"), r(1 / h, 4).alias("effective_n"))


@query("select w.t + 28800000 as t, max(w.t) as t_weight, case when count(x.r) >= 5 then round(sum(w.weight * x.r) / nullif(sum(case when x.r is not null then w.weight end), 0), 8) end as r_m, count(x.r) as n, round(coalesce(sum(case when x.r is not null then w.weight end), 0) / sum(w.weight), 6) as coverage from wts w left join rets x on x.symbol = w.symbol and x.t = w.t + 28800000 group by w.t having coalesce(sum(case when x.r is not null then w.weight end), 0) / sum(w.weight) >= 0.5", wts=_W, rets=RET)
def vw_index_lagged(spark, sf):
    out = market.weighted_index(bar_returns(spark, sf), weights(spark, sf), STEP, 5, 0.5)
    return out.select("t", "t_weight", r("r_m", 8).alias("r_m"), "n", r("coverage").alias("coverage"))


_BETA = "select symbol, t, n, sxy / nullif(sxx, 0) as b, sqrt(greatest((syy - sxy * sxy / nullif(sxx, 0)) / (n - 2), 0)) as se, sqrt(syy / (n - 1)) as st from (select p.symbol, p.t, cast(regr_count(p.r, i.r_m) over w as bigint) as n, regr_sxx(p.r, i.r_m) over w as sxx, regr_syy(p.r, i.r_m) over w as syy, regr_sxy(p.r, i.r_m) over w as sxy from rets p left join idx i using (t) window w as (partition by p.symbol order by p.t rows between 39 preceding and current row)) where n >= 20 and sxx > 0"


@query("select symbol, t, n as n_obs, round(0.7 * b + 0.3 * avg(b) over (partition by t), 5) as beta, round(se, 7) as sigma_eps, round(st, 7) as sigma_total, round(se / nullif(st, 0), 5) as ratio from q", rets=RET, q=_BETA)
def beta_idiovol(spark, sf):
    out = market.beta_idiovol(bar_returns(spark, sf), index(spark, sf), 40, 20, 0.7)
    return out.select("symbol", "t", "n_obs", r("beta", 5).alias("beta"), r("sigma_eps", 7).alias("sigma_eps"), r("sigma_total", 7).alias("sigma_total"), r("ratio", 5).alias("ratio"))


_LEGS = "select l.symbol, l.t, l.fwd_ret, m.fwd_rm from legs l left join (select l.t, sum(w.weight * l.fwd_ret) / nullif(sum(w.weight), 0) as fwd_rm from legs l join wts w using (symbol, t) group by l.t having count(*) >= 5) m using (t)"
_FWD = "select symbol, t, fwd_ret from (select symbol, t, case when lead(t) over w - t = 28800000 then lead(fill) over w / nullif(fill, 0) - 1 end as fwd_ret from panel window w as (partition by symbol order by t)) where fwd_ret is not null"


@query("select symbol, t, round(fwd_ret, 8) as fwd_ret, round(fwd_rm, 8) as fwd_rm from both_legs", wts=_W, legs=_FWD, both_legs=_LEGS)
def forward_legs(spark, sf):
    out = market.forward_legs(panel(spark, sf), weights(spark, sf), STEP, 5)
    return out.select("symbol", "t", r("fwd_ret", 8).alias("fwd_ret"), r("fwd_rm", 8).alias("fwd_rm"))


@query("select symbol, t, round((fwd_ret - beta * fwd_rm) / nullif(sigma, 0), 6) as target from both_legs join betas using (symbol, t) where fwd_rm is not null", wts=_W, legs=_FWD, both_legs=_LEGS)
def target_assembly(spark, sf):
    legs = market.forward_legs(panel(spark, sf), weights(spark, sf), STEP, 5)
    return market.target(legs, betas(spark, sf)).select("symbol", "t", r("target").alias("target"))


@query("select count(*) as n, round(max(abs(y - (fwd_ret - beta * fwd_rm) / sigma)), 3) as max_diff, round(median(abs(y - (fwd_ret - beta * fwd_rm) / sigma)), 5) as mid_diff from labels where sigma > 0")
def target_identity(spark, sf):
    d = F.abs(F.col("y") - (F.col("fwd_ret") - F.col("beta") * F.col("fwd_rm")) / F.col("sigma"))
    return labels(spark, sf).filter("sigma > 0").agg(F.count(F.lit(1)).alias("n"), r(F.max(d), 3).alias("max_diff"), r(F.median(d), 5).alias("mid_diff"))


# ---- book -------------------------------------------------------------------------------------------------------------

_BOOKW = """select t, symbol, fwd_ret, fwd_rm, funding, x / nullif(sum(abs(x)) over (partition by t), 0) as w from (
  select *, d - avg(d) over (partition by t) as x from (
    select *, (p - avg(p) over (partition by t)) / nullif(sigma, 0) as d from (
      select *, (rank() over (partition by t order by score) + (count(*) over (partition by t, score) - 1) / 2.0) / count(*) over (partition by t) as p, count(*) over (partition by t) as n from book) where n >= 8))"""
_SERIES = "select t, sum(w * fwd_ret) as gross, sum(w * funding) as fund, avg(fwd_rm) as r_m from bw group by t"
_HEDGED = "select *, case when row_number() over (order by t) > 60 then covar_samp(gross - fund, r_m) over (order by t rows between 40 preceding and 1 preceding) / nullif(var_pop(r_m) over (order by t rows between 40 preceding and 1 preceding), 0) end as hedge from series"
CFG = market.BookConfig(hedge_rows=40, hedge_warm=60)


@query("select t, symbol, round(w, 8) as w from bw", bw=_BOOKW)
def book_weights(spark, sf):
    return market.book_weights(book(spark, sf), CFG).select("t", "symbol", r("w", 8).alias("w"))


@query("select t, round(gross, 8) as gross, round(fund, 8) as funding, round(hedge, 5) as hedge, round(gross - fund - coalesce(hedge, 0) * r_m, 7) as ret from hedged", bw=_BOOKW, series=_SERIES, hedged=_HEDGED)
def book_returns(spark, sf):
    s = market.book_returns(market.book_weights(book(spark, sf), CFG), CFG)
    return s.select("t", r("gross", 8).alias("gross"), r("funding", 8).alias("funding"), r("hedge", 5).alias("hedge"), r("ret", 7).alias("ret"))


@query(
    "select count(ret) as bars, round(pow(1 + avg(ret), 1095) - 1, 4) as ann_return, round(stddev_samp(ret) * sqrt(1095), 5) as vol, round(avg(ret) / stddev_samp(ret) * sqrt(1095), 4) as sharpe, round(avg(case when ret > 0 then 1.0 else 0.0 end), 6) as hit, round(min(dd), 6) as max_drawdown from (select ret, e / greatest(max(e) over (order by t), 1.0) - 1 as dd from (select t, ret, exp(sum(ln(1 + ret)) over (order by t)) as e from (select t, gross - fund as ret from series)))",
    bw=_BOOKW, series=_SERIES,
)
def book_metrics(spark, sf):
    cfg = market.BookConfig(hedge_warm=1_000_000)
    m = market.metrics(market.book_returns(market.book_weights(book(spark, sf), cfg), cfg))
    return m.select("bars", r("ann_return", 4).alias("ann_return"), r("vol", 5).alias("vol"), r("sharpe", 4).alias("sharpe"), r("hit").alias("hit"), r("max_drawdown").alias("max_drawdown"))


@query("select round(max(abs(net)), 9) as max_net, round(max(abs(gross - 1)), 9) as max_gross_error, count(*) as bars from (select t, sum(w) as net, sum(abs(w)) as gross from bw group by t having sum(abs(w)) > 0)", bw=_BOOKW)
def book_invariants(spark, sf):
    s = market.book_weights(book(spark, sf), CFG).groupBy("t").agg(F.sum("w").alias("net"), F.sum(F.abs("w")).alias("gross")).filter("gross > 0")
    return s.agg(r(F.max(F.abs("net")), 9).alias("max_net"), r(F.max(F.abs(F.col("gross") - 1)), 9).alias("max_gross_error"), F.count(F.lit(1)).alias("bars"))


@query("select strftime(make_timestamp(t * 1000), '%Y-%m') as month, round(exp(sum(ln(1 + gross - fund))) - 1, 7) as ret, count(*) as bars from series group by all", bw=_BOOKW, series=_SERIES)
def monthly_compound(spark, sf):
    cfg = market.BookConfig(hedge_warm=1_000_000)
    s = market.book_returns(market.book_weights(book(spark, sf), cfg), cfg)
    return s.groupBy(F.date_format(F.timestamp_millis("t"), "yyyy-MM").alias("month")).agg(r(F.expm1(F.sum(F.log1p("ret"))), 7).alias("ret"), F.count(F.lit(1)).alias("bars"))


@query(None)
def sharpe_probability(spark, sf):
    """Probabilistic Sharpe ratio of the book from one row of moments."""
    cfg = market.BookConfig(hedge_warm=1_000_000)
    s = market.book_returns(market.book_weights(book(spark, sf), cfg), cfg)
    n, m, sd, sk, ku = s.agg(F.count("ret"), F.avg("ret"), F.stddev_samp("ret"), F.skewness("ret"), F.kurtosis("ret") + 3).first()
    psr = probabilistic_sharpe(m / sd, 0.0, n, sk, ku) if n and sd else float("nan")
    return spark.createDataFrame([(n, psr)], "bars bigint, psr double")


@query("select case when disp <= q1 then 0 when disp <= q2 then 1 else 2 end as tercile, count(*) as bars, round(avg(ic), 6) as ic from (select i.t, i.ic, d.disp, quantile_cont(d.disp, 1/3) over () as q1, quantile_cont(d.disp, 2/3) over () as q2 from i join d using (t)) group by all", ranks="select *, rank() over (partition by t order by score) + (count(*) over (partition by t, score) - 1) / 2.0 as ra, rank() over (partition by t order by fwd_ret) + (count(*) over (partition by t, fwd_ret) - 1) / 2.0 as rb from book", i="select t, case when not isnan(corr(ra, rb)) then corr(ra, rb) end as ic from ranks group by t having count(*) >= 8", d="select t, stddev_samp(fwd_ret) as disp from book group by t having count(*) >= 8")
def ic_by_dispersion(spark, sf):
    from gridloom.operators import xsec as xs

    b = book(spark, sf)
    d = b.groupBy("t").agg(F.stddev_samp("fwd_ret").alias("disp"), F.count(F.lit(1)).alias("m")).filter("m >= 8")
    j = xs.bar_ic(b, "score", "fwd_ret", ["t"], 8).join(d, "t")
    q = j.agg(F.percentile("disp", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    j = j.crossJoin(F.broadcast(q)).withColumn("tercile", F.when(F.col("disp") <= F.col("q")[0], 0).when(F.col("disp") <= F.col("q")[1], 1).otherwise(2))
    return j.groupBy("tercile").agg(F.count(F.lit(1)).alias("bars"), r(F.avg("ic")).alias("ic"))


@query("select bucket, count(*) as n, round(avg(fwd_ret), 8) as mean from (select fwd_ret, case when n > 1 then cast(greatest(ceil((k - 1) * 5 / (n - 1)) - 1, 0) as int) else 0 end as bucket from (select *, row_number() over (partition by t order by score, symbol) as k, count(*) over (partition by t) as n from book) where n >= 8) group by bucket")
def quintile_profile(spark, sf):
    from gridloom.operators import xsec as xs

    b = xs.counted_ordinals(book(spark, sf).select("t", "symbol", "score", "fwd_ret"), "score", ["t"], ["symbol"]).filter("score_n >= 8")
    b = b.withColumn("bucket", xs.quantile_of(F.col("score_down"), F.col("score_n"), 5))
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), r(F.avg("fwd_ret"), 8).alias("mean"))


@query("select case when r_m < 0 then 'down' else 'up' end as side, count(*) as n, round(regr_slope(r, r_m), 5) as beta, round(corr(r, r_m), 5) as rho from rets join idx using (t) where r is not null group by all", rets=RET)
def semi_beta(spark, sf):
    x = bar_returns(spark, sf).join(index(spark, sf), "t").filter("r is not null")
    return x.groupBy(F.when(F.col("r_m") < 0, "down").otherwise("up").alias("side")).agg(F.count(F.lit(1)).alias("n"), r(F.regr_slope("r", "r_m"), 5).alias("beta"), r(corr("r", "r_m"), 5).alias("rho"))


@query("select pos, count(*) as n, round(avg(case when pos * fwd_ret > 0 then 1.0 else 0.0 end), 6) as hit, round(avg(pos * fwd_ret), 8) as mean from (select symbol, t, fwd_ret, case when trend > 0 then 1 when trend < 0 then -1 else 0 end as pos from (select symbol, t, fwd_ret, case when count(fwd_ret) over w >= 5 then avg(fwd_ret) over w end as trend from labels window w as (partition by symbol order by t rows between 21 preceding and 1 preceding)) where trend is not null) group by pos")
def momentum_rule(spark, sf):
    w = W.partitionBy("symbol").orderBy("t").rowsBetween(-21, -1)
    x = labels(spark, sf).withColumn("trend", wn.rolling("mean", "fwd_ret", w, 5)).filter("trend is not null").withColumn("pos", F.signum("trend").cast("int"))
    gain = F.col("pos") * F.col("fwd_ret")
    return x.groupBy("pos").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.when(gain > 0, 1.0).otherwise(0.0))).alias("hit"), r(F.avg(gain), 8).alias("mean"))


# ---- screening ----------------------------------------------------------------------------------------------------------

_FEATS = ["y", "fwd_ret", "beta", "sigma"]


@query("select a, b, round(rho, 5) as rho, n from (" + " union all ".join(f"select '{a}' as a, '{b}' as b, corr(r_{a}, r_{b}) as rho, count(*) as n from ranks" for i, a in enumerate(_FEATS) for b in _FEATS[i + 1 :]) + ") where n >= 500", ranks="select " + ", ".join(f"(rank() over (partition by t order by {f}) + (count(*) over (partition by t, {f}) - 1) / 2.0) / count(*) over (partition by t) - 0.5 as r_{f}" for f in _FEATS) + " from labels where sigma is not null and beta is not null")
def corr_matrix(spark, sf):
    x = labels(spark, sf).filter("sigma is not null and beta is not null")
    return selection.pair_correlations(x, _FEATS, ["t"]).select("a", "b", r("rho", 5).alias("rho"), "n")


@query(None)
def redundancy_r2(spark, sf):
    """Share of each column explained by the others, from one Gram aggregate."""
    x = labels(spark, sf).select(*_FEATS)
    r2 = selection.r_squared(selection.covariance(*selection.gram(x, _FEATS)))
    return spark.createDataFrame([(f, round(float(v), 6)) for f, v in zip(_FEATS, r2)], "feature string, r2 double")


@query(
    "select symbol, t, round(rb * ((ss + 10) * b_y - bs * s_y) / det + rs * ((bb + 10) * s_y - bs * b_y) / det, 8) as score from x, (select *, (bb + 10) * (ss + 10) - bs * bs as det from (select sum(rb * rb) as bb, sum(rs * rs) as ss, sum(rb * rs) as bs, sum(rb * y) as b_y, sum(rs * y) as s_y from x where y is not null))",
    x="select symbol, t, y, coalesce(case when beta is not null then (rank() over (partition by t, beta is not null order by beta) + (count(*) over (partition by t, beta) - 1) / 2.0) / count(beta) over (partition by t) end - 0.5, 0) as rb, coalesce(case when sigma is not null then (rank() over (partition by t, sigma is not null order by sigma) + (count(*) over (partition by t, sigma) - 1) / 2.0) / count(sigma) over (partition by t) end - 0.5, 0) as rs from labels",
)
def ridge_scores(spark, sf):
    """Ridge on centred ranks of the estimates known at the bar, scored back on the panel."""
    x = selection.centred_ranks(labels(spark, sf), ["beta", "sigma"], ["t"])
    beta = selection.ridge_fit(x, ["r_beta", "r_sigma"], "y", 10.0)
    return selection.ridge_score(x, ["r_beta", "r_sigma"], beta).select("symbol", "t", r("score", 8).alias("score"))


@query("select t, round(rho, 6) as rho, n from (select a.t, case when not isnan(corr(a.p, b.p)) then corr(a.p, b.p) end as rho, count(*) as n from p a join p b on a.symbol = b.symbol and a.t = b.t + 259200000 group by a.t) where n > 3", p="select symbol, t, (rank() over (partition by t order by beta) + (count(*) over (partition by t, beta) - 1) / 2.0) / count(*) over (partition by t) as p from betas")
def feature_persistence(spark, sf):
    return selection.persistence(betas(spark, sf), "beta", "symbol", "t", STEP, 9).filter("n > 3").select("t", r("rho").alias("rho"), "n")


@query("select symbol, round(rho, 5) as autocorr, round(noise, 5) as noise from (select symbol, case when not isnan(corr(beta, l)) then corr(beta, l) end as rho, stddev_samp(d) / sqrt(6) / nullif(stddev_samp(beta), 0) as noise, count(*) as n from (select symbol, beta, lag(beta) over w as l, beta - 2 * lag(beta) over w + lag(beta, 2) over w as d from betas window w as (partition by symbol order by t)) group by symbol) where n >= 10")
def estimation_noise(spark, sf):
    b = betas(spark, sf)
    many = b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter("n >= 10").select("symbol")
    return selection.estimation_noise(b, "beta", "symbol", "t").join(many, "symbol").select("symbol", r("autocorr", 5).alias("autocorr"), r("noise", 5).alias("noise"))


@query("select f as feature, round(cov, 6) as coverage, cast(bad as bigint) as not_finite, d as \"distinct\", round(v, 6) as bars_varying from (" + " union all ".join(f"select '{f}' as f, avg(case when {f} is not null then 1.0 else 0.0 end) as cov, count(case when isnan({f}) or isinf({f}) then 1 end) as bad, count(distinct {f}) as d, (select avg(case when h > l then 1.0 when h <= l then 0.0 end) from (select max({f}) as h, min({f}) as l from labels group by t)) as v from labels" for f in ("y", "beta", "sigma")) + ")")
def stage0_coverage(spark, sf):
    out = selection.coverage_report(labels(spark, sf), ["y", "beta", "sigma"], "t")
    return out.select("feature", r("coverage").alias("coverage"), "not_finite", "distinct", r("bars_varying").alias("bars_varying"))


@query("select symbol, t from labels where t in (select t from (select t, row_number() over (order by t) as n from (select distinct t from labels)) where (n - 1) % 7 = 0)")
def sample_every_seventh(spark, sf):
    return selection.sampled_instants(labels(spark, sf), "t", 7).select("symbol", "t")


@query(None)
def seeded_sample(spark, sf):
    return selection.seeded_sample(labels(spark, sf).select("symbol", "t", "y"), ["symbol", "t"], 100, 11)


@query("select count(*) - count(distinct (symbol, t)) as repeats, round(avg(case when beta is not null then 1.0 else 0.0 end), 6) as beta_coverage, min(t) as first, max(t) as last from labels")
def gate_values(spark, sf):
    """Values of a table's gates, from one aggregate."""
    g = [gates.unique_key(["symbol", "t"]), gates.coverage("beta", 0.9)]
    return labels(spark, sf).agg(g[0].value.alias("repeats"), r(g[1].value).alias("beta_coverage"), F.min("t").alias("first"), F.max("t").alias("last"))


# ---- sources and manifest ------------------------------------------------------------------------------------------------


@query("select key, dataset, status, \"rows\" from (select *, row_number() over (partition by key order by cast(replace(trim(updated_at), 'T', ' ') as timestamptz) desc nulls last, dataset desc, status desc, \"rows\" desc nulls last) as rn from files where key is not null) where rn = 1")
def manifest_latest(spark, sf):
    return latest_record(read(spark, sf, "files"), "key", instant_ms(F.col("updated_at")), ["dataset", "status", "rows"])


@query("select dataset, status, count(*) as files, cast(coalesce(sum(\"rows\"), 0) as bigint) as \"rows\" from files group by all")
def manifest_summary(spark, sf):
    return store.summary(read(spark, sf, "files"))


@query(
    "select key from (select *, max(case when d = '' then m end) over (partition by dataset, symbol) as last from (select distinct key, dataset, symbol, m, d from spelled where m <> '')) x where (d = '' or last is null or m > last) and m >= '202101' and not exists (select 1 from files f where f.status = 'converted' and f.key = x.key)",
    spelled="select key, dataset, symbol, case when regexp_matches(p, '^\\d{6}(\\d{2})?$') then substr(p, 1, 6) when regexp_matches(p, '^\\d{4}[-/_. ]\\d{1,2}([-/_. ]\\d{1,2})?$') then substr(p, 1, 4) || lpad(regexp_extract(p, '^\\d{4}.(\\d{1,2})', 1), 2, '0') else '' end as m, case when regexp_matches(p, '^\\d{8}$') then substr(p, 7, 2) else regexp_extract(p, '^\\d{4}[-/_. ]\\d{1,2}[-/_. ](\\d{1,2})$', 1) end as d from (select *, trim(period) as p from files where period is not null)",
)
def manifest_plan(spark, sf):
    log = read(spark, sf, "files")
    month, day = period_parts(F.col("period"))
    f = log.select("key", "dataset", "symbol", month.alias("month"), day.alias("day")).filter("month is not null")
    period = F.concat_ws("-", F.substring("month", 1, 4), F.substring("month", 5, 2), F.when(F.col("day") != "", F.col("day")))
    wanted = f.select("key", "dataset", "symbol", period.alias("period"), F.when(F.col("day") != "", "daily").otherwise("monthly").alias("granularity")).distinct()
    return store.plan_downloads(wanted, store.done_keys(log), "2021-01").select("key")


@query("select symbol, close_time, open_time, close from (select *, row_number() over (partition by symbol, close_time order by open_time desc, close desc) as rn from perp_klines where close is not null and not isnan(close)) where rn = 1")
def dedup_keep_last(spark, sf):
    d = read(spark, sf, "perp_klines").filter("close is not null and not isnan(close)").select("symbol", "close_time", "open_time", "close")
    return store.keep_last(d, ["symbol", "close_time"], ["open_time", "close"])


@query("select symbol, max(close_time) as last from perp_klines group by symbol")
def last_timestamp(spark, sf):
    return store.last_instant(read(spark, sf, "perp_klines"), ["symbol"], "close_time")


@query(f"select symbol, close_time from perp_klines where close_time >= {FEB} and close_time < {MAR}")
def period_scan(spark, sf):
    return read(spark, sf, "perp_klines").filter((F.col("close_time") >= FEB) & (F.col("close_time") < MAR)).select("symbol", "close_time")


# ---- features ----------------------------------------------------------------------------------------------------------------


LEADS = ("KORUSDX", "VELUSDX")
CONTRACTS = (("C_210201", 1_612_137_600_000), ("C_210326", 1_616_716_800_000), ("C_210625", 1_624_579_200_000))
SECTOR = 8


def feature_context(spark: SparkSession, sf: str) -> Context:
    """The test tables as a feature context. They hold no second venue, premium, open interest or dated contracts, for which
    stand: for spot the bars in which buyers took less than 60 %, 17 seconds later and at their open prices, with flows of their own; for the
    premium the open-to-close move; for open interest the volumes; for contracts three of the lead symbol's, one expired early.
    Sectors are runs of eight symbols by name."""
    t = bars(spark, sf).select("symbol", "t", *[clean(c).alias(c) for c in ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_quote_volume")], "trade_count")
    t = t.groupBy("symbol", "t").agg(*[F.max(c).alias(c) for c in t.columns if c not in ("symbol", "t")])
    spot = t.filter("taker_buy_quote_volume < 0.6 * quote_volume and open is not null").select(
        "symbol", (F.col("t") + 17_000).alias("t"), "open", "high", "low", F.col("open").alias("close"), "volume", (F.col("volume") * F.col("open")).alias("quote_volume"), (2 * F.col("trade_count") + 1).alias("trade_count"), (0.5 * F.col("taker_buy_quote_volume")).alias("taker_buy_quote_volume")
    )
    move = F.try_divide(F.col("close"), F.col("open")) - 1
    hours = read(spark, sf, "returns_1h").filter((F.abs("ret") < PLAUSIBLE["ret"]) & F.col("symbol").isNotNull()).groupBy("symbol", "t").agg(F.max("ret").alias("r"), F.max(clean("r_m")).alias("r_m"))
    p = panel(spark, sf)
    sectors = p.select("symbol").distinct().withColumn("g", F.floor((F.row_number().over(W.orderBy("symbol")) - 1) / F.lit(SECTOR)))
    quotes = t.filter(F.col("symbol") == LEADS[0]).crossJoin(F.broadcast(spark.createDataFrame(CONTRACTS, "contract string, expiry bigint")))  # three rows to each
    delivery = quotes.filter(F.col("t") + 5_000 < F.col("expiry")).select("contract", (F.col("t") + 5_000).alias("t"), "expiry", (F.col("close") * (1 + (F.col("expiry") - F.col("t")) / F.lit(1e11))).alias("px"))
    return Context({
        "panel": p, "index": index(spark, sf), "betas": betas(spark, sf), "tape": t, "hourly": hours, "sectors": sectors, "delivery": delivery, "weights": weights(spark, sf).select("symbol", "t", "weight"),
        "spot": spot, "premium": t.select("symbol", "t", move.alias("close"), F.greatest(move, F.lit(0.0)).alias("high"), F.least(move, F.lit(0.0)).alias("low")),
        "funding": book(spark, sf).select("symbol", "t", F.col("funding").alias("rate")), "oi": t.select("symbol", "t", F.col("volume").alias("oi"), F.col("quote_volume").alias("oi_value")),
    }, lead=LEADS)


_GRID = "select symbol, unnest(generate_series(min(t), max(t), 28800000)) as t from panel group by symbol"
_DENSE = f"select g.symbol, g.t, p.px, p.qv, b.beta, b.sigma, i.r_m from ({_GRID}) g left join panel p using (symbol, t) left join betas b using (symbol, t) left join idx i using (t)"
_E8 = "select *, (rr - beta * r_m) / nullif(sigma, 0) as e8 from (select *, px / nullif(lag(px) over (partition by symbol order by t), 0) - 1 as rr from dense)"
_BAR = "cast(ceil(t / 28800000.0) as bigint) * 28800000"
_FTAPE = "select symbol, t, " + ", ".join(f"max(case when not isnan({c}) and not isinf({c}) then {c} end) as {n}" for c, n in (("open", "open"), ("high", "high"), ("low", "low"), ("close", "close"), ("volume", "volume"), ("quote_volume", "quote_volume"), ("taker_buy_quote_volume", "tb"))) + ", max(trade_count) as trade_count from bars group by symbol, t"
_SPOT = "select symbol, t + 17000 as t, open as close, volume * open as quote_volume, 0.5 * tb as tb, 2 * trade_count + 1 as trade_count from ftape where tb < 0.6 * quote_volume and open is not null"
_PREM = "select symbol, t, m as close, greatest(m, 0) as high, least(m, 0) as low from (select symbol, t, close / nullif(open, 0) - 1 as m from ftape)"
_TRET = "select *, lag(ret) over (partition by symbol order by t) as ret1, " + _BAR + " as bar from (select *, close / nullif(lag(close) over (partition by symbol order by t), 0) - 1 as ret from ftape)"
_HOURS = "select symbol, t, max(ret) as r, max(case when not isnan(r_m) and not isinf(r_m) then r_m end) as r_m from returns_1h where abs(ret) < " + str(PLAUSIBLE["ret"]) + " and symbol is not null group by symbol, t"
_FIRST = "row_number() over (partition by symbol order by t)"


def feature_sql(least: float) -> dict[str, str]:
    """SQL of the families, from their definitions: plain windows over whole rows. ``least`` scales the least counts."""

    def m(n: int) -> int:
        return max(2, round(n * least))

    def win(n: int, by: str = "symbol", t: str = "t") -> str:
        return f"over (partition by {by} order by {t} rows between {n - 1} preceding and current row)"

    def roll(fn: str, n: int, k: int, x: str, by: str = "symbol") -> str:
        return f"case when count({x}) {win(n, by)} >= {k} then {fn}({x}) {win(n, by)} end"

    def z30(x: str) -> str:
        return f"({x} - ({roll('avg', 90, m(54), x)})) / nullif({roll('stddev_samp', 90, m(54), x)}, 0)"

    def wcorr(x: str, y: str, n: int, k: int, by: str = "symbol") -> str:
        c = f"corr({x}, {y}) {win(n, by)}"
        return f"case when count(case when {x} is not null and {y} is not null then 1 end) {win(n, by)} >= {k} and not isnan({c}) then {c} end"

    def slope(y: str, x: str, n: int, k: int) -> str:
        return f"case when regr_count({y}, {x}) {win(n)} >= {k} then regr_sxy({y}, {x}) {win(n)} / nullif(regr_sxx({y}, {x}) {win(n)}, 0) end"

    def ranged(tape: str) -> str:
        return f"select symbol, t, {roll('max', 480, m(120), 'high')} as hi, {roll('min', 480, m(120), 'low')} as lo from {tape}"

    def asof(view: str, name: str, at: str = "d.t") -> str:
        return f" asof left join {view} {name} on {name}.symbol = d.symbol and {at} >= {name}.t"

    def final(body: str, **columns: str) -> str:
        picked = ", ".join(f"round({v}, {DIGITS.get(k, 6)}) as {k}" for k, v in columns.items())
        return f"select x.* from (select symbol, t, {picked} from {body}) x join panel p on p.symbol = x.symbol and p.t = x.t"

    w = "window w as (partition by symbol order by t)"
    out: dict[str, str] = {}
    out["A"] = sql(
        final(
            "(select d.symbol, d.t, case when d.t - f.t <= 32400000 then f.z end as z, case when d.t - f.t <= 32400000 then f.cum end as cum, case when d.t - f.t <= 32400000 then f.run end as run, d.rz from (select symbol, t, " + z30("r") + f" as rz from (select g.symbol, g.t, px / nullif(lag(px) over (partition by g.symbol order by g.t), 0) - 1 as r from ({_GRID}) g left join panel using (symbol, t))) d" + asof("fund", "f") + ")",
            funding_z="z", funding_cum_7d="cum", funding_sign_persist="run::double", crowd_winning="z * rz",
        ),
        fund0="select symbol, t, funding as rate, sign(funding) as s, case when sign(funding) is not distinct from lag(sign(funding)) over (partition by symbol order by t) then 0 else 1 end as fresh from book",
        fund1="select *, sum(fresh) over (partition by symbol order by t) as grp from fund0",
        fund="select symbol, t, cast(row_number() over (partition by symbol, grp order by t) * s as bigint) as run, " + z30("rate") + " as z, " + roll("sum", 21, m(12), "rate") + " as cum from fund1",
    )
    out["B"] = sql(
        final(f"(select *, lag(oi, 3) over w as oi3, lag(oi) over w as oi1 from bp {w})", oi_velocity_24h="oi / nullif(oi3, 0) - 1", oi_price_corr="c", oi_per_trade="(oi - oi1) / nullif(trades, 0)", turnover="qv / nullif(oiv, 0)"),
        ftape=_FTAPE, hours=_HOURS,
        bo="select symbol, t, volume as oi, quote_volume as oiv from ftape",
        bh="select symbol, t, " + wcorr("doi", "r", 720, m(432)) + " as c from (select *, oi / nullif(lag(oi) over (partition by symbol order by t), 0) - 1 as doi from (select d.symbol, d.t, d.r, case when d.t - o.t <= 7200000 then o.oi end as oi from hours d" + asof("bo", "o") + "))",
        bp=f"select d.symbol, d.t, d.qv, case when d.t - o.t <= 7200000 then o.oi end as oi, case when d.t - o.t <= 7200000 then o.oiv end as oiv, n.trades, case when d.t - h.t <= 7200000 then h.c end as c from (select g.symbol, g.t, p.qv from ({_GRID}) g left join panel p using (symbol, t)) d left join (select symbol, {_BAR} as t, sum(trade_count) as trades from ftape group by all) n using (symbol, t)" + asof("bo", "o") + asof("bh", "h"),
    )
    k = "0.1715728752538097"
    out["C"] = sql(
        final(
            "cz", zero_return_minutes="zero::double", roll_spread="case when w_n1 > 1 then case when cov < 0 then 2 * sqrt(abs(cov)) when cov >= 0 then 0 end end", kyle_lambda=f"case when n >= {m(30)} then cs / nullif(vs, 0) end",
            vpin_perp_z=z30("vpin"), corwin_schultz=roll("avg", 90, m(54), "cs1"), premium_reversion_speed=f"case when w_qn >= {m(30)} then (w_qn * w_qxy - w_qx * w_qy) / nullif(w_qn * w_qxx - w_qx * w_qx, 0) end",
        ),
        ftape=_FTAPE, prem=_PREM, tret=_TRET.replace("select *, close", "select *, 2 * tb - quote_volume as signed, close"), ext=ranged("ftape"),
        cb="select symbol, bar as t, count(case when ret = 0 then 1 end) as zero, sum(case when ret1 is not null then ret end) as sx, sum(case when ret is not null then ret1 end) as sy, sum(ret * ret1) as sxy, count(ret * ret1) as n1, count(ret * signed) as n, var_pop(case when ret is not null then signed end) as vs, covar_pop(ret, signed) as cs, sum(signed) as net, sum(quote_volume) as qs from tret group by symbol, bar",
        cq=f"select symbol, {_BAR} as t, sum(case when p is not null then p1 end) as qx, sum(case when p1 is not null then p end) as qy, sum(p * p1) as qxy, sum(case when p is not null then p1 * p1 end) as qxx, count(p * p1) as qn from (select symbol, t, close as p, lag(close) over (partition by symbol order by t) as p1 from prem) group by all",
        cd=f"select d.symbol, d.t, b.* exclude (symbol, t), q.* exclude (symbol, t), e.hi, e.lo from ({_GRID}) d left join cb b using (symbol, t) left join cq q using (symbol, t)" + asof("ext", "e"),
        cw="select *, " + ", ".join(f"sum({c}) over w3 as w_{c}" for c in ("sx", "sy", "sxy", "n1", "qx", "qy", "qxy", "qxx", "qn")) + ", abs(net) / nullif(qs, 0) as vpin, lag(hi) over w as hi1, lag(lo) over w as lo1 from cd window w3 as (partition by symbol order by t rows between 2 preceding and current row), w as (partition by symbol order by t)",
        cz=f"select *, (w_sxy - w_sx * w_sy / nullif(w_n1, 0)) / nullif(w_n1 - 1, 0) as cov, case when b2 is not null and g2 is not null then greatest(2 * (exp(a) - 1) / (1 + exp(a)), 0) end as cs1 from (select *, (sqrt(2 * b2) - sqrt(b2)) / {k} - sqrt(g2 / {k}) as a from (select *, pow(ln(hi / nullif(lo, 0)), 2) + pow(ln(hi1 / nullif(lo1, 0)), 2) as b2, pow(ln(greatest(hi, hi1) / nullif(least(lo, lo1), 0)), 2) as g2 from cw))",
    )
    ok = lambda x: f"case when n >= {m(60)} then {x} end"
    out["D"] = sql(
        final(
            "(select *, " + roll("avg", 90, m(54), "lt") + " as lt30, " + roll("avg", 90, m(54), "lv") + " as lv30 from fd)",
            retail_attention_div=ok("(lt - lt30) - (lv - lv30)"), volume_concentration=ok("vol2 / nullif(vol * vol, 0)"), close_vs_vwap=ok("p8 / nullif(pv / nullif(vol, 0), 0) - 1"),
            move_timing=ok("(p1 / nullif(p0, 0) - p8 / nullif(p7, 0)) / nullif(sabs, 0)"), realized_skew=ok("sqrt(n) * s3 / nullif(pow(s2, 1.5), 0)"), realized_kurt=ok("n * s4 / nullif(s2 * s2, 0)"),
            parkinson_ratio=ok("sqrt(coalesce(hl2, 0) / (2.772588722239781 * n)) / nullif(sqrt(s2 / n), 0)"), volume_return_coupling=ok(f"case when nc >= {m(30)} then cq / nullif(sq, 0) end"),
        ),
        ftape=_FTAPE, tret=_TRET,
        fpath="select symbol, bar as t, count(ret) as n, sum(trade_count) as trades, sum(quote_volume) as vol, sum(quote_volume * quote_volume) as vol2, sum(close * quote_volume) as pv, sum(ret * ret) as s2, sum(ret * ret * ret) as s3, sum(ret * ret * ret * ret) as s4, sum(abs(ret)) as sabs, sum(pow(ln(high / nullif(low, 0)), 2)) as hl2, count(ret * quote_volume) as nc, covar_pop(abs(ret), quote_volume) as cq, stddev_pop(case when quote_volume is not null then abs(ret) end) * stddev_pop(case when ret is not null then quote_volume end) as sq from tret group by symbol, bar",
        fd=f"select d.symbol, d.t, f.* exclude (symbol, t), a.close as p0, b.close as p1, c.close as p7, e.close as p8, case when trades > 0 then ln(trades) end as lt, case when vol > 0 then ln(vol) end as lv from (select *, t - 28800000 as ta, t - 25200000 as tb, t - 3600000 as tc from ({_GRID})) d left join fpath f using (symbol, t)" + asof("ftape", "a", "d.ta") + asof("ftape", "b", "d.tb") + asof("ftape", "c", "d.tc") + asof("ftape", "e"),
    )
    out["E"] = sql(
        final(
            "(select *, v9 / nullif(9 * v1, 0) as vr, lag(beta, 90) over w as beta90, lag(sigma, 90) over w as sigma90, lag(share, 3) over w as share3 from (select *, " + roll("var_samp", 270, m(162), "raw9") + " as v9, " + roll("var_samp", 270, m(162), "raw") + " as v1, " + roll("stddev_samp", 90, m(54), "beta") + " as bi, " + roll("max", 90, m(54), "px") + " as peak, l - (" + roll("avg", 30, m(15), "l", "symbol, h") + f") as rel from (select *, {roll('sum', 9, 9, 'raw')} as raw9 from (select *, e8 * sigma as raw, case when qv > 0 then ln(qv) end as l, t // 3600000 % 24 as h, qv / nullif(sum(qv) over (partition by t), 0) as share from e8))) {w})",
            resid_reversal_8h="-e8", variance_ratio_72h="vr", reversal_x_vr="-e8 * (1 - vr)", beta_momentum="beta - beta90", beta_instability="bi", idio_vol_momentum="sigma / nullif(sigma90, 0) - 1", drawdown_from_peak="px / nullif(peak, 0) - 1", volume_share_rotation="share - share3", session_rel_volume="rel",
        ),
        dense=_DENSE, e8=_E8,
    )
    hs = (3, 9, 21)
    peer = lambda x: f"{x} - case when count({x}) over (partition by t, g) >= 2 then (sum({x}) over (partition by t, g) - {x}) / (count({x}) over (partition by t, g) - 1) end"
    out["F"] = sql(
        final(
            "ff", sector_rel_reversal_8h="-rel1", sector_rel_agreement="-(rel1 + rel3 + rel9 + rel21) / 4", coin_sector_corr="csc", btc_resid_lag="bl", corr_btc_8h_90d="cb", sector_cohesion="coh", sector_dispersion="sd", sector_belonging="bel", eth_resid_lag="el", sector_decoupling="dec", dispersion_contribution="dev / nullif(tot, 0)",
        ),
        dense=_DENSE, e8=_E8, wts=_W, hours=_HOURS,
        sect=f"select symbol, (row_number() over (order by symbol) - 1) // {SECTOR} as g from (select distinct symbol from panel)",
        fl="select e.*, s.g, e8 as x1, lag(e8) over w as l8, " + ", ".join(f"px / nullif(lag(px, {h}) over w, 0) - 1 as r{h}, lag(weight, {h}) over w as w{h}" for h in hs) + " from e8 e left join sect s using (symbol) left join wts using (symbol, t) window w as (partition by e.symbol order by e.t)",
        fm="select t, " + ", ".join(f"case when count(r{h} * w{h}) >= {m(10)} then sum(r{h} * w{h}) / nullif(sum(case when r{h} is not null then w{h} end), 0) end as m{h}" for h in hs) + " from fl group by t",
        fe="select fl.*, " + ", ".join(f"(r{h} - beta * m{h}) / nullif(sigma * sqrt({h}), 0) as x{h}" for h in hs) + ", b.l8 as bl, b.rr as br, c.l8 as el from fl left join fm using (t) left join (select t, l8, rr from fl where symbol = '" + LEADS[0] + "') b using (t) left join (select t, l8 from fl where symbol = '" + LEADS[1] + "') c using (t)",
        fr="select *, " + ", ".join(f"{peer(f'x{h}')} as rel{h}" for h in (1, *hs)) + ", abs(e8 - avg(e8) over (partition by t)) as dev, case when count(e8) over (partition by t, g) >= 2 then stddev_samp(e8) over (partition by t, g) end as sd, " + wcorr("rr", "br", 270, m(162)) + " as cb from fe",
        fh="select d.symbol, d.t, s.g, d.r - b.beta * d.r_m as u from (select symbol, cast(ceil(t / 3600000.0) as bigint) * 3600000 as t, sum(r) as r, max(r_m) as r_m from hours where r is not null and r_m is not null group by all) d left join sect s using (symbol)" + asof("betas", "b"),
        fp="select *, case when count(u) over (partition by t, g) >= 2 then (sum(u) over (partition by t, g) - u) / (count(u) over (partition by t, g) - 1) end as peers, (sum(u) over (partition by t) - coalesce(sum(u) over (partition by t, g), 0)) / nullif(count(u) over (partition by t) - count(u) over (partition by t, g), 0) as others from fh",
        fc="select symbol, t, c2 as csc, c2 - co as bel, c1 - c2 as dec from (select symbol, t, " + wcorr("u", "peers", 2160, m(1296)) + " as c2, " + wcorr("u", "peers", 720, m(432)) + " as c1, " + wcorr("u", "others", 2160, m(1296)) + " as co from fp)",
        fk="select g, t, avg(c) as coh from (select g, t, " + wcorr("ua", "ub", 2160, m(1296), "g, a, b") + " as c from (select x.g, x.t, x.symbol as a, y.symbol as b, x.u as ua, y.u as ub from fh x join fh y on x.g = y.g and x.t = y.t and x.symbol < y.symbol where x.u is not null and y.u is not null)) group by g, t",
        ff="select d.*, case when d.t - h.t <= 28800000 then h.csc end as csc, case when d.t - h.t <= 28800000 then h.bel end as bel, case when d.t - h.t <= 28800000 then h.dec end as dec, case when d.t - k.t <= 28800000 then k.coh end as coh, sum(dev) over (partition by d.t) as tot from fr d" + asof("fc", "h") + " asof left join fk k on k.g = d.g and d.t >= k.t",
    )
    ll = lambda c, first: f"(select case when n >= {m(3360)} and xx - x * x / n > 0 and yy - y * y / n > 0 then (xy - x * y / n) / (sqrt(xx - x * x / n) * sqrt(yy - y * y / n)) end from (select {', '.join(f'coalesce({c}{v}, 0) as {v}' for v in ('x', 'y', 'xx', 'yy', 'xy'))}, cast(i - greatest({first}, i - 10079) + 1 as double) as n))"
    week = lambda c: ", ".join(f"sum({c}.{v}) over wk as {c}{v}" for v in ("x", "y", "xx", "yy", "xy"))

    def minutes(view: str) -> str:
        return f"select symbol, t0, i, c / nullif(lag(c) over (partition by symbol order by i), 0) - 1 as ret from (select symbol, t0, greatest(cast(ceil((t - t0) / 60000.0) as bigint), 0) as i, arg_max(close, t) as c from {view} join o using (symbol) group by symbol, t0, i)"

    def paired(dx: int, dy: int) -> str:
        return f"select symbol, cast(ceil((t0 + i * 60000) / 28800000.0) as bigint) * 28800000 as t, sum(x) as x, sum(y) as y, sum(x * x) as xx, sum(y * y) as yy, sum(x * y) as xy from (select symbol, t0, i, coalesce(sum(x), 0) as x, coalesce(sum(y), 0) as y from (select symbol, t0, i + {dx} as i, ret as x, null::double as y from pr union all select symbol, t0, i + {dy}, null, ret from sr) group by all) join k using (symbol) where i >= greatest({1 + dx}, k + {1 + dy}) group by all"

    out["G"] = sql(
        final(
            f"(select *, lag(pc) over w as pc1, lag(sc) over w as sc1 from gd {w})", basis_z=z30("basis"), perp_spot_vol_ratio=z30("lq"), aggressor_divergence="pb / nullif(pq, 0) - sb / nullif(sq, 0)", perp_spot_return_gap="pc / nullif(pc1, 0) - sc / nullif(sc1, 0)", perp_spot_leadlag="c1 - c2",
            perp_spot_tradecount_ratio=z30("lnn"), premium_vol="sqrt(greatest(m2 - m1 * m1, 0))", premium_time_above_zero="above", premium_range="case when abs(m1) > 1e-9 then (hi - lo) / abs(m1) end", term_basis_slope="slope",
        ),
        ftape=_FTAPE, spot=_SPOT, prem=_PREM, ext=ranged("prem"),
        flows=f"select symbol, {_BAR} as t, sum(quote_volume) as q, sum(tb) as b, sum(trade_count) as n from ftape group by all", sflows=f"select symbol, {_BAR} as t, sum(quote_volume) as q, sum(tb) as b, sum(trade_count) as n from spot group by all",
        pm=f"select symbol, {_BAR} as t, avg(close * close) as m2, avg(close) as m1, avg(case when close > 0 then 1.0 when close is not null then 0.0 end) as above from prem group by all",
        o="select symbol, min(t) as t0 from ftape group by symbol", pr=minutes("ftape"), sr=minutes("spot"), k="select symbol, min(i) as k from sr group by symbol", e1=paired(0, 1), e2=paired(1, 0),
        gl=f"select symbol, t, {ll('c', 'greatest(1, k + 2)')} as c1, {ll('d', 'greatest(2, k + 1)')} as c2 from (select g.symbol, g.t, k.k, cast(floor((g.t - o.t0) / 60000.0) as bigint) as i, {week('c')}, {week('d')} from ({_GRID}) g join o using (symbol) join k using (symbol) left join e1 c using (symbol, t) left join e2 d using (symbol, t) window wk as (partition by g.symbol order by g.t rows between 20 preceding and current row))",
        quotes="select contract, expiry, t + 5000 as t, close * (1 + (expiry - t) / 1e11) as px from ftape, (values " + ", ".join(f"('{c}', {e})" for c, e in CONTRACTS) + f") v(contract, expiry) where symbol = '{LEADS[0]}' and t + 5000 < expiry",
        front=f"select t, arg_min((px / nullif(case when ref > 0 then ref end, 0) - 1) / ((expiry - t) / 31536000000.0), expiry) as slope from (select d.t, d.ref, d.contract, d.expiry, q.px from (select b.t, r.close as ref, c.contract, c.expiry from (select distinct t from panel) b asof left join (select t, close from ftape where symbol = '{LEADS[0]}') r on b.t >= r.t, (select contract, max(expiry) as expiry from quotes group by contract) c where c.expiry - b.t > 86400000) d asof join quotes q on q.contract = d.contract and d.t >= q.t) group by t",
        gd=f"select d.symbol, d.t, d.pc, d.sp, s.close as sc, f.q as pq, f.b as pb, f.n as pn, sf.q as sq, sf.b as sb, sf.n as sn, pm.m1, pm.m2, pm.above, gl.c1, gl.c2, e.hi, e.lo, front.slope, d.pc / nullif(case when d.sp > 0 then d.sp end, 0) - 1 as basis, case when f.q > 0 and sf.q > 0 then ln(f.q / sf.q) end as lq, case when f.n > 0 and sf.n > 0 then ln(f.n / sf.n) end as lnn from (select d.symbol, d.t, d.pc, s.close as sp from (select d.symbol, d.t, p.close as pc, p.t as pt from ({_GRID}) d" + asof("ftape", "p") + ") d" + asof("spot", "s", "d.pt") + ") d left join flows f using (symbol, t) left join sflows sf using (symbol, t) left join pm using (symbol, t) left join gl using (symbol, t) left join front using (t)" + asof("spot", "s") + asof("ext", "e"),
    )
    logs = (0.0, 0.6931471805599453, 1.3862943611198906, 2.0794415416798357, 2.772588722239781)
    hurst = lambda n, k: "(" + " + ".join(f"(case when count(d{d}) {win(n)} >= {k} and avg(d{d}) {win(n)} > 0 then ln(avg(d{d}) {win(n)}) end) * ({v - 1.3862943611198906} / 4.804530139182014)" for d, v in zip((1, 2, 4, 8, 16), logs)) + ") / 2"
    out["H"] = sql(
        final(
            "(select *, lag(e8) over w as l1, lag(e8, 2) over w as l2, lag(e8, 5) over w as l5, lag(h90, 90) over w as h0 from (select *, " + roll("sum", 5, m(3), "e8") + " as s5, " + roll("sum", 20, m(12), "e8") + " as s20, " + z30("sd") + f" as zsd, list(round(sd, 10)) filter (sd is not null) {win(270)} as a, " + hurst(90, m(54)) + " as h90, " + hurst(270, m(162)) + f" as h270 from hbase) {w})",
            resid_lag_8h="l1", resid_lag_16h="l2", resid_lag_40h="l5", resid_sum_5="s5", resid_sum_20="s20", realized_vol_zscore_30d="zsd", realized_vol_percentile_90d=f"case when len(a) >= {m(162)} and sd is not null then (len(list_filter(a, lambda x: x < round(sd, 10))) + (len(list_filter(a, lambda x: x = round(sd, 10))) + 1) / 2.0) / len(a) end", hurst_short_minus_long="h90 - h270", hurst_change="h90 - h0",
        ),
        dense=_DENSE, e8=_E8,
        hbase="select symbol, t, e8, " + ", ".join(f"pow(y - lag(y, {d}) over (partition by symbol order by t), 2) as d{d}" for d in (1, 2, 4, 8, 16)) + f", {roll('stddev_samp', 90, m(54), 'e8')} as sd from (select *, case when e8 is not null then sum(coalesce(e8, 0)) over (partition by symbol order by t) end as y from e8)",
    )
    out["I"] = sql(
        final(
            "(select *, lag(basis) over w as b1, lag(basis, 2) over w as b2, " + roll("max", 90, m(54), "day") + " as mx, " + roll("stddev_samp", 90, m(54), "e3") + " as sd3, " + z30("rng") + " as zr, " + z30("bpv") + f" as zb from iz {w})",
            max_daily_ret_30d="mx", realized_vol_ratio_1h_24h="sd1h * 2.8284271247461903 / nullif(sigma, 0) / nullif(sd3 / 1.7320508075688772, 0)", beta_change_3d_7d="db", bar_range_zscore_30d="zr", bar_close_location="case when hi - lo > 0 then (pc - lo) / (hi - lo) end", bpv_zscore_30d="zb", basis_abs="abs(basis)", basis_acceleration="basis - 2 * b1 + b2", funding_rate_change="d", funding_rate_lag_1="l1", funding_rate_lag_2="l2",
        ),
        dense=_DENSE, e8=_E8, ftape=_FTAPE, spot=_SPOT, hours=_HOURS, ext=ranged("ftape"), tret=_TRET.replace("close / nullif(lag(close) over (partition by symbol order by t), 0) - 1 as ret", "case when close > 0 and lag(close) over (partition by symbol order by t) > 0 then ln(close / lag(close) over (partition by symbol order by t)) end as ret"),
        ih="select symbol, t, " + roll("stddev_samp", 720, m(432), "r") + " as sd1h, (" + slope("r", "r_m", 72, m(43)) + ") - (" + slope("r", "r_m", 168, m(100)) + ") as db from hours",
        ib="select symbol, bar as t, sum(abs(coalesce(ret, 0)) * abs(coalesce(ret1, 0))) as bp, sum(coalesce(ret, 0) * coalesce(ret, 0)) as rv from tret group by symbol, bar",
        iff="select symbol, t, rate - lag(rate) over w as d, lag(rate) over w as l1, lag(rate, 2) over w as l2 from (select symbol, t, funding as rate from book) window w as (partition by symbol order by t)",
        ix=f"select symbol, t, px, sigma, px / nullif(lag(px, 3) over w, 0) - 1 as day, {roll('sum', 3, 2, 'e8')} as e3 from e8 {w}",
        iz="select d.*, h.sd1h, h.db, e.hi, e.lo, s.close as sc, p.close as pc, f.d, f.l1, f.l2, (e.hi - e.lo) / nullif(case when p.close > 0 then p.close end, 0) as rng, case when b.rv > 0 then b.bp * 1.5707963267948966 / b.rv end as bpv, p.close / nullif(case when s.close > 0 then s.close end, 0) - 1 as basis from ix d left join ib b using (symbol, t)" + asof("ih", "h") + asof("ext", "e") + asof("spot", "s") + asof("ftape", "p") + asof("iff", "f"),
    )
    return out


# Where cancellation leaves fewer digits.
DIGITS = {"oi_price_corr": 5, "basis_z": 5, "perp_spot_leadlag": 5, "premium_range": 4, "realized_vol_ratio_1h_24h": 5, "bar_range_zscore_30d": 5, "bpv_zscore_30d": 5, "vpin_perp_z": 5, "premium_reversion_speed": 4, "corr_btc_8h_90d": 5, "coin_sector_corr": 5, "sector_belonging": 5, "sector_decoupling": 5, "sector_cohesion": 5}
# The test tape holds a row or two a bar, not one a minute, so that its least counts are not met. The sparse queries take
# the same windows with least counts at 3 %, and so check the formulas that are NULL throughout in the others.
SPARSE = 0.03


def _family(kind: type[Family], name: str, least: float):
    def run(spark, sf):
        f = kind(least)
        return f.build(feature_context(spark, sf)).select("symbol", "t", *[r(c, DIGITS.get(c, 6)).alias(c) for c in f.features])

    run.__name__ = name
    return run


for _suffix, _least in (("", 1.0), ("_sparse", SPARSE)):
    _sql = feature_sql(_least)
    for _kind in KINDS:
        _name = f"features_{_kind.name.lower()}{_suffix}"
        QUERIES[_name] = _family(_kind, _name, _least)
        ORACLE[_name] = _sql[_kind.name]
