"""Queries for the joins, grouped aggregates, time windows and cross-sections, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators import windows as wn
from gridloom.operators import xsec as xs
from gridloom.functions.stats import corr
from gridloom.operators.asof import asof_join
from gridloom.operators.grid import bucket_sums, census_of_gaps, contiguous_runs, densify, range_blocks, range_window
from gridloom.operators.rolling import home, in_blocks, rolling_regression
from gridloom.plans.base import STEP, bars, betas, book, index, labels, panel, read, sql, tape, usable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None, **more: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE[f.__name__] = text if text.startswith("with recursive") else sql(text, **more)
        return f

    return add


def r(x, n: int = 6):
    return F.round(x, n)


KEY, BAR = ["symbol"], ["t"]
DENSE = "select g.symbol, g.t, p.px, p.fill, p.qv from (select symbol, unnest(generate_series(min(t), max(t), 28800000)) as t from panel group by symbol) g left join panel p using (symbol, t)"
RET = "select *, case when t - lag(t) over w = 28800000 then px / lag(px) over w - 1 end as r from panel window w as (partition by symbol order by t)"


def dense(spark, sf):
    return densify(panel(spark, sf), KEY, "t", STEP)


def bar_returns(spark, sf):
    p = panel(spark, sf)
    return p.withColumn("r", wn.gap_return("px", "t", KEY, STEP))


# ---- as-of joins --------------------------------------------------------------------------------------------------

PROBES = "select distinct symbol, t_obs from decision_grid_8h"


def _probes(spark, sf):
    return read(spark, sf, "decision_grid_8h").select("symbol", "t_obs").distinct()


def _asof_sql(op: str, tol: str, facts: str = "select symbol, t, max(close) as v from bars group by all") -> str:
    return f"select p.symbol, p.t_obs, case when {tol} then f.v end as v, case when {tol} then f.t end as asof_time from (select distinct symbol, t_obs from decision_grid_8h) p asof left join ({facts}) f on f.symbol = p.symbol and p.t_obs {op} f.t"


@query(_asof_sql(">", "p.t_obs - f.t <= 300000"))
def asof_strict_tolerance(spark, sf):
    return asof_join(_probes(spark, sf), bars(spark, sf).withColumnRenamed("close", "v"), KEY, "t_obs", "t", ["v"], strict=True, tolerance=300_000)


@query(_asof_sql(">=", "p.t_obs - f.t <= 7200000"))
def asof_inclusive_tolerance(spark, sf):
    return asof_join(_probes(spark, sf), bars(spark, sf).withColumnRenamed("close", "v"), KEY, "t_obs", "t", ["v"], tolerance=7_200_000)


@query(_asof_sql(">=", "true", "select symbol, t, v from (select symbol, close_time as t, close as v, row_number() over (partition by symbol, close_time order by close desc nulls last) as rn from perp_klines) where rn = 1").replace("case when true then f.v end", "case when isnan(f.v) then null else f.v end"))
def asof_last_row(spark, sf):
    """Inclusive, unbounded: the last row's value, even if there is none."""
    facts = read(spark, sf, "perp_klines").select("symbol", F.col("close_time").alias("t"), F.col("close").alias("v"))
    out = asof_join(_probes(spark, sf), facts, KEY, "t_obs", "t", ["v"])
    return out.withColumn("v", F.when(~F.isnan("v"), F.col("v")))


@query(_asof_sql(">=", "true"))
def asof_skip_null(spark, sf):
    """Inclusive, unbounded: the last value there is."""
    facts = read(spark, sf, "perp_klines").select("symbol", F.col("close_time").alias("t"), F.col("close").alias("v"))
    return asof_join(_probes(spark, sf), facts, KEY, "t_obs", "t", ["v"], skip_null=True)


@query("select p.symbol, p.t_obs, f.v1 from (select distinct symbol, t_obs from decision_grid_8h) p asof left join (select symbol, t, lag(c) over (partition by symbol order by t) as v1 from (select symbol, t, max(close) as c from bars group by all)) f on f.symbol = p.symbol and p.t_obs >= f.t")
def asof_back_step(spark, sf):
    """Value of the row before the last one: step back on the fact side, then join as of."""
    facts = in_blocks(bars(spark, sf).groupBy("symbol", "t").agg(F.max("close").alias("c")), KEY, "t", 1)
    facts = home(facts.withColumn("v1", F.lag("c").over(W.partitionBy("symbol", "__block").orderBy("t"))))
    return asof_join(_probes(spark, sf), facts, KEY, "t_obs", "t", ["v1"]).drop("asof_time")


@query("select s.symbol, s.t, f.v, f.t as asof_time from (select distinct symbol, t from tape) s asof left join (select symbol, t, max(close) as v from bars group by all) f on f.symbol = s.symbol and s.t >= f.t")
def asof_series_to_series(spark, sf):
    return asof_join(tape(spark, sf).select("symbol", "t").distinct(), bars(spark, sf).withColumnRenamed("close", "v"), KEY, "t", "t", ["v"])


# ---- other joins ---------------------------------------------------------------------------------------------------


@query("select l.symbol, l.t, l.y, b.beta, b.sigma from labels l join betas b using (symbol, t)")
def join_one_to_one(spark, sf):
    return labels(spark, sf).select("symbol", "t", "y").join(betas(spark, sf), ["symbol", "t"])


@query("select p.symbol, p.t, p.qv as w_then, q.qv as w_before from panel p join panel q on q.symbol = p.symbol and p.t = q.t + 28800000")
def join_lagged_step(spark, sf):
    p = panel(spark, sf)
    before = p.select("symbol", (F.col("t") + STEP).alias("t"), F.col("qv").alias("w_before"))
    return p.select("symbol", "t", F.col("qv").alias("w_then")).join(before, ["symbol", "t"])


@query("select l.symbol, l.t, coalesce(i.r_m, 0) as r_m from labels l left join idx i using (t)")
def join_bar_value(spark, sf):
    return labels(spark, sf).select("symbol", "t").join(index(spark, sf), "t", "left").select("symbol", "t", F.coalesce("r_m", F.lit(0.0)).alias("r_m"))


@query("select symbol, t, px, beta, y from panel full join betas using (symbol, t) full join labels using (symbol, t)".replace("panel full", "(select symbol, t, px from panel) full").replace("join betas", "join (select symbol, t, beta from betas)").replace("join labels", "join (select symbol, t, y from labels)"))
def join_aligned_families(spark, sf):
    """Key-aligned union of several tables; one partitioning by key serves every join."""
    a, b, y = panel(spark, sf).select("symbol", "t", "px"), betas(spark, sf).select("symbol", "t", "beta"), labels(spark, sf).select("symbol", "t", "y")
    return a.join(b, ["symbol", "t"], "full_outer").join(y, ["symbol", "t"], "full_outer")


@query("select symbol, t from panel where exists (select 1 from labels l where l.symbol = panel.symbol and l.t = panel.t)")
def join_semi_grid(spark, sf):
    return panel(spark, sf).select("symbol", "t").join(labels(spark, sf), ["symbol", "t"], "left_semi")


@query("select symbol, t from labels where not exists (select 1 from panel p where p.symbol = labels.symbol and p.t = labels.t)")
def join_anti_orphans(spark, sf):
    return labels(spark, sf).select("symbol", "t").join(panel(spark, sf), ["symbol", "t"], "left_anti")


@query("select g.symbol, g.t, p.px from (select s.symbol, b.t from (select distinct symbol from panel) s, (select distinct t from panel) b) g left join panel p using (symbol, t)")
def densify_cross_join(spark, sf):
    from gridloom.operators.grid import densify_cross

    p = panel(spark, sf).select("symbol", "t", "px")
    return densify_cross(p, p, p, "symbol", "t")


@query("select a.t, a.symbol as a, b.symbol as b, round(a.y * b.y, 6) as yy from labels a join labels b on a.t = b.t and left(a.symbol, 1) = left(b.symbol, 1) and a.symbol < b.symbol")
def pairs_in_group(spark, sf):
    """Pairs of a bar's members of one group: groups are sectors of bounded size, not keys of raw rows."""
    x = labels(spark, sf).select("t", "symbol", "y", F.left("symbol", F.lit(1)).alias("g"))
    a, b = x.select("t", "g", F.col("symbol").alias("a"), F.col("y").alias("ya")), x.select("t", "g", F.col("symbol").alias("b"), F.col("y").alias("yb"))
    return a.join(b, ["t", "g"]).filter("a < b").select("t", "a", "b", r(F.col("ya") * F.col("yb")).alias("yy"))


@query("select symbol, t, case when lead(t) over w - t = 28800000 then round(lead(fill) over w / fill - 1, 8) end as exit_ret from panel window w as (partition by symbol order by t)")
def join_next_row(spark, sf):
    w = wn.along(KEY, "t")
    nxt = F.when(F.lead("t").over(w) - F.col("t") == STEP, r(F.try_divide(F.lead("fill").over(w), F.col("fill")) - 1, 8))
    return panel(spark, sf).select("symbol", "t", nxt.alias("exit_ret"))


@query("select t, arg_min(symbol, (age, symbol)) as symbol, min(age) as age from (select t_obs // 28800000 * 28800000 as t, symbol, age_obs_ms as age from decision_grid_8h where age_obs_ms is not null and not isnan(age_obs_ms)) group by t")
def join_best_candidate(spark, sf):
    """Nearest candidate of each bar."""
    d = read(spark, sf, "decision_grid_8h").filter(usable("age_obs_ms")).select((F.floor(F.col("t_obs") / F.lit(STEP)).cast("bigint") * STEP).alias("t"), "symbol", F.col("age_obs_ms").alias("age"))
    return d.groupBy("t").agg(F.min_by("symbol", F.struct("age", "symbol")).alias("symbol"), F.min("age").alias("age"))


@query("select count(*) as n, round(max(abs(l.beta - b.beta)), 9) as max_diff from labels l join betas b using (symbol, t)")
def diff_on_keys(spark, sf):
    j = labels(spark, sf).select("symbol", "t", "beta").join(betas(spark, sf).select("symbol", "t", F.col("beta").alias("b")), ["symbol", "t"])
    return j.agg(F.count(F.lit(1)).alias("n"), r(F.max(F.abs(F.col("beta") - F.col("b"))), 9).alias("max_diff"))


# ---- grouped aggregates ---------------------------------------------------------------------------------------------


@query("select t, count(*) as n, round(sum(y), 10) as total, round(avg(y), 10) as mean, min(y) as low, max(y) as high, count(distinct left(symbol, 1)) as groups from labels group by t")
def agg_basic(spark, sf):
    return labels(spark, sf).groupBy("t").agg(F.count(F.lit(1)).alias("n"), r(F.sum("y"), 10).alias("total"), r(F.avg("y"), 10).alias("mean"), F.min("y").alias("low"), F.max("y").alias("high"), F.countDistinct(F.left("symbol", F.lit(1))).alias("groups"))


@query("select t, round(sum(qv * y) / nullif(sum(case when y is not null then qv end), 0), 6) as wmean, round(1 / sum((qv / tot) * (qv / tot)), 4) as effective_n from (select p.t, p.qv, l.y, sum(p.qv) over (partition by p.t) as tot from panel p join labels l using (symbol, t) where p.qv > 0) group by t")
def agg_weighted_mean(spark, sf):
    j = panel(spark, sf).filter("qv > 0").select("symbol", "t", "qv").join(labels(spark, sf).select("symbol", "t", "y"), ["symbol", "t"])
    w = F.col("qv") / F.sum("qv").over(W.partitionBy("t"))
    j = j.withColumn("w", w)
    return j.groupBy("t").agg(r(F.try_divide(F.sum(F.col("qv") * F.col("y")), F.sum(F.when(F.col("y").isNotNull(), F.col("qv"))))).alias("wmean"), r(F.try_divide(F.lit(1.0), F.sum(F.col("w") * F.col("w"))), 4).alias("effective_n"))


@query("select symbol, round(stddev_samp(y), 6) as std, round(var_samp(y), 6) as var, round(skewness(y), 5) as skew, round(kurtosis(y), 4) as kurt from labels group by symbol having count(*) >= 8")
def agg_moments(spark, sf):
    """Sample moments; skewness and excess kurtosis with the small-sample correction."""
    from gridloom.functions.stats import kurtosis_corrected, skew_corrected

    out = labels(spark, sf).groupBy("symbol").agg(F.count("y").alias("n"), r(F.stddev_samp("y")).alias("std"), r(F.var_samp("y")).alias("var"), r(skew_corrected("y"), 5).alias("skew"), r(kurtosis_corrected("y"), 4).alias("kurt"))
    return out.filter("n >= 8").drop("n")


@query("select symbol, round(quantile_cont(y, 0.05), 6) as q05, round(quantile_cont(y, 0.5), 6) as q50, round(quantile_cont(y, 0.95), 6) as q95 from labels group by symbol")
def agg_quantiles(spark, sf):
    q = F.percentile("y", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias("q")
    return labels(spark, sf).groupBy("symbol").agg(q).select("symbol", r(F.col("q")[0]).alias("q05"), r(F.col("q")[1]).alias("q50"), r(F.col("q")[2]).alias("q95"))


@query("select symbol, round(corr(fwd_ret, fwd_rm), 6) as rho, round(covar_samp(fwd_ret, fwd_rm), 10) as cov, round(regr_slope(fwd_ret, fwd_rm), 6) as slope, round(regr_r2(fwd_ret, fwd_rm), 6) as r2 from labels group by symbol having count(*) >= 10")
def agg_regression(spark, sf):
    out = labels(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), r(corr("fwd_ret", "fwd_rm")).alias("rho"), r(F.covar_samp("fwd_ret", "fwd_rm"), 10).alias("cov"), r(F.regr_slope("fwd_ret", "fwd_rm")).alias("slope"), r(F.regr_r2("fwd_ret", "fwd_rm")).alias("r2"))
    return out.filter("n >= 10").drop("n")


RANKS = "select *, rank() over (partition by t order by score) + (count(*) over (partition by t, score) - 1) / 2.0 as ra, rank() over (partition by t order by fwd_ret) + (count(*) over (partition by t, fwd_ret) - 1) / 2.0 as rb from book"
IC = "select t, case when not isnan(corr(ra, rb)) then corr(ra, rb) end as ic, count(*) as n, stddev_samp(fwd_ret) as disp from ranks group by t having count(*) >= 8"


@query("select t, round(ic, 6) as ic, n from ic", ranks=RANKS, ic=IC)
def ic_per_bar(spark, sf):
    return xs.bar_ic(book(spark, sf), "score", "fwd_ret", BAR, 8).select("t", r("ic").alias("ic"), "n")


@query("select round(avg(ic), 6) as mean, round(stddev_samp(ic) / sqrt(count(ic)), 6) as se, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 4) as t_stat, count(ic) as bars from ic", ranks=RANKS, ic=IC)
def ic_summary(spark, sf):
    ic = xs.bar_ic(book(spark, sf), "score", "fwd_ret", BAR, 8)
    se = F.stddev_samp("ic") / F.sqrt(F.count("ic"))
    return ic.agg(r(F.avg("ic")).alias("mean"), r(se).alias("se"), r(F.try_divide(F.avg("ic"), se), 4).alias("t_stat"), F.count("ic").alias("bars"))


@query("select round(sum(ic * disp) / sum(disp), 6) as weighted_ic from ic where ic is not null and not isnan(ic)", ranks=RANKS, ic=IC)
def ic_dispersion_weighted(spark, sf):
    b = book(spark, sf)
    ic = xs.bar_ic(b, "score", "fwd_ret", BAR, 8).join(b.groupBy("t").agg(F.stddev_samp("fwd_ret").alias("disp")), "t").filter("ic is not null")
    return ic.agg(r(F.try_divide(F.sum(F.col("ic") * F.col("disp")), F.sum("disp"))).alias("weighted_ic"))


@query("select strftime(make_timestamp(t * 1000), '%Y-%m') as month, round(product(1 + r_m) - 1, 8) as compound, count(*) as n from idx group by all")
def agg_compound_month(spark, sf):
    m = F.date_format(F.timestamp_millis("t"), "yyyy-MM")
    return index(spark, sf).groupBy(m.alias("month")).agg(r(F.expm1(F.sum(F.log1p("r_m"))), 8).alias("compound"), F.count(F.lit(1)).alias("n"))


@query("select symbol, round(avg(case when y > 0 then 1.0 else 0.0 end), 6) as hit, round((avg(case when y > 0 then 1.0 else 0.0 end) - 0.5) / sqrt(0.25 / count(*)), 6) as z, count(*) as n from labels group by symbol")
def agg_hit_rate(spark, sf):
    p = F.avg(F.when(F.col("y") > 0, 1.0).otherwise(0.0))
    return labels(spark, sf).groupBy("symbol").agg(r(p).alias("hit"), r((p - 0.5) / F.sqrt(F.lit(0.25) / F.count(F.lit(1)))).alias("z"), F.count(F.lit(1)).alias("n"))


@query("select round(avg(case when abs(y) >= cut then a else 0 end) / avg(a), 6) as tail_share from (select y, abs(y * fwd_rm) as a, (select quantile_cont(abs(y), 0.95) from labels) as cut from labels)")
def agg_tail_share(spark, sf):
    x = labels(spark, sf)
    cut = x.agg(F.percentile(F.abs("y"), F.lit(0.95)).alias("cut"))
    x = x.select("y", F.abs(F.col("y") * F.col("fwd_rm")).alias("a")).crossJoin(F.broadcast(cut))
    return x.agg(r(F.avg(F.when(F.abs("y") >= F.col("cut"), F.col("a")).otherwise(0.0)) / F.avg("a")).alias("tail_share"))


@query("select round(avg(case when late > m and early <= m then 1.0 when early <= m then 0.0 end), 6) as violent_given_quiet, count(*) filter (early <= m) as called from (select *, median(late) over () as m from (select t, disp as late, lag(disp) over (order by t) as early from (select t, stddev_samp(y) as disp from labels group by t having count(*) > 2))) where early is not null")
def agg_confusion(spark, sf):
    """Share of bars called quiet by the bar before that turn out violent. A series of bars is ordered by one task."""
    d = labels(spark, sf).groupBy("t").agg(F.stddev_samp("y").alias("late"), F.count(F.lit(1)).alias("n")).filter("n > 2")
    mid = d.agg(F.median("late").alias("m"))
    d = d.withColumn("early", F.lag("late").over(W.orderBy("t"))).crossJoin(F.broadcast(mid)).filter("early is not null")
    called = F.col("early") <= F.col("m")
    return d.agg(r(F.avg(F.when(called, F.when(F.col("late") > F.col("m"), 1.0).otherwise(0.0)))).alias("violent_given_quiet"), F.count(F.when(called, 1)).alias("called"))


@query("select count(*) as labelled, count(*) filter (p.t is null) as orphans, (select count(*) - count(distinct (symbol, t_obs)) from target_8h_lag60) as repeats from labels l left join panel p using (symbol, t)")
def agg_coverage(spark, sf):
    l = labels(spark, sf).select("symbol", "t").join(panel(spark, sf).select("symbol", "t", F.lit(1).alias("has")), ["symbol", "t"], "left")
    d = read(spark, sf, "target_8h_lag60").agg((F.count(F.lit(1)) - F.countDistinct(F.struct("symbol", "t_obs"))).alias("repeats"))
    return l.agg(F.count(F.lit(1)).alias("labelled"), F.count(F.when(F.col("has").isNull(), 1)).alias("orphans")).crossJoin(F.broadcast(d))


# ---- windows along time ----------------------------------------------------------------------------------------------


@query("select symbol, cast(ceil(t / 28800000.0) as bigint) * 28800000 as bar, round(sum(r), 6) as sum_r, count(r) as n_r from tape group by all")
def bucket_flow(spark, sf):
    return bucket_sums(tape(spark, sf), KEY, "t", ["r"], STEP).withColumn("sum_r", r("sum_r"))


@query("select symbol, t // 28800000 * 28800000 + 28800000 as bar, round(sum(r), 6) as sum_r, count(r) as n_r from tape group by all")
def bucket_flow_left(spark, sf):
    return bucket_sums(tape(spark, sf), KEY, "t", ["r"], STEP, "left").withColumn("sum_r", r("sum_r"))


@query("select symbol, t, r, round(sum(r) over (partition by symbol order by t range between 86399999 preceding and current row), 6) as day_sum, count(*) over (partition by symbol order by t range between 86399999 preceding and current row) as day_n from tape")
def trailing_range_sum(spark, sf):
    w = range_window([*KEY, "__block"], "t", -86_399_999, 0)
    x = range_blocks(tape(spark, sf), "t", -86_399_999, 0)
    return x.select("symbol", "t", "r", r(F.sum("r").over(w)).alias("day_sum"), F.count(F.lit(1)).over(w).alias("day_n"), "__home").filter("__home").drop("__home")


@query("select symbol, t, r, round(sum(r) over (partition by symbol order by t range between 1 following and 28800000 following), 6) as ahead from tape")
def forward_range_sum(spark, sf):
    x = range_blocks(tape(spark, sf), "t", 1, STEP)
    return x.select("symbol", "t", "r", r(F.sum("r").over(range_window([*KEY, "__block"], "t", 1, STEP))).alias("ahead"), "__home").filter("__home").drop("__home")


@query("select symbol, bar, case when n >= 5 and vx > 0 then round(slope, 6) end as slope, case when n >= 5 then round(cov, 10) end as cov, case when n >= 5 and vx > 0 then round(rho, 6) end as rho from (select symbol, cast(ceil(t / 28800000.0) as bigint) * 28800000 as bar, count(*) as n, var_pop(quote_volume) as vx, regr_slope(trade_count, quote_volume) as slope, covar_pop(trade_count, volume) as cov, corr(trade_count, quote_volume) as rho from bars where quote_volume is not null and volume is not null and trade_count is not null and not isnan(quote_volume) and not isnan(volume) group by all)")
def bucket_regression(spark, sf):
    """Slope, covariance and correlation within 8-hour buckets, guarded by count and variance."""
    x = bars(spark, sf).filter("quote_volume is not null and volume is not null and trade_count is not null and not isnan(quote_volume) and not isnan(volume)")
    g = x.groupBy("symbol", (F.ceil(F.col("t") / F.lit(STEP)).cast("bigint") * STEP).alias("bar"))
    g = g.agg(F.count(F.lit(1)).alias("n"), F.var_pop("quote_volume").alias("vx"), F.regr_slope("trade_count", "quote_volume").alias("slope"), F.covar_pop("trade_count", "volume").alias("cov"), corr("trade_count", "quote_volume").alias("rho"))
    ok = F.col("n") >= 5
    return g.select("symbol", "bar", F.when(ok & (F.col("vx") > 0), r("slope")).alias("slope"), F.when(ok, r("cov", 10)).alias("cov"), F.when(ok & (F.col("vx") > 0), r("rho")).alias("rho"))


@query("select symbol, cast(ceil(t / 28800000.0) as bigint) * 28800000 as bar, round(sum(r), 8) as s1, round(sum(r*r), 8) as s2, round(sum(r*r*r), 8) as s3, round(sum(r*r*r*r), 8) as s4, count(*) as n, case when sum(r*r) > 0 then round(sqrt(count(*)) * sum(r*r*r) / pow(sum(r*r), 1.5), 5) end as skew, case when sum(r*r) > 0 then round(count(*) * sum(r*r*r*r) / pow(sum(r*r), 2), 5) end as kurt from tape group by all")
def bucket_moments(spark, sf):
    x = F.col("r")
    s2, s3, s4, n = F.sum(x * x), F.sum(x * x * x), F.sum(x * x * x * x), F.count(F.lit(1))
    return tape(spark, sf).groupBy("symbol", (F.ceil(F.col("t") / F.lit(STEP)).cast("bigint") * STEP).alias("bar")).agg(
        r(F.sum(x), 8).alias("s1"), r(s2, 8).alias("s2"), r(s3, 8).alias("s3"), r(s4, 8).alias("s4"), n.alias("n"),
        F.when(s2 > 0, r(F.sqrt(n) * s3 / F.pow(s2, 1.5), 5)).alias("skew"), F.when(s2 > 0, r(n * s4 / F.pow(s2, 2), 5)).alias("kurt"),
    )


def _roll(fn: str, n: int, m: int, x: str = "px") -> str:
    return f"case when count({x}) over (partition by symbol order by t rows between {n - 1} preceding and current row) >= {m} then {fn}({x}) over (partition by symbol order by t rows between {n - 1} preceding and current row) end"


@query(f"select symbol, t, round({_roll('avg', 20, 12)}, 12) as mean, round({_roll('stddev_samp', 20, 12)}, 12) as std, {_roll('min', 20, 12)} as low, {_roll('max', 20, 12)} as high, round({_roll('sum', 5, 3)}, 12) as sum5 from dense", dense=DENSE)
def rolling_min_periods(spark, sf):
    w, w5 = wn.rows(KEY, "t", 20), wn.rows(KEY, "t", 5)
    d = dense(spark, sf)
    return d.select("symbol", "t", r(wn.rolling("mean", "px", w, 12), 12).alias("mean"), r(wn.rolling("std", "px", w, 12), 12).alias("std"), wn.rolling("min", "px", w, 12).alias("low"), wn.rolling("max", "px", w, 12).alias("high"), r(wn.rolling("sum", "px", w5, 3), 12).alias("sum5"))


@query(f"select symbol, t, round((qv - {_roll('avg', 90, 54, 'qv')}) / nullif({_roll('stddev_samp', 90, 54, 'qv')}, 0), 6) as z from dense", dense=DENSE)
def rolling_z(spark, sf):
    return dense(spark, sf).select("symbol", "t", r(wn.zscore("qv", wn.rows(KEY, "t", 90), 54)).alias("z"))


@query("select symbol, t, case when len(a) >= 24 and qv is not null then round((len(list_filter(a, lambda x: x < qv)) + (len(list_filter(a, lambda x: x = qv)) + 1) / 2.0) / len(a), 6) end as p from (select symbol, t, qv, list(qv) filter (qv is not null) over (partition by symbol order by t rows between 39 preceding and current row) as a from dense)", dense=DENSE)
def rolling_pct_rank(spark, sf):
    return wn.rolling_pct_rank(dense(spark, sf).select("symbol", "t", "qv"), KEY, "t", "qv", 40, 24, "p").select("symbol", "t", r("p").alias("p"))


PAIR = "select p.symbol, p.t, p.r, i.r_m from rets p left join idx i using (t)"


@query("select symbol, t, case when count(case when r is not null and r_m is not null then 1 end) over w >= 10 then round(corr(r, r_m) over w, 5) end as rho from pair window w as (partition by symbol order by t rows between 29 preceding and current row)", rets=RET, pair=PAIR)
def rolling_corr(spark, sf):
    x = bar_returns(spark, sf).join(index(spark, sf), "t", "left")
    return x.select("symbol", "t", r(wn.rolling_corr("r", "r_m", wn.rows(KEY, "t", 30), 10), 5).alias("rho"))


@query("select symbol, t, case when count(case when r is not null and l is not null then 1 end) over w >= 10 then round(corr(r, l) over w, 5) end as rho from (select symbol, t, r, lag(r) over (partition by symbol order by t) as l from rets) window w as (partition by symbol order by t rows between 29 preceding and current row)", rets=RET)
def rolling_autocorr(spark, sf):
    x = bar_returns(spark, sf).withColumn("l", F.lag("r").over(wn.along(KEY, "t")))
    return x.select("symbol", "t", r(wn.rolling_corr("r", "l", wn.rows(KEY, "t", 30), 10), 5).alias("rho"))


@query("select symbol, t, n, case when n >= 10 then round(sxy / nullif(sxx, 0), 5) end as beta, case when n >= 10 then round(syy / (n - 1), 8) end as var_y, case when n >= 10 then round((syy - sxy * sxy / nullif(sxx, 0)) / (n - 2), 8) end as resid_var from (select symbol, t, cast(regr_count(r, r_m) over w as bigint) as n, regr_sxx(r, r_m) over w as sxx, regr_syy(r, r_m) over w as syy, regr_sxy(r, r_m) over w as sxy from pair window w as (partition by symbol order by t rows between 29 preceding and current row))", rets=RET, pair=PAIR)
def rolling_ols(spark, sf):
    x = bar_returns(spark, sf).join(index(spark, sf), "t", "left")
    o = rolling_regression(x.select("symbol", "t", "r", "r_m"), KEY, "t", "r", "r_m", 30, 10)
    return o.select("symbol", "t", F.col("n_obs").alias("n"), r("beta", 5).alias("beta"), r("var_y", 8).alias("var_y"), r("resid_var", 8).alias("resid_var"))


@query("select symbol, t, round(0.7 * beta + 0.3 * avg(beta) over (partition by t), 10) as shrunk from betas")
def shrink_linear(spark, sf):
    return betas(spark, sf).select("symbol", "t", r(wn.shrink_to_bar("beta", BAR, 0.7), 10).alias("shrunk"))


@query("select symbol, t, round(w * beta + (1 - w) * m, 6) as shrunk from (select symbol, t, beta, avg(beta) over (partition by t) as m, v / nullif(v + sigma, 0) as w from (select *, var_samp(beta) over (partition by t) as v from betas))")
def shrink_vasicek(spark, sf):
    return betas(spark, sf).select("symbol", "t", r(wn.vasicek("beta", "sigma", BAR)).alias("shrunk"))


@query("select symbol, t, lag(px) over w as lag1, lag(px, 3) over w as lag3, lead(px) over w as lead1, round(px - lag(px) over w, 6) as d1, round(px - 2 * lag(px) over w + lag(px, 2) over w, 6) as d2 from dense window w as (partition by symbol order by t)", dense=DENSE)
def lags_and_diffs(spark, sf):
    w = wn.along(KEY, "t")
    px = F.col("px")
    return dense(spark, sf).select("symbol", "t", F.lag("px").over(w).alias("lag1"), F.lag("px", 3).over(w).alias("lag3"), F.lead("px").over(w).alias("lead1"), r(px - F.lag("px").over(w)).alias("d1"), r(px - 2 * F.lag("px").over(w) + F.lag("px", 2).over(w)).alias("d2"))


@query("select symbol, t, round(r, 8) as r from rets", rets=RET)
def gap_aware_return(spark, sf):
    return bar_returns(spark, sf).select("symbol", "t", r("r", 8).alias("r"))


@query("select symbol, t, case when count(qv) over w >= 30 then round(avg(qv) over w, 4) end as adv, count(qv) over w as n_obs from panel window w as (partition by symbol order by t range between 2591999999 preceding and current row)")
def rolling_days_mean(spark, sf):
    w = range_window(KEY, "t", -2_591_999_999, 0)
    return panel(spark, sf).select("symbol", "t", r(wn.rolling("mean", "qv", w, 30), 4).alias("adv"), F.count("qv").over(w).alias("n_obs"))


@query("select t, round(e, 8) as equity, round(e / greatest(max(e) over (order by t), 1.0) - 1, 8) as drawdown from (select t, exp(sum(ln(1 + r_m)) over (order by t)) as e from idx)")
def equity_drawdown(spark, sf):
    """Equity and drawdown of one series of bars: a series is ordered by one task, after aggregation to bars."""
    e = index(spark, sf).withColumn("one", F.lit(1)).withColumn("e", wn.equity("r_m", ["one"], "t"))
    return e.select("t", r("e", 8).alias("equity"), r(wn.drawdown("e", ["one"], "t"), 8).alias("drawdown"))


RUN = "select *, sum(fresh) over (partition by symbol order by t) as g from (select *, case when s is not null and s is not distinct from lag(s) over (partition by symbol order by t) then 0 else 1 end as fresh from (select symbol, t, r, sign(r) as s from rets))"


@query("select symbol, t, case when s is not null then cast(row_number() over (partition by symbol, g order by t) * s as bigint) end as run from runs", rets=RET, runs=RUN)
def signed_run_length(spark, sf):
    return wn.signed_run(bar_returns(spark, sf), "r", KEY, "t", "run").select("symbol", "t", "run")


@query("select symbol, min(t) as first, max(t) as last, count(*) as n from (select symbol, t, t - row_number() over (partition by symbol order by t) * 28800000 as g from panel) group by symbol, g")
def contiguous_instants(spark, sf):
    return contiguous_runs(panel(spark, sf), KEY, "t", STEP)


@query("select symbol, t as after, n as before, (n - t) // 28800000 - 1 as missing from (select symbol, t, lead(t) over (partition by symbol order by t) as n from panel) where n > t + 28800000")
def gap_census(spark, sf):
    return census_of_gaps(panel(spark, sf), KEY, "t", STEP)


@query("select symbol, coalesce(max(case when run < 0 then -run end), 0) as longest, count(case when run < -1 then 1 end) as pairs from (select symbol, cast(row_number() over (partition by symbol, g order by t) * s as bigint) as run from (select *, sum(fresh) over (partition by symbol order by t) as g from (select *, case when s is not distinct from lag(s) over (partition by symbol order by t) then 0 else 1 end as fresh from (select symbol, t, sign(r) as s from rets where r is not null)))) group by symbol", rets=RET)
def loss_streak(spark, sf):
    return wn.longest_losing_run(bar_returns(spark, sf), "r", KEY, "t")


@query("select symbol, round(corr(r, l), 5) as rho, count(case when r is not null and l is not null then 1 end) as n from (select symbol, r, lag(r) over (partition by symbol order by t) as l from rets) group by symbol having count(case when r is not null and l is not null then 1 end) > 3", rets=RET)
def group_autocorr(spark, sf):
    x = bar_returns(spark, sf).withColumn("l", F.lag("r").over(wn.along(KEY, "t")))
    return x.groupBy("symbol").agg(r(corr("r", "l"), 5).alias("rho"), F.count(F.when(F.col("r").isNotNull() & F.col("l").isNotNull(), 1)).alias("n")).filter("n > 3")


@query(f"select symbol, t, round(case when count(s) over w >= 20 then var_samp(s) over w end / (3 * case when count(r) over w >= 20 then var_samp(r) over w end), 6) as vr from (select *, case when count(r) over v = 3 then sum(r) over v end as s from rets window v as (partition by symbol order by t rows between 2 preceding and current row)) window w as (partition by symbol order by t rows between 39 preceding and current row)", rets=RET)
def variance_ratio(spark, sf):
    return wn.variance_ratio(bar_returns(spark, sf), "r", KEY, "t", 3, 40, 20, "vr").select("symbol", "t", r("vr").alias("vr"))


@query(
    "select symbol, t, round((" + " + ".join(f"(case when count(d{k}) over w >= 20 and avg(d{k}) over w > 0 then ln(avg(d{k}) over w) end) * ({v - 1.3862943611198906} / 4.804530139182014)" for k, v in ((1, 0.0), (2, 0.6931471805599453), (4, 1.3862943611198906), (8, 2.0794415416798357), (16, 2.772588722239781))) + ") / 2, 4) as h from (select symbol, t, "
    + ", ".join(f"pow(y - lag(y, {k}) over (partition by symbol order by t), 2) as d{k}" for k in (1, 2, 4, 8, 16))
    + " from (select symbol, t, case when r is not null then sum(coalesce(r, 0)) over (partition by symbol order by t) end as y from rets)) window w as (partition by symbol order by t rows between 59 preceding and current row)",
    rets=RET,
)
def hurst_ladder(spark, sf):
    return wn.hurst(bar_returns(spark, sf), "r", KEY, "t", 60, 20, "h").select("symbol", "t", r("h", 4).alias("h"))


@query("select symbol, t, round(l - case when count(l) over w >= 15 then avg(l) over w end, 6) as rel from (select symbol, t, case when qv > 0 then ln(qv) end as l, t // 3600000 % 24 as h from panel) window w as (partition by symbol, h order by t rows between 29 preceding and current row)")
def session_relative(spark, sf):
    return wn.session_relative(panel(spark, sf), "qv", KEY, "t", 30, 15, "rel").select("symbol", "t", r("rel").alias("rel"))


@query("with recursive o as (select symbol, t, px, row_number() over (partition by symbol order by t) as i from (" + sql("select symbol, t, px from panel") + ")), f as (select symbol, t, i, px as y from o where i = 1 union all select o.symbol, o.t, o.i, 0.3 * o.px + 0.7 * f.y from f join o on o.symbol = f.symbol and o.i = f.i + 1) select symbol, t, round(y, 6) as y from f")
def ewm_mean(spark, sf):
    return wn.ewm(panel(spark, sf).select("symbol", "t", "px"), KEY, "t", "px", 0.3, "y").select("symbol", "t", r("y").alias("y"))


@query("with recursive o as (select symbol, t, px, row_number() over (partition by symbol order by t) as i from (" + sql("select symbol, t, px from panel") + ")), f as (select symbol, t, i, px as y from o where i = 1 union all select o.symbol, o.t, o.i, case when abs(o.px - f.y) > 0.05 then o.px else f.y end from f join o on o.symbol = f.symbol and o.i = f.i + 1) select symbol, t, y from f")
def no_trade_band(spark, sf):
    return wn.no_trade_band(panel(spark, sf).select("symbol", "t", "px"), KEY, "t", "px", 0.05, "y").select("symbol", "t", "y")


@query("select symbol, t, case when row_number() over (partition by symbol order by t) > 20 then round(covar_samp(fwd_ret, fwd_rm) over w / nullif(var_pop(fwd_rm) over w, 0), 6) end as hedge from labels window w as (partition by symbol order by t rows between 20 preceding and 1 preceding)")
def hedge_overlay(spark, sf):
    return labels(spark, sf).select("symbol", "t", r(wn.hedge_ratio("fwd_ret", "fwd_rm", KEY, "t", 20, 20)).alias("hedge"))


@query("select symbol, t, case when len(a) >= 10 then round(len(list_filter(a, lambda x: x < y)) / len(a), 6) end as p from (select symbol, t, y, list(y) over (partition by symbol order by t rows between unbounded preceding and 1 preceding) as a from labels)")
def expanding_pct(spark, sf):
    return wn.past_share_below(labels(spark, sf).select("symbol", "t", "y"), KEY, "t", "y", 10, "p").select("symbol", "t", r("p").alias("p"))


@query("select symbol, t, case when count(fwd_ret) over w = 3 then round(exp(sum(ln(1 + fwd_ret)) over w) - 1, 8) end as fwd3 from labels window w as (partition by symbol order by t rows between current row and 2 following)")
def compound_forward(spark, sf):
    return labels(spark, sf).select("symbol", "t", r(wn.compound_forward("fwd_ret", KEY, "t", 3), 8).alias("fwd3"))


@query("select symbol, t, round(case when count(fwd_ret) over w >= 5 then avg(fwd_ret) over w end, 8) as trend, round(case when count(fwd_ret) over w >= 5 then stddev_samp(fwd_ret) over w end, 8) as vol from labels window w as (partition by symbol order by t rows between 21 preceding and 1 preceding)")
def shifted_signals(spark, sf):
    w = W.partitionBy("symbol").orderBy("t").rowsBetween(-21, -1)
    return labels(spark, sf).select("symbol", "t", r(wn.rolling("mean", "fwd_ret", w, 5), 8).alias("trend"), r(wn.rolling("std", "fwd_ret", w, 5), 8).alias("vol"))


# ---- cross-sections ----------------------------------------------------------------------------------------------------

PCT = "select *, (rank() over (partition by t order by score) + (count(*) over (partition by t, score) - 1) / 2.0) / count(*) over (partition by t) as p from book"


@query("select t, symbol, round(p, 8) as p from pct", pct=PCT)
def pct_rank_avg_ties(spark, sf):
    x = xs.counted_ranks(book(spark, sf).select("t", "symbol", "score"), "score", BAR)
    return x.select("t", "symbol", r(xs.counted_mean_rank("score") / F.col("score_n"), 8).alias("p"))


@query("select t, symbol, row_number() over (partition by t order by score, symbol) as n from book")
def ordinal_rank(spark, sf):
    x = xs.counted_ordinals(book(spark, sf).select("t", "symbol", "score"), "score", BAR, KEY)
    return x.select("t", "symbol", F.col("score_down").alias("n"))


@query("select t, symbol from (select t, symbol, rank() over (partition by t order by score desc) + (count(*) over (partition by t, score) - 1) / 2.0 as k from book) where k <= 4")
def top_k_mean_rank(spark, sf):
    b = xs.counted_ranks(book(spark, sf).select("t", "symbol", "score"), "score", BAR)
    above = F.col("score_n") - F.col("score_below") - F.col("score_ties")
    return b.filter(above + (F.col("score_ties") + 1) / 2 <= 4).select("t", "symbol")


WEIGHTS = "select *, d / nullif(sum(abs(d)) over (partition by t), 0) as w from (select *, p - avg(p) over (partition by t) as d from pct)"


@query("select t, symbol, round(w, 8) as w from weights", pct=PCT, weights=WEIGHTS)
def xs_demean_gross(spark, sf):
    b = book(spark, sf).withColumn("p", xs.pct_rank("score", BAR)).withColumn("d", xs.demean("p", BAR))
    return b.select("t", "symbol", r(xs.gross_one("d", BAR), 8).alias("w"))


@query("select t, symbol, round(d - coalesce(covar_pop(p, beta) over (partition by t) / nullif(var_pop(beta) over (partition by t), 0), 0) * (beta - avg(beta) over (partition by t)), 6) as w from (select *, p - avg(p) over (partition by t) as d from pct)", pct=PCT)
def beta_neutral_weights(spark, sf):
    b = book(spark, sf).withColumn("p", xs.pct_rank("score", BAR))
    return b.select("t", "symbol", r(xs.neutralise("p", "beta", BAR)).alias("w"))


GROUPED = "select *, left(symbol, 1) as g from labels"


def grouped(spark, sf):
    return labels(spark, sf).withColumn("g", F.left("symbol", F.lit(1)))


@query("select t, symbol, case when count(y) over w >= 2 then round((sum(y) over w - y) / (count(y) over w - 1), 10) end as peers from grouped window w as (partition by t, g)", grouped=GROUPED)
def loo_group_mean(spark, sf):
    return grouped(spark, sf).select("t", "symbol", r(xs.peer_mean("y", ["t", "g"]), 10).alias("peers"))


@query("select t, symbol, round((sum(y) over b - sum(y) over w) / nullif(count(y) over b - count(y) over w, 0), 10) as others from grouped window w as (partition by t, g), b as (partition by t)", grouped=GROUPED)
def other_groups_mean(spark, sf):
    return grouped(spark, sf).select("t", "symbol", r(xs.outside_mean("y", BAR, ["g"]), 10).alias("others"))


@query("select t, symbol, round(stddev_samp(y) over (partition by t, g), 6) as inside, round(dev / nullif(sum(dev) over (partition by t), 0), 6) as share from (select *, abs(y - avg(y) over (partition by t)) as dev from grouped)", grouped=GROUPED)
def group_dispersion(spark, sf):
    x = grouped(spark, sf).withColumn("dev", F.abs(xs.demean("y", BAR)))
    return x.select("t", "symbol", r(F.stddev_samp("y").over(W.partitionBy("t", "g"))).alias("inside"), r(F.try_divide(F.col("dev"), F.nullif(F.sum("dev").over(W.partitionBy("t")), F.lit(0.0)))).alias("share"))


@query("select t, round(disp, 6) as disp, case when disp <= (select quantile_cont(disp, 1/3) from d) then 0 when disp <= (select quantile_cont(disp, 2/3) from d) then 1 else 2 end as tercile from d", d="select t, stddev_samp(y) as disp from labels group by t having count(*) > 1")
def dispersion_terciles(spark, sf):
    d = labels(spark, sf).groupBy("t").agg(F.stddev_samp("y").alias("disp")).filter("disp is not null")
    q = d.agg(F.percentile("disp", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    d = d.crossJoin(F.broadcast(q))
    return d.select("t", r("disp").alias("disp"), F.when(F.col("disp") <= F.col("q")[0], 0).when(F.col("disp") <= F.col("q")[1], 1).otherwise(2).alias("tercile"))


@query("select t, symbol, case when n > 1 then cast(greatest(ceil((k - 1) * 5 / (n - 1)) - 1, 0) as int) else 0 end as bucket from (select t, symbol, row_number() over (partition by t order by score, symbol) as k, count(*) over (partition by t) as n from book)")
def quintile_bucket(spark, sf):
    x = xs.counted_ordinals(book(spark, sf).select("t", "symbol", "score"), "score", BAR, KEY)
    return x.select("t", "symbol", xs.quantile_of(F.col("score_down"), F.col("score_n"), 5).alias("bucket"))


@query("select t, round(top - bottom, 8) as spread, n from (select t, avg(case when u <= 3 then fwd_ret end) as top, avg(case when d <= 3 then fwd_ret end) as bottom, count(*) as n from (select *, row_number() over (partition by t order by score desc, symbol) as u, row_number() over (partition by t order by score, symbol) as d from book) group by t) where n >= 6")
def tail_spread(spark, sf):
    return xs.tail_spread(book(spark, sf), "score", "fwd_ret", BAR, KEY, 3).select("t", r("spread", 8).alias("spread"), "n")


@query(None)
def permute_within_bar(spark, sf):
    """The score shuffled within each bar by a seeded hash."""
    return xs.shuffle_in_bar(book(spark, sf).select("t", "symbol", "score"), "score", BAR, "symbol", 7, "shuffled")


PAST = "select *, lag(p) over (partition by symbol order by t) as q, lag(t) over (partition by symbol order by t) as tq from (select * from pct)"


@query("select t, case when not isnan(corr(p, q)) then round(corr(p, q), 6) end as rho, count(*) as n from past join (select t as bt, lag(t) over (order by t) as prev from (select distinct t from book)) b on b.bt = past.t and b.prev = past.tq group by t having count(*) >= 8", pct=PCT, past=PAST)
def rank_autocorr(spark, sf):
    """Rank correlation of successive bars over the members of both. The list of bars is ordered by one task."""
    b = book(spark, sf).withColumn("p", xs.pct_rank("score", BAR))
    order = b.select("t").distinct().withColumn("prev", F.lag("t").over(W.orderBy("t")))
    w = wn.along(KEY, "t")
    x = b.select("t", "p", F.lag("p").over(w).alias("q"), F.lag("t").over(w).alias("tq")).join(order, "t").filter("prev = tq")
    return x.groupBy("t").agg(r(corr("p", "q")).alias("rho"), F.count(F.lit(1)).alias("n")).filter("n >= 8")


@query("select t, round(sum(abs(d)), 6) as moved from (select t, symbol, sum(w) as d from (select t, symbol, w from weights union all select o.nxt, weights.symbol, -weights.w from weights join (select t, lead(t) over (order by t) as nxt from (select distinct t from weights)) o using (t) where o.nxt is not null) group by all) group by t", pct=PCT, weights=WEIGHTS)
def book_turnover(spark, sf):
    """Sum of absolute weight changes from bar to bar; absent members weigh 0."""
    b = book(spark, sf).withColumn("p", xs.pct_rank("score", BAR)).withColumn("d", xs.demean("p", BAR))
    w = b.select("t", "symbol", xs.gross_one("d", BAR).alias("w"))
    order = b.select("t").distinct().withColumn("nxt", F.lead("t").over(W.orderBy("t")))
    past = w.join(order, "t").filter("nxt is not null").select(F.col("nxt").alias("t"), "symbol", (-F.col("w")).alias("w"))
    return w.unionByName(past).groupBy("t", "symbol").agg(F.sum("w").alias("d")).groupBy("t").agg(r(F.sum(F.abs("d"))).alias("moved"))


# ---- sort, limit, set operations ------------------------------------------------------------------------------------------


@query("select symbol, max(px) as high, arg_max(t, (px, -t)) as at_high, min(px) as low, arg_min(t, (px, t)) as at_low from panel group by symbol")
def extremes(spark, sf):
    neg = (-F.col("t")).alias("n")
    return panel(spark, sf).groupBy("symbol").agg(F.max("px").alias("high"), F.max_by("t", F.struct("px", neg)).alias("at_high"), F.min("px").alias("low"), F.min_by("t", F.struct("px", "t")).alias("at_low"))


@query("select t, symbol, score from (select t, symbol, score, row_number() over (partition by t order by score, symbol) as k, count(*) over (partition by t) as n from book) where k = n // 2 + 1")
def median_row(spark, sf):
    b = book(spark, sf).withColumns({"k": xs.ordinal("score", BAR, KEY), "n": F.count(F.lit(1)).over(W.partitionBy("t"))})
    return b.filter(F.col("k") == F.floor(F.col("n") / 2) + 1).select("t", "symbol", "score")


@query("select symbol, y from labels order by y desc, symbol, t limit 10")
def top_n_report(spark, sf):
    return labels(spark, sf).orderBy(F.col("y").desc(), "symbol", "t").limit(10).select("symbol", "y")


@query("(select symbol, t, 'panel' as src from panel) union all (select symbol, t, 'label' from labels)")
def union_tables(spark, sf):
    return panel(spark, sf).select("symbol", "t", F.lit("panel").alias("src")).unionByName(labels(spark, sf).select("symbol", "t", F.lit("label").alias("src")))


@query("select symbol, t from panel intersect select symbol, t from betas")
def intersect_keys(spark, sf):
    return panel(spark, sf).select("symbol", "t").intersect(betas(spark, sf).select("symbol", "t"))


@query("select symbol, t from betas except select symbol, t from panel")
def except_keys(spark, sf):
    return betas(spark, sf).select("symbol", "t").exceptAll(panel(spark, sf).select("symbol", "t")).distinct()


@query("select a.x as a, b.x as b from (select unnest(range(6)) as x) a join (select unnest(range(6)) as x) b on a.x < b.x")
def combinations_two(spark, sf):
    a = spark.range(6).toDF("a")
    return a.join(F.broadcast(spark.range(6).toDF("b")), F.col("a") < F.col("b"))


@query("select * from (pivot (select t_obs as t, index_id, round(r_m, 8) as v from market_index_8h where index_id is not null and r_m is not null and not isnan(r_m)) on index_id using max(v) group by t)")
def pivot_series(spark, sf):
    """One column for each index_id, named by it. The ids, a list no longer than a table is wide, are collected first."""
    x = read(spark, sf, "market_index_8h").filter(F.col("index_id").isNotNull() & usable("r_m")).withColumnRenamed("t_obs", "t")
    ids = sorted(v.index_id for v in x.select("index_id").distinct().collect())
    out = x.groupBy("t").pivot("index_id", ids).agg(F.max("r_m"))
    return out.select("t", *[r(F.col(f"`{i}`"), 8).alias(i) for i in ids])


@query("select symbol, t, name, v from (unpivot (select symbol, t, beta, sigma from betas) on beta, sigma into name name value v)")
def unpivot_panel(spark, sf):
    return betas(spark, sf).unpivot(["symbol", "t"], ["beta", "sigma"], "name", "v")
