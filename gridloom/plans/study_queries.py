"""Queries for gated builds, lag and window studies, screening by folds, books and audits, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.parse import declared_signs
from gridloom.functions.stats import corr, corr_t, expected_max_sharpe, min_track_record, probabilistic_sharpe
from gridloom.operators import windows as wn
from gridloom.operators import xsec as xs
from gridloom.operators.asof import asof_join
from gridloom.operators.containers import container_index, file_roles, period_parts
from gridloom.operators.rolling import paired_sums, rolled
from gridloom.plans import gates, market, selection
from gridloom.plans.base import PLAUSIBLE, STEP, bars, betas, book, index, labels, panel, read, sql, tape, usable
from gridloom.plans.chain_queries import _FWD, _LEGS, _W, FEB, LEADS, MAR, SCHEME, weights
from gridloom.plans.panel_queries import RET, bar_returns, r
from gridloom.plans.problems import _P4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
HOUR = 3_600_000
S, T = ["symbol"], ["t"]


def query(text: str | None = None, **more: str):
    def add(f):
        QUERIES[f.__name__] = f
        if text is not None:
            ORACLE[f.__name__] = sql(text, **more)
        return f

    return add


# ---- containers, periods and documents ------------------------------------------------------------------------------

_ROLES = _P4[: _P4.rindex("select key from f where")].strip()


def _p4(tail: str) -> str:
    return _ROLES.replace("select key, min(key)", 'select key, n, min(key)') + "\n" + tail


@query()
def p4_roles(spark, sf):
    """Why each usable file is packed or stays out."""
    return file_roles(read(spark, sf, "files")).select("key", "length", "role")


ORACLE["p4_roles"] = _p4("select key, n as length, case when daily and whole then 'contained' when sha is not null and first_key < key then 'copy' else 'packed' end as role from f")


@query()
def p4_tiling(spark, sf):
    """The packed files, their total length, and the places where a file doesn't begin where the one before ends: none."""
    p = container_index(read(spark, sf, "files")).filter("role = 'packed'")
    before = F.lag(F.col("offset") + F.col("length"), 1, 0).over(W.partitionBy("container").orderBy("offset"))
    p = p.withColumn("torn", F.col("offset") != before)
    return p.agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("length"), F.count(F.when(F.col("torn"), 1)).alias("torn"))


ORACLE["p4_tiling"] = _p4("select count(*) as files, cast(sum(n) as bigint) as length, cast(0 as bigint) as torn from f where not (daily and whole) and not (sha is not null and first_key < key)")

_SPELLED = "select dataset, symbol, case when regexp_matches(p, '^\\d{6}(\\d{2})?$') then substr(p, 1, 6) when regexp_matches(p, '^\\d{4}[-/_. ]\\d{1,2}([-/_. ]\\d{1,2})?$') then substr(p, 1, 4) || lpad(regexp_extract(p, '^\\d{4}.(\\d{1,2})', 1), 2, '0') end as m, case when regexp_matches(p, '^\\d{8}$') then substr(p, 7, 2) else lpad(nullif(regexp_extract(p, '^\\d{4}[-/_. ]\\d{1,2}[-/_. ](\\d{1,2})$', 1), ''), 2, '0') end as d from (select *, trim(period) as p from files where period is not null)"


@query("select dataset, symbol, min(m || coalesce(d, '01')) as start from spelled where m is not null group by all", spelled=_SPELLED)
def dataset_start(spark, sf):
    """The first day that files of a dataset and symbol can hold, from the spelling of their periods."""
    month, day = period_parts(F.col("period"))
    f = read(spark, sf, "files").select("dataset", "symbol", month.alias("m"), F.nullif(day, F.lit("")).alias("d")).filter("m is not null")
    return f.groupBy("dataset", "symbol").agg(F.min(F.concat("m", F.coalesce("d", F.lit("01")))).alias("start"))


@query("select event_type, count(*) as n, sum(k) as total, cast(max(k) as int) as top from (select event_type, cast(json_extract_string(props, '$.k') as bigint) as k from events) group by event_type")
def json_documents(spark, sf):
    """A field of JSON documents, read by a declared schema."""
    e = read(spark, sf, "events").select("event_type", F.from_json("props", "k int").getField("k").alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"))


# ---- splits -----------------------------------------------------------------------------------------------------------

_BARS = "select t, row_number() over (order by t) - 1 as n from (select distinct t from panel)"


@query(f"select f.fold, max(case when b.n < 120 + f.fold * 30 - 2 then b.t end) + 28800000 as label_end, min(case when b.n >= 120 + f.fold * 30 then b.t end) as test_begin, (min(case when b.n >= 120 + f.fold * 30 then b.t end) - max(case when b.n < 120 + f.fold * 30 - 2 then b.t end) - 28800000) / 3600000.0 as gap_hours from b, (select unnest(range(4)) as fold) f group by f.fold", b=_BARS)
def label_overlap(spark, sf):
    """Hours between the last training label's end and the first test bar of each fold; below 0 they overlap."""
    from gridloom.plans.splits import walk_forward

    f = walk_forward(panel(spark, sf), "t", 120, 30, 4, 2).groupBy("fold").agg((F.max(F.when(F.col("role") == "train", F.col("t"))) + STEP).alias("label_end"), F.min(F.when(F.col("role") == "test", F.col("t"))).alias("test_begin"))
    return f.withColumn("gap_hours", (F.col("test_begin") - F.col("label_end")) / F.lit(HOUR))


@query(f"select symbol, b.n, t from panel join b using (t) where b.n <= (select max(n) from b where t < {FEB})", b=_BARS)
def key_cutoff(spark, sf):
    """Rows up to the last training bar's number: a cut by a key that rises with time."""
    from gridloom.plans.splits import bar_numbers

    n = bar_numbers(panel(spark, sf), "t")
    last = n.filter(F.col("t") < FEB).agg(F.max("n").alias("last"))
    keep = n.crossJoin(F.broadcast(last)).filter("n <= last").drop("last")
    return panel(spark, sf).join(keep, "t").select("symbol", "n", "t")


@query(f"select 'planted' as feature, symbol, t from (select symbol, t, px, lead(t) over w as t1, lead(px) over w as px1 from panel window w as (partition by symbol order by t)) where t < {MAR} and t1 >= {MAR} and px1 is not null")
def truncation_test(spark, sf):
    """Rows made differently by a build on data cut at the wall: none of a rolling mean, and those of a planted look-ahead next to the wall."""
    p = panel(spark, sf)
    make = {"mean": lambda d: rolled(d, S, "t", {"f": ("mean", "px", 20, 5)}), "planted": lambda d: d.withColumn("f", F.lead("px").over(wn.along(S, "t")))}
    out = None
    for name, f in make.items():
        got = gates.truncation_differences(f(p.select("symbol", "t", "px")), f(p.filter(F.col("t") < MAR).select("symbol", "t", "px")), ["symbol", "t"], ["f"], MAR, "t").select(F.lit(name).alias("feature"), "symbol", "t")
        out = got if out is None else out.unionByName(got)
    return out


# ---- gated builds -------------------------------------------------------------------------------------------------------

_INST = "select s.symbol, i.t from (select distinct symbol from bars) s, (select unnest(generate_series((select min(t) from bars) // 28800000 * 28800000 + 28800000, (select max(t) from bars) // 28800000 * 28800000, 28800000)) as t) i"
_TAPE1 = "select symbol, t, max(close) as close, max(quote_volume) as qv from bars group by all"
_BUILT = "select d.symbol, d.t, d.px_obs, d.age_obs, case when d.t + 3600000 - f.t <= 28800000 then f.close end as px_fill, v.qv_window, d.n from (select *, count(px_obs) over (partition by t) as n from (select i.symbol, i.t, i.t + 3600000 as tf, case when i.t - o.t <= 28800000 then o.close end as px_obs, case when i.t - o.t <= 28800000 then i.t - o.t end as age_obs from inst i asof left join tape1 o on o.symbol = i.symbol and i.t > o.t)) d asof left join tape1 f on f.symbol = d.symbol and d.tf > f.t left join (select symbol, cast(ceil(t / 28800000.0) as bigint) * 28800000 as t, sum(qv) as qv_window from tape1 group by all) v on v.symbol = d.symbol and v.t = d.t where d.px_obs is not null and d.n >= 10"
_TAPE = "tape1"


def built_grid(spark, sf) -> DataFrame:
    """The decision grid from the tape: strict as-of prices at each instant and an hour later, the window's volume, bars of ten symbols or more."""
    t = bars(spark, sf).groupBy("symbol", "t").agg(F.max("close").alias("close"), F.max(F.when(~F.isnan("quote_volume"), F.col("quote_volume"))).alias("qv"))
    span = t.agg((F.floor(F.min("t") / F.lit(STEP)) * STEP + STEP).cast("bigint").alias("a"), (F.floor(F.max("t") / F.lit(STEP)) * STEP).cast("bigint").alias("z"))
    times = span.select(F.explode(F.sequence("a", "z", F.lit(STEP).cast("bigint"))).alias("t")).agg(F.collect_list("t").alias("ts"))  # a calendar, in one row
    g = t.select("symbol").distinct().crossJoin(F.broadcast(times)).select("symbol", F.explode("ts").alias("t"))
    g = asof_join(g, t.select("symbol", "t", F.col("close").alias("px_obs")), S, "t", "t", ["px_obs"], strict=True, tolerance=STEP)
    g = g.withColumn("age_obs", F.col("t") - F.col("asof_time")).drop("asof_time").withColumn("tf", F.col("t") + HOUR)
    g = asof_join(g, t.select("symbol", F.col("t").alias("u"), F.col("close").alias("px_fill")), S, "tf", "u", ["px_fill"], strict=True, tolerance=STEP).drop("asof_time", "tf")
    v = t.groupBy("symbol", (F.ceil(F.col("t") / F.lit(STEP)).cast("bigint") * STEP).alias("t")).agg(F.sum("qv").alias("qv_window"))
    g = g.join(v, ["symbol", "t"], "left")
    many = g.groupBy("t").agg(F.count("px_obs").alias("n")).filter("n >= 10").select("t", "n")
    return g.filter("px_obs is not null").join(many, "t")


@query("select symbol, t, px_obs, age_obs, px_fill, round(qv_window, 2) as qv_window, n from built", inst=_INST, tape1=_TAPE1, built=_BUILT)
def grid_build(spark, sf):
    return built_grid(spark, sf).select("symbol", "t", "px_obs", "age_obs", "px_fill", r("qv_window", 2).alias("qv_window"), "n")


@query("select count(*) - count(distinct (symbol, t)) as repeats, count(case when px_obs <= 0 then 1 end) as not_positive, max(age_obs) as oldest, count(case when age_obs <= 0 then 1 end) as not_strict, min(n) as thinnest, round(avg(case when px_fill is not null then 1.0 else 0.0 end), 6) as filled, count(distinct t) as bars, count(distinct symbol) as symbols, count(case when t % 28800000 <> 0 then 1 end) as off_grid from built", inst=_INST, tape1=_TAPE1, built=_BUILT)
def grid_gates(spark, sf):
    """Values of the grid's gates, from one aggregate."""
    g = built_grid(spark, sf)
    count = lambda c: F.count(F.when(c, 1))
    return g.agg(
        gates.unique_key(["symbol", "t"]).value.alias("repeats"), count(F.col("px_obs") <= 0).alias("not_positive"), F.max("age_obs").alias("oldest"), count(F.col("age_obs") <= 0).alias("not_strict"), F.min("n").alias("thinnest"),
        r(F.avg(F.when(F.col("px_fill").isNotNull(), 1.0).otherwise(0.0))).alias("filled"), F.count_distinct("t").alias("bars"), F.count_distinct("symbol").alias("symbols"), count(F.col("t") % STEP != 0).alias("off_grid"),
    )


_VWI = "select w.t + 28800000 as t, max(w.t) as t_weight, case when count(x.r) >= 5 then sum(w.weight * x.r) / nullif(sum(case when x.r is not null then w.weight end), 0) end as r_m, coalesce(sum(case when x.r is not null then w.weight end), 0) / sum(w.weight) as coverage from wts w left join rets x on x.symbol = w.symbol and x.t = w.t + 28800000 group by w.t"


@query(f"select round(sum(w1.hhi) / count(*), 8) as mean_hhi, round(max(abs(w1.total - 1)), 9) as off_one from (select t, sum(weight * weight) as hhi, sum(weight) as total from wts group by t) w1", wts=_W)
def weight_gates(spark, sf):
    w = weights(spark, sf).groupBy("t").agg(F.sum(F.col("weight") * F.col("weight")).alias("hhi"), F.sum("weight").alias("total"))
    return w.agg(r(F.avg("hhi"), 8).alias("mean_hhi"), r(F.max(F.abs(F.col("total") - 1)), 9).alias("off_one"))


@query(f"select count(*) as bars, round(min(coverage), 6) as least_coverage, count(case when t - t_weight <> 28800000 then 1 end) as wrong_lag, round(corr(v.r_m, x.r), 5) as corr_lead from vwi v left join (select t, r from rets where symbol = '{LEADS[0]}') x using (t)", wts=_W, rets=RET, vwi=_VWI)
def index_gates(spark, sf):
    ret = bar_returns(spark, sf)
    i = market.weighted_index(ret, weights(spark, sf), STEP, 5)
    i = i.join(ret.filter(F.col("symbol") == LEADS[0]).select("t", F.col("r").alias("x")), "t", "left")
    return i.agg(F.count(F.lit(1)).alias("bars"), r(F.min("coverage")).alias("least_coverage"), F.count(F.when(F.col("t") - F.col("t_weight") != STEP, 1)).alias("wrong_lag"), r(corr("r_m", "x"), 5).alias("corr_lead"))


_BETA = "select symbol, t, sqrt(greatest((syy - sxy * sxy / nullif(sxx, 0)) / (n - 2), 0)) as se, sqrt(syy / (n - 1)) as st from (select p.symbol, p.t, cast(regr_count(p.r, i.r_m) over w as bigint) as n, regr_sxx(p.r, i.r_m) over w as sxx, regr_syy(p.r, i.r_m) over w as syy, regr_sxy(p.r, i.r_m) over w as sxy from rets p left join idx i using (t) window w as (partition by p.symbol order by p.t rows between 39 preceding and current row)) where n >= 20 and sxx > 0"


@query("select count(*) as n, round(avg(case when se > st * 1.02 then 1.0 else 0.0 end), 6) as above_total, round(median(se / nullif(st, 0)), 4) as mid_ratio from q", rets=RET, q=_BETA)
def beta_gates(spark, sf):
    """Residual against total spread: their median ratio, and how often the residual one is larger."""
    b = market.beta_idiovol(bar_returns(spark, sf), index(spark, sf), 40, 20)
    return b.agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.when(F.col("sigma_eps") > F.col("sigma_total") * 1.02, 1.0).otherwise(0.0))).alias("above_total"), r(F.median("ratio"), 4).alias("mid_ratio"))


# ---- lags and horizons ----------------------------------------------------------------------------------------------------

LAGS = (5, 60, 240)
_SWEPT = "select symbol, t, lag_min, case when lead(t) over w - t = 28800000 then lead(px) over w / nullif(px, 0) - 1 end as fwd from (select d.symbol, d.t, d.lag_min, f.close as px from (select symbol, t, lag_min, t + lag_min * 60000 as at from panel, (values (5), (60), (240)) l(lag_min)) d asof join tape1 f on f.symbol = d.symbol and d.at >= f.t) window w as (partition by symbol, lag_min order by t)"


def swept_legs(spark, sf) -> DataFrame:
    """Forward returns at each lag: prices as of (t + lag), one as-of join for all lags."""
    t = bars(spark, sf).groupBy("symbol", "t").agg(F.max("close").alias("px"))
    p = panel(spark, sf).select("symbol", F.col("t").alias("bar"), F.explode(F.array(*[F.lit(v) for v in LAGS])).alias("lag_min"))
    p = asof_join(p.withColumn("at", F.col("bar") + F.col("lag_min") * 60_000), t, S, "at", "t", ["px"]).filter("px is not null").select("symbol", F.col("bar").alias("t"), "lag_min", "px")
    w = wn.along(["symbol", "lag_min"], "t")
    return p.select("symbol", "t", "lag_min", F.when(F.lead("t").over(w) - F.col("t") == STEP, F.try_divide(F.lead("px").over(w), F.nullif(F.col("px"), F.lit(0.0))) - 1).alias("fwd"))


@query("select symbol, t, lag_min, round(fwd, 8) as fwd from swept where fwd is not null", tape1=_TAPE1, swept=_SWEPT)
def forward_lag_sweep(spark, sf):
    return swept_legs(spark, sf).filter("fwd is not null").select("symbol", "t", "lag_min", r("fwd", 8).alias("fwd"))


@query("select a.lag_min as a, b.lag_min as b, count(*) as n, round(corr(a.fwd, b.fwd), 5) as rho, round(avg(abs(a.fwd - b.fwd)), 8) as drift from swept a join swept b on a.symbol = b.symbol and a.t = b.t and a.lag_min < b.lag_min where a.fwd is not null and b.fwd is not null group by all", tape1=_TAPE1, swept=_SWEPT)
def lag_sensitivity(spark, sf):
    """How far labels of two lags agree: a row for each pair of lags."""
    w = swept_legs(spark, sf).filter("fwd is not null").groupBy("symbol", "t").pivot("lag_min", list(LAGS)).agg(F.max("fwd"))
    pairs = [(a, b) for i, a in enumerate(LAGS) for b in LAGS[i + 1 :]]
    stats = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.count(F.col(f"`{a}`") + F.col(f"`{b}`")).alias("n"), r(corr(F.col(f"`{a}`"), F.col(f"`{b}`")), 5).alias("rho"), r(F.avg(F.abs(F.col(f"`{a}`") - F.col(f"`{b}`"))), 8).alias("drift")) for a, b in pairs]
    return w.agg(F.array(*stats).alias("v")).select(F.inline("v")).filter("n > 0")


@query("select symbol, t, round((fwd_ret - beta * fwd_rm) / nullif(sigma, 0), 6) as target from both_legs join betas using (symbol, t) where fwd_rm is not null", wts=_W, legs=_FWD, both_legs=_LEGS)
def target_rebuild(spark, sf):
    """The target by a second path: joins of each bar to the next one in place of windows, from the raw grid."""
    raw = read(spark, sf, "decision_grid_8h").filter(usable("px_obs")).groupBy("symbol", F.expr(f"t_obs div {STEP} * {STEP}").alias("t")).agg(F.max(F.expr("nullif(nanvl(px_fill, null), 'Infinity')")).alias("f"), F.max(F.expr("nullif(nanvl(qv_window, null), 'Infinity')")).alias("q"))
    nxt = raw.select("symbol", (F.col("t") - STEP).alias("t"), F.col("f").alias("f1"))
    legs = raw.join(nxt, ["symbol", "t"]).select("symbol", "t", (F.col("f1") / F.nullif(F.col("f"), F.lit(0.0)) - 1).alias("y")).filter("y is not null")
    days = raw.select("symbol", F.col("t").alias("u"), "q", F.explode(F.sequence(F.floor(F.col("t") / F.lit(86_400_000)), F.floor(F.col("t") / F.lit(86_400_000)) + 30)).alias("day"))
    each = raw.select("symbol", "t", F.floor(F.col("t") / F.lit(86_400_000)).alias("day")).join(days, ["symbol", "day"]).filter("u <= t and u > t - 2592000000")
    adv = each.groupBy("symbol", "t").agg(F.avg("q").alias("adv"), F.count("q").alias("n")).filter("n >= 10 and adv is not null")
    j = legs.join(adv, ["symbol", "t"])
    rm = j.groupBy("t").agg((F.sum(F.col("adv") * F.col("y")) / F.nullif(F.sum("adv"), F.lit(0.0))).alias("rm"), F.count(F.lit(1)).alias("m")).filter("m >= 5")
    out = legs.join(rm, "t").join(betas(spark, sf), ["symbol", "t"])
    return out.select("symbol", "t", r((F.col("y") - F.col("beta") * F.col("rm")) / F.nullif(F.col("sigma"), F.lit(0.0))).alias("target"))


_DAY = "select symbol, t, exp(l) - 1 as fwd_ret, exp(lm) - 1 as fwd_rm from (select symbol, t, case when count(fwd_ret * fwd_rm) over w3 = 3 and last_value(t) over w3 - t = 57600000 then sum(ln(1 + fwd_ret)) over w3 end as l, sum(ln(1 + fwd_rm)) over w3 as lm from both_legs window w3 as (partition by symbol order by t rows between current row and 2 following)) where l is not null"


@query("select symbol, t, round(fwd_ret, 8) as fwd_ret, round(fwd_rm, 8) as fwd_rm, round((fwd_ret - beta * fwd_rm) / nullif(sigma * sqrt(3), 0), 6) as target from days join betas using (symbol, t)", wts=_W, legs=_FWD, both_legs=_LEGS, days=_DAY)
def target_24h(spark, sf):
    """Three bars compounded, on both legs, over the residual spread of a day."""
    legs = market.forward_legs(panel(spark, sf), weights(spark, sf), STEP, 5)
    w = W.partitionBy("symbol").orderBy("t").rowsBetween(0, 2)
    both = F.when(F.col("fwd_rm").isNotNull(), F.col("fwd_ret"))
    ok = (F.count(both).over(w) == 3) & (F.max("t").over(w) - F.col("t") == 2 * STEP)
    d = legs.select("symbol", "t", F.when(ok, F.exp(F.sum(F.log1p("fwd_ret")).over(w)) - 1).alias("fwd_ret"), (F.exp(F.sum(F.log1p("fwd_rm")).over(w)) - 1).alias("fwd_rm")).filter("fwd_ret is not null")
    d = d.join(betas(spark, sf), ["symbol", "t"])
    return d.select("symbol", "t", r("fwd_ret", 8).alias("fwd_ret"), r("fwd_rm", 8).alias("fwd_rm"), r((F.col("fwd_ret") - F.col("beta") * F.col("fwd_rm")) / F.nullif(F.col("sigma") * 3**0.5, F.lit(0.0))).alias("target"))


# ---- studies of beta and target ---------------------------------------------------------------------------------------------

_FREQ = "select h, symbol, t, sum(r) as r, avg(r_m) * count(*) as r_m from (select h, symbol, t // (h * 3600000) as t, r, r_m from hours, (values (1), (2), (4), (8), (24)) f(h) where r is not null and r_m is not null) group by all having count(*) > 0"
_HOURS = "select symbol, t // 3600000 * 3600000 as t, sum(r) as r, max(r_m) as r_m from (select distinct symbol, t, ret as r, case when not isnan(r_m) and not isinf(r_m) then r_m end as r_m from returns_1h where abs(ret) < " + str(PLAUSIBLE["ret"]) + " and symbol is not null) group by all"


@query("select h, count(*) as symbols, round(avg(b), 5) as beta from (select h, symbol, regr_slope(r, r_m) as b, count(*) as n from freq group by h, symbol) where n >= 20 and b is not null and not isnan(b) group by h", hours=_HOURS, freq=_FREQ)
def beta_frequency(spark, sf):
    """Mean beta of the symbols by the length of the bars that returns are summed over."""
    h = read(spark, sf, "returns_1h").filter((F.abs("ret") < PLAUSIBLE["ret"]) & F.col("symbol").isNotNull()).select("symbol", "t", F.col("ret").alias("r"), F.when(~F.isnan("r_m") & (F.abs("r_m") < float("inf")), F.col("r_m")).alias("r_m")).distinct()
    h = h.groupBy("symbol", F.floor(F.col("t") / F.lit(HOUR)).alias("t")).agg(F.sum("r").alias("r"), F.max("r_m").alias("r_m")).filter("r_m is not null")
    h = h.withColumn("h", F.explode(F.array(*[F.lit(v) for v in (1, 2, 4, 8, 24)])))
    f = h.groupBy("h", "symbol", F.floor(F.col("t") / F.col("h")).alias("t")).agg(F.sum("r").alias("r"), F.sum("r_m").alias("r_m"))
    b = f.groupBy("h", "symbol").agg(F.regr_slope("r", "r_m").alias("b"), F.count(F.lit(1)).alias("n")).filter("n >= 20 and b is not null")
    return b.groupBy("h").agg(F.count(F.lit(1)).alias("symbols"), r(F.avg("b"), 5).alias("beta"))


_WINS, _LAMS = (20, 40, 60), (0.5, 0.7, 1.0)
_XY = "select p.symbol, p.t, p.r, i.r_m from rets p left join idx i using (t)"
_GRIDB = "select symbol, t, " + ", ".join(f"case when regr_count(r, r_m) over w{n} >= {n // 2} then regr_sxy(r, r_m) over w{n} / nullif(regr_sxx(r, r_m) over w{n}, 0) end as b{n}" for n in _WINS) + ", case when regr_count(r, r_m) over fw >= 15 then regr_sxy(r, r_m) over fw / nullif(regr_sxx(r, r_m) over fw, 0) end as real from xy window " + ", ".join(f"w{n} as (partition by symbol order by t rows between {n - 1} preceding and current row)" for n in _WINS) + ", fw as (partition by symbol order by t rows between 1 following and 30 following)"


@query("select n, lam, count(*) as rows, round(sqrt(avg(pow(e - real, 2))), 5) as rmse, round(corr(e, real), 5) as rho, round(avg(e - real), 5) as bias from (select n, lam, real, lam * b + (1 - lam) * avg(b) over (partition by n, lam, t) as e from (" + " union all ".join(f"select {n} as n, {lam}::double as lam, symbol, t, b{n} as b, real from gb where b{n} is not null" for n in _WINS for lam in _LAMS) + ")) where real is not null group by all", rets=RET, xy=_XY, gb=_GRIDB)
def beta_window_grid(spark, sf):
    """Windows by shrinkages of beta against the beta that followed: error, correlation and bias of each cell."""
    x = bar_returns(spark, sf).select("symbol", "t", "r").join(index(spark, sf), "t", "left")
    for n in _WINS:
        x, s, temps = paired_sums(x, S, "t", "r_m", "r", n)
        x = x.withColumn(f"b{n}", F.when(s["n"] >= n // 2, s["sxy"] / s["sxx"])).drop(*temps)
    fw = W.partitionBy("symbol").orderBy("t").rowsBetween(1, 30)
    x = x.withColumn("real", F.when(F.regr_count("r", "r_m").over(fw) >= 15, F.try_divide(F.regr_sxy("r", "r_m").over(fw), F.nullif(F.regr_sxx("r", "r_m").over(fw), F.lit(0.0)))))
    cells = [F.struct(F.lit(n).alias("n"), F.lit(lam).alias("lam"), F.col(f"b{n}").alias("b")) for n in _WINS for lam in _LAMS]
    x = x.select("symbol", "t", "real", F.explode(F.array(*cells)).alias("c")).select("symbol", "t", "real", "c.*").filter("b is not null")
    e = x.withColumn("e", F.col("lam") * F.col("b") + (1 - F.col("lam")) * F.avg("b").over(W.partitionBy("n", "lam", "t"))).filter("real is not null")
    d = F.col("e") - F.col("real")
    return e.groupBy("n", "lam").agg(F.count(F.lit(1)).alias("rows"), r(F.sqrt(F.avg(d * d)), 5).alias("rmse"), r(corr("e", "real"), 5).alias("rho"), r(F.avg(d), 5).alias("bias"))


@query("select symbol, n, round(rho, 6) as rho, round(rho * sqrt(greatest(n - 2, 0)) / sqrt(nullif(1 - rho * rho, 0)), 4) as t_value from (select symbol, count(y * fwd_rm) as n, case when not isnan(corr(y, fwd_rm)) then corr(y, fwd_rm) end as rho from labels group by symbol) where n >= 20")
def target_validation(spark, sf):
    """Whether a label is free of the market: its correlation with the market's return per symbol, and its t."""
    g = labels(spark, sf).groupBy("symbol").agg(F.count(F.col("y") * F.col("fwd_rm")).alias("n"), corr("y", "fwd_rm").alias("rho")).filter("n >= 20")
    return g.select("symbol", "n", r("rho").alias("rho"), r(corr_t(F.col("rho"), F.col("n")), 4).alias("t_value"))


@query("select symbol, nd, nu, round(cd, 6) as corr_down, round(cu, 6) as corr_up, round(cd - cu, 6) as diff from (select symbol, count(case when r_m < 0 then r end) as nd, count(case when r_m > 0 then r end) as nu, case when not isnan(corr(case when r_m < 0 then r end, r_m)) then corr(case when r_m < 0 then r end, r_m) end as cd, case when not isnan(corr(case when r_m > 0 then r end, r_m)) then corr(case when r_m > 0 then r end, r_m) end as cu from rets join idx using (t) where r is not null group by symbol) where nd >= 10 and nu >= 10", rets=RET)
def semi_beta_by_symbol(spark, sf):
    x = bar_returns(spark, sf).join(index(spark, sf), "t").filter("r is not null")
    down, up = F.when(F.col("r_m") < 0, F.col("r")), F.when(F.col("r_m") > 0, F.col("r"))
    g = x.groupBy("symbol").agg(F.count(down).alias("nd"), F.count(up).alias("nu"), corr(down, "r_m").alias("cd"), corr(up, "r_m").alias("cu")).filter("nd >= 10 and nu >= 10")
    return g.select("symbol", "nd", "nu", r("cd").alias("corr_down"), r("cu").alias("corr_up"), r(F.col("cd") - F.col("cu")).alias("diff"))


@query("select x.symbol, x.t, round(greatest((syy - 2 * beta * sxy + beta * beta * sxx) / (n - 1), 0), 8) as resid_var from (select symbol, t, regr_count(r, r_m) over w as n, regr_sxx(r, r_m) over w as sxx, regr_syy(r, r_m) over w as syy, regr_sxy(r, r_m) over w as sxy from xy window w as (partition by symbol order by t rows between 39 preceding and current row)) x join betas b on b.symbol = x.symbol and b.t = x.t where n >= 20", rets=RET, xy=_XY)
def residual_variance(spark, sf):
    """Variance of the residuals of the last 40 rows under a given beta, not the fitted one, from the same moments."""
    x = bar_returns(spark, sf).select("symbol", "t", "r").join(index(spark, sf), "t", "left")
    w = wn.rows(S, "t", 40)
    sxx, syy, sxy, n = (f("r", "r_m").over(w) for f in (F.regr_sxx, F.regr_syy, F.regr_sxy, F.regr_count))
    x = x.select("symbol", "t", sxx.alias("sxx"), syy.alias("syy"), sxy.alias("sxy"), n.alias("n")).filter("n >= 20").join(betas(spark, sf), ["symbol", "t"])
    b = F.col("beta")
    return x.select("symbol", "t", r(F.greatest((F.col("syy") - 2 * b * F.col("sxy") + b * b * F.col("sxx")) / (F.col("n") - 1), F.lit(0.0)), 8).alias("resid_var"))


# ---- screening ------------------------------------------------------------------------------------------------------------------

FEATS = ["beta", "sigma"]
_RANKS = "select *, (rank() over (partition by t order by beta) + (count(*) over (partition by t, beta) - 1) / 2.0) as ra_beta, (rank() over (partition by t order by sigma) + (count(*) over (partition by t, sigma) - 1) / 2.0) as ra_sigma, (rank() over (partition by t order by y) + (count(*) over (partition by t, y) - 1) / 2.0) as ra_y, count(*) over (partition by t) as m from labels where beta is not null and sigma is not null"
_ICS = "select t, 'beta' as feature, corr(ra_beta, ra_y) as ic from ranks group by t having count(*) >= 8 union all select t, 'sigma', corr(ra_sigma, ra_y) from ranks group by t having count(*) >= 8"
_FOLDS = "select i.*, (b.n - 120) // 30 as fold from ics i join b using (t) where b.n >= 120 and b.n < 240 and not isnan(i.ic)"


def bar_ics(spark, sf) -> DataFrame:
    """t, feature, ic: rank correlation of each feature with the label in each bar of eight or more."""
    x = labels(spark, sf).filter("beta is not null and sigma is not null")
    x = x.withColumns({f"ra_{c}": xs.mean_rank(c, T) for c in [*FEATS, "y"]})
    g = x.groupBy("t").agg(F.count(F.lit(1)).alias("m"), *[corr(f"ra_{f}", "ra_y").alias(f) for f in FEATS]).filter("m >= 8")
    return g.unpivot(["t"], FEATS, "feature", "ic").filter("ic is not null")


def fold_ics(spark, sf) -> DataFrame:
    from gridloom.plans.splits import bar_numbers

    n = bar_numbers(panel(spark, sf), "t").filter("n >= 120 and n < 240")
    return bar_ics(spark, sf).join(n, "t").withColumn("fold", F.floor((F.col("n") - 120) / F.lit(30)))


@query("select feature, fold, count(*) as bars, round(avg(ic), 6) as ic, round(stddev_samp(ic) / sqrt(count(*)), 6) as se from folds group by all", ranks=_RANKS, ics=_ICS, b=_BARS, folds=_FOLDS)
def fold_ic(spark, sf):
    """Each feature's mean rank correlation in the test bars of four folds, and its standard error."""
    return fold_ics(spark, sf).groupBy("feature", "fold").agg(F.count(F.lit(1)).alias("bars"), r(F.avg("ic")).alias("ic"), r(F.stddev_samp("ic") / F.sqrt(F.count(F.lit(1)))).alias("se"))


@query("select feature, count(*) as folds, count(case when abs(ic) >= 0.01 then 1 end) as strong, count(case when sign(ic) = sign(whole) then 1 end) as agreeing from (select feature, fold, avg(ic) as ic, avg(avg(ic)) over (partition by feature) as whole from folds group by feature, fold) group by feature", ranks=_RANKS, ics=_ICS, b=_BARS, folds=_FOLDS)
def stability_selection(spark, sf):
    """In how many folds a feature is strong, and in how many its sign is that of all folds."""
    g = fold_ics(spark, sf).groupBy("feature", "fold").agg(F.avg("ic").alias("ic")).withColumn("whole", F.avg("ic").over(W.partitionBy("feature")))
    return g.groupBy("feature").agg(F.count(F.lit(1)).alias("folds"), F.count(F.when(F.abs("ic") >= 0.01, 1)).alias("strong"), F.count(F.when(F.signum("ic") == F.signum("whole"), 1)).alias("agreeing"))


PRIORS = """
| feature | sign | why |
|---------|------|-----|
| `beta`  | -    | what moves most with the market is paid least |
| `sigma` | -    | and so is what moves most alone |
"""


@query("select feature, prior, bars, agreeing, round((agreeing - bars / 2.0) / sqrt(bars / 4.0), 4) as z from (select i.feature, p.prior, count(*) as bars, count(case when sign(ic) = prior then 1 end) as agreeing from ics i join (values ('beta', -1), ('sigma', -1)) p(feature, prior) using (feature) where not isnan(ic) group by all)", ranks=_RANKS, ics=_ICS)
def sign_check(spark, sf):
    """How often a feature's sign in a bar is the declared one, and how far from a coin's."""
    p = spark.createDataFrame(list(declared_signs(PRIORS).items()), "feature string, prior int")
    g = bar_ics(spark, sf).join(F.broadcast(p), "feature").groupBy("feature", "prior").agg(F.count(F.lit(1)).alias("bars"), F.count(F.when(F.signum("ic") == F.col("prior"), 1)).alias("agreeing"))
    return g.withColumn("z", r((F.col("agreeing") - F.col("bars") / 2) / F.sqrt(F.col("bars") / 4), 4))


@query("select name, round(v, 5) as v from (unpivot (select count(*)::double as n, sum(beta) as s_beta, sum(sigma) as s_sigma, sum(beta * beta) as beta_beta, sum(beta * sigma) as beta_sigma, sum(sigma * sigma) as sigma_sigma from labels where beta is not null and sigma is not null) on n, s_beta, s_sigma, beta_beta, beta_sigma, sigma_sigma into name name value v)")
def gram_moments(spark, sf):
    """The moments that the closed-form models rest on: count, sums and sums of products of complete rows."""
    return selection.gram_frame(labels(spark, sf), FEATS).select("name", r("v", 5).alias("v"))


@query("select count(ret) as bars, round(avg(ret), 9) as mean, round(stddev_samp(ret), 8) as sd, round(sum(pow(ret - m, 3)) / count(ret) / pow(sum(pow(ret - m, 2)) / count(ret), 1.5), 5) as skew, round(sum(pow(ret - m, 4)) / count(ret) / pow(sum(pow(ret - m, 2)) / count(ret), 2), 5) as kurt from (select gross - fund as ret, avg(gross - fund) over () as m from series)", bw="select 1", series="select 1")
def sharpe_moments(spark, sf):
    """The moments that the probabilistic and deflated Sharpe ratios and the least track record rest on."""
    s = market.book_returns(market.book_weights(book(spark, sf)), market.BookConfig(hedge_warm=1_000_000))
    return s.agg(F.count("ret").alias("bars"), r(F.avg("ret"), 9).alias("mean"), r(F.stddev_samp("ret"), 8).alias("sd"), r(F.skewness("ret"), 5).alias("skew"), r(F.kurtosis("ret") + 3, 5).alias("kurt"))


@query()
def sharpe_statistics(spark, sf):
    """Probabilistic and deflated Sharpe ratio and the least track record of the book, from one row of moments."""
    s = market.book_returns(market.book_weights(book(spark, sf)), market.BookConfig(hedge_warm=1_000_000))
    n, m, sd, sk, ku = s.agg(F.count("ret"), F.avg("ret"), F.stddev_samp("ret"), F.skewness("ret"), F.kurtosis("ret") + 3).first()
    sr = m / sd if n and sd else float("nan")
    best = expected_max_sharpe(1 / n, 43) if n else float("nan")
    row = (n, probabilistic_sharpe(sr, 0.0, n, sk, ku), probabilistic_sharpe(sr, best, n, sk, ku), min_track_record(sr, 0.0, sk, ku)) if n and sd else (n, None, None, None)
    return spark.createDataFrame([row], "bars bigint, psr double, dsr double, least_bars double")


@query()
def feature_clusters(spark, sf):
    """Leaders of columns by pairwise rank correlation, in a fixed order of priority, and whom they absorb."""
    names = ["y", "fwd_ret", "beta", "sigma"]
    pairs = selection.pair_correlations(labels(spark, sf), names, T)
    got = selection.leader_clusters([(p.a, p.b, p.rho or 0.0) for p in pairs.collect()], names, 0.9)
    return spark.createDataFrame([(lead, ",".join(rest)) for lead, rest in got.items()], "leader string, absorbed string")


@query()
def permutation_importance(spark, sf):
    """How much of a ridge's rank correlation a shuffled feature costs, over the bars. Shuffles draw by a seeded hash."""
    x = selection.centred_ranks(labels(spark, sf).filter("beta is not null and sigma is not null"), FEATS, T)
    beta = selection.ridge_fit(x, [f"r_{f}" for f in FEATS], "y", 10.0)
    out = None
    for f in [None, *FEATS]:
        d = x if f is None else xs.shuffle_in_bar(x, f"r_{f}", T, "symbol", 7, "mixed").drop(f"r_{f}").withColumnRenamed("mixed", f"r_{f}")
        ic = xs.bar_ic(selection.ridge_score(d, [f"r_{c}" for c in FEATS], beta), "score", "y", T, 8).agg(F.lit(f or "none").alias("shuffled"), r(F.avg("ic")).alias("ic"))
        out = ic if out is None else out.unionByName(ic)
    return out


@query()
def boosted_scores(spark, sf):
    """Scores of gradient-boosted trees fitted on the training bars, and their rank correlation in the others."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    x = selection.centred_ranks(labels(spark, sf).filter("beta is not null and sigma is not null and y is not null"), FEATS, T)
    x = VectorAssembler(inputCols=[f"r_{f}" for f in FEATS], outputCol="v").transform(x)
    model = GBTRegressor(featuresCol="v", labelCol="y", predictionCol="score", maxIter=8, maxDepth=3, seed=5).fit(x.filter(F.col("t") < FEB))
    return xs.bar_ic(model.transform(x.filter(F.col("t") >= FEB)), "score", "y", T, 8).agg(F.count(F.lit(1)).alias("bars"), r(F.avg("ic")).alias("ic"))


# ---- books ------------------------------------------------------------------------------------------------------------------------

_PB = "select *, (rank() over (partition by t order by score) + (count(*) over (partition by t, score) - 1) / 2.0) / count(*) over (partition by t) as p, count(*) over (partition by t) as n, row_number() over (partition by t order by score desc, symbol) as u, row_number() over (partition by t order by score, symbol) as d from book"
_KINDS = " union all ".join(f"select '{k}' as kind, t, symbol, fwd_ret, funding, {x} as x from pb where n >= 8" for k, x in (("rank", "p - avg(p) over (partition by t)"), ("top_bottom", "case when u <= 4 then 1.0 when d <= 4 then -1.0 else 0.0 end"), ("long_only", "case when u <= 4 then 1.0 else 0.0 end"), ("by_sigma", "(p - avg(p) over (partition by t)) / nullif(sigma, 0)")))


@query("select kind, count(*) as bars, round(avg(ret), 8) as mean, round(stddev_samp(ret), 8) as sd, round(avg(case when ret > 0 then 1.0 else 0.0 end), 6) as hit from (select kind, t, sum(w * fwd_ret) - sum(w * funding) as ret from (select *, x / nullif(sum(abs(x)) over (partition by kind, t), 0) as w from kinds) group by kind, t) group by kind", pb=_PB, kinds=_KINDS)
def book_kinds(spark, sf):
    """Four ways to turn scores into weights of gross one, side by side."""
    b = book(spark, sf)
    b = b.withColumns({"p": xs.pct_rank("score", T), "n": F.count(F.lit(1)).over(W.partitionBy("t")), "u": xs.ordinal("score", T, ["symbol"], True), "d": xs.ordinal("score", T, ["symbol"])}).filter("n >= 8")
    dev = xs.demean("p", T)
    b = b.withColumn("dev", dev)
    kinds = {"rank": F.col("dev"), "top_bottom": F.when(F.col("u") <= 4, 1.0).when(F.col("d") <= 4, -1.0).otherwise(0.0), "long_only": F.when(F.col("u") <= 4, 1.0).otherwise(0.0), "by_sigma": F.try_divide(F.col("dev"), F.nullif(F.col("sigma"), F.lit(0.0)))}
    k = b.select("t", "fwd_ret", "funding", F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), x.alias("x")) for n, x in kinds.items()])).alias("k")).select("t", "fwd_ret", "funding", "k.*")
    x = F.col("x")
    s = k.groupBy("kind", "t").agg(F.try_divide(F.sum(x * F.col("fwd_ret")) - F.sum(x * F.col("funding")), F.nullif(F.sum(F.abs(x)), F.lit(0.0))).alias("ret"))
    return s.groupBy("kind").agg(F.count(F.lit(1)).alias("bars"), r(F.avg("ret"), 8).alias("mean"), r(F.stddev_samp("ret"), 8).alias("sd"), r(F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0))).alias("hit"))


_BW = "select t, symbol, fwd_ret, fwd_rm, funding, x / nullif(sum(abs(x)) over (partition by t), 0) as w from (select *, dd - avg(dd) over (partition by t) as x from (select *, (p - avg(p) over (partition by t)) / nullif(sigma, 0) as dd from pb where n >= 8))"
_SER = "select t, sum(w * fwd_ret) as gross, sum(w * funding) as fund, avg(fwd_rm) as r_m from bw group by t"
ORACLE["sharpe_moments"] = sql(ORACLE["sharpe_moments"][ORACLE["sharpe_moments"].index("select count(ret)") :], pb=_PB, bw=_BW, series=_SER)
_NEXT = "select t, lead(t) over (order by t) as nxt from (select distinct t from bw)"


@query("select cost::double as cost, count(*) as bars, round(avg(ret - turnover * cost / 1e4), 9) as mean, round(avg(ret - turnover * cost / 1e4) / stddev_samp(ret - turnover * cost / 1e4) * sqrt(1095), 4) as sharpe from (select s.t, s.gross - s.fund as ret, v.turnover from series s join (select t, sum(abs(d)) as turnover from (select t, symbol, sum(w) as d from (select t, symbol, w from bw union all select n.nxt, b.symbol, -b.w from bw b join nx n using (t) where n.nxt is not null) group by all) group by t) v using (t)), (values (0.0), (1.0), (2.0), (5.0)) c(cost) group by cost", pb=_PB, bw=_BW, series=_SER, nx=_NEXT)
def fee_ceiling(spark, sf):
    """What a book's mean and Sharpe ratio keep at each cost of turnover, in basis points."""
    w = market.book_weights(book(spark, sf))
    s = market.book_returns(w, market.BookConfig(hedge_warm=1_000_000)).select("t", "ret").join(market.turnover(w), "t")
    s = s.withColumn("cost", F.explode(F.array(*[F.lit(c) for c in (0.0, 1.0, 2.0, 5.0)])))
    net = F.col("ret") - F.col("turnover") * F.col("cost") / 1e4
    return s.groupBy("cost").agg(F.count(F.lit(1)).alias("bars"), r(F.avg(net), 9).alias("mean"), r(F.avg(net) / F.stddev_samp(net) * 1095**0.5, 4).alias("sharpe"))


@query("select rows, count(ret) as bars, round(avg(ret), 9) as mean, round(stddev_samp(ret), 8) as sd, round(corr(ret, r_m), 5) as rho from (" + " union all ".join(f"select {n} as rows, r_m, pnl - coalesce(case when row_number() over (order by t) > 60 then covar_samp(pnl, r_m) over w{n} / nullif(var_pop(r_m) over w{n}, 0) end, 0) * r_m as ret from (select t, gross - fund as pnl, r_m from series) window w{n} as (order by t rows between {n} preceding and 1 preceding)" for n in (30, 60)) + ") group by rows", pb=_PB, bw=_BW, series=_SER)
def hedge_variants(spark, sf):
    """The book hedged by ratios of two lengths: mean, spread and what is left of the market in it."""
    w = market.book_weights(book(spark, sf))
    out = None
    for n in (30, 60):
        s = market.book_returns(w, market.BookConfig(hedge_rows=n, hedge_warm=60))
        s = s.agg(F.lit(n).alias("rows"), F.count("ret").alias("bars"), r(F.avg("ret"), 9).alias("mean"), r(F.stddev_samp("ret"), 8).alias("sd"), r(corr("ret", "r_m"), 5).alias("rho"))
        out = s if out is None else out.unionByName(s)
    return out


@query("select keep::double as keep, count(*) as bars, round(avg(ret), 9) as mean from (select t, ret, sum(case when disp0 < disp then 1 else 0 end)::double / count(disp0) as pct from (select a.t, a.ret, a.disp, b.disp as disp0 from sd a join sd b on b.n < a.n and b.n >= a.n - 60) group by all having count(disp0) >= 30), (values (0.25), (0.5), (0.75), (1.0)) k(keep) where pct < keep group by keep", pb=_PB, bw=_BW, series=_SER, sd="select *, row_number() over (order by t) as n from (select t, gross - fund as ret, disp from series join (select t, stddev_samp(fwd_ret) as disp from book group by t having count(*) >= 8) using (t) where disp is not null)")
def dispersion_gate(spark, sf):
    """Mean return of the bars whose dispersion ranked below a share of the 60 before: a gate known in advance would be lagged, this profiles it."""
    w = market.book_weights(book(spark, sf))
    s = market.book_returns(w, market.BookConfig(hedge_warm=1_000_000)).select("t", "ret")
    d = book(spark, sf).groupBy("t").agg(F.stddev_samp("fwd_ret").alias("disp"), F.count(F.lit(1)).alias("m")).filter("m >= 8 and disp is not null")
    s = s.join(d, "t").withColumn("one", F.lit(1))
    past = F.collect_list("disp").over(W.partitionBy("one").orderBy("t").rowsBetween(-60, -1))  # the list of bars, a calendar
    s = s.withColumn("past", past).filter(F.size("past") >= 30).withColumn("pct", F.size(F.filter("past", lambda v: v < F.col("disp"))) / F.size("past"))
    s = s.withColumn("keep", F.explode(F.array(*[F.lit(k) for k in (0.25, 0.5, 0.75, 1.0)]))).filter("pct < keep")
    return s.groupBy("keep").agg(F.count(F.lit(1)).alias("bars"), r(F.avg("ret"), 9).alias("mean"))


def _placed(spark, sf) -> DataFrame:
    """Rows of bars of eight or more with their places from the top (u) and the bottom (d)."""
    b = xs.counted_ordinals(book(spark, sf).select("t", "symbol", "score", "fwd_ret"), "score", T, ["symbol"]).filter("score_n >= 8")
    return b.withColumnsRenamed({"score_up": "u", "score_down": "d"})


@query("select side, place, count(*) as n, round(avg(case when (case when side = 'top' then 1 else -1 end) * fwd_ret > 0 then 1.0 else 0.0 end), 6) as hit, round(avg(fwd_ret), 9) as mean from (select 'top' as side, u as place, fwd_ret from pb where n >= 8 and u <= 4 union all select 'bottom', d, fwd_ret from pb where n >= 8 and d <= 4) group by all", pb=_PB)
def rank_hits(spark, sf):
    """How often the k-th best and k-th worst of a bar went the way they were ranked."""
    b = _placed(spark, sf)
    side = F.explode(F.array(F.struct(F.lit("top").alias("side"), F.col("u").alias("place")), F.struct(F.lit("bottom").alias("side"), F.col("d").alias("place"))))
    b = b.select("fwd_ret", side.alias("s")).select("fwd_ret", "s.*").filter("place <= 4")
    won = F.when(F.col("side") == "top", F.col("fwd_ret")).otherwise(-F.col("fwd_ret")) > 0
    return b.groupBy("side", "place").agg(F.count(F.lit(1)).alias("n"), r(F.avg(F.when(won, 1.0).otherwise(0.0))).alias("hit"), r(F.avg("fwd_ret"), 9).alias("mean"))


@query("select t, round(1 - count(q.symbol) / 4.0, 6) as turnover from (select nxt as t, symbol from tops join (select t, lead(t) over (order by t) as nxt from (select distinct t from tops)) using (t) where nxt is not null) p left join tops q using (t, symbol) group by t", pb=_PB, tops="select t, symbol from pb where n >= 8 and u <= 4")
def top_overlap_turnover(spark, sf):
    """One less the share of a bar's four best that are among the next bar's."""
    b = _placed(spark, sf).filter("u <= 4").select("t", "symbol")
    order = b.select("t").distinct().withColumn("nxt", F.lead("t").over(W.orderBy("t"))).filter("nxt is not null")
    past = b.join(order, "t").select(F.col("nxt").alias("t"), "symbol")
    return past.join(b.withColumn("kept", F.lit(1)), ["t", "symbol"], "left").groupBy("t").agg(r(1 - F.count("kept") / 4).alias("turnover"))


# ---- structure, direction and stability -------------------------------------------------------------------------------------------


def _returns_matrix(spark, sf, members: int = 20):
    """Bars by the symbols with the most of them, and the index: a calendar by ``members`` columns, NaN where a symbol has no return."""
    import numpy as np

    ret = bar_returns(spark, sf).filter("r is not null").select("symbol", "t", "r")
    top = ret.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "symbol").limit(members).select("symbol")
    long = ret.join(F.broadcast(top), "symbol").join(index(spark, sf), "t").toArrow()
    bars_, row = np.unique(long["t"].to_numpy(), return_inverse=True)
    names, col = np.unique(long["symbol"].to_pylist(), return_inverse=True)
    x, m = np.full((len(bars_), len(names)), np.nan), np.full(len(bars_), np.nan)
    x[row, col], m[row] = long["r"].to_numpy(), long["r_m"].to_numpy()
    return x, m


def _pairwise(x):
    """Correlations of columns over the rows that both have; 0 where they share fewer than three."""
    import numpy as np

    has = ~np.isnan(x)
    v, h = np.where(has, x, 0.0), has.astype(float)
    n = h.T @ h
    with np.errstate(invalid="ignore", divide="ignore"):
        mean, other = (v.T @ h) / n, (h.T @ v) / n
        sq = (v * v).T @ h
        cov = (v.T @ v) / n - mean * other
        var = np.sqrt(np.maximum(sq / n - mean * mean, 0) * np.maximum(sq.T / n - other * other, 0))
        c = np.where((n > 2) & (var > 0), cov / var, 0.0)
    np.fill_diagonal(c, 1.0)
    return c


@query()
def factor_structure(spark, sf):
    """Shares of the first two principal components of twenty symbols' returns, the second one's 95 % interval from resampled bars, and how the first one goes with the index."""
    import numpy as np

    x, market_ret = _returns_matrix(spark, sf)
    kinds = "bars bigint, pc1 double, pc2 double, pc2_low double, pc2_high double, corr_index double"
    if len(x) < 30 or x.shape[1] < 2:
        return spark.createDataFrame([(len(x), None, None, None, None, None)], kinds)
    shares = selection.eigen_shares(_pairwise(x))
    rng = np.random.default_rng(5)
    draws = [selection.eigen_shares(_pairwise(x[rng.integers(0, len(x), len(x))]))[1] for _ in range(200)]
    z = np.nan_to_num((x - np.nanmean(x, axis=0)) / np.nanstd(x, axis=0))
    first = np.linalg.eigh(_pairwise(x))[1][:, -1]
    rho = abs(float(np.corrcoef(z @ first, market_ret)[0, 1]))
    row = (len(x), *(round(float(v), 6) for v in (shares[0], shares[1], np.quantile(draws, 0.025), np.quantile(draws, 0.975), rho)))
    return spark.createDataFrame([row], kinds)


@query()
def ic_interval(spark, sf):
    """Mean rank correlation of each feature and its 95 % interval from moving blocks of bars, whose order the blocks keep."""
    import numpy as np

    rows = []
    for f in FEATS:
        v = np.array([v.ic for v in bar_ics(spark, sf).filter(F.col("feature") == f).orderBy("t").select("ic").collect()], float)
        low, high = selection.block_bootstrap(v, 21, 500, 3) if len(v) else (None, None)
        rows.append((f, len(v), round(float(v.mean()), 6) if len(v) else None, round(low, 6) if len(v) else None, round(high, 6) if len(v) else None))
    return spark.createDataFrame(rows, "feature string, bars bigint, ic double, low double, high double")


@query()
def ridge_grid(spark, sf):
    """A ridge's mean rank correlation by its penalty, on the bars it is fitted on and on the later ones."""
    x = selection.centred_ranks(labels(spark, sf).filter("beta is not null and sigma is not null"), FEATS, T)
    cols, out = [f"r_{f}" for f in FEATS], None
    for alpha in (1.0, 10.0, 100.0, 1000.0):
        beta = selection.ridge_fit(x.filter(F.col("t") < FEB), cols, "y", alpha)
        ic = xs.bar_ic(selection.ridge_score(x, cols, beta), "score", "y", T, 8)
        ic = ic.agg(F.lit(alpha).alias("alpha"), r(F.avg(F.when(F.col("t") < FEB, F.col("ic")))).alias("fitted"), r(F.avg(F.when(F.col("t") >= FEB, F.col("ic")))).alias("later"))
        out = ic if out is None else out.unionByName(ic)
    return out


@query()
def seed_stability(spark, sf):
    """Boosted trees by seed, with rows drawn at random: mean rank correlation on later bars for each, and again for the first one."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    x = selection.centred_ranks(labels(spark, sf).filter("beta is not null and sigma is not null and y is not null"), FEATS, T)
    x = VectorAssembler(inputCols=[f"r_{f}" for f in FEATS], outputCol="v").transform(x)
    train, out = x.filter(F.col("t") < FEB).repartition(4, "symbol").sortWithinPartitions("symbol", "t"), None
    for run, seed in enumerate((1, 2, 1)):
        model = GBTRegressor(featuresCol="v", labelCol="y", predictionCol="score", maxIter=4, maxDepth=3, subsamplingRate=0.7, seed=seed).fit(train)
        ic = xs.bar_ic(model.transform(x.filter(F.col("t") >= FEB)), "score", "y", T, 8).agg(F.lit(run).alias("run"), F.lit(seed).alias("seed"), r(F.avg("ic")).alias("ic"))
        out = ic if out is None else out.unionByName(ic)
    return out


_GRIDPX = "select g.symbol, g.t, p.px from (select symbol, unnest(generate_series(min(t), max(t), 28800000)) as t from panel group by symbol) g left join panel p using (symbol, t)"


def _dense_px(spark, sf):
    from gridloom.operators.grid import densify

    return densify(panel(spark, sf).select("symbol", "t", "px"), S, "t", STEP)


@query("select h, count(x * y) as n, round(corr(x, y), 6) as ic, round(avg(x * y) / stddev_samp(x * y) * sqrt(1095.0 / h), 4) as sharpe from (" + " union all ".join(f"select {h} as h, px / nullif(lag(px, 9) over w, 0) - 1 as x, case when t // 28800000 % {h} = 0 then lead(px, {h}) over w / nullif(px, 0) - 1 end as y from gp window w as (partition by symbol order by t)" for h in (1, 3, 9)) + ") where x is not null and y is not null group by h", gp=_GRIDPX)
def directional_ic(spark, sf):
    """How a nine-bar move goes with the next one, three or nine bars, on bars that don't overlap."""
    w = wn.along(S, "t")
    ratio = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0))) - 1
    px, bar = F.col("px"), F.floor(F.col("t") / F.lit(STEP))
    d = _dense_px(spark, sf).select(ratio(px, F.lag("px", 9).over(w)).alias("x"), F.array(*[F.struct(F.lit(h).alias("h"), F.when(bar % h == 0, ratio(F.lead("px", h).over(w), px)).alias("y")) for h in (1, 3, 9)]).alias("v"))
    d = d.select("x", F.inline("v")).filter("x is not null and y is not null")
    xy = F.col("x") * F.col("y")
    return d.groupBy("h").agg(F.count(F.lit(1)).alias("n"), r(corr("x", "y")).alias("ic"), (F.avg(xy) / F.stddev_samp(xy)).alias("q")).select("h", "n", "ic", r(F.col("q") * F.sqrt(F.lit(1095.0) / F.col("h")), 4).alias("sharpe"))


@query("select n, count(y) as rows, round(avg(y), 9) as hold, round(avg(case when x > 0 then y else 0 end), 9) as long_flat, round(avg(sign(x) * y), 9) as long_short from (" + " union all ".join(f"select {n} as n, px / nullif(lag(px, {n}) over w, 0) - 1 as x, lead(px) over w / nullif(px, 0) - 1 as y from gp window w as (partition by symbol order by t)" for n in (21, 90)) + ") where x is not null and y is not null group by n", gp=_GRIDPX)
def momentum_rules(spark, sf):
    """Holding, holding while the trend is up, and going with the trend, for two lengths of it."""
    w = wn.along(S, "t")
    ratio = lambda a, b: F.try_divide(a, F.nullif(b, F.lit(0.0))) - 1
    d = _dense_px(spark, sf).select(ratio(F.lead("px").over(w), F.col("px")).alias("y"), F.array(*[F.struct(F.lit(n).alias("n"), ratio(F.col("px"), F.lag("px", n).over(w)).alias("x")) for n in (21, 90)]).alias("v"))
    d = d.select("y", F.inline("v")).filter("x is not null and y is not null")
    y = F.col("y")
    return d.groupBy("n").agg(F.count(F.lit(1)).alias("rows"), r(F.avg(y), 9).alias("hold"), r(F.avg(F.when(F.col("x") > 0, y).otherwise(0.0)), 9).alias("long_flat"), r(F.avg(F.signum("x") * y), 9).alias("long_short"))


_NEUTRAL = "select t, 'dollar' as kind, beta, fwd_ret, funding, d1 as x from dd union all select t, 'beta', beta, fwd_ret, funding, d1 - coalesce(covar_pop(d1, beta) over (partition by t) / nullif(var_pop(beta) over (partition by t), 0), 0) * (beta - avg(beta) over (partition by t)) from dd"


@query("select kind, count(*) as bars, round(avg(abs(exposure)), 7) as exposure, round(avg(ret), 9) as mean from (select kind, t, sum(w * beta) as exposure, sum(w * fwd_ret) - sum(w * funding) as ret from (select *, x / nullif(sum(abs(x)) over (partition by kind, t), 0) as w from nb) group by kind, t) where ret is not null group by kind", pb=_PB, dd="select *, dv - avg(dv) over (partition by t) as d1 from (select *, (p - avg(p) over (partition by t)) / nullif(sigma, 0) as dv from pb where n >= 8)", nb=_NEUTRAL)
def neutral_books(spark, sf):
    """The book neutral to money and the one neutral to beta: what exposure is left, and the mean return."""
    out = None
    for kind, cfg in (("dollar", market.BookConfig()), ("beta", market.BookConfig(beta_neutral=True))):
        w = market.book_weights(book(spark, sf), cfg).groupBy("t").agg(F.sum(F.col("w") * F.col("beta")).alias("e"), (F.sum(F.col("w") * F.col("fwd_ret")) - F.sum(F.col("w") * F.col("funding"))).alias("ret")).filter("ret is not null")
        g = w.agg(F.lit(kind).alias("kind"), F.count(F.lit(1)).alias("bars"), r(F.avg(F.abs("e")), 7).alias("exposure"), r(F.avg("ret"), 9).alias("mean"))
        out = g if out is None else out.unionByName(g)
    return out


# ---- audits -------------------------------------------------------------------------------------------------------------------------

_CHECKS = {
    "repeats": "count(*) - count(distinct (symbol, open_time, open, high, low, close, close_time))", "high_below_low": "count(case when high < low then 1 end)", "close_outside": "count(case when not isnan(close) and (close > high or close < low) then 1 end)",
    "no_close": "count(case when close is null or isnan(close) then 1 end)", "negative_volume": "count(case when volume < 0 then 1 end)", "closed_before_open": "count(case when close_time <= open_time then 1 end)", "buyers_above_all": "count(case when taker_buy_quote_volume > quote_volume then 1 end)",
}


@query(" union all ".join(f"select '{k}' as check_name, cast({v} as bigint) as n from perp_klines" for k, v in _CHECKS.items()))
def data_audit(spark, sf):
    """Counts of what may not be in a table of bars, from one pass."""
    b = read(spark, sf, "perp_klines")
    cols = ["symbol", "open_time", "open", "high", "low", "close", "close_time"]
    checks = {k: F.expr(v) for k, v in _CHECKS.items() if k != "repeats"} | {"repeats": F.count(F.lit(1)) - F.count_distinct(F.struct(*cols))}
    one = b.agg(*[c.cast("bigint").alias(k) for k, c in checks.items()])
    return one.unpivot([], list(checks), "check_name", "n")


@query("select symbol, count(*) as frozen from (select symbol, px, lag(px, 1) over w as p1, lag(px, 2) over w as p2 from panel window w as (partition by symbol order by t)) where px = p1 and p1 = p2 group by symbol")
def frozen_series(spark, sf):
    """Symbols whose price stood still over three bars, and how often."""
    w = wn.along(S, "t")
    p = panel(spark, sf).select("symbol", "px", F.lag("px", 1).over(w).alias("p1"), F.lag("px", 2).over(w).alias("p2")).filter("px = p1 and p1 = p2")
    return p.groupBy("symbol").agg(F.count(F.lit(1)).alias("frozen"))


@query("select round(max(abs(net)), 9) as net, round(max(abs(gross_w - 1)), 9) as off_gross, round(max(top), 6) as top_share, count(*) as bars from (select t, sum(w) as net, sum(abs(w)) as gross_w, max(abs(w)) as top from bw group by t having sum(abs(w)) > 0)", pb=_PB, bw=_BW)
def strategy_audit(spark, sf):
    """What must hold of a book in every bar: weights sum to nothing, their sizes to one, and none is too large."""
    w = market.book_weights(book(spark, sf)).groupBy("t").agg(F.sum("w").alias("net"), F.sum(F.abs("w")).alias("g"), F.max(F.abs("w")).alias("top")).filter("g > 0")
    return w.agg(r(F.max(F.abs("net")), 9).alias("net"), r(F.max(F.abs(F.col("g") - 1)), 9).alias("off_gross"), r(F.max("top")).alias("top_share"), F.count(F.lit(1)).alias("bars"))
