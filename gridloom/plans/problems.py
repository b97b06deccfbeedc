"""Queries p1, p2, p4, p5 and p7 over whole tables, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.containers import container_index, file_roles
from gridloom.operators.control_chart import ChartSpec, chart_readings, physical_limits
from gridloom.operators.doubling import trailing_totals
from gridloom.operators.seasonal import regular_grid
from gridloom.operators.validity import as_known_at

SLOT_MS = 28_800_000


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _read(spark, sf_dir, "returns_1h").select("symbol", "t", F.lit("ret").alias("field"), F.col("ret").alias("x"))
    b = _read(spark, sf_dir, "target_8h_lag60").select("symbol", F.col("t_obs").alias("t"), F.explode(F.array(F.struct(F.lit("fwd_ret").alias("field"), F.col("fwd_ret").alias("x")), F.struct(F.lit("target").alias("field"), F.col("target").alias("x")))).alias("v"))
    rows = a.unionByName(b.select("symbol", "t", "v.field", "v.x"))
    impossible = physical_limits(rows, "x", {"ret": -1.0, "fwd_ret": -1.0}, "field").filter("symbol is not null and t is not null")
    found = chart_readings(rows, ["symbol", "field"], "t", "x", ChartSpec()).select("symbol", "t", "field").unionByName(impossible.select("symbol", "t", "field")).distinct()
    return found.select(F.when(F.col("field") == "ret", "returns_1h").otherwise("target_8h_lag60").alias("src"), "symbol", "t", "field")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    est = _read(spark, sf_dir, "beta_idiovol_8h").filter("beta is not null and not isnan(beta) and sigma_eps is not null and not isnan(sigma_eps)")
    out = as_known_at(_read(spark, sf_dir, "decision_grid_8h"), "symbol", "t_obs", est, "symbol", "t_known", ["t_obs", "t_known"], [])
    return out.select("symbol", "t_obs", F.col("version_t_obs").alias("beta_t_obs"), F.col("version_t_known").alias("beta_t_known"))


def p2_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attributes themselves, beside the identity of the estimate."""
    est = _read(spark, sf_dir, "beta_idiovol_8h").filter("beta is not null and not isnan(beta) and sigma_eps is not null and not isnan(sigma_eps)")
    out = as_known_at(_read(spark, sf_dir, "decision_grid_8h"), "symbol", "t_obs", est, "symbol", "t_known", ["t_obs", "t_known"], ["beta", "sigma_eps"])
    return out.select("symbol", "t_obs", F.col("version_beta").alias("beta"), F.col("version_sigma_eps").alias("sigma_eps"), (F.col("t_obs") - F.col("version_t_known")).alias("age_ms"))


def p4_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container index of the whole log: where each packed archive lies, and why the others stay out."""
    return container_index(_read(spark, sf_dir, "files"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_roles(_read(spark, sf_dir, "files")).filter("role <> 'packed'").select("key")


def p5_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The regular grid of both sources, with observed, fitted and filled values."""
    live = _read(spark, sf_dir, "listings").filter(~F.col("symbol").startswith("IDX_")).withColumnRenamed("symbol", "k")
    live = live.withColumn("src", F.explode(F.array(F.lit("returns_1h"), F.lit("decision_grid_8h"))))
    a = _read(spark, sf_dir, "returns_1h").select(F.lit("returns_1h").alias("src"), F.col("symbol").alias("k"), "t", F.col("ret").alias("x"))
    b = _read(spark, sf_dir, "decision_grid_8h").select(F.lit("decision_grid_8h").alias("src"), F.col("symbol").alias("k"), F.col("t_obs").alias("t"), F.col("px_obs").alias("x"))
    return regular_grid(a.unionByName(b), live, SLOT_MS)


def p5_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each slot of both sources' grids holds: the total of its distinct readings (mean times number) and their number."""
    return p5_grid(spark, sf_dir).select("src", F.col("k").alias("symbol"), "live_from", "slot", F.round(F.col("observed") * F.col("n"), 7).alias("total"), "n")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_grid(spark, sf_dir).filter("state <> 'observed'").select("src", F.col("k").alias("symbol"), "slot").distinct()


def p7_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _read(spark, sf_dir, "returns_1h").select(F.col("symbol").alias("k"), "t", F.col("ret").alias("x"))
    b = _read(spark, sf_dir, "market_index_8h").select(F.col("index_id").alias("k"), F.col("t_obs").alias("t"), F.col("r_m").alias("x"))
    return trailing_totals(a.unionByName(b), _read(spark, sf_dir, "listings").withColumnRenamed("symbol", "k"), [7, 30])


def _day(days):
    return F.date_format(F.date_from_unix_date(days.cast("int")), "yyyy-MM-dd").alias("day")


def p7_trailing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals (in millionths), counts and averages over 7 and 30 days of every whole day."""
    t = p7_totals(spark, sf_dir)
    return t.select(F.col("k").alias("symbol"), _day(F.col("day")), "total_7", "n_7", F.round("mean_7", 9).alias("mean_7"), "total_30", "n_30", F.round("mean_30", 9).alias("mean_30"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_totals(spark, sf_dir).filter(F.signum("total_7") * F.signum("total_30") < 0).select(F.col("k").alias("symbol"), _day(F.col("day")))


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_attributes": p2_attributes, "p4_found": p4_found, "p4_index": p4_index, "p5_found": p5_found, "p5_grid": p5_grid, "p5_observed": p5_observed, "p7_found": p7_found, "p7_trailing": p7_trailing}

_P2 = """
with d as (select distinct symbol, t_obs from decision_grid_8h where symbol is not null and t_obs is not null),
e as (select distinct symbol, t_obs as b, t_known as k, beta, sigma_eps from beta_idiovol_8h where beta is not null and not isnan(beta) and sigma_eps is not null and not isnan(sigma_eps)),
j as (select d.symbol, d.t_obs, e.b, e.k, e.beta, e.sigma_eps, row_number() over (partition by d.symbol, d.t_obs order by e.b desc, e.k desc, e.beta desc, e.sigma_eps desc) as rn
from d join e on e.symbol = d.symbol and e.k <= d.t_obs)
"""

_P4 = """
with last as (
  select key, dataset, symbol, status, "rows" as n, lower(trim(sha256)) as sha, trim(period) as p,
    row_number() over (partition by key order by cast(replace(trim(updated_at), 'T', ' ') as timestamptz) desc nulls last, dataset desc, symbol desc, period desc) as rn
  from files where key is not null),
ok as (select *, case when regexp_matches(p, '^\\d{6}(\\d{2})?$') then substr(p, 1, 6) else
    regexp_extract(p, '^(\\d{4})\\D(\\d{1,2})', 1) || lpad(regexp_extract(p, '^(\\d{4})\\D(\\d{1,2})', 2), 2, '0') end as mon,
    regexp_matches(p, '^\\d{8}$') or regexp_matches(p, '^\\d{4}\\D\\d{1,2}\\D\\d{1,2}$') as daily
  from last where rn = 1 and status = 'converted' and n > 0),
f as (select key, min(key) over (partition by sha) as first_key, sha, daily,
    exists (select 1 from ok m where not m.daily and m.dataset = ok.dataset and m.symbol = ok.symbol and m.mon = ok.mon) as whole from ok)
select key from f where (daily and whole) or (sha is not null and first_key < key)
"""

_P5 = """
with s as (select distinct symbol, live_from, live_to from listings where not starts_with(symbol, 'IDX_')),
g as (select symbol, unnest(generate_series(cast(ceil(live_from / 28800000.0) as bigint) * 28800000, (live_to // 28800000) * 28800000 - 28800000, 28800000)) as slot from s),
a as (select distinct symbol, t // 28800000 * 28800000 as slot from returns_1h where ret is not null and not isnan(ret) and not isinf(ret)),
b as (select distinct symbol, t_obs // 28800000 * 28800000 as slot from decision_grid_8h where px_obs is not null and not isnan(px_obs))
select distinct 'returns_1h' as src, symbol, slot from (select * from g except select * from a)
union all select distinct 'decision_grid_8h', symbol, slot from (select * from g except select * from b)
"""

_P7 = """
with r as (select symbol as k, t, cast(round(round(x, 6) * 1000000) as bigint) as u from (
    select distinct symbol, t, ret as x from returns_1h union all select distinct index_id, t_obs, r_m from market_index_8h)
  where x is not null and not isnan(x) and abs(x) < 1),
l as (select distinct symbol as k, live_from, live_to from listings),
d as (select k, live_from, live_to, unnest(generate_series(cast(ceil(live_from / 86400000.0) as bigint), live_to // 86400000 - 1)) as day from l),
h as (select l.k, l.live_from, r.t // 86400000 as day, sum(u) as u, count(*) as n from r join l on r.k = l.k and r.t >= l.live_from and r.t < l.live_to group by all),
w as (select d.k, d.live_from, d.day, coalesce(sum(u) filter (h.day > d.day - 7), 0) as a, coalesce(sum(n) filter (h.day > d.day - 7), 0) as na, coalesce(sum(u), 0) as b, coalesce(sum(n), 0) as nb
  from d left join h on h.k = d.k and h.live_from = d.live_from and h.day > d.day - 30 and h.day <= d.day group by all)
"""

ORACLE = {
    "p1_found": """
with r as (select 'returns_1h' as src, symbol, t, 'ret' as field, ret as x from returns_1h
  union all select 'target_8h_lag60', symbol, t_obs, 'fwd_ret', fwd_ret from target_8h_lag60
  union all select 'target_8h_lag60', symbol, t_obs, 'target', target from target_8h_lag60),
u as (select distinct * from r where x is not null and not isnan(x)),
q as (select src, symbol, field, median(x) as m, greatest(quantile_cont(x, 0.84) - quantile_cont(x, 0.16), (quantile_cont(x, 0.975) - quantile_cont(x, 0.025)) / 1.96) / 2 as s
  from u where not isinf(x) group by all),
n as (select src, symbol, field, avg(x) as m, stddev_pop(x) as s from u join q using (src, symbol, field) where abs(x - q.m) <= 8 * q.s group by all),
e as (select *, case when abs(x - lag(x) over w) <= 1e-9 * greatest(abs(x), abs(lag(x) over w)) and not isinf(x) and not isinf(lag(x) over w) then 0 else 1 end as fresh
  from u window w as (partition by src, symbol, field order by t, x)),
i as (select *, sum(fresh) over (partition by src, symbol, field order by t, x) as run from e),
z as (select *, count(*) over (partition by src, symbol, field, run) as len from i)
select distinct z.src, z.symbol, z.t, z.field from z left join n using (src, symbol, field)
where isinf(x) or (z.field <> 'target' and x <= -1) or abs(x - n.m) > 10 * n.s or len >= 6
""",
    "p2_found": _P2 + "select symbol, t_obs, b as beta_t_obs, k as beta_t_known from j where rn = 1",
    "p2_attributes": _P2 + "select symbol, t_obs, beta, sigma_eps, t_obs - k as age_ms from j where rn = 1",
    "p4_found": _P4,
    "p5_found": _P5,
    "p5_observed": """
with s as (select distinct symbol, live_from, live_to from listings where not starts_with(symbol, 'IDX_')),
g as (select symbol, live_from, unnest(generate_series(cast(ceil(live_from / 28800000.0) as bigint) * 28800000, (live_to // 28800000) * 28800000 - 28800000, 28800000)) as slot from s),
r as (select distinct 'returns_1h' as src, symbol, t, ret as x from returns_1h union all select distinct 'decision_grid_8h', symbol, t_obs, px_obs from decision_grid_8h),
m as (select src, symbol, t // 28800000 * 28800000 as slot, avg(x) as observed, count(*) as n from r where x is not null and not isnan(x) and not isinf(x) group by all)
select k.src, g.symbol, g.live_from, g.slot, round(m.observed * m.n, 7) as total, coalesce(m.n, 0) as n
from g, (values ('returns_1h'), ('decision_grid_8h')) k(src) left join m on m.src = k.src and m.symbol = g.symbol and m.slot = g.slot
""",
    "p7_found": _P7 + "select k as symbol, strftime(make_date(cast(day as int)), '%Y-%m-%d') as day from w where a * b < 0",
    "p7_trailing": _P7 + "select k as symbol, strftime(make_date(cast(day as int)), '%Y-%m-%d') as day, cast(a as bigint) as total_7, cast(na as bigint) as n_7, round(a / 1e6 / nullif(na, 0), 9) as mean_7, cast(b as bigint) as total_30, cast(nb as bigint) as n_30, round(b / 1e6 / nullif(nb, 0), 9) as mean_30 from w",
}
