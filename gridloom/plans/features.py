"""Nine feature families over point-in-time datasets. Each returns (symbol, t, features...) as one lazy plan.

Windows by symbol run over the dense grid of bars (a calendar) only. Tapes
and hourly readings are raw rows: what looks back in them runs in blocks with a
halo (``operators.rolling``), and is reduced to bar buckets, keyed by (symbol,
bar), which combine on the map side. Window sizes are rows; the grid's step is ``ctx.step``.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators import windows as wn
from gridloom.operators import xsec as xs
from gridloom.operators.asof import asof_join
from gridloom.operators.grid import densify
from gridloom.operators.rolling import home, in_blocks, rolled, rolling_pair_beta, rolling_pair_corr

HOUR = 3_600_000
S = ["symbol"]
B = ["symbol", "__block"]


@dataclass(frozen=True)
class Context:
    """Datasets by name. panel: symbol, t, px, qv. index: t, r_m. betas: symbol, t, beta, sigma.
    tape and spot: symbol, t, open, high, low, close, volume, quote_volume, trade_count, taker_buy_quote_volume.
    premium: symbol, t, close, high, low. funding: symbol, t, rate. oi: symbol, t, oi, oi_value.
    hourly: symbol, t, r, r_m. delivery: contract, t, expiry, px. weights: symbol, t, weight.
    sectors: symbol, g, with few symbols to a sector, since its pairs are formed. lead: two context symbols.
    ``cutoff`` bounds every dataset; ``sealed`` names what a feature may not read.
    """

    data: dict[str, DataFrame]
    step: int = 8 * HOUR
    cutoff: int | None = None
    lead: tuple[str, str] = ("", "")
    sealed: frozenset[str] = field(default_factory=lambda: frozenset({"target", "forward"}))

    def scan(self, name: str) -> DataFrame:
        if name in self.sealed:
            raise PermissionError(f"a feature may not read {name}")
        df = self.data[name]
        return df.filter(F.col("t") < self.cutoff) if self.cutoff is not None and "t" in df.columns else df


class Family(ABC):
    """A feature family: its inputs, what it emits, and a lazy plan for it."""

    name: str
    inputs: tuple[str, ...]
    features: tuple[str, ...]
    context: tuple[str, ...] = ()  # features equal for all symbols of a bar
    warmup_bars: int = 0

    def __init__(self, least: float = 1.0) -> None:
        """``least`` scales the least counts (not the windows), for tapes sparser than one row a minute."""
        self.least = least

    def m(self, n: int) -> int:
        return max(2, round(n * self.least))

    def z30(self, x: str) -> tuple:
        return ("z", x, 90, self.m(54))

    @abstractmethod
    def compute(self, ctx: Context) -> DataFrame: ...

    def build(self, ctx: Context) -> DataFrame:
        """The emitted features on the panel's keys, with infinities as NULL."""
        out = self.compute(ctx)
        keys = ctx.scan("panel").select("symbol", "t")
        clean = [F.when(F.abs(F.col(c)) < F.lit(float("inf")), F.col(c).cast("double")).alias(c) for c in self.features]
        return out.select("symbol", "t", *clean).join(keys, ["symbol", "t"], "left_semi")

    def availability(self, ctx: Context) -> DataFrame:
        """feature, rows, usable: counted from ``warmup_bars`` steps after each symbol's first row on."""
        d = self.build(ctx)
        first = F.min("t").over(W.partitionBy("symbol"))
        d = d.withColumn("__first", first).filter(F.col("t") >= F.col("__first") + self.warmup_bars * ctx.step)
        long = d.unpivot(["symbol", "t"], list(self.features), "feature", "v")
        return long.groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.count("v").alias("usable"))


def lag(x: str | Column, k: int = 1, key: list[str] = S) -> Column:
    return F.lag(x, k).over(wn.along(key, "t"))


def grid_roll(d: DataFrame, **outputs: tuple) -> DataFrame:
    return rolled(d, S, "t", outputs)


def div(a, b) -> Column:
    b = b if isinstance(b, Column) else F.col(b)
    return F.try_divide(a if isinstance(a, Column) else F.col(a), F.nullif(b, F.lit(0.0)))


def ln(x: Column) -> Column:
    return F.when(x > 0, F.log(x))


def dense_panel(ctx: Context) -> DataFrame:
    """The dense grid with r (gap-aware), r_m, beta, sigma and e8 = (r - beta r_m) / sigma."""
    d = densify(ctx.scan("panel").select("symbol", "t", "px", "qv"), S, "t", ctx.step)
    d = d.join(ctx.scan("betas").select("symbol", "t", "beta", "sigma"), ["symbol", "t"], "left").join(ctx.scan("index").select("t", "r_m"), "t", "left")
    d = d.withColumn("r", wn.gap_return("px", "t", S, ctx.step))
    return d.withColumn("e8", div(F.col("r") - F.col("beta") * F.col("r_m"), "sigma"))


def tape_returns(tape: DataFrame, log: bool = False) -> DataFrame:
    """ret, the return between successive rows of a tape, and ret1, the one before. Worked out in blocks."""
    t = in_blocks(tape, S, "t", 2)
    ratio = F.try_divide(F.col("close"), F.nullif(lag("close", 1, B), F.lit(0.0)))
    t = t.withColumn("ret", ln(ratio) if log else ratio - 1)
    return home(t.withColumn("ret1", lag("ret", 1, B)))


def tape_range(tape: DataFrame, rows: int, least: int) -> DataFrame:
    """symbol, t, hi, lo: the highest high and lowest low of the last ``rows`` rows of a tape, NULL below ``least`` of either."""
    t = rolled(in_blocks(tape.select("symbol", "t", "high", "low"), S, "t", rows), B, "t", {"hi": ("max", "high", rows, least), "lo": ("min", "low", rows, least)})
    return home(t).select("symbol", "t", "hi", "lo")


def bucket(ctx: Context) -> Column:
    """The bar whose window (bar - step, bar] holds t."""
    return (F.ceil(F.col("t") / F.lit(ctx.step)).cast("bigint") * ctx.step).alias("t")


def attach(panel: DataFrame, buckets: DataFrame) -> DataFrame:
    return panel.join(buckets, ["symbol", "t"], "left")


def last_at(d: DataFrame, facts: DataFrame, values: list[str], **more) -> DataFrame:
    return asof_join(d, facts, S, "t", "t", values, **more).drop("asof_time")


class Carry(Family):
    name, inputs, features, warmup_bars = "A", ("panel", "funding"), ("funding_z", "funding_cum_7d", "funding_sign_persist", "crowd_winning"), 90

    def compute(self, ctx):
        f = grid_roll(ctx.scan("funding").select("symbol", "t", "rate"), funding_z=self.z30("rate"), funding_cum_7d=("sum", "rate", 21, self.m(12)))
        f = wn.signed_run(f, "rate", S, "t", "funding_sign_persist")
        p = densify(ctx.scan("panel").select("symbol", "t", "px"), S, "t", ctx.step).withColumn("r", wn.gap_return("px", "t", S, ctx.step))
        p = asof_join(grid_roll(p, rz=self.z30("r")), f, S, "t", "t", ["funding_z", "funding_cum_7d", "funding_sign_persist"], tolerance=9 * HOUR)
        return p.withColumn("crowd_winning", F.col("funding_z") * F.col("rz"))


class Positioning(Family):
    name, inputs, features, warmup_bars = "B", ("panel", "oi", "tape", "hourly"), ("oi_velocity_24h", "oi_price_corr", "oi_per_trade", "turnover"), 90

    def compute(self, ctx):
        oi = ctx.scan("oi").select("symbol", "t", "oi", "oi_value")
        p = last_at(densify(ctx.scan("panel").select("symbol", "t", "px", "qv"), S, "t", ctx.step), oi, ["oi", "oi_value"], tolerance=2 * HOUR)
        n = ctx.scan("tape").groupBy("symbol", bucket(ctx)).agg(F.sum("trade_count").alias("trades"))
        h = in_blocks(last_at(ctx.scan("hourly").select("symbol", "t", "r"), oi, ["oi"], tolerance=2 * HOUR), S, "t", 721)
        h = rolling_pair_corr(h.withColumn("doi", div("oi", lag("oi", 1, B)) - 1), B, "t", "doi", "r", 720, self.m(432), "oi_price_corr")
        p = last_at(attach(p, n), home(h).select("symbol", "t", "oi_price_corr"), ["oi_price_corr"], tolerance=2 * HOUR)
        return p.withColumns({"oi_velocity_24h": div("oi", lag("oi", 3)) - 1, "oi_per_trade": div(F.col("oi") - lag("oi"), F.col("trades").cast("double")), "turnover": div("qv", "oi_value")})


class Liquidity(Family):
    name, inputs, warmup_bars = "C", ("panel", "tape", "premium"), 90
    features = ("zero_return_minutes", "roll_spread", "kyle_lambda", "vpin_perp_z", "corwin_schultz", "premium_reversion_speed")

    def compute(self, ctx):
        t = tape_returns(ctx.scan("tape")).withColumn("signed", 2 * F.col("taker_buy_quote_volume") - F.col("quote_volume"))
        x, y = _both("ret", "ret1")
        u, v = _both("signed", "ret")
        b = t.groupBy("symbol", bucket(ctx)).agg(
            F.count(F.when(F.col("ret") == 0, 1)).cast("double").alias("zero_return_minutes"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.count(x).alias("n1"),
            F.count(u).alias("n"), F.var_pop(u).alias("vs"), F.covar_pop(u, v).alias("cs"), F.sum("signed").alias("net"), F.sum("quote_volume").alias("qs"),
        )
        q = in_blocks(ctx.scan("premium").select("symbol", "t", F.col("close").alias("p")), S, "t", 1)
        q = home(q.withColumn("p1", lag("p", 1, B)))
        u, v = _both("p1", "p")
        q = q.groupBy("symbol", bucket(ctx)).agg(F.sum(u).alias("qx"), F.sum(v).alias("qy"), F.sum(u * v).alias("qxy"), F.sum(u * u).alias("qxx"), F.count(u).alias("qn"))
        d = attach(attach(densify(ctx.scan("panel").select("symbol", "t"), S, "t", ctx.step), b), q)
        d = last_at(d, tape_range(ctx.scan("tape"), 480, self.m(120)), ["hi", "lo"])
        # 24-hour windows at an 8-hour step are sums of three buckets.
        w3 = wn.rows(S, "t", 3)
        d = d.withColumns({f"w_{c}": F.sum(c).over(w3) for c in ("sx", "sy", "sxy", "n1", "qx", "qy", "qxy", "qxx", "qn")})
        g = lambda c: F.col(f"w_{c}")
        cov = (g("sxy") - F.try_divide(g("sx") * g("sy"), g("n1"))) / (g("n1") - 1)
        spread = F.when(cov < 0, 2 * F.sqrt(F.abs(cov))).when(cov.isNotNull(), 0.0)
        d = d.withColumns({
            "roll_spread": F.when(g("n1") > 1, spread),
            "kyle_lambda": F.when(F.col("n") >= self.m(30), div("cs", "vs")),
            "vpin": div(F.abs("net"), "qs"),
            "premium_reversion_speed": F.when(g("qn") >= self.m(30), div(g("qn") * g("qxy") - g("qx") * g("qy"), g("qn") * g("qxx") - g("qx") * g("qx"))),
            "b2": F.pow(ln(div("hi", "lo")), 2) + F.pow(ln(div(lag("hi"), lag("lo"))), 2),
            "g2": F.pow(ln(div(F.greatest(F.col("hi"), lag("hi")), F.least(F.col("lo"), lag("lo")))), 2),
        })
        k = 3 - 2 * math.sqrt(2)
        a = (F.sqrt(2 * F.col("b2")) - F.sqrt("b2")) / k - F.sqrt(F.col("g2") / k)
        d = d.withColumn("cs1", F.when(F.col("b2").isNotNull() & F.col("g2").isNotNull(), F.greatest(2 * (F.exp(a) - 1) / (1 + F.exp(a)), F.lit(0.0))))
        return grid_roll(d, vpin_perp_z=self.z30("vpin"), corwin_schultz=("mean", "cs1", 90, self.m(54)))


def _both(a: str, b: str) -> tuple[Column, Column]:
    """a and b, NULL where either is."""
    ok = F.col(a).isNotNull() & F.col(b).isNotNull()
    return F.when(ok, F.col(a)), F.when(ok, F.col(b))


class Path(Family):
    name, inputs, warmup_bars = "D", ("panel", "tape"), 90
    features = ("retail_attention_div", "volume_concentration", "close_vs_vwap", "move_timing", "realized_skew", "realized_kurt", "parkinson_ratio", "volume_return_coupling")

    def compute(self, ctx):
        x, qv, hl = F.col("ret"), F.col("quote_volume"), ln(div("high", "low"))
        size, flow = _both("size", "quote_volume")
        b = tape_returns(ctx.scan("tape")).withColumn("size", F.abs(x)).groupBy("symbol", bucket(ctx)).agg(
            F.count(x).alias("n"), F.sum("trade_count").cast("double").alias("trades"), F.sum(qv).alias("vol"), F.sum(qv * qv).alias("vol2"), F.sum(F.col("close") * qv).alias("pv"),
            F.sum(x * x).alias("s2"), F.sum(x * x * x).alias("s3"), F.sum(x * x * x * x).alias("s4"), F.sum("size").alias("sabs"), F.sum(hl * hl).alias("hl2"),
            F.count(size).alias("nc"), F.covar_pop(size, flow).alias("cq"), (F.stddev_pop(size) * F.stddev_pop(flow)).alias("sq"),
        )
        d = attach(densify(ctx.scan("panel").select("symbol", "t"), S, "t", ctx.step), b)
        # The prices as of the window's edges, from one as-of join.
        edges = {"p0": -ctx.step, "p1": HOUR - ctx.step, "p7": -HOUR, "p8": 0}
        at = d.select("symbol", F.col("t").alias("bar"), F.explode(F.array(*[F.struct(F.lit(k).alias("edge"), (F.col("t") + v).alias("t")) for k, v in edges.items()])).alias("e")).select("symbol", "bar", "e.edge", "e.t")
        at = last_at(at, ctx.scan("tape").select("symbol", "t", "close"), ["close"])
        at = at.groupBy("symbol", F.col("bar").alias("t")).agg(*[F.max(F.when(F.col("edge") == k, F.col("close"))).alias(k) for k in edges])
        d = attach(d, at).withColumns({"lt": ln(F.col("trades")), "lv": ln(F.col("vol"))})
        d = grid_roll(d, lt30=("mean", "lt", 90, self.m(54)), lv30=("mean", "lv", 90, self.m(54)))
        ok = lambda c: F.when(F.col("n") >= self.m(60), c)
        n = F.col("n")
        return d.withColumns({
            "retail_attention_div": ok((F.col("lt") - F.col("lt30")) - (F.col("lv") - F.col("lv30"))),
            "volume_concentration": ok(div("vol2", F.col("vol") * F.col("vol"))),
            "close_vs_vwap": ok(div("p8", div("pv", "vol")) - 1),
            "move_timing": ok(div((div("p1", "p0") - 1) - (div("p8", "p7") - 1), "sabs")),
            "realized_skew": ok(div(F.sqrt("n") * F.col("s3"), F.pow("s2", F.lit(1.5)))),
            "realized_kurt": ok(div(n * F.col("s4"), F.col("s2") * F.col("s2"))),
            "parkinson_ratio": ok(div(F.sqrt(F.coalesce("hl2", F.lit(0.0)) / (4 * math.log(2) * n)), F.sqrt(F.col("s2") / n))),
            "volume_return_coupling": ok(F.when(F.col("nc") >= self.m(30), div("cq", "sq"))),
        })


class Regime(Family):
    name, inputs, warmup_bars = "E", ("panel", "index", "betas"), 270
    features = ("resid_reversal_8h", "variance_ratio_72h", "reversal_x_vr", "beta_momentum", "beta_instability", "idio_vol_momentum", "drawdown_from_peak", "volume_share_rotation", "session_rel_volume")

    def compute(self, ctx):
        d = dense_panel(ctx).withColumn("raw", F.col("e8") * F.col("sigma"))  # back in units of return
        d = grid_roll(grid_roll(d, raw9=("sum", "raw", 9, 9)), v9=("var", "raw9", 270, self.m(162)), v1=("var", "raw", 270, self.m(162)), beta_instability=("std", "beta", 90, self.m(54)), peak=("max", "px", 90, self.m(54)))
        d = d.withColumn("variance_ratio_72h", div("v9", 9 * F.col("v1")))
        d = d.withColumn("l", ln(F.col("qv"))).withColumn("hour", F.floor(F.col("t") / F.lit(HOUR)) % 24)
        d = rolled(d, ["symbol", "hour"], "t", {"usual": ("mean", "l", 30, self.m(15))}).withColumn("session_rel_volume", F.col("l") - F.col("usual"))
        d = d.withColumns({
            "resid_reversal_8h": -F.col("e8"), "beta_momentum": F.col("beta") - lag("beta", 90),
            "idio_vol_momentum": div("sigma", lag("sigma", 90)) - 1, "drawdown_from_peak": div("px", "peak") - 1,
        })
        d = d.withColumn("reversal_x_vr", F.col("resid_reversal_8h") * (1 - F.col("variance_ratio_72h")))
        total = d.groupBy("t").agg(F.sum("qv").alias("total"))
        d = d.join(total, "t").withColumn("share", div("qv", "total"))
        return d.withColumn("volume_share_rotation", F.col("share") - lag("share", 3))


class Relational(Family):
    name, inputs, warmup_bars = "F", ("panel", "index", "betas", "hourly", "sectors", "weights"), 270
    features = ("sector_rel_reversal_8h", "sector_rel_agreement", "coin_sector_corr", "btc_resid_lag", "corr_btc_8h_90d", "sector_cohesion", "sector_dispersion", "sector_belonging", "eth_resid_lag", "sector_decoupling", "dispersion_contribution")
    context = ("btc_resid_lag", "eth_resid_lag")
    horizons = (3, 9, 21)
    least_members = 10
    hourly_rows: tuple[tuple[int, int], ...] = ((720, 432), (2160, 1296))

    def compute(self, ctx):
        d = dense_panel(ctx).join(ctx.scan("sectors"), "symbol", "left").join(ctx.scan("weights").select("symbol", "t", "weight"), ["symbol", "t"], "left")
        d = d.withColumns({"x1": F.col("e8"), "l8": lag("e8")} | {f"r{h}": div("px", lag("px", h)) - 1 for h in self.horizons} | {f"w{h}": lag("weight", h) for h in self.horizons})
        # The market's return over a horizon, by the weights known when it opened; a residual in units of sigma and the root of its bars.
        has = {h: F.col(f"r{h}").isNotNull() & F.col(f"w{h}").isNotNull() for h in self.horizons}
        market = d.groupBy("t").agg(*[
            F.when(F.count(F.when(has[h], 1)) >= self.m(self.least_members), div(F.sum(F.when(has[h], F.col(f"r{h}") * F.col(f"w{h}"))), F.sum(F.when(has[h], F.col(f"w{h}"))))).alias(f"m{h}") for h in self.horizons
        ])
        d = d.join(market, "t", "left").withColumns({f"x{h}": div(F.col(f"r{h}") - F.col("beta") * F.col(f"m{h}"), F.col("sigma") * math.sqrt(h)) for h in self.horizons})
        spans = (1, *self.horizons)
        d = d.withColumns({f"rel{k}": F.col(f"x{k}") - xs.peer_mean(f"x{k}", ["t", "g"]) for k in spans})
        lead = {n: d.filter(F.col("symbol") == s).select("t", F.col("l8").alias(n), F.col("r").alias(f"{n}_r")) for n, s in zip(("btc_resid_lag", "eth_resid_lag"), ctx.lead)}
        for x in lead.values():
            d = d.join(x, "t", "left")
        bar, sec = W.partitionBy("t"), W.partitionBy("t", "g")
        rel = F.col("rel1")
        for k in self.horizons:
            rel = rel + F.col(f"rel{k}")
        d = d.withColumn("dev", F.abs(xs.demean("e8", ["t"]))).withColumns({
            "sector_rel_reversal_8h": -F.col("rel1"), "sector_rel_agreement": -rel / len(spans),
            "sector_dispersion": F.when(F.count("e8").over(sec) >= 2, F.stddev_samp("e8").over(sec)), "dispersion_contribution": div("dev", F.sum("dev").over(bar)),
        })
        d = rolling_pair_corr(d, S, "t", "r", "btc_resid_lag_r", 270, self.m(162), "corr_btc_8h_90d")
        d = last_at(d, self.hourly(ctx), ["coin_sector_corr", "sector_belonging", "sector_decoupling"], tolerance=ctx.step)
        return asof_join(d, self.cohesion(ctx), ["g"], "t", "t", ["sector_cohesion"], tolerance=ctx.step)

    def residuals(self, ctx) -> DataFrame:
        """Residuals on a whole-hour grid: r - beta r_m with the beta known at the hour."""
        h = ctx.scan("hourly").filter("r is not null and r_m is not null").groupBy("symbol", (F.ceil(F.col("t") / F.lit(HOUR)).cast("bigint") * HOUR).alias("t")).agg(F.sum("r").alias("r"), F.max("r_m").alias("r_m"))
        h = last_at(h, ctx.scan("betas"), ["beta"], skip_null=True).withColumn("u", F.col("r") - F.col("beta") * F.col("r_m"))
        return h.select("symbol", "t", "u").join(ctx.scan("sectors"), "symbol", "left")

    def hourly(self, ctx) -> DataFrame:
        h = self.residuals(ctx)
        h = h.withColumns({"peers": xs.peer_mean("u", ["t", "g"]), "others": xs.outside_mean("u", ["t"], ["g"])})
        (n1, m1), (n2, m2) = self.hourly_rows
        h = rolling_pair_corr(h, S, "t", "u", "peers", n2, self.m(m2), "coin_sector_corr")
        h = rolling_pair_corr(rolling_pair_corr(h, S, "t", "u", "peers", n1, self.m(m1), "c1"), S, "t", "u", "others", n2, self.m(m2), "co")
        return h.select("symbol", "t", "coin_sector_corr", (F.col("coin_sector_corr") - F.col("co")).alias("sector_belonging"), (F.col("c1") - F.col("coin_sector_corr")).alias("sector_decoupling"))

    def cohesion(self, ctx) -> DataFrame:
        """Mean pairwise rolling correlation inside each sector. Pairs are those of a sector's members at one hour."""
        h = self.residuals(ctx).filter("u is not null")
        a, b = h.select("g", "t", F.col("symbol").alias("a"), F.col("u").alias("ua")), h.select("g", "t", F.col("symbol").alias("b"), F.col("u").alias("ub"))
        n, m = self.hourly_rows[-1][0], self.m(self.hourly_rows[-1][1])
        pairs = rolling_pair_corr(a.join(b, ["g", "t"]).filter("a < b"), ["g", "a", "b"], "t", "ua", "ub", n, m, "c")
        return pairs.groupBy("g", "t").agg(F.avg("c").alias("sector_cohesion"))


class SpotPerp(Family):
    name, inputs, warmup_bars = "G", ("panel", "tape", "spot", "premium", "delivery"), 90
    features = ("basis_z", "perp_spot_vol_ratio", "aggressor_divergence", "perp_spot_return_gap", "perp_spot_leadlag", "perp_spot_tradecount_ratio", "premium_vol", "premium_time_above_zero", "premium_range", "term_basis_slope")
    context = ("term_basis_slope",)
    minute, week, least_minutes = 60_000, 10_080, 3_360

    def compute(self, ctx):
        tape, spot = ctx.scan("tape"), ctx.scan("spot")

        def flows(x: DataFrame, p: str) -> DataFrame:
            return x.groupBy("symbol", bucket(ctx)).agg(F.sum("quote_volume").alias(f"{p}q"), F.sum("taker_buy_quote_volume").alias(f"{p}b"), F.sum("trade_count").cast("double").alias(f"{p}n"))

        perp_px, spot_px = tape.select("symbol", "t", F.col("close").alias("pc")), spot.select("symbol", "t", F.col("close").alias("sc"))
        d = densify(ctx.scan("panel").select("symbol", "t"), S, "t", ctx.step)
        d = attach(attach(d, flows(tape, "p")), flows(spot, "s"))
        # The basis stands on the perp's clock: spot as of the perp's last row, not as of the bar.
        d = asof_join(d, perp_px, S, "t", "t", ["pc"]).withColumnRenamed("asof_time", "pt")
        d = asof_join(d, spot_px.withColumnRenamed("sc", "sp"), S, "pt", "t", ["sp"]).drop("asof_time")
        d = last_at(d, spot_px, ["sc"])
        q = ctx.scan("premium").groupBy("symbol", bucket(ctx)).agg(
            F.avg(F.col("close") * F.col("close")).alias("m2"), F.avg("close").alias("m1"), F.avg(F.when(F.col("close") > 0, 1.0).when(F.col("close").isNotNull(), 0.0)).alias("premium_time_above_zero")
        )
        d = attach(attach(d, q), self.lead_lag(ctx))
        d = last_at(d, tape_range(ctx.scan("premium"), 480, self.m(120)), ["hi", "lo"])
        d = d.withColumns({"basis": div("pc", F.when(F.col("sp") > 0, F.col("sp"))) - 1, "lq": ln(div("pq", F.when(F.col("sq") > 0, F.col("sq")))), "lnn": ln(div("pn", F.when(F.col("sn") > 0, F.col("sn"))))})
        d = grid_roll(d.join(self.front(ctx), "t", "left"), basis_z=self.z30("basis"), perp_spot_vol_ratio=self.z30("lq"), perp_spot_tradecount_ratio=self.z30("lnn"))
        return d.withColumns({
            "aggressor_divergence": div("pb", "pq") - div("sb", "sq"), "perp_spot_return_gap": div("pc", lag("pc")) - div("sc", lag("sc")),
            "premium_vol": F.sqrt(F.greatest(F.col("m2") - F.col("m1") * F.col("m1"), F.lit(0.0))), "premium_range": F.when(F.abs("m1") > 1e-9, (F.col("hi") - F.col("lo")) / F.abs("m1")),
        })

    def lead_lag(self, ctx) -> DataFrame:
        """corr(perp, spot a minute before) - corr(perp a minute before, spot) over a week of minutes: symbol, t, perp_spot_leadlag.

        Both prices stand on one minute grid, filled as of each minute from the
        perp's first row on. A filled price doesn't move, so only minutes with
        a reading have a return other than 0, and the sums of a week run over
        those; the minutes themselves are counted. A minute belongs to the
        first bar that has it, and a week is a whole number of bars.
        """
        origin = ctx.scan("tape").groupBy("symbol").agg(F.min("t").alias("t0"))

        def moves(x: DataFrame) -> DataFrame:
            i = F.greatest(F.ceil((F.col("t") - F.col("t0")) / F.lit(self.minute)).cast("bigint"), F.lit(0))
            last = x.select("symbol", "t", "close").join(origin, "symbol").groupBy("symbol", "t0", i.alias("i")).agg(F.max_by("close", "t").alias("close"))
            last = in_blocks(last.withColumn("t", F.col("t0") + F.col("i") * self.minute), S, "t", 1)
            return home(last.withColumn("ret", div("close", lag("close", 1, B)) - 1)).select("symbol", "t0", "i", "ret")

        perp, spot = moves(ctx.scan("tape")), moves(ctx.scan("spot"))
        begun = spot.groupBy("symbol").agg(F.min("i").alias("k"))
        out = None
        for name, x, dx, y, dy in (("c1", perp, 0, spot, 1), ("c2", perp, 1, spot, 0)):
            e = x.select("symbol", "t0", (F.col("i") + dx).alias("i"), F.col("ret").alias("x"), F.lit(None).cast("double").alias("y"))
            e = e.unionByName(y.select("symbol", "t0", (F.col("i") + dy).alias("i"), F.lit(None).cast("double").alias("x"), F.col("ret").alias("y")))
            e = e.groupBy("symbol", "t0", "i").agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("x"), F.coalesce(F.sum("y"), F.lit(0.0)).alias("y")).join(begun, "symbol")
            first = F.greatest(F.lit(1 + dx), F.col("k") + 1 + dy)  # the first minute at which both have a return
            bar = F.ceil((F.col("t0") + F.col("i") * self.minute) / F.lit(ctx.step)).cast("bigint") * ctx.step
            e = e.filter(F.col("i") >= first).groupBy("symbol", bar.alias("t")).agg(*[F.sum(v).alias(f"{name}_{c}") for c, v in (("x", F.col("x")), ("y", F.col("y")), ("xx", F.col("x") * F.col("x")), ("yy", F.col("y") * F.col("y")), ("xy", F.col("x") * F.col("y")))])
            out = e if out is None else out.join(e, ["symbol", "t"], "full_outer")
        d = attach(densify(ctx.scan("panel").select("symbol", "t"), S, "t", ctx.step).join(origin, "symbol").join(begun, "symbol"), out)
        i = F.floor((F.col("t") - F.col("t0")) / F.lit(self.minute)).cast("bigint")
        week = wn.rows(S, "t", self.week * self.minute // ctx.step)
        got = []
        for name, dx, dy in (("c1", 0, 1), ("c2", 1, 0)):
            first = F.greatest(F.lit(1 + dx), F.col("k") + 1 + dy)
            n = (i - F.greatest(first, i - self.week + 1) + 1).cast("double")
            s = {c: F.coalesce(F.sum(f"{name}_{c}").over(week), F.lit(0.0)) for c in ("x", "y", "xx", "yy", "xy")}
            vx, vy = s["xx"] - s["x"] * s["x"] / n, s["yy"] - s["y"] * s["y"] / n
            got.append(F.when((n >= self.m(self.least_minutes)) & (vx > 0) & (vy > 0), (s["xy"] - s["x"] * s["y"] / n) / (F.sqrt(vx) * F.sqrt(vy))))
        return d.select("symbol", "t", (got[0] - got[1]).alias("perp_spot_leadlag"))

    def front(self, ctx) -> DataFrame:
        """Annualised basis of the contract nearest to expiry, more than a day away, as of each bar: t, term_basis_slope."""
        quotes = ctx.scan("delivery").select("contract", "t", "px")
        contracts = ctx.scan("delivery").groupBy("contract").agg(F.max("expiry").alias("expiry"))
        bars = ctx.scan("panel").select("t").distinct()
        d = bars.join(F.broadcast(ctx.scan("delivery").sparkSession.createDataFrame([(ctx.lead[0],)], "symbol string")))
        d = last_at(d, ctx.scan("tape").filter(F.col("symbol") == ctx.lead[0]).select("symbol", "t", F.col("close").alias("ref")), ["ref"])
        d = d.crossJoin(contracts).filter(F.col("expiry") - F.col("t") > 24 * HOUR)  # a few contracts to each bar of the calendar
        d = asof_join(d, quotes, ["contract"], "t", "t", ["px"]).filter("px is not null")
        ttm = (F.col("expiry") - F.col("t")) / F.lit(365.0 * 24 * HOUR)
        ann = (div("px", F.when(F.col("ref") > 0, F.col("ref"))) - 1) / ttm
        return d.groupBy("t").agg(F.min_by(ann, F.struct(F.col("expiry").alias("m"), F.col("contract"))).alias("term_basis_slope"))


class Inherited(Family):
    name, inputs, warmup_bars = "H", ("panel", "index", "betas"), 360
    features = ("resid_lag_8h", "resid_lag_16h", "resid_lag_40h", "resid_sum_5", "resid_sum_20", "realized_vol_zscore_30d", "realized_vol_percentile_90d", "hurst_short_minus_long", "hurst_change")

    def compute(self, ctx):
        d = grid_roll(dense_panel(ctx).select("symbol", "t", "e8"), sd=("std", "e8", 90, self.m(54)), resid_sum_5=("sum", "e8", 5, self.m(3)), resid_sum_20=("sum", "e8", 20, self.m(12)))
        d = d.withColumns({"resid_lag_8h": lag("e8"), "resid_lag_16h": lag("e8", 2), "resid_lag_40h": lag("e8", 5)})
        d = hurst(grid_roll(d, realized_vol_zscore_30d=self.z30("sd")), "e8", {"h90": (90, self.m(54)), "h270": (270, self.m(162))})
        d = d.withColumns({"hurst_short_minus_long": F.col("h90") - F.col("h270"), "hurst_change": F.col("h90") - lag("h90", 90)})
        # Windows of the same values are equal but for the last digits, and tie.
        return wn.rolling_pct_rank(d.withColumn("level", F.round("sd", 10)), S, "t", "level", 270, self.m(162), "realized_vol_percentile_90d")


def hurst(d: DataFrame, x: str, outputs: dict[str, tuple[int, int]], lags: tuple[int, ...] = (1, 2, 4, 8, 16)) -> DataFrame:
    """Half the slope of log mean squared displacement of the running sum of x on log lag, over n rows with m values of each lag."""
    run = F.sum(F.coalesce(F.col(x), F.lit(0.0))).over(wn.along(S, "t").rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("__y", F.when(F.col(x).isNotNull(), run))
    d = d.withColumns({f"__d{k}": F.pow(F.col("__y") - lag("__y", k), 2) for k in lags})
    d = grid_roll(d, **{f"__m{k}_{n}": ("mean", f"__d{k}", n, m) for k in lags for n, m in outputs.values()})
    logs = [math.log(k) for k in lags]
    mid = sum(logs) / len(logs)
    den = sum((v - mid) ** 2 for v in logs)
    for out, (n, _) in outputs.items():
        slope = None
        for k, v in zip(lags, logs):
            part = ln(F.col(f"__m{k}_{n}")) * ((v - mid) / den)
            slope = part if slope is None else slope + part
        d = d.withColumn(out, slope / 2)
    return d.drop("__y", *[c for c in d.columns if c.startswith(("__d", "__m"))])


class Inherited2(Family):
    name, inputs, warmup_bars = "I", ("panel", "index", "betas", "tape", "spot", "hourly", "funding"), 90
    features = ("max_daily_ret_30d", "realized_vol_ratio_1h_24h", "beta_change_3d_7d", "bar_range_zscore_30d", "bar_close_location", "bpv_zscore_30d", "basis_abs", "basis_acceleration", "funding_rate_change", "funding_rate_lag_1", "funding_rate_lag_2")

    def compute(self, ctx):
        d = grid_roll(dense_panel(ctx), e3=("sum", "e8", 3, 2)).withColumn("day", div("px", lag("px", 3)) - 1)
        h = in_blocks(ctx.scan("hourly").select("symbol", "t", "r", "r_m"), S, "t", 720)
        h = rolled(h, B, "t", {"sd1h": ("std", "r", 720, self.m(432))})
        h = rolling_pair_beta(rolling_pair_beta(h, B, "t", "r", "r_m", 72, self.m(43), "b3"), B, "t", "r", "r_m", 168, self.m(100), "b7")
        h = home(h).select("symbol", "t", "sd1h", (F.col("b3") - F.col("b7")).alias("beta_change_3d_7d"))
        d = last_at(d, h, ["sd1h", "beta_change_3d_7d"])
        size, before = F.abs(F.coalesce("ret", F.lit(0.0))), F.abs(F.coalesce("ret1", F.lit(0.0)))
        b = tape_returns(ctx.scan("tape"), log=True).groupBy("symbol", bucket(ctx)).agg(F.sum(size * before).alias("bp"), F.sum(size * size).alias("rv"))
        d = last_at(attach(d, b), tape_range(ctx.scan("tape"), 480, self.m(120)), ["hi", "lo"])
        d = last_at(d, ctx.scan("spot").select("symbol", "t", F.col("close").alias("sc")), ["sc"])
        d = last_at(d, ctx.scan("tape").select("symbol", "t", F.col("close").alias("pc")), ["pc"])
        f = ctx.scan("funding").select("symbol", "t", "rate").withColumns({"funding_rate_lag_1": lag("rate"), "funding_rate_lag_2": lag("rate", 2)}).withColumn("funding_rate_change", F.col("rate") - F.col("funding_rate_lag_1"))
        d = last_at(d, f, ["funding_rate_change", "funding_rate_lag_1", "funding_rate_lag_2"])
        span = F.col("hi") - F.col("lo")
        d = d.withColumns({"range": div(span, F.when(F.col("pc") > 0, F.col("pc"))), "bpv": F.when(F.col("rv") > 0, F.col("bp") * (math.pi / 2) / F.col("rv")), "basis": div("pc", F.when(F.col("sc") > 0, F.col("sc"))) - 1})
        d = grid_roll(d, max_daily_ret_30d=("max", "day", 90, self.m(54)), sd3=("std", "e3", 90, self.m(54)), bar_range_zscore_30d=self.z30("range"), bpv_zscore_30d=self.z30("bpv"))
        return d.withColumns({
            "realized_vol_ratio_1h_24h": div(div(F.col("sd1h") * math.sqrt(8), "sigma"), F.col("sd3") / math.sqrt(3)),
            "bar_close_location": F.when(span > 0, (F.col("pc") - F.col("lo")) / span), "basis_abs": F.abs("basis"), "basis_acceleration": F.col("basis") - 2 * lag("basis") + lag("basis", 2),
        })


KINDS: tuple[type[Family], ...] = (Carry, Positioning, Liquidity, Path, Regime, Relational, SpotPerp, Inherited, Inherited2)
FAMILIES: dict[str, Family] = {f.name: f() for f in KINDS}
