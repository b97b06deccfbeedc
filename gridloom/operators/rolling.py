"""Rolling statistics whose cost per row doesn't grow with the window, and blocks for windows over raw rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.operators.skew import ordered_blocks, time_buckets

DAY_MS = 86_400_000
BLOCK_ROWS = 32_768
CANCELLED = 1e-12  # a variance below this share of the mean square is cancellation, not data


def in_blocks(rows: DataFrame, key: list[str], t: str, halo: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` cut into blocks of about ``block_rows`` in time order, each led by at least ``halo`` earlier rows (or all there are).

    Adds ``__block`` and ``__home``. Window functions by (key, ``__block``)
    that look back at most ``halo`` rows are right for the rows at home; drop
    the others after them (``home``). No task holds a key: the finest piece is
    a day of one, or less where it has more rows than a block. Rows with a NULL key or time are left out.
    """
    ok = F.col(t).isNotNull()
    for k in key:
        ok = ok & F.col(k).isNotNull()
    # That the day is known is said here, so that counts and rows read one exchange: only one side would infer it from the join.
    days = time_buckets(rows.filter(ok), key, t, DAY_MS, block_rows, "__bucket").filter("__bucket is not null").repartition(*key, "__bucket")
    return ordered_blocks(days, key, "__bucket", block_rows, halo)


def home(rows: DataFrame) -> DataFrame:
    return rows.filter("__home").drop("__home", "__block", "__bucket")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def window_sums(df: DataFrame, key: list[str], t: str, parts: dict[str, Column], windows: list[int]) -> DataFrame:
    """Sums of ``parts`` over the last n rows, as ``__{name}_{n}``: differences of running sums."""
    w = W.partitionBy(*key).orderBy(t)
    df = df.withColumns({f"__run_{k}": F.sum(v).over(w.rowsBetween(W.unboundedPreceding, 0)) for k, v in parts.items()})
    zero = F.lit(0.0)
    sums = {f"__{k}_{n}": F.col(f"__run_{k}") - F.coalesce(F.lag(f"__run_{k}", n).over(w), zero) for k in parts for n in sorted(set(windows))}
    return df.withColumns(sums).drop(*[f"__run_{k}" for k in parts])


def rolled(df: DataFrame, key: list[str], t: str, outputs: dict[str, tuple]) -> DataFrame:
    """Add ``{out: (fn, x, n, m)}``: fn of x over the last n rows, NULL below m values.

    fn: sum, mean, var, std (samples), z ((x - mean) / std; NULL where std is 0), max, min.
    Moments come from running sums, extremes from running extremes forward and
    backward in chunks of n rows, so a row costs the same whatever n is.
    """
    names = list(dict.fromkeys(_name(x) for _, x, _, _ in outputs.values()))
    short = {c: f"c{i}" for i, c in enumerate(names)}
    parts: dict[str, Column] = {}
    for fn, x, _, _ in outputs.values():
        c, v = short[x], F.col(x)
        has = v.isNotNull()
        parts[f"{c}n"] = F.when(has, 1.0).otherwise(0.0)
        if fn not in ("max", "min"):
            parts[f"{c}s"] = F.coalesce(v.cast("double"), F.lit(0.0))
        if fn in ("var", "std", "z"):
            parts[f"{c}q"] = F.coalesce(v.cast("double") * v, F.lit(0.0))
    df = window_sums(df, key, t, parts, [n for _, _, n, _ in outputs.values()])
    made: dict[str, Column] = {}
    extremes = {(fn, x, n) for fn, x, n, _ in outputs.values() if fn in ("max", "min")}
    if extremes:
        order = W.partitionBy(*key).orderBy(t)
        df = df.withColumn("__row", F.row_number().over(order).cast("long") - 1)
        for fn, x, n in sorted(extremes):
            f, c, chunk = (F.max if fn == "max" else F.min), short[x], F.floor(F.col("__row") / F.lit(n))
            up = W.partitionBy(*key, chunk).orderBy(t).rowsBetween(W.unboundedPreceding, 0)
            down = W.partitionBy(*key, chunk).orderBy(F.col(t).desc()).rowsBetween(W.unboundedPreceding, 0)
            df = df.withColumn(f"__suf_{fn}_{c}_{n}", f(F.col(x)).over(down)).withColumn(f"__pre_{fn}_{c}_{n}", f(F.col(x)).over(up))
            df = df.withColumn(f"__suf_{fn}_{c}_{n}", F.lag(f"__suf_{fn}_{c}_{n}", n - 1).over(order))
    for out, (fn, x, n, m) in outputs.items():
        c = short[x]
        g = lambda k: F.col(f"__{c}{k}_{n}")  # noqa: B023,E731
        if fn in ("max", "min"):
            value = (F.greatest if fn == "max" else F.least)(F.col(f"__pre_{fn}_{c}_{n}"), F.col(f"__suf_{fn}_{c}_{n}"))
        elif fn == "sum":
            value = g("s")
        else:
            mean = g("s") / F.nullif(g("n"), F.lit(0.0))
            if fn == "mean":
                value = mean
            else:
                gap = g("q") - g("s") * mean
                var = F.when(g("n") > 1, F.when(gap > CANCELLED * g("q"), gap).otherwise(0.0) / (g("n") - 1))
                value = {"var": var, "std": F.sqrt(var), "z": (F.col(x) - mean) / F.nullif(F.sqrt(var), F.lit(0.0))}[fn]
        made[out] = F.when(g("n") >= m, value)
    df = df.withColumns(made)
    return df.drop(*[c for c in df.columns if c.startswith(("__c", "__suf_", "__pre_", "__row"))])


def _name(x: str) -> str:
    if not isinstance(x, str):
        raise TypeError("name a column")
    return x


def paired_sums(df: DataFrame, key: list[str], t: str, x: str, y: str, n: int) -> tuple[DataFrame, dict[str, Column], list[str]]:
    """Counts, sums and products of the last n rows with both values, as columns to take apart and then drop."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")).otherwise(0.0), F.when(both, F.col(y).cast("double")).otherwise(0.0)
    parts = {"pn": F.when(both, 1.0).otherwise(0.0), "px": a, "py": b, "pxx": a * a, "pyy": b * b, "pxy": a * b}
    df = window_sums(df, key, t, parts, [n])
    g = {k[1:]: F.col(f"__{k}_{n}") for k in parts}
    gap = lambda q, s: F.when(q - s * s / F.nullif(g["n"], F.lit(0.0)) > CANCELLED * q, q - s * s / F.nullif(g["n"], F.lit(0.0)))
    got = {"n": g["n"], "sxx": gap(g["xx"], g["x"]), "syy": gap(g["yy"], g["y"]), "sxy": g["xy"] - g["x"] * g["y"] / F.nullif(g["n"], F.lit(0.0))}
    return df, got, [f"__{k}_{n}" for k in parts]


def rolling_pair_corr(df: DataFrame, key: list[str], t: str, x: str, y: str, n: int, m: int, out: str) -> DataFrame:
    """Pearson correlation over the rows of the last n with both values; NULL below m of them or without variance."""
    df, s, temps = paired_sums(df, key, t, x, y, n)
    return df.withColumn(out, F.when(s["n"] >= m, s["sxy"] / (F.sqrt(s["sxx"]) * F.sqrt(s["syy"])))).drop(*temps)


def rolling_pair_beta(df: DataFrame, key: list[str], t: str, y: str, x: str, n: int, m: int, out: str) -> DataFrame:
    """Slope of y on x over the rows of the last n with both values; NULL below m of them or without variance of x."""
    df, s, temps = paired_sums(df, key, t, x, y, n)
    return df.withColumn(out, F.when(s["n"] >= m, s["sxy"] / s["sxx"])).drop(*temps)


def rolling_regression(df: DataFrame, key: list[str], t: str, y: str, x: str, n: int, m: int) -> DataFrame:
    """Single-factor regression moments over the rows of the last n with both values: adds n_obs, beta, var_y, resid_var, se2."""
    df, s, temps = paired_sums(df, key, t, x, y, n)
    ok, k = s["n"] >= m, s["n"]
    sxx, syy, sxy = s["sxx"], F.coalesce(s["syy"], F.lit(0.0)), s["sxy"]
    beta = sxy / sxx
    rss = syy - sxy * beta
    left = F.nullif(k - 2, F.lit(0.0))
    return df.withColumns({
        "n_obs": k.cast("bigint"), "beta": F.when(ok, beta), "var_y": F.when(ok, syy / F.nullif(k - 1, F.lit(0.0))),
        "resid_var": F.when(ok, rss / left), "se2": F.when(ok, rss / left / sxx),
    }).drop(*temps)
