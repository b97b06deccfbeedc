"""Feature screening, closed-form models and resampling: sums on executors, small linear algebra on the driver."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.stats import corr
from gridloom.operators import windows as wn
from gridloom.operators import xsec as xs


def centred_ranks(df: DataFrame, features: list[str], bar: list[str], fill: bool = True) -> DataFrame:
    """Percentile ranks within the bar less their middle; a missing feature ranks in the middle if ``fill``."""
    out = df
    for f in features:
        p = xs.pct_rank(f, bar) - 0.5
        out = out.withColumn(f"r_{f}", F.coalesce(p, F.lit(0.0)) if fill else p)
    return out


def gram_frame(df: DataFrame, columns: list[str]) -> DataFrame:
    """name, v: n, sums (s_x) and sums of products (x_y) of complete rows, in one scan.

    Each partition folds its Arrow batches into one small matrix; the matrices are then summed.
    """
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    names = ["n", *[f"s_{c}" for c in columns], *[f"{columns[i]}_{columns[j]}" for i, j in pairs]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            x = np.column_stack([np.ones(len(batch)), *[c.to_numpy(zero_copy_only=False) for c in batch.columns]])
            total += x.T @ x
        values = [total[0, 0], *total[0, 1:], *[total[i + 1, j + 1] for i, j in pairs]]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(values, pa.float64())], ["name", "v"])

    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    return rows.mapInArrow(run, "name string, v double").groupBy("name").agg(F.sum("v").alias("v"))


def gram(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums and sums of products of complete rows. Its size is that of the columns, whatever the rows."""
    got = {r.name: r.v for r in gram_frame(df, columns).collect()}
    k = len(columns)
    m = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            m[i, j] = m[j, i] = got.get(f"{columns[i]}_{columns[j]}", 0.0)
    return int(got.get("n", 0)), np.array([got.get(f"s_{c}", 0.0) for c in columns]), m


def covariance(n: int, s: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (m - np.outer(s, s) / n) / (n - 1)


def pair_correlations(df: DataFrame, features: list[str], bar: list[str], least: int = 500) -> DataFrame:
    """Pairwise-complete correlations of ranks demeaned within the bar: a, b, rho, n."""
    ranks = centred_ranks(df, features, bar, fill=False)
    names = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    both = {(a, b): F.when(F.col(f"r_{a}").isNotNull() & F.col(f"r_{b}").isNotNull(), 1) for a, b in names}
    rows = ranks.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), corr(f"r_{a}", f"r_{b}").alias("rho"), F.count(both[a, b]).alias("n")) for a, b in names]).alias("v"))
    return rows.select(F.inline("v")).filter(F.col("n") >= least)


def r_squared(cov: np.ndarray) -> np.ndarray:
    """Share of each column explained by all others: 1 - 1 / (C^-1)_ii of the correlation matrix."""
    d = np.sqrt(np.diag(cov))
    c = cov / np.outer(d, d)
    return 1 - 1 / np.diag(np.linalg.pinv(c))


def leader_clusters(pairs: list[tuple[str, str, float]], priority: list[str], cut: float = 0.9) -> dict[str, list[str]]:
    """Features by priority lead; later ones whose |rho| with a leader reaches the cut are absorbed by the first such."""
    near = {(a, b): abs(r) for a, b, r in pairs} | {(b, a): abs(r) for a, b, r in pairs}
    out: dict[str, list[str]] = {}
    for f in priority:
        for lead in out:
            if near.get((lead, f), 0.0) >= cut:
                out[lead].append(f)
                break
        else:
            out[f] = []
    return out


def components(pairs: list[tuple[str, str, float]], names: list[str], cut: float = 0.7) -> list[list[str]]:
    """Connected components of features linked by |rho| at or above the cut."""
    root = {n: n for n in names}

    def find(x: str) -> str:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b, r in pairs:
        if abs(r) >= cut:
            root[find(b)] = find(a)
    groups: dict[str, list[str]] = {}
    for n in names:
        groups.setdefault(find(n), []).append(n)
    return list(groups.values())


def drop_redundant(names: list[str], cov: np.ndarray, cut: float = 0.8, exempt: tuple[str, ...] = ()) -> list[str]:
    """Drop the feature best explained by the others until none is explained beyond the cut."""
    keep = list(range(len(names)))
    while len(keep) > 2:
        r2 = r_squared(cov[np.ix_(keep, keep)])
        order = [i for i in np.argsort(-r2) if names[keep[i]] not in exempt]
        if not order or r2[order[0]] < cut:
            break
        del keep[order[0]]
    return [names[i] for i in keep]


def content_hash(spec: dict) -> str:
    return hashlib.sha256(json.dumps(spec, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def ridge_fit(df: DataFrame, features: list[str], y: str, alpha: float) -> np.ndarray:
    """Coefficients on given (centred) columns: (X'X + alpha I)^-1 X'y, from one aggregate."""
    _, _, m = gram(df, [*features, y])
    k = len(features)
    return np.linalg.solve(m[:k, :k] + alpha * np.eye(k), m[:k, k])


def ridge_score(df: DataFrame, features: list[str], beta: np.ndarray, out: str = "score") -> DataFrame:
    total = F.lit(0.0)
    for f, b in zip(features, beta.tolist()):
        total = total + F.col(f) * b
    return df.withColumn(out, total)


def eigen_shares(cov: np.ndarray) -> np.ndarray:
    d = np.sqrt(np.diag(cov))
    w = np.linalg.eigvalsh(cov / np.outer(d, d))[::-1]
    return w / w.sum()


def block_bootstrap(values: np.ndarray, block: int, draws: int, seed: int, level: float = 0.95) -> tuple[float, float]:
    """Interval of the mean of a series of bars from moving blocks."""
    rng, n = np.random.default_rng(seed), len(values)
    starts = rng.integers(0, max(1, n - block + 1), (draws, -(-n // block)))
    at = (starts[:, :, None] + np.arange(block)).reshape(draws, -1)[:, :n]
    means = values[np.minimum(at, n - 1)].mean(axis=1)
    a = (1 - level) / 2
    return float(np.quantile(means, a)), float(np.quantile(means, 1 - a))


def persistence(df: DataFrame, x: str, symbol: str, t: str, step: int, bars: int) -> DataFrame:
    """Rank correlation of cross-sections ``bars`` apart: t, rho, n."""
    now = df.filter(F.col(x).isNotNull()).withColumn("p", xs.pct_rank(x, [t])).select(symbol, t, "p")
    then = now.select(symbol, (F.col(t) + step * bars).alias(t), F.col("p").alias("q"))
    return now.join(then, [symbol, t]).groupBy(t).agg(corr("p", "q").alias("rho"), F.count(F.lit(1)).alias("n"))


def estimation_noise(df: DataFrame, x: str, symbol: str, t: str) -> DataFrame:
    """Per symbol: lag-1 autocorrelation, and noise (deviation of second differences over root 6) against spread."""
    w = wn.along([symbol], t)
    d = df.withColumns({"__l": F.lag(x).over(w), "__d": F.col(x) - 2 * F.lag(x).over(w) + F.lag(x, 2).over(w)})
    return d.groupBy(symbol).agg(corr(x, "__l").alias("autocorr"), F.try_divide(F.stddev_samp("__d") / math.sqrt(6), F.nullif(F.stddev_samp(x), F.lit(0.0))).alias("noise"))


def coverage_report(df: DataFrame, features: list[str], bar: str) -> DataFrame:
    """Stage 0/1 of each feature: coverage, infinities, distinct values, bars with variation. Two aggregates in all."""
    stats = [F.struct(F.lit(f).alias("feature"), F.avg(F.when(F.col(f).isNotNull(), 1.0).otherwise(0.0)).alias("coverage"), F.count(F.when(F.isnan(f) | (F.abs(f) == F.lit(float("inf"))), 1)).alias("not_finite"), F.count_distinct(f).alias("distinct")) for f in features]
    a = df.agg(F.array(*stats).alias("v")).select(F.inline("v"))
    inner = df.groupBy(bar).agg(*[(F.max(f) > F.min(f)).alias(f) for f in features])
    b = inner.agg(F.array(*[F.struct(F.lit(f).alias("feature"), F.avg(F.when(F.col(f), 1.0).when(~F.col(f), 0.0)).alias("bars_varying")) for f in features]).alias("v")).select(F.inline("v"))
    return a.join(F.broadcast(b), "feature")


def sampled_instants(df: DataFrame, t: str, every: int) -> DataFrame:
    """Rows of every k-th distinct instant."""
    from pyspark.sql import Window as W

    keep = df.select(t).distinct().withColumn("__n", F.row_number().over(W.orderBy(t))).filter((F.col("__n") - 1) % every == 0).select(t)
    return df.join(keep, t)


def seeded_sample(df: DataFrame, key: list[str], n: int, seed: int) -> DataFrame:
    """n rows in a hash order: the same rows for the same seed, whatever the partitioning. A sampling operator."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


