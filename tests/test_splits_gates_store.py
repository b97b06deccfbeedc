"""Splits, folds, gates, sources, statistics and streaming."""

import datetime as dt
import json
import math
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import stats
from gridloom.plans import gates, market, selection, splits
from gridloom.sources import store

H = splits.HOUR_MS
SCHEME = splits.SplitScheme((splits.Split("train", 0, 1000 * H), splits.Split("test", 1000 * H, None)))


def times(spark, *t):
    return spark.createDataFrame([(x,) for x in t], "t bigint")


def test_bounds_are_half_open_and_purge_looks_back(spark):
    df = times(spark, -1, 0, 880 * H - 1, 880 * H, 1000 * H - 1, 1000 * H, 1200 * H)
    assert [r.t for r in SCHEME.take(df, "train", "t").collect()] == [0, 880 * H - 1]
    assert [r.t for r in SCHEME.take(df, "train", "t", purge=False).collect()] == [0, 880 * H - 1, 880 * H, 1000 * H - 1]
    assert [r.t for r in SCHEME.take(df, "test", "t").collect()] == [1000 * H]
    assert [r[0] for r in df.select(SCHEME.assign(F.col("t"))).collect()] == [None, "train", "train", "train", "train", "test", "test"]


def test_split_errors(spark):
    with pytest.raises(KeyError):
        SCHEME.take(times(spark, 1), "other", "t")
    with pytest.raises(KeyError):
        SCHEME.take(times(spark, 1), "train", "nope")
    with pytest.raises(splits.LeakError, match="2 rows"):
        SCHEME.assert_train_only(times(spark, 1, 1000 * H, 1001 * H), "t")
    SCHEME.assert_train_only(times(spark, 1), "t")
    with pytest.raises(ValueError):
        splits.SplitScheme((splits.Split("a", 0, None), splits.Split("b", 5, 6)))
    with pytest.raises(splits.LeakError):
        splits.SplitScheme(SCHEME.splits, frozenset({"test"})).get("test")


def test_folds(spark):
    f = splits.walk_forward(times(spark, *range(0, 200)), "t", 100, 20, 5, 2).toPandas()
    for k, g in f.groupby("fold"):
        tr, te = g[g.role == "train"].t, g[g.role == "test"].t
        assert (tr.max(), te.min(), te.max()) == (100 + 20 * k - 3, 100 + 20 * k, 119 + 20 * k)


def test_combinatorial_purge_and_paths(spark):
    f = splits.combinatorial(times(spark, *range(60)), "t", 60).toPandas()
    assert f.fit.nunique() == 15
    for _, g in f.groupby("fit"):
        te = set(g[g.role == "test"].t)
        assert len(te) == 20
        assert all(t + 1 not in te and t + 2 not in te and not {t - 1, t - 2, t - 3, t - 4} & te for t in g[g.role == "train"].t)
    paths = splits.stitched_paths()
    assert len(paths) == 5 and all(len(p) == 6 for p in paths) and sorted(f for p in paths for f in p.values()) == sorted(list(range(15)) * 2)


def test_gates_write_all_or_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, None)], "k string, t bigint, x double")
    path = str(tmp_path / "out")
    with pytest.raises(gates.GateError, match="coverage"):
        gates.gated_write(df, path, [gates.coverage("x", 0.9)])
    assert os.listdir(tmp_path) == []
    note = gates.gated_write(df, path, [gates.unique_key(["k", "t"]), gates.coverage("x", 0.5), gates.finite("x")], {"who": "test"}, ["t"])
    assert spark.read.parquet(path).count() == 2 and note["who"] == "test"
    assert json.loads((tmp_path / "out.json").read_text())["gates"]["unique key"] == 0


def test_zip_scan_sniffs_headers_and_units(spark, tmp_path):
    head = "open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore\n"
    row = "{},1,2,0.5,1.5,10,{},15,7,4,6,0\n"
    for name, text in (("a", head + row.format(1_700_000_000_000, 1_700_000_059_999)), ("b", row.format(1_700_000_060_000_000, 1_700_000_119_999_000) + row.format("bad", "bad"))):
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            z.writestr(f"{name}.csv", text)
    got = store.scan_zips(spark, str(tmp_path), store.CATALOGUE["perp_klines"]).orderBy("src_path", "open_time").collect()
    assert [(r.open_time, r.close_time, r.trade_count, r.taker_buy_base_volume) for r in got] == [(1_700_000_000_000, 1_700_000_059_999, 7, 4.0), (None, None, 7, 4.0), (1_700_000_060_000, 1_700_000_119_999, 7, 4.0)]


def test_partitioned_scan_prunes(spark, tmp_path):
    day = 86_400_000
    df = spark.range(90).select(F.lit("s").alias("symbol"), (F.col("id") * day + 1_609_459_200_000).alias("t"), F.col("id").cast("double").alias("x"))
    store.write_partitioned(df, str(tmp_path / "d"), "t")
    got = store.scan(spark, str(tmp_path / "d"), "t", 1_609_459_200_000 + 40 * day, 1_609_459_200_000 + 45 * day, ["t", "x"], ["s"])
    assert sorted(r.x for r in got.collect()) == [40, 41, 42, 43, 44]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull" in plan and "month" in plan.split("PartitionFilters")[1] and "GreaterThanOrEqual(t" in plan


def test_manifest(spark):
    wanted = spark.createDataFrame([("m1", "d", "s", "2021-01", "monthly"), ("a", "d", "s", "2021-01-05", "daily"), ("b", "d", "s", "2021-02-05", "daily"), ("c", "d", "z", "2021-01-05", "daily")], "key string, dataset string, symbol string, period string, granularity string")
    have = spark.createDataFrame([("c",)], "key string")
    assert sorted(r.key for r in store.plan_downloads(wanted, have).collect()) == ["b", "m1"]
    assert sorted(r.key for r in store.plan_downloads(wanted, have, "2021-02").collect()) == ["b"]
    old = spark.createDataFrame([("k", 1, "x")], "key string, at bigint, v string")
    assert [r.v for r in store.upsert(old, spark.createDataFrame([("k", 2, "y")], old.schema), "key", "at").collect()] == ["y"]
    c = store.dated_contracts(spark.createDataFrame([("BTC_210625",), ("BTC_x",), ("BTC",)], "s string"), "s", "BTC").collect()
    assert [(r.s, r.expiry) for r in c] == [("BTC_210625", 1_624_579_200_000)]


def test_universe_and_checksums(spark, tmp_path):
    (tmp_path / "u.txt").write_text("﻿# head\nabc\n\n xyz # note\nABC\n", encoding="utf-8")
    assert sorted(r.symbol for r in store.universe(spark, str(tmp_path / "u.txt")).collect()) == ["ABC", "XYZ"]
    path = f"file:{tmp_path}/u.txt"
    import hashlib

    pub = spark.createDataFrame([(path, hashlib.sha256((tmp_path / "u.txt").read_bytes()).hexdigest().upper())], "path string, sha256 string")
    assert store.verify_checksums(spark, str(tmp_path), pub).first().ok is True
    assert store.listing(spark, str(tmp_path)).first().key == "u.txt"


def test_statistics():
    assert abs(stats.probabilistic_sharpe(0.1, 0.0, 101, 0.0, 3.0) - stats.N.cdf(1 / math.sqrt(1.005))) < 1e-9
    assert stats.expected_max_sharpe(1.0, 1) == 0 and 2.4 < stats.expected_max_sharpe(1.0, 100) < 2.6
    assert math.isinf(stats.min_track_record(0.0, 0.1, 0, 3))
    assert abs(stats.binomial_tail(3, 3, 0.5) - 0.125) < 1e-12 and abs(stats.binomial_two_sided(0, 4) - 0.125) < 1e-12


def test_linear_algebra(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 3))
    x[:, 2] += x[:, 0]
    y = x @ [1.0, -2.0, 0.5] + rng.normal(size=300) * 0.1
    df = spark.createDataFrame([tuple(map(float, (*a, b))) for a, b in zip(x, y)], "a double, b double, c double, y double")
    want = np.linalg.solve(x.T @ x + 3 * np.eye(3), x.T @ y)
    np.testing.assert_allclose(selection.ridge_fit(df, ["a", "b", "c"], "y", 3.0), want, atol=1e-9)
    cov = selection.covariance(*selection.gram(df, ["a", "b", "c"]))
    np.testing.assert_allclose(cov, np.cov(x.T), atol=1e-9)
    one = np.c_[np.ones(300), x[:, 1:]]
    res = x[:, 0] - one @ np.linalg.lstsq(one, x[:, 0], rcond=None)[0]
    assert abs(selection.r_squared(cov)[0] - (1 - res.var() / x[:, 0].var())) < 1e-9
    assert selection.leader_clusters([("a", "b", -0.95), ("b", "c", 0.95)], ["a", "b", "c"]) == {"a": ["b"], "c": []}
    assert sorted(map(sorted, selection.components([("a", "b", 0.8), ("c", "d", 0.1)], list("abcd")))) == [["a", "b"], ["c"], ["d"]]
    assert selection.drop_redundant(["a", "b", "c"], np.array([[1, 0, 0.99], [0, 1, 0], [0.99, 0, 1]]), 0.8, ("a",)) == ["a", "b"]
    lo, hi = selection.block_bootstrap(np.arange(100.0), 5, 200, 1)
    assert lo < 49.5 < hi and abs(selection.eigen_shares(np.eye(3)).sum() - 1) < 1e-12


def test_book_invariants(spark):
    rng = np.random.default_rng(2)
    rows = [(t, f"s{i}", float(rng.normal()), float(rng.normal(0, 0.01)), 0.001 * t, 1.0 + 0.1 * i, 0.01 + 0.001 * i, 0.0) for t in range(30) for i in range(12)]
    rows += [(99, "s1", 1.0, 0.0, 0.0, 1.0, 0.01, 0.0)]
    df = spark.createDataFrame(rows, "t bigint, symbol string, score double, fwd_ret double, fwd_rm double, beta double, sigma double, funding double")
    cfg = market.BookConfig(hedge_rows=10, hedge_warm=10)
    w = market.book_weights(df, cfg)
    agg = w.groupBy("t").agg(F.sum("w").alias("net"), F.sum(F.abs("w")).alias("gross")).toPandas()
    assert len(agg) == 30 and agg.net.abs().max() < 1e-12 and (agg.gross - 1).abs().max() < 1e-12
    whole = market.book_returns(w, cfg).toPandas().sort_values("t").reset_index(drop=True)
    past = whole[whole.t < 20].assign(pnl=lambda d: d.gross - d.funding)[["t", "pnl", "r_m"]]
    late = market.book_returns(w.filter("t >= 20"), cfg, spark.createDataFrame(past)).toPandas().sort_values("t")
    np.testing.assert_allclose(late.ret.values, whole[whole.t >= 20].ret.values, atol=1e-12)
    m = market.metrics(market.book_returns(w, cfg).join(market.turnover(w), "t"), costs_bps=(1.0,)).first()
    assert m.bars == 30 and m.max_drawdown <= 0 and m["sharpe_at_1bps"] < m.sharpe


def test_streams_equal_batches(spark, tmp_path):
    from gridloom.streaming import bars

    rows = [("ab"[i % 2], dt.datetime(2024, 1, 1) + dt.timedelta(minutes=37 * i), float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "key string, ts timestamp, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def run(frame, name, mode):
        q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).toPandas()

    got = run(bars.tumbling(stream, "key", "ts", "v"), "tumbling", "append")
    want = df.groupBy("key", F.window("ts", "8 hours").end.alias("bar")).agg(F.sum("v").alias("total")).toPandas()
    done = want.merge(got, on=["key", "bar"], suffixes=("", "_s"))
    assert len(done) == len(got) >= len(want) - 4 and (done.total == done.total_s).all()
    held = run(bars.held_band(stream, "key", "v", 5.0), "held", "append")
    assert len(held) == 200 and held.held.nunique() < 80
