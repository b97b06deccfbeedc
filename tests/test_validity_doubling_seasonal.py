"""Attributes as known, trailing totals and the regular grid, against brute force."""

import math
import random

import pytest

from gridloom.operators.doubling import doubled_windows, trailing_totals
from gridloom.operators.seasonal import regular_grid
from gridloom.operators.validity import as_known_at

DAY = 86_400_000


def known(spark, events, versions, bucket=10):
    ev = spark.createDataFrame(events, "k string, t bigint, v string")
    ve = spark.createDataFrame(versions, "k string, o bigint, known bigint, v string, b bigint")
    out = as_known_at(ev, "k", "t", ve, "k", "known", ["o", "known"], ["v"], bucket)
    return sorted((r.k, r.t, r.version_o, r.version_known, r.version_v) for r in out.collect())


def test_as_known_matches_brute_force(spark):
    rng = random.Random(1)
    versions = [(rng.choice("abc"), o := rng.randrange(0, 300), o + rng.choice([0, 1, 5, 60]), f"v{i}", 0) for i in range(150)]
    events = [(rng.choice("abcd"), rng.randrange(-20, 400), "x") for _ in range(200)]
    versions += versions[:20]
    events += events[:20]
    want = []
    for k, t, _ in sorted(set(events)):
        got = [(o, kn, v) for kk, o, kn, v, _ in versions if kk == k and kn <= t]
        if got:
            want.append((k, t, *max(got)))
    assert known(spark, events, versions) == want
    assert known(spark, events, versions, 1000) == want


def test_as_known_nulls_and_empty(spark):
    assert known(spark, [(None, 1, "x"), ("a", None, "x"), ("a", 5, None)], [("a", 1, 5, None, 0), ("a", None, 1, "n", 0), (None, 1, 1, "n", 0), ("a", 2, None, "n", 0)]) == [("a", 5, 1, 5, None)]
    assert known(spark, [], [("a", 1, 1, "v", 0)]) == [] and known(spark, [("a", 1, "x")], []) == []


@pytest.mark.parametrize("spans", [[1, 2, 3], [7, 30], [5, 16, 31]])
def test_doubled_windows(spark, spans):
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(-50, 50)) for k in "ab" for i in range(45)]
    df = doubled_windows(spark.createDataFrame(rows, "k string, day int, total bigint"), ["k"], "day", ["total"], spans)
    by = {(k, i): v for k, i, v in rows}
    for r in df.collect():
        for s in spans:
            assert r[f"total_{s}"] == sum(by.get((r.k, d), 0) for d in range(r.day - s + 1, r.day + 1))


def test_trailing_totals_brute_force(spark):
    rng = random.Random(3)
    live = [("a", DAY // 2, 20 * DAY), ("a", 25 * DAY, 40 * DAY + 5), ("b", 0, DAY), ("b", 0, DAY), ("c", 5, 6)]
    reads = [(rng.choice("abx"), rng.randrange(0, 45 * DAY), round(rng.uniform(-1.2, 1.2), 6)) for _ in range(300)]
    reads += reads[:30] + [("a", 3 * DAY, None), ("a", 3 * DAY, math.nan), (None, 1, 0.5), ("a", 26 * DAY, math.inf)]
    out = trailing_totals(spark.createDataFrame(reads, "k string, t bigint, x double"), spark.createDataFrame(live, "k string, live_from bigint, live_to bigint"), [7, 30]).collect()
    ok = {(k, t, x) for k, t, x in reads if k and x is not None and math.isfinite(x) and abs(x) < 1}
    want = {}
    for k, a, z in set(live):
        for d in range(-(-a // DAY), z // DAY):
            row = []
            for s in (7, 30):
                v = [round(x * 1e6) for kk, t, x in ok if kk == k and max(a, (d - s + 1) * DAY) <= t < min(z, (d + 1) * DAY)]
                row += [sum(v), len(v)]
            want[k, a, d] = tuple(row)
    assert {(r.k, r.live_from, r.day): (r.total_7, r.n_7, r.total_30, r.n_30) for r in out} == want
    assert all((r.mean_7 is None) == (r.n_7 == 0) for r in out)


def grid(spark, reads, live, step=8 * 3_600_000):
    r = spark.createDataFrame(reads, "src string, k string, t bigint, x double, slot string")
    return regular_grid(r, spark.createDataFrame(live, "src string, k string, live_from bigint, live_to bigint"), step).collect()


def test_grid_marks_and_fills(spark):
    step = 8 * 3_600_000
    f = lambda i: 5 + 0.01 * i + math.sin(2 * math.pi * i / 3) + 0.5 * math.cos(2 * math.pi * i / 21)
    reads = [("s", "a", i * step + 7, f(i), "x") for i in range(1, 120) if i % 11]
    out = grid(spark, reads + reads[:5], [("s", "a", 5, 121 * step + 1)])
    assert [r.slot // step for r in sorted(out, key=lambda r: r.slot)] == list(range(1, 121))
    missing = {r.slot // step: r for r in out if r.state != "observed"}
    assert set(missing) == {i for i in range(1, 121) if i % 11 == 0 or i == 120}
    assert all(r.state == "filled" and abs(r.filled - f(i)) < 0.02 for i, r in missing.items())


def test_grid_cases(spark):
    step = 8 * 3_600_000
    out = grid(spark, [("s", "a", 1, None, ""), ("s", "a", 2, math.nan, ""), ("s", "a", 3, math.inf, ""), ("s", None, 3, 1.0, ""), ("s", "b", step, 2.0, "")], [("s", "a", 0, 2 * step), ("s", "b", 0, 2 * step), ("s", "c", 5, step), ("s", "b", 0, 2 * step)])
    assert sorted((r.k, r.slot // step, r.state) for r in out) == [("a", 0, "empty"), ("a", 1, "empty"), ("b", 0, "filled"), ("b", 1, "observed")]
    assert grid(spark, [], [("s", "a", 0, 5)]) == [] and grid(spark, [], []) == []


def test_equal_rows_count_once_in_a_slot(spark):
    step = 8 * 3_600_000
    out = grid(spark, [("s", "a", 5, 1.0, "p"), ("s", "a", 5, 1.0, "q"), ("s", "a", 5, 1.0, "p"), ("s", "a", 9, 5.0, "p"), ("s", "a", 7, 1.0, "p")], [("s", "a", 0, step)])
    assert [(r.observed, r.n) for r in out] == [(7 / 3, 3)]


def test_spikes_do_not_pull_the_fit(spark):
    step = 8 * 3_600_000
    rng = random.Random(1)
    f = lambda i: 5 + 0.01 * i + math.sin(2 * math.pi * i / 3) + 0.5 * math.cos(2 * math.pi * i / 21) + rng.gauss(0, 0.01)
    values = {i: f(i) for i in range(0, 200)}
    reads = [("s", "a", i * step + 7, v + (1000 if i % 19 == 4 else 20 if i % 23 == 6 else 0), "x") for i, v in values.items() if i % 7]
    out = {r.slot // step: r for r in grid(spark, reads, [("s", "a", 0, 200 * step)])}
    assert max(abs(out[i].fitted - v) for i, v in values.items()) < 0.1
    assert max(abs(out[i].filled - v) for i, v in values.items() if i % 7 == 0) < 0.1
    assert out[4].observed > 1000 and out[4].filled == out[4].observed
