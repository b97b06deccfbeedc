"""Which archives stay out, where the others lie, and an exact round trip of packed bytes."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators.containers import container_index, instant_ms, pack_files, period_parts, read_packed

COLS = "key string, dataset string, symbol string, period string, status string, sha256 string, rows bigint, updated_at string, role string"


def log(spark, *rows):
    full = [{"dataset": "d", "symbol": "s", "period": "2021-01-01", "status": "converted", "sha256": None, "rows": 5, "updated_at": "2021-04-01T00:00:00Z", "role": "x"} | r for r in rows]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in COLS.split(", ")) for r in full], COLS)


def roles(spark, *rows):
    return {r.key: r.role for r in container_index(log(spark, *rows)).collect()}


def test_roles(spark):
    got = roles(
        spark,
        {"key": "m", "period": " 2021_01", "sha256": "AB"}, {"key": "d1", "period": "20210105"}, {"key": "d2", "period": "2021/2/5"}, {"key": "d3", "period": "2021-1-9", "symbol": "z"},
        {"key": "x", "period": "2021-03-01", "sha256": "ab "}, {"key": "y", "period": "2021-03-02", "sha256": "cd", "rows": 0}, {"key": "z", "period": "2021-03-03", "sha256": "cd"},
        {"key": "n1", "period": "2021-05-01"}, {"key": "n2", "period": "2021-05-02"}, {"key": None}, {"key": "odd", "period": "soon"}, {"key": "nullp", "period": None},
    )
    assert got == {"m": "packed", "d1": "contained", "d2": "packed", "d3": "packed", "x": "copy", "z": "packed", "n1": "packed", "n2": "packed", "odd": "packed", "nullp": "packed"}


def test_the_latest_record_counts(spark):
    late, early = {"key": "a", "rows": None, "status": "failed", "updated_at": "2021-04-02 01:00:00+05:00"}, {"key": "a", "updated_at": "2021-04-01T19:30:00Z"}
    assert roles(spark, late, early, late) == {}
    assert roles(spark, early | {"updated_at": "2021-04-01T21:00:00+00:00"}, late) == {"a": "packed"}
    assert roles(spark, {"key": "b", "updated_at": None}, {"key": "b", "status": "failed", "updated_at": "never"}) in ({}, {"b": "packed"})
    assert container_index(log(spark)).count() == 0


def test_offsets_tile_each_container(spark):
    rows = [{"key": f"k{i:04}", "period": f"2021-05-{i % 28 + 1:02}", "symbol": f"s{i}", "rows": i % 50 + 1} for i in range(500)]
    got = container_index(log(spark, *rows), target=600, max_files=100).collect()
    by = {}
    for r in got:
        by.setdefault(r.container, []).append((r.offset, r.length))
    assert sum(len(v) for v in by.values()) == 500
    for v in by.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length


@pytest.mark.parametrize("text, ms", [("2021-01-01T00:00:00+00:00", 1_609_459_200_000), ("2021-01-01 00:00:00-05:00", 1_609_477_200_000), ("2021-01-01T00:00:00Z", 1_609_459_200_000), ("x", None), (None, None)])
def test_instants(spark, text, ms):
    assert spark.createDataFrame([(text,)], "x string").select(instant_ms(F.col("x"))).first()[0] == ms


@pytest.mark.parametrize("text, want", [("2021-2-7", ("202102", "07")), (" 20210207", ("202102", "07")), ("2021/02", ("202102", "")), ("202102", ("202102", "")), ("2021_02_07", ("202102", "07")), ("?", (None, ""))])
def test_periods(spark, text, want):
    assert tuple(spark.createDataFrame([(text,)], "x string").select(*period_parts(F.col("x"))).first()) == want


def test_bytes_round_trip(spark, tmp_path):
    rng, want = random.Random(5), {}
    (tmp_path / "in/deep").mkdir(parents=True)
    for i in range(60):
        body = rng.randbytes(rng.choice([1, 700, 5000])) if i % 4 else b"the same bytes"
        p = tmp_path / ("in/deep" if i % 2 else "in") / f"f{i}.bin"
        p.write_bytes(body)
        want[p.name] = body
    out = str(tmp_path / "out")
    index = pack_files(spark, str(tmp_path / "in"), out, target_bytes=20_000, shards=3)
    rows = index.collect()
    assert len(rows) == 60 and len(os.listdir(f"{out}/data")) < 20
    assert all(r.checksum == hashlib.sha256(want[os.path.basename(r.path)]).hexdigest() for r in rows)
    assert len({(r.container, r.offset) for r in rows if r.checksum == hashlib.sha256(b"the same bytes").hexdigest()}) == 1
    assert {os.path.basename(r.path): bytes(r.content) for r in read_packed(index, out).collect()} == want
    bad = index.withColumn("checksum", F.lit("0"))
    with pytest.raises(Exception, match="differ"):
        read_packed(bad, out).count()
