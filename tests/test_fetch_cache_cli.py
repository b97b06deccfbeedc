"""Fetching with retries, tables kept by their parameters, scans of files without a period, and the command line."""

import hashlib
import uuid

from pyspark.sql import functions as F

from gridloom.__main__ import main
from gridloom.session import cached
from gridloom.sources import fetch, store


def test_backfill_places_whole_files_and_records_the_rest(spark, tmp_path):
    (tmp_path / "src/a").mkdir(parents=True)
    (tmp_path / "src/a/x.zip").write_bytes(b"body")
    plan = spark.createDataFrame([("a/x.zip",), ("a/x.zip",), ("a/none.zip",), (None,)], "key string")
    got = {r.key: r for r in fetch.backfill(plan, str(tmp_path / "src"), str(tmp_path / "dst"), tasks=2).collect()}
    assert set(got) == {"a/x.zip", "a/none.zip"} and got["a/none.zip"].status == "absent"
    assert got["a/x.zip"].status == "downloaded" and got["a/x.zip"].sha256 == hashlib.sha256(b"body").hexdigest() and got["a/x.zip"].bytes == 4
    assert [p.name for p in (tmp_path / "dst/a").iterdir()] == ["x.zip"] and (tmp_path / "dst/a/x.zip").read_bytes() == b"body"


def test_failures_are_tried_again_with_longer_waits(tmp_path):
    (tmp_path / "src/d").mkdir(parents=True)  # a folder can't be read as a file
    waits = []
    row = fetch.fetch_one("d", str(tmp_path / "src"), str(tmp_path / "dst"), retries=4, wait=1.0, sleep=waits.append)
    assert row[1] in ("failed", "absent") and (row[1] == "absent" or (row[4] == 4 and waits == [1.0, 2.0, 4.0] and row[5]))


def test_a_table_is_kept_by_its_parameters(spark, tmp_path):
    made, name = [], f"legs-{uuid.uuid4().hex}"  # the session's shared folder may outlive the test

    def build(v):
        made.append(v)
        return spark.range(v)

    for lag in (3, 3, 4, 3):
        assert cached(spark, name, {"lag": lag}, lambda: build(lag), str(tmp_path)).count() == lag
    assert made == [3, 4]


def test_rows_without_a_month_are_always_read(spark, tmp_path):
    day = 86_400_000
    df = spark.range(90).select(F.lit("s").alias("symbol"), (F.lit(1_609_459_200_000) + F.col("id") * day).alias("t"))
    store.write_partitioned(df.filter("id < 60"), str(tmp_path / "d"), "t")
    df.filter("id >= 60").withColumn("month", F.lit(None).cast("string")).write.mode("append").partitionBy("symbol", "month").parquet(str(tmp_path / "d"))
    got = store.scan(spark, str(tmp_path / "d"), "t", 1_609_459_200_000 + 50 * day, 1_609_459_200_000 + 70 * day)
    assert got.count() == 20


def test_command_line(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "p2_found" in capsys.readouterr().out
    assert main(["run", "nothing", "x", "y"]) == 2
    assert main(["run", "combinations_two", "unused", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 15
