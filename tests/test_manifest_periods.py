"""A file is planned for whatever the spelling of its period."""

import __spark_entry__ as entry


def test_every_spelling_counts(spark, tmp_path):
    rows = [
        ("m1", "d", "a", "2021_02", "failed"),  # the last monthly file of (d, a)
        ("m2", "d", "b", "202103", "converted"),
        ("in1", "d", "a", "2021-02-08", "failed"), ("in2", "d", "a", "20210217", "failed"), ("in3", "d", "b", "2021/3/1", "failed"),  # inside a monthly file
        ("out1", "d", "a", "2021/03/08", "failed"), ("out2", "d", "a", "20210317", "failed"), ("out3", "d", "a", "2021-3-6", "failed"), ("out4", "d", "b", " 2021_04_01 ", "failed"),
        ("had", "d", "a", "2021_03_09", "failed"), ("had", "d", "a", "2021-03-09", "converted"),
        ("early", "d", "a", "2020/12", "failed"), ("none", "d", "a", "soon", "failed"),
    ]
    spark.createDataFrame(rows, "key string, dataset string, symbol string, period string, status string").write.parquet(f"{tmp_path}/files.parquet")
    got = sorted(r.key for r in entry.queries()["manifest_plan"](spark, str(tmp_path)).collect())
    assert got == ["m1", "out1", "out2", "out3", "out4"]
