"""Every index has its column in the pivot, with its own values."""

import __spark_entry__ as entry


def test_every_index_is_pivoted(spark, tmp_path):
    rows = [("IDX_00001", 1, 0.1), ("IDX_00002", 1, 0.2), ("IDX_00003", 1, 0.3), ("IDX_ALL", 2, 0.4), ("x.y", 2, 0.5), ("x.y", 2, float("nan")), (None, 3, 0.6)]
    spark.createDataFrame(rows, "index_id string, t_obs bigint, r_m double").write.parquet(f"{tmp_path}/market_index_8h.parquet")
    df = entry.queries()["pivot_series"](spark, str(tmp_path))
    long = {(r["t"], c, r[c]) for r in df.collect() for c in df.columns if c != "t" and r[c] is not None}
    assert long == {(t, i, v) for i, t, v in rows if i is not None and v == v}
