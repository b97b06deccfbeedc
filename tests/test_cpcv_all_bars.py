"""The combinatorial splits take every bar of the panel, and their groups are even."""

import __spark_entry__ as entry

H8 = 28_800_000


def test_no_bar_is_left_out(spark, tmp_path):
    n = 265
    grid = spark.createDataFrame([("a", i * H8, 1.0, 1.0, 1.0) for i in range(n)], "symbol string, t_obs bigint, px_obs double, px_fill double, qv_window double")
    grid.write.parquet(f"{tmp_path}/decision_grid_8h.parquet")
    got = entry.queries()["cpcv_members"](spark, str(tmp_path)).toPandas()
    edges = [0, 44, 88, 132, 176, 220, 265]
    test = got[got.role == "test"].assign(n=lambda d: d.t // H8)
    assert got.fit.nunique() == 15
    for g in range(6):
        of = test[test.grp == g]
        assert sorted(of.n.unique()) == list(range(edges[g], edges[g + 1]))
        assert (of.groupby("n").fit.nunique() == 5).all()
    train = got[(got.role == "train") & (got.fit == 0)]  # tests groups 0 and 1
    assert sorted(train.t // H8) == list(range(92, 265))
