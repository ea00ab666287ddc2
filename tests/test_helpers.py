from stratum.functions import helpers as H


def test_asof_join_keeps_columns_of_both_sides(spark):
    left = spark.createDataFrame([(1, 5, "a"), (1, 1, "b"), (2, 9, "c"), (None, 9, "d")], "k long, at long, v string")
    right = spark.createDataFrame([(1, 2, "x"), (1, 4, "y"), (2, 10, "z"), (None, 1, "w")], "k long, at long, v string")
    out = H.asof_join(left, right, ["k"], "at", "at")
    assert out.columns == ["k", "at", "v", "right_at", "right_v"]
    assert {(r.v, r.right_at, r.right_v) for r in out.collect()} == {("a", 4, "y"), ("b", None, None), ("c", None, None), ("d", None, None)}
