"""Rows without a partner and cells outside a frame stay."""

from roadledger.operators import aggregates as agg
from roadledger.operators import joins
from tests.conftest import rows


def test_positional_merge_keeps_both_sides(spark):
    left = spark.createDataFrame([(1, 10), (1, 11), (2, 20), (None, 30)], "k int, x int")
    right = spark.createDataFrame([(1, 5), (3, 6), (None, 7), (None, 8)], "k int, y int")
    got = rows(joins.positional_merge(left, right, ["k"], ["x"], ["y"]), "k", "x", "y", "merge_code")
    assert got == sorted([(1, 10, 5, 3), (1, 11, 5, 3), (2, 20, None, 1), (3, None, 6, 2), (None, 30, 7, 3), (None, 30, 8, 3)], key=repr)


def test_dense_grid_keeps_outside_and_missing(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (5, 1, 3.0), (None, 1, 4.0)], "a int, b int, w double")
    got = rows(agg.dense_grid(df, "a", range(2), "b", range(2), "w"), "a", "b", "n", "pct")
    assert got == [(0, 0, 1.0, 12.5), (0, 1, 4.0, 50.0), (1, 0, 0.0, 0.0), (1, 1, 0.0, 0.0), (5, 1, 3.0, 37.5)]
