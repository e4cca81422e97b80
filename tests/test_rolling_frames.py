"""Frames merged from blocks against Spark's own frames, row by row."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import frame, hourly
from wattlane.operators import windows as W

NAMES = ["energy_mean_24h", "energy_std_24h", "energy_min_24h", "energy_max_24h", "energy_mean_7d", "energy_std_7d"]


def whole_frames(df, col=W.POWER):
    """Every frame read again for every row."""
    s = Window.partitionBy("series_id").orderBy("ts", "arrival_no")
    day, week = s.rowsBetween(-23, 0), s.rowsBetween(-167, 0)
    return df.select("series_id", "arrival_no", F.avg(col).over(day).alias(NAMES[0]), F.stddev_samp(col).over(day).alias(NAMES[1]),
                     F.min(col).over(day).alias(NAMES[2]), F.max(col).over(day).alias(NAMES[3]),
                     F.avg(col).over(week).alias(NAMES[4]), F.stddev_samp(col).over(week).alias(NAMES[5]))


def same(a, b, tolerance=1e-9):
    if a is None or b is None:
        return a is b
    return (math.isnan(a) and math.isnan(b)) or a == b or math.isclose(a, b, rel_tol=tolerance, abs_tol=tolerance)


def series(spark):
    rng = random.Random(5)
    rows = []
    for k, n in enumerate((1, 2, 3, 4, 5, 23, 24, 25, 167, 168, 169, 400)):
        rows += hourly(spark, n, series=f"len{n}", arrival_base=1000 * k, power=lambda i: rng.gauss(50, 20))
    rows += hourly(spark, 300, series="far", arrival_base=20000, power=lambda i: 1e9 + rng.random())
    rows += hourly(spark, 300, series="holes", arrival_base=30000, power=lambda i: None if i < 30 or rng.random() < 0.4 else rng.gauss(0, 1))
    rows += hourly(spark, 60, series="none", arrival_base=40000, power=lambda i: None)
    rows += hourly(spark, 300, series="nan", arrival_base=50000, power=lambda i: float("nan") if i == 40 else float("inf") if i == 230 else rng.random())
    rows += [(None, *r[1:]) for r in hourly(spark, 50, arrival_base=60000, power=lambda i: rng.random())]
    return frame(spark, rows)


@pytest.mark.parametrize("plan", [{"strategy": "plain"}, {"strategy": "chunked", "chunk_rows": 170, "num_partitions": 5}, {"hot_rows": 250, "chunk_rows": 200}])
def test_blocks_equal_whole_frames(spark, plan):
    df = series(spark)
    want = {(r["series_id"], r["arrival_no"]): r for r in whole_frames(df).collect()}
    got = {(r["series_id"], r["arrival_no"]): r for r in W.rolling_features(df, **plan).collect()}
    assert got.keys() == want.keys()
    for k, w in want.items():
        for name in NAMES:
            # around 1e9 a double ends at 1e-7, in Spark's own frames too
            assert same(got[k][name], w[name], 1e-6 if k[0] == "far" else 1e-9), (k, name, got[k][name], w[name])


def test_a_constant_has_no_deviation(spark):
    for value in (0.1, 1 / 3, 1e15 + 0.25):
        rows = W.rolling_features(frame(spark, hourly(spark, 200, power=lambda i: value))).collect()
        assert {r["energy_std_7d"] for r in rows if r["arrival_no"] >= 1} == {0.0}
        assert {r["energy_std_24h"] for r in rows if r["arrival_no"] >= 1} == {0.0}


def test_only_the_given_columns_and_the_features_come_out(spark):
    df = frame(spark, hourly(spark, 30))
    assert W.rolling_features(df).columns == [*df.columns, *NAMES]


def test_a_frame_must_hold_whole_blocks(spark):
    s = Window.partitionBy("series_id").orderBy("ts")
    blocks = W.first_block(frame(spark, hourly(spark, 5)), s, W.POWER, 4)
    with pytest.raises(ValueError, match="no multiple"):
        W.merge_blocks(blocks, s, 4, 10)


def test_all_levels_share_one_shuffle_and_one_sort(spark):
    df = W.rolling_features(frame(spark, hourly(spark, 200)), strategy="plain")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1, plan
