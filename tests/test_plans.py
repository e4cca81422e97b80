"""The physical plans that the design promises."""

import re

from conftest import frame, hourly
from wattlane.operators import windows as W
from wattlane.operators.metrics import time_split
from wattlane.operators.score import fit_forecast_models, score_series


def plan_of(df):
    df.collect()  # AQE: the plan that ran
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def exchanges(plan):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


def many(spark, n=200):
    return frame(spark, [r for k in range(4) for r in hourly(spark, n, series=f"s{k}", arrival_base=1000 * k, power=lambda i: float(i % 13))])


def test_flagship_shuffles_the_readings_once(spark):
    df = many(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(W.serving_features(df))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    # one exchange for the windows, one of partial means; the readings meet the means by broadcast
    carrying = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert len(carrying) == 2 and plan.count("SortMergeJoin") == 0 and plan.count("BroadcastExchange") == 1, plan


def test_split_uses_one_partitioning(spark):
    plan = plan_of(time_split(many(spark)))
    assert len(exchanges(plan)) == 1 and "Join" not in plan, plan


def test_scoring_cuts_the_readings_before_it_shuffles_them(spark):
    df = many(spark, 400)
    models = fit_forecast_models(W.serving_features(df), rf_params={"numTrees": 2, "maxDepth": 2}, gbt_params={"maxIter": 2, "maxDepth": 2})
    plan = plan_of(score_series(df, models, mode="impute"))
    lines = plan.split("\n")
    limit = [i for i, x in enumerate(lines) if "WindowGroupLimit" in x and "Partial" in x and "192" in x]
    assert limit, plan
    # the lags are computed once
    assert sum("lag(Power_Consumption" in x and "Window [" in x for x in lines) == 1, plan
    before = [x for x in lines[:limit[0]] if "Exchange" in x]
    assert before, plan
