"""The ``preds`` fixture: ten rows of y and three predictions."""

import math

import pytest
from pyspark.sql import functions as F

from wattlane.operators import metrics as A
from wattlane.operators.models import weighted_ensemble

Y = [10.0, 12.0, 9.0, 11.0, 15.0, 14.0, 8.0, 10.0, 13.0, 12.0]
SEQ = [11.0, 12.5, 8.0, 10.0, 16.0, 13.0, 9.0, 10.5, 12.0, 12.0]
RF = [9.0, 11.0, 9.5, 11.5, 14.0, 15.0, 7.5, 9.0, 13.5, 11.0]
GBT = [10.5, 13.0, 10.0, 12.0, 15.5, 14.5, 8.5, 11.0, 12.5, 13.0]


@pytest.fixture(scope="module")
def preds(spark):
    rows = [(("a" if i < 5 else "b"), i, y, s, r, g) for i, (y, s, r, g) in enumerate(zip(Y, SEQ, RF, GBT))]
    df = spark.createDataFrame(rows, "series_id STRING, i INT, y DOUBLE, seq DOUBLE, rf DOUBLE, gbt DOUBLE")
    return df.withColumn("prediction", weighted_ensemble(F.col("seq"), F.col("rf"), F.col("gbt")))


def blend(i):
    return 0.5 * SEQ[i] + 0.25 * RF[i] + 0.25 * GBT[i]


def test_blend_mae_rmse_bounds(spark, preds):
    p = [blend(i) for i in range(10)]
    mae = sum(abs(y - q) for y, q in zip(Y, p)) / 10
    rmse = math.sqrt(sum((y - q) ** 2 for y, q in zip(Y, p)) / 10)
    ev = A.evaluate(preds).first()
    assert ev["n"] == 10 and abs(ev["mae"] - mae) < 1e-12 and abs(ev["rmse"] - rmse) < 1e-12
    assert abs(A.mae(preds).first()["mae"] - mae) < 1e-12
    assert abs(A.rmse(preds).first()["rmse"] - rmse) < 1e-12
    b = A.prediction_bounds(preds).first()
    assert b["min_val"] == min(Y + p) and b["max_val"] == max(Y + p)
    per = {r["series_id"]: r for r in A.evaluate(preds, keys=["series_id"]).collect()}
    assert per["a"]["n"] == 5 and per["b"]["n"] == 5
    avp = A.actual_vs_predicted(preds, keep=["i"]).orderBy("i").collect()
    assert [r["actual"] for r in avp] == Y and abs(avp[0]["predicted"] - blend(0)) < 1e-12


def test_avg_by_numeric_only(spark, preds):
    out = {r["series_id"]: r for r in A.avg_by(preds, "series_id").collect()}
    assert abs(out["a"]["avg_y"] - sum(Y[:5]) / 5) < 1e-12
    assert "avg_series_id" not in out["a"].asDict()
    with_ts = preds.withColumn("t", F.timestamp_seconds(F.col("i") * 3600))
    got = A.avg_by(with_ts, "series_id", timestamps_as_epoch=True).orderBy("series_id").first()
    assert got["avg_t"] == 2 * 3600.0
    assert "avg_t" not in A.avg_by(with_ts, "series_id").columns
