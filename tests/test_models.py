import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import frame, hourly
from wattlane.operators import models as M
from wattlane.operators import windows as W
from wattlane.operators.score import ForecastModels, fit_forecast_models, score_series
from wattlane.operators.sequences import fit_scaler, latest_sequence
from wattlane.session import ensure_checkpoint_dir


@pytest.fixture(scope="module")
def feats(spark):
    import math
    rows = []
    for s, phase in (("a", 0.0), ("b", 1.0)):
        rows += hourly(spark, 400, series=s, arrival_base=0 if s == "a" else 1000,
                       power=lambda i, p=phase: round(10 + 5 * math.sin(i / 24 * 2 * math.pi + p) + (i % 7) * 0.3, 2))
    return W.serving_features(frame(spark, rows)).repartitionByRange(2, "series_id", "ts", "arrival_no").cache()


def test_forest_is_mean_of_trees(spark, feats):
    model = M.train_random_forest(feats, numTrees=5, maxDepth=4)
    forest = model.stages[-1]
    assembled = M.assemble_features(feats)
    pred = np.array([r["prediction"] for r in forest.transform(assembled).orderBy("arrival_no", "series_id").collect()])
    per_tree = []
    for t in forest.trees:
        per_tree.append([r["prediction"] for r in t.transform(assembled).orderBy("arrival_no", "series_id").collect()])
    assert np.allclose(pred, np.mean(per_tree, axis=0), atol=1e-9)


def test_gbt_is_weighted_sum_of_trees(spark, feats):
    model = M.train_gbt(feats, maxIter=5, maxDepth=3)
    gbt = model.stages[-1]
    assembled = M.assemble_features(feats)
    pred = np.array([r["prediction"] for r in gbt.transform(assembled).orderBy("arrival_no", "series_id").collect()])
    total = np.zeros_like(pred)
    for w, t in zip(gbt.treeWeights, gbt.trees):
        total += w * np.array([r["prediction"] for r in t.transform(assembled).orderBy("arrival_no", "series_id").collect()])
    assert np.allclose(pred, total, atol=1e-9)


def test_assembler_skips_rows_without_lag_168(spark, feats):
    out = M.assemble_features(feats)
    assert out.filter(F.col("energy_lag_168").isNull()).count() == 0
    assert out.count() == feats.filter(F.col("energy_lag_168").isNotNull()).count()


def test_stacker_equals_closed_form(spark, feats):
    f = feats.select(F.col("energy_kwh").alias("y"), F.col("energy_mean_24h").alias("a"), F.col("energy_lag_24").alias("b"))
    b0, (b1, b2) = M.stacker_coefficients(M.train_stacker(f, ["a", "b"]))
    data = np.array([(r["y"], r["a"], r["b"]) for r in f.collect()])
    X = np.column_stack([np.ones(len(data)), data[:, 1], data[:, 2]])
    ref = np.linalg.lstsq(X, data[:, 0], rcond=None)[0]
    assert np.allclose([b0, b1, b2], ref, rtol=1e-8, atol=1e-8)


def test_weighted_ensemble(spark):
    df = spark.createDataFrame([(10.0, 20.0, 30.0)], "s DOUBLE, r DOUBLE, g DOUBLE")
    got = df.select(M.weighted_ensemble(F.col("s"), F.col("r"), F.col("g")).alias("p")).first()["p"]
    assert got == 0.5 * 10 + 0.25 * 20 + 0.25 * 30
    with pytest.raises(ValueError):
        M.weighted_ensemble(F.col("s"), F.col("r"), F.col("g"), {"sequence": 0.5, "rf": 0.5, "gbt": 0.5})


def test_scaler_round_trip_and_latest_sequence(spark, feats):
    sc = fit_scaler(feats)
    scaled = sc.transform(feats.select("arrival_no", "series_id", *sc.columns))
    lo_hi = scaled.agg(F.min("energy_kwh"), F.max("energy_kwh")).first()
    assert abs(lo_hi[0]) < 1e-12 and abs(lo_hi[1] - 1.0) < 1e-12
    back = scaled.select(sc.inverse_target(F.col("energy_kwh")).alias("e"), "arrival_no", "series_id").join(
        feats.select("arrival_no", "series_id", "energy_kwh"), ["arrival_no", "series_id"])
    assert back.filter(F.abs(F.col("e") - F.col("energy_kwh")) > 1e-9).count() == 0
    seq = latest_sequence(feats).collect()
    assert len(seq) == 2
    for r in seq:
        assert r["n_steps"] == 24 and len(r["seq"]) == 24 and all(len(step) == 10 for step in r["seq"])


def test_save_load_same_predictions(spark, feats):
    models = fit_forecast_models(feats, rf_params={"numTrees": 3, "maxDepth": 3}, gbt_params={"maxIter": 3, "maxDepth": 3})
    path = os.path.join(ensure_checkpoint_dir(spark), f"models-{uuid.uuid4().hex}")
    models.save(spark, path)
    again = ForecastModels.load(spark, path)
    raw = frame(spark, hourly(spark, 200))
    a = score_series(raw, models).collect()
    b = score_series(raw, again).collect()
    assert [(r["status"], r["prediction"]) for r in a] == [(r["status"], r["prediction"]) for r in b]
    assert a[0]["status"] == "scored" and a[0]["prediction"] is not None


def test_score_series_statuses(spark, feats):
    models = fit_forecast_models(feats, rf_params={"numTrees": 3, "maxDepth": 3}, gbt_params={"maxIter": 3, "maxDepth": 3})
    rows = []
    for n, s in ((5, "len_5"), (47, "len_47"), (48, "len_48"), (168, "len_168"), (169, "len_169")):
        rows += hourly(spark, n, series=s, arrival_base=len(rows) * 10)
    bad = hourly(spark, 200, series="with_null", arrival_base=99999)
    bad[7] = bad[7][:6] + (None,) + bad[7][7:]
    out = {r["series_id"]: r for r in score_series(frame(spark, rows + bad), models).collect()}
    assert out["len_5"]["status"] == "insufficient_history" and out["len_5"]["n_rows"] == 24
    assert out["len_47"]["status"] == "insufficient_history"
    assert out["len_48"]["status"] == "missing_lag" and out["len_168"]["status"] == "missing_lag"
    assert out["len_169"]["status"] == "scored" and out["len_169"]["prediction"] is not None
    assert out["with_null"]["status"] == "invalid_input" and out["with_null"]["prediction"] is None
    r = out["len_169"]
    assert abs(r["prediction"] - (0.5 * r["seq_pred"] + 0.25 * r["rf_pred"] + 0.25 * r["gbt_pred"])) < 1e-9
    imputed = {r["series_id"]: r["status"] for r in score_series(frame(spark, bad), models, mode="impute").collect()}
    assert imputed["with_null"] == "scored"


def test_sequence_model_hooks(spark):
    from wattlane.operators.sequences import sliding_sequences
    seqs = sliding_sequences(frame(spark, hourly(spark, 60)))
    lr = M.train_sequence_model(seqs)
    scored = M.score_sequence_model(lr, seqs)
    assert scored.count() == 36
    # the series is linear, so a linear window model is exact
    assert scored.filter(F.abs(F.col("seq_pred") - F.col("y")) > 1e-6).count() == 0
    udf = M.sequence_model_udf(M.mean_model, 24)
    got = seqs.select(udf(F.col("seq")).alias("m"), "y").first()
    assert abs(got["m"] - (got["y"] - 12.5)) < 1e-9


def test_horizon_one_trains_on_next_row(spark, feats):
    models = fit_forecast_models(feats, rf_params={"numTrees": 2, "maxDepth": 2},
                                 gbt_params={"maxIter": 2, "maxDepth": 2}, horizon=1)
    assert models.rf.stages[-1].getLabelCol() == "label"
    out = score_series(frame(spark, hourly(spark, 200)), models).first()
    assert out["status"] == "scored" and out["prediction"] is not None


def test_boosting_runs_in_few_tasks(spark):
    """Tasks of the fit hang on the cores, not on the partitions of the input; no row is lost."""
    rows = spark.range(500).repartition(40)
    few = M.in_few_tasks(rows)
    assert few.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism < 40
    assert few.count() == 500 and M.in_few_tasks(spark.range(5).repartition(2)).rdd.getNumPartitions() == 2
