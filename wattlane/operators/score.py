"""End-to-end scoring of every series in one plan (M12) and the model bundle.

validate → pad → gate; newest rows → impute → features → newest row to the tree
models, newest 24×10 window to the sequence model → inverse-scale → blend.  Errors
become a ``status`` per series instead of exceptions; nothing is collected.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlane.config import ENERGY_LAGS, LONG_FRAME, SEQUENCE_FEATURES, SEQUENCE_LENGTH, TREE_FEATURES
from wattlane.operators.clean import KEYS, READING_COLUMNS, fill_from_means, series_gate
from wattlane.operators.models import (flatten_sequence, save_model, score_trees,
                                       train_gbt, train_random_forest, train_window_model,
                                       weighted_ensemble)
from wattlane.operators.sequences import (SequenceScaler, fit_scaler,
                                          scale_sequence, scaler_from_rows)
from wattlane.operators.windows import last_n_rows, row_features, with_horizon
from wattlane.plans.keys import join_on_keys
from wattlane.plans.ordering import ORDER

#: Rows that the features of a series' newest ``SEQUENCE_LENGTH`` rows look back on.
RECENT = max(max(ENERGY_LAGS), LONG_FRAME - 1) + SEQUENCE_LENGTH


@dataclass
class ForecastModels:
    rf: PipelineModel
    gbt: PipelineModel
    sequence: LinearRegressionModel
    scaler: SequenceScaler
    booster: PipelineModel | None = None
    meta: PipelineModel | None = None

    def save(self, spark: SparkSession, path: str) -> None:
        """Every part through Spark ML persistence or a parquet table."""
        save_model(self.rf, os.path.join(path, "rf"))
        save_model(self.gbt, os.path.join(path, "gbt"))
        save_model(self.sequence, os.path.join(path, "sequence"))
        for name in ("booster", "meta"):
            if getattr(self, name) is not None:
                save_model(getattr(self, name), os.path.join(path, name))
        spark.createDataFrame(self.scaler.to_rows(), "kind STRING, column STRING, offset DOUBLE, scale DOUBLE") \
            .coalesce(1).write.mode("overwrite").parquet(os.path.join(path, "scaler"))

    @staticmethod
    def load(spark: SparkSession, path: str, parts: Sequence[str] = ()) -> "ForecastModels":
        """``parts`` names the optional models (``booster``, ``meta``) that were saved."""
        rows = [tuple(r) for r in spark.read.parquet(os.path.join(path, "scaler")).collect()]
        order = {c: i for i, c in enumerate(r[1] for r in rows)}
        stacked = {name: PipelineModel.load(os.path.join(path, name)) for name in parts}
        return ForecastModels(
            PipelineModel.load(os.path.join(path, "rf")),
            PipelineModel.load(os.path.join(path, "gbt")),
            LinearRegressionModel.load(os.path.join(path, "sequence")),
            scaler_from_rows(sorted(rows, key=lambda r: order[r[1]])),
            **stacked,
        )


def fit_forecast_models(features: DataFrame, keys: Sequence[str] = KEYS,
                        rf_params: dict | None = None, gbt_params: dict | None = None,
                        scaler_kind: str = "minmax", seq_len: int = SEQUENCE_LENGTH,
                        horizon: int = 0) -> ForecastModels:
    """Train the three base models on a serving-feature frame.

    ``horizon=0`` trains the tree models on the same-row ``energy_kwh`` (the
    stored models' behaviour); ``horizon=1`` on the next row's value.  The
    sequence model always learns the value that follows its window."""
    # four fits read the same frame: keep it once (recomputed from lineage if a block is lost)
    features = features.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        labelled = with_horizon(features, horizon, keys=keys)
        rf = train_random_forest(labelled, label="label", **(rf_params or {}))
        gb = train_gbt(labelled, label="label", **(gbt_params or {}))
        scaler = fit_scaler(features, kind=scaler_kind)
        # only what the windows are made of: a hot series is sorted and stored by its positions
        seq = train_window_model(scaler.transform(features.select(*dict.fromkeys([*keys, *ORDER, *SEQUENCE_FEATURES]))), keys, seq_len)
    finally:
        features.unpersist()
    return ForecastModels(rf, gb, seq, scaler)


def score_recent(recent: DataFrame, models: ForecastModels, keys: Sequence[str] = KEYS,
                 seq_len: int = SEQUENCE_LENGTH, weights: dict | None = None) -> DataFrame:
    """Predictions of series that passed the gate, from their newest ``RECENT``
    rows (measures filled): one window for the features, one aggregate that
    leaves a row per series with the newest features and the ``seq_len`` × 10
    sequence, and both model families on that row."""
    keys = list(keys)
    feats = row_features(recent, keys)
    tail = last_n_rows(feats, seq_len, keys)
    place = F.struct("ts", "arrival_no")
    step = F.struct("ts", "arrival_no", F.array(*[F.col(c).cast("double") for c in SEQUENCE_FEATURES]).alias("x"))
    one = tail.groupBy(*keys).agg(F.max_by(F.struct("ts", *TREE_FEATURES), place).alias("_new"),
                                  F.array_sort(F.collect_list(step)).alias("_steps"))  # at most seq_len steps
    one = one.select(*keys, F.col("_new.ts").alias("scored_ts"), *[F.col(f"_new.{c}").alias(c) for c in TREE_FEATURES],
                     F.transform("_steps", lambda s: s["x"]).alias("seq"))
    one = one.dropna(subset=list(TREE_FEATURES)).filter(F.size("seq") == F.lit(seq_len))
    trees = score_trees(one, models.rf, models.gbt)
    scaled = trees.withColumn("seq_features", flatten_sequence(scale_sequence(F.col("seq"), models.scaler)))
    scored = models.sequence.transform(scaled).withColumnRenamed("seq_pred", "_seq_scaled")
    scored = scored.select(*keys, "scored_ts", "rf_pred", "gbt_pred",
                           models.scaler.inverse_target(F.col("_seq_scaled")).alias("seq_pred"))
    return scored.withColumn("prediction", weighted_ensemble(F.col("seq_pred"), F.col("rf_pred"), F.col("gbt_pred"), weights))


def score_series(readings: DataFrame, models: ForecastModels, keys: Sequence[str] = KEYS,
                 mode: str = "reject", seq_len: int = SEQUENCE_LENGTH, weights: dict | None = None) -> DataFrame:
    """One row per series: ``status`` and, for scored series, the three
    base predictions and the blend.

    ``mode='reject'`` quarantines any series with a NULL (API parity);
    ``mode='impute'`` fills NULLs and rejects a series with a missing stamp, or
    without a single temperature or humidity to fill from.

    Only the newest ``RECENT`` rows of a series matter to its score.  They are
    cut from the raw readings (a window-group limit ahead of the exchange, so a
    hot series ships at most that many rows a task); gate and means come from
    one partial aggregate over all rows.
    """
    keys = list(keys)
    if mode not in ("reject", "impute"):
        raise ValueError(f"unknown mode {mode!r}")
    means = [F.avg(c).alias(f"mean_{c}") for c in ("temperature", "humidity")]
    if mode == "reject":
        gate = series_gate(readings, keys, READING_COLUMNS, seq_len, keep=means)
    else:
        gate = series_gate(readings, keys, ("ts",), seq_len, filled=("temperature", "humidity"), keep=means)
    columns = [*keys, "ts", "arrival_no", "Power_Consumption", "voltage", "current", "temperature", "humidity"]
    recent = last_n_rows(readings.select(*columns), RECENT, keys)
    ok = gate.filter(F.col("status") == "scored").drop("n_rows", "n_feature_rows", "status")
    recent = fill_from_means(join_on_keys(recent, ok, keys), columns)
    preds = score_recent(recent, models, keys, seq_len, weights)
    return join_on_keys(gate.select(*keys, "n_rows", "status"), preds, keys, "left").select(
        *keys, "n_rows", "status", "scored_ts", "seq_pred", "rf_pred", "gbt_pred", "prediction")
