"""Model operators on tables (M1–M5, M8, M9) and model persistence.

All fitting is Spark ML: the data stays partitioned, only model parameters
reach the driver.  Stored hyper-parameters are the defaults; tests and the
registered queries pass small ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, predict_batch_udf
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.regression import (GBTRegressor, LinearRegression, RandomForestRegressionModel,
                                   RandomForestRegressor)
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlane.config import (BOOST_FEATURES, BOOST_PARAMS, ENSEMBLE_WEIGHTS, GBT_PARAMS, LABEL,
                             RF_PARAMS, SEQUENCE_LENGTH, TREE_FEATURES)
from wattlane.operators.clean import KEYS
from wattlane.operators.sequences import feature_windows, window_moments


def assembler(inputs: Sequence[str] = TREE_FEATURES, output: str = "features") -> VectorAssembler:
    """M1: stored input order; rows with a NULL or NaN input are skipped."""
    return VectorAssembler(inputCols=list(inputs), outputCol=output, handleInvalid="skip")


def assemble_features(df: DataFrame, inputs: Sequence[str] = TREE_FEATURES) -> DataFrame:
    return assembler(inputs).transform(df)


def random_forest(label: str = LABEL, prediction: str = "prediction", **params) -> RandomForestRegressor:
    """M2: numTrees 200, maxDepth 15, minInstancesPerNode 5, seed 42 unless overridden."""
    p = {**RF_PARAMS, **params}
    return RandomForestRegressor(featuresCol="features", labelCol=label, predictionCol=prediction, **p)


def gbt(label: str = LABEL, prediction: str = "prediction", **params) -> GBTRegressor:
    """M3: maxIter 100, maxDepth 10, stepSize 0.1, seed 42 unless overridden."""
    p = {**GBT_PARAMS, **params}
    return GBTRegressor(featuresCol="features", labelCol=label, predictionCol=prediction, **p)


def train_pipeline(df: DataFrame, estimator, inputs: Sequence[str] = TREE_FEATURES) -> PipelineModel:
    return Pipeline(stages=[assembler(inputs), estimator]).fit(df)


def train_random_forest(df: DataFrame, label: str = LABEL, **params) -> PipelineModel:
    return train_pipeline(df.dropna(subset=[label]), random_forest(label=label, **params))


def in_few_tasks(df: DataFrame) -> DataFrame:
    """At most two tasks a core.  Boosting runs some jobs per level and round over the same rows, and each task of each job
    answers to the driver: what the driver gets hangs on the cores then, not on the partitions that the input came in."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, 1))


def train_gbt(df: DataFrame, label: str = LABEL, **params) -> PipelineModel:
    return train_pipeline(in_few_tasks(df.dropna(subset=[label])), gbt(label=label, **params))


def train_boosted(df: DataFrame, label: str = "Power_Consumption", drop_incomplete: bool = True,
                  **params) -> PipelineModel:
    """M4: gradient-boosted trees on lag_1, lag_24, hour, dow, sin_hour,
    cos_hour (500 rounds, rate 0.05, depth 6 by default).  Same model family
    as the original booster, not numerically the same algorithm.  As there, a
    row with a NULL in any column does not train; ``drop_incomplete=False``
    drops only rows whose inputs or label are NULL."""
    train = df.dropna(how="any") if drop_incomplete else df.dropna(subset=BOOST_FEATURES + [label])
    est = GBTRegressor(featuresCol="features", labelCol=label, **{**BOOST_PARAMS, **params})
    return Pipeline(stages=[assembler(BOOST_FEATURES), est]).fit(in_few_tasks(train))


def tree_parts(df: DataFrame, model: PipelineModel, inputs: Sequence[str] = TREE_FEATURES, prediction: str = "prediction") -> DataFrame:
    """Predictions of a fitted ensemble, and as ``from_parts`` what its trees give
    by themselves: their mean (forest) or their weighted sum (boosting)."""
    ensemble = model.stages[-1]
    out = ensemble.copy().setPredictionCol(prediction).transform(assemble_features(df, inputs))
    names = [f"_tree_{i}" for i in range(len(ensemble.trees))]
    for name, tree in zip(names, ensemble.trees):
        out = tree.copy().setPredictionCol(name).transform(out)
    weights = [1.0 / len(names)] * len(names) if isinstance(ensemble, RandomForestRegressionModel) else list(ensemble.treeWeights)
    parts = F.aggregate(F.array(*[F.col(c) * F.lit(w) for c, w in zip(names, weights)]), F.lit(0.0), lambda a, x: a + x)
    return out.withColumn("from_parts", parts).drop("features", *names)


def score_trees(df: DataFrame, rf_model: PipelineModel, gbt_model: PipelineModel,
                inputs: Sequence[str] = TREE_FEATURES) -> DataFrame:
    """Assemble once, run both tree models on the same frame."""
    assembled = assemble_features(df, inputs)
    rf_stage = rf_model.stages[-1].copy().setPredictionCol("rf_pred")
    gbt_stage = gbt_model.stages[-1].copy().setPredictionCol("gbt_pred")
    return gbt_stage.transform(rf_stage.transform(assembled)).drop("features")


# ---- M5: sequence model slot ---------------------------------------------------------

def flatten_sequence(seq: Column, nested: bool = True) -> Column:
    """ARRAY<ARRAY<DOUBLE>> (or, with ``nested=False``, ARRAY<DOUBLE>) → ML vector."""
    return array_to_vector(F.flatten(seq) if nested else seq)


def _is_nested(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType.elementType, T.ArrayType)


def train_sequence_model(sequences: DataFrame, seq_col: str = "seq", label: str = "y",
                         reg_param: float = 0.0, elastic_net: float = 0.0, max_iter: int = 100,
                         split_col: str | None = None, train_value: str = "train"):
    """M5(a): a linear sequence model over the flattened window (the recurrent
    network is not reproduced; its slot takes any Spark ML regressor).  With
    ``split_col`` (M10) it learns from the ``train`` rows only."""
    nested = _is_nested(sequences, seq_col)
    train = sequences if split_col is None else sequences.filter(F.col(split_col) == F.lit(train_value))
    frame = train.select(flatten_sequence(F.col(seq_col), nested).alias("seq_features"), F.col(label))
    lr = LinearRegression(featuresCol="seq_features", labelCol=label, predictionCol="seq_pred",
                          regParam=reg_param, elasticNetParam=elastic_net, maxIter=max_iter)
    return lr.fit(frame)


def train_window_model(features: DataFrame, keys: Sequence[str] = KEYS, seq_len: int = SEQUENCE_LENGTH):
    """``train_sequence_model`` on ``feature_windows``: least squares hangs on the moments of its columns only, so it is
    solved on a few points made from the moments of all windows.  Windows that have none (a missing value
    among them, or no window at all) go to the fit as rows."""
    moments = window_moments(features, keys, seq_len=seq_len)
    if moments is None:
        return train_sequence_model(feature_windows(features, keys, seq_len=seq_len))
    frame = features.sparkSession.createDataFrame([(Vectors.dense(p[:-1]), float(p[-1])) for p in moments.points()], T.StructType([
        T.StructField("seq_features", VectorUDT()), T.StructField("y", T.DoubleType())])).coalesce(1)
    return LinearRegression(featuresCol="seq_features", labelCol="y", predictionCol="seq_pred", maxIter=100).fit(frame)


def score_sequence_model(model, sequences: DataFrame, seq_col: str = "seq") -> DataFrame:
    nested = _is_nested(sequences, seq_col)
    return model.transform(sequences.withColumn("seq_features", flatten_sequence(F.col(seq_col), nested))
                           ).drop("seq_features")


def sequence_model_udf(make_predict_fn, seq_len: int, batch_size: int = 1024):
    """M5(b): hook for a caller's own network, Arrow-batched.  ``make_predict_fn``
    returns a function from a float array of shape (batch, seq_len) to (batch,)."""
    return predict_batch_udf(make_predict_fn, return_type=T.DoubleType(), batch_size=batch_size,
                             input_tensor_shapes=[[seq_len]])


def mean_model():
    """A trivial network stand-in: the mean of the window."""
    import numpy as np

    def predict(x):
        return np.asarray(x, dtype="float64").mean(axis=1)
    return predict


# ---- M8 / M9 ----------------------------------------------------------------------------

def weighted_ensemble(seq_pred: Column, rf_pred: Column, gbt_pred: Column,
                      weights: dict | None = None) -> Column:
    """M8: w_seq·seq + w_rf·rf + w_gbt·gbt; the weights must sum to 1."""
    w = weights or ENSEMBLE_WEIGHTS
    if abs(sum(w.values()) - 1.0) > 1e-9:
        raise ValueError(f"ensemble weights must sum to 1, got {w}")
    return (F.lit(w["sequence"]) * seq_pred + F.lit(w["rf"]) * rf_pred + F.lit(w["gbt"]) * gbt_pred)


def train_stacker(df: DataFrame, inputs: Sequence[str], label: str = "y", split_col: str | None = None,
                  train_value: str = "train"):
    """M9: ordinary least squares on the base predictions (normal equations,
    no regularisation).  Fitted on every given row (in-sample, as the
    original), or only on rows whose ``split_col`` equals ``train_value``."""
    vec = VectorAssembler(inputCols=list(inputs), outputCol="stack_features", handleInvalid="skip")
    lr = LinearRegression(featuresCol="stack_features", labelCol=label, predictionCol="prediction",
                          regParam=0.0, solver="normal", standardization=False)
    train = df if split_col is None else df.filter(F.col(split_col) == F.lit(train_value))
    return Pipeline(stages=[vec, lr]).fit(train)


def stacker_coefficients(model: PipelineModel) -> tuple[float, list[float]]:
    lr = model.stages[-1]
    return float(lr.intercept), [float(c) for c in lr.coefficients]


# ---- S5 ------------------------------------------------------------------------------------

def normal_equations_hold(df: DataFrame, inputs: Sequence[Column], label: str, prediction: str, tolerance: float = 1e-6) -> bool:
    """Whether a least squares fit solves its problem: residuals sum to 0, and to 0 against every input (relative to the data)."""
    r = F.col(label) - F.col(prediction)
    row = df.agg(F.sum(r), F.sum(F.abs(F.col(label))), *[x for c in inputs for x in (F.sum(r * c), F.sum(F.abs(F.col(label) * c)))]).first()
    return all(abs(row[i]) <= tolerance * max(1.0, row[i + 1]) for i in range(0, len(row), 2))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
