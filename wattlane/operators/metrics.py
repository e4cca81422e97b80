"""Counts, grouped means, error metrics and the time split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlane.config import HOT_SERIES_ROWS, VALIDATION_FRACTION
from wattlane.operators.clean import KEYS
from wattlane.plans.ordering import ORDER, SeriesCounts, series_row_number

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType,
           T.DecimalType)


def row_count(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A1 / S4."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))


def avg_by(df: DataFrame, key: str, columns: Sequence[str] | None = None,
           timestamps_as_epoch: bool = False) -> DataFrame:
    """A2: group by one column, average the given (default: all numeric)
    columns as ``avg_<c>``.  Timestamps are averaged as epoch seconds only
    on request."""
    cols = []
    for f in df.schema.fields:
        if f.name == key or (columns is not None and f.name not in columns):
            continue
        if isinstance(f.dataType, NUMERIC) or isinstance(f.dataType, T.BooleanType):
            cols.append(F.avg(F.col(f.name).cast("double")).alias(f"avg_{f.name}"))
        elif timestamps_as_epoch and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            epoch = F.unix_micros(F.col(f.name).cast("timestamp")) / F.lit(1e6)
            cols.append(F.avg(epoch).alias(f"avg_{f.name}"))
    return df.groupBy(key).agg(*cols)


def prediction_bounds(df: DataFrame, actual: str = "y", predicted: str = "prediction",
                      keys: Sequence[str] = ()) -> DataFrame:
    """A4: one min and one max over actual and predicted together."""
    return df.groupBy(*keys).agg(
        F.least(F.min(actual), F.min(predicted)).alias("min_val"),
        F.greatest(F.max(actual), F.max(predicted)).alias("max_val"))


def mae(df: DataFrame, actual: str = "y", predicted: str = "prediction",
        keys: Sequence[str] = ()) -> DataFrame:
    """A5."""
    return df.groupBy(*keys).agg(F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae"))


def rmse(df: DataFrame, actual: str = "y", predicted: str = "prediction",
         keys: Sequence[str] = ()) -> DataFrame:
    """A6."""
    return df.groupBy(*keys).agg(
        F.sqrt(F.avg(F.pow(F.col(actual) - F.col(predicted), 2))).alias("rmse"))


def evaluate(df: DataFrame, actual: str = "y", predicted: str = "prediction",
             keys: Sequence[str] = ()) -> DataFrame:
    """MAE and RMSE in one pass (overall, or per key)."""
    err = F.col(actual) - F.col(predicted)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"))


def actual_vs_predicted(df: DataFrame, actual: str = "y", predicted: str = "prediction",
                        keep: Sequence[str] = ()) -> DataFrame:
    """The two-column frame (plus optional keys)."""
    return df.select(*keep, F.col(actual).alias("actual"), F.col(predicted).alias("predicted"))


def time_split(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER,
               validation_fraction: float = VALIDATION_FRACTION,
               hot_rows: int = HOT_SERIES_ROWS, strategy: str = "auto", counts: SeriesCounts | None = None) -> DataFrame:
    """The newest ``validation_fraction`` of each series, unshuffled, is
    ``validation``: a row is ``train`` when its 0-based position is below
    ``floor(n · (1 − fraction))``.  Position and size come from one
    partitioning of the rows."""
    numbered = series_row_number(df, list(keys), order, strategy=strategy, hot_rows=hot_rows, size_col="_n", counts=counts)
    cut = F.floor(F.col("_n") * F.lit(1.0 - validation_fraction))
    return (numbered
            .withColumn("split", F.when(F.col("rn") < cut, F.lit("train")).otherwise(F.lit("validation")))
            .drop("_n"))
