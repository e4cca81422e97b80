"""Cleaning, validation and projection operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlane.config import (HUMIDITY_DEFAULT, MIN_FEATURE_ROWS, POWER_DEFAULT,
                             SEQUENCE_FEATURES, SEQUENCE_LENGTH, TEMPERATURE_DEFAULT)
from wattlane.plans.keys import join_on_keys
from wattlane.plans.ordering import count_series, maybe_broadcast

KEYS = ("series_id",)
READING_COLUMNS = ("ts", "Power_Consumption", "voltage", "current", "temperature", "humidity")


def drop_null_target(df: DataFrame, target: str = "Power_Consumption") -> DataFrame:
    """P1."""
    return df.dropna(subset=[target])


def drop_duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Full-row dedupe (map-side partial dedupe, then one shuffle)."""
    return df.dropDuplicates(list(subset)) if subset else df.dropDuplicates()


def null_profile(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """P5: null count per column, long form ``(keys..., column, null_count)``."""
    wide = df.groupBy(*keys).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return wide.unpivot(list(keys), list(columns), "column", "null_count")


def _any_null(columns: Sequence[str]):
    cond = F.lit(False)
    for c in columns:
        cond = cond | F.col(c).isNull()
    return cond


def reject_series_with_nulls(df: DataFrame, keys: Sequence[str] = KEYS,
                             columns: Sequence[str] = READING_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """A series with any NULL in ``columns`` is quarantined whole.

    The per-series flag is an aggregate (partial on the map side); the split
    is a semi/anti join on the flagged keys, so no series is gathered in one
    task.
    """
    keys = list(keys)
    bad = (df.groupBy(*keys).agg(F.bool_or(_any_null(columns)).alias("_bad"))
           .filter("_bad").select(*keys))
    return join_on_keys(df, bad, keys, "left_anti"), join_on_keys(df, bad, keys, "left_semi")


def series_means(df: DataFrame, keys: Sequence[str] = KEYS,
                 columns: Sequence[str] = ("temperature", "humidity")) -> DataFrame:
    """A3: mean of each column per series."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(f"mean_{c}") for c in columns])


def impute_mean_or_default(df: DataFrame, keys: Sequence[str] = KEYS,
                           all_null_default: bool = False, n_series: int | None = None) -> DataFrame:
    """temperature/humidity NULL → series mean, or 20/50 when that mean is
    exactly 0 (``mean() or default``); an all-NULL column stays NULL unless
    ``all_null_default``.  Target NULL → 0.

    The means (one row per series) are broadcast behind their measured count
    (``n_series``, counted here unless given), so the readings are not shuffled
    for them and a hot series is not gathered; beyond the limit it is a shuffle
    join, which AQE can split."""
    keys = list(keys)
    n = count_series(df, keys).n_series if n_series is None else n_series
    return fill_from_means(join_on_keys(df, maybe_broadcast(series_means(df, keys), n), keys, "left"),
                           df.columns, all_null_default)


def fill_from_means(out: DataFrame, columns: Sequence[str], all_null_default: bool = False) -> DataFrame:
    """The filling of P7 on a frame that carries its series' means."""
    fills = {"temperature": TEMPERATURE_DEFAULT, "humidity": HUMIDITY_DEFAULT}
    cols = []
    for c in columns:
        if c in fills:
            m = F.col(f"mean_{c}")
            fill = F.when(m == 0, F.lit(fills[c])).otherwise(m)
            if all_null_default:
                fill = F.coalesce(fill, F.lit(fills[c]))
            cols.append(F.coalesce(F.col(c), fill).alias(c))
        elif c == "Power_Consumption":
            cols.append(F.coalesce(F.col(c), F.lit(POWER_DEFAULT)).alias(c))
        else:
            cols.append(F.col(c))
    return out.select(*cols)


def require_columns(df: DataFrame | Sequence[str], columns: Sequence[str]) -> DataFrame | Sequence[str]:
    """Fail before any job when a column of the frame (or name of the list) is missing."""
    present = set(df.columns if isinstance(df, DataFrame) else df)
    missing = [c for c in columns if c not in present]
    if missing:
        raise ValueError(f"the frame lacks {', '.join(missing)}")
    return df


def rename_target(df: DataFrame, source: str = "Power_Consumption", target: str = "energy_kwh") -> DataFrame:
    """P9."""
    return df.withColumnRenamed(source, target)


def select_sequence_features(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """P10: the ordered ten-column sequence projection."""
    require_columns(df, SEQUENCE_FEATURES)
    return df.select(*keep, *SEQUENCE_FEATURES)


def drop_warmup_rows(df: DataFrame, subset: Sequence[str] = ("energy_lag_1", "energy_lag_24")) -> DataFrame:
    """Drop rows whose warm-up lags are NULL."""
    return df.dropna(subset=list(subset))


def drop_incomplete_rows(df: DataFrame) -> DataFrame:
    """P11, second form: drop rows with any NULL."""
    return df.dropna(how="any")


def gate_status(n_rows: Column, invalid: Column, seq_len: int = SEQUENCE_LENGTH, deepest_lag: int = 168) -> Column:
    """The one rule of batch and stream, over a series' row count (padding
    included) and whether its input is invalid."""
    return (F.when(invalid, F.lit("invalid_input"))
            .when(n_rows - F.lit(seq_len) < F.lit(MIN_FEATURE_ROWS), F.lit("insufficient_history"))
            .when(n_rows <= F.lit(deepest_lag), F.lit("missing_lag"))
            .otherwise(F.lit("scored")))


def history_status(readings: DataFrame, keys: Sequence[str] = KEYS,
                   columns: Sequence[str] = READING_COLUMNS,
                   seq_len: int = SEQUENCE_LENGTH, deepest_lag: int = 168) -> DataFrame:
    """Per-series gate, one row per series.

    ``invalid_input`` – any NULL in the checked columns;
    ``insufficient_history`` – fewer than ``seq_len`` rows survive warm-up
    (the warm-up drops the first ``seq_len`` rows, so n < 2·seq_len);
    ``missing_lag`` – the newest row has no lag ``deepest_lag`` (n ≤ deepest_lag),
    so the tree models would skip it;
    ``scored`` otherwise.
    """
    n = F.count(F.lit(1))
    feature_rows = F.greatest(n - F.lit(seq_len), F.lit(0))
    status = gate_status(n, F.bool_or(_any_null(columns)), seq_len, deepest_lag)
    return readings.groupBy(*keys).agg(n.cast("long").alias("n_rows"),
                                       feature_rows.cast("long").alias("n_feature_rows"),
                                       status.alias("status"))


def series_gate(readings: DataFrame, keys: Sequence[str] = KEYS,
                columns: Sequence[str] = READING_COLUMNS, seq_len: int = SEQUENCE_LENGTH,
                deepest_lag: int = 168, filled: Sequence[str] = (), keep: Sequence[Column] = ()) -> DataFrame:
    """P12 after J4, from one aggregate over the unpadded readings.

    Padding lifts a series of 1 ≤ n < ``seq_len`` rows to ``seq_len`` rows
    built from its first point with defaults, so it never adds a NULL the
    real rows do not already have and never lifts a series out of
    ``insufficient_history``.  Same result as ``history_status(pad_short_series(...))``
    without materialising the padding.  ``filled`` columns are imputed later:
    only a series that has no value at all in one of them is invalid.  ``keep``
    adds aggregates of the same pass.
    """
    n_padded = F.greatest(F.count(F.lit(1)), F.lit(seq_len))
    feature_rows = F.greatest(n_padded - F.lit(seq_len), F.lit(0))
    invalid = F.bool_or(_any_null(columns))
    for c in filled:
        invalid = invalid | (F.count(c) == 0)
    status = gate_status(n_padded, invalid, seq_len, deepest_lag)
    return readings.groupBy(*keys).agg(n_padded.cast("long").alias("n_rows"),
                                       feature_rows.cast("long").alias("n_feature_rows"),
                                       status.alias("status"), *keep)
