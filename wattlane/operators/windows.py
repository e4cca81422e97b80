"""Positional window operators.

Every feature family is a ``FeatureFn(frame, spec)`` that adds columns over
one ordered window spec; ``plans.ordering.over_series`` decides whether the
spec is a plain per-series window or the chunk+halo plan.  All lags and
frames of one family share one partitioning and one sort.  The long frames
(W2, W3) are merged from states of shorter blocks (``merge_blocks``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from wattlane.config import (CHUNK_ROWS, ENERGY_LAGS, HOT_SERIES_ROWS, LONG_FRAME,
                             ROLLING_3H_PRECEDING, ROLLING_BLOCK, SHORT_FRAME, TRAINING_LAGS, VALUE_LAGS,
                             VALUE_ROLLING)
from wattlane.functions.calendar import (calendar_columns, cyclic_hour, dow_sunday1,
                                         flag_columns, weather_interactions)
from wattlane.functions.text import parse_timestamp
from wattlane.operators.clean import (KEYS, drop_duplicate_rows, drop_null_target,
                                      drop_warmup_rows, impute_mean_or_default, rename_target)
from wattlane.plans.ordering import ORDER, SeriesCounts, count_series, over_series, plain_window

POWER = "Power_Consumption"


def _rows(spec: WindowSpec, preceding: int, following: int = 0) -> WindowSpec:
    return spec.rowsBetween(-preceding, following)


# ---- feature families: (frame, spec) -> frame ---------------------------------

def energy_lag_cols(spec: WindowSpec, col: str = POWER, lags: Sequence[int] = ENERGY_LAGS,
                    prefix: str = "energy_lag_") -> list[Column]:
    """W1."""
    return [F.lag(F.col(col), k).over(spec).alias(f"{prefix}{k}") for k in lags]


def first_block(frame: DataFrame, spec: WindowSpec, col: str, size: int) -> DataFrame:
    """State of the newest ``size`` rows by an ordinary frame: count ``_n``, mean ``_m``,
    squared deviations ``_q``, ``_lo`` and ``_hi`` (names end in the size).  NULLs do not count."""
    c, w = F.col(col), _rows(spec, size - 1)
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    # the mean of equal values is that value, without the rounding of sum / count
    return frame.select("*", F.count(c).over(w).alias(f"_n{size}"), F.when(lo == hi, lo).otherwise(F.avg(c).over(w)).alias(f"_m{size}"),
                        F.coalesce(F.var_pop(c).over(w) * F.count(c).over(w), F.lit(0.0)).alias(f"_q{size}"),
                        lo.alias(f"_lo{size}"), hi.alias(f"_hi{size}"))


def merge_blocks(frame: DataFrame, spec: WindowSpec, inner: int, size: int, extremes: bool = False) -> DataFrame:
    """State of the newest ``size`` rows out of the states of ``inner`` rows that
    lie whole blocks back (``lag``), over the partitioning and order that are there.

    A row costs ``size / inner`` steps, not ``size``.  States are merged around the
    newest mean and never subtracted: nothing cancels on long series, equal blocks
    have deviation 0 between them, and a NaN is gone once it leaves the frame.
    """
    if size % inner:
        raise ValueError(f"{size} is no multiple of {inner}")
    own, back = frame.columns, range(1, size // inner)
    fields = ["n", "m", "q", "lo", "hi"] if extremes else ["n", "m", "q"]
    frame = frame.select("*", *[F.lag(f"_{x}{inner}", inner * k).over(spec).alias(f"_{x}{inner}_{k}") for k in back for x in fields])
    parts = {x: [F.col(f"_{x}{inner}"), *[F.col(f"_{x}{inner}_{k}") for k in back]] for x in fields}
    counts = [F.coalesce(n, F.lit(0)) for n in parts["n"]]
    total, mean = F.col(f"_n{size}"), F.col(f"_m{size}")
    frame = frame.select("*", sum(counts[1:], counts[0]).alias(f"_n{size}"), F.coalesce(*parts["m"]).alias("_near"))
    off = [F.when(n > 0, n * (m - F.col("_near"))).otherwise(F.lit(0.0)) for n, m in zip(counts, parts["m"])]
    sums = [F.when(n > 0, n * m).otherwise(F.lit(0.0)) for n, m in zip(counts, parts["m"])]
    near = F.col("_near") + sum(off[1:], off[0]) / total
    # infinite values have no distance from the newest mean
    frame = frame.select("*", F.when(total > 0, F.nanvl(near, sum(sums[1:], sums[0]) / total)).alias(f"_m{size}"))
    dev = [F.when(n > 0, q + n * (m - mean) * (m - mean)).otherwise(F.lit(0.0)) for n, m, q in zip(counts, parts["m"], parts["q"])]
    ends = [F.least(*parts["lo"]).alias(f"_lo{size}"), F.greatest(*parts["hi"]).alias(f"_hi{size}")] if extremes else []
    return frame.select(*own, total, mean, sum(dev[1:], dev[0]).alias(f"_q{size}"), *ends)


def block_std(size: int) -> Column:
    """Sample deviation of a block state; NULL below two values."""
    n = F.col(f"_n{size}")
    return F.when(n > 1, F.sqrt(F.col(f"_q{size}") / (n - 1)))


def rolling_frames(frame: DataFrame, spec: WindowSpec, col: str = POWER) -> DataFrame:
    """mean/std/min/max over the current row and the 23 before it.
    W3: mean/std over the current row and the 167 before it, from W2's states."""
    kept, day, week = frame.columns, SHORT_FRAME, LONG_FRAME
    frame = first_block(frame, spec, col, ROLLING_BLOCK)
    frame = merge_blocks(frame, spec, ROLLING_BLOCK, day, extremes=True)
    frame = frame.select(*kept, *[f"_{x}{day}" for x in ("n", "m", "q", "lo", "hi")])
    frame = merge_blocks(frame, spec, day, week)
    return frame.select(*kept, F.col(f"_m{day}").alias("energy_mean_24h"), block_std(day).alias("energy_std_24h"),
                        F.col(f"_lo{day}").alias("energy_min_24h"), F.col(f"_hi{day}").alias("energy_max_24h"),
                        F.col(f"_m{week}").alias("energy_mean_7d"), block_std(week).alias("energy_std_7d"))


def training_lag_cols(spec: WindowSpec, col: str = POWER) -> list[Column]:
    """lag_1, lag_24."""
    return [F.lag(F.col(col), k).over(spec).alias(f"lag_{k}") for k in TRAINING_LAGS]


def rolling_3h_col(spec: WindowSpec, col: str = POWER) -> Column:
    """Mean over FOUR rows (rowsBetween(-3, 0)), name kept as is."""
    return F.avg(F.col(col)).over(_rows(spec, ROLLING_3H_PRECEDING)).alias("rolling_3h")


def short_lag_cols(spec: WindowSpec, col: str = "value") -> list[Column]:
    """lag_1..lag_3."""
    return [F.lag(F.col(col), k).over(spec).alias(f"lag_{k}") for k in VALUE_LAGS]


def rolling_strict_cols(spec: WindowSpec, col: str = "value",
                        sizes: Sequence[int] = VALUE_ROLLING) -> list[Column]:
    """Mean over exactly n rows; NULL until the frame is full or when any
    value inside it is NULL."""
    out = []
    for n in sizes:
        w = _rows(spec, n - 1)
        full = F.count(F.lit(1)).over(w) == F.lit(n)
        complete = F.count(F.col(col)).over(w) == F.lit(n)
        out.append(F.when(full & complete, F.avg(F.col(col)).over(w)).alias(f"rolling_{n}"))
    return out


# ---- operators ------------------------------------------------------------------

def _plan(strategy: str, hot_rows: int, chunk_rows: int, num_partitions: int | None) -> dict:
    return {"strategy": strategy, "hot_rows": hot_rows, "chunk_rows": chunk_rows,
            "num_partitions": num_partitions}


def energy_lags(df: DataFrame, keys: Sequence[str] = KEYS, col: str = POWER,
                lags: Sequence[int] = ENERGY_LAGS, strategy: str = "auto",
                hot_rows: int = HOT_SERIES_ROWS, chunk_rows: int = CHUNK_ROWS,
                num_partitions: int | None = None) -> DataFrame:
    """W1 as an operator."""
    return over_series(df, keys, lambda f, s: f.select("*", *energy_lag_cols(s, col, lags)),
                       halo=max(lags), **_plan(strategy, hot_rows, chunk_rows, num_partitions))


def rolling_features(df: DataFrame, keys: Sequence[str] = KEYS, col: str = POWER,
                     strategy: str = "auto", hot_rows: int = HOT_SERIES_ROWS,
                     chunk_rows: int = CHUNK_ROWS, num_partitions: int | None = None) -> DataFrame:
    """W2 + W3 over one sort."""
    return over_series(df, keys,
                       lambda f, s: rolling_frames(f, s, col),
                       halo=LONG_FRAME - 1, **_plan(strategy, hot_rows, chunk_rows, num_partitions))


def build_value_features(df: DataFrame, keys: Sequence[str] = KEYS, col: str = "value",
                         order: Sequence[str] = ORDER, strategy: str = "auto",
                         hot_rows: int = HOT_SERIES_ROWS, chunk_rows: int = CHUNK_ROWS,
                         num_partitions: int | None = None) -> DataFrame:
    """lag_1..3, strict rolling_3 / rolling_5, then drop rows with any NULL.
    Needs an explicit order (the original relied on the row order it got)."""
    def fn(f: DataFrame, s: WindowSpec) -> DataFrame:
        return f.select("*", *short_lag_cols(s, col), *rolling_strict_cols(s, col))
    out = over_series(df, keys, fn, halo=max(max(VALUE_LAGS), max(VALUE_ROLLING) - 1), order=order,
                      **_plan(strategy, hot_rows, chunk_rows, num_partitions))
    return out.dropna(how="any")


def last_n_rows(df: DataFrame, n: int, keys: Sequence[str] = KEYS,
                order: Sequence[str] = ORDER, newest: bool = True, rank_col: str | None = None) -> DataFrame:
    """Newest (or oldest) ``n`` rows per series.

    ``row_number() <= n`` lets Catalyst insert a partial window-group limit
    before the exchange, so a hot series ships at most ``n`` rows per input
    partition.
    """
    from pyspark.sql import Window
    sort = [F.col(c).desc() for c in order] if newest else [F.col(c).asc() for c in order]
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*sort))
    out = df.withColumn("_rank", rn).filter(F.col("_rank") <= F.lit(n))
    return out.withColumnRenamed("_rank", rank_col) if rank_col else out.drop("_rank")


def row_features(readings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The columns of W13 for frames that hold few rows per series (a tail, say):
    plain windows, measures already filled, warm-up rows kept."""
    s = plain_window(list(keys))
    feats = rolling_frames(readings.select("*", *energy_lag_cols(s)), s)
    feats = feats.select("*", *calendar_columns("ts")).select("*", *flag_columns())
    return rename_target(feats.select("*", *weather_interactions()))


def serving_features(readings: DataFrame, keys: Sequence[str] = KEYS, impute: bool = True,
                     strategy: str = "auto", hot_rows: int = HOT_SERIES_ROWS,
                     chunk_rows: int = CHUNK_ROWS, num_partitions: int | None = None,
                     drop_warmup: bool = True) -> DataFrame:
    """W13 (flagship): impute → calendar → flags → lags → 24-row and 168-row
    frames → interactions → rename → drop warm-up rows, for every series in
    one plan."""
    keys = list(keys)
    # one count on the raw readings (key columns only) serves the means join and the window plan
    counts = count_series(readings, keys, hot_rows) if strategy != "plain" or impute else None
    df = impute_mean_or_default(readings, keys, n_series=counts.n_series) if impute else readings
    base = df.select(*keys, "ts", "arrival_no", POWER, "voltage", "current", "temperature", "humidity")

    def fn(f: DataFrame, s: WindowSpec) -> DataFrame:
        return rolling_frames(f.select("*", *energy_lag_cols(s)), s)

    feats = over_series(base, keys, fn, halo=max(max(ENERGY_LAGS), LONG_FRAME - 1), counts=counts,
                        **_plan(strategy, hot_rows, chunk_rows, num_partitions))
    if drop_warmup:
        feats = drop_warmup_rows(feats)
    # row-local columns come after the window: they are not shuffled, sorted or checkpointed
    feats = feats.select("*", *calendar_columns("ts")).select("*", *flag_columns())
    return rename_target(feats.select("*", *weather_interactions()))


def global_series_features(readings: DataFrame, chunk_rows: int = CHUNK_ROWS,
                           num_partitions: int | None = None, impute: bool = True) -> DataFrame:
    """The serving feature set over one unpartitioned series (all rows),
    via the chunk+halo plan so no task holds the whole table."""
    one = readings.withColumn("series_id", F.lit("all"))
    return serving_features(one, ["series_id"], impute=impute, strategy="chunked",
                            chunk_rows=chunk_rows, num_partitions=num_partitions)


def training_features(raw: DataFrame, keys: Sequence[str] = KEYS, target: str = POWER,
                      strategy: str = "auto", hot_rows: int = HOT_SERIES_ROWS,
                      chunk_rows: int = CHUNK_ROWS, num_partitions: int | None = None) -> DataFrame:
    """Drop NULL target, dedupe, parse ``ts``, hour, dow (Sunday = 1),
    sin/cos hour, lag_1, lag_24, rolling_3h.

    A re-delivered reading differs in nothing but our own ``arrival_no``; the
    earliest arrival stays (a partial aggregate, then one shuffle)."""
    df = drop_null_target(raw, target)
    own = [c for c in df.columns if c != "arrival_no"]
    df = (df.groupBy(*own).agg(F.min("arrival_no").alias("arrival_no")).select(*df.columns)
          if "arrival_no" in df.columns else drop_duplicate_rows(df))
    if "ts" not in df.columns:
        df = df.withColumn("ts", parse_timestamp(F.col("timestamp")))

    def fn(f: DataFrame, s: WindowSpec) -> DataFrame:
        return f.select("*", *training_lag_cols(s, target), rolling_3h_col(s, target))

    out = over_series(df, keys, fn, halo=max(max(TRAINING_LAGS), ROLLING_3H_PRECEDING),
                      **_plan(strategy, hot_rows, chunk_rows, num_partitions))
    out = out.select("*", F.hour("ts").alias("hour"), dow_sunday1("ts").alias("dow"))
    return out.select("*", *cyclic_hour())


def with_horizon(features: DataFrame, horizon: int = 0, label: str = "energy_kwh",
                 out_col: str = "label", keys: Sequence[str] = KEYS, strategy: str = "auto",
                 hot_rows: int = HOT_SERIES_ROWS, chunk_rows: int = CHUNK_ROWS,
                 num_partitions: int | None = None, counts: SeriesCounts | None = None) -> DataFrame:
    """The training label.  ``horizon=0`` is the same-row value (the
    stored tree models' behaviour); ``horizon=h`` is the value ``h`` rows
    later (``lead``), NULL for the last ``h`` rows of a series."""
    if horizon == 0:
        return features.withColumn(out_col, F.col(label))
    return over_series(features, keys, lambda f, s: f.select("*", F.lead(F.col(label), horizon).over(s).alias(out_col)),
                       halo=0, lookahead=horizon, counts=counts, **_plan(strategy, hot_rows, chunk_rows, num_partitions))


def sort_by_time(df: DataFrame, keys: Sequence[str] = KEYS, order: Sequence[str] = ORDER) -> DataFrame:
    """O1: total order, for sinks only (windows sort by themselves)."""
    return df.orderBy(*keys, *order)
