"""Sequence operators (W10–W12) and sequence scaling (M6, M7).

Sliding windows are arrays of ``lag`` offsets over the same ordered spec as
the other lags, so they ride on the same exchange, cost O(1) per row and
offset, and the chunk+halo plan covers them with a halo of ``seq_len``
rows.  NULL values keep their slot.

Training reads the same windows from ``sequence_blocks``: overlapping blocks of
rows that hold every value once (and ``seq_len`` of them twice), so neither a
shuffle, a cache nor an Arrow batch carries a value ``seq_len`` times.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from wattlane.config import (BLOCK_WINDOWS, CHUNK_ROWS, HOT_SERIES_ROWS, SEQUENCE_FEATURES, SEQUENCE_LENGTH,
                             VALIDATION_FRACTION)
from wattlane.operators.clean import KEYS
from wattlane.operators.windows import last_n_rows
from wattlane.plans.ordering import ORDER, SeriesCounts, count_series, over_series, range_partitions, series_row_number, with_chunks

POWER = "Power_Consumption"


def window_is_full(spec: WindowSpec, seq_len: int, order_col: str = "arrival_no") -> Column:
    """True when ``seq_len`` rows precede the current one (the ordering column
    is never NULL)."""
    return F.lag(F.col(order_col), seq_len).over(spec).isNotNull()


def window_values(spec: WindowSpec, col: str, seq_len: int) -> Column:
    """The ``seq_len`` values before the current row, oldest first, built from
    ``lag`` offsets (O(1) per row each; NULL values keep their slot).  Until
    the window is full the array is empty, never padded with NULLs, so an
    expression that Catalyst evaluates ahead of the size filter (a model UDF
    in a pushed-down predicate, say) never sees a half window."""
    lags = F.array(*[F.lag(F.col(col), seq_len - j).over(spec) for j in range(seq_len)])
    return F.when(window_is_full(spec, seq_len), lags).otherwise(F.array().cast("array<double>"))


def sliding_sequences(df: DataFrame, keys: Sequence[str] = KEYS, col: str = POWER,
                      seq_len: int = SEQUENCE_LENGTH, with_target: bool = True,
                      strategy: str = "auto", hot_rows: int = HOT_SERIES_ROWS,
                      chunk_rows: int = CHUNK_ROWS, num_partitions: int | None = None) -> DataFrame:
    """Every full window of ``seq_len`` values and (W10) the value
    that follows it as ``y``; a series of n rows gives max(n − seq_len, 0)."""
    def fn(f: DataFrame, s: WindowSpec) -> DataFrame:
        return f.select("*", window_values(s, col, seq_len).alias("seq"))

    out = over_series(df, keys, fn, halo=seq_len, strategy=strategy, hot_rows=hot_rows,
                      chunk_rows=chunk_rows, num_partitions=num_partitions)
    out = out.filter(F.size("seq") == F.lit(seq_len))
    if with_target:
        out = out.withColumn("y", F.col(col))
    return out


def sequence_blocks(df: DataFrame, keys: Sequence[str] = KEYS, col: str = POWER, seq_len: int = SEQUENCE_LENGTH,
                    block_windows: int = BLOCK_WINDOWS, validation_fraction: float = VALIDATION_FRACTION,
                    order: Sequence[str] = ORDER, strategy: str = "auto", hot_rows: int = HOT_SERIES_ROWS,
                    num_partitions: int | None = None, counts: SeriesCounts | None = None) -> DataFrame:
    """W10 for training: one row per series and ``block`` with ``values`` (the
    ``seq_len`` rows before the block, then its own) and, for each of its windows,
    the order columns of the row that follows it.  Window ``i`` is
    ``values[i : i + seq_len]`` and its target ``values[i + seq_len]``; the first
    ``n_train`` of ``n_windows`` belong to the older part of the series (M10).

    A block has at most ``max(block_windows, seq_len) + seq_len`` values whatever
    the series holds; hot series are numbered by the chunked plan.
    """
    keys, order = list(keys), list(order)
    rows = df.select(*keys, *order, F.col(col).cast("double").alias("_v"))
    rows = series_row_number(rows, keys, order, strategy=strategy, hot_rows=hot_rows, num_partitions=num_partitions,
                             col="_rn", size_col="_size", counts=counts)
    rows = with_chunks(rows, halo=seq_len, chunk_rows=block_windows, pos_col="_rn")
    blocks = (rows.groupBy(*keys, F.col("_chunk").alias("block"))
              .agg(F.array_sort(F.collect_list(F.struct("_rn", *order, "_v"))).alias("_s"), F.max("_size").alias("_size"))
              .filter(F.size("_s") > F.lit(seq_len)))
    n = F.size("_s") - F.lit(seq_len)
    older = F.floor((F.col("_size") - F.lit(seq_len)) * F.lit(1.0 - validation_fraction))
    before = F.get("_s", F.lit(seq_len))["_rn"] - F.lit(seq_len)
    return blocks.select(*keys, "block", F.col("_s")["_v"].alias("values"),
                         *[F.slice(F.col("_s")[c], F.lit(seq_len + 1), n).alias(c) for c in order],
                         n.alias("n_windows"), F.least(F.greatest(older - before, F.lit(0)), n).cast("int").alias("n_train"))


def block_sequences(blocks: DataFrame, keys: Sequence[str] = KEYS, seq_len: int = SEQUENCE_LENGTH,
                    order: Sequence[str] = ORDER) -> DataFrame:
    """The windows of ``sequence_blocks`` as rows: keys, order columns, ``seq``,
    ``y`` and ``split``, as ``time_split`` of ``sliding_sequences`` gives them."""
    # a block becomes an array of small structs first: rows that carried their whole block along would hold every value
    # ``block_windows`` times wherever they are buffered (before a Python function, say)
    each = F.transform(F.sequence(F.lit(0), F.col("n_windows") - 1), lambda i: F.struct(
        *[F.get(c, i).alias(c) for c in order], F.slice("values", i + 1, F.lit(seq_len)).alias("seq"), F.get("values", i + F.lit(seq_len)).alias("y"),
        F.when(i < F.col("n_train"), F.lit("train")).otherwise(F.lit("validation")).alias("split")))
    return blocks.select(*keys, F.inline(each))


def latest_sequence(features: DataFrame, keys: Sequence[str] = KEYS,
                    feature_cols: Sequence[str] = SEQUENCE_FEATURES,
                    seq_len: int = SEQUENCE_LENGTH, order: Sequence[str] = ORDER) -> DataFrame:
    """The newest ``seq_len`` rows × features of each series as
    ``ARRAY<ARRAY<DOUBLE>>`` (time-major, oldest first).  The group is at
    most ``seq_len`` rows after the window-group limit."""
    keys = list(keys)
    tail = last_n_rows(features, seq_len, keys, order)
    step = F.struct(*[F.col(c) for c in order],
                    F.array(*[F.col(c).cast("double") for c in feature_cols]).alias("x"))
    return (tail.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(step)).alias("_steps"))
            .select(*keys, F.transform("_steps", lambda s: s["x"]).alias("seq"),
                    F.size("_steps").alias("n_steps"),
                    F.element_at("_steps", -1)[order[0]].alias("last_ts")))


# ---- M6 / M7 ------------------------------------------------------------------------

@dataclass
class SequenceScaler:
    """Fitted per-feature scaler; parameters are a handful of numbers.

    ``minmax``: (x − min) / (max − min), a zero range scales by 1;
    ``standard``: (x − mean) / std (population), a zero std scales by 1.
    The target is feature 0.
    """

    kind: str
    columns: list[str]
    offset: list[float]
    scale: list[float]

    def transform(self, df: DataFrame, suffix: str = "") -> DataFrame:
        cols = []
        for c in df.columns:
            if c in self.columns and not suffix:
                cols.append(self._apply(c).alias(c))
            else:
                cols.append(F.col(c))
        if suffix:
            cols += [self._apply(c).alias(f"{c}{suffix}") for c in self.columns]
        return df.select(*cols)

    def _apply(self, c: str) -> Column:
        i = self.columns.index(c)
        return (F.col(c).cast("double") - F.lit(self.offset[i])) / F.lit(self.scale[i])

    def inverse_target(self, scaled: Column, index: int = 0) -> Column:
        """M7: undo the scaling of one feature (the target by default)."""
        return scaled * F.lit(self.scale[index]) + F.lit(self.offset[index])

    def to_rows(self) -> list[tuple]:
        return [(self.kind, c, o, s) for c, o, s in zip(self.columns, self.offset, self.scale)]


def fit_scaler(df: DataFrame, columns: Sequence[str] = SEQUENCE_FEATURES,
               kind: str = "minmax") -> SequenceScaler:
    """M6: one global aggregate (partial per task), a few numbers back."""
    columns = list(columns)
    if kind == "minmax":
        aggs = [F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in columns]
        aggs += [F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in columns]
        row = df.agg(*aggs).first()
        lo = [row[f"lo_{c}"] for c in columns]
        rng = [row[f"hi_{c}"] - row[f"lo_{c}"] for c in columns]
        return SequenceScaler(kind, columns, lo, [r if r != 0 else 1.0 for r in rng])
    if kind == "standard":
        aggs = [F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in columns]
        aggs += [F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in columns]
        row = df.agg(*aggs).first()
        mean = [row[f"m_{c}"] for c in columns]
        std = [row[f"s_{c}"] for c in columns]
        return SequenceScaler(kind, columns, mean, [s if s else 1.0 for s in std])
    raise ValueError(f"unknown scaler kind {kind!r}")


def scaler_from_rows(rows: Sequence[tuple]) -> SequenceScaler:
    kind = rows[0][0]
    return SequenceScaler(kind, [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows])


def scale_sequence(seq: Column, scaler: SequenceScaler) -> Column:
    """Scale an ``ARRAY<ARRAY<DOUBLE>>`` sequence step by step, as array math."""
    offs = F.array(*[F.lit(o) for o in scaler.offset])
    scl = F.array(*[F.lit(s) for s in scaler.scale])
    return F.transform(seq, lambda step: F.zip_with(
        F.zip_with(step, offs, lambda x, o: x - o), scl, lambda d, s: d / s))



def feature_windows(features: DataFrame, keys: Sequence[str] = KEYS,
                    feature_cols: Sequence[str] = SEQUENCE_FEATURES, label: str = "energy_kwh",
                    seq_len: int = SEQUENCE_LENGTH, strategy: str = "auto",
                    hot_rows: int = HOT_SERIES_ROWS, chunk_rows: int = CHUNK_ROWS,
                    num_partitions: int | None = None) -> DataFrame:
    """Multivariate training windows: the previous ``seq_len`` rows × features
    as ``ARRAY<ARRAY<DOUBLE>>`` and the current row's label as ``y``."""
    cols = [F.col(c).cast("double") for c in feature_cols]

    def fn(f: DataFrame, s: WindowSpec) -> DataFrame:
        steps = F.array(*[F.array(*[F.lag(c, seq_len - j).over(s) for c in cols]) for j in range(seq_len)])
        empty = F.array().cast("array<array<double>>")
        return f.select("*", F.when(window_is_full(s, seq_len), steps).otherwise(empty).alias("seq"))

    out = over_series(features, keys, fn, halo=seq_len, strategy=strategy, hot_rows=hot_rows,
                      chunk_rows=chunk_rows, num_partitions=num_partitions)
    return out.filter(F.size("seq") == F.lit(seq_len)).withColumn("y", F.col(label).cast("double"))


@dataclass
class Moments:
    """Count, mean and summed products of deviations of some columns; states of parts merge into the state of the whole."""

    n: int
    mean: np.ndarray
    dev: np.ndarray

    @staticmethod
    def none(width: int) -> "Moments":
        return Moments(0, np.zeros(width), np.zeros((width, width)))

    @staticmethod
    def of(z: np.ndarray) -> "Moments":
        mean = z.mean(axis=0)
        d = z - mean
        return Moments(len(z), mean, d.T @ d)

    def merged(self, other: "Moments") -> "Moments":
        if not (self.n and other.n):
            return self if self.n else other
        n, off = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + off * (other.n / n), self.dev + other.dev + np.outer(off, off) * (self.n * other.n / n))

    def points(self) -> np.ndarray:
        """Twice as many points as columns, on which least squares for the last column has the solution of the rows.
        Directions in which the rows do not vary (columns may repeat each other) leave it open: there the points vary
        without the last column, so the solution is the shortest of the equally good.  A column of one value is 0: it
        has no part in the fit."""
        scale = np.sqrt(np.where(np.diag(self.dev) > 1e-20 * self.n * self.mean ** 2, np.diag(self.dev), 0.0))
        per = np.divide(1.0, scale, out=np.zeros_like(scale), where=scale > 0)
        dev = self.dev * np.outer(per, per)
        size, axes = np.linalg.eigh(dev[:-1, :-1])
        open_ = size <= 1e-11 * max(size[-1], 1e-300)
        size[open_] = 1.0
        slope = np.where(open_, 0.0, axes.T @ dev[:-1, -1]) / np.sqrt(size)
        off = np.zeros((len(scale), len(scale)))  # one axis a row
        off[:-1, :-1], off[:-1, -1], off[-1, -1] = (axes * np.sqrt(size)).T, slope, np.sqrt(max(dev[-1, -1] - slope @ slope, 0.0))
        off *= scale * np.sqrt(len(scale) / self.n)
        mean = np.append(np.where(scale > 0, self.mean, 0.0)[:-1], self.mean[-1])
        return np.concatenate((mean + off, mean - off))


MOMENTS = "n long, broken long, mean binary, dev binary"


def _moments_batch(m: Moments, broken: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"n": pa.array([m.n], pa.int64()), "broken": pa.array([broken], pa.int64()),
                                       "mean": [m.mean.tobytes()], "dev": [m.dev.tobytes()]})


def window_moments(features: DataFrame, keys: Sequence[str] = KEYS, feature_cols: Sequence[str] = SEQUENCE_FEATURES,
                   label: str = "energy_kwh", seq_len: int = SEQUENCE_LENGTH, order: Sequence[str] = ORDER, strategy: str = "auto",
                   hot_rows: int = HOT_SERIES_ROWS, chunk_rows: int = CHUNK_ROWS, num_partitions: int | None = None) -> Moments | None:
    """Moments of the columns of ``feature_windows`` (flattened, then the label), over all of its rows; None if there is no
    window, or a window or its label holds a NULL, NaN or infinite value.

    Rows lie in order in a task, so a window is a view of the ``seq_len`` rows before its target and no window is stored:
    blocks of windows are multiplied, and a state of fixed size leaves the task.
    """
    keys, order, width = list(keys), list(order), len(feature_cols)
    counts = count_series(features, keys, hot_rows)
    rows = features.select(*keys, *order, *[F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(feature_cols)], F.col(label).cast("double").alias("_y"))
    rows = series_row_number(rows, keys, order, strategy=strategy, hot_rows=hot_rows, num_partitions=num_partitions, col="_rn", counts=counts)
    rows = with_chunks(rows, halo=seq_len, chunk_rows=chunk_rows, pos_col="_rn")
    tasks = num_partitions or range_partitions(features, counts.n_rows)
    rows = rows.repartition(tasks, *keys, "_chunk").sortWithinPartitions(*keys, "_chunk", "_rn")
    columns, size = [f"_x{k}" for k in range(width)] + ["_y"], seq_len * width + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, broken = Moments.none(size), 0
        left = np.zeros((0, width + 3))  # the rows before the batch that its windows reach back to
        for b in batches:
            got = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
            now = np.stack([*got, b.column("_rn").to_numpy(), b.column("_chunk").to_numpy()], axis=1).astype(np.float64)
            z = np.concatenate((left, now))
            left = z[-seq_len:]
            if len(z) <= seq_len:
                continue
            x, y, rn, chunk = np.ascontiguousarray(z[:, :width]), z[:, width], z[:, -2], z[:, -1]
            run = np.cumsum(np.append(True, (np.diff(rn) != 1) | (np.diff(chunk) != 0)))
            at = np.flatnonzero(run[seq_len:] == run[:-seq_len])  # window ``k`` is the rows k to k + seq_len, its target the next
            view = np.lib.stride_tricks.as_strided(x, (len(x) - seq_len, seq_len * width), (x.strides[0], x.strides[1]), writeable=False)
            for lo in range(0, len(at), 4096):
                some = at[lo:lo + 4096]
                both = np.empty((len(some), size))
                both[:, :-1], both[:, -1] = view[some], y[some + seq_len]
                whole = np.isfinite(both).all(axis=1)
                if not whole.all():
                    broken += int((~whole).sum())
                    both = both[whole]
                if len(both):
                    total = total.merged(Moments.of(both))
        yield _moments_batch(total, broken)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, broken = Moments.none(size), 0
        for b in batches:
            for n, bad, mean, dev in zip(*(b.column(c).to_pylist() for c in ("n", "broken", "mean", "dev"))):
                total, broken = total.merged(Moments(n, np.frombuffer(mean), np.frombuffer(dev).reshape(size, size))), broken + bad
        yield _moments_batch(total, broken)

    parts = rows.select(*columns, "_rn", "_chunk").mapInArrow(sums, MOMENTS).repartition(8).mapInArrow(merge, MOMENTS)
    total, broken = Moments.none(size), 0
    for r in parts.collect():  # at most eight
        total, broken = total.merged(Moments(r.n, np.frombuffer(r["mean"]), np.frombuffer(r.dev).reshape(size, size))), broken + r.broken
    return total if total.n and not broken else None
