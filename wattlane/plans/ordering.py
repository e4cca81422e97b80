"""Positional windows over series of any size.

Lags and framed aggregates are row-positional within a series ordered by
``(ts, arrival_no)``.  Three physical shapes, one logical meaning:

* ``plain``   – ``Window.partitionBy(series).orderBy(ts, arrival_no)``: one
  exchange on the series key, one sort.  A series must fit one task.
* ``chunked`` – every row gets its global position ``_g`` in the total order
  (range partitioning + per-partition counts, no single-task window over the
  data), rows are cut into chunks of ``chunk_rows`` and the last ``halo``
  rows of each chunk are copied into the next one.  Windows run over
  ``(series, chunk)``; only the chunk's own rows are kept.  Exact as long as
  ``halo`` covers the deepest lag / widest frame.
* ``auto``    – series with more than ``hot_rows`` rows take the chunked plan,
  all others the plain one.  The hot-key set has at most
  ``total_rows / hot_rows`` entries, so broadcasting it is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from wattlane.config import BROADCAST_KEYS_LIMIT, CHUNK_ROWS, HOT_SERIES_ROWS, RANGE_PARTITION_ROWS
from wattlane.session import scratch_table
from wattlane.plans.keys import join_on_keys

ORDER = ("ts", "arrival_no")
FeatureFn = Callable[[DataFrame, WindowSpec], DataFrame]


def global_position(df: DataFrame, sort_cols: Sequence[str], num_partitions: int | None = None,
                    pos_col: str = "_g", checkpoint: bool = True) -> DataFrame:
    """Attach the 0-based position of each row in the total order ``sort_cols``.

    Range partitioning samples the key distribution, so a hot key is spread
    over many partitions.  Inside a partition the sorted rows are numbered by
    ``monotonically_increasing_id``; the offsets of the partitions come from a
    table with one row per partition (bounded by ``num_partitions``) that is
    broadcast back.  The numbered frame is written below the session's
    checkpoint directory (as a table: compressed, and readers take only the
    columns they need), so partition ids are computed exactly once and
    survive executor loss.
    """
    spark = df.sparkSession
    n = int(num_partitions or spark.conf.get("spark.sql.shuffle.partitions"))
    pid = F.spark_partition_id()
    ranged = (df.repartitionByRange(n, *sort_cols)
              .sortWithinPartitions(*sort_cols)
              .withColumn("_pid", pid)
              .withColumn("_local", F.monotonically_increasing_id()
                          - F.shiftleft(F.col("_pid").cast("long"), 33)))
    if checkpoint:
        ranged = scratch_table(ranged, "positions")
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (ranged.join(F.broadcast(offsets), "_pid")
            .withColumn(pos_col, (F.col("_off") + F.col("_local")).cast("long"))
            .drop("_pid", "_local", "_off"))


def with_chunks(positioned: DataFrame, halo: int, chunk_rows: int, pos_col: str = "_g",
                lookahead: int = 0) -> DataFrame:
    """Each row in its own chunk, plus a copy in the next chunk when it is one
    of the last ``halo`` rows of its chunk, and a copy in the previous chunk
    when it is one of the first ``lookahead`` rows (for ``lead``).  One pass,
    no self-union."""
    c = max(int(chunk_rows), int(halo), int(lookahead), 1)
    g = F.col(pos_col)
    own = F.floor(g / F.lit(c)).cast("long")
    r = g % F.lit(c)
    last = F.when(r >= F.lit(c - halo), own + 1).otherwise(own) if halo > 0 else own
    first = F.when((r < F.lit(lookahead)) & (own > 0), own - 1).otherwise(own) if lookahead > 0 else own
    return (positioned.withColumn("_chunk", F.explode(F.sequence(first, last)))
            .withColumn("_own", F.col("_chunk") == own))


def plain_window(keys: Sequence[str], order: Sequence[str] = ORDER) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def range_partitions(df: DataFrame, rows: int | None = None,
                     target_rows: int = RANGE_PARTITION_ROWS) -> int:
    """Tasks for numbering and for the chunk windows: one per ``target_rows``
    rows (counted here unless the caller knows them from its key counts),
    never fewer than the shuffle setting."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.count() if rows is None else int(rows)
    return max(n, -(-rows // max(int(target_rows), 1)))


def chunked_apply(df: DataFrame, keys: Sequence[str], fn: FeatureFn, halo: int,
                  order: Sequence[str] = ORDER, chunk_rows: int = CHUNK_ROWS,
                  num_partitions: int | None = None, keep_position: bool = False,
                  lookahead: int = 0, rows: int | None = None) -> DataFrame:
    n = num_partitions or range_partitions(df, rows)
    pos = global_position(df, [*keys, *order], n)
    # the window's exchange gets the data-sized task count too (a window
    # shuffle is never split by AQE); the window reuses this distribution
    chunked = with_chunks(pos, halo, chunk_rows, lookahead=lookahead).repartition(n, *keys, "_chunk")
    w = Window.partitionBy(*keys, "_chunk").orderBy("_g")
    out = fn(chunked, w).filter(F.col("_own")).drop("_chunk", "_own")
    return out if keep_position else out.drop("_g")


@dataclass(frozen=True)
class SeriesCounts:
    """What one pass over the key columns tells: the hot series (a table of at
    most rows / hot_rows keys) and four numbers."""

    hot: DataFrame
    n_series: int
    n_rows: int
    n_hot: int
    hot_row_count: int


def count_series(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_SERIES_ROWS) -> SeriesCounts:
    """Count on the cheapest frame that has the series' rows (only the key
    columns are read) and pass the result to whatever runs above it."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    is_hot = F.col("_n") > F.lit(hot_rows)
    row = sizes.agg(F.count(F.lit(1)), F.sum("_n"), F.count_if(is_hot), F.sum(F.when(is_hot, F.col("_n")))).first()
    return SeriesCounts(sizes.filter(is_hot).select(*keys), *[int(x or 0) for x in row])


def maybe_broadcast(keys_df: DataFrame, n_keys: int) -> DataFrame:
    """Broadcast the key set only behind its measured size; above the limit
    the join stays a shuffle join (AQE may still pick broadcast at run time)."""
    return F.broadcast(keys_df) if n_keys <= BROADCAST_KEYS_LIMIT else keys_df


def over_series(df: DataFrame, keys: Sequence[str], fn: FeatureFn, halo: int,
                order: Sequence[str] = ORDER, strategy: str = "auto",
                hot_rows: int = HOT_SERIES_ROWS, chunk_rows: int = CHUNK_ROWS,
                num_partitions: int | None = None, lookahead: int = 0,
                counts: SeriesCounts | None = None) -> DataFrame:
    """Apply ``fn(frame, window_spec)`` positionally within every series.

    ``fn`` must add columns with ``select('*', ...)`` over the given ordered
    window spec (use ``spec.rowsBetween`` for frames) and keep all others.
    ``halo`` is the deepest look-back in rows, ``lookahead`` the furthest
    look-ahead (``lead``).  ``counts`` may pass what ``count_series`` found
    upstream, on a cheaper frame with (about) the same rows per series.
    """
    keys = list(keys)
    if strategy == "plain":
        return fn(df, plain_window(keys, order))
    if strategy == "chunked":
        return chunked_apply(df, keys, fn, halo, order, chunk_rows, num_partitions, lookahead=lookahead,
                             rows=None if counts is None else counts.n_rows)
    if strategy != "auto":
        raise ValueError(f"unknown strategy {strategy!r}")
    counts = count_series(df, keys, hot_rows) if counts is None else counts
    if counts.n_hot == 0:
        return fn(df, plain_window(keys, order))
    hot_b = maybe_broadcast(counts.hot, counts.n_hot)  # at most total_rows / hot_rows keys
    total = counts.hot_row_count
    cold_part = fn(join_on_keys(df, hot_b, keys, "left_anti"), plain_window(keys, order))
    hot_part = chunked_apply(join_on_keys(df, hot_b, keys, "left_semi"), keys, fn, halo, order,
                             chunk_rows, num_partitions, lookahead=lookahead, rows=total)
    return cold_part.unionByName(hot_part)


def series_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ORDER,
                      strategy: str = "auto", hot_rows: int = HOT_SERIES_ROWS,
                      num_partitions: int | None = None, col: str = "rn", size_col: str | None = None,
                      counts: SeriesCounts | None = None) -> DataFrame:
    """0-based position of each row within its series, and on demand the
    series' row count (``size_col``), over the same partitioning.

    Hot series get it from the global position minus the series start; the
    start table has one row per hot series and is broadcast behind its
    measured size.
    """
    keys = list(keys)

    def plain(frame: DataFrame) -> DataFrame:
        frame = frame.withColumn(col, (F.row_number().over(plain_window(keys, order)) - 1).cast("long"))
        return frame.withColumn(size_col, F.count(F.lit(1)).over(Window.partitionBy(*keys))) if size_col else frame

    def chunked(frame: DataFrame, n_keys: int, rows: int) -> DataFrame:
        n = num_partitions or range_partitions(frame, rows)
        pos = global_position(frame, [*keys, *order], n)
        size = [F.count(F.lit(1)).alias(size_col)] if size_col else []
        starts = maybe_broadcast(pos.groupBy(*keys).agg(F.min("_g").alias("_start"), *size), n_keys)
        return (join_on_keys(pos, starts, keys).withColumn(col, (F.col("_g") - F.col("_start")).cast("long"))
                .drop("_g", "_start"))

    if strategy == "plain":
        return plain(df)
    counts = count_series(df, keys, hot_rows) if counts is None else counts
    if strategy == "chunked":
        return chunked(df, counts.n_series, counts.n_rows)
    if counts.n_hot == 0:
        return plain(df)
    hot_b = maybe_broadcast(counts.hot, counts.n_hot)
    return plain(join_on_keys(df, hot_b, keys, "left_anti")).unionByName(
        chunked(join_on_keys(df, hot_b, keys, "left_semi"), counts.n_hot, counts.hot_row_count))
