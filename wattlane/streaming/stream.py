"""Streaming scorer.

Readings arrive as a stream.  A keyed stateful operator (``keyed.py``) holds for
each series, in Spark's state store, its newest ``RECENT`` rows, counters and the
deliveries already seen (one state per bucket of series); it gives out the stored rows and the rows of the batch
that can be placed behind them.  ``foreachBatch`` puts both through the
distributed batch plan: lag and rolling features (a hot series is chunked, not
gathered), and for each touched series one response from the models, by the code
and the gate rule that batch scoring uses.

* Lateness is per series.  A row can be placed only behind the newest row of
  its own series; a series whose clock lags the others loses nothing.
* Every row read either comes out once or is counted: in ``repeated_rows`` if its
  series has delivered that arrival number before (within the time to live), else
  in ``late_rows`` if it is stamped at or before its series' newest placed row, or
  has no stamp.  Both are cumulative per series and part of the state, so a series
  with nothing but late rows in an epoch is counted too (``stream_counts``).
* Missing temperature/humidity take the running mean of the series (``mean or
  default`` as in batch); after the last micro-batch this is the mean over all
  its placed rows, so the final response equals the batch scorer's.
* The state store keeps one version per epoch, and an epoch's outputs go to a
  folder of its own with overwrite: a replayed epoch gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlane.config import CHUNK_ROWS, HOT_SERIES_ROWS, POWER_DEFAULT, SERIES_BUCKETS
from wattlane.operators.clean import KEYS, fill_from_means, gate_status
from wattlane.operators.score import RECENT, ForecastModels, score_recent
from wattlane.operators.windows import energy_lag_cols, last_n_rows, rolling_frames
from wattlane.plans.keys import join_on_keys
from wattlane.plans.ordering import over_series
from wattlane.streaming.keyed import COUNTS, MEASURES, NEW, OUTPUT, STATE, SUMS, TOTALS, advance

SERIES = list(KEYS)
ROW = ["ts", "arrival_no", *MEASURES]


def reading_rows(rows: DataFrame) -> DataFrame:
    """The columns the keyed operator reads, stamps as microseconds; absent measures are NULL."""
    def column(c: str, kind: str):
        return (F.col(c) if c in rows.columns else F.lit(None)).cast(kind)

    return rows.select(F.col("series_id").cast("string").alias("series_id"), F.unix_micros(column("ts", "timestamp")).alias("micros"),
                       column("arrival_no", "long").alias("arrival_no"), *[column(m, "double").alias(m) for m in MEASURES])


def placed_rows(batch: DataFrame) -> DataFrame:
    """Rows of the touched series: stored before (``_old``) and placed by the batch."""
    ts = F.timestamp_micros("micros").cast("timestamp_ntz").alias("ts")
    return batch.where(f"kind <> {TOTALS}").select("series_id", ts, *ROW[1:], (F.col("kind") != NEW).alias("_old"))


def series_totals(batch: DataFrame) -> DataFrame:
    """One row of totals per touched series, after the batch."""
    return batch.where(f"kind = {TOTALS}").select("series_id", *COUNTS, *SUMS)


def row_outputs(placed: DataFrame, after: DataFrame, hot_rows: int, chunk_rows: int) -> DataFrame:
    """Lag and rolling features of the rows the batch placed."""
    power = placed.withColumn("Power_Consumption", F.coalesce("Power_Consumption", F.lit(POWER_DEFAULT)))
    feats = over_series(power, SERIES, lambda f, s: rolling_frames(f.select("*", *energy_lag_cols(s)), s),
                        halo=RECENT, hot_rows=hot_rows, chunk_rows=chunk_rows)
    new = feats.where("not _old").drop("_old").withColumnRenamed("Power_Consumption", "energy_kwh")
    return join_on_keys(new, after.select("series_id", "late_rows", "n_seen"), SERIES, "left")


def series_responses(placed: DataFrame, after: DataFrame, models: ForecastModels) -> DataFrame:
    """One response per touched series: the status by the batch gate's rule, and the scores of those that pass."""
    invalid = (F.col("t_cnt") == 0) | (F.col("h_cnt") == 0)
    status = after.withColumn("status", gate_status(F.col("n_seen"), invalid))
    means = status.where("status = 'scored'").select("series_id", (F.col("t_sum") / F.col("t_cnt")).alias("mean_temperature"),
                                                     (F.col("h_sum") / F.col("h_cnt")).alias("mean_humidity"))
    recent = join_on_keys(last_n_rows(placed.drop("_old"), RECENT, SERIES), means, SERIES)
    preds = score_recent(fill_from_means(recent, ["series_id", *ROW]), models)
    return join_on_keys(status.select("series_id", "n_seen", "late_rows", "repeated_rows", "status"), preds, SERIES, "left")


def run_stream(spark: SparkSession, source_path: str, out_path: str, checkpoint: str,
               schema: T.StructType, models: ForecastModels | None = None, hot_rows: int = HOT_SERIES_ROWS,
               chunk_rows: int = CHUNK_ROWS, max_files_per_trigger: int | None = None, buckets: int = SERIES_BUCKETS) -> None:
    """Stream everything available in ``source_path``.  Without ``models`` each
    epoch writes the placed rows' features, with them one response per series.
    ``buckets`` of series share a state each; a checkpoint keeps the number it began with."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    rows = reading_rows(reader.parquet(source_path)).withColumn("bucket", F.pmod(F.xxhash64("series_id"), F.lit(buckets)))
    keyed = rows.groupBy("bucket").applyInPandasWithState(advance, OUTPUT, STATE, "append", "NoTimeout")

    def process(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)  # read by several branches; else the state operator runs again
        try:
            placed, after = placed_rows(batch), series_totals(batch)
            out = row_outputs(placed, after, hot_rows, chunk_rows) if models is None else series_responses(placed, after, models)
            out.write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")
        finally:
            batch.unpersist()

    (keyed.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def stream_counts(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(series_id, n_seen, late_rows, repeated_rows) of every series ever read, from the stream's own state store."""
    state = spark.read.format("statestore").load(checkpoint)
    counts = [f"value.groupState.{c}" for c in ("series", "n_seen", "late_rows", "repeated_rows")]
    return state.selectExpr(f"inline(arrays_zip({', '.join(counts)}))").withColumnRenamed("series", "series_id")


# ---- replaying a table as a stream --------------------------------------------------------

def time_slices(readings: DataFrame, n: int, col: str = "_slice") -> DataFrame:
    """Number rows 0..n-1 by time, between quantiles of the stamps; rows without one go last."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = readings.agg(F.percentile_approx(at, [k / n for k in range(1, n)], 100_000)).first()[0] or []
    number = sum([(at > F.lit(c)).cast("int") for c in cuts], F.lit(0))
    return readings.withColumn(col, F.coalesce(number, F.lit(n - 1)))


def replay(sliced: DataFrame, path: str, n: int, step: Callable[[], None], col: str = "_slice") -> None:
    """Write slice after slice (each by all its tasks) and stream it before the next: ordered micro-batches."""
    for k in range(n):
        sliced.where(F.col(col) == k).drop(col).write.mode("append").parquet(path)
        step()
