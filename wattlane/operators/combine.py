"""Table-shaped joins of the reference (J1–J4) and the padding union."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattlane.config import (CURRENT_DEFAULT, HUMIDITY_DEFAULT, POWER_DEFAULT, SEQUENCE_LENGTH,
                             TEMPERATURE_DEFAULT, VOLTAGE_DEFAULT)
from wattlane.functions.numeric import default_if_missing
from wattlane.functions.text import first_non_null_name
from wattlane.operators.clean import KEYS
from wattlane.sources.weather import describe_weather_code, weather_code_table
from wattlane.plans.keys import join_on_keys
from wattlane.plans.ordering import maybe_broadcast

PAD_DEFAULTS = {
    "Power_Consumption": POWER_DEFAULT,
    "voltage": VOLTAGE_DEFAULT,
    "current": CURRENT_DEFAULT,
    "temperature": TEMPERATURE_DEFAULT,
    "humidity": HUMIDITY_DEFAULT,
}


def decode_weather_code(df: DataFrame, code_col: str = "weather_code",
                        out_col: str = "description", use_join: bool = False) -> DataFrame:
    """Code → description, default ``Unknown``.  Default form is a map
    literal; ``use_join`` gives the broadcast join on the 24-row table."""
    if not use_join:
        return df.withColumn(out_col, describe_weather_code(F.col(code_col)))
    lookup = weather_code_table(df.sparkSession).withColumnRenamed("description", "_desc")
    joined = df.join(F.broadcast(lookup), df[code_col] == lookup["weather_code"], "left")
    return joined.select(*[df[c] for c in df.columns],
                         F.coalesce(F.col("_desc"), F.lit("Unknown")).alias(out_col))


def latest_observation(weather: DataFrame, location_col: str = "location") -> DataFrame:
    """Newest observation per location (ties broken by ``obs_id``), as an
    aggregate: partial per task, so a busy location is never gathered."""
    payload = [c for c in weather.columns if c != location_col]
    best = F.max_by(F.struct(*payload), F.struct("ts", "obs_id"))
    return (weather.groupBy(location_col).agg(best.alias("_o"))
            .select(location_col, *[F.col(f"_o.{c}").alias(c) for c in payload]))


def attach_current_weather(readings: DataFrame, weather: DataFrame,
                           location_col: str = "location") -> DataFrame:
    """Stamp the current observation of the reading's location on every
    reading; temperature/humidity take ``x || default`` (0 counts as missing);
    the code is decoded and a display name chosen (P14).  The newest observation
    per location is broadcast behind the measured number of locations: the
    readings are not shuffled onto a few location keys."""
    obs = latest_observation(weather, location_col).select(
        location_col,
        F.col("ts").alias("obs_ts"),
        F.col("temp").alias("_temp"),
        F.col("humidity").alias("_hum"),
        F.col("wind_speed"),
        describe_weather_code(F.col("weather_code")).alias("weather_description"),
        first_non_null_name(F.col("city"), F.col("town"), F.col("village")).alias("location_name"),
    )
    base = readings.drop("temperature", "humidity")
    n_locations = weather.select(F.count_distinct(location_col)).first()[0]
    out = base.join(maybe_broadcast(obs, n_locations), location_col, "left")
    return out.select(*base.columns,
                      default_if_missing(F.col("_temp"), TEMPERATURE_DEFAULT).alias("temperature"),
                      default_if_missing(F.col("_hum"), HUMIDITY_DEFAULT).alias("humidity"),
                      "wind_speed", "weather_description", "location_name", "obs_ts")


def align_predictions(target: DataFrame, *predictions: DataFrame,
                      keys: Sequence[str] = ("series_id", "ts", "arrival_no")) -> DataFrame:
    """Align model outputs with the target by row key (not by position)."""
    out = target
    for p in predictions:
        out = join_on_keys(out, p, keys, "inner")
    return out


def pad_short_series(readings: DataFrame, keys: Sequence[str] = KEYS,
                     seq_len: int = SEQUENCE_LENGTH, as_of: Column | None = None) -> DataFrame:
    """J4 + U1: a series with 1 ≤ n < seq_len rows gets seq_len − n rows
    copied from its first-arrived point, stamped ``first_ts − i`` hours for
    i = seq_len − n … 1 (arrival_no −i), absent values taking the defaults.
    Series of seq_len rows or more are untouched; empty series do not exist
    as rows.  The per-series summary is an aggregate; padding is generated
    from it (≤ seq_len − 1 rows per series), then unioned."""
    keys = list(keys)
    measures = [m for m in PAD_DEFAULTS if m in readings.columns]
    # one min_by per field (fixed-width buffers → hash aggregation); a NULL
    # value at the first arrival is kept and then takes the default
    firsts = [F.min_by(F.col(c), F.col("arrival_no")).alias(f"_first_{c}") for c in ["ts", *measures]]
    summary = (readings.groupBy(*keys)
               .agg(F.count(F.lit(1)).alias("_n"), *firsts)
               .filter(F.col("_n") < F.lit(seq_len)))
    first_ts = F.col("_first_ts") if as_of is None else F.coalesce(F.col("_first_ts"), as_of)
    pads = (summary.select("*", F.explode(F.sequence(F.lit(1), F.lit(seq_len) - F.col("_n"))).alias("_i"))
            .select(*keys,
                    (first_ts - F.make_dt_interval(hours=F.col("_i"))).alias("ts"),
                    (-F.col("_i")).cast("long").alias("arrival_no"),
                    *[F.coalesce(F.col(f"_first_{m}"), F.lit(PAD_DEFAULTS[m])).alias(m) for m in measures],
                    F.lit(True).alias("is_padding")))
    real = readings.withColumn("is_padding", F.lit(False))
    extra = [c for c in real.columns if c not in pads.columns]
    pads = pads.select(*pads.columns, *[F.lit(None).cast(real.schema[c].dataType).alias(c) for c in extra])
    return real.unionByName(pads)


def form_points(values: DataFrame, voltage: Column | None = None, current: Column | None = None,
                temperature: Column | None = None, humidity: Column | None = None) -> DataFrame:
    """P13 applied to form points: ``x || default`` for every measure."""
    return values.select(
        "*",
        default_if_missing(voltage if voltage is not None else F.lit(None), VOLTAGE_DEFAULT).alias("voltage"),
        default_if_missing(current if current is not None else F.lit(None), CURRENT_DEFAULT).alias("current"),
        default_if_missing(temperature if temperature is not None else F.lit(None), TEMPERATURE_DEFAULT).alias("temperature"),
        default_if_missing(humidity if humidity is not None else F.lit(None), HUMIDITY_DEFAULT).alias("humidity"),
    )


def form_request_points(requests: DataFrame, weather: DataFrame | None = None,
                        text_col: str = "text", as_of_col: str = "as_of",
                        location_col: str = "location", request_col: str = "request_id",
                        voltage: Column | None = None, current: Column | None = None,
                        seq_len: int = SEQUENCE_LENGTH) -> tuple[DataFrame, DataFrame]:
    """The form's client-side preparation over a table of requests (T6 → T7 →
    J2 → P13 → T8): parse the comma-separated text, keep the newest
    ``seq_len`` values (fewer is a form error), stamp them hourly back from
    ``as_of``, stamp the location's current weather and the form defaults on
    every point.  An infinite value cannot travel as JSON and arrives as
    NULL.  Returns ``(points, form_errors)``; points are reading rows keyed
    by ``series_id`` = request id."""
    from wattlane.functions.text import hourly_stamp, last_n_values, parse_reading_list
    vals = parse_reading_list(F.col(text_col))
    parsed = requests.select(F.col(request_col), F.col(as_of_col), F.col(location_col),
                             vals.alias("_vals"), last_n_values(vals, seq_len).alias("_kept"))
    errors = parsed.filter(F.col("_kept").isNull()).select(
        request_col, F.size("_vals").alias("n_values"), F.lit("form_error").alias("status"))
    pts = parsed.select(request_col, as_of_col, location_col,
                        F.posexplode("_kept").alias("_pos", "_p"))
    pts = pts.select(
        F.col(request_col).cast("string").alias("series_id"),
        hourly_stamp(F.col(as_of_col), F.col("_pos"), seq_len).alias("ts"),
        F.col("_pos").cast("long").alias("arrival_no"),
        F.when(F.abs(F.col("_p")) == F.lit(float("inf")), F.lit(None).cast("double"))
        .otherwise(F.col("_p")).alias("Power_Consumption"),
        default_if_missing(voltage if voltage is not None else F.lit(None), VOLTAGE_DEFAULT).alias("voltage"),
        default_if_missing(current if current is not None else F.lit(None), CURRENT_DEFAULT).alias("current"),
        F.col(location_col))
    if weather is None:
        pts = pts.select("*", F.lit(TEMPERATURE_DEFAULT).alias("temperature"),
                         F.lit(HUMIDITY_DEFAULT).alias("humidity"))
    else:
        pts = attach_current_weather(pts.select("*", F.lit(None).cast("double").alias("temperature"),
                                                F.lit(None).cast("double").alias("humidity")),
                                     weather, location_col)
    return pts, errors
