"""Registered queries: one Spark callable and (where expressible) one DuckDB
twin per operator.  Computed doubles are compared through
``round(x + 1e-9, 6)`` on both sides; lags, minima, maxima and raw inputs
are compared as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattlane.config import BOOST_FEATURES, CHUNK_ROWS, HOT_SERIES_ROWS, HUMIDITY_DEFAULT, LABEL, TEMPERATURE_DEFAULT, TREE_FEATURES, WEATHER_CODES
from wattlane.functions import calendar as CAL
from wattlane.functions import numeric as NUM
from wattlane.functions import text as TXT
from wattlane.functions.numeric import r6
from wattlane.operators import boosting as BO
from wattlane.operators import clean as C
from wattlane.operators import combine as J
from wattlane.operators import forest as HF
from wattlane.operators import metrics as A
from wattlane.operators import models as M
from wattlane.operators import recurrent as RN
from wattlane.operators import score as SC
from wattlane.operators import sequences as S
from wattlane.operators import windows as W
from wattlane.plans.ordering import over_series, series_row_number
from wattlane.session import ensure_checkpoint_dir, pin_semantics, scratch_table
from wattlane.sources import readings as RD
from wattlane.sources import sinks as SK
from wattlane.sources import weather as WX
from wattlane.sources import weather_documents as WD
from wattlane.sources.readings import load_readings
from wattlane.streaming import stream as ST

QueryFn = Callable[[SparkSession, str], DataFrame]

# ---- SQL building blocks (DuckDB dialect) -----------------------------------------

SERIES_SQL = {
    "event_type": "event_type",
    "user_id": "CAST(user_id AS VARCHAR)",
    "user_event": "concat_ws(':', CAST(user_id AS VARCHAR), event_type)",
    "constant": "'all'",
    "skewed": "CASE WHEN event_type = 'view' THEN 'hot' ELSE CAST(user_id AS VARCHAR) END",
}


def sql_readings(series_key: str = "event_type") -> str:
    return f"""(
  SELECT {SERIES_SQL[series_key]} AS series_id, ts, event_id AS arrival_no,
         CAST(value AS DOUBLE) AS Power_Consumption,
         225.0::DOUBLE + CAST(event_id % 11 AS DOUBLE) AS voltage,
         5.0::DOUBLE + CAST(event_id % 13 AS DOUBLE) / 2.0::DOUBLE AS "current",
         CASE WHEN k % 10 = 0 THEN NULL ELSE 10.0::DOUBLE + CAST(k AS DOUBLE) / 5.0::DOUBLE END AS temperature,
         CASE WHEN k % 17 = 0 THEN NULL ELSE 30.0::DOUBLE + CAST(k % 50 AS DOUBLE) END AS humidity
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) e
)"""


def R(x: str) -> str:
    return f"ROUND(({x}) + 1e-9, 6)"


def sql_imputed(series_key: str = "event_type") -> str:
    return f"""(
  SELECT r.series_id, r.ts, r.arrival_no,
         coalesce(r.Power_Consumption, 0.0::DOUBLE) AS Power_Consumption,
         r.voltage, r."current",
         coalesce(r.temperature, CASE WHEN m.mt = 0 THEN 20.0::DOUBLE ELSE m.mt END) AS temperature,
         coalesce(r.humidity, CASE WHEN m.mh = 0 THEN 50.0::DOUBLE ELSE m.mh END) AS humidity
  FROM {sql_readings(series_key)} r
  LEFT JOIN (SELECT series_id, avg(temperature) AS mt, avg(humidity) AS mh
             FROM {sql_readings(series_key)} x GROUP BY series_id) m USING (series_id)
)"""


SQL_CALENDAR = """CAST(hour(ts) AS INTEGER) AS hour,
         CAST(isodow(ts) - 1 AS INTEGER) AS day_of_week,
         CAST(day(ts) AS INTEGER) AS day_of_month,
         CAST(month(ts) AS INTEGER) AS month,
         CAST(quarter(ts) AS INTEGER) AS quarter,
         CAST(year(ts) AS INTEGER) AS year,
         CAST(week(ts) AS INTEGER) AS week_of_year"""

SQL_FLAGS = """CAST(isodow(ts) - 1 IN (5, 6) AS INTEGER) AS is_weekend,
         CAST(hour(ts) BETWEEN 9 AND 17 AS INTEGER) AS is_business_hours,
         CAST(hour(ts) BETWEEN 17 AND 21 AS INTEGER) AS is_peak_hours"""


def sql_win(part: str = "series_id", order: str = "ts, arrival_no", frame: str = "") -> str:
    return f"OVER (PARTITION BY {part} ORDER BY {order}{(' ' + frame) if frame else ''})"


def rows(preceding: int, following: int = 0) -> str:
    fol = "CURRENT ROW" if following == 0 else (
        f"{following} FOLLOWING" if following > 0 else f"{-following} PRECEDING")
    return f"ROWS BETWEEN {preceding} PRECEDING AND {fol}"


def sql_serving_features(series_key: str = "event_type", part: str = "series_id") -> str:
    p = "Power_Consumption"
    w = sql_win(part)
    w24 = sql_win(part, frame=rows(23))
    w168 = sql_win(part, frame=rows(167))
    lags = ",\n         ".join(f"lag({p}, {k}) {w} AS energy_lag_{k}" for k in (1, 2, 3, 24, 48, 168))
    return f"""(
  SELECT series_id, ts, arrival_no, {p} AS energy_kwh, voltage, "current", temperature, humidity,
         {SQL_CALENDAR},
         {SQL_FLAGS},
         {lags},
         avg({p}) {w24} AS energy_mean_24h,
         stddev_samp({p}) {w24} AS energy_std_24h,
         min({p}) {w24} AS energy_min_24h,
         max({p}) {w24} AS energy_max_24h,
         avg({p}) {w168} AS energy_mean_7d,
         stddev_samp({p}) {w168} AS energy_std_7d,
         temperature * CAST(hour(ts) AS INTEGER) AS temp_hour_interaction,
         humidity * temperature AS humidity_temp_interaction
  FROM {sql_imputed(series_key)} c
)"""


FEATURE_DOUBLES = ["temperature", "humidity", "energy_mean_24h", "energy_std_24h",
                   "energy_mean_7d", "energy_std_7d", "temp_hour_interaction",
                   "humidity_temp_interaction"]
FEATURE_RAW = ["series_id", "ts", "arrival_no", "energy_kwh", "voltage", "current",
               "hour", "day_of_week", "day_of_month", "month", "quarter", "year", "week_of_year",
               "is_weekend", "is_business_hours", "is_peak_hours",
               "energy_lag_1", "energy_lag_2", "energy_lag_3", "energy_lag_24", "energy_lag_48",
               "energy_lag_168", "energy_min_24h", "energy_max_24h"]


def spark_feature_projection(df: DataFrame) -> DataFrame:
    return df.select(*FEATURE_RAW, *[r6(F.col(c)).alias(c) for c in FEATURE_DOUBLES])


def sql_feature_projection(source: str, where: str = "") -> str:
    cols = ", ".join(f'"{c}"' if c == "current" else c for c in FEATURE_RAW)
    rounded = ", ".join(f"{R(c)} AS {c}" for c in FEATURE_DOUBLES)
    return f"SELECT {cols}, {rounded} FROM {source} f {where}"


WARMUP = "WHERE energy_lag_1 IS NOT NULL AND energy_lag_24 IS NOT NULL"
KEYCOLS = ["series_id", "ts", "arrival_no"]


def sql_features_warm(series_key: str = "event_type") -> str:
    return f"(SELECT * FROM {sql_serving_features(series_key)} s {WARMUP})"


def features_warm(spark: SparkSession, sf_dir: str, series_key: str = "event_type") -> DataFrame:
    return W.serving_features(load_readings(spark, sf_dir, series_key))


def rounded(df: DataFrame, raw: list[str], dbl: list[str]) -> DataFrame:
    return df.select(*raw, *[r6(F.col(c)).alias(c) for c in dbl])


def sql_rounded(source: str, raw: list[str], dbl: list[str], where: str = "") -> str:
    q = lambda c: f'"{c}"' if c == "current" else c
    parts = [q(c) for c in raw] + [f"{R(q(c))} AS {c}" for c in dbl]
    return f"SELECT {', '.join(parts)} FROM {source} t {where}"


SPARK_QUERIES: dict[str, QueryFn] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            pin_semantics(spark)
            return fn(spark, sf_dir)
        run.__name__ = getattr(fn, "__name__", name)
        run.__doc__ = fn.__doc__
        SPARK_QUERIES[name] = run
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


# ---- W13 / W15 (flagship) -------------------------------------------------------------

register("serving_features", sql_feature_projection(sql_serving_features("event_type"), WARMUP))(
    lambda spark, d: spark_feature_projection(W.serving_features(load_readings(spark, d, "event_type"))))

register("global_series_features", sql_feature_projection(sql_serving_features("constant"), WARMUP))(
    lambda spark, d: spark_feature_projection(
        W.global_series_features(load_readings(spark, d, "constant"), chunk_rows=4096)))

register("serving_features_by_user", sql_feature_projection(sql_serving_features("user_id"), WARMUP))(
    lambda spark, d: spark_feature_projection(W.serving_features(load_readings(spark, d, "user_id"))))


# ---- shared adapters --------------------------------------------------------------------

def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the session's (shared) checkpoint directory."""
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/wattlane-scratch/{tag}-{uuid.uuid4().hex}"


def events(spark: SparkSession, d: str) -> DataFrame:
    return RD.read_table(spark, d, "events")


def k_col():
    return F.get_json_object("props", "$.k").cast("int")


SQL_EVENTS_K = "(SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"


def sql_weather() -> str:
    return f"""(
  SELECT 'loc_' || CAST(user_id % 7 AS VARCHAR) AS location, ts, event_id AS obs_id,
         CAST(k - 20 AS DOUBLE) / 2.0::DOUBLE AS temp,
         CAST((k * 3) % 101 AS DOUBLE) AS humidity,
         CAST(event_id % 13 AS DOUBLE) / 2.0::DOUBLE AS wind_speed,
         k AS weather_code,
         CASE WHEN k % 4 = 0 THEN NULL WHEN k % 4 = 1 THEN '' ELSE 'City ' || CAST(user_id % 7 AS VARCHAR) END AS city,
         CASE WHEN k % 3 = 0 THEN NULL ELSE 'Town ' || CAST(user_id % 5 AS VARCHAR) END AS town,
         CASE WHEN k % 5 = 0 THEN '' ELSE 'Village ' || CAST(user_id AS VARCHAR) END AS village
  FROM {SQL_EVENTS_K} e
)"""


def weather(spark: SparkSession, d: str) -> DataFrame:
    return WX.weather_from_events(events(spark, d))


def sql_weather_codes() -> str:
    vals = ", ".join(f"({c}, '{t}')" for c, t in WEATHER_CODES.items())
    return f"(SELECT * FROM (VALUES {vals}) v(weather_code, description))"


READING_COLS = ["series_id", "ts", "arrival_no", "Power_Consumption", "voltage", "current",
                "temperature", "humidity"]
SQL_READING_COLS = 'series_id, ts, arrival_no, Power_Consumption, voltage, "current", temperature, humidity'


# ---- S1, S2, S4, S5, S6, S7 ---------------------------------------------------------------

def q_read_readings_csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    # other column order, and a column that the schema does not know
    r = load_readings(spark, d, "event_type")
    RD.write_readings_csv(r.select(*reversed(r.columns), F.lit("x").alias("note")), path)
    schema = ("series_id STRING, ts TIMESTAMP_NTZ, arrival_no BIGINT, Power_Consumption DOUBLE, "
              "voltage DOUBLE, current DOUBLE, temperature DOUBLE, humidity DOUBLE")
    return RD.read_readings_csv(spark, path, schema=schema)


register("read_readings_csv", f"SELECT {SQL_READING_COLS} FROM {sql_readings('event_type')} r")(q_read_readings_csv)


def request_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Request bodies built from events: k % 10 = 0 null, 1 a lone object,
    2 junk or an array with junk behind it, 3 an empty array, 4 a truncated
    array, otherwise a two-point array mixing numbers and numeric text (at times
    with white space around it)."""
    e = events(spark, d)
    k = k_col()
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    stamp2 = F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    v = F.format_string("%.2f", F.col("value"))
    v2 = F.format_string("%.2f", F.col("value") * F.lit(2.0))
    volt = F.format_string("%d", F.lit(225) + F.col("event_id") % 11)
    p1 = F.concat(F.lit('{"timestamp": "'), stamp, F.lit('Z", "Power_Consumption": '), v,
                  F.lit(', "voltage": "'), volt, F.lit('", "current": 10, "temperature": '),
                  F.when(k % 7 == 0, F.lit("null")).otherwise(k.cast("string")),
                  F.lit(', "humidity": "50"}'))
    p2 = F.concat(F.lit('{"timestamp": "'), stamp2, F.lit('", "Power_Consumption": "'), v2,
                  F.lit('", "voltage": 230, "current": "'),
                  F.when(k % 9 == 0, F.lit("abc")).otherwise(F.lit("12.5")),
                  F.lit('", "temperature": 21.5, "humidity": 40}'))
    body = (F.when(k % 10 == 0, F.lit(None).cast("string"))
            .when(k % 10 == 1, p1)
            .when(k % 20 == 2, F.lit("junk"))
            .when(k % 20 == 12, F.concat(F.lit("["), p1, F.lit("] junk")))
            .when(k % 20 == 15, F.concat(F.lit("\n\t["), p1, F.lit(", "), p2, F.lit("]\n")))
            .when(k % 10 == 3, F.lit(" [] "))
            .when(k % 10 == 4, F.concat(F.lit("["), p1))
            .otherwise(F.concat(F.lit("["), p1, F.lit(", "), p2, F.lit("]"))))
    return e.select(F.col("event_id").alias("request_id"), body.alias("body"))


def q_parse_reading_batches(spark: SparkSession, d: str) -> DataFrame:
    accepted, _ = RD.parse_reading_batches(request_bodies(spark, d))
    pts = RD.coerce_points(accepted)
    return pts.select("series_id", "arrival_no", F.col("ts").cast("timestamp_ntz").alias("ts"),
                      "Power_Consumption", "voltage", "current", "temperature", "humidity")


SQL_PARSED_POINTS = f"""
SELECT CAST(event_id AS VARCHAR) AS series_id, CAST(0 AS BIGINT) AS arrival_no, ts,
       value AS Power_Consumption, CAST(225 + event_id % 11 AS DOUBLE) AS voltage, 10.0::DOUBLE AS "current",
       CASE WHEN k % 7 = 0 THEN NULL ELSE CAST(k AS DOUBLE) END AS temperature, 50.0::DOUBLE AS humidity
FROM {SQL_EVENTS_K} e WHERE k % 10 >= 5
UNION ALL
SELECT CAST(event_id AS VARCHAR), CAST(1 AS BIGINT), ts + INTERVAL 1 HOUR,
       CAST(printf('%.2f', value * 2.0::DOUBLE) AS DOUBLE), 230.0::DOUBLE,
       CASE WHEN k % 9 = 0 THEN NULL ELSE 12.5::DOUBLE END, 21.5::DOUBLE, 40.0::DOUBLE
FROM {SQL_EVENTS_K} e WHERE k % 10 >= 5
"""
register("parse_reading_batches", SQL_PARSED_POINTS)(q_parse_reading_batches)


def q_parse_reading_rejects(spark: SparkSession, d: str) -> DataFrame:
    _, rejected = RD.parse_reading_batches(request_bodies(spark, d))
    return rejected.select("request_id", "reason")


register("parse_reading_rejects", f"""
SELECT event_id AS request_id,
       CASE WHEN k % 20 = 12 THEN 'invalid_json' ELSE CASE k % 10 WHEN 0 THEN 'null_body' WHEN 1 THEN 'not_an_array'
                   WHEN 2 THEN 'not_an_array' WHEN 3 THEN 'empty_array' ELSE 'invalid_json' END END AS reason
FROM {SQL_EVENTS_K} e WHERE k % 10 <= 4
""")(q_parse_reading_rejects)


def q_row_count(spark: SparkSession, d: str) -> DataFrame:
    return A.row_count(load_readings(spark, d, "event_type"), ["series_id"])


register("row_count", f"SELECT series_id, count(*) AS row_count FROM {sql_readings('event_type')} r GROUP BY series_id")(q_row_count)

register("row_count_total", "SELECT count(*) AS row_count FROM events")(
    lambda spark, d: A.row_count(events(spark, d)))


def q_read_weather(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "weather")
    weather(spark, d).write.mode("overwrite").parquet(path)
    return WX.read_weather(spark, path)


register("read_weather", f"SELECT * FROM {sql_weather()} w")(q_read_weather)


def weather_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two stored answers an event, built from the observations; ``c`` is the weather code.
    Conditions by c % 19: 1 truncated, 2 junk behind, 3 status 500, 4 no location, 5 an empty body, 6 a temperature that is
    no number, 7 an older delivery too, 8 numbers as text, 9 an error in place of a body. Places by c % 13: 1 not asked for, 2 status 404, 3 no time."""
    w = weather(spark, d).withColumn("at", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    c, p = F.col("weather_code") % 19, F.col("weather_code") % 13

    def line(kind: str, body, **other):
        head = {"location": F.col("location"), "obs_id": F.col("obs_id"), "at": F.col("at"), "status": F.lit(200)} | other
        return F.to_json(F.struct(F.lit(kind).alias("kind"), *[v.alias(k) for k, v in head.items()], body.alias("body")))

    def current(temp, cast: str):
        return F.struct(F.struct(temp.alias("temperature_2m"), F.col("humidity").cast(cast).alias("relative_humidity_2m"),
                                 F.col("wind_speed").cast(cast).alias("wind_speed_10m"), F.col("weather_code").alias("weather_code")).alias("current"))

    nothing = F.lit(None).cast("string")
    full = line("conditions", current(F.col("temp"), "double"))
    conditions = (F.when(c == 1, F.left(full, F.length(full) - 2)).when(c == 2, F.concat(full, F.lit(" {}")))
                  .when(c == 3, line("conditions", current(F.col("temp"), "double"), status=F.lit(500)))
                  .when(c == 4, line("conditions", current(F.col("temp"), "double"), location=nothing))
                  .when(c == 5, line("conditions", F.create_map(F.lit("elevation"), F.lit(38))))
                  .when(c == 6, line("conditions", current(F.lit("n/a"), "double")))
                  .when(c == 8, line("conditions", current(F.col("temp").cast("string"), "string")))
                  .when(c == 9, line("conditions", F.lit("out of range"))).otherwise(full))
    before = F.date_format(F.col("ts") - F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    older = F.when(c == 7, line("conditions", current(F.lit(99.5), "double"), at=before))
    address = F.struct(F.struct("city", "town", "village").alias("address"))
    place = (F.when(p == 1, nothing).when(p == 2, line("place", address, status=F.lit(404)))
             .when(p == 3, line("place", address, at=nothing)).otherwise(line("place", address)))
    return w.select(F.explode(F.array(conditions, older, place, F.when(c == 0, F.lit("  ")))).alias("value")).where("value is not null")


def q_weather_documents(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "weather-lines")
    weather_lines(spark, d).write.text(path)
    return WD.observations(WD.read_weather_documents(spark, path)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def q_weather_documents_set_aside(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "weather-lines")
    weather_lines(spark, d).write.text(path)
    return WD.quarantined(WD.read_weather_documents(spark, path)).groupBy("reason").agg(F.count("*").alias("n_lines"))


def q_weather_documents_stream(spark: SparkSession, d: str) -> DataFrame:
    """Two runs from one checkpoint: half of the lines are there for the first, and the places of an event may come before its conditions."""
    path, out, checkpoint = (scratch_path(spark, f"weather-{x}") for x in ("folder", "taken-in", "checkpoint"))
    lines = weather_lines(spark, d)
    for half in (0, 1):
        lines.where(F.abs(F.xxhash64("value")) % 2 == half).write.mode("append").text(path)
        WD.follow_weather_documents(spark, path, out, checkpoint, max_files=4).awaitTermination()
    return WD.observations(spark.read.parquet(out)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


SQL_WEATHER_DOCUMENTS = f"""
SELECT location, ts, obs_id, CASE WHEN c IN (5, 6) THEN NULL ELSE temp END AS temp, CASE WHEN c = 5 THEN NULL ELSE humidity END AS humidity,
       CASE WHEN c = 5 THEN NULL ELSE wind_speed END AS wind_speed, CASE WHEN c = 5 THEN NULL ELSE weather_code END AS weather_code,
       CASE WHEN p IN (1, 2, 3) THEN NULL ELSE city END AS city, CASE WHEN p IN (1, 2, 3) THEN NULL ELSE town END AS town,
       CASE WHEN p IN (1, 2, 3) THEN NULL ELSE village END AS village
FROM (SELECT *, weather_code % 19 AS c, weather_code % 13 AS p FROM {sql_weather()} w) v WHERE c NOT IN (1, 2, 3, 4, 9)
"""
register("weather_documents", SQL_WEATHER_DOCUMENTS)(q_weather_documents)
register("weather_documents_stream", SQL_WEATHER_DOCUMENTS)(q_weather_documents_stream)
register("weather_documents_set_aside", f"""
SELECT reason, count(*) AS n_lines FROM (
  SELECT CASE WHEN c IN (1, 2) THEN 'invalid_json' WHEN c = 4 THEN 'no_key' WHEN c IN (3, 9) THEN 'failed' END AS reason
  FROM (SELECT weather_code % 19 AS c FROM {sql_weather()} w) v
  UNION ALL SELECT CASE WHEN p = 2 THEN 'failed' WHEN p = 3 THEN 'no_key' END FROM (SELECT weather_code % 13 AS p FROM {sql_weather()} w) v
) r WHERE reason IS NOT NULL GROUP BY reason
""")(q_weather_documents_set_aside)


def sql_to_fixed(x: str, d: int) -> str:
    """printf rounds the exact binary value like toFixed, except on products
    that round to an exact .5: there the Dekker error term of |x|·10^d decides,
    and an exact tie goes up (toFixed) instead of to even (printf)."""
    m = float(10 ** d)
    bh, bl = NUM._split(m)
    a = f"abs({x})"
    p = f"({a} * {m!r})"
    ah = f"(({a} * 134217729.0) - (({a} * 134217729.0) - {a}))"
    al = f"({a} - {ah})"
    err = f"(((({ah} * {bh!r}) - {p}) + ({ah} * {bl!r})) + ({al} * {bh!r})) + ({al} * {bl!r})"
    sign = f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END)"
    up = f"{sign} || printf('%.{d}f', (floor({p}) + 1) / {m!r})"
    down = f"{sign} || printf('%.{d}f', floor({p}) / {m!r})"
    return (f"CASE WHEN {p} - floor({p}) = 0.5 THEN (CASE WHEN {err} >= 0 THEN {up} ELSE {down} END) "
            f"ELSE printf('%.{d}f', {x}) END")


def stand_in_predictions(spark: SparkSession, d: str) -> DataFrame:
    """Base-model stand-ins derived from the features: sequence = 24-row mean,
    rf = lag 24, gbt = lag 168; target = energy_kwh."""
    f = features_warm(spark, d)
    return f.select(*KEYCOLS, F.col("energy_kwh").alias("y"),
                    F.col("energy_mean_24h").alias("seq_pred"),
                    F.col("energy_lag_24").alias("rf_pred"),
                    F.col("energy_lag_168").alias("gbt_pred")).withColumn(
        "prediction", M.weighted_ensemble(F.col("seq_pred"), F.col("rf_pred"), F.col("gbt_pred")))


def sql_stand_in() -> str:
    return f"""(SELECT series_id, ts, arrival_no, energy_kwh AS y, energy_mean_24h AS seq_pred,
       energy_lag_24 AS rf_pred, energy_lag_168 AS gbt_pred,
       0.5::DOUBLE * energy_mean_24h + 0.25::DOUBLE * energy_lag_24 + 0.25::DOUBLE * energy_lag_168 AS prediction
FROM {sql_features_warm()} f)"""


def q_write_predictions(spark: SparkSession, d: str) -> DataFrame:
    preds = stand_in_predictions(spark, d).filter(F.col("prediction").isNotNull())
    # compare through the rounded value: the 24-row mean differs between engines in the last bits
    preds = SK.with_display(preds.withColumn("prediction", r6(F.col("prediction"))))
    path = scratch_path(spark, "predictions")
    SK.write_predictions(preds, path)
    return spark.read.parquet(path).select(*KEYCOLS, "prediction", "prediction_display")


register("write_predictions", f"""
SELECT series_id, ts, arrival_no, x AS prediction, {sql_to_fixed('x', 3)} AS prediction_display
FROM (SELECT *, {R('prediction')} AS x FROM {sql_stand_in()} p WHERE prediction IS NOT NULL) q""")(q_write_predictions)


# ---- P1–P15 --------------------------------------------------------------------------------


register("drop_null_target", f"SELECT {SQL_READING_COLS} FROM {sql_readings('user_id')} r WHERE temperature IS NOT NULL")(
    lambda spark, d: C.drop_null_target(load_readings(spark, d, "user_id"), "temperature"))

register("drop_duplicate_rows", f"""SELECT DISTINCT * FROM (
  SELECT {SQL_READING_COLS} FROM {sql_readings('user_id')} a
  UNION ALL SELECT {SQL_READING_COLS} FROM {sql_readings('user_id')} b) u""")(
    lambda spark, d: C.drop_duplicate_rows(
        load_readings(spark, d, "user_id").unionByName(load_readings(spark, d, "user_id"))))


#: Spellings beside ISO, and what of the stamp they keep.
OTHER_SPELLINGS = [
    ("yyyy/MM/dd HH:mm", "minute"), ("MM/dd/yyyy HH:mm:ss", "second"), ("MMM d yyyy", "day"), ("yyyyMMdd", "day"), ("d MMMM yyyy HH:mm", "minute"),
    ("EEEE, MMMM d, yyyy h:mm a", "minute"), ("MM-dd-yyyy", "day"), ("yyyyMMdd'T'HHmmss", "second"), ("EEE, dd MMM yyyy HH:mm:ss", "second"),
    ("yyyy.M.d H:mm", "minute"), ("MMM d, yyyy hh:mm:ss a", "second"), ("dd-MMM-yyyy", "day"), ("yyyy-MMM-dd HH:mm", "minute"),
]


def q_parse_timestamp(spark: SparkSession, d: str) -> DataFrame:
    k = k_col()
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (F.when(k % 8 == 0, F.concat(iso, F.lit("Z")))
            .when(k % 8 == 1, F.concat(iso, F.lit("+02:00")))
            .when(k % 8 == 2, iso).when(k % 8 == 3, F.lit("not a time"))
            .when(k % 8 == 4, F.lit("12:30")).when(k % 8 == 5, F.lit("T12:30:00"))
            .when(k % 8 == 6, F.concat(F.lit(" "), iso)).otherwise(F.date_format("ts", "yyyy-MM-dd")))
    other = [F.date_format("ts", p) for p, _ in OTHER_SPELLINGS]
    for n, spelled in enumerate(other):
        text = F.when(F.col("event_id") % 29 == n, spelled).otherwise(text)
    return events(spark, d).select("event_id", TXT.parse_timestamp(text).cast("timestamp_ntz").alias("parsed"))


register("parse_timestamp", f"""
SELECT event_id, CASE {' '.join(f"WHEN event_id % 29 = {n} THEN date_trunc('{unit}', ts)" for n, (_, unit) in enumerate(OTHER_SPELLINGS))}
  ELSE CASE k % 8 WHEN 0 THEN ts WHEN 1 THEN ts - INTERVAL 2 HOUR WHEN 2 THEN ts WHEN 6 THEN ts
       WHEN 7 THEN date_trunc('day', ts) END END AS parsed
FROM {SQL_EVENTS_K} e""")(q_parse_timestamp)


def numeric_text():
    k = k_col()
    v = F.format_string("%.2f", F.col("value"))
    return (F.when(k % 10 == 0, v).when(k % 10 == 1, F.concat(F.lit(" "), v))
            .when(k % 10 == 2, F.concat(v, F.lit("abc"))).when(k % 10 == 3, F.lit("NaN"))
            .when(k % 10 == 4, F.lit("")).when(k % 10 == 5, F.lit("1e3"))
            .when(k % 10 == 6, F.concat(v, F.lit("d"))).when(k % 10 == 7, F.concat(v, F.lit("f")))
            .when(k % 10 == 8, F.lit("0x10")).otherwise(F.lit("1.5D")))


SQL_NUMERIC_TEXT = """CASE k % 10 WHEN 0 THEN printf('%.2f', value) WHEN 1 THEN ' ' || printf('%.2f', value)
       WHEN 2 THEN printf('%.2f', value) || 'abc' WHEN 3 THEN 'NaN' WHEN 4 THEN '' WHEN 5 THEN '1e3'
       WHEN 6 THEN printf('%.2f', value) || 'd' WHEN 7 THEN printf('%.2f', value) || 'f' WHEN 8 THEN 'zero' ELSE '1.5D' END"""


def q_coerce_numeric(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).select("event_id", NUM.coerce_numeric(numeric_text()).alias("number"))


register("coerce_numeric", f"""
SELECT event_id, CASE WHEN isnan(x) THEN NULL ELSE x END AS number
FROM (SELECT event_id, TRY_CAST(trim({SQL_NUMERIC_TEXT}) AS DOUBLE) AS x FROM {SQL_EVENTS_K} e) t""")(q_coerce_numeric)

MEASURE_COLS = ["ts", "Power_Consumption", "voltage", "current", "temperature", "humidity"]

register("null_profile", " UNION ALL ".join(
    f"""SELECT series_id, '{c}' AS "column", CAST(count_if({'"current"' if c == 'current' else c} IS NULL) AS BIGINT) AS null_count
        FROM {sql_readings('event_type')} r GROUP BY series_id""" for c in MEASURE_COLS))(
    lambda spark, d: C.null_profile(load_readings(spark, d, "event_type"), MEASURE_COLS, ["series_id"]))


def q_reject_series(spark: SparkSession, d: str) -> DataFrame:
    valid, quarantine = C.reject_series_with_nulls(load_readings(spark, d, "user_event"))
    return (valid.select(*KEYCOLS, F.lit(False).alias("quarantined"))
            .unionByName(quarantine.select(*KEYCOLS, F.lit(True).alias("quarantined"))))


register("reject_series_with_nulls", f"""
SELECT series_id, ts, arrival_no, bool_or(temperature IS NULL OR humidity IS NULL OR ts IS NULL
       OR Power_Consumption IS NULL OR voltage IS NULL OR "current" IS NULL) OVER (PARTITION BY series_id) AS quarantined
FROM {sql_readings('user_event')} r""")(q_reject_series)

register("impute_mean_or_default", sql_rounded(sql_imputed("user_id"), KEYCOLS + ["Power_Consumption", "voltage", "current"],
                                               ["temperature", "humidity"]))(
    lambda spark, d: rounded(C.impute_mean_or_default(load_readings(spark, d, "user_id")),
                             KEYCOLS + ["Power_Consumption", "voltage", "current"], ["temperature", "humidity"]))

register("series_means", f"""SELECT series_id, {R('avg(temperature)')} AS mean_temperature, {R('avg(humidity)')} AS mean_humidity
FROM {sql_readings('user_id')} r GROUP BY series_id""")(
    lambda spark, d: rounded(C.series_means(load_readings(spark, d, "user_id")), ["series_id"],
                             ["mean_temperature", "mean_humidity"]))

register("rename_target", f"""SELECT series_id, ts, arrival_no, Power_Consumption AS energy_kwh, voltage, "current",
temperature, humidity FROM {sql_readings('event_type')} r""")(
    lambda spark, d: C.rename_target(load_readings(spark, d, "event_type")))

SEQ_RAW = ["energy_kwh", "hour", "day_of_week", "is_weekend", "is_peak_hours", "energy_lag_1", "energy_lag_24"]
SEQ_DBL = ["temperature", "humidity", "energy_mean_24h"]

register("select_sequence_features", sql_rounded(sql_features_warm(), KEYCOLS + SEQ_RAW, SEQ_DBL))(
    lambda spark, d: rounded(C.select_sequence_features(features_warm(spark, d), KEYCOLS),
                             KEYCOLS + SEQ_RAW, SEQ_DBL))


def q_drop_warmup_rows(spark: SparkSession, d: str) -> DataFrame:
    lags = W.energy_lags(load_readings(spark, d, "user_id"))
    return C.drop_warmup_rows(lags).select(*KEYCOLS, "energy_lag_1", "energy_lag_24")


register("drop_warmup_rows", f"""SELECT * FROM (
  SELECT series_id, ts, arrival_no, lag(Power_Consumption, 1) {sql_win()} AS energy_lag_1,
         lag(Power_Consumption, 24) {sql_win()} AS energy_lag_24 FROM {sql_readings('user_id')} r) t
WHERE energy_lag_1 IS NOT NULL AND energy_lag_24 IS NOT NULL""")(q_drop_warmup_rows)

register("drop_incomplete_rows", f"SELECT {SQL_READING_COLS} FROM {sql_readings('user_id')} r WHERE temperature IS NOT NULL AND humidity IS NOT NULL")(
    lambda spark, d: C.drop_incomplete_rows(load_readings(spark, d, "user_id")))


def sql_status(source: str, checked: str) -> str:
    return f"""SELECT series_id, CAST(count(*) AS BIGINT) AS n_rows,
       CAST(greatest(count(*) - 24, 0) AS BIGINT) AS n_feature_rows,
       CASE WHEN bool_or({checked}) THEN 'invalid_input'
            WHEN greatest(count(*) - 24, 0) < 24 THEN 'insufficient_history'
            WHEN count(*) <= 168 THEN 'missing_lag' ELSE 'scored' END AS status
FROM {source} s GROUP BY series_id"""


ALL_NULL_CHECK = ('ts IS NULL OR Power_Consumption IS NULL OR voltage IS NULL OR "current" IS NULL '
                  'OR temperature IS NULL OR humidity IS NULL')

register("history_status", sql_status(sql_imputed("user_id"), ALL_NULL_CHECK))(
    lambda spark, d: C.history_status(C.impute_mean_or_default(load_readings(spark, d, "user_id"))))


def sql_padded(series_key: str = "user_event") -> str:
    return f"""(
  SELECT {SQL_READING_COLS}, FALSE AS is_padding FROM {sql_readings(series_key)} r
  UNION ALL
  SELECT series_id, f.ts - to_hours(i) AS ts, -i AS arrival_no,
         coalesce(f.Power_Consumption, 0.0::DOUBLE), coalesce(f.voltage, 230.0::DOUBLE),
         coalesce(f."current", 10.0::DOUBLE), coalesce(f.temperature, 20.0::DOUBLE),
         coalesce(f.humidity, 50.0::DOUBLE), TRUE AS is_padding
  FROM (SELECT series_id, n, f, unnest(generate_series(1, 24 - n)) AS i FROM (
          SELECT series_id, count(*) AS n,
                 arg_min({{'ts': ts, 'Power_Consumption': Power_Consumption, 'voltage': voltage,
                          'current': "current", 'temperature': temperature, 'humidity': humidity}}, arrival_no) AS f
          FROM {sql_readings(series_key)} r GROUP BY series_id) s WHERE n < 24) p
)"""


register("pad_short_series", f"SELECT * FROM {sql_padded('user_event')} p")(
    lambda spark, d: J.pad_short_series(
        load_readings(spark, d, "user_event")))

register("history_status_padded", sql_status(sql_padded("user_event"), ALL_NULL_CHECK))(
    lambda spark, d: C.history_status(
        J.pad_short_series(
            load_readings(spark, d, "user_event")).drop("is_padding")))


def q_default_if_missing(spark: SparkSession, d: str) -> DataFrame:
    w = weather(spark, d)
    return w.select("obs_id",
                    NUM.default_if_missing(F.col("temp"), TEMPERATURE_DEFAULT).alias("temperature"),
                    NUM.default_if_missing(F.col("humidity"), HUMIDITY_DEFAULT).alias("humidity"),
                    NUM.default_if_absent(F.when(F.col("wind_speed") > 3, F.col("wind_speed")), 0.0).alias("wind_speed"))


register("default_if_missing", f"""SELECT obs_id,
  coalesce(CASE WHEN temp = 0 OR isnan(temp) THEN NULL ELSE temp END, 20.0::DOUBLE) AS temperature,
  coalesce(CASE WHEN humidity = 0 OR isnan(humidity) THEN NULL ELSE humidity END, 50.0::DOUBLE) AS humidity,
  coalesce(CASE WHEN wind_speed > 3 THEN wind_speed END, 0.0::DOUBLE) AS wind_speed
FROM {sql_weather()} w""")(q_default_if_missing)


def q_first_non_null_name(spark: SparkSession, d: str) -> DataFrame:
    return weather(spark, d).select("obs_id", TXT.first_non_null_name(F.col("city"), F.col("town"), F.col("village")).alias("location_name"))


register("first_non_null_name", f"""SELECT obs_id, coalesce(nullif(city, ''), nullif(town, ''), nullif(village, ''), 'Unknown Location') AS location_name
FROM {sql_weather()} w""")(q_first_non_null_name)


def response_text():
    k = k_col()
    kt = F.get_json_object("props", "$.k")
    return (F.when(k % 8 == 0, F.lit(" \n")).when(k % 8 == 1, kt)
            .when(k % 8 == 2, F.concat(kt, F.lit("x"))).when(k % 8 == 3, F.concat(F.lit(" "), kt, F.lit(" ")))
            .when(k % 8 == 4, F.concat(kt, F.lit("d"))).when(k % 8 == 5, F.lit("inf"))
            .when(k % 8 == 6, F.lit("-Infinity")).otherwise(F.lit("0x1F")))


def q_valid_prediction(spark: SparkSession, d: str) -> DataFrame:
    v = NUM.valid_prediction(response_text())
    return events(spark, d).select("event_id", v["valid"].alias("valid"), v["prediction"].alias("prediction"))


register("valid_prediction", f"""SELECT event_id, x IS NOT NULL AS valid, x AS prediction FROM (
  SELECT event_id, CASE k % 8 WHEN 0 THEN 0.0::DOUBLE WHEN 1 THEN CAST(k AS DOUBLE) WHEN 3 THEN CAST(k AS DOUBLE)
         WHEN 6 THEN '-Infinity'::DOUBLE WHEN 7 THEN 31.0::DOUBLE END AS x
  FROM {SQL_EVENTS_K} e) t""")(q_valid_prediction)


# ---- T1–T9 ----------------------------------------------------------------------------------


CAL_COLS = ["hour", "day_of_week", "day_of_month", "month", "quarter", "year", "week_of_year"]

register("calendar_features", f"SELECT series_id, ts, arrival_no, {SQL_CALENDAR} FROM {sql_readings('event_type')} r")(
    lambda spark, d: load_readings(spark, d, "event_type").select(*KEYCOLS, *CAL.calendar_columns("ts")))

register("dow_sunday1", f"SELECT series_id, ts, arrival_no, CAST(dayofweek(ts) + 1 AS INTEGER) AS dow FROM {sql_readings('event_type')} r")(
    lambda spark, d: load_readings(spark, d, "event_type").select(*KEYCOLS, CAL.dow_sunday1("ts").alias("dow")))

register("flag_features", f"SELECT series_id, ts, arrival_no, {SQL_FLAGS} FROM {sql_readings('event_type')} r")(
    lambda spark, d: load_readings(spark, d, "event_type").select(*KEYCOLS, *CAL.calendar_columns("ts"))
    .select(*KEYCOLS, *CAL.flag_columns()))

SQL_CYCLIC = ("sin((CAST(hour(ts) AS INTEGER) * 2) * 3.14159::DOUBLE / 24) AS sin_hour, "
              "cos((CAST(hour(ts) AS INTEGER) * 2) * 3.14159::DOUBLE / 24) AS cos_hour")

register("cyclic_hour", sql_rounded(f"(SELECT series_id, ts, arrival_no, CAST(hour(ts) AS INTEGER) AS hour, {SQL_CYCLIC} FROM {sql_readings('event_type')} r)",
                                    KEYCOLS + ["hour"], ["sin_hour", "cos_hour"]))(
    lambda spark, d: rounded(load_readings(spark, d, "event_type").select(*KEYCOLS, F.hour("ts").alias("hour"))
                             .select("*", *CAL.cyclic_hour()), KEYCOLS + ["hour"], ["sin_hour", "cos_hour"]))

register("weather_interactions", sql_rounded(
    f"""(SELECT series_id, ts, arrival_no, temperature * CAST(hour(ts) AS INTEGER) AS temp_hour_interaction,
        humidity * temperature AS humidity_temp_interaction FROM {sql_imputed('user_id')} i)""",
    KEYCOLS, ["temp_hour_interaction", "humidity_temp_interaction"]))(
    lambda spark, d: rounded(C.impute_mean_or_default(load_readings(spark, d, "user_id"))
                             .select(*KEYCOLS, "temperature", "humidity", F.hour("ts").alias("hour"))
                             .select(*KEYCOLS, *CAL.weather_interactions()),
                             KEYCOLS, ["temp_hour_interaction", "humidity_temp_interaction"]))


def list_text():
    """A reading list per event: its value, junk, partial numbers, specials."""
    k = k_col()
    v = F.format_string("%.2f", F.col("value"))
    kt = k.cast("string")
    inf = F.when(k % 9 == 0, F.lit("Infinity")).otherwise(F.lit("x"))
    return F.concat_ws(",", v, F.lit("abc"), F.concat(kt, F.lit("x")), F.lit(".5"), F.lit(" 1e3"),
                       F.lit("7."), F.lit("NaN"), F.lit(""), F.concat(F.lit("-"), kt), inf, F.lit("+2.5e-1z"))


SQL_LIST_TEXT = ("concat_ws(',', printf('%.2f', value), 'abc', CAST(k AS VARCHAR) || 'x', '.5', ' 1e3', '7.', 'NaN', '', "
                 "'-' || CAST(k AS VARCHAR), CASE WHEN k % 9 = 0 THEN 'Infinity' ELSE 'x' END, '+2.5e-1z')")
SQL_PREFIX = r"'^[+-]?(Infinity|([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?)'"


def sql_parse_list(text: str) -> str:
    return (f"list_filter(list_transform(string_split({text}, ','), "
            f"lambda x: TRY_CAST(regexp_extract(trim(x), {SQL_PREFIX}, 0) AS DOUBLE)), lambda x: x IS NOT NULL)")


def q_parse_reading_list(spark: SparkSession, d: str) -> DataFrame:
    vals = TXT.parse_reading_list(list_text())
    finite = F.filter(vals, lambda x: ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return events(spark, d).select(
        "event_id", F.size(vals).alias("n_values"), F.size(finite).alias("n_finite"),
        F.element_at(vals, 1).alias("first_value"), F.element_at(vals, -1).alias("last_value"),
        r6(F.aggregate(finite, F.lit(0.0), lambda a, x: a + x)).alias("finite_sum"))


register("parse_reading_list", f"""SELECT event_id, CAST(len(l) AS INTEGER) AS n_values,
  CAST(len(list_filter(l, lambda x: NOT isinf(x))) AS INTEGER) AS n_finite,
  l[1] AS first_value, l[-1] AS last_value,
  {R('list_reduce(list_prepend(0.0::DOUBLE, list_filter(l, lambda x: NOT isinf(x))), lambda a, x: a + x)')} AS finite_sum
FROM (SELECT event_id, {sql_parse_list(SQL_LIST_TEXT)} AS l FROM {SQL_EVENTS_K} e) t""")(q_parse_reading_list)


def long_list_text():
    """k % 40 values per event, value + 1 … value + n, as text."""
    k = k_col()
    items = F.transform(F.sequence(F.lit(1), F.greatest(k % 40, F.lit(1))),
                        lambda i: F.format_string("%.2f", F.col("value") + i))
    return F.when(k % 40 > 0, F.array_join(items, ",")).otherwise(F.lit(""))


SQL_LONG_LIST = ("CASE WHEN k % 40 > 0 THEN array_to_string(list_transform(range(1, k % 40 + 1), "
                 "lambda i: printf('%.2f', value + i)), ',') ELSE '' END")


def q_last_n_values(spark: SparkSession, d: str) -> DataFrame:
    t = TXT
    vals = TXT.parse_reading_list(long_list_text())
    kept = t.last_n_values(vals)
    return events(spark, d).select("event_id", F.size(vals).alias("n_values"), F.size(kept).alias("n_kept"),
                                   F.element_at(kept, 1).alias("first_kept"), F.element_at(kept, -1).alias("last_kept"),
                                   r6(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)).alias("kept_sum"))


register("last_n_values", f"""SELECT event_id, CAST(len(l) AS INTEGER) AS n_values,
  CASE WHEN len(l) >= 24 THEN 24 END AS n_kept,
  CASE WHEN len(l) >= 24 THEN l[len(l) - 23] END AS first_kept,
  CASE WHEN len(l) >= 24 THEN l[len(l)] END AS last_kept,
  CASE WHEN len(l) >= 24 THEN {R('list_reduce(list_prepend(0.0::DOUBLE, l[len(l) - 23:]), lambda a, x: a + x)')} END AS kept_sum
FROM (SELECT event_id, {sql_parse_list(SQL_LONG_LIST)} AS l FROM {SQL_EVENTS_K} e) t""")(q_last_n_values)


def q_request_points(spark: SparkSession, d: str) -> DataFrame:
    """T6 → T7 → T8 → P13: the form's data points, one request per event."""
    t = TXT
    kept = t.last_n_values(t.parse_reading_list(long_list_text()))
    # posexplode of a NULL list yields no rows: no separate filter that would parse twice
    pts = events(spark, d).select("event_id", "ts", F.posexplode(kept).alias("pos", "Power_Consumption"))
    pts = pts.select("event_id", F.col("pos").cast("int").alias("pos"),
                     t.hourly_stamp(F.col("ts"), F.col("pos"), 24).alias("ts"), "Power_Consumption")
    return J.form_points(pts)


register("request_points", f"""SELECT event_id, CAST(pos - 1 AS INTEGER) AS pos, ts - to_hours(24 - pos) AS ts,
  l[len(l) - 24 + pos] AS Power_Consumption, 230.0::DOUBLE AS voltage, 10.0::DOUBLE AS "current",
  20.0::DOUBLE AS temperature, 50.0::DOUBLE AS humidity
FROM (SELECT event_id, ts, l, unnest(range(1, 25)) AS pos FROM (
  SELECT event_id, ts, {sql_parse_list(SQL_LONG_LIST)} AS l FROM {SQL_EVENTS_K} e) t WHERE len(l) >= 24) u""")(q_request_points)


def q_format_fixed(spark: SparkSession, d: str) -> DataFrame:
    f = features_warm(spark, d).select(*KEYCOLS, r6(F.col("temperature")).alias("t"), r6(F.col("energy_mean_24h")).alias("m"))
    return f.select(*KEYCOLS, NUM.format_fixed(F.col("t"), 1).alias("temperature_display"),
                    NUM.format_fixed(F.col("m"), 3).alias("mean_display"))


register("format_fixed", f"""SELECT series_id, ts, arrival_no, {sql_to_fixed('t', 1)} AS temperature_display,
  {sql_to_fixed('m', 3)} AS mean_display
FROM (SELECT series_id, ts, arrival_no, {R('temperature')} AS t, {R('energy_mean_24h')} AS m FROM {sql_features_warm()} f) q""")(q_format_fixed)


# ---- J1–J3 ------------------------------------------------------------------------------------


SQL_DECODE = f"""SELECT w.obs_id, w.weather_code, coalesce(c.description, 'Unknown') AS description
FROM {sql_weather()} w LEFT JOIN {sql_weather_codes()} c ON w.weather_code = c.weather_code"""

register("decode_weather_code", SQL_DECODE)(
    lambda spark, d: J.decode_weather_code(weather(spark, d).select("obs_id", "weather_code")))

register("decode_weather_code_join", SQL_DECODE)(
    lambda spark, d: J.decode_weather_code(weather(spark, d).select("obs_id", "weather_code"), use_join=True))


def q_attach_current_weather(spark: SparkSession, d: str) -> DataFrame:
    r = load_readings(spark, d, "user_id")
    r = r.withColumn("location", WX.location_of_user(F.col("series_id").cast("long")))  # the series key is the user
    out = J.attach_current_weather(r, weather(spark, d))
    return out.select(*KEYCOLS, "location", "temperature", "humidity", "wind_speed", "weather_description",
                      "location_name", "obs_ts")


register("attach_current_weather", f"""
WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY location ORDER BY ts DESC, obs_id DESC) AS rn
                               FROM {sql_weather()} w) x WHERE rn = 1),
     r AS (SELECT CAST(user_id AS VARCHAR) AS series_id, ts, event_id AS arrival_no,
                  'loc_' || CAST(user_id % 7 AS VARCHAR) AS location FROM events)
SELECT r.series_id, r.ts, r.arrival_no, r.location,
       coalesce(CASE WHEN l.temp = 0 THEN NULL ELSE l.temp END, 20.0::DOUBLE) AS temperature,
       coalesce(CASE WHEN l.humidity = 0 THEN NULL ELSE l.humidity END, 50.0::DOUBLE) AS humidity,
       l.wind_speed, coalesce(c.description, 'Unknown') AS weather_description,
       coalesce(nullif(l.city, ''), nullif(l.town, ''), nullif(l.village, ''), 'Unknown Location') AS location_name,
       l.ts AS obs_ts
FROM r LEFT JOIN latest l USING (location) LEFT JOIN {sql_weather_codes()} c ON l.weather_code = c.weather_code""")(q_attach_current_weather)



def q_align_predictions(spark: SparkSession, d: str) -> DataFrame:
    r = load_readings(spark, d, "event_type")
    target = features_warm(spark, d).select(*KEYCOLS, F.col("energy_kwh").alias("y"))
    seq = S.sliding_sequences(r).select(
        *KEYCOLS, (F.aggregate("seq", F.lit(0.0), lambda a, x: a + x) / F.lit(24.0)).alias("seq_pred"))
    boost = W.training_features(r).select(*KEYCOLS, F.col("lag_24").alias("boost_pred"))
    out = J.align_predictions(target, seq, boost)
    return out.select(*KEYCOLS, "y", r6(F.col("seq_pred")).alias("seq_pred"), "boost_pred")


register("align_predictions", f"""
WITH s AS (SELECT series_id, ts, arrival_no, avg(Power_Consumption) {sql_win(frame=rows(24, -1))} AS seq_pred,
                  count(*) {sql_win(frame=rows(24, -1))} AS n, lag(Power_Consumption, 24) {sql_win()} AS boost_pred
           FROM {sql_readings('event_type')} r)
SELECT f.series_id, f.ts, f.arrival_no, f.energy_kwh AS y, {R('s.seq_pred')} AS seq_pred, s.boost_pred
FROM {sql_features_warm()} f JOIN s USING (series_id, ts, arrival_no) WHERE s.n = 24""")(q_align_predictions)


# ---- W1–W12, W14 -------------------------------------------------------------------------------

LAG_COLS = [f"energy_lag_{k}" for k in (1, 2, 3, 24, 48, 168)]
P = "Power_Consumption"

register("energy_lags", f"""SELECT series_id, ts, arrival_no, {P},
  {', '.join(f'lag({P}, {k}) {sql_win()} AS energy_lag_{k}' for k in (1, 2, 3, 24, 48, 168))}
FROM {sql_readings('user_id')} r""")(
    lambda spark, d: W.energy_lags(load_readings(spark, d, "user_id")).select(*KEYCOLS, P, *LAG_COLS))

ROLL_DBL = ["energy_mean_24h", "energy_std_24h", "energy_mean_7d", "energy_std_7d"]
ROLL_RAW = ["energy_min_24h", "energy_max_24h"]

register("rolling_features", sql_rounded(f"""(SELECT series_id, ts, arrival_no,
  avg({P}) {sql_win(frame=rows(23))} AS energy_mean_24h, stddev_samp({P}) {sql_win(frame=rows(23))} AS energy_std_24h,
  min({P}) {sql_win(frame=rows(23))} AS energy_min_24h, max({P}) {sql_win(frame=rows(23))} AS energy_max_24h,
  avg({P}) {sql_win(frame=rows(167))} AS energy_mean_7d, stddev_samp({P}) {sql_win(frame=rows(167))} AS energy_std_7d
FROM {sql_readings('event_type')} r)""", KEYCOLS + ROLL_RAW, ROLL_DBL))(
    lambda spark, d: rounded(W.rolling_features(load_readings(spark, d, "event_type")), KEYCOLS + ROLL_RAW, ROLL_DBL))

TRAIN_RAW = ["Power_Consumption", "hour", "dow", "lag_1", "lag_24"]
TRAIN_DBL = ["sin_hour", "cos_hour", "rolling_3h"]


def delivered(spark: SparkSession, d: str, series_key: str = "event_type") -> DataFrame:
    """Readings of which every tenth was delivered again under a later arrival number."""
    r = load_readings(spark, d, series_key)
    again = r.where("arrival_no % 10 = 3").withColumn("arrival_no", F.col("arrival_no") + 1_000_000_000)
    return r.unionByName(again)


def sql_delivered(series_key: str = "event_type") -> str:
    return f"""(SELECT * FROM {sql_readings(series_key)} a UNION ALL BY NAME
  SELECT * REPLACE (arrival_no + 1000000000 AS arrival_no) FROM {sql_readings(series_key)} b WHERE arrival_no % 10 = 3)"""


def sql_training(series_key: str = "event_type") -> str:
    return f"""(SELECT series_id, ts, arrival_no, {P}, voltage, "current", temperature, humidity,
  CAST(hour(ts) AS INTEGER) AS hour, CAST(dayofweek(ts) + 1 AS INTEGER) AS dow, {SQL_CYCLIC},
  lag({P}, 1) {sql_win()} AS lag_1, lag({P}, 24) {sql_win()} AS lag_24,
  avg({P}) {sql_win(frame=rows(3))} AS rolling_3h
FROM (SELECT series_id, ts, {P}, voltage, "current", temperature, humidity, min(arrival_no) AS arrival_no
      FROM {sql_delivered(series_key)} r0 WHERE {P} IS NOT NULL GROUP BY ALL) r)"""


register("training_features", sql_rounded(sql_training(), KEYCOLS + TRAIN_RAW, TRAIN_DBL))(
    lambda spark, d: rounded(W.training_features(delivered(spark, d)), KEYCOLS + TRAIN_RAW, TRAIN_DBL))

register("training_lags", f"SELECT series_id, ts, arrival_no, lag_1, lag_24 FROM {sql_training('user_id')} t")(
    lambda spark, d: W.training_features(delivered(spark, d, "user_id")).select(*KEYCOLS, "lag_1", "lag_24"))

register("rolling_3h", sql_rounded(sql_training("user_id"), KEYCOLS, ["rolling_3h"]))(
    lambda spark, d: rounded(W.training_features(delivered(spark, d, "user_id")), KEYCOLS, ["rolling_3h"]))


def value_frame(spark: SparkSession, d: str) -> DataFrame:
    """Generic ``value`` series: temperature per user (it has NULLs inside)."""
    return load_readings(spark, d, "user_id").select(*KEYCOLS, F.col("temperature").alias("value"))


def q_short_lags(spark: SparkSession, d: str) -> DataFrame:
    return over_series(value_frame(spark, d), ["series_id"], lambda f, s: f.select("*", *W.short_lag_cols(s)), halo=3)


SQL_VALUE = f"(SELECT series_id, ts, arrival_no, temperature AS value FROM {sql_readings('user_id')} r)"

register("short_lags", f"""SELECT series_id, ts, arrival_no, value,
  {', '.join(f'lag(value, {k}) {sql_win()} AS lag_{k}' for k in (1, 2, 3))} FROM {SQL_VALUE} v""")(q_short_lags)


def sql_strict(n: int) -> str:
    w = sql_win(frame=rows(n - 1))
    return f"CASE WHEN count(*) {w} = {n} AND count(value) {w} = {n} THEN avg(value) {w} END AS rolling_{n}"


def q_rolling_strict(spark: SparkSession, d: str) -> DataFrame:
    out = over_series(value_frame(spark, d), ["series_id"], lambda f, s: f.select("*", *W.rolling_strict_cols(s)), halo=4)
    return rounded(out, KEYCOLS, ["rolling_3", "rolling_5"])


register("rolling_strict", sql_rounded(f"(SELECT series_id, ts, arrival_no, {sql_strict(3)}, {sql_strict(5)} FROM {SQL_VALUE} v)",
                                       KEYCOLS, ["rolling_3", "rolling_5"]))(q_rolling_strict)

register("build_value_features", sql_rounded(f"""(SELECT * FROM (SELECT series_id, ts, arrival_no, value,
  {', '.join(f'lag(value, {k}) {sql_win()} AS lag_{k}' for k in (1, 2, 3))}, {sql_strict(3)}, {sql_strict(5)}
  FROM {SQL_VALUE} v) t WHERE value IS NOT NULL AND lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL
  AND rolling_3 IS NOT NULL AND rolling_5 IS NOT NULL)""", KEYCOLS + ["value", "lag_1", "lag_2", "lag_3"], ["rolling_3", "rolling_5"]))(
    lambda spark, d: rounded(W.build_value_features(value_frame(spark, d)), KEYCOLS + ["value", "lag_1", "lag_2", "lag_3"],
                             ["rolling_3", "rolling_5"]))

register("last_n_rows", f"""SELECT * FROM (SELECT series_id, ts, arrival_no, {P},
  CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, arrival_no DESC) AS INTEGER) AS recency
  FROM {sql_readings('user_id')} r) t WHERE recency <= 24""")(
    lambda spark, d: W.last_n_rows(load_readings(spark, d, "user_id"), 24, rank_col="recency")
    .select(*KEYCOLS, P, "recency"))

register("first_n_rows", f"""SELECT * FROM (SELECT series_id, ts, arrival_no, {P},
  CAST(row_number() OVER (PARTITION BY series_id ORDER BY ts, arrival_no) AS INTEGER) AS position
  FROM {sql_readings('user_id')} r) t WHERE position <= 3""")(
    lambda spark, d: W.last_n_rows(load_readings(spark, d, "user_id"), 3, newest=False, rank_col="position")
    .select(*KEYCOLS, P, "position"))


def seq_summary(df: DataFrame, with_target: bool = True) -> DataFrame:
    cols = [*KEYCOLS, F.size("seq").alias("seq_size"), F.element_at("seq", 1).alias("seq_first"),
            F.element_at("seq", -1).alias("seq_last"),
            r6(F.aggregate("seq", F.lit(0.0), lambda a, x: a + x)).alias("seq_sum")]
    if with_target:
        cols.append("y")
    return df.select(*cols)


def sql_seq_summary(series_key: str, with_target: bool = True, part: str = "series_id") -> str:
    w = sql_win(part, frame=rows(24, -1))
    y = f", {P} AS y" if with_target else ""
    return f"""SELECT series_id, ts, arrival_no, CAST(n AS INTEGER) AS seq_size, seq_first, seq_last, {R('s')} AS seq_sum{y}
FROM (SELECT *, count(*) {w} AS n, first_value({P}) {w} AS seq_first, last_value({P}) {w} AS seq_last,
             sum({P}) {w} AS s FROM {sql_readings(series_key)} r) t WHERE n = 24"""


register("sliding_sequences", sql_seq_summary("event_type"))(
    lambda spark, d: seq_summary(S.sliding_sequences(load_readings(spark, d, "event_type"))))

register("sliding_sequences_x", sql_seq_summary("user_id", with_target=False))(
    lambda spark, d: seq_summary(S.sliding_sequences(load_readings(spark, d, "user_id"), with_target=False), False))

register("sliding_sequences_global", sql_seq_summary("constant"))(
    lambda spark, d: seq_summary(S.sliding_sequences(load_readings(spark, d, "constant"), strategy="chunked",
                                                          chunk_rows=1000)))


register("sequence_blocks", sql_seq_summary("event_type"))(
    lambda spark, d: seq_summary(S.block_sequences(S.sequence_blocks(load_readings(spark, d, "event_type")))))

register("sequence_blocks_global", sql_seq_summary("constant"))(
    lambda spark, d: seq_summary(S.block_sequences(S.sequence_blocks(load_readings(spark, d, "constant"), strategy="chunked", block_windows=256))))


def q_latest_sequence(spark: SparkSession, d: str) -> DataFrame:
    s = S.latest_sequence(features_warm(spark, d, "user_id"))
    energy = F.transform("seq", lambda st: st[0])
    temp = F.transform("seq", lambda st: st[1])
    return s.select("series_id", "n_steps", "last_ts",
                    F.element_at(energy, 1).alias("first_energy"), F.element_at(energy, -1).alias("last_energy"),
                    r6(F.aggregate(energy, F.lit(0.0), lambda a, x: a + x)).alias("sum_energy"),
                    r6(F.aggregate(temp, F.lit(0.0), lambda a, x: a + x)).alias("sum_temperature"),
                    F.size(F.element_at("seq", 1)).alias("n_features"))


register("latest_sequence", f"""SELECT series_id, CAST(count(*) AS INTEGER) AS n_steps, max(ts) AS last_ts,
  arg_min(energy_kwh, rk) AS first_energy, arg_max(energy_kwh, rk) AS last_energy,
  {R('sum(energy_kwh)')} AS sum_energy, {R('sum(temperature)')} AS sum_temperature, 10 AS n_features
FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts, arrival_no) AS rk,
             row_number() OVER (PARTITION BY series_id ORDER BY ts DESC, arrival_no DESC) AS recency
      FROM {sql_features_warm('user_id')} f) t WHERE recency <= 24 GROUP BY series_id""")(q_latest_sequence)


# ---- A1–A7, O1, M8, M10, M11 ---------------------------------------------------------------------


AVG_COLS = ["arrival_no", "Power_Consumption", "voltage", "current", "humidity", "hour", "dow",
            "sin_hour", "cos_hour", "lag_1", "lag_24", "rolling_3h"]


def q_avg_by(spark: SparkSession, d: str) -> DataFrame:
    tf = W.training_features(delivered(spark, d))
    out = A.avg_by(tf, "temperature", AVG_COLS)
    return rounded(out, ["temperature"], [f"avg_{c}" for c in AVG_COLS])


register("avg_by", f"""SELECT temperature, {', '.join(f'{R(f"avg(CAST({chr(34) + c + chr(34) if c == 'current' else c} AS DOUBLE))")} AS avg_{c}' for c in AVG_COLS)}
FROM {sql_training('event_type')} t GROUP BY temperature""")(q_avg_by)

register("prediction_bounds", sql_rounded(f"""(SELECT series_id, least(min(y), min(prediction)) AS min_val,
  greatest(max(y), max(prediction)) AS max_val FROM {sql_stand_in()} p GROUP BY series_id)""", ["series_id"], ["min_val", "max_val"]))(
    lambda spark, d: rounded(A.prediction_bounds(stand_in_predictions(spark, d), keys=["series_id"]),
                             ["series_id"], ["min_val", "max_val"]))

register("mae", f"SELECT series_id, {R('avg(abs(y - prediction))')} AS mae FROM {sql_stand_in()} p GROUP BY series_id")(
    lambda spark, d: rounded(A.mae(stand_in_predictions(spark, d), keys=["series_id"]), ["series_id"], ["mae"]))

register("rmse", f"SELECT series_id, {R('sqrt(avg(pow(y - prediction, 2)))')} AS rmse FROM {sql_stand_in()} p GROUP BY series_id")(
    lambda spark, d: rounded(A.rmse(stand_in_predictions(spark, d), keys=["series_id"]), ["series_id"], ["rmse"]))

register("evaluate", f"""SELECT CAST(count(*) AS BIGINT) AS n, {R('avg(abs(y - prediction))')} AS mae,
  {R('sqrt(avg((y - prediction) * (y - prediction)))')} AS rmse FROM {sql_stand_in()} p WHERE prediction IS NOT NULL""")(
    lambda spark, d: rounded(A.evaluate(stand_in_predictions(spark, d).filter(F.col("prediction").isNotNull())),
                             ["n"], ["mae", "rmse"]))

register("actual_vs_predicted", sql_rounded(f"(SELECT series_id, ts, arrival_no, y AS actual, prediction AS predicted FROM {sql_stand_in()} p)",
                                            KEYCOLS + ["actual"], ["predicted"]))(
    lambda spark, d: rounded(A.actual_vs_predicted(stand_in_predictions(spark, d), keep=KEYCOLS),
                             KEYCOLS + ["actual"], ["predicted"]))

register("weighted_ensemble", sql_rounded(sql_stand_in(), KEYCOLS + ["y", "rf_pred", "gbt_pred"], ["seq_pred", "prediction"]))(
    lambda spark, d: rounded(stand_in_predictions(spark, d), KEYCOLS + ["y", "rf_pred", "gbt_pred"], ["seq_pred", "prediction"]))

register("time_split", f"""SELECT series_id, ts, arrival_no,
  CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY ts, arrival_no) - 1
            < floor(count(*) OVER (PARTITION BY series_id) * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS split
FROM {sql_features_warm()} f""")(
    lambda spark, d: A.time_split(features_warm(spark, d).select(*KEYCOLS)).select(*KEYCOLS, "split"))

register("time_split_global", f"""SELECT series_id, ts, arrival_no,
  CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY ts, arrival_no) - 1
            < floor(count(*) OVER (PARTITION BY series_id) * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS split
FROM {sql_readings('constant')} f""")(
    lambda spark, d: A.time_split(load_readings(spark, d, "constant"), strategy="chunked")
    .select(*KEYCOLS, "split"))

register("sort_by_time", f"SELECT {SQL_READING_COLS} FROM {sql_readings('user_id')} r ORDER BY series_id, ts, arrival_no")(
    lambda spark, d: W.sort_by_time(load_readings(spark, d, "user_id")))


# ---- M1, M5(b), M6, M7, M9 ----------------------------------------------------------------------


TREE_NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in
                             ["hour", "day_of_week", "month", "is_weekend", "is_peak_hours", "temperature",
                              "humidity", "temp_hour_interaction", "energy_lag_1", "energy_lag_24",
                              "energy_lag_168", "energy_mean_24h", "energy_std_24h", "energy_mean_7d"])

register("assemble_features", f"SELECT series_id, ts, arrival_no, energy_lag_168 FROM {sql_features_warm()} f WHERE {TREE_NOT_NULL}")(
    lambda spark, d: M.assemble_features(features_warm(spark, d)).select(*KEYCOLS, "energy_lag_168"))


def q_sequence_model_udf(spark: SparkSession, d: str) -> DataFrame:
    m = M
    seqs = S.sliding_sequences(load_readings(spark, d, "event_type"))
    udf = m.sequence_model_udf(m.mean_model, 24)
    return seqs.select(*KEYCOLS, r6(udf(F.col("seq"))).alias("seq_pred"))


register("sequence_model_udf", f"""SELECT series_id, ts, arrival_no, {R('s')} AS seq_pred FROM (
  SELECT *, count(*) {sql_win(frame=rows(24, -1))} AS n, avg({P}) {sql_win(frame=rows(24, -1))} AS s
  FROM {sql_readings('event_type')} r) t WHERE n = 24""")(q_sequence_model_udf)

SEQ_FEATS = ["energy_kwh", "temperature", "humidity", "hour", "day_of_week", "is_weekend", "is_peak_hours",
             "energy_lag_1", "energy_lag_24", "energy_mean_24h"]


def q_scale_sequence(spark: SparkSession, d: str) -> DataFrame:
    f = features_warm(spark, d).select(*KEYCOLS, *SEQ_FEATS)
    scaler = S.fit_scaler(f)
    return rounded(scaler.transform(f), KEYCOLS, SEQ_FEATS)


def sql_minmax_scaled() -> str:
    stats = ", ".join(f"min(CAST({c} AS DOUBLE)) OVER () AS lo_{c}, max(CAST({c} AS DOUBLE)) OVER () AS hi_{c}"
                      for c in SEQ_FEATS)
    scaled = ", ".join(
        f"(CAST({c} AS DOUBLE) - lo_{c}) / (CASE WHEN hi_{c} - lo_{c} = 0 THEN 1.0 ELSE hi_{c} - lo_{c} END) AS {c}"
        for c in SEQ_FEATS)
    return f"""(SELECT series_id, ts, arrival_no, {scaled}, lo_energy_kwh, hi_energy_kwh
FROM (SELECT *, {stats} FROM {sql_features_warm()} f) t)"""


register("scale_sequence", sql_rounded(sql_minmax_scaled(), KEYCOLS, SEQ_FEATS))(q_scale_sequence)


def q_inverse_scale_target(spark: SparkSession, d: str) -> DataFrame:
    f = features_warm(spark, d).select(*KEYCOLS, *SEQ_FEATS)
    scaler = S.fit_scaler(f)
    scaled = scaler.transform(f)
    return scaled.select(*KEYCOLS, r6(scaler.inverse_target(F.col("energy_kwh"))).alias("restored"))


register("inverse_scale_target", f"""SELECT series_id, ts, arrival_no,
  {R('energy_kwh * (hi_energy_kwh - lo_energy_kwh) + lo_energy_kwh')} AS restored FROM {sql_minmax_scaled()} t""")(q_inverse_scale_target)


def q_train_stacker(spark: SparkSession, d: str) -> DataFrame:
    m = M
    f = features_warm(spark, d).select(F.col("energy_kwh").alias("y"), F.col("energy_mean_24h").alias("a"),
                                       F.col("energy_lag_24").alias("b"))
    model = m.train_stacker(f, ["a", "b"])
    b0, (b1, b2) = m.stacker_coefficients(model)
    ev = A.evaluate(model.transform(f))
    return rounded(ev.select("n", "mae", "rmse", F.lit(b0).alias("intercept"), F.lit(b1).alias("coef_seq"),
                             F.lit(b2).alias("coef_boost")), ["n"], ["mae", "rmse", "intercept", "coef_seq", "coef_boost"])


register("train_stacker", f"""
WITH d AS (SELECT energy_kwh AS y, energy_mean_24h AS a, energy_lag_24 AS b FROM {sql_features_warm()} f),
s AS (SELECT *, avg(y) OVER () AS my, avg(a) OVER () AS ma, avg(b) OVER () AS mb,
             var_pop(a) OVER () AS vaa, var_pop(b) OVER () AS vbb,
             covar_pop(a, b) OVER () AS cab, covar_pop(a, y) OVER () AS cay,
             covar_pop(b, y) OVER () AS cby FROM d),
c AS (SELECT *, (vbb * cay - cab * cby) / (vaa * vbb - cab * cab) AS b1,
             (vaa * cby - cab * cay) / (vaa * vbb - cab * cab) AS b2 FROM s),
k AS (SELECT *, my - b1 * ma - b2 * mb AS b0 FROM c)
SELECT CAST(count(*) AS BIGINT) AS n, {R('avg(abs(y - (b0 + b1 * a + b2 * b)))')} AS mae,
       {R('sqrt(avg((y - (b0 + b1 * a + b2 * b)) * (y - (b0 + b1 * a + b2 * b))))')} AS rmse,
       {R('any_value(b0)')} AS intercept, {R('any_value(b1)')} AS coef_seq, {R('any_value(b2)')} AS coef_boost
FROM k  """)(q_train_stacker)


# ---- model fits, scoring, persistence: facts that SQL can check (surviving rows), flags that Spark computes ----

SMALL_RF = {"numTrees": 10, "maxDepth": 5}
SMALL_GBT = {"maxIter": 10, "maxDepth": 4}


def tree_frame(spark: SparkSession, d: str) -> DataFrame:
    """Training rows for the tree models.  They come out of the window's hash
    exchange sorted by the total order, so the layout (and with it the
    forest's per-partition bootstrap) is the same on every run."""
    return features_warm(spark, d)


def q_tree_fit(spark: SparkSession, d: str, fit, features: DataFrame) -> DataFrame:
    """Rows the assembler keeps, and whether each prediction is what the ensemble's own trees give together."""
    out = M.tree_parts(features, fit(features))
    same = F.abs(F.col("prediction") - F.col("from_parts")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("prediction"))
    return out.select(*KEYCOLS, "energy_kwh", F.coalesce(same, F.lit(False)).alias("parts_agree"))


def sql_tree_rows(source: str) -> str:
    return f"SELECT series_id, ts, arrival_no, energy_kwh, TRUE AS parts_agree FROM {source} f WHERE {TREE_NOT_NULL}"


register("train_random_forest", sql_tree_rows(sql_features_warm()))(
    lambda spark, d: q_tree_fit(spark, d, lambda f: M.train_random_forest(f, **SMALL_RF), tree_frame(spark, d)))
register("train_gbt", sql_tree_rows(sql_features_warm()))(
    lambda spark, d: q_tree_fit(spark, d, lambda f: M.train_gbt(f, **SMALL_GBT), tree_frame(spark, d)))


def q_train_hashed_forest(spark: SparkSession, d: str) -> DataFrame:
    """M2 with a bootstrap by row: how often each row is drawn for the first trees, and whether two layouts of the rows give
    the same forest."""
    # read five times: the features are computed once
    f = scratch_table(tree_frame(spark, d).select(*KEYCOLS, *dict.fromkeys([*TREE_FEATURES, LABEL])), "forest-features")
    small = {"numTrees": 4, "maxDepth": 5}
    one, other = HF.train_hashed_forest(f, **small), HF.train_hashed_forest(f.repartition(7, "arrival_no"), **small)
    both = other.transform(one.transform(f, "_one"), "_other")
    return both.select(*KEYCOLS, *[HF.draws(HF.KEY, k, 42).alias(f"drawn_{k}") for k in range(3)], (F.abs(F.col("_one") - F.col("_other")) < 1e-9).alias("same_forest"))


def sql_draws(tree: int) -> str:
    u = f"CAST('0x' || substr(md5(concat_ws(':', series_id, arrival_no, {tree}, 42)), 1, 8) AS BIGINT)"
    return "CAST(" + " + ".join(f"({u} >= {c})::INT" for c in HF.DRAWN_AT_MOST) + f" AS INT) AS drawn_{tree}"


register("train_hashed_forest", f"""SELECT series_id, ts, arrival_no, {', '.join(sql_draws(k) for k in range(3))}, TRUE AS same_forest
FROM {sql_features_warm()} f WHERE {TREE_NOT_NULL}""")(q_train_hashed_forest)


def boosted_frame(spark: SparkSession, d: str) -> DataFrame:
    """Training features with rows whose weather is NULL among them; they do not train, and are not predicted."""
    return W.training_features(delivered(spark, d))


def q_train_boosted(spark: SparkSession, d: str) -> DataFrame:
    tf = boosted_frame(spark, d)
    out = M.tree_parts(C.drop_incomplete_rows(tf), M.train_boosted(tf, maxIter=20, maxDepth=4), BOOST_FEATURES)
    same = F.abs(F.col("prediction") - F.col("from_parts")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs("prediction"))
    return out.select(*KEYCOLS, P, same.alias("parts_agree"))


register("train_boosted", f"""SELECT series_id, ts, arrival_no, {P}, TRUE AS parts_agree FROM {sql_training()} t
WHERE temperature IS NOT NULL AND humidity IS NOT NULL AND lag_1 IS NOT NULL AND lag_24 IS NOT NULL""")(q_train_boosted)


BOOST_ROUNDS, BOOST_DEPTH, BOOST_BINS = 3, 2, 16


def q_boosted_trees(spark: SparkSession, d: str) -> DataFrame:
    """M4, second order: every node of the first trees, with its split (the last value that goes left) or its leaf value."""
    m = BO.train_histogram_boosted(boosted_frame(spark, d), rounds=BOOST_ROUNDS, depth=BOOST_DEPTH, max_bins=BOOST_BINS)
    rows = [(t, k, BOOST_FEATURES[f] if f >= 0 else None, float(m.edges[f][b]) if f >= 0 else None, None if f >= 0 else float(v))
            for t, tree in enumerate(m.trees) for k, (f, b, v) in enumerate(zip(tree.feature.tolist(), tree.bin.tolist(), tree.value.tolist()))]
    out = spark.createDataFrame(rows, "round int, node int, feature string, threshold double, value double")
    return rounded(out, ["round", "node", "feature"], ["threshold", "value"])


def sql_boosted_trees() -> str:
    """The same trees by plain counting: each round and level looks at every row against every edge."""
    fs = BOOST_FEATURES
    quantiles = [k / BOOST_BINS for k in range(1, BOOST_BINS)]
    sql = f"""WITH t AS (SELECT row_number() OVER () AS id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in fs)}, {P} AS y FROM {sql_training()} t
  WHERE {' AND '.join(f'{c} IS NOT NULL' for c in [*fs, P])}),
e AS ({' UNION ALL '.join(f"SELECT DISTINCT {k} AS f, unnest(q) AS edge FROM (SELECT quantile_disc({c}, {quantiles}) AS q FROM t)" for k, c in enumerate(fs))}),
v AS ({' UNION ALL '.join(f"SELECT id, {k} AS f, {c} AS x FROM t" for k, c in enumerate(fs))}),
p0 AS (SELECT id, y, avg(y) OVER () AS pred FROM t)"""
    found = []
    for r in range(BOOST_ROUNDS):
        sql += f",\nn{r}_0 AS (SELECT id, pred - y AS g, 0 AS node FROM p{r})"
        for level in range(BOOST_DEPTH):
            n, b = f"n{r}_{level}", f"b{r}_{level}"
            sql += f""",
{b} AS (SELECT node, f, edge FROM (SELECT node, f, edge, gain, row_number() OVER (PARTITION BY node ORDER BY gain DESC, f, edge) AS k FROM (
  SELECT node, f, edge, round((gl * gl / (nl + 1.0) + (ga - gl) * (ga - gl) / (na - nl + 1.0) - ga * ga / (na + 1.0)) / (SELECT count(*) FROM t), 6) AS gain FROM (
    SELECT node, f, edge, coalesce(sum(g) FILTER (x <= edge), 0.0) AS gl, count(*) FILTER (x <= edge) AS nl, sum(g) AS ga, count(*) AS na
    FROM {n} JOIN v USING (id) JOIN e USING (f) WHERE node >= {(1 << level) - 1} GROUP BY node, f, edge)
  WHERE nl >= 1 AND na - nl >= 1)) WHERE k = 1 AND gain > 0),
n{r}_{level + 1} AS (SELECT {n}.id, g, CASE WHEN edge IS NULL THEN node ELSE 2 * node + 1 + (x > edge)::INT END AS node
  FROM {n} LEFT JOIN {b} USING (node) LEFT JOIN v ON v.id = {n}.id AND v.f = {b}.f)"""
            found.append(f"SELECT {r} AS round, node, f, edge, CAST(NULL AS DOUBLE) AS value FROM {b}")
        last = f"n{r}_{BOOST_DEPTH}"
        sql += f""",
l{r} AS (SELECT node, -0.05 * sum(g) / (count(*) + 1.0) AS value FROM {last} GROUP BY node),
p{r + 1} AS (SELECT id, p{r}.y, p{r}.pred + value AS pred FROM p{r} JOIN {last} USING (id) JOIN l{r} USING (node))"""
        found.append(f"SELECT {r} AS round, node, CAST(NULL AS INT) AS f, CAST(NULL AS DOUBLE) AS edge, value FROM l{r}")
    size = (1 << (BOOST_DEPTH + 1)) - 1
    names = "CASE f " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(fs)) + " END"
    return f"""{sql},
found AS ({' UNION ALL '.join(found)}),
every AS (SELECT CAST(r AS INT) AS round, CAST(k AS INT) AS node FROM range({BOOST_ROUNDS}) a(r), range({size}) b(k))
SELECT every.round, every.node, {names} AS feature, {R('edge')} AS threshold, {R('CASE WHEN f IS NULL THEN coalesce(value, 0.0) END')} AS value
FROM every LEFT JOIN found USING (round, node)"""


register("boosted_trees", sql_boosted_trees())(q_boosted_trees)


def q_train_boosted_full(spark: SparkSession, d: str) -> DataFrame:
    """M4 at the stored size (500 rounds, depth 6): predicted rows; the training error falls in every round, and what is
    predicted has that error."""
    tf = boosted_frame(spark, d)
    m = BO.train_histogram_boosted(tf)
    out = m.transform(tf.dropna(subset=[*BOOST_FEATURES, P]))
    falls = len(m.trees) == 500 and all(b <= a + 1e-9 * abs(a) for a, b in zip(m.losses, m.losses[1:]))
    err = out.agg(F.avg((F.col("prediction") - F.col(P)) ** 2)).first()[0]
    same = abs(err - m.losses[-1]) <= 1e-6 * max(1.0, m.losses[0])
    return out.select(*KEYCOLS, P, F.col("prediction").isNotNull().alias("predicted"), F.lit(falls).alias("loss_falls"), F.lit(same).alias("loss_agrees"))


register("train_boosted_full", f"""SELECT series_id, ts, arrival_no, {P}, TRUE AS predicted, TRUE AS loss_falls, TRUE AS loss_agrees FROM {sql_training()} t
WHERE {P} IS NOT NULL AND lag_1 IS NOT NULL AND lag_24 IS NOT NULL""")(q_train_boosted_full)


def q_train_sequence_model(spark: SparkSession, d: str) -> DataFrame:
    """M5(a) with M10: fitted on the older 80 % of each series; rows and errors of both parts.  The fit solves its
    least squares problem (residuals sum to 0 overall and against each of the 24 inputs), the held-out error is finite."""
    seqs = A.time_split(S.sliding_sequences(load_readings(spark, d, "event_type")).select(*KEYCOLS, "seq", "y"))
    model = M.train_sequence_model(seqs, split_col="split")
    out = M.score_sequence_model(model, seqs).select("split", "y", "seq_pred", "seq")
    train = out.filter(F.col("split") == "train")
    solved = M.normal_equations_hold(train, [F.get("seq", F.lit(k)) for k in range(24)], "y", "seq_pred")
    report = A.evaluate(out, "y", "seq_pred", ["split"])
    return report.select("split", "n", F.lit(solved).alias("normal_equations"), (F.col("mae") <= F.col("rmse")).alias("errors_ordered"))


register("train_sequence_model", f"""SELECT split, count(*) AS n, TRUE AS normal_equations, TRUE AS errors_ordered FROM (
  SELECT CASE WHEN row_number() {sql_win()} - 1 < floor(count(*) OVER (PARTITION BY series_id) * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS split
  FROM (SELECT *, count(*) {sql_win(frame=rows(24, -1))} AS n FROM {sql_readings('event_type')} r) q WHERE n = 24) t GROUP BY split""")(q_train_sequence_model)


def q_train_recurrent_model(spark: SparkSession, d: str) -> DataFrame:
    """M5, the recurrent network: fitted on the older 80 % of each series and served through the hook; rows and errors of
    both parts, and whether the training loss fell."""
    seqs = A.time_split(S.sliding_sequences(load_readings(spark, d, "event_type")).select(*KEYCOLS, "seq", "y"))
    net = RN.train_recurrent(seqs, layers=(8, 4), steps=12, rate=0.02, split_col="split")
    report = A.evaluate(net.transform(seqs).select("split", "y", "seq_pred"), "y", "seq_pred", ["split"])
    return report.select("split", "n", F.lit(net.losses[-1] < net.losses[0]).alias("loss_falls"), (F.col("mae") <= F.col("rmse")).alias("errors_ordered"))


register("train_recurrent_model", ORACLE_SQL["train_sequence_model"].replace("normal_equations", "loss_falls"))(q_train_recurrent_model)


def q_train_recurrent_blocks(spark: SparkSession, d: str) -> DataFrame:
    """M5 over blocks of rows: the same fit, windows cut inside the tasks; served over the windows of the blocks."""
    blocks = S.sequence_blocks(load_readings(spark, d, "event_type"))
    net = RN.train_recurrent_blocks(blocks, layers=(8, 4), steps=12, rate=0.02)
    report = A.evaluate(net.transform(S.block_sequences(blocks)).select("split", "y", "seq_pred"), "y", "seq_pred", ["split"])
    return report.select("split", "n", F.lit(net.losses[-1] < net.losses[0]).alias("loss_falls"), (F.col("mae") <= F.col("rmse")).alias("errors_ordered"))


register("train_recurrent_blocks", ORACLE_SQL["train_recurrent_model"])(q_train_recurrent_blocks)


def q_save_load_model(spark: SparkSession, d: str) -> DataFrame:
    f = tree_frame(spark, d)
    model = M.train_gbt(f, **SMALL_GBT)
    path = scratch_path(spark, "gbt-model")
    M.save_model(model, path)
    fitted = model.stages[-1].copy().setPredictionCol("pred_fitted")
    reloaded = M.load_pipeline(path).stages[-1].copy().setPredictionCol("pred_reloaded")
    both = reloaded.transform(fitted.transform(M.assemble_features(f)))
    return both.select(*KEYCOLS, (F.col("pred_fitted") == F.col("pred_reloaded")).alias("same_prediction"))


register("save_load_model", f"SELECT series_id, ts, arrival_no, TRUE AS same_prediction FROM {sql_features_warm()} f WHERE {TREE_NOT_NULL}")(q_save_load_model)


def q_stacked_ensemble(spark: SparkSession, d: str) -> DataFrame:
    """The stacked ensemble end to end: sequence model and booster fitted on the older 80 % of each series, their
    predictions aligned by row key, the linear meta model over them, saved and reloaded, its errors per split.  The meta
    model equals the closed form over the base predictions."""
    r = load_readings(spark, d, "event_type")
    seqs = A.time_split(S.sliding_sequences(r).select(*KEYCOLS, "seq", "y"))
    sequence = M.train_sequence_model(seqs, split_col="split")
    seq = M.score_sequence_model(sequence, seqs).select(*KEYCOLS, "split", F.col("y"), "seq_pred")
    tf = C.drop_incomplete_rows(W.training_features(r))
    in_train = J.align_predictions(tf, seq.filter(F.col("split") == "train").select(*KEYCOLS))
    booster = M.train_boosted(in_train, maxIter=20, maxDepth=4)
    boost = booster.transform(tf).select(*KEYCOLS, F.col("prediction").alias("boost_pred"))
    base = J.align_predictions(seq, boost).persist(StorageLevel.MEMORY_AND_DISK)  # read by the fit, the closed form and the report
    try:
        meta = M.train_stacker(base, ["seq_pred", "boost_pred"])
        b0, (b1, b2) = M.stacker_coefficients(meta)
        m = base.agg(F.avg("y").alias("my"), F.avg("seq_pred").alias("ma"), F.avg("boost_pred").alias("mb"), F.var_pop("seq_pred").alias("vaa"),
                     F.var_pop("boost_pred").alias("vbb"), F.covar_pop("seq_pred", "boost_pred").alias("cab"),
                     F.covar_pop("seq_pred", "y").alias("cay"), F.covar_pop("boost_pred", "y").alias("cby")).first()
        det = m.vaa * m.vbb - m.cab**2
        c1, c2 = (m.vbb * m.cay - m.cab * m.cby) / det, (m.vaa * m.cby - m.cab * m.cay) / det
        closed = max(abs(b1 - c1), abs(b2 - c2), abs(b0 - (m.my - c1 * m.ma - c2 * m.mb))) < 1e-6
        path = scratch_path(spark, "meta-model")
        M.save_model(meta, path)
        out = meta.transform(base).drop("stack_features")
        again = M.load_pipeline(path).transform(base).select(*KEYCOLS, F.col("prediction").alias("_again"))
        out = J.align_predictions(out, again)
        report = out.groupBy("split").agg(
            F.count(F.lit(1)).alias("n"), F.bool_and(F.col("prediction") == F.col("_again")).alias("same_after_reload"),
            (F.sqrt(F.avg(F.pow(F.col("y") - F.col("prediction"), 2))) >= F.avg(F.abs(F.col("y") - F.col("prediction")))).alias("errors_ordered"))
        result = report.select("split", "n", "same_after_reload", "errors_ordered", F.lit(closed).alias("equals_closed_form"))
        return spark.createDataFrame(result.collect(), result.schema)  # two rows; the cached base goes now
    finally:
        base.unpersist()


register("stacked_ensemble", f"""SELECT split, count(*) AS n, TRUE AS same_after_reload, TRUE AS errors_ordered, TRUE AS equals_closed_form FROM (
  SELECT *, CASE WHEN row_number() {sql_win()} - 1 < floor(count(*) OVER (PARTITION BY series_id) * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS split
  FROM (SELECT *, count(*) {sql_win(frame=rows(24, -1))} AS n FROM {sql_readings('event_type')} r) q WHERE n = 24) t
WHERE temperature IS NOT NULL AND humidity IS NOT NULL GROUP BY split""")(q_stacked_ensemble)


def scored_readings(spark: SparkSession, d: str) -> DataFrame:
    """Long series, short series, and one long series (``blind``) without any temperature."""
    long = load_readings(spark, d, "event_type")
    blind = load_readings(spark, d, "constant").withColumns({"series_id": F.lit("blind"), "temperature": F.lit(None).cast("double")})
    return long.unionByName(load_readings(spark, d, "user_event")).unionByName(blind)


def sql_scored_readings() -> str:
    return f"""(SELECT * FROM {sql_readings('event_type')} a UNION ALL SELECT * FROM {sql_readings('user_event')} b
  UNION ALL SELECT * REPLACE ('blind' AS series_id, CAST(NULL AS DOUBLE) AS temperature) FROM {sql_readings('constant')} c)"""


def with_blend_flag(df: DataFrame) -> DataFrame:
    """``blend_ok``: exactly the scored series have a prediction, and it is the weighted sum of the three."""
    blend = M.weighted_ensemble(F.col("seq_pred"), F.col("rf_pred"), F.col("gbt_pred"))
    right = F.when(F.col("status") == "scored", F.abs(F.col("prediction") - blend) < 1e-9).otherwise(F.col("prediction").isNull())
    return df.withColumn("blend_ok", F.coalesce(right, F.lit(False)))


def q_score_series(spark: SparkSession, d: str, mode: str = "impute") -> DataFrame:
    models = SC.fit_forecast_models(tree_frame(spark, d), rf_params=SMALL_RF, gbt_params=SMALL_GBT)
    out = SC.score_series(scored_readings(spark, d), models, mode=mode)
    return with_blend_flag(out).select("series_id", "n_rows", "status", "scored_ts", "blend_ok")


def sql_score_series(invalid: str) -> str:
    return f"""SELECT series_id, n_rows, status, CASE WHEN status = 'scored' THEN newest END AS scored_ts, TRUE AS blend_ok FROM (
  SELECT series_id, CAST(greatest(count(*), 24) AS BIGINT) AS n_rows, max(ts) AS newest,
         CASE WHEN {invalid} THEN 'invalid_input' WHEN count(*) < 48 THEN 'insufficient_history'
              WHEN count(*) <= 168 THEN 'missing_lag' ELSE 'scored' END AS status
  FROM {sql_scored_readings()} r GROUP BY series_id) t"""


register("score_series", sql_score_series("bool_or(ts IS NULL) OR count(temperature) = 0 OR count(humidity) = 0"))(q_score_series)
register("score_series_reject", sql_score_series(f"bool_or({ALL_NULL_CHECK})"))(lambda spark, d: q_score_series(spark, d, "reject"))


# ---- M13 stream ------------------------------------------------------------------------------------

STREAM_DBL = ["energy_mean_24h", "energy_std_24h", "energy_mean_7d", "energy_std_7d"]
STREAM_RAW = ["energy_kwh", *LAG_COLS, "energy_min_24h", "energy_max_24h", "late_rows"]


SLICES = 4


def replayed(spark: SparkSession, readings: DataFrame, tag: str, models=None, hot_rows: int = HOT_SERIES_ROWS,
             chunk_rows: int = CHUNK_ROWS, slices: int = SLICES) -> tuple[DataFrame, DataFrame]:
    """A table replayed as ordered micro-batches: (output rows, counts per series)."""
    base = scratch_path(spark, tag)
    sliced = readings if "_slice" in readings.columns else ST.time_slices(readings, slices)
    schema = readings.drop("_slice").schema
    ST.replay(sliced, f"{base}/in", slices, lambda: ST.run_stream(
        spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", schema, models, hot_rows, chunk_rows))
    return spark.read.parquet(f"{base}/out"), ST.stream_counts(spark, f"{base}/ckpt")


def q_score_stream(spark: SparkSession, d: str) -> DataFrame:
    """Readings replayed as a file stream in four time-ordered micro-batches;
    the state store carries each series' history between batches."""
    r = load_readings(spark, d, "event_type").select("series_id", "ts", "arrival_no", P)
    return rounded(replayed(spark, r, "stream")[0], KEYCOLS + STREAM_RAW, STREAM_DBL)


register("score_stream", sql_rounded(f"""(SELECT series_id, ts, arrival_no, {P} AS energy_kwh,
  {', '.join(f'lag({P}, {k}) {sql_win()} AS energy_lag_{k}' for k in (1, 2, 3, 24, 48, 168))},
  min({P}) {sql_win(frame=rows(23))} AS energy_min_24h, max({P}) {sql_win(frame=rows(23))} AS energy_max_24h,
  CAST(0 AS BIGINT) AS late_rows,
  avg({P}) {sql_win(frame=rows(23))} AS energy_mean_24h, stddev_samp({P}) {sql_win(frame=rows(23))} AS energy_std_24h,
  avg({P}) {sql_win(frame=rows(167))} AS energy_mean_7d, stddev_samp({P}) {sql_win(frame=rows(167))} AS energy_std_7d
FROM {sql_readings('event_type')} r)""", KEYCOLS + STREAM_RAW, STREAM_DBL))(q_score_stream)


# ---- per-name entries for W2, W3, T8, B10, M6 (standard) ------------------------------------------

register("rolling_24h", sql_rounded(f"""(SELECT series_id, ts, arrival_no,
  avg({P}) {sql_win(frame=rows(23))} AS energy_mean_24h, stddev_samp({P}) {sql_win(frame=rows(23))} AS energy_std_24h,
  min({P}) {sql_win(frame=rows(23))} AS energy_min_24h, max({P}) {sql_win(frame=rows(23))} AS energy_max_24h
FROM {sql_readings('user_id')} r)""", KEYCOLS + ROLL_RAW, ["energy_mean_24h", "energy_std_24h"]))(
    lambda spark, d: rounded(W.rolling_features(load_readings(spark, d, "user_id")), KEYCOLS + ROLL_RAW,
                             ["energy_mean_24h", "energy_std_24h"]))

register("rolling_7d", sql_rounded(f"""(SELECT series_id, ts, arrival_no,
  avg({P}) {sql_win(frame=rows(167))} AS energy_mean_7d, stddev_samp({P}) {sql_win(frame=rows(167))} AS energy_std_7d
FROM {sql_readings('constant')} r)""", KEYCOLS, ["energy_mean_7d", "energy_std_7d"]))(
    lambda spark, d: rounded(W.rolling_features(load_readings(spark, d, "constant"), strategy="chunked", chunk_rows=2048),
                             KEYCOLS, ["energy_mean_7d", "energy_std_7d"]))


def q_assign_hourly_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """T8 alone: each event's own reading list (T6) stamped hourly, ending at
    the event's time."""
    t = TXT
    e = events(spark, d).select("event_id", "ts", t.parse_reading_list(list_text()).alias("v"))
    return e.select("event_id", "ts", F.size("v").alias("n"), F.posexplode("v").alias("pos", "value")).select(
        "event_id", F.col("pos").cast("int").alias("pos"),
        t.hourly_stamp(F.col("ts"), F.col("pos"), F.col("n")).alias("ts"), "value")


register("assign_hourly_timestamps", f"""SELECT event_id, CAST(pos - 1 AS INTEGER) AS pos,
  ts - to_hours(CAST(len(l) - pos AS BIGINT)) AS ts, l[pos] AS value
FROM (SELECT event_id, ts, l, unnest(range(1, len(l) + 1)) AS pos FROM (
  SELECT event_id, ts, {sql_parse_list(SQL_LIST_TEXT)} AS l FROM {SQL_EVENTS_K} e) t) u""")(q_assign_hourly_timestamps)

register("horizon_label", f"""SELECT series_id, ts, arrival_no, energy_kwh,
  lead(energy_kwh, 1) OVER (PARTITION BY series_id ORDER BY ts, arrival_no) AS label FROM {sql_features_warm('user_id')} f""")(
    lambda spark, d: W.with_horizon(features_warm(spark, d, "user_id"), 1).select(*KEYCOLS, "energy_kwh", "label"))


def q_scale_sequence_standard(spark: SparkSession, d: str) -> DataFrame:
    f = features_warm(spark, d).select(*KEYCOLS, *SEQ_FEATS)
    scaler = S.fit_scaler(f, kind="standard")
    return rounded(scaler.transform(f), KEYCOLS, SEQ_FEATS)


def sql_standard_scaled() -> str:
    stats = ", ".join(f"avg(CAST({c} AS DOUBLE)) OVER () AS m_{c}, stddev_pop(CAST({c} AS DOUBLE)) OVER () AS s_{c}"
                      for c in SEQ_FEATS)
    scaled = ", ".join(
        f"(CAST({c} AS DOUBLE) - m_{c}) / (CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END) AS {c}"
        for c in SEQ_FEATS)
    return f"(SELECT series_id, ts, arrival_no, {scaled} FROM (SELECT *, {stats} FROM {sql_features_warm()} f) t)"


register("scale_sequence_standard", sql_rounded(sql_standard_scaled(), KEYCOLS, SEQ_FEATS))(q_scale_sequence_standard)


def q_score_stream_predictions(spark: SparkSession, d: str) -> DataFrame:
    """M13 end to end: readings replayed as ordered micro-batches (a series
    without any temperature among them); the last response of each series, and
    whether its blend is the weighted sum of the three predictions."""
    models = SC.fit_forecast_models(tree_frame(spark, d), rf_params=SMALL_RF, gbt_params=SMALL_GBT)
    r = scored_readings(spark, d).select("series_id", "ts", "arrival_no", P, "temperature", "humidity")
    out, _ = replayed(spark, r, "scoring-stream", models)
    last = out.groupBy("series_id").agg(F.max_by(F.struct(*[c for c in out.columns if c != "series_id"]), "epoch").alias("r")).select("series_id", "r.*")
    return with_blend_flag(last).select("series_id", F.col("n_seen").alias("n_rows"), "late_rows", "status", "scored_ts", "blend_ok")


register("score_stream_predictions", f"""SELECT series_id, CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS late_rows,
  CASE WHEN count(temperature) = 0 OR count(humidity) = 0 THEN 'invalid_input' WHEN count(*) < 48 THEN 'insufficient_history'
       WHEN count(*) <= 168 THEN 'missing_lag' ELSE 'scored' END AS status,
  CASE WHEN count(temperature) > 0 AND count(humidity) > 0 AND count(*) > 168 THEN max(ts) END AS scored_ts, TRUE AS blend_ok
FROM {sql_scored_readings()} r GROUP BY series_id""")(q_score_stream_predictions)


def late_deliveries(spark: SparkSession, d: str) -> DataFrame:
    """Six deliveries of the readings: four by time, the series ``view`` one delivery behind the others (its clock is slow,
    none of its rows is late); every eleventh row of the other series comes two deliveries late, every thirteenth comes again
    in the last one, which brings nothing else to most series."""
    r = ST.time_slices(load_readings(spark, d, "event_type").select("series_id", "ts", "arrival_no", P), SLICES)
    slow = F.col("series_id") == "view"
    r = r.withColumn("_slice", F.when(slow, F.col("_slice") + 1).when(F.col("arrival_no") % 11 == 0, F.col("_slice") + 2).otherwise(F.col("_slice")))
    again = r.where(~slow & (F.col("arrival_no") % 13 == 0)).withColumn("_slice", F.lit(5))
    return r.unionByName(again)


def q_score_stream_late(spark: SparkSession, d: str) -> DataFrame:
    """Per series: rows delivered, rows that came out, rows counted as late and as repeated; the last three make up the first."""
    rows = late_deliveries(spark, d)
    out, counts = replayed(spark, rows, "late-stream", slices=6)
    read = rows.groupBy("series_id").agg(F.count("*").alias("n_read"))
    emitted = out.groupBy("series_id").agg(F.count("*").alias("n_out"), F.count_distinct("arrival_no").alias("n_distinct"))
    return (read.join(emitted, "series_id").join(counts, "series_id")
            .select("series_id", "n_read", "n_out", "n_distinct", "n_seen", "late_rows", "repeated_rows",
                    (F.col("n_out") + F.col("late_rows") + F.col("repeated_rows") == F.col("n_read")).alias("all_counted")))


register("score_stream_late", f"""
WITH c AS (SELECT quantile_disc(epoch_us(ts), [0.25, 0.5, 0.75]) AS q FROM events),
s AS (SELECT event_type AS series_id, ts, event_id AS no, (epoch_us(ts) > q[1])::INT + (epoch_us(ts) > q[2])::INT + (epoch_us(ts) > q[3])::INT AS k FROM events, c),
t AS (SELECT series_id, ts, no, CASE WHEN series_id = 'view' THEN k + 1 WHEN no % 11 = 0 THEN k + 2 ELSE k END AS k FROM s),
u AS (SELECT *, FALSE AS again FROM t UNION ALL SELECT series_id, ts, no, 5, TRUE FROM t WHERE series_id <> 'view' AND no % 13 = 0),
w AS (SELECT *, max({{'ts': ts, 'no': no}}) OVER (PARTITION BY series_id ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest,
             row_number() OVER (PARTITION BY series_id, no ORDER BY k) AS copy FROM u),
x AS (SELECT series_id, copy > 1 AS again, copy = 1 AND coalesce(newest >= {{'ts': ts, 'no': no}}, FALSE) AS late FROM w)
SELECT series_id, count(*) AS n_read, count(*) FILTER (NOT late AND NOT again) AS n_out, count(*) FILTER (NOT late AND NOT again) AS n_distinct,
       count(*) FILTER (NOT late AND NOT again) AS n_seen, count(*) FILTER (late) AS late_rows, count(*) FILTER (again) AS repeated_rows, TRUE AS all_counted
FROM x GROUP BY series_id""")(q_score_stream_late)


def q_stacker_time_split(spark: SparkSession, d: str) -> DataFrame:
    """M9 with M10: fit the stacker on each series' older 80 %, report MAE/RMSE
    on the newest 20 % per series."""
    m = M
    f = A.time_split(features_warm(spark, d)).select(
        "series_id", "split", F.col("energy_kwh").alias("y"), F.col("energy_mean_24h").alias("a"),
        F.col("energy_lag_24").alias("b"))
    model = m.train_stacker(f, ["a", "b"], split_col="split")
    b0, (b1, b2) = m.stacker_coefficients(model)
    ev = A.evaluate(model.transform(f.filter(F.col("split") == "validation")), keys=["series_id"])
    return rounded(ev.select("series_id", "n", "mae", "rmse", F.lit(b0).alias("intercept"), F.lit(b1).alias("coef_seq"),
                             F.lit(b2).alias("coef_boost")), ["series_id", "n"],
                   ["mae", "rmse", "intercept", "coef_seq", "coef_boost"])


register("stacker_time_split", f"""
WITH d AS (SELECT series_id, energy_kwh AS y, energy_mean_24h AS a, energy_lag_24 AS b, CASE WHEN row_number() OVER (PARTITION BY series_id ORDER BY ts, arrival_no) - 1 < floor(count(*) OVER (PARTITION BY series_id) * 0.8::DOUBLE) THEN 'train' ELSE 'validation' END AS split FROM {sql_features_warm()} f),
s AS (SELECT *, avg(CASE WHEN split = 'train' THEN y END) OVER () AS my, avg(CASE WHEN split = 'train' THEN a END) OVER () AS ma, avg(CASE WHEN split = 'train' THEN b END) OVER () AS mb,
             var_pop(CASE WHEN split = 'train' THEN a END) OVER () AS vaa, var_pop(CASE WHEN split = 'train' THEN b END) OVER () AS vbb,
             covar_pop(CASE WHEN split = 'train' THEN a END, CASE WHEN split = 'train' THEN b END) OVER () AS cab, covar_pop(CASE WHEN split = 'train' THEN a END, CASE WHEN split = 'train' THEN y END) OVER () AS cay,
             covar_pop(CASE WHEN split = 'train' THEN b END, CASE WHEN split = 'train' THEN y END) OVER () AS cby FROM d),
c AS (SELECT *, (vbb * cay - cab * cby) / (vaa * vbb - cab * cab) AS b1,
             (vaa * cby - cab * cay) / (vaa * vbb - cab * cab) AS b2 FROM s),
k AS (SELECT *, my - b1 * ma - b2 * mb AS b0 FROM c)
SELECT series_id, CAST(count(*) AS BIGINT) AS n, {R('avg(abs(y - (b0 + b1 * a + b2 * b)))')} AS mae,
       {R('sqrt(avg((y - (b0 + b1 * a + b2 * b)) * (y - (b0 + b1 * a + b2 * b))))')} AS rmse,
       {R('any_value(b0)')} AS intercept, {R('any_value(b1)')} AS coef_seq, {R('any_value(b2)')} AS coef_boost
FROM k WHERE split = 'validation' GROUP BY series_id""")(q_stacker_time_split)


# ---- hourly frame and model fits comparable with BASELINE's probe rows ---------------

HOURLY_DBL = ["Power_Consumption", "voltage", "current", "temperature", "humidity"]

register("hourly_readings", f"""SELECT series_id, date_trunc('hour', ts) AS ts, min(arrival_no) AS arrival_no,
  {R('sum(Power_Consumption)')} AS Power_Consumption, {R('avg(voltage)')} AS voltage, {R('avg("current")')} AS "current",
  {R('avg(temperature)')} AS temperature, {R('avg(humidity)')} AS humidity
FROM {sql_readings('constant')} r GROUP BY series_id, date_trunc('hour', ts)""")(
    lambda spark, d: rounded(RD.hourly_readings(load_readings(spark, d, "constant")), ["series_id", "ts", "arrival_no"],
                             HOURLY_DBL))


def hourly_features(spark: SparkSession, d: str) -> DataFrame:
    """Serving features over the one hourly series (a row per clock hour of the data)."""
    return W.serving_features(RD.hourly_readings(load_readings(spark, d, "constant")))


def sql_hourly_features() -> str:
    hourly = f"""(SELECT series_id, date_trunc('hour', ts) AS ts, min(arrival_no) AS arrival_no, sum(Power_Consumption) AS {P},
  avg(temperature) AS temperature, avg(humidity) AS humidity FROM {sql_readings('constant')} r GROUP BY series_id, date_trunc('hour', ts))"""
    lags = ", ".join(f"lag({P}, {k}) {sql_win()} AS energy_lag_{k}" for k in (1, 24, 168))
    return f"""(SELECT series_id, ts, arrival_no, {R(P)} AS energy_kwh FROM (SELECT *, {lags},
  count(temperature) OVER (PARTITION BY series_id) AS nt, count(humidity) OVER (PARTITION BY series_id) AS nh FROM {hourly} h) t
  WHERE energy_lag_1 IS NOT NULL AND energy_lag_24 IS NOT NULL AND energy_lag_168 IS NOT NULL AND nt > 0 AND nh > 0)"""


def q_hourly_fit(spark: SparkSession, d: str, fit) -> DataFrame:
    out = q_tree_fit(spark, d, fit, hourly_features(spark, d))
    return out.withColumn("energy_kwh", r6(F.col("energy_kwh")))


SQL_HOURLY_FIT = f"SELECT *, TRUE AS parts_agree FROM {sql_hourly_features()} f"
# the stored parameters of the forest, and a boosting of BASELINE's probe size
register("train_forest_hourly", SQL_HOURLY_FIT)(lambda spark, d: q_hourly_fit(spark, d, M.train_random_forest))
register("train_gbt_full", SQL_HOURLY_FIT)(lambda spark, d: q_hourly_fit(spark, d, M.train_gbt))  # 100 rounds of depth 10
register("train_gbt_hourly", SQL_HOURLY_FIT)(lambda spark, d: q_hourly_fit(spark, d, lambda f: M.train_gbt(f, maxIter=10, maxDepth=5)))


def q_read_request_bodies(spark: SparkSession, d: str) -> DataFrame:
    """S2 from files: the request bodies written as JSON lines, read back with
    a declared schema, parsed and coerced."""
    path = scratch_path(spark, "requests")
    request_bodies(spark, d).write.mode("overwrite").json(path)
    accepted, _ = RD.parse_reading_batches(RD.read_request_bodies(spark, path))
    return RD.coerce_points(accepted).select(
        "series_id", "arrival_no", F.col("ts").cast("timestamp_ntz").alias("ts"),
        "Power_Consumption", "voltage", "current", "temperature", "humidity")


register("read_request_bodies", SQL_PARSED_POINTS)(q_read_request_bodies)

# one hot series (all 'view' events) among per-user series: the auto plan sends
# the hot one through chunk+halo and the rest through the plain window
register("serving_features_skewed", sql_feature_projection(sql_serving_features("skewed"), WARMUP))(
    lambda spark, d: spark_feature_projection(
        W.serving_features(load_readings(spark, d, "skewed"), hot_rows=1000, chunk_rows=512)))


def q_series_gate(spark: SparkSession, d: str) -> DataFrame:
    """The scorer's gate (validate → pad → gate in one aggregate) over long and
    short series together."""
    readings = load_readings(spark, d, "event_type").unionByName(load_readings(spark, d, "user_event"))
    return C.series_gate(readings)


register("series_gate", sql_status(f"""(SELECT * FROM {sql_padded('event_type')} a
  UNION ALL SELECT * FROM {sql_padded('user_event')} b)""", ALL_NULL_CHECK))(q_series_gate)


def form_requests(spark: SparkSession, d: str) -> DataFrame:
    """One form request per event: its long reading list (an ``Infinity`` at
    the end when k % 9 = 0), sent at the event's time from its user's location."""
    k = k_col()
    text = F.when(k % 9 == 0, F.concat(long_list_text(), F.lit(",Infinity"))).otherwise(long_list_text())
    return events(spark, d).select(F.col("event_id").alias("request_id"), text.alias("text"),
                                   F.col("ts").alias("as_of"), WX.location_of_user(F.col("user_id")).alias("location"))


def q_form_request_status(spark: SparkSession, d: str) -> DataFrame:
    """SURVEY 3.3 end to end up to the gate: every request the form lets
    through carries exactly 24 points, so none survives warm-up (B1)."""
    pts, errors = J.form_request_points(form_requests(spark, d), weather(spark, d))
    gate = C.series_gate(pts.drop("location", "weather_description", "location_name", "obs_ts", "wind_speed"))
    return (gate.select(F.col("series_id").cast("long").alias("request_id"), "n_rows", "status")
            .unionByName(errors.select("request_id", F.lit(None).cast("long").alias("n_rows"), "status")))


register("form_request_status", f"""
SELECT event_id AS request_id,
       CASE WHEN len(l) >= 24 THEN CAST(24 AS BIGINT) END AS n_rows,
       CASE WHEN len(l) < 24 THEN 'form_error'
            WHEN len(list_filter(l[len(l) - 23:], lambda x: isinf(x))) > 0 THEN 'invalid_input'
            ELSE 'insufficient_history' END AS status
FROM (SELECT event_id, {sql_parse_list("CASE WHEN k % 9 = 0 THEN (" + SQL_LONG_LIST + ") || ',Infinity' ELSE " + SQL_LONG_LIST + " END")} AS l
      FROM {SQL_EVENTS_K} e) t""")(q_form_request_status)


def q_score_stream_table_state(spark: SparkSession, d: str) -> DataFrame:
    """The same stream with every series hot: each one is chunked inside the micro-batch."""
    r = load_readings(spark, d, "event_type").select("series_id", "ts", "arrival_no", P)
    out, _ = replayed(spark, r, "hot-stream", hot_rows=500, chunk_rows=512)
    return rounded(out, KEYCOLS + STREAM_RAW, STREAM_DBL)


register("score_stream_table_state", ORACLE_SQL["score_stream"])(q_score_stream_table_state)


def q_request_status(spark: SparkSession, d: str) -> DataFrame:
    """The prediction endpoint over a table of request bodies, up to the gate:
    S2 parse → P4 coerce → J4 pad → P6/P12 gate, one status per request;
    rejected bodies keep their reason."""
    accepted, rejected = RD.parse_reading_batches(request_bodies(spark, d))
    points = RD.coerce_points(accepted)
    gate = C.series_gate(points)
    return (gate.select(F.col("series_id").cast("long").alias("request_id"), "n_rows", "status")
            .unionByName(rejected.select("request_id", F.lit(None).cast("long").alias("n_rows"),
                                         F.col("reason").alias("status"))))


register("request_status", f"""
SELECT event_id AS request_id,
       CASE WHEN k % 10 >= 5 THEN CAST(24 AS BIGINT) END AS n_rows,
       CASE WHEN k % 20 = 12 THEN 'invalid_json' WHEN k % 10 = 0 THEN 'null_body' WHEN k % 10 <= 2 THEN 'not_an_array'
            WHEN k % 10 = 3 THEN 'empty_array' WHEN k % 10 = 4 THEN 'invalid_json'
                   ELSE CASE WHEN k % 7 = 0 OR k % 9 = 0 THEN 'invalid_input' ELSE 'insufficient_history' END END AS status
FROM {SQL_EVENTS_K} e""")(q_request_status)


# ---- request body to prediction ------------------------------------------------------------------

REQUEST_SIZES = (1, 47, 48, 168, 169)
SQL_REQUEST_OF = f"""(SELECT *, (n // {sum(REQUEST_SIZES)}) * {len(REQUEST_SIZES)} + CASE {' '.join(
    f'WHEN n % {sum(REQUEST_SIZES)} < {sum(REQUEST_SIZES[:i + 1])} THEN {i}' for i in range(len(REQUEST_SIZES)))} END AS request_id
  FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) - 1 AS n FROM {SQL_EVENTS_K} e) t)"""


def sized_bodies(spark: SparkSession, d: str) -> DataFrame:
    """All events as request bodies of 1, 47, 48, 168 and 169 points in turn (at most 169 points are gathered for one);
    a request whose number is divisible by 7 has a value that is not a number."""
    e = events(spark, d).select(F.lit("all").alias("series_id"), "ts", F.col("event_id").alias("arrival_no"), "value", k_col().alias("k"))
    cycle = sum(REQUEST_SIZES)
    numbered = series_row_number(e, ["series_id"], strategy="chunked", col="n")
    at = F.col("n") % cycle
    part = F.when(at < REQUEST_SIZES[0], 0)
    for i in range(1, len(REQUEST_SIZES)):
        part = part.when(at < sum(REQUEST_SIZES[:i + 1]), i)
    numbered = numbered.withColumn("request_id", (F.floor(F.col("n") / cycle) * len(REQUEST_SIZES) + part).cast("long"))
    broken = (F.col("request_id") % 7 == 0) & (F.col("k") >= 0)
    point = F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"), F.format_string("%.2f", "value").alias("Power_Consumption"),
                     F.when(broken, F.lit("12d")).otherwise(F.lit("230")).alias("voltage"), F.lit(10).alias("current"),
                     (F.lit(10) + F.col("k") % 20).alias("temperature"), (F.lit(30) + F.col("k") % 50).alias("humidity"))
    bodies = numbered.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("n", point.alias("p")))).alias("ps"))
    return bodies.select("request_id", F.to_json(F.transform("ps", lambda x: x["p"])).alias("body"))


def q_score_requests(spark: SparkSession, d: str) -> DataFrame:
    """The endpoint from body to number: S2 parse → P4 coerce → J4/P12 gate → M12 score, one row per request."""
    models = SC.fit_forecast_models(tree_frame(spark, d), rf_params=SMALL_RF, gbt_params=SMALL_GBT)
    accepted, _ = RD.parse_reading_batches(sized_bodies(spark, d))
    points = RD.coerce_points(accepted).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    out = with_blend_flag(SC.score_series(points, models, mode="reject"))
    return out.select(F.col("series_id").cast("long").alias("request_id"), "n_rows", "status", "scored_ts", "blend_ok")


register("score_requests", f"""SELECT request_id, n_rows, status, CASE WHEN status = 'scored' THEN newest END AS scored_ts, TRUE AS blend_ok FROM (
  SELECT request_id, CAST(greatest(count(*), 24) AS BIGINT) AS n_rows, max(ts) AS newest,
         CASE WHEN request_id % 7 = 0 THEN 'invalid_input' WHEN count(*) < 48 THEN 'insufficient_history'
              WHEN count(*) <= 168 THEN 'missing_lag' ELSE 'scored' END AS status
  FROM {SQL_REQUEST_OF} r GROUP BY request_id) t""")(q_score_requests)
