"""Reading tables: declared schema, CSV files, JSON request batches and the
adapter from the driver's ``events`` table.

A reading table is ``series_id, ts, arrival_no, Power_Consumption, voltage,
current, temperature, humidity``.  ``(series_id, ts, arrival_no)`` is the
total order used by every positional operator.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlane.functions.numeric import coerce_numeric
from wattlane.operators.clean import require_columns
from wattlane.functions.text import one_json_value, parse_timestamp

TS_TEXT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # keep microseconds in text files
MEASURES = ["Power_Consumption", "voltage", "current", "temperature", "humidity"]

# S3: the declared six-field schema of one reading
READINGS_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType(), True),
    T.StructField("Power_Consumption", T.DoubleType(), True),
    T.StructField("voltage", T.DoubleType(), True),
    T.StructField("current", T.DoubleType(), True),
    T.StructField("temperature", T.DoubleType(), True),
    T.StructField("humidity", T.DoubleType(), True),
])

# A request point: every value read as text and coerced later, since values
# may arrive as numbers or as numeric strings.
POINT_SCHEMA = T.ArrayType(T.StructType([
    T.StructField(f.name, T.StringType(), True) for f in READINGS_SCHEMA.fields
]))


def readings_schema() -> T.StructType:
    return READINGS_SCHEMA


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def series_key_expr(series_key: str) -> Column:
    if series_key == "event_type":
        return F.col("event_type")
    if series_key == "user_id":
        return F.col("user_id").cast("string")
    if series_key == "user_event":
        return F.concat_ws(":", F.col("user_id").cast("string"), F.col("event_type"))
    if series_key == "constant":
        return F.lit("all")
    if series_key == "skewed":  # every 'view' event in one hot series, the rest per user
        return F.when(F.col("event_type") == "view", F.lit("hot")).otherwise(F.col("user_id").cast("string"))
    raise ValueError(f"unknown series key {series_key!r}")


def readings_from_events(events: DataFrame, series_key: str = "event_type") -> DataFrame:
    """Adapter from ``events`` to the reading table (see FIXTURES.md §2).

    Every derived measure is computed in DOUBLE so the same expression in
    another engine gives identical bits.
    """
    k = F.get_json_object("props", "$.k").cast("int")
    kd = k.cast("double")
    temperature = F.when(k % 10 == 0, F.lit(None).cast("double")).otherwise(
        F.lit(10.0) + kd / F.lit(5.0))
    humidity = F.when(k % 17 == 0, F.lit(None).cast("double")).otherwise(
        F.lit(30.0) + (k % 50).cast("double"))
    return events.select(
        series_key_expr(series_key).alias("series_id"),
        F.col("ts"),
        F.col("event_id").alias("arrival_no"),
        F.col("value").cast("double").alias("Power_Consumption"),
        (F.lit(225.0) + (F.col("event_id") % 11).cast("double")).alias("voltage"),
        (F.lit(5.0) + (F.col("event_id") % 13).cast("double") / F.lit(2.0)).alias("current"),
        temperature.alias("temperature"),
        humidity.alias("humidity"),
    )


def load_readings(spark: SparkSession, sf_dir: str, series_key: str = "event_type") -> DataFrame:
    return readings_from_events(read_table(spark, sf_dir, "events"), series_key)


def hourly_readings(readings: DataFrame) -> DataFrame:
    """One row per series and clock hour: summed power, mean weather.  The
    stamp keeps the input's timestamp type (``date_trunc`` alone would turn a
    TIMESTAMP_NTZ into a TIMESTAMP)."""
    hour = F.date_trunc("hour", "ts").cast(readings.schema["ts"].dataType)
    return (readings.groupBy("series_id", hour.alias("ts"))
            .agg(F.sum("Power_Consumption").alias("Power_Consumption"),
                 F.avg("voltage").alias("voltage"),
                 F.avg("current").alias("current"),
                 F.avg("temperature").alias("temperature"),
                 F.avg("humidity").alias("humidity"),
                 F.min("arrival_no").alias("arrival_no")))


# ---- S1 -----------------------------------------------------------------------

def read_readings_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                      infer_schema: bool = False, timestamp_col: str = "timestamp") -> DataFrame:
    """CSV with a header row.  Declared columns are found by their header name
    (not by position) and read as text, then cast to their type (bad → NULL); a
    file whose header differs from the first file's raises.  Columns the schema
    does not name are left out, a missing one is an error.  The inference option
    is kept for files whose columns are unknown."""
    reader = (spark.read.option("header", True).option("mode", "PERMISSIVE")
              .option("timestampNTZFormat", TS_TEXT).option("timestampFormat", TS_TEXT))
    if schema is not None:
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        header = reader.csv(path).columns
        require_columns(header, [f.name for f in fields])
        text = T.StructType([T.StructField(c, T.StringType(), True) for c in header])
        raw = reader.option("enforceSchema", False).schema(text).csv(path)
        df = raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields])
    else:
        df = reader.option("inferSchema", infer_schema).csv(path)
    if timestamp_col in df.columns and not isinstance(
            df.schema[timestamp_col].dataType, (T.TimestampType, T.TimestampNTZType)):
        df = df.withColumn(timestamp_col, parse_timestamp(F.col(timestamp_col)))
    return df


def write_readings_csv(df: DataFrame, path: str) -> None:
    (df.write.mode("overwrite").option("header", True)
     .option("timestampNTZFormat", TS_TEXT).option("timestampFormat", TS_TEXT).csv(path))


# ---- S2 -----------------------------------------------------------------------

def parse_reading_batches(bodies: DataFrame, body_col: str = "body",
                          request_col: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """JSON request bodies → one row per point, plus a frame of rejected bodies.

    A body is accepted only when it is a non-empty JSON array, with white space
    around it at most: a lone object, junk (also behind an array), null and ``[]``
    are rejected with a reason.  The position in the
    array becomes ``arrival_no``.  Values stay text until ``coerce_points``.
    """
    body = F.col(body_col)
    parsed = F.from_json(body, POINT_SCHEMA)
    is_array = body.rlike(r"^\s*\[")
    whole = one_json_value(body)
    reason = (F.when(body.isNull(), F.lit("null_body"))
              .when(~is_array, F.lit("not_an_array"))
              .when(parsed.isNull() | ~whole, F.lit("invalid_json"))
              .when(F.size(parsed) == 0, F.lit("empty_array")))
    tagged = bodies.select(F.col(request_col), body, parsed.alias("_points"), reason.alias("reason"))
    rejected = tagged.filter(F.col("reason").isNotNull()).select(request_col, body_col, "reason")
    accepted = (tagged.filter(F.col("reason").isNull())
                .select(F.col(request_col), F.posexplode("_points").alias("arrival_no", "_p"))
                .select(F.col(request_col).cast("string").alias("series_id"),
                        F.col("arrival_no").cast("long").alias("arrival_no"),
                        F.col("_p.timestamp").alias("timestamp"),
                        *[F.col(f"_p.{m}").alias(m) for m in MEASURES]))
    return accepted, rejected


def read_request_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Request bodies stored as JSON lines ``{"request_id": …, "body": "<json text>"}``."""
    return spark.read.schema("request_id BIGINT, body STRING").json(path)


def coerce_points(points: DataFrame) -> DataFrame:
    """Text point values → TIMESTAMP ``ts`` and DOUBLE measures (bad → NULL)."""
    cols = [c for c in points.columns if c not in MEASURES and c != "timestamp"]
    return points.select(
        *cols,
        parse_timestamp(F.col("timestamp")).alias("ts"),
        *[coerce_numeric(F.col(m)).alias(m) for m in MEASURES],
    )
