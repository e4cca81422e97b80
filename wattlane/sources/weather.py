"""Weather observations as a table (S6) and the weather-code lookup (J1 data).

Current conditions enter as rows of ``location, ts, obs_id, temp, humidity,
wind_speed, weather_code, city, town, village``; no HTTP client is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattlane.config import WEATHER_CODES, WEATHER_UNKNOWN

WEATHER_SCHEMA = T.StructType([
    T.StructField("location", T.StringType(), True),
    T.StructField("ts", T.TimestampType(), True),
    T.StructField("obs_id", T.LongType(), True),
    T.StructField("temp", T.DoubleType(), True),
    T.StructField("humidity", T.DoubleType(), True),
    T.StructField("wind_speed", T.DoubleType(), True),
    T.StructField("weather_code", T.IntegerType(), True),
    T.StructField("city", T.StringType(), True),
    T.StructField("town", T.StringType(), True),
    T.StructField("village", T.StringType(), True),
])

LOCATIONS = 7  # adapter parameter: locations are user_id modulo this


def location_of_user(user_id: Column) -> Column:
    return F.concat(F.lit("loc_"), (user_id % LOCATIONS).cast("string"))


def weather_from_events(events: DataFrame) -> DataFrame:
    """Adapter: every event is also an observation at ``loc_<user_id % 7>``.
    Zero temperatures/humidities and empty names occur on purpose."""
    k = F.get_json_object("props", "$.k").cast("int")
    u = F.col("user_id")
    city = (F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 4 == 1, F.lit(""))
            .otherwise(F.concat(F.lit("City "), (u % LOCATIONS).cast("string"))))
    town = F.when(k % 3 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("Town "), (u % 5).cast("string")))
    village = F.when(k % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("Village "), u.cast("string")))
    return events.select(
        location_of_user(u).alias("location"),
        F.col("ts"),
        F.col("event_id").alias("obs_id"),
        ((k - F.lit(20)).cast("double") / F.lit(2.0)).alias("temp"),
        ((k * 3) % 101).cast("double").alias("humidity"),
        ((F.col("event_id") % 13).cast("double") / F.lit(2.0)).alias("wind_speed"),
        k.alias("weather_code"),
        city.alias("city"), town.alias("town"), village.alias("village"),
    )


def read_weather(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Read an observation table with the declared schema."""
    reader = spark.read.format(fmt)
    if fmt != "parquet":
        reader = reader.schema(WEATHER_SCHEMA)
    return reader.load(path)


def weather_code_map() -> Column:
    """The 24-entry code → description map as a literal (no join, stays in codegen)."""
    items = []
    for code, text in WEATHER_CODES.items():
        items += [F.lit(code), F.lit(text)]
    return F.create_map(*items)


def weather_code_table(spark: SparkSession) -> DataFrame:
    """The same lookup as a 24-row table, for a broadcast join."""
    return spark.createDataFrame(list(WEATHER_CODES.items()), "weather_code INT, description STRING")


def describe_weather_code(code: Column) -> Column:
    return F.coalesce(F.try_element_at(weather_code_map(), code.cast("int")), F.lit(WEATHER_UNKNOWN))
