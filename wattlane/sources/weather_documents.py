"""Stored weather documents as observation rows.

Answers of a current-conditions service and of a reverse-geocoding service,
kept as JSON lines, each under the key of the request it answers:

    {"kind": "conditions", "location": "loc_3", "obs_id": 17, "at": "2024-01-05T10:00:00", "status": 200,
     "body": {"current": {"temperature_2m": 3.5, "relative_humidity_2m": 81, "wind_speed_10m": 4, "weather_code": 61}}}
    {"kind": "place", "location": "loc_3", "obs_id": 17, "at": "2024-01-05T10:00:00", "status": 200,
     "body": {"address": {"town": "Ely"}}}

Files are read by Spark's text source, so they may lie in any store that Spark
reads and large ones are split; a stream follows the same folder.  A line is
parsed by itself (``parse_documents``): it is a record, or it has a ``reason``
to be set aside.  Both kinds of a request meet in one aggregate by
``(location, obs_id)``, which also takes the newest of repeated deliveries:
one shuffle, no join (``observations``).

* A line that is not one whole JSON object is ``invalid_json``; a line without
  kind, location, number or time is ``no_key``; an answer with another status
  than 2xx, or without a body, is ``failed``.  Blank lines are no documents.
* A field that is missing or of another type is NULL, and the observation stays.
* Conditions without a place keep NULL names; a place alone is no observation.
* Ties in time go to the greater values, so a result does not depend on files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattlane.functions.numeric import coerce_numeric
from wattlane.functions.text import one_json_value, parse_timestamp
from wattlane.sources.weather import WEATHER_SCHEMA

CONDITIONS, PLACE = "conditions", "place"
#: Every leaf is text first: a number, or a number as text, becomes DOUBLE, anything else NULL.
DOCUMENT_SCHEMA = """
    kind STRING, location STRING, obs_id STRING, at STRING, status STRING,
    body STRUCT<current: STRUCT<temperature_2m: STRING, relative_humidity_2m: STRING, wind_speed_10m: STRING, weather_code: STRING>,
                address: STRUCT<city: STRING, town: STRING, village: STRING>>"""
MEASURES = {"temp": "temperature_2m", "humidity": "relative_humidity_2m", "wind_speed": "wind_speed_10m"}
NAMES = ["city", "town", "village"]
KEY = ["location", "obs_id"]


def _code(text: Column) -> Column:
    number = coerce_numeric(text)
    return F.when(number == F.floor(number), number.cast("int"))


def parse_documents(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """``kind, location, obs_id, ts``, the measures, the names, ``reason`` and,
    where there is a reason, the ``line`` itself: one row per line that is not blank."""
    line = F.col(line_col)
    doc = F.from_json(line, DOCUMENT_SCHEMA)
    whole = line.rlike(r"^\s*\{") & one_json_value(line) & doc.isNotNull()
    raw = lines.where(F.length(F.trim(line)) > 0).select(line.alias("line"), whole.alias("_whole"), doc.alias("_d"))
    status = F.expr("try_cast(_d.status AS INT)")
    current, address = F.col("_d.body.current"), F.col("_d.body.address")
    parsed = raw.select(
        "line", "_whole", F.col("_d.kind").alias("kind"), F.col("_d.location").alias("location"),
        F.expr("try_cast(_d.obs_id AS BIGINT)").alias("obs_id"), parse_timestamp(F.col("_d.at")).alias("ts"),
        (F.coalesce(status.between(200, 299), F.lit(False)) & F.col("_d.body").isNotNull()).alias("_answered"),
        *[coerce_numeric(current[f]).alias(c) for c, f in MEASURES.items()], _code(current["weather_code"]).alias("weather_code"),
        *[address[n].alias(n) for n in NAMES])
    keyed = F.coalesce(F.col("kind").isin(CONDITIONS, PLACE), F.lit(False)) & F.col("location").isNotNull() & F.col("obs_id").isNotNull() & F.col("ts").isNotNull()
    reason = (F.when(~F.coalesce(F.col("_whole"), F.lit(False)), F.lit("invalid_json"))
              .when(~keyed, F.lit("no_key")).when(~F.col("_answered"), F.lit("failed")))
    out = parsed.withColumn("reason", reason)
    return out.select("kind", *KEY, "ts", *MEASURES, "weather_code", *NAMES, "reason", F.when(F.col("reason").isNotNull(), F.col("line")).alias("line"))


def read_weather_documents(spark: SparkSession, path: str) -> DataFrame:
    """Parsed lines of a folder of documents."""
    return parse_documents(spark.read.text(path))


def quarantined(documents: DataFrame) -> DataFrame:
    """(reason, line) of the lines that were set aside."""
    return documents.where(F.col("reason").isNotNull()).select("reason", "line")


def observations(documents: DataFrame) -> DataFrame:
    """Parsed lines → observation rows (``WEATHER_SCHEMA``), one per answered request."""
    measured, named = ["ts", *MEASURES, "weather_code"], ["ts", *NAMES]
    met = documents.where(F.col("reason").isNull()).groupBy(*KEY).agg(
        F.max(F.when(F.col("kind") == CONDITIONS, F.struct(*measured))).alias("_c"),
        F.max(F.when(F.col("kind") == PLACE, F.struct(*named))).alias("_p"))
    columns = {**{c: F.col(c) for c in KEY}, **{c: F.col(f"_c.{c}") for c in measured}, **{n: F.col(f"_p.{n}") for n in NAMES}}
    return met.where(F.col("_c").isNotNull()).select(*[columns[f.name].alias(f.name) for f in WEATHER_SCHEMA])


def follow_weather_documents(spark: SparkSession, path: str, out: str, checkpoint: str, max_files: int = 1000) -> StreamingQuery:
    """Take in what is new in the folder since the last run, and stop.

    Parsed lines are appended to the Parquet table ``out`` by Spark's file
    source and file sink, whose logs count every file once, also after a
    restart.  ``observations(spark.read.parquet(out))`` is then the table; as
    it takes the newest delivery of a request, a place may come in any run.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return (parse_documents(lines).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
