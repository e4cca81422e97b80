"""Calendar, flag and cyclic columns (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattlane.config import BUSINESS_HOURS, PEAK_HOURS, PI_APPROX, WEEKEND_DAYS


def calendar_columns(ts: str = "ts") -> list[Column]:
    """Hour, day_of_week (Monday = 0), day_of_month, month, quarter, year,
    ISO week of year."""
    t = F.col(ts)
    return [
        F.hour(t).alias("hour"),
        F.weekday(t).alias("day_of_week"),
        F.dayofmonth(t).alias("day_of_month"),
        F.month(t).alias("month"),
        F.quarter(t).alias("quarter"),
        F.year(t).alias("year"),
        F.weekofyear(t).alias("week_of_year"),
    ]


def dow_sunday1(ts: str = "ts") -> Column:
    """Day of week with Sunday = 1."""
    return F.dayofweek(F.col(ts))


def flag_columns(hour: str = "hour", day_of_week: str = "day_of_week") -> list[Column]:
    """Weekend, business hours (9..17) and peak hours (17..21) as 0/1 INT."""
    h = F.col(hour)
    return [
        F.col(day_of_week).isin(*WEEKEND_DAYS).cast("int").alias("is_weekend"),
        h.between(*BUSINESS_HOURS).cast("int").alias("is_business_hours"),
        h.between(*PEAK_HOURS).cast("int").alias("is_peak_hours"),
    ]


def cyclic_hour(hour: str = "hour", pi: float = PI_APPROX) -> list[Column]:
    """T4: sin/cos of ``hour * 2 * pi / 24`` evaluated left to right."""
    angle = F.col(hour) * F.lit(2) * F.lit(pi) / F.lit(24)
    return [F.sin(angle).alias("sin_hour"), F.cos(angle).alias("cos_hour")]


def weather_interactions(temperature: str = "temperature", humidity: str = "humidity",
                         hour: str = "hour") -> list[Column]:
    """T5: temperature × hour and humidity × temperature."""
    return [
        (F.col(temperature) * F.col(hour)).alias("temp_hour_interaction"),
        (F.col(humidity) * F.col(temperature)).alias("humidity_temp_interaction"),
    ]
