"""Fixed values.

These constants must equal the behaviour being reproduced (sequence
length, lags, frames, defaults, flag hours, feature orders, stored model
parameters, blend weights and the weather-code descriptions).  They are
kept together, in natural order, as plain text.
"""

from __future__ import annotations

# ---- fixed values -----------------------------------------------------------
SEQUENCE_LENGTH = 24
ENERGY_LAGS = (1, 2, 3, 24, 48, 168)
SHORT_FRAME = 24            # rows in the "24h" rolling frame (current row included)
LONG_FRAME = 168            # rows in the "7d" rolling frame (current row included)
ROLLING_BLOCK = 6           # rows in the blocks the 24-row states are merged from (a plan parameter; 24 is a multiple)
BLOCK_WINDOWS = 1024        # windows in one block of sequence_blocks (a plan parameter)
TRAINING_LAGS = (1, 24)
ROLLING_3H_PRECEDING = 3    # frame rowsBetween(-3, 0): four rows
VALUE_LAGS = (1, 2, 3)
VALUE_ROLLING = (3, 5)      # strict means: null until full, null if any null inside

POWER_DEFAULT = 0.0
VOLTAGE_DEFAULT = 230.0
CURRENT_DEFAULT = 10.0
TEMPERATURE_DEFAULT = 20.0
HUMIDITY_DEFAULT = 50.0

WEEKEND_DAYS = (5, 6)       # Monday = 0
BUSINESS_HOURS = (9, 17)    # inclusive
PEAK_HOURS = (17, 21)       # inclusive
PI_APPROX = 3.14159         # the literal used for the cyclic hour, not math.pi

MIN_FEATURE_ROWS = 24       # rows needed after warm-up rows are dropped

SEQUENCE_FEATURES = [
    "energy_kwh", "temperature", "humidity",
    "hour", "day_of_week", "is_weekend", "is_peak_hours",
    "energy_lag_1", "energy_lag_24", "energy_mean_24h",
]

TREE_FEATURES = [
    "hour", "day_of_week", "month", "is_weekend", "is_peak_hours",
    "temperature", "humidity", "temp_hour_interaction",
    "energy_lag_1", "energy_lag_24", "energy_lag_168",
    "energy_mean_24h", "energy_std_24h", "energy_mean_7d",
]

BOOST_FEATURES = ["lag_1", "lag_24", "hour", "dow", "sin_hour", "cos_hour"]

RF_PARAMS = {"numTrees": 200, "maxDepth": 15, "minInstancesPerNode": 5, "seed": 42}
GBT_PARAMS = {"maxIter": 100, "maxDepth": 10, "stepSize": 0.1, "seed": 42}
BOOST_PARAMS = {"maxIter": 500, "stepSize": 0.05, "maxDepth": 6}
LABEL = "energy_kwh"

ENSEMBLE_WEIGHTS = {"sequence": 0.5, "rf": 0.25, "gbt": 0.25}

VALIDATION_FRACTION = 0.2

WEATHER_CODES = {
    0: "Clear sky",
    1: "Mainly clear",
    2: "Partly cloudy",
    3: "Overcast",
    45: "Foggy",
    48: "Depositing rime fog",
    51: "Light drizzle",
    53: "Moderate drizzle",
    55: "Dense drizzle",
    61: "Slight rain",
    63: "Moderate rain",
    65: "Heavy rain",
    71: "Slight snow",
    73: "Moderate snow",
    75: "Heavy snow",
    77: "Snow grains",
    80: "Slight rain showers",
    81: "Moderate rain showers",
    82: "Violent rain showers",
    85: "Slight snow showers",
    86: "Heavy snow showers",
    95: "Thunderstorm",
    96: "Thunderstorm with slight hail",
    99: "Thunderstorm with heavy hail",
}
WEATHER_UNKNOWN = "Unknown"
LOCATION_UNKNOWN = "Unknown Location"
# ---- end of fixed values ----------------------------------------------------

# Engine parameters (ours, not the reference's).
HOT_SERIES_ROWS = 1 << 17       # a series above this is split into chunks with a halo
CHUNK_ROWS = 1 << 17            # rows per chunk in the chunk+halo plan: what one task sorts and windows at once
SERIES_BUCKETS = 1 << 11        # groups of the streaming state: each holds its series' newest rows; more for over some 20 M series
BROADCAST_KEYS_LIMIT = 1_000_000  # largest measured key set that is broadcast
RANGE_PARTITION_ROWS = 1 << 19  # target rows per task when numbering and when windowing chunks
