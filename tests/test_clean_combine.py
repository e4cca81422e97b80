from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import frame, hourly
from wattlane.operators import clean as C
from wattlane.operators.combine import (attach_current_weather, decode_weather_code,
                                        pad_short_series)


def test_impute_mean_zero_all_null_and_some_null(spark):
    t = datetime(2024, 1, 1)
    rows = []
    zero_mean = [None, 1.0, -1.0, 2.0, -2.0, 3.0, -3.0, 0.5, -0.5, 0.0]
    for i, v in enumerate(zero_mean):  # mean of temperature is exactly 0 → default 20 (B4)
        rows.append(("mean_zero", t + timedelta(hours=i), i, v, 230.0, 10.0, v, 50.0))
    for i in range(10):  # all NULL stays NULL
        rows.append(("all_null", t + timedelta(hours=i), 100 + i, 1.0, 230.0, 10.0, None, None))
    for i in range(10):
        rows.append(("some_null", t + timedelta(hours=i), 200 + i, 1.0, 230.0, 10.0,
                     None if i < 2 else float(i), 40.0))
    df = frame(spark, rows)
    out = {r["arrival_no"]: r for r in C.impute_mean_or_default(df).collect()}
    assert out[0]["temperature"] == 20.0 and out[0]["Power_Consumption"] == 0.0
    assert out[100]["temperature"] is None and out[100]["humidity"] is None
    assert out[200]["temperature"] == sum(range(2, 10)) / 8
    filled = {r["arrival_no"]: r for r in C.impute_mean_or_default(df, all_null_default=True).collect()}
    assert filled[100]["temperature"] == 20.0 and filled[100]["humidity"] == 50.0


def test_reject_whole_series_with_one_null(spark):
    rows = hourly(spark, 30, series="bad") + hourly(spark, 30, series="good", arrival_base=100)
    rows[5] = rows[5][:6] + (None,) + rows[5][7:]
    valid, quarantine = C.reject_series_with_nulls(frame(spark, rows))
    assert {r["series_id"] for r in valid.collect()} == {"good"}
    assert quarantine.count() == 30


def test_require_columns_fails_before_any_job(spark):
    df = frame(spark, hourly(spark, 3))
    with pytest.raises(ValueError, match="the frame lacks"):
        C.select_sequence_features(df)


@pytest.mark.parametrize("n,status", [(47, "insufficient_history"), (48, "missing_lag"),
                                      (168, "missing_lag"), (169, "scored")])
def test_history_status_thresholds(spark, n, status):
    out = C.history_status(frame(spark, hourly(spark, n))).first()
    assert out["status"] == status and out["n_rows"] == n


def test_history_status_invalid_input(spark):
    rows = hourly(spark, 200)
    rows[3] = rows[3][:3] + (None,) + rows[3][4:]
    assert C.history_status(frame(spark, rows)).first()["status"] == "invalid_input"


def test_null_profile_long_form(spark):
    rows = hourly(spark, 5)
    rows[1] = rows[1][:6] + (None,) + rows[1][7:]
    out = {r["column"]: r["null_count"] for r in C.null_profile(frame(spark, rows), ["temperature", "humidity"]).collect()}
    assert out == {"temperature": 1, "humidity": 0}


@pytest.mark.parametrize("n", [1, 23, 24, 30])
def test_padding_to_24(spark, n):
    out = pad_short_series(frame(spark, hourly(spark, n, power=lambda i: 7.0 + i)))
    rows = out.collect()
    assert len(rows) == max(n, 24)
    pads = [r for r in rows if r["is_padding"]]
    assert len(pads) == max(24 - n, 0)
    if pads:
        first = datetime(2024, 1, 1)
        assert sorted(r["ts"] for r in pads) == [first - timedelta(hours=i) for i in range(24 - n, 0, -1)]
        assert {r["Power_Consumption"] for r in pads} == {7.0}


def test_padding_source_is_first_arrival_and_defaults(spark):
    t = datetime(2024, 1, 1, 12)
    rows = [("s", t + timedelta(hours=3), 0, 4.0, None, 10.0, 20.0, 50.0),   # first arrival, not earliest
            ("s", t, 1, 1.0, 230.0, 10.0, 20.0, 50.0),
            ("s", t + timedelta(hours=1), 2, 2.0, 230.0, 10.0, 20.0, 50.0)]
    pads = pad_short_series(frame(spark, rows)).filter("is_padding").collect()
    assert len(pads) == 21
    assert {r["Power_Consumption"] for r in pads} == {4.0}
    assert {r["voltage"] for r in pads} == {230.0}         # absent value → default
    assert max(r["ts"] for r in pads) == t + timedelta(hours=2)
    assert all(r["arrival_no"] < 0 for r in pads)


def test_weather_code_and_current_weather(spark):
    obs = spark.createDataFrame([
        ("L1", datetime(2024, 1, 1, 0), 1, 0.0, 0.0, 3.0, 61, "", None, "V"),
        ("L1", datetime(2024, 1, 1, 5), 2, 12.5, 40.0, 2.0, 999, None, "Town", "V"),
        ("L2", datetime(2024, 1, 1, 1), 3, 0.0, 0.0, 1.0, 0, "City", "T", "V"),
    ], "location STRING, ts TIMESTAMP_NTZ, obs_id BIGINT, temp DOUBLE, humidity DOUBLE, wind_speed DOUBLE, "
       "weather_code INT, city STRING, town STRING, village STRING")
    dec = {r["obs_id"]: r["description"] for r in decode_weather_code(obs).collect()}
    assert dec == {1: "Slight rain", 2: "Unknown", 3: "Clear sky"}
    dec_join = {r["obs_id"]: r["description"] for r in decode_weather_code(obs, use_join=True).collect()}
    assert dec_join == dec
    readings = frame(spark, hourly(spark, 2)).withColumn("location", F.lit("L1")).unionByName(
        frame(spark, hourly(spark, 1, series="t", arrival_base=10)).withColumn("location", F.lit("L2")))
    out = {r["series_id"]: r for r in attach_current_weather(readings, obs).collect()}
    assert out["s"]["temperature"] == 12.5 and out["s"]["humidity"] == 40.0
    assert out["s"]["location_name"] == "Town" and out["s"]["weather_description"] == "Unknown"
    assert out["t"]["temperature"] == 20.0 and out["t"]["humidity"] == 50.0  # zero counts as missing (B15)
    assert out["t"]["location_name"] == "City"


def test_series_gate_equals_gate_over_padding(spark):
    from wattlane.operators.combine import pad_short_series
    rows = []
    for n, s in ((1, "n1"), (23, "n23"), (30, "n30"), (47, "n47"), (48, "n48"), (169, "n169")):
        rows += hourly(spark, n, series=s, arrival_base=len(rows) * 10)
    bad = hourly(spark, 5, series="bad", arrival_base=99999)
    bad[2] = bad[2][:3] + (None,) + bad[2][4:]
    df = frame(spark, rows + bad)
    a = {r["series_id"]: tuple(r) for r in C.series_gate(df).collect()}
    b = {r["series_id"]: tuple(r) for r in C.history_status(pad_short_series(df).drop("is_padding")).collect()}
    assert a == b
    assert a["n1"][1:] == (24, 0, "insufficient_history") and a["bad"][3] == "invalid_input"


def test_form_request_flow(spark):
    from wattlane.operators.combine import form_request_points
    t = datetime(2024, 5, 1, 12)
    reqs = spark.createDataFrame([
        (1, ",".join(str(i) for i in range(30)), t, "L1"),
        (2, "1,2,3", t, "L1"),
        (3, ",".join(["5"] * 23 + ["Infinity"]), t, "L2"),
    ], "request_id BIGINT, text STRING, as_of TIMESTAMP_NTZ, location STRING")
    obs = spark.createDataFrame([("L1", datetime(2024, 5, 1, 11), 1, 0.0, 40.0, 2.0, 3, "C", None, None)],
                                "location STRING, ts TIMESTAMP_NTZ, obs_id BIGINT, temp DOUBLE, humidity DOUBLE, "
                                "wind_speed DOUBLE, weather_code INT, city STRING, town STRING, village STRING")
    pts, errors = form_request_points(reqs, obs)
    assert [(r["request_id"], r["n_values"]) for r in errors.collect()] == [(2, 3)]
    one = sorted((r for r in pts.collect() if r["series_id"] == "1"), key=lambda r: r["arrival_no"])
    assert len(one) == 24 and one[0]["Power_Consumption"] == 6.0 and one[-1]["Power_Consumption"] == 29.0
    assert one[0]["ts"] == t - timedelta(hours=23) and one[-1]["ts"] == t
    assert one[0]["temperature"] == 20.0 and one[0]["humidity"] == 40.0 and one[0]["voltage"] == 230.0
    gate = {r["series_id"]: r["status"] for r in C.series_gate(
        pts.select("series_id", "ts", "arrival_no", "Power_Consumption", "voltage", "current",
                   "temperature", "humidity")).collect()}
    assert gate == {"1": "insufficient_history", "3": "invalid_input"}
