from datetime import datetime

from pyspark.sql import functions as F

from wattlane.functions.numeric import (coerce_numeric, default_if_absent, default_if_missing,
                                        format_fixed, valid_prediction)
from wattlane.functions.text import (first_non_null_name, hourly_stamp, last_n_values,
                                     parse_reading_list, parse_timestamp)
from wattlane.sources.readings import coerce_points, parse_reading_batches, readings_schema


def test_parse_reading_list_prefix_semantics(spark):
    df = spark.createDataFrame([("12abc, 1e3,abc,.5,7.,NaN,,-3,+2,Infinity,-Infinity, x5,\t4,1e,infinity",)], "t STRING")
    got = df.select(parse_reading_list(F.col("t")).alias("v")).first()["v"]
    assert got == [12.0, 1000.0, 0.5, 7.0, -3.0, 2.0, float("inf"), float("-inf"), 4.0, 1.0]


def test_last_n_values_and_stamps(spark):
    df = spark.createDataFrame([([float(i) for i in range(30)],), ([1.0] * 5,)], "v ARRAY<DOUBLE>")
    got = [r["k"] for r in df.select(last_n_values(F.col("v")).alias("k")).collect()]
    assert got[0] == [float(i) for i in range(6, 30)] and got[1] is None
    as_of = datetime(2024, 3, 1, 12, 30)
    st = spark.createDataFrame([(as_of,)], "a TIMESTAMP_NTZ").select(
        hourly_stamp(F.col("a"), F.lit(0), 24).alias("first"), hourly_stamp(F.col("a"), F.lit(23), 24).alias("last")).first()
    assert st["first"] == datetime(2024, 2, 29, 13, 30) and st["last"] == as_of


def test_coerce_numeric_and_defaults(spark):
    df = spark.createDataFrame([("12abc",), (" 1e3",), ("abc",), (".5",), ("7.",), ("NaN",), ("",), ("0",)], "t STRING")
    got = [r["x"] for r in df.select(coerce_numeric(F.col("t")).alias("x")).collect()]
    assert got == [None, 1000.0, None, 0.5, 7.0, None, None, 0.0]
    d = spark.createDataFrame([(0.0,), (None,), (float("nan"),), (3.0,)], "x DOUBLE")
    got = [(r["a"], r["b"]) for r in d.select(default_if_missing(F.col("x"), 20.0).alias("a"),
                                              default_if_absent(F.col("x"), 20.0).alias("b")).collect()]
    assert [g[0] for g in got] == [20.0, 20.0, 20.0, 3.0]
    assert got[0][1] == 0.0 and got[1][1] == 20.0


def test_format_fixed_matches_to_fixed(spark):
    # expected strings are what a browser's toFixed prints
    cases = [(1.0005, 3, "1.000"), (2.675, 2, "2.67"), (0.0625, 3, "0.063"), (12.3145, 3, "12.315"),
             (-0.0001, 3, "-0.000"), (5.0, 3, "5.000"), (123.4565, 3, "123.457"), (0.0005, 3, "0.001"),
             (20.0, 1, "20.0"), (0.05, 1, "0.1")]
    df = spark.createDataFrame([(x,) for x, _, _ in cases], "x DOUBLE")
    for (x, d, want) in cases:
        got = df.filter(F.col("x") == x).select(format_fixed(F.col("x"), d).alias("s")).first()["s"]
        assert got == want, (x, d, got)
    edge = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1e17,), (-0.0,), (None,)], "x DOUBLE")
    got = [r["s"] for r in edge.select(format_fixed(F.col("x"), 3).alias("s")).collect()]
    assert got == ["Infinity", "-Infinity", "100000000000000000.000", "0.000", None]


def test_parse_timestamp_formats(spark):
    df = spark.createDataFrame([("2024-01-01T10:00:00Z",), ("2024-01-01T10:00:00+02:00",),
                                ("2024-01-01 10:00:00",), ("junk",)], "t STRING")
    out = [r["p"] for r in df.select(parse_timestamp(F.col("t")).cast("timestamp_ntz").alias("p")).collect()]
    assert out == [datetime(2024, 1, 1, 10), datetime(2024, 1, 1, 8), datetime(2024, 1, 1, 10), None]
    asof = df.select(parse_timestamp(F.col("t"), F.lit(datetime(2020, 1, 1))).alias("p")).collect()[3]["p"]
    assert asof is not None


def test_valid_prediction_and_names(spark):
    df = spark.createDataFrame([("",), ("12",), ("12x",), (" 3.5 ",), ("NaN",)], "t STRING")
    got = [(r["v"]["valid"], r["v"]["prediction"]) for r in df.select(valid_prediction(F.col("t")).alias("v")).collect()]
    assert got == [(True, 0.0), (True, 12.0), (False, None), (True, 3.5), (False, None)]
    n = spark.createDataFrame([("", None, "V"), (None, "", ""), ("C", "T", "V")], "c STRING, t STRING, v STRING")
    names = [r["n"] for r in n.select(first_non_null_name(F.col("c"), F.col("t"), F.col("v")).alias("n")).collect()]
    assert names == ["V", "Unknown Location", "C"]


def test_request_bodies(spark):
    good = '[{"timestamp": "2024-01-01T00:00:00Z", "Power_Consumption": "1.5", "voltage": 230}]'
    df = spark.createDataFrame([(1, None), (2, "{}"), (3, "[]"), (4, "junk"), (5, good), (6, '{"timestamp": "x"}')],
                               "request_id INT, body STRING")
    acc, rej = parse_reading_batches(df)
    reasons = {r["request_id"]: r["reason"] for r in rej.collect()}
    assert reasons == {1: "null_body", 2: "not_an_array", 3: "empty_array", 4: "not_an_array", 6: "not_an_array"}
    pts = coerce_points(acc).collect()
    assert len(pts) == 1 and pts[0]["Power_Consumption"] == 1.5 and pts[0]["voltage"] == 230.0
    assert pts[0]["arrival_no"] == 0 and pts[0]["current"] is None
    assert [f.name for f in readings_schema().fields] == ["timestamp", "Power_Consumption", "voltage",
                                                          "current", "temperature", "humidity"]


def test_csv_round_trip_and_inference(spark, tmp_path):
    from datetime import datetime as dt

    from wattlane.sources.readings import read_readings_csv, write_readings_csv
    df = spark.createDataFrame([("s", dt(2024, 1, 1, 0, 0, 0, 123456), 1, 2.5, None)],
                               "series_id STRING, ts TIMESTAMP_NTZ, arrival_no BIGINT, Power_Consumption DOUBLE, temperature DOUBLE")
    path = str(tmp_path / "csv")
    write_readings_csv(df, path)
    back = read_readings_csv(spark, path, schema=df.schema).first()
    assert back["ts"] == dt(2024, 1, 1, 0, 0, 0, 123456) and back["temperature"] is None
    inferred = read_readings_csv(spark, path, infer_schema=True)
    assert dict(inferred.dtypes)["Power_Consumption"] == "double"
    raw = spark.createDataFrame([("2024-01-01T05:00:00Z", 1.0)], "timestamp STRING, Power_Consumption DOUBLE")
    raw_path = str(tmp_path / "raw")
    raw.write.option("header", True).csv(raw_path)
    got = read_readings_csv(spark, raw_path, schema="timestamp STRING, Power_Consumption DOUBLE").first()
    assert got["timestamp"] is not None


def test_parse_timestamp_other_spellings(spark):
    want = {
        "2024/01/05 10:00": datetime(2024, 1, 5, 10), "01/05/2024 10:00": datetime(2024, 1, 5, 10), "Jan 5 2024": datetime(2024, 1, 5),
        "20240105": datetime(2024, 1, 5), "13/01/2024": datetime(2024, 1, 13), "1/2/2024": datetime(2024, 1, 2), "5 January 2024 22:15:30.5": datetime(2024, 1, 5, 22, 15, 30, 500000),
        "January 5th, 2024 12 am": datetime(2024, 1, 5), "jan 5, 2024 12:30 PM": datetime(2024, 1, 5, 12, 30), "Fri, 05 Jan 2024 10:00:00": datetime(2024, 1, 5, 10),
        "20240105T100203": datetime(2024, 1, 5, 10, 2, 3), "20240105 1002": datetime(2024, 1, 5, 10, 2), "2024.1.5": datetime(2024, 1, 5), " Sept 3 2024 ": datetime(2024, 9, 3),
        "2024/01/05T10:00:00Z": datetime(2024, 1, 5, 10), "01/05/2024 10:00+02:00": datetime(2024, 1, 5, 8),
        "13/13/2024": None, "2024/13/05": None, "Janet 5 2024": None, "5 2024": None, "01/05/24": None, "12:30": None, "Friday": None, "20241305": None,
        "Jan 5 2024 13 pm": None, "Jan 5 2024 0 am": None, "01/05/2024x": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    got = {r.t: r.p for r in df.select("t", parse_timestamp(F.col("t")).cast("timestamp_ntz").alias("p")).collect()}
    assert got == want
