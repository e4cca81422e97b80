"""Inputs that must not be misread: columns by name, whole bodies, dates, numbers."""

import os
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import frame
from wattlane.functions.numeric import coerce_numeric, valid_prediction
from wattlane.functions.text import parse_timestamp
from wattlane.operators.models import train_boosted
from wattlane.operators.windows import training_features
from wattlane.session import ensure_checkpoint_dir
from wattlane.sources.readings import parse_reading_batches, read_readings_csv

SCHEMA = "timestamp TIMESTAMP, Power_Consumption DOUBLE, humidity DOUBLE"


def folder(spark, **files):
    path = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}".removeprefix("file:")
    os.makedirs(path)
    for name, text in files.items():
        with open(f"{path}/{name}.csv", "w") as f:
            f.write(text)
    return path


def test_csv_columns_go_by_header_name(spark):
    path = folder(spark, a="timestamp,humidity,extra,Power_Consumption\n2024-01-01T00:00:00,55,x,1.5\n2024-01-01T01:00:00,bad,,2\n")
    rows = read_readings_csv(spark, path, SCHEMA).orderBy("timestamp").collect()
    assert [(r.Power_Consumption, r.humidity) for r in rows] == [(1.5, 55.0), (2.0, None)]
    with pytest.raises(ValueError, match="voltage"):
        read_readings_csv(spark, path, "voltage DOUBLE")


def test_csv_with_another_header_raises(spark):
    path = folder(spark, a="timestamp,humidity,Power_Consumption\n2024-01-01T00:00:00,55,1.5\n", b="timestamp,Power_Consumption,humidity\n2024-01-01T00:00:00,1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_readings_csv(spark, path, SCHEMA).collect()


@pytest.mark.parametrize("body,reason", [
    ('[{"timestamp": "2024-01-01"}]', None), ('\n\t [{"timestamp": "2024-01-01"}] \n', None), ('[{"timestamp": "2024-01-01"}] junk', "invalid_json"),
    ('[{"timestamp": "2024-01-01"}], []', "invalid_json"), ('[{"timestamp": "2024-01-01"}]]', "invalid_json"), ('[{"timestamp"', "invalid_json"),
    ('{"timestamp": "2024-01-01"}', "not_an_array"), ("junk", "not_an_array"), ("", "not_an_array"), ("[]", "empty_array"), (None, "null_body")])
def test_bodies(spark, body, reason):
    accepted, rejected = parse_reading_batches(spark.createDataFrame([(1, body)], "request_id long, body string"))
    assert [r.reason for r in rejected.collect()] == ([] if reason is None else [reason])
    assert accepted.count() == (1 if reason is None else 0)


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize("text,ok", [("2024-01-05", True), ("2024-01-05T10:00:00Z", True), (" 2024-01-05 10:00", True), ("2024", True),
                                     ("12:30", False), ("T12:30:00", False), ("now", False), ("", False)])
def test_a_timestamp_needs_a_date(spark, text, ok):
    assert (one(spark, text, parse_timestamp) is not None) == ok


@pytest.mark.parametrize("text,value", [("12", 12.0), (" 1e3 ", 1000.0), (".5", 0.5), ("7.", 7.0), ("-2.5E-1", -0.25), ("inf", float("inf")), ("12d", None),
                                        ("12f", None), ("1.5D", None), ("0x10", None), ("NaN", None), ("", None), ("1 2", None)])
def test_numbers(spark, text, value):
    assert one(spark, text, coerce_numeric) == value


@pytest.mark.parametrize("text,value", [("", 0.0), (" \n", 0.0), ("12", 12.0), ("12d", None), ("inf", None), ("Infinity", float("inf")),
                                        ("-Infinity", float("-inf")), ("0x10", 16.0), ("0b101", 5.0), ("0o17", 15.0), ("-0x10", None), ("NaN", None), ("1e2", 100.0)])
def test_responses(spark, text, value):
    got = one(spark, text, valid_prediction)
    assert got.prediction == value and got.valid == (value is not None)


def test_redelivered_readings_count_once_and_incomplete_rows_do_not_train(spark):
    from conftest import hourly
    rows = hourly(spark, 50, power=lambda i: float(i % 7))
    again = [(*r[:2], 1000 + r[2], *r[3:]) for r in rows[:10]]
    gap = [(*r[:6], None, r[7]) if r[2] == 40 else r for r in rows]
    feats = training_features(frame(spark, gap + again))
    assert feats.count() == 50 and feats.agg(F.max("arrival_no")).first()[0] == 49
    model = train_boosted(feats, maxIter=1, maxDepth=1)
    assert model.stages[-1].trees[0].numNodes >= 1
    assert feats.dropna(how="any").count() == 25  # 24 warm-up rows and the one without a temperature are out
