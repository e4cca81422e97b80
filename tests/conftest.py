from __future__ import annotations

import os
import sys
from datetime import datetime, timedelta

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wattlane.session import build_session, ensure_checkpoint_dir  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", app_name="wattlane-tests", shuffle_partitions=4)
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


READING_DDL = ("series_id STRING, ts TIMESTAMP_NTZ, arrival_no BIGINT, Power_Consumption DOUBLE, "
               "voltage DOUBLE, current DOUBLE, temperature DOUBLE, humidity DOUBLE")


def hourly(spark, n, series="s", start=datetime(2024, 1, 1), power=None, temp=20.0, hum=50.0,
           skip=(), arrival_base=0):
    """A simple hourly series of ``n`` rows (positions in ``skip`` left out)."""
    rows = []
    for i in range(n):
        if i in skip:
            continue
        p = float(i) if power is None else power(i)
        rows.append((series, start + timedelta(hours=i), arrival_base + i, p, 230.0, 10.0, temp, hum))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, READING_DDL)
