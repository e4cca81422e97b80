from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import frame, hourly
from wattlane.operators import windows as W


def by_key(df, *cols):
    return {(r["series_id"], r["arrival_no"]): r for r in df.collect()}


def test_lags_are_positional_across_gaps(spark):
    rows = hourly(spark, 55, skip={10, 11, 12, 13, 14})  # 50 rows, 5 hours missing
    out = W.energy_lags(frame(spark, rows)).orderBy("ts").collect()
    assert len(out) == 50
    # row 5 positions after the gap: lag_1 is the previous *row*, not the previous hour
    r = [x for x in out if x["arrival_no"] == 15][0]
    assert r["energy_lag_1"] == 9.0
    assert r["energy_lag_3"] == 7.0
    first = out[0]
    assert first["energy_lag_1"] is None


def test_ties_in_ts_use_arrival_order(spark):
    t = datetime(2024, 1, 1)
    rows = [("s", t, a, float(a), 230.0, 10.0, 20.0, 50.0) for a in (5, 3, 4, 0, 2, 1)]
    out = W.energy_lags(frame(spark, rows)).collect()
    got = {r["arrival_no"]: r["energy_lag_1"] for r in out}
    assert got == {0: None, 1: 0.0, 2: 1.0, 3: 2.0, 4: 3.0, 5: 4.0}


def test_rolling_single_row_std_is_null_and_constant_std_zero(spark):
    rows = hourly(spark, 200, power=lambda i: 5.0 if i < 150 else 9.0)
    out = {r["arrival_no"]: r for r in W.rolling_features(frame(spark, rows)).collect()}
    assert out[0]["energy_std_24h"] is None
    assert out[0]["energy_mean_24h"] == 5.0
    assert out[100]["energy_std_24h"] == 0.0
    assert out[150]["energy_max_24h"] == 9.0 and out[150]["energy_min_24h"] == 5.0
    # 24-row frame includes the current row: 23 fives and one nine
    assert abs(out[150]["energy_mean_24h"] - (23 * 5 + 9) / 24) < 1e-12
    assert abs(out[199]["energy_mean_7d"] - (118 * 5 + 50 * 9) / 168) < 1e-12


def test_calendar_flags_and_iso_week(spark):
    # 2027-01-03 is a Sunday in ISO week 53 of 2026; hours 8..22 cover the flag edges
    start = datetime(2027, 1, 3, 8)
    rows = [("s", start + timedelta(hours=i), i, 1.0, 230.0, 10.0, 20.0, 50.0) for i in range(15)]
    out = W.serving_features(frame(spark, rows), drop_warmup=False).orderBy("ts").collect()
    r = {x["hour"]: x for x in out}
    assert r[8]["week_of_year"] == 53 and r[8]["year"] == 2027
    assert r[8]["day_of_week"] == 6 and r[8]["is_weekend"] == 1
    assert (r[8]["is_business_hours"], r[9]["is_business_hours"], r[17]["is_business_hours"], r[18]["is_business_hours"]) == (0, 1, 1, 0)
    assert (r[16]["is_peak_hours"], r[17]["is_peak_hours"], r[21]["is_peak_hours"], r[22]["is_peak_hours"]) == (0, 1, 1, 0)
    dow = W.training_features(frame(spark, rows)).select("dow").distinct().collect()
    assert [x["dow"] for x in dow] == [1]  # Sunday = 1 in the training coding
    assert r[10]["temp_hour_interaction"] == 200.0
    assert r[10]["humidity_temp_interaction"] == 1000.0


def test_serving_features_drops_first_24_rows(spark):
    rows = hourly(spark, 60)
    out = W.serving_features(frame(spark, rows))
    assert out.count() == 36
    assert out.agg(F.min("arrival_no")).first()[0] == 24
    assert "energy_kwh" in out.columns and "Power_Consumption" not in out.columns


def test_rolling_strict_null_inside(spark):
    vals = [1.0, 2.0, None, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0, 10.0]
    rows = [("s", datetime(2024, 1, 1) + timedelta(hours=i), i, 0.0, 0.0, 0.0, 0.0, 0.0) for i in range(10)]
    df = frame(spark, rows).drop("temperature").join(
        spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "arrival_no BIGINT, value DOUBLE"), "arrival_no")
    from wattlane.plans.ordering import over_series
    out = over_series(df, ["series_id"], lambda f, s: f.select("*", *W.rolling_strict_cols(s)), halo=4).collect()
    got = {r["arrival_no"]: (r["rolling_3"], r["rolling_5"]) for r in out}
    assert got[1] == (None, None)          # frame not full
    assert got[3] == (None, None)          # NULL inside
    assert got[5] == (5.0, None)           # 3-frame clean, 5-frame holds the NULL
    assert got[7] == (7.0, 6.0)
    feats = W.build_value_features(df.select("series_id", "ts", "arrival_no", "value"))
    assert sorted(r["arrival_no"] for r in feats.collect()) == [7, 8, 9]


def test_last_n_rows_newest_and_oldest(spark):
    rows = hourly(spark, 30, series="a") + hourly(spark, 5, series="b", arrival_base=100)
    df = frame(spark, rows)
    newest = W.last_n_rows(df, 24).collect()
    assert len(newest) == 24 + 5
    assert min(r["arrival_no"] for r in newest if r["series_id"] == "a") == 6
    oldest = W.last_n_rows(df, 3, newest=False).collect()
    assert sorted(r["arrival_no"] for r in oldest) == [0, 1, 2, 100, 101, 102]


def test_rolling_3h_spans_four_rows(spark):
    rows = hourly(spark, 10)
    out = {r["arrival_no"]: r for r in W.training_features(frame(spark, rows)).collect()}
    assert out[5]["rolling_3h"] == (2 + 3 + 4 + 5) / 4
    assert out[0]["lag_1"] is None and out[3]["lag_1"] == 2.0
    assert abs(out[6]["sin_hour"] - __import__("math").sin(6 * 2 * 3.14159 / 24)) < 1e-15
