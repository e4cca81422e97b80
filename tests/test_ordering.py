"""chunk+halo == plain window, for several chunk sizes and uneven series."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import frame
from wattlane.operators import windows as W
from wattlane.operators.metrics import time_split
from wattlane.operators.sequences import sliding_sequences
from wattlane.plans.ordering import global_position, over_series, series_row_number

FEATURES = ["energy_lag_1", "energy_lag_24", "energy_lag_168", "energy_min_24h", "energy_max_24h",
            "energy_mean_24h", "energy_std_7d"]


def random_readings(spark, sizes, seed):
    rng = random.Random(seed)
    rows = []
    arrival = 0
    for s, n in sizes.items():
        t = datetime(2024, 1, 1)
        for _ in range(n):
            t += timedelta(minutes=rng.choice([0, 7, 60, 61]))  # repeated stamps → ties
            rows.append((s, t, arrival, round(rng.uniform(0, 50), 2), 230.0, 10.0,
                         None if rng.random() < 0.1 else 20.0, 50.0))
            arrival += 1
    rng.shuffle(rows)
    return frame(spark, rows)


def as_map(df):
    return {r["arrival_no"]: tuple(None if r[c] is None else round(r[c], 9) for c in FEATURES) for r in df.collect()}


@pytest.mark.parametrize("chunk_rows", [168, 169, 2048])
def test_chunked_equals_plain(spark, chunk_rows):
    df = random_readings(spark, {"big": 1500, "mid": 400, "small": 30, "one": 1}, seed=chunk_rows)
    plain = W.serving_features(df, strategy="plain", drop_warmup=False)
    chunked = W.serving_features(df, strategy="chunked", chunk_rows=chunk_rows, num_partitions=5,
                                 drop_warmup=False)
    a, b = as_map(plain), as_map(chunked)
    assert len(b) == df.count()
    assert a == b


def test_auto_routes_hot_series_and_matches_plain(spark):
    df = random_readings(spark, {"hot": 900, "cold1": 200, "cold2": 50}, seed=7)
    plain = W.serving_features(df, strategy="plain")
    auto = W.serving_features(df, strategy="auto", hot_rows=500, chunk_rows=256, num_partitions=3)
    assert as_map(plain) == as_map(auto)
    assert plain.count() == auto.count()


def test_global_position_is_a_permutation(spark):
    df = random_readings(spark, {"a": 300, "b": 5}, seed=3)
    pos = global_position(df, ["series_id", "ts", "arrival_no"], num_partitions=7).collect()
    assert sorted(r["_g"] for r in pos) == list(range(305))
    ordered = sorted(pos, key=lambda r: r["_g"])
    keys = [(r["series_id"], r["ts"], r["arrival_no"]) for r in ordered]
    assert keys == sorted(keys)


def test_series_row_number_chunked_equals_plain(spark):
    df = random_readings(spark, {"a": 700, "b": 90, "c": 3}, seed=11)
    plain = {r["arrival_no"]: r["rn"] for r in series_row_number(df, ["series_id"], strategy="plain").collect()}
    chunk = {r["arrival_no"]: r["rn"] for r in series_row_number(df, ["series_id"], strategy="chunked",
                                                                   num_partitions=6).collect()}
    auto = {r["arrival_no"]: r["rn"] for r in series_row_number(df, ["series_id"], hot_rows=100,
                                                                  num_partitions=6).collect()}
    assert plain == chunk == auto


def test_sequences_chunked_equal_plain_and_count(spark):
    sizes = {"a": 500, "b": 30, "c": 10}
    df = random_readings(spark, sizes, seed=5)
    plain = sliding_sequences(df, strategy="plain")
    chunk = sliding_sequences(df, strategy="chunked", chunk_rows=64, num_partitions=4)
    assert plain.count() == sum(max(n - 24, 0) for n in sizes.values())
    pa = {r["arrival_no"]: (list(r["seq"]), r["y"]) for r in plain.collect()}
    pb = {r["arrival_no"]: (list(r["seq"]), r["y"]) for r in chunk.collect()}
    assert pa == pb


def test_time_split_fractions(spark):
    df = random_readings(spark, {"a": 100, "b": 7}, seed=2)
    out = time_split(df).groupBy("series_id", "split").count().collect()
    got = {(r["series_id"], r["split"]): r["count"] for r in out}
    assert got[("a", "train")] == 80 and got[("a", "validation")] == 20
    assert got[("b", "train")] == 5 and got[("b", "validation")] == 2


def test_input_order_does_not_matter(spark):
    df = random_readings(spark, {"a": 400}, seed=9)
    a = as_map(W.serving_features(df, strategy="plain"))
    b = as_map(W.serving_features(df.orderBy(F.rand(1)).repartition(7), strategy="plain"))
    assert a == b


def test_horizon_label_chunked_equals_plain(spark):
    df = random_readings(spark, {"a": 600, "b": 40}, seed=13)
    feats = W.serving_features(df, strategy="plain", drop_warmup=False)
    plain = {r["arrival_no"]: r["label"] for r in W.with_horizon(feats, 1, strategy="plain").collect()}
    chunk = {r["arrival_no"]: r["label"] for r in W.with_horizon(feats, 1, strategy="chunked", chunk_rows=50,
                                                                  num_partitions=4).collect()}
    assert plain == chunk
    assert sum(v is None for v in plain.values()) == 2
    same = W.with_horizon(feats, 0).filter("label != energy_kwh").count()
    assert same == 0


def test_chunk_halo_property(spark):
    """Random series sizes, chunk sizes and partition counts: chunked == plain."""
    from hypothesis import HealthCheck, given, settings
    from hypothesis import strategies as st

    @settings(max_examples=5, deadline=None, derandomize=True, suppress_health_check=list(HealthCheck))
    @given(sizes=st.lists(st.integers(min_value=1, max_value=700), min_size=1, max_size=3),
           chunk=st.integers(min_value=168, max_value=600), parts=st.integers(min_value=1, max_value=9),
           seed=st.integers(min_value=0, max_value=10_000))
    def check(sizes, chunk, parts, seed):
        df = random_readings(spark, {f"s{i}": n for i, n in enumerate(sizes)}, seed=seed)
        plain = as_map(W.serving_features(df, strategy="plain", drop_warmup=False))
        chunked = as_map(W.serving_features(df, strategy="chunked", chunk_rows=chunk, num_partitions=parts,
                                            drop_warmup=False))
        assert plain == chunked

    check()


def test_null_series_key_is_a_series(spark):
    rows = [(None,) + r[1:] for r in random_readings(spark, {"x": 60}, seed=1).collect()]
    rows += [tuple(r) for r in random_readings(spark, {"y": 40}, seed=2).collect()]
    df = spark.createDataFrame(rows, random_readings(spark, {"z": 1}, seed=3).schema)
    for kw in ({"strategy": "plain"}, {"strategy": "chunked", "chunk_rows": 168}, {"hot_rows": 10, "chunk_rows": 168}):
        got = {r["series_id"]: r["count"] for r in W.serving_features(df, **kw).groupBy("series_id").count().collect()}
        assert got == {None: 36, "y": 16}, kw
    split = {(r["series_id"], r["split"]): r["count"] for r in time_split(df, hot_rows=10).groupBy("series_id", "split").count().collect()}
    assert split[(None, "train")] == 48 and split[(None, "validation")] == 12


def test_a_large_series_is_not_one_task(spark):
    """A series of 300,000 rows is numbered by its stored positions, and cut into chunks that one task holds easily."""
    df = spark.range(300_000).selectExpr("'s' as series_id", "timestamp_ntz'2024-01-01' as ts", "id as arrival_no", "repeat('x', 20) as wide")
    numbered = series_row_number(df, ["series_id"], size_col="n")
    files = numbered.inputFiles()
    assert files and all("/positions-" in f for f in files)
    assert numbered.where("rn <> arrival_no or n <> 300000").count() == 0
    parts = over_series(df, ["series_id"], lambda f, s: f.select("*", F.lag("arrival_no", 24).over(s).alias("lag")), halo=24)
    assert parts.where("coalesce(arrival_no - lag, 24) <> 24").count() == 0 and parts.where("lag is null").count() == 24
    assert parts.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 300_000
