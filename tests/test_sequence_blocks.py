"""Blocks of rows for training: the windows and splits of sliding_sequences, the fit of the row form."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import frame, hourly
from wattlane.operators import recurrent as R
from wattlane.operators import sequences as S
from wattlane.operators.metrics import time_split


def series(spark, holes=True):
    rng = random.Random(3)
    rows = []
    for k, n in enumerate((1, 23, 24, 25, 47, 48, 49, 72, 300)):
        rows += hourly(spark, n, series=f"len{n}", arrival_base=1000 * k, power=lambda i: rng.random())
    if holes:
        rows += hourly(spark, 120, series="holes", arrival_base=20000, power=lambda i: None if rng.random() < 0.03 else rng.random())
        rows += [(None, *r[1:]) for r in hourly(spark, 60, arrival_base=30000, power=lambda i: rng.random())]
    return frame(spark, rows).repartition(5)


def as_set(df):
    return sorted((str(r.series_id), r.ts, r.arrival_no, repr(list(r.seq)), repr(r.y), r.split) for r in df.collect())


@pytest.mark.parametrize("how", [{"strategy": "plain"}, {"strategy": "plain", "block_windows": 24}, {"strategy": "plain", "block_windows": 1},
                                 {"strategy": "chunked", "num_partitions": 4, "block_windows": 37}, {"hot_rows": 100, "block_windows": 50}])
def test_windows_and_splits_are_those_of_the_row_form(spark, how):
    df = series(spark)
    want = as_set(time_split(S.sliding_sequences(df, strategy="plain"), strategy="plain"))
    blocks = S.sequence_blocks(df, **how)
    assert as_set(S.block_sequences(blocks)) == want
    size = max(how.get("block_windows", 1024), 24)
    assert blocks.agg(F.max(F.size("values"))).first()[0] <= size + 24
    assert blocks.where("n_windows < 1 or n_windows > size(values) - 24 or size(ts) != n_windows").isEmpty()


def test_short_and_empty_inputs_give_no_block(spark):
    assert S.sequence_blocks(frame(spark, hourly(spark, 24)), strategy="plain").isEmpty()
    assert S.sequence_blocks(frame(spark, []), strategy="plain").isEmpty()
    with pytest.raises(ValueError):
        R.train_recurrent_blocks(S.sequence_blocks(frame(spark, hourly(spark, 24)), strategy="plain"), layers=(2,), steps=1)


def test_the_fit_is_that_of_the_row_form(spark):
    df = series(spark)
    rows = time_split(S.sliding_sequences(df, strategy="plain"), strategy="plain")
    a = R.train_recurrent(rows, layers=(3, 2), steps=4, rate=0.05, split_col="split")
    b = R.train_recurrent_blocks(S.sequence_blocks(df, strategy="plain", block_windows=40), layers=(3, 2), steps=4, rate=0.05)
    assert np.allclose([a.mean, a.scale], [b.mean, b.scale]) and np.allclose(a.losses, b.losses) and np.allclose(a.weights, b.weights)


def test_a_share_of_the_windows_is_drawn_alike_on_any_partitions(spark):
    blocks = S.sequence_blocks(series(spark, holes=False), strategy="plain", block_windows=30)
    one, two = (R.train_recurrent_blocks(b, layers=(2,), steps=3, batch_share=0.5, seed=9) for b in (blocks, blocks.repartition(7)))
    assert np.allclose(one.weights, two.weights)
    train = blocks.select("values", "n_train", F.xxhash64("series_id", "block").alias("key"))
    whole = R.gradient_sums(train, (2,), one.weights, 0.5, 0.3, 24, R.block_rows)[0]
    part = R.gradient_sums(train, (2,), one.weights, 0.5, 0.3, 24, R.block_rows, share=0.5, seed=10)[0]
    assert 0.3 * whole < part < 0.7 * whole and whole == blocks.agg(F.sum("n_train")).first()[0]


def test_no_row_carries_its_block_along(spark):
    """What reaches a Python function is one window a row, not the block that it was cut from."""
    out = S.block_sequences(S.sequence_blocks(series(spark), strategy="plain")).select("y", F.pandas_udf(lambda s: s.str.len(), "long")("seq").alias("n"))
    lines = out._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(lines) if "ArrowEvalPython" in line)
    assert "slice(" not in lines[at] and "values" not in lines[at + 1].split("Generate")[0]
    assert out.where("n <> 24").count() == 0
