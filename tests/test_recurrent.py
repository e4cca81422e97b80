"""Recurrent model: gradient against finite differences, the distributed sums, and a series that no linear model follows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlane.operators import models as M
from wattlane.operators import recurrent as R


@pytest.mark.parametrize("layers", [(3,), (4, 3), (2, 3, 2)])
def test_gradient_equals_finite_differences(layers):
    rng = np.random.default_rng(1)
    net = R.Network(1, layers)
    w, x, y = net.start(3) + rng.normal(0, 0.1, net.size), rng.normal(0, 1, (5, 6, 1)), rng.normal(0, 1, 5)
    _, grad = net.gradient(w, x, y)
    for k in range(net.size):
        e = np.zeros(net.size)
        e[k] = 1e-6
        plain = (((net.forward(w + e, x)[0] - y) ** 2).sum() - ((net.forward(w - e, x)[0] - y) ** 2).sum()) / 2e-6
        assert grad[k] == pytest.approx(plain, rel=1e-5, abs=1e-6)


@pytest.fixture(scope="module")
def windows(spark):
    """Windows of 6 over a chaotic map: the next value is a curve of the last one."""
    v = [0.37]
    for _ in range(900):
        v.append(3.8 * v[-1] * (1 - v[-1]))
    rows = [("s", i, v[i:i + 6], v[i + 6], "train" if i < 700 else "validation") for i in range(890)]
    return spark.createDataFrame(rows, "series_id string, arrival_no long, seq array<double>, y double, split string").repartition(3)


def test_sums_do_not_depend_on_partitions(windows):
    net = R.Network(1, (4,))
    w = net.start(5)
    df = windows.select(F.col("seq").alias("x"), "y")
    a, b = (R.gradient_sums(d, (4,), w, 0.5, 0.2, 6) for d in (df, df.repartition(7)))
    rows = df.collect()
    x, y = (np.array([r[0] for r in rows])[:, :, None] - 0.5) / 0.2, (np.array([r[1] for r in rows]) - 0.5) / 0.2
    loss, grad = net.gradient(w, x, y)
    assert a[0] == b[0] == 890 and a[1] == pytest.approx(loss) and np.allclose(a[2], grad) and np.allclose(b[2], grad)


def test_beats_the_linear_model_on_held_out_windows(windows):
    net = R.train_recurrent(windows, layers=(8,), steps=60, rate=0.05, seq_len=6, split_col="split")
    linear = M.train_sequence_model(windows, split_col="split")
    held = windows.where("split = 'validation'")

    def error(df):
        return df.agg(F.sqrt(F.avg((F.col("seq_pred") - F.col("y")) ** 2))).first()[0]

    ours, plain = error(net.transform(held)), error(M.score_sequence_model(linear, held))
    assert ours < 0.6 * plain and net.losses[-1] < 0.4 * net.losses[0]
    got = {r.arrival_no: r.seq_pred for r in net.transform(held).collect()}
    rows = held.collect()
    assert np.allclose(net.predict(np.array([r.seq for r in rows])), [got[r.arrival_no] for r in rows], atol=1e-4)


def test_edge_rows(spark, windows):
    odd = spark.createDataFrame([("s", 1, [1.0, None, 2.0, 1.0, 1.0, 1.0], 2.0, "train"), ("s", 2, [1.0] * 5, 2.0, "train"), ("s", 3, [1.0] * 6, None, "train")], windows.schema)
    with pytest.raises(ValueError):
        R.train_recurrent(odd, layers=(2,), steps=1, seq_len=6)
    flat = spark.createDataFrame([("s", k, [5.0] * 6, 5.0, "train") for k in range(9)], windows.schema)
    net = R.train_recurrent(flat.unionByName(odd), layers=(2,), steps=2, seq_len=6, batch_share=0.5)
    assert net.mean == 5.0 and all(math.isfinite(p) for p in net.predict(np.full((2, 6), 5.0)))


def test_the_fit_is_spread_over_the_cores(spark, windows):
    """A step costs arithmetic, not bytes: windows that lie in one partition are dealt out, packed, and all of them train."""
    one = windows.select(F.col("seq").alias("x"), "y").coalesce(1)
    dealt = R.spread(R.pack(one, 6))
    assert dealt.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    w = R.Network(1, (4,)).start(5)
    a, b = R.gradient_sums(one, (4,), w, 0.5, 0.2, 6), R.gradient_sums(dealt, (4,), w, 0.5, 0.2, 6, R.packed_rows)
    assert a[0] == b[0] == 890 and a[1] == pytest.approx(b[1]) and np.allclose(a[2], b[2])
