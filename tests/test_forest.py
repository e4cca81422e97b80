"""Hashed bootstrap: the forest does not depend on the layout, draws are Poisson, rows with a NULL input are skipped."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattlane.operators import forest as H


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    rows = [("s", i, float(a), float(i % 24), float(4 * a + (i % 24) / 3 + e)) for i, (a, e) in enumerate(zip(rng.normal(0, 1, 900), rng.normal(0, 0.2, 900)))]
    rows += [("s", 900, None, 1.0, 1.0), ("s", 901, 0.5, 2.0, None)]
    return spark.createDataFrame(rows, "series_id string, arrival_no long, a double, b double, y double")


def test_same_forest_for_any_layout(table):
    got = []
    for parts in (1, 4, 37):
        m = H.train_hashed_forest(table.repartition(parts), "y", ["a", "b"], numTrees=3, maxDepth=5)
        got.append({r.arrival_no: r.prediction for r in m.transform(table).collect()})
    assert set(got[0]) == set(range(900)) | {901}
    for other in got[1:]:
        assert all(abs(other[k] - v) < 1e-9 for k, v in got[0].items())
    y = {r.arrival_no: r.y for r in table.collect()}
    assert np.sqrt(np.mean([(got[0][k] - y[k]) ** 2 for k in range(900)])) < 1.5
    other_seed = H.train_hashed_forest(table, "y", ["a", "b"], numTrees=3, maxDepth=5, seed=7).transform(table).collect()
    assert any(abs(r.prediction - got[0][r.arrival_no]) > 1e-6 for r in other_seed)


def test_draws_are_poisson_and_differ_between_trees(spark):
    rows = spark.range(20_000).select(F.lit("s").alias("series_id"), F.col("id").alias("arrival_no"))
    n = rows.select(*[H.draws(H.KEY, k, 42).alias(f"d{k}") for k in range(2)]).toPandas()
    for k in range(4):
        assert abs((n.d0 == k).mean() - math.exp(-1) / math.factorial(k)) < 0.015
    assert abs(np.corrcoef(n.d0, n.d1)[0, 1]) < 0.03


def test_edges_are_exact_quantiles_of_any_layout(spark):
    """Quantiles from a sketch hang on the layout as soon as the sketch is compressed."""
    rng = np.random.default_rng(11)
    x = np.concatenate((rng.normal(0, 1e6, 60_000), rng.integers(-3, 4, 20_000), [-0.0, 0.0, 1e-300, -1e300, math.inf, -math.inf]))
    y = np.where(rng.random(len(x)) < 0.9, 1.0, 2.0)
    rows = spark.createDataFrame(pd.DataFrame({"series_id": "s", "arrival_no": np.arange(len(x)), "x": x, "y": y, "label": x}))
    want = [np.unique(np.sort(c)[[math.ceil(k / 32 * len(c)) - 1 for k in range(1, 32)]]) for c in (x, y)]
    for parts in (1, 7):
        blocks = H._blocks(rows.repartition(parts), ["x", "y"], "label", H.KEY, range(1), 42)
        for got, exact in zip(H.exact_edges(blocks, 2, len(x), 32), want):
            assert np.array_equal(got, exact)


def test_draws_hash_a_row_once(spark):
    """The chances share one hash; the counts are those of the chances one by one."""
    rows = spark.range(2000).select(F.when(F.col("id") % 7 != 0, F.lit("s")).alias("series_id"), F.col("id").alias("arrival_no"))
    plan = rows.select(H.draws(H.KEY, 1, 42).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5") == 1
    for r in rows.withColumn("d", H.draws(H.KEY, 1, 42)).collect():
        u = int(hashlib.md5(":".join(str(v) for v in (r.series_id, r.arrival_no, 1, 42) if v is not None).encode()).hexdigest()[:8], 16)
        assert r.d == sum(u >= c for c in H.DRAWN_AT_MOST)


def test_tree_is_the_best_one_by_hand(spark):
    """One level, all features: the split with the least squared error over the drawn rows, at least five rows a side."""
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 9, 300).astype(float), rng.integers(0, 5, 300).astype(float)
    y = np.where(a > 5, 3.0, 0.0) + b + rng.normal(0, 0.1, 300)
    rows = spark.createDataFrame(pd.DataFrame({"series_id": "s", "arrival_no": np.arange(300), "a": a, "b": b, "y": y}))
    w = np.array([r.d for r in rows.orderBy("arrival_no").select(H.draws(H.KEY, 0, 42).alias("d")).collect()], float)
    m = H.train_hashed_forest(rows, "y", ["a", "b"], numTrees=1, maxDepth=1, featureSubsetStrategy="all")

    def error(left):
        if min((left & (w > 0)).sum(), (~left & (w > 0)).sum()) < 5:
            return math.inf
        return sum((w[s] * (y[s] - np.average(y[s], weights=w[s])) ** 2).sum() for s in (left, ~left))

    best = min((x <= e for x, edges in zip((a, b), m.edges) for e in edges), key=error)
    want = np.where(best, np.average(y[best], weights=w[best]), np.average(y[~best], weights=w[~best]))
    got = [r.prediction for r in m.transform(rows).orderBy("arrival_no").collect()]
    assert np.allclose(got, want, atol=1e-9)
