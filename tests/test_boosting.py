"""Second-order boosting: trees against plain counting over rows, both ways of summing, NULL rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlane.operators import boosting as B


def plain_trees(x, y, edges, rounds, depth, rate, l2):
    """Greedy trees by trying every edge on every node's rows."""
    pred, trees = np.full(len(y), y.mean()), []
    for _ in range(rounds):
        node, tree = np.zeros(len(y), int), {}
        for level in range(depth):
            for k in range((1 << level) - 1, (1 << (level + 1)) - 1):
                own = node == k
                g = (pred - y)[own]
                best = (0.0, None, None)
                for f, es in enumerate(edges):
                    for b, e in enumerate(es):
                        left = x[own, f] <= e
                        n = left.sum()
                        if 1 <= n < own.sum():
                            gl = g[left].sum()
                            gain = gl ** 2 / (n + l2) + (g.sum() - gl) ** 2 / (own.sum() - n + l2) - g.sum() ** 2 / (own.sum() + l2)
                            if round(gain / len(y), 6) > best[0]:
                                best = (round(gain / len(y), 6), f, b)
                if best[1] is not None:
                    tree[k] = best[1:]
                    node[own] = 2 * k + 1 + (x[own, best[1]] > edges[best[1]][best[2]])
        for k in np.unique(node):
            own = node == k
            tree[k] = -rate * (pred - y)[own].sum() / (own.sum() + l2)
        pred = pred + np.array([tree[k] for k in node])
        trees.append(tree)
    return trees, pred


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(4)
    rows = []
    for i in range(700):
        a, b, c = rng.gauss(0, 1), float(rng.randrange(24)), float(rng.randrange(3))
        rows.append((i, a, b, c, 3 * a + (5 if b > 12 else 0) * c + rng.gauss(0, 0.3)))
    rows += [(700, None, 1.0, 1.0, 1.0), (701, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(3)


@pytest.mark.parametrize("max_cells", [1 << 18, 0])
def test_trees_equal_plain_counting(table, max_cells):
    m = B.train_histogram_boosted(table, "y", ["a", "b", "c"], rounds=3, rate=0.3, depth=3, l2=1.5, max_bins=8, max_cells=max_cells)
    rows = table.dropna().orderBy("id").collect()
    x, y = np.array([r[1:4] for r in rows]), np.array([r.y for r in rows])
    trees, pred = plain_trees(x, y, m.edges, 3, 3, 0.3, 1.5)
    for got, want in zip(m.trees, trees, strict=True):
        for k, v in want.items():
            assert (int(got.feature[k]), int(got.bin[k])) == v if isinstance(v, tuple) else got.value[k] == pytest.approx(v, abs=1e-9)
    assert np.allclose(m.predict(x), pred)
    assert m.losses[-1] == pytest.approx(((pred - y) ** 2).mean())
    assert all(b < a for a, b in zip(m.losses, m.losses[1:]))


def test_nulls_and_empty_tables(spark, table):
    m = B.train_histogram_boosted(table, "y", ["a", "b", "c"], rounds=2, depth=2)
    out = {r.id: r.prediction for r in m.transform(table).collect()}
    assert out[700] is None and out[701] is not None and len(out) == 702
    with pytest.raises(ValueError):
        B.train_histogram_boosted(table.where("id < 0"), "y", ["a"], rounds=1)
    same = B.train_histogram_boosted(spark.range(5).select(F.lit(1.0).alias("a"), F.lit(2.0).alias("y")), "y", ["a"], rounds=2)
    assert same.predict(np.array([[1.0], [9.0]])).tolist() == [2.0, 2.0]


def test_l2_and_rate_shrink_the_leaves(table):
    size = {}
    for l2, rate in ((0.0, 1.0), (50.0, 1.0), (0.0, 0.1)):
        m = B.train_histogram_boosted(table, "y", ["a", "b", "c"], rounds=1, rate=rate, depth=1, l2=l2)
        size[l2, rate] = np.abs(m.trees[0].value).max()
    assert size[50.0, 1.0] < size[0.0, 1.0] and size[0.0, 0.1] == pytest.approx(0.1 * size[0.0, 1.0])


def test_many_rounds_beat_few_on_unseen_rows(table):
    train, held = table.dropna().where("id % 4 <> 0"), table.dropna().where("id % 4 = 0")
    errors = [held.transform(lambda d, m=B.train_histogram_boosted(train, "y", ["a", "b", "c"], rounds=r): m.transform(d))
              .agg(F.avg((F.col("prediction") - F.col("y")) ** 2)).first()[0] for r in (5, 200)]
    assert errors[1] < 0.2 * errors[0]


def test_bins_of_rows_are_those_of_the_edges(spark):
    """Compiled comparisons, no function over an array per row; NULL is below all edges, NaN above."""
    edges = np.array([-1.0, 0.0, 2.5, 7.0])
    df = spark.createDataFrame([(v,) for v in (-5.0, -1.0, 0.0, 0.1, 2.5, 7.0, 8.0, float("nan"), None)], "a double")
    out = df.select("a", B.bin_of("a", edges).alias("bin"))
    assert [r.bin for r in out.collect()] == [0, 0, 1, 2, 2, 3, 4, 4, 0]
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_trained_combinations_are_served_from_their_sums(table):
    """The sums are exactly what the trees give; combinations that did not train go through the trees."""
    m = B.train_histogram_boosted(table, "y", ["a", "b", "c"], rounds=5, depth=3, max_bins=8)
    x = np.array([[r.a, r.b, r.c] for r in table.dropna().collect()] + [[9.0, 99.0, -9.0], [-9.0, 0.0, 9.0]])
    served = m.predict(x)
    assert len(m.codes) and m.summed == 5
    m.codes = None
    assert served.tolist() == m.predict(x).tolist()
