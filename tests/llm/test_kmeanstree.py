"""Operator 9: recall against brute force, exact scores, ties, odd vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattlane.llm import kmeanstree, queries


def exact(ids, x, query, k=5):
    cos = (x @ x[query]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[query]))
    cos[query] = -2
    return [(int(ids[i]), cos[i]) for i in np.lexsort((ids, -np.round(cos, 12)))[:k]]


def test_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    got = {}
    for r in queries.op9_neighbours(spark, sf).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    queried = np.flatnonzero(ids % 50 == 0)
    assert set(got) == {int(ids[q]) for q in queried}
    hits = 0
    for q in queried:
        found = sorted(got[int(ids[q])])
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(a[2] >= b[2] for a, b in zip(found, found[1:]))
        cos = {int(i): c for i, c in zip(ids, (x @ x[q]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[q])))}
        assert all(abs(cos[v] - s) < 1e-12 for _, v, s in found)
        hits += len({f[1] for f in found} & {i for i, _ in exact(ids, x, q)})
    assert hits / (5 * len(queried)) >= 0.9


def test_a_deep_tree_over_skewed_vectors(spark, monkeypatch):
    monkeypatch.setattr(kmeanstree, "LEAF", 20)
    monkeypatch.setattr(kmeanstree, "SLOT", 50)
    rng = np.random.default_rng(3)
    x = np.concatenate([np.tile(rng.normal(size=8), (300, 1)), rng.normal(size=(600, 8))]).astype(np.float32)  # a third are copies
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    got = {}
    for r in kmeanstree.nearest_vectors(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    assert [v for _, v in sorted(got[0])] == [1, 2, 3, 4, 5] and [v for _, v in sorted(got[250])] == [0, 1, 2, 3, 4]  # ties to the smaller id
    x = x.astype(float)
    hits = sum(len({v for _, v in got[q]} & {i for i, _ in exact(np.arange(900), x, q)}) for q in got)
    assert hits >= 0.9 * 5 * len(got) and len(got) == 18


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 0.0])], [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.0, 1.0])]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r["rank"], r.vec_id) for r in kmeanstree.nearest_vectors(df, F.col("vec_id") % 50 == 0).collect()]
    assert sorted(got) == ([(0, 1, 1), (0, 2, 2)] if len(rows) == 3 else [])


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [None, 1.0], 1), (6, [1.0, 0.1], 1), (6, [1.0, 0.1], 1),
            (None, [1.0, 0.0], 1), (7, [1.0, 2.0, 3.0], 1), (50, [float("inf"), 1.0], 1), (8, [-1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, leaf int")
    got = [(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in kmeanstree.nearest_vectors(df, F.col("vec_id") % 50 == 0).orderBy("rank").collect()]
    assert got == [(0, 1, 6, 0.995037), (0, 2, 8, -1.0)]


def test_strays_get_five_neighbours(spark, monkeypatch):
    monkeypatch.setattr(kmeanstree, "LEAF", 20)
    monkeypatch.setattr(kmeanstree, "calibrated_visits", lambda *_: {16: 1})  # what tight topics come close to
    rng = np.random.default_rng(6)
    topics = rng.normal(size=(20, 16)) * 5
    x = np.concatenate([t + 0.01 * rng.normal(size=(60, 16)) for t in topics] + [rng.normal(size=(40, 16)) * 5])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in kmeanstree.nearest_vectors(df, (F.col("vec_id") >= 1200) | (F.col("vec_id") % 50 == 0)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    asked = [i for i in range(len(x)) if i >= 1200 or i % 50 == 0]
    assert sorted(got) == asked and {len(v) for v in got.values()} == {5}


def test_every_length_is_searched_by_itself(spark, monkeypatch):
    monkeypatch.setattr(kmeanstree, "LEAF", 25)
    rng = np.random.default_rng(8)
    sizes = {0: 8, 1: 8, 2: 8, 3: 4, 4: 3}  # by id % 5; ids 0 to 399
    rows = [(i, rng.normal(size=sizes[i % 5]).tolist()) for i in range(400)] + [(450, [1.0] * 17), (3, rng.normal(size=8).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = {(q, len(v)): np.array(v) for q, v in rows if q % 7 == 3 or q == 450}
    got = {}
    for r in kmeanstree.nearest_vectors(df, (F.col("vec_id") % 7 == 3) | (F.col("vec_id") == 450)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert 450 not in got and set(got) == {q for q, _ in asked if q != 450}
    hits = 0
    for (q, d), v in asked.items():
        if q in (3, 450):  # 3 has vectors of two lengths
            continue
        others = [(i, np.array(w)) for i, w in rows if len(w) == d and i != q]
        cos = {i: w @ v / (np.linalg.norm(w) * np.linalg.norm(v)) for i, w in others}
        assert [f[0] for f in sorted(got[q])] == [1, 2, 3, 4, 5] and all(abs(cos[i] - s) < 1e-12 for _, i, s in got[q])
        hits += len({i for _, i, _ in got[q]} & set(sorted(cos, key=lambda i: -cos[i])[:5]))
    assert hits >= 0.9 * 5 * (len(got) - 1)


def test_a_length_that_the_sample_misses_is_one_leaf(spark, monkeypatch):
    monkeypatch.setattr(kmeanstree, "SAMPLE", 3)
    monkeypatch.setattr(kmeanstree, "SLOT", 4)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=2 + i % 9).tolist()) for i in range(180)]
    got = {}
    for r in kmeanstree.nearest_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    for q in (0, 50, 100, 150):
        v = np.array(rows[q][1])
        cos = {i: np.dot(w, v) / (np.linalg.norm(w) * np.linalg.norm(v)) for i, w in rows if len(w) == len(v) and i != q}
        assert [i for _, i in sorted(got[q])] == sorted(cos, key=lambda i: (-cos[i], i))[:5]
